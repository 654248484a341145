"""Sums per key over blocks, at every number of hops, against plain Python."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from editscan.llm import suffix_tree
from editscan.llm.common import Block, count_exchange, flags_exchange, flags_of, shared_dir, stage, token_blocks, totals_of
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def made(spark, parts=5):
    rng = random.Random(4)
    texts = [" ".join(["the", *(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(30))]) for _ in range(120)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def own(x: Block):
    at = np.argsort(x.vocab)
    return x.vocab[at], np.bincount(x.ids, minlength=len(x.vocab))[at]


@pytest.mark.parametrize("per, fan", [(1 << 21, 256), (200, 256), (60, 3), (20, 2)])
def test_sums(spark, per, fan):
    blocks = stage(token_blocks(made(spark), "text", "doc_id", block_tokens=200), "blocks")
    rows = [Block(r.asDict()) for r in blocks.collect()]
    want, n = Counter(), 0
    for x in rows:
        n += len(x.vocab)
        want.update(dict(zip(*(a.tolist() for a in own(x)))))
    assert len(rows) > 15
    counts = count_exchange(blocks, own, n, keys_per_range=per, fan=fan, top=100)
    got = counts.toArrow()
    for x in rows:
        mine = got.filter(np.asarray(got.column("unit")) == x.block)
        assert totals_of(mine).tolist() == [want[k] for k in own(x)[0].tolist()]
    ends = [r.asDict() for r in counts.where("unit < 0").collect()]
    assert sum(r["n_pos"] for r in ends) == len(want)
    signs = flags_exchange(blocks, lambda x: (own(x)[0], own(x)[1] - 1.5), n, keys_per_range=per, fan=fan).toArrow()
    for x in rows:
        mine = signs.filter(np.asarray(signs.column("unit")) == x.block)
        held = Counter(k for y in rows for k in y.vocab.tolist())
        assert flags_of(mine).tolist() == [want[k] >= 1.5 * held[k] for k in own(x)[0].tolist()]


def test_rows_follow_blocks(spark):
    """With hops, twice the blocks send about twice the rows, not four times."""
    sent = []
    for parts in (4, 8):
        docs = made(spark)
        docs = docs if parts == 4 else docs.unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" x")).alias("text")))
        blocks = stage(token_blocks(docs.repartition(parts), "text", "doc_id", block_tokens=200), "blocks")
        n = blocks.agg(F.sum(F.length("vocab") / 8)).first()[0]
        sent.append(count_exchange(blocks, own, int(n), keys_per_range=20, fan=4).where("unit >= 0").count() / blocks.count())
    assert sent[1] < 1.5 * sent[0]


def test_scores_do_not_depend_on_hops(spark):
    docs = made(spark)
    scores = [{r["doc_id"]: r["score"] for r in suffix_tree.suffix_tree_scores(docs, F.col("doc_id") % 7 != 2, **sizes).collect()} for sizes in ({}, {"keys_per_range": 300, "fan": 3})]
    assert scores[0] == pytest.approx(scores[1])


def test_only_the_scores_stay(spark):
    """Tables of hops hold every entry of an exchange; no table but the result stays, at any number of hops."""
    top = Path(shared_dir(spark).removeprefix("file:")) / "editscan"
    for sizes in ({}, {"keys_per_range": 300, "fan": 3}):
        before = set(top.iterdir()) if top.exists() else set()
        suffix_tree.suffix_tree_scores(made(spark), F.col("doc_id") % 7 != 2, **sizes)
        assert [p.name.split("-")[0] for p in set(top.iterdir()) - before] == ["scores"]
