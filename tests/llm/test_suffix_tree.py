"""Every state and score against brute force, and rare evidence in a corpus of any size."""

import math
import random
from collections import Counter, defaultdict

import pytest
from editscan.llm import suffix_tree
from pyspark.sql import functions as F


def brute(docs, depth, strength=2.0, least=2, min_divergence=0.01):
    """id: score; docs are (id, train, text)."""
    seqs = {i: (t, ["<", *x.split(), None]) for i, t, x in docs}
    uni = Counter(w for t, s in seqs.values() if t for w in s[1:])
    n, v = sum(uni.values()), len(uni)
    follow = defaultdict(Counter)
    for t, s in seqs.values():
        for i in range(1, len(s)) if t else ():
            for d in range(1, min(depth, i) + 1):
                follow[tuple(s[i - d : i])][s[i]] += 1
    kept = {}

    def p(ctx, w):
        if not ctx:
            return (uni[w] + 1) / (n + v + 1)
        below = p(ctx[1:], w)
        return (follow[ctx][w] + strength * below) / (follow[ctx].total() + strength) if kept.get(ctx) else below

    for ctx in sorted(follow, key=len):
        seen = follow[ctx].total()
        gain = sum(c * math.log((c - 1 + strength * p(ctx[1:], w)) / ((seen - 1 + strength) * p(ctx[1:], w))) for w, c in follow[ctx].items()) if seen >= least else 0
        kept[ctx] = seen >= least and gain / seen >= min_divergence
    return {i: sum(math.log10(p(tuple(s[max(0, i - depth) : i]), s[i])) for i in range(1, len(s))) for i, (_, s) in seqs.items()}, kept


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_scores(spark, depth):
    rng = random.Random(depth)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [texts[0] + " x y z", texts[1] + " x y z w", "x y z w", "x y z w", ""]
    docs = [(i, i % 7 != 2, t) for i, t in enumerate(texts)]
    want, kept = brute(docs, depth)
    assert depth < 3 or any(k and len(c) == depth for c, k in kept.items())
    got = suffix_tree.suffix_tree_scores(spark.createDataFrame(docs, "doc_id long, t boolean, text string").repartition(3), F.col("t"), max_depth=depth)
    assert {r["doc_id"]: r["score"] for r in got.collect()} == pytest.approx(want, rel=1e-5)


def test_evidence_stays_in_a_larger_corpus(spark):
    """A passage trained on twice gains by the same states whatever else is trained on."""
    said = " ".join(f"p{i}" for i in range(50))
    gains = []
    for more in (10, 1500):
        docs = [(0, True, said), (1, True, said), (2, False, said)] + [(3 + i, True, " ".join(f"d{i}w{k}" for k in range(40))) for i in range(more)]
        got = suffix_tree.suffix_tree_scores(spark.createDataFrame(docs, "doc_id long, t boolean, text string"), F.col("t"))
        r = got.where("doc_id = 2").first()
        gains.append(r["score"] - r["base_score"])
        assert r["score"] > -0.5 * r["n_tokens"]
    assert gains[1] > gains[0] > 0
