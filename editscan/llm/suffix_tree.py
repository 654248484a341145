"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of up to ``max_depth`` words, the begin of a document included. A context is
a candidate if it occurs ``min_count`` times or more in training, at any size of corpus; it is
retained if the log-likelihood of what follows it, each occurrence left out once, exceeds that
under its longest retained suffix by ``min_divergence`` nats a token or more.
A state's next-symbol distribution is (count + strength * p) / (occurrences + strength), with p
its suffix's; no count is cut. The root is the add-one unigram distribution over all training words.

A token is scored in the longest state that is a suffix of what precedes it in its document.

Contexts, symbols and verdicts never come together anywhere: each depth's counts and verdicts are
tables dealt by key ranges and joined back to the token blocks, which carry the counts and
verdicts of the depths so far and make each token's probability of them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_SCHEMA, Block, _arrow_schema, count_exchange, flags_exchange, flags_of, mix64, pack, planes, rows_to_batch, stage, token_blocks, totals_of, unpack, unplanes, unstage

BEGIN, END, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_STATE = BLOCK_SCHEMA + ", uni binary, counts array<binary>, keeps array<binary>, n_next long"


class State(Block):
    """A token block with the counts and verdicts of each depth, per token (ends of documents included).

    ns[d] are the training counts of (context of d words, token), 0 where the context is no
    candidate; keeps[d - 1] flags the tokens whose context of d words is a state.
    """

    def __init__(self, row: dict):
        super().__init__(row)
        lens = self.lens + 1
        ends = np.cumsum(lens) - 1
        self.row, self.size = row, int(lens.sum())
        self.is_end = np.zeros(self.size, bool)
        self.is_end[ends] = True
        self.sym = np.full(self.size, END)
        self.sym[~self.is_end] = self.vocab[self.ids]
        self.at = np.arange(self.size) - np.repeat(ends - self.lens, lens)
        self.train = np.repeat(self.marks, lens)
        self.doc = np.repeat(np.arange(len(lens)), lens)
        if "uni" in row:
            own = np.zeros(self.size, np.int64)
            own[~self.is_end] = unplanes(row["uni"])[self.ids]
            self.ns = [own, *map(unplanes, row["counts"])]
            self.keeps = [np.unpackbits(unpack(b, np.uint8), count=self.size).astype(bool) for b in row["keeps"]]

    def seen(self, depth: int, trained: int) -> np.ndarray:
        """Training counts of each token's context of ``depth`` words."""
        seen = np.zeros(self.size, np.int64)
        seen[1:] = self.ns[depth - 1][:-1]
        seen[self.at < max(depth - 1, 1)] = 0
        if depth == 1:
            seen[self.at == 0] = trained
        return seen

    def contexts(self, depth: int, trained: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens after candidates of ``depth`` words, the candidates' hashes and training counts."""
        seen = self.seen(depth, trained)
        use = np.flatnonzero(seen >= least)
        at, h = self.at[use], np.zeros(len(use), np.uint64)
        for j in range(1, depth + 1):
            h = mix64(h * STEP + np.where(at >= j, self.sym[use - j], BEGIN))
        return use, h, seen[use]

    def grams(self, use: np.ndarray, h: np.ndarray) -> np.ndarray:
        return mix64((h ^ END) * STEP + self.sym[use])

    def sums(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=w, minlength=len(self.lens))


def suffix_tree_scores(docs: DataFrame, train: F.Column, doc_id: str = "doc_id", text: str = "text", max_depth: int = 3, min_count: int = 2, strength: float = 2.0, min_divergence: float = 0.01, **sizes) -> DataFrame:
    """Scores every document with a tree learned from those where ``train`` is true.

    Returns one row per input row: doc_id, held_out (not train), n_tokens, n_known,
    train_tokens, base_score (add-one unigram) and score, both log10 probabilities. Null text
    is an empty document, which has its end token only; a null id stays null (and, its train
    flag being null, counts as not train); repeated rows each count and are each scored; with
    no training document all words are unseen and both scores agree. Other columns are ignored.
    ``sizes`` go to common.key_exchange (keys_per_range, fan) and change no result.
    """
    if max_depth < 1 or min_count < 2:
        raise ValueError("max_depth must be 1 or more and min_count 2 or more")
    spark = docs.sparkSession
    blocks = stage(token_blocks(docs, text, doc_id, mark=train), "blocks", by="block")
    words, trained, keys = blocks.agg(F.coalesce(F.sum("marked_tokens"), F.lit(0)), F.coalesce(F.sum("marked_docs"), F.lit(0)), F.coalesce(F.sum(F.length("vocab") / 8), F.lit(0)).cast("long")).first()
    n = words + trained

    def drop(*old: DataFrame) -> None:
        for df in old:
            unstage(df)

    def keys_of(x: Block):
        at = np.argsort(x.vocab)
        counts = np.bincount(x.ids[np.repeat(x.marks, x.lens)], minlength=len(x.vocab))
        return x.vocab[at], counts[at]

    hops = []
    got = stage(count_exchange(blocks, keys_of, keys, scratch=hops, **sizes), "counts")
    drop(*hops)
    v = (got.where("unit = -1").agg(F.sum("n_pos")).first()[0] or 0) + (trained > 0)
    names = [f.strip().split(" ")[0] for f in _STATE.split(", ")]
    schema, out = _arrow_schema(spark, _STATE), _arrow_schema(spark, _OUT)

    def made(x: State) -> pa.RecordBatch:
        row = x.row | {"n_next": int((x.seen(len(x.ns), trained) >= min_count).sum())}
        return rows_to_batch([tuple(row[c] for c in names)], schema)

    def chances(x: State) -> tuple[np.ndarray, np.ndarray]:
        """Each token's training count, and its probability by the states of the depths judged so far."""
        c = np.where(x.is_end, trained, x.ns[0])
        p = (c + 1) / (n + v + 1)
        for d, keep in enumerate(x.keeps, 1):
            p[keep] = (x.ns[d][keep] + strength * p[keep]) / (x.seen(d, trained)[keep] + strength)
        return c, p

    def rows_of(table: pa.Table):
        for r in range(table.num_rows):
            yield {c: table.column(c)[r].as_py() for c in table.schema.names}

    def root(table: pa.Table, totals: pa.Table) -> pa.Table:
        made_ = []
        for row in rows_of(table):
            known = np.empty(len(row["vocab"]) // 8, np.uint64)
            known[np.argsort(np.frombuffer(row["vocab"], np.uint64))] = totals_of(totals)
            made_.append(made(State(row | {"uni": planes(known), "counts": [], "keeps": []})))
        return pa.Table.from_batches(made_, schema=schema)

    def left_out(x: State, depth: int):
        use, h, seen = x.contexts(depth, trained, min_count)
        p = chances(x)[1][use]
        uniq, inv = np.unique(h, return_inverse=True)
        gain = np.log((np.maximum(x.ns[depth][use].astype(float) - 1, 0) + strength * p) / ((seen - 1 + strength) * p)) - min_divergence
        return uniq, np.bincount(inv, weights=np.where(x.train[use], gain, 0.0), minlength=len(uniq))

    def counted(x: State, depth: int):
        use, h, _ = x.contexts(depth, trained, min_count)
        uniq, inv = np.unique(x.grams(use, h), return_inverse=True)
        return uniq, np.bincount(inv, weights=x.train[use], minlength=len(uniq)).astype(np.int64)

    def judged(x: State, totals: pa.Table, depth: int) -> np.ndarray:
        """Whether each token's context of ``depth`` words is a state."""
        use, h, _ = x.contexts(depth, trained, min_count)
        keep = np.zeros(x.size, bool)
        keep[use] = flags_of(totals)[np.unique(h, return_inverse=True)[1]]
        return keep

    def of(totals: pa.Table, kind: int) -> pa.Table:
        return totals.filter(pc.equal(totals.column("kind"), kind))

    def next_depth(depth: int):
        def run(table: pa.Table, totals: pa.Table) -> pa.Table:
            made_ = []
            for row in rows_of(table):
                x = State(row)
                keeps = [*row["keeps"], pack(np.packbits(judged(x, of(totals, 1), depth - 1)))] if depth > 1 else []
                use, h, _ = x.contexts(depth, trained, min_count)
                counts = np.zeros(x.size, np.int64)
                counts[use] = totals_of(of(totals, 0))[np.unique(x.grams(use, h), return_inverse=True)[1]]
                x.row, x.ns = row | {"counts": [*row["counts"], planes(counts)], "keeps": keeps}, [*x.ns, counts]
                made_.append(made(x))
            return pa.Table.from_batches(made_, schema=schema)

        return run

    def scored(depth: int):
        def run(table: pa.Table, totals: pa.Table) -> pa.Table:
            made_ = []
            for row in rows_of(table):
                x = State(row)
                if depth:
                    x.keeps.append(judged(x, totals, depth))
                known, p = chances(x)
                base = np.log10((known + 1) / (n + v + 1))
                cols = [x.doc_ids, ~x.marks, x.lens + 1, x.sums(known > 0).astype(np.int64), np.full(len(x.lens), n), x.sums(base), x.sums(np.log10(p))]
                made_.append(pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(cols, out)], schema=out))
            return pa.Table.from_batches(made_, schema=out)

        return run

    def followers(s: DataFrame) -> int:
        return s.agg(F.coalesce(F.sum("n_next"), F.lit(0))).first()[0]

    def returned(exchange: Callable, s: DataFrame, keys_of: Callable, n_keys: int, kind: int) -> DataFrame:
        """The blocks' answers of one exchange, staged before the next begins: one's entries at a time are on disk."""
        hops = []
        rows = exchange(s, keys_of, n_keys, kind=State, scratch=hops, **sizes).where("unit >= 0").select("slot", F.col("unit").alias("block"), "totals", F.lit(kind).alias("kind"))
        answers = stage(rows, "totals")
        drop(*hops)
        return answers

    def verdicts(s: DataFrame, depth: int, now: int) -> DataFrame:
        return returned(flags_exchange, s, lambda x: left_out(x, depth), now, 1)

    cur = stage(blocks.groupBy("block").cogroup(got.where("unit >= 0").groupBy("unit")).applyInArrow(root, _STATE), "states", by="block")
    depth, now, more = 0, 0, followers(cur)
    drop(blocks, got)
    while depth < max_depth and more:
        answers = [verdicts(cur, depth, now)] if depth else []
        depth += 1
        answers.append(returned(count_exchange, cur, lambda x, d=depth: counted(x, d), more, 0))
        totals = functools.reduce(DataFrame.unionByName, answers)
        before, cur = cur, stage(cur.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(next_depth(depth), _STATE), "states", by="block")
        now, more = more, followers(cur)
        drop(before, *answers)
    last = [verdicts(cur, depth, now)] if depth else []
    totals = last[0] if last else cur.select(F.lit(0).cast("long").alias("slot"), "block", F.lit(None).cast("binary").alias("totals"), F.lit(1).alias("kind")).limit(0)
    scores = stage(cur.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(scored(depth), _OUT), "scores")
    drop(cur, *last)
    return scores
