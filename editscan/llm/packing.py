"""Packing by minimum bin slack.

Documents are cut into whole windows and one remainder each. Remainder lengths form a histogram
of fewer than ``window`` entries, whatever the input's size. The driver fills one window at a
time: the longest remaining length opens it, and a bitset subset-sum over the remaining
multiset picks, with backtracked counts, what comes closest to the capacity. The pattern is then
used as often as the histogram allows, so the plan has a few thousand segments at most. Pieces
find their place by their rank within their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, release, rows_to_batch, slices, stage

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, nth long"
_PLAN = "length long, low long, high long, per long, sequence long, at long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that the sum is the largest that fits.

    The longest length present is taken at least once. Bits of ``reach`` are reachable sums.
    """
    first = max(counts)
    left = dict(counts)
    left[first] -= 1
    room = capacity - first
    lengths = [x for x in sorted(left, reverse=True) if left[x] and x <= room]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in lengths:
        bits, many, step = reach[-1], min(left[x], room // x), 1
        while many:
            take = min(step, many)
            bits |= bits << (x * take) & mask
            many -= take
            step *= 2
        reach.append(bits)
        if bits >> room & 1:
            break
    took, total = {first: 1}, reach[-1].bit_length() - 1
    for k in range(len(reach) - 1, 0, -1):
        x = lengths[k - 1]
        while not reach[k - 1] >> total & 1:
            took[x] = took.get(x, 0) + 1
            total -= x
    return took


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, low, high, per, sequence, at): ranks low to high - 1 of a length go, ``per`` to a sequence, to the sequences from ``sequence`` on, the first at offset ``at``."""
    left = {x: n for x, n in histogram.items() if n > 0}
    used, out, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        took = fill(left, capacity)
        times = min(left[x] // n for x, n in took.items())
        at = 0
        for x, n in sorted(took.items(), reverse=True):
            out.append((x, used[x], used[x] + n * times, n, sequence, at))
            used[x] += n * times
            at += n * x
            left[x] -= n * times
            if not left[x]:
                del left[x]
        sequence += times
    return out


def token_pieces(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as pieces of at most ``window`` ids (binary, little-endian unsigned 32-bit).

    ``vocabulary`` is a byte-level BPE in the tokenizers library's JSON form, a path on every
    machine; the ids are those of its ``encode(text, add_special_tokens=False)``. A null text is
    empty, a document of the end id alone; a null id stays null; repeated rows are cut each.
    """
    schema = _arrow_schema(docs.sparkSession, _PIECES)

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b in slices(batches):
            rows, size = [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), end_id], "<u4")
                for s in range(0, len(ids), window):
                    x = ids[s : s + window]
                    rows.append((d, s, len(x), x.tobytes(), len(ids), part, int(seen[len(x)])))
                    seen[len(x)] += 1
                    size += len(x)
                if size > 1_000_000:
                    yield rows_to_batch(rows, schema)
                    rows, size = [], 0
            yield rows_to_batch(rows, schema)
        release()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _PIECES)


def encoder(vocabulary: str):
    """A function from text to ids, those of the tokenizers library for a byte-level BPE whose ids follow its merges.

    tiktoken applies the merges several times faster; texts that spell an added token, which the
    library takes out before it splits a text, go to the library itself.
    """
    import json

    import tiktoken

    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    model, added = spec["model"], [t["content"] for t in spec["added_tokens"]]
    del spec
    # The format's alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up, in order.
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if w not in set(added)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast, slow = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, []

    def encode(text: str) -> list[int]:
        if not any(t in text for t in added):
            return fast(text)
        if not slow:  # Few texts need it, and it takes memory.
            slow.append(Tokenizer.from_file(vocabulary))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", carry: tuple = ("ids",)) -> DataFrame:
    """Every piece with its sequence: doc_id, start, length, doc_tokens, sequence_id, offset and ``carry``.

    ``carry`` holds columns of a piece (its ids by default) or expressions of them, evaluated
    before the only shuffles, which otherwise move no ids. A sequence's pieces stand side by
    side from offset 0. Null or empty text is a document of the end id alone; a null id stays
    null; repeated rows are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = stage(token_pieces(docs, vocabulary, window, end_id, doc_id, text), "pieces", "zstd")
    each = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = spark.createDataFrame(plan(histogram, window), _PLAN)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = each.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    small = pieces.select("doc_id", "start", "length", "doc_tokens", "part", "nth", *carry)
    placed = small.join(ranks, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    # Broadcast: segments are bounded by the window's length, not by the input.
    placed = placed.join(F.broadcast(segments.withColumnRenamed("length", "len")), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    rest = [c for c in small.columns if c not in {"part", "nth"}]
    return placed.select(*rest, (F.col("sequence") + F.expr("(rank - low) div per")).alias("sequence_id"), (F.col("at") + at % F.col("per") * F.col("length")).alias("offset"))
