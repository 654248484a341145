"""N-gram Jaccard join by prefix filters under several global orders.

Every order ranks shingles by a power-of-two class of their document frequency, rare first,
and breaks ties by its own permutation of the hash. Two sets of Jaccard similarity t or more
share a token among the first |x| - ceil(t|x|) + 1 of each, under *every* such order, so the
orders' filters are intersected before a pair is verified on the whole sets. Shingles that
only one document holds (class 0) open every order and never need to be looked up: a document
whose prefix is full of them is done.

Groups of near copies are not expanded into pairs. Each prefix token first offers its cleanest
document as a pivot to the token's other documents (one candidate each); components of those
links follow, and only pairs that are still in different components and pass the length,
position and order filters are then generated and verified. That second step is exact: no link
between two components can be missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Block, _arrow_schema, components, count_exchange, mix64, rows_to_batch, stage, token_blocks, totals_of, unstage

ORDERS = 3
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)

_DDL = "rid long, doc_id long, n int, digest binary, clean int, toks array<long>, poss array<int>, others array<array<long>>, tokens array<long>"


def shingle_sets(x: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the distinct k-word shingle hashes, ascending; and documents' set sizes.

    Fewer than k words make one shingle of the whole sequence; no words, none.
    """
    if not 1 <= k <= len(_ODD):
        raise ValueError(f"shingles of 1 to {len(_ODD)} words are supported")
    w, n = x.vocab[x.ids], len(x.ids)
    h, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += w[j : n - k + 1 + j] * np.uint64(_ODD[j])
        inside = x.doc_of[: n - k + 1] == x.doc_of[k - 1 :]
        h, owner = mix64(h[inside]), x.doc_of[: n - k + 1][inside]
    short = np.flatnonzero((x.lens > 0) & (x.lens < k))
    if len(short):
        whole = np.full(len(short), 0, np.uint64)
        for j in range(k - 1):
            has = x.lens[short] > j
            whole[has] += w[x.starts[short[has]] + j] * np.uint64(_ODD[j])
        whole = mix64(whole ^ mix64(x.lens[short].astype(np.uint64)))
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
    at = np.lexsort((h, owner))
    h, owner = h[at], owner[at]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[new], owner[new]
    return h, np.bincount(owner, minlength=len(x.lens))


def _minimum(n: np.ndarray | int, num: int, den: int):
    """ceil(t * n): the least overlap with any partner."""
    return -(-num * n // den)


def _signatures(blocks: DataFrame, k: int, num: int, den: int, n_tokens: int) -> DataFrame:
    """A row per document; the columns after n are null where no partner is possible."""
    bits = np.uint64(64 - min(64, int(np.ceil(np.log2(n_tokens + 2))) + 6))
    schema = _arrow_schema(blocks.sparkSession, _DDL)

    def keys_of(x: Block):
        return np.unique(shingle_sets(x, k)[0] >> bits << bits, return_counts=True)

    def sign(blocks_: pa.Table, totals: pa.Table) -> pa.Table:
        rows = []
        for r in range(blocks_.num_rows):
            x = Block({c: blocks_.column(c)[r].as_py() for c in blocks_.schema.names})
            h, sizes = shingle_sets(x, k)
            short = h >> bits << bits
            df = totals_of(totals)[np.searchsorted(np.unique(short), short)]
            cls = np.log2(np.maximum(df, 1)).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            unique = np.bincount(owner, weights=cls == 0, minlength=len(sizes)).astype(np.int64)
            prefix = sizes - _minimum(sizes, num, den) + 1
            maybe = (sizes > 0) & (unique < prefix)
            ends = np.cumsum(sizes)
            for d in range(len(sizes)):
                row = [(x.block << 21) + d, x.doc_ids[d], int(sizes[d])]
                if not maybe[d]:
                    rows.append((*row, *[None] * 6))
                    continue
                s, c = h[ends[d] - sizes[d] : ends[d]], cls[ends[d] - sizes[d] : ends[d]]
                p, u, orders = int(prefix[d]), int(unique[d]), []
                for o in range(ORDERS):
                    at = np.lexsort((mix64(s + np.uint64(_ODD[o])), c))[u:p]
                    orders.append(s[at])
                rows.append((*row, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), u, orders[0].view(np.int64).tolist(), list(range(u, p)), [t.view(np.int64) for t in orders[1:]], s.view(np.int64)))
        return pa.Table.from_batches([rows_to_batch(rows, schema)])

    got = count_exchange(blocks, keys_of, n_tokens)
    return blocks.groupBy("block").cogroup(got.where("unit >= 0").groupBy("unit")).applyInArrow(sign, _DDL)


def _verify(pairs: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every other order, and then link.

    Only prefixes travel to all pairs; whole sets join those that every order leaves.
    """
    short = lambda s: sigs.select(F.col("rid").alias(s), F.col("others").alias(f"o{s}"))
    whole = lambda s: sigs.select(F.col("rid").alias(s), F.col("tokens").alias(f"t{s}"))
    left = pairs.join(short("a"), "a").join(short("b"), "b")
    for o in range(ORDERS - 1):
        left = left.where(F.arrays_overlap(F.get("oa", F.lit(o)), F.get("ob", F.lit(o))))
    both = F.size(F.array_intersect("ta", "tb"))
    wide = left.select("a", "b").join(whole("a"), "a").join(whole("b"), "b").withColumn("both", both)
    return wide.where(F.col("both") * den >= (F.size("ta") + F.size("tb") - F.col("both")) * num).select("a", "b")


def ngram_jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents linked at a k-word shingle Jaccard similarity of num/den or more.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable
    by links), is_first (true for one row of each component: the smallest id, ties broken
    arbitrarily but once). Null or wordless text: n_shingles 0, linked with nothing. A null
    doc_id keeps its row; it counts for a component's links but not for its id (null where no
    id is known). Repeated rows link with each other. Other columns are ignored.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must be above 0 and at most 1")
    blocks = stage(token_blocks(docs, text, doc_id), "blocks")
    n_tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    sigs = stage(_signatures(blocks, k, num, den, n_tokens), "signatures")
    unstage(blocks)

    classes = sigs.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    classes = stage(classes, "classes")
    reps = classes.select(F.col("rep").alias("rid"))
    rep_sigs = stage(sigs.where("digest is not null").join(reps, "rid", "left_semi"), "representatives")

    rows = rep_sigs.select("rid", "n", "clean", F.explode(F.arrays_zip("toks", "poss")).alias("z")).select("rid", "n", "clean", F.col("z.toks").alias("tok"), F.col("z.poss").alias("pos"))
    pivots = rows.groupBy("tok").agg(F.count("*").alias("m"), F.min(F.struct((F.col("clean") / F.col("n")).alias("c"), "rid", "n")).alias("p")).where("m > 1").select("tok", F.col("p.rid").alias("prid"), F.col("p.n").alias("pn"))
    rows = stage(rows.join(pivots, "tok"), "tokens")

    near = lambda p, q: (F.col(p) * den >= F.col(q) * num) & (F.col(q) * den >= F.col(p) * num)
    star = rows.where("rid <> prid").where(near("n", "pn")).select(F.least("rid", "prid").alias("a"), F.greatest("rid", "prid").alias("b")).distinct()
    links = stage(_verify(star, rep_sigs, num, den), "links")
    label = components(links)

    # A link needs an overlap of o = t/(1+t) * (n + m) or more. At the first common token the shorter set still has n - pos tokens, so pos <= n - o.
    lab = stage(rows.select("tok", "rid", "n", "pos").join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")), "labelled")
    mixed = lab.groupBy("tok").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("tok")
    lab = lab.join(mixed, "tok", "left_semi")
    shorter = lab.where(F.col("pos") * (num + den) <= F.col("n") * (den - num)).select("tok", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"))
    longer = lab.select("tok", F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"))
    need = F.col("num_") * (F.col("na") + F.col("nb"))
    cross = shorter.withColumn("num_", F.lit(num)).join(longer, "tok").where((F.col("ra") != F.col("rb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") * den >= F.col("nb") * num) & ((F.col("na") - F.col("pa")) * (num + den) >= need) & ((F.col("nb") - F.col("pb")) * (num + den) >= need))
    pairs = cross.select("a", "b").distinct()
    more = stage(_verify(pairs, rep_sigs, num, den), "links")
    final = components(links.unionByName(more).select("a", "b"))

    member = sigs.select("rid", "doc_id", "n", "digest").join(classes, "digest", "left")
    member = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("rid", "doc_id", "n", F.coalesce("root", "rep", "rid").alias("comp"), (F.coalesce("copies", F.lit(1)) + F.when(F.col("root").isNotNull(), 1).otherwise(0)).alias("others"))
    member = stage(member, "members")
    alone = member.where("others = 1").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
    grouped = member.where("others > 1")
    first = grouped.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min_by("rid", F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("frid"))
    linked = grouped.join(first, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("rid") == F.col("frid")).alias("is_first"))
    return alone.unionByName(linked)


def one_of_each_component(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that are first of their component in ``found``; columns stay.

    Of rows that share an id, null included, as many stay as were first, by the order of their
    values.
    """
    ids = found.groupBy(F.col("doc_id").alias("_d")).agg(F.sum(F.col("is_first").cast("int")).alias("_keep"), F.count("*").alias("_all")).where("_keep < _all")
    # Rows without an entry stay, so only ids that lose a row are looked up.
    # The given columns travel as one, so that none can clash with those made here.
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).alias("_i"))
    d = rows.join(stage(ids, "losers").hint("shuffle_hash"), F.col("_i").eqNullSafe(F.col("_d")), "left")
    some = d.where("_keep > 0").withColumn("_r", F.row_number().over(Window.partitionBy("_i").orderBy("row"))).where("_r <= _keep")
    return d.where("_all is null").select("row.*").unionByName(some.select("row.*"))
