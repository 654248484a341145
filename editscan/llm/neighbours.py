"""Approximate nearest neighbours: NN-descent graphs and greedy search.

Vectors are dealt by hash to shards of about ``shard_rows``, so whatever a task holds at once has
a fixed size. In each shard, NN-descent starts from random neighbours; each round joins every
node with its neighbours' neighbours (a Spark join of the symmetric edge table with adjacency
lists) and keeps the best ``degree``. Queries enter each shard's graph at several nodes, expand
the best unexpanded nodes of their beam until it stops changing, and the shards' results merge.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, stage


def usable(vec: Column) -> Column:
    """Not null, of some length, all components finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    vals = table.column(column).combine_chunks()
    return np.asarray(vals.flatten(), np.float64).reshape(len(vals), -1) if len(vals) else np.empty((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Products of rows i of a with rows j of b, pair by pair."""
    out = np.empty(len(i), np.float32)
    for s in range(0, len(i), step):
        out[s : s + step] = np.einsum("ij,ij->i", a[i[s : s + step]], b[j[s : s + step]])
    return out


def build_graph(points: DataFrame, degree: int = 24, rounds: int = 6) -> DataFrame:
    """points (shard, node, vec) as adjacency lists (shard, node, near array<long>), best first."""
    ddl = "shard long, node long, near array<long>, sims array<float>, fresh array<boolean>"
    schema = _arrow_schema(points.sparkSession, ddl)

    def improve(cands: pa.Table, vecs: pa.Table) -> pa.Table:
        """Merges each node's candidates, an array per edge, into its list so far, by similarity."""
        node = np.asarray(vecs.column("node"))
        at = np.argsort(node)
        node, unit, n = node[at], _unit(_matrix(vecs, "vec")[at]).astype(np.float32), len(at)

        def marked(column: str) -> np.ndarray:
            """A bit for each pair of nodes that the column lists."""
            hit = np.zeros(n * n, bool)
            for a in range(0, cands.num_rows, 1 << 14):
                part = cands.slice(a, 1 << 14)
                lists = part.column(column).combine_chunks()
                src = np.repeat(np.searchsorted(node, np.asarray(part.column("node"))), lists.value_lengths().to_numpy())
                hit[src * n + np.searchsorted(node, np.asarray(lists.flatten()))] = True
            return hit

        # Only candidate pairs are scored, each once: a node's best come first in its stretch.
        known, code = marked("known"), marked("cand")
        code |= known
        code[:: n + 1] = False
        src, dst = (x.astype(np.int32) for x in np.divmod(np.flatnonzero(code), n))
        sims = _dots(unit, src, unit, dst)
        order = np.lexsort((dst, -sims, src))
        src, dst, sims = src[order], dst[order], sims[order]
        best = np.arange(len(src)) - np.searchsorted(src, np.arange(n))[src] < degree
        src, dst, sims = src[best], dst[best], sims[best]
        fresh = ~known[src.astype(np.int64) * n + dst]
        ends = np.searchsorted(src, np.arange(n + 1))
        shard = vecs.column("home")[0].as_py() if n else 0
        cut = lambda v, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind))
        return pa.Table.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(node, pa.int64()), cut(node[dst], pa.int64()), cut(sims, pa.float32()), cut(fresh, pa.bool_())], schema=schema)

    # Random start: the nodes that follow in a shuffled circle, at several strides.
    none = F.array().cast("array<long>")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("node", F.lit(1)), "node")
    circle = points.select(F.col("shard").alias("shard"), F.col("node").alias("node"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("shard")).alias("n"))
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda k: (F.col("i") + k * k) % F.col("n")))
    cands = circle.select("shard", "node", steps.alias("i")).join(circle.select("shard", "i", F.col("node").alias("to")), ["shard", "i"]).select("shard", "node", F.array("to").alias("cand"), none.alias("known"))
    own, graph = points.select(F.col("shard").alias("home"), F.col("node").alias("node"), "vec"), None
    for _ in range(rounds + 1):
        graph = stage(cands.groupBy("shard").cogroup(own.groupBy("home")).applyInArrow(improve, ddl), "graph")
        edges = graph.select("shard", "node", F.explode(F.arrays_zip("near", "sims", "fresh")).alias("e")).select("shard", "node", F.col("e.near").alias("to"), F.col("e.sims").alias("sim"), F.col("e.fresh").alias("fresh"))
        back = edges.select("shard", F.col("to").alias("node"), F.col("node").alias("to"), "sim", "fresh")
        # A popular node keeps its best reverse edges; a shard bounds how many it can have.
        sym = edges.unionByName(back).groupBy("shard", "node", "to").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh")).withColumn("r", F.row_number().over(Window.partitionBy("shard", "node").orderBy(F.desc("sim"), "to"))).where(F.col("r") <= 2 * degree)
        lists = sym.groupBy("shard", "node").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "to", "fresh"))).alias("l")).select("shard", "node", F.transform("l", lambda x: x["to"]).alias("near"), F.transform("l", lambda x: x["fresh"]).alias("fresh"))
        lists = stage(lists, "adjacency")
        # A neighbour's neighbour is a candidate once: when either edge on the way is new.
        way = F.transform(F.filter(F.arrays_zip("far", "new"), lambda x: F.col("fresh") | x["new"]), lambda x: x["far"])
        nn = sym.join(lists.select("shard", F.col("node").alias("to"), F.col("near").alias("far"), F.col("fresh").alias("new")), ["shard", "to"]).select("shard", "node", F.concat(F.array("to"), way).alias("cand"), none.alias("known"))
        cands = nn.unionByName(graph.select("shard", "node", none.alias("cand"), F.col("near").alias("known")))
    return lists.select("shard", "node", "near")


def greedy_search(unit: np.ndarray, near: list[np.ndarray], queries: np.ndarray, beam: int, entries: int, wide: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` nodes found for each query, and their similarities, best first (-1: none)."""
    n, q = len(unit), len(queries)
    width = max(map(len, near), default=0)
    links = np.full((n, max(width, 1)), -1, np.int64)
    for i, x in enumerate(near):
        links[i, : len(x)] = x
    beam = min(beam, n)
    start = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
    seen, opened = np.zeros((q, n), bool), np.zeros((q, n), bool)
    sims = np.full((q, n), -2.0, np.float32)
    seen[:, start] = True
    sims[:, start] = queries @ unit[start].T
    live = np.arange(q)
    while len(live):
        kth = np.argpartition(-sims[live], beam - 1, axis=1)[:, :beam]
        vals = np.where(np.take_along_axis(opened[live], kth, 1), -2, np.take_along_axis(sims[live], kth, 1))
        pick = np.argsort(-vals, axis=1)[:, :wide]
        ok = np.take_along_axis(vals, pick, 1) > -2
        nodes = np.take_along_axis(kth, pick, 1)
        rows = np.repeat(live, pick.shape[1])[ok.ravel()]
        flat = nodes.ravel()[ok.ravel()]
        opened[rows, flat] = True
        to = links[flat]
        r, t = np.repeat(rows, to.shape[1]), to.ravel()
        new = t >= 0
        r, t = r[new], t[new]
        new = ~seen[r, t]
        code = np.unique(r[new] * n + t[new])
        r, t = code // n, code % n
        seen[r, t] = True
        sims[r, t] = _dots(queries, r, unit, t)
        live = live[ok.any(axis=1)]
    best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
    return np.where(np.take_along_axis(sims, best, 1) > -2, best, -1), np.take_along_axis(sims, best, 1)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vec: str = "embedding", shard_rows: int = 4096, degree: int = 24, rounds: int = 5, beam: int = 128, entries: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where ``is_query``.

    Score: cosine in double precision of the vectors as given. Ties go to the smaller id. A row
    is never its own neighbour; rows with equal ids are one row (the first by vector). Equal
    vectors are indexed once and answer with their smallest ids. Ids or vectors that are null,
    and vectors that are empty, zero or not finite, take no part; vectors of another length than
    the query's are no neighbours. Fewer than k candidates: all of them. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vec))).select(F.col(vec_id).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = stage(rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec"))).where("r = 1").drop("r"), "vectors")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    same = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    count = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()
    shards = F.create_map(*[x for r in count for x in (F.lit(r["dim"]), F.lit(math.ceil(r["n"] / shard_rows)))]) if count else F.create_map(F.lit(0), F.lit(1))
    of = shards[F.size("vec")]
    # The shard number holds the vectors' length above its lower bits, so a shard has one length.
    points = same.select((F.size("vec").cast("long") * (1 << 40) + F.pmod(F.xxhash64(F.element_at("ids", 1)), of)).alias("shard"), F.element_at("ids", 1).alias("node"), "vec", "ids")
    points = stage(points, "points")
    graph = build_graph(points.select("shard", "node", "vec"), degree, rounds)
    asked = rows.where("q").select(F.explode(F.sequence(F.lit(0).cast("long"), of.cast("long") - 1)).alias("s"), "id", "vec").select((F.size("vec").cast("long") * (1 << 40) + F.col("s")).alias("shard"), F.lit(None).cast("long").alias("node"), "vec", F.array("id").alias("ids"), F.lit(None).cast("array<long>").alias("near"))
    ddl = "query_id long, vec_id long, score double"
    schema = _arrow_schema(spark, ddl)

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        index = index.sort_by("node")
        node, raw, ids = np.asarray(index.column("node")), _matrix(index, "vec"), index.column("ids").to_pylist()
        near = [np.searchsorted(node, np.asarray(x or [], np.int64)) for x in index.column("near").to_pylist()]
        unit, out = _unit(raw), []
        raw_q, who = _matrix(queries, "vec"), [x[0] for x in queries.column("ids").to_pylist()]
        for a in range(0, len(who), 512):
            qs = _unit(raw_q[a : a + 512])
            best, _ = greedy_search(unit.astype(np.float32), near, qs.astype(np.float32), beam, entries)
            for r, found in enumerate(best):
                found = found[found >= 0]
                score = (raw[found] * raw_q[a + r]).sum(axis=1) / (np.sqrt((raw[found] ** 2).sum(axis=1)) * np.sqrt((raw_q[a + r] ** 2).sum()))
                exact = np.where(np.isfinite(score), score, (unit[found] * qs[r]).sum(axis=1))
                hits = sorted((-s, i) for s, f in zip(exact.tolist(), found) for i in ids[f] if i != who[a + r])[:k]
                out += [(who[a + r], i, -s) for s, i in hits]
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    index = points.join(graph, ["shard", "node"], "left").select("shard", "node", "vec", "ids", "near")
    found = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(search, ddl)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
