"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that hold them). The
driver, which sees one row per pattern only, routes token capacity from patterns to source
quotas; a pattern's first use is free and each repetition costs more than the one before. The
flow says how many words each pattern gives; documents are then selected in a seeded order.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WEIGHTS = (5, 2, 1)
_BUCKETS = 4096


def fair_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Adds target to (source, source_size): weights repeat over the sources by code point, null last, and share all sizes; targets stop at ``cap`` times a source's size, the excess reshared by weight.

    Sources are capped in order of cap/weight, so the level solves in closed form: the first k
    such that the next source stays under what is left per weight. A null source is a source; a
    null size counts as 0, and a source of size 0 has target 0; sources are to be distinct; an
    empty table gives no rows.
    """
    one = Window.partitionBy(F.lit(1))
    by_name, by_ratio = one.orderBy(F.col("source").asc_nulls_last()), one.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(x) for x in weights])
    sizes = sizes.withColumn("source_size", F.coalesce("source_size", F.lit(0)))
    t = sizes.withColumn("w", F.get(w, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    t = t.withColumn("top", F.col("source_size") * cap).withColumn("ratio", F.col("top") / F.col("w"))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("rest", F.sum("source_size").over(one) - F.coalesce(F.sum("top").over(upto), F.lit(0)))
    t = t.withColumn("rest_w", F.sum("w").over(one) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    # At the first source (by ratio) that is not capped, rest / rest_w is the level for it and all after it.
    t = t.withColumn("free", F.col("top") * F.col("rest_w") > F.col("rest") * F.col("w")).withColumn("at", F.row_number().over(by_ratio))
    level = t.withColumn("first", F.min(F.when(F.col("free"), F.col("at"))).over(one))
    level = level.withColumn("r", F.max(F.when(F.col("at") == F.col("first"), F.col("rest"))).over(one)).withColumn("rw", F.max(F.when(F.col("at") == F.col("first"), F.col("rest_w"))).over(one))
    capped = F.col("first").isNull() | (F.col("at") < F.col("first"))
    return level.select("source", "source_size", F.when(capped, F.col("top").cast("double")).otherwise((F.col("w") * F.col("r")).cast("double") / F.col("rw")).alias("target"))


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, costs: tuple[int, ...] = (0, 1, 3)) -> list[dict]:
    """Words each pattern gives to each of its sources.

    patterns: (sources, words); each may give its words once at each cost (convex: ascending).
    Successive shortest augmenting paths, so the total is maximal and the repetition cost minimal.
    Sources without a quota are to be left out of patterns; a pattern without sources or words, or
    a quota of 0, gives nothing; no patterns give no rows. Ties go by the order given.
    """
    names = list(quotas)
    end, start = len(patterns) + len(names) + 1, len(patterns) + len(names)
    node = {s: len(patterns) + k for k, s in enumerate(names)}
    head, to, room, price = [[] for _ in range(end + 1)], [], [], []

    def edge(a, b, capacity, cost):
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            head[x].append(len(to))
            to.append(y)
            room.append(c)
            price.append(p)

    used = []
    for k, (sources, words) in enumerate(patterns):
        for c in costs:
            edge(start, k, words, c)
        mine = {}
        for s in sources:
            mine[s] = len(to)
            edge(k, node[s], words * len(costs), 0)
        used.append(mine)
    for s, q in quotas.items():
        edge(node[s], end, q, 0)
    while True:
        far, via, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in head[a]:
                if room[e] and (to[e] not in far or far[a] + price[e] < far[to[e]]):
                    far[to[e]], via[to[e]] = far[a] + price[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if end not in far:
            return [{s: room[e ^ 1] for s, e in mine.items() if room[e ^ 1]} for mine in used]
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def mix_sources(docs: DataFrame, quotas: dict, seed: str = "mix", max_repeats: int = 3, max_patterns: int = 100_000) -> DataFrame:
    """docs (doc_id, size, sources array<string>, ...) with ``repeats``: how often the mix uses each.

    A pattern gives q whole rounds of all its documents and the rest to documents in the order
    of md5(seed:doc_id), up to the document that comes nearest; so a pattern misses its words
    by half a document at most, no document is used over ``max_repeats`` times, and reruns
    agree. Null or empty sources: never used. Null or negative size counts as 0. A null id is
    an id of its own; repeated rows are documents of their own. Other columns are kept.
    Memory on the driver grows with the distinct patterns, of which more than ``max_patterns``
    raise an error, and not with documents.
    """
    spark = docs.sparkSession
    key = F.sort_array(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # The given columns travel as one, so that none can clash with those made here.
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "sources", "size", "doc_id").withColumns({"_key": key, "_size": F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long"), "_order": order, "_bucket": F.conv(F.substring(order, 1, 3), 16, 10).cast("int")})
    sums = d.groupBy("_key", "_bucket").agg(F.sum("_size").alias("n"))
    sums = stage(sums, "sums")
    total = sums.groupBy("_key").agg(F.sum("n").alias("n")).limit(max_patterns + 1).collect()
    if len(total) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns")
    patterns = sorted(((tuple(r["_key"]), r["n"]) for r in total), key=lambda p: tuple((s is None, s or "") for s in p[0]))
    flow = min_cost_flow([(tuple(s for s in p if s in quotas), n) for p, n in patterns], {s: int(q) for s, q in quotas.items()}, tuple(k * (k + 1) // 2 for k in range(max_repeats)))
    given = [(list(p), *divmod(sum(f.values()), n)) if n else (list(p), 0, 0) for (p, n), f in zip(patterns, flow)]
    given = spark.createDataFrame(given, "_key array<string>, rounds long, rest long")
    same = F.col("_key") == F.col("_k")
    # The bucket in which a pattern's rest runs out; only its documents need a running sum.
    before = F.sum("n").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    cross = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(given.withColumnRenamed("_key", "_k"), same).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    cross = stage(cross.select("_k", "rounds", "rest", F.col("_bucket").alias("cross"), "before"), "rests")
    d = d.join(cross, same, "left")
    out = [*[F.col("row")[c].alias(c) for c in docs.columns if c != "repeats"], F.coalesce("repeats", F.lit(0)).cast("int").alias("repeats")]
    clear = d.where("_bucket <> cross or cross is null").withColumn("repeats", F.col("rounds") + F.when(F.col("_bucket") < F.col("cross"), 1).otherwise(0))
    running = F.sum("_size").over(Window.partitionBy("_key").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, 0))
    edge = d.where("_bucket = cross").withColumn("repeats", F.col("rounds") + F.when(2 * (F.col("before") + running) - F.col("_size") <= 2 * F.col("rest"), 1).otherwise(0))
    return clear.select(*out).unionByName(edge.select(*out))
