"""Insertion profiles around anchors (anchor_id, chrom, center, is_minus)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import has, ref_end
from .intervals import points_in
from .reads import passing


def layout(flank: int) -> tuple[int, int, int]:
    """Bin size, bins per side and span."""
    size = 10 if flank >= 10 else 1
    return size, flank // size, flank // size * size


def usable_anchors(anchors: DataFrame, sizes: DataFrame, flank: int = 2000) -> DataFrame:
    _, _, span = layout(flank)
    return anchors.join(sizes.select("chrom", "size"), "chrom").where((F.col("center") - span >= 0) & (F.col("center") + span <= F.col("size"))).drop("size")


def anchor_profile(reads: DataFrame, anchors: DataFrame, sizes: DataFrame, flank: int = 2000, min_mapq: int = 20) -> DataFrame:
    """bin, position, insertions, mean, normalized: unshifted 5' ends per anchor, minus anchors mirrored, over the mean of both edges (null where that is 0)."""
    size, half, span = layout(flank)
    ok = usable_anchors(anchors, sizes, flank).select("chrom", "center", "is_minus", (F.col("center") - span).alias("start"), (F.col("center") + span).alias("end"))
    ends = passing(reads, min_mapq).select("chrom", F.when(has(F.col("flag"), 16), ref_end(F.col("pos"), F.col("cigar")) - 1).otherwise(F.col("pos")).alias("pos"))
    # Equal ends count once each, so they are summed before the join.
    ends = ends.groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    hit = points_in(ends, ok)
    idx = F.expr(f"(pos - start) div {size}")
    n = hit.groupBy(F.when(F.col("is_minus"), 2 * half - 1 - idx).otherwise(idx).alias("bin")).agg(F.sum("n").alias("n"))
    bins = reads.sparkSession.range(2 * half).select(F.col("id").alias("bin")).join(n, "bin", "left").crossJoin(F.broadcast(ok.agg(F.count("*").alias("anchors"))))
    p = bins.select("bin", ((F.col("bin") - half) * size + size / 2).alias("position"), F.coalesce("n", F.lit(0)).alias("insertions"), (F.coalesce("n", F.lit(0)).cast("double") / F.nullif("anchors", F.lit(0))).alias("mean"))
    edge = max(1, min(100 // size, half))
    left, right = F.sum(F.when(F.col("bin") < edge, F.col("insertions"))), F.sum(F.when(F.col("bin") >= 2 * half - edge, F.col("insertions")))
    back = p.agg((left + right).alias("b"))
    # mean / background: the anchors' number cancels out, which keeps the ratio exact.
    return p.crossJoin(F.broadcast(back)).select("bin", "position", "insertions", "mean", F.when(F.col("b") > 0, F.col("insertions") * F.lit(2.0 * edge) / F.col("b")).alias("normalized"))


def anchor_score(profile: DataFrame) -> DataFrame:
    return profile.agg(F.max("normalized").alias("score"), F.when(F.max("normalized").isNull(), "zero_background").otherwise("ok").alias("status"), F.sum("insertions").alias("insertions"))
