"""Interval algebra. Range joins are equi-joins on bins with the range as a residual, since a bare range predicate is planned as a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins to a mean span, and the least bases of a bin where both sides have spans.
PIECES, LEAST = 8, 32


def merge(regions: DataFrame) -> DataFrame:
    """Overlapping or bookended intervals (chrom, start, end) as one; empty ones count, start > end raises."""
    w = Window.partitionBy("chrom").orderBy("start", "end")
    checked = regions.select("chrom", "start", F.when(F.col("start") > F.col("end"), F.raise_error(F.lit("interval starts after its end"))).otherwise(F.col("end")).alias("end"))
    new = F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return checked.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w)).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def clip(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Regions within contigs of ``sizes`` (chrom, size); unknown contigs and regions wholly past an end drop out."""
    return regions.join(sizes.select("chrom", "size"), "chrom").select("chrom", "start", F.least("end", "size").alias("end")).where("start < end")


def _width(spans: DataFrame, start: str, end: str, least: int) -> DataFrame:
    """One row, _w: an eighth of the mean span, so that all spans together lie in at most ten bins each on the mean, and few rows meet in a bin that do not meet in a base."""
    mean = spans.where(F.col(start) < F.col(end)).agg(F.avg(F.col(end) - F.col(start)).alias("m"))
    return F.broadcast(mean.select(F.greatest(F.lit(least), F.coalesce(F.floor(F.col("m") / PIECES), F.lit(1))).cast("long").alias("_w")))


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], least: int = LEAST) -> DataFrame:
    """Pairs of rows on one chrom whose spans share a base; each pair once. Columns must differ but for chrom; empty spans overlap nothing.

    Either a begins within b (even bins: a's first, all of b's) or b begins within a, after its
    first base (odd bins: a's from its second base, b's first). Bins are ``least`` bases at least,
    of which a's spans should hold few.
    """
    (s, e), (t, f) = a_span, b_span
    p, q = _sides(a, b, a_span, b_span, least)
    within = F.when(F.col("_bin") % 2 == 0, (F.col(t) <= F.col(s)) & (F.col(s) < F.col(f))).otherwise((F.col(s) < F.col(t)) & (F.col(t) < F.col(e)))
    return p.join(q, ["chrom", "_bin"]).where(within).drop("_bin")


def _sides(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], least: int) -> tuple[DataFrame, DataFrame]:
    (s, e), (t, f) = a_span, b_span
    width = _width(b, t, f, least)
    p = a.where(F.col(s) < F.col(e)).crossJoin(width).withColumn("_k", F.explode(F.expr(f"sequence(-1L, (`{e}` - 1) div _w - (`{s}` + 1) div _w)")))
    q = b.where(F.col(t) < F.col(f)).crossJoin(width).withColumn("_k", F.explode(F.expr(f"sequence(-1L, (`{f}` - 1) div _w - `{t}` div _w)")))
    p = p.withColumn("_bin", F.expr(f"if(_k < 0, `{s}` div _w * 2, ((`{s}` + 1) div _w + _k) * 2 + 1)"))
    q = q.withColumn("_bin", F.expr(f"if(_k < 0, `{t}` div _w * 2 + 1, (`{t}` div _w + _k) * 2)"))
    return p.drop("_w", "_k"), q.drop("_w", "_k")


def points_in(points: DataFrame, regions: DataFrame, pos: str = "pos", span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Points joined with the regions that hold them; a point has one bin, so no pair repeats."""
    s, e = span
    p, r = _binned(points, regions, pos, span)
    return p.join(r, ["chrom", "_bin"]).where((F.col(pos) >= F.col(s)) & (F.col(pos) < F.col(e))).drop("_bin")


def _binned(points: DataFrame, regions: DataFrame, pos: str, span: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    s, e = span
    width = _width(regions, s, e, 1)
    r = regions.where(F.col(s) < F.col(e)).crossJoin(width).withColumn("_bin", F.explode(F.expr(f"sequence(`{s}` div _w, (`{e}` - 1) div _w)")))
    return points.crossJoin(width).withColumn("_bin", F.expr(f"`{pos}` div _w")).drop("_w"), r.drop("_w")
