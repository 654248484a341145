"""Sparse per-base tracks (chrom, pos, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import BASES, is_edit, ref_end
from .fragments import merged_bases
from .intervals import overlap_join, points_in
from .reads import cut_site, passing


def base_counts(reads: DataFrame, chunks: DataFrame, min_mapq: int = 20, min_baseq: int = 20, regions: DataFrame | None = None, ref_in: tuple[str, ...] | None = None) -> DataFrame:
    """chrom, pos, edits, coverage (fragments with an A, C, G or T) in one pass. chunks: pieces of the reference; regions, disjoint, and ``ref_in`` bound what is unfolded."""
    b = merged_bases(reads, min_mapq, min_baseq, chunks, regions, ref_in).where("ref <> ''")
    return b.groupBy("chrom", "pos").agg(F.count_if(is_edit(F.col("ref"), F.col("base"))).alias("edits"), F.count_if(F.col("base").isin(*BASES)).alias("coverage"))


def edit_counts(reads, chunks, min_mapq: int = 20, min_baseq: int = 20, regions: DataFrame | None = None) -> DataFrame:
    return base_counts(reads, chunks, min_mapq, min_baseq, regions, ("C", "G")).where("edits > 0").select("chrom", "pos", F.col("edits").alias("value"))


def edit_ratio(reads, chunks, min_mapq: int = 20, min_baseq: int = 20, min_coverage: int = 1, regions: DataFrame | None = None) -> DataFrame:
    """Edits over coverage where coverage reaches the minimum; zeros are left out."""
    c = base_counts(reads, chunks, min_mapq, min_baseq, regions, ("C", "G")).where((F.col("coverage") >= min_coverage) & (F.col("coverage") > 0) & (F.col("edits") > 0))
    return c.select("chrom", "pos", (F.col("edits").cast("double") / F.col("coverage")).alias("value"))


def cuts(reads: DataFrame, min_mapq: int = 20, plus_shift: int = 4, minus_shift: int = -5) -> DataFrame:
    return passing(reads, min_mapq).select("chrom", cut_site(plus_shift, minus_shift).alias("pos"), F.col("pos").alias("r_start"), ref_end(F.col("pos"), F.col("cigar")).alias("r_end"))


def cut_counts(reads: DataFrame, sizes: DataFrame, min_mapq: int = 20, plus_shift: int = 4, minus_shift: int = -5) -> DataFrame:
    c = cuts(reads, min_mapq, plus_shift, minus_shift).join(sizes.select("chrom", "size"), "chrom").where("pos >= 0 and pos < size")
    return c.groupBy("chrom", "pos").agg(F.count("*").alias("value"))


def cut_counts_in(reads: DataFrame, regions: DataFrame, min_mapq: int = 20, plus_shift: int = 4, minus_shift: int = -5) -> DataFrame:
    """Cuts in regions; a record counts in a region that it overlaps and its cut is in."""
    r = overlap_join(cuts(reads, min_mapq, plus_shift, minus_shift), regions, ("r_start", "r_end"), ("start", "end"))
    return r.where("pos >= start and pos < end").groupBy("chrom", "pos").agg(F.count("*").alias("value"))


def in_regions(track: DataFrame, regions: DataFrame) -> DataFrame:
    return points_in(track, regions).select("chrom", "pos", "value", "start", "end")


def extend(track: DataFrame, size: int, width: int = 1 << 16) -> DataFrame:
    """Each event adds its value to [pos - size, pos + size], clipped to its region (start, end).

    A difference array and a running sum, so the cost does not grow with size but for the
    output; an event goes to every bin of ``width`` that it reaches, and bins are independent.
    """
    reach = track.select("chrom", "start", "end", "value", F.greatest(F.col("pos") - size, "start").alias("lo"), F.least(F.col("pos") + size + 1, "end").alias("hi"))
    cut = reach.withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    cut = cut.withColumn("lo", F.greatest("lo", F.col("bin") * width)).withColumn("hi", F.least("hi", (F.col("bin") + 1) * width))
    key = ["chrom", "start", "end", "bin"]
    ends = cut.select(*key, F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.col("value").alias("d")), F.struct(F.col("hi").alias("pos"), (-F.col("value")).alias("d")))).alias("e")).select(*key, "e.pos", "e.d")
    w = Window.partitionBy(*key).orderBy("pos")
    runs = ends.groupBy(*key, "pos").agg(F.sum("d").alias("d")).withColumn("value", F.sum("d").over(w)).withColumn("stop", F.lead("pos").over(w))
    return runs.where("value <> 0 and stop > pos").select("chrom", F.explode(F.sequence("pos", F.col("stop") - 1)).alias("pos"), "value")


def normalize(track: DataFrame, scale: float = 1e6) -> DataFrame:
    """value * scale / total; nothing where the total is 0. The total is one row."""
    total = track.agg(F.sum("value").alias("total"))
    return track.crossJoin(F.broadcast(total)).where("total <> 0").select("chrom", "pos", (F.col("value") * F.lit(float(scale)) / F.col("total")).alias("value"))
