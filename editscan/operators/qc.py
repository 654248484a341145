"""Quality-control distributions, as frequency tables first and ratios last, so that results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import BASES, is_edit, ratio, reverse_complement
from .fragments import KEY, merged_bases


def fragment_stats(reads: DataFrame, chunks: DataFrame, min_mapq: int = 20, min_baseq: int = 20) -> DataFrame:
    """Per fragment: ct, ga, edits, editable (C or G), aligned bases and mismatches that are no edits; only A, C, G and T count, on both sides."""
    b = merged_bases(reads, min_mapq, min_baseq, chunks, ref_in=BASES).where(F.col("base").isin(*BASES))
    edit = is_edit(F.col("ref"), F.col("base"))
    return b.groupBy(*KEY).agg(F.count_if(edit & (F.col("ref") == "C")).alias("ct"), F.count_if(edit & (F.col("ref") == "G")).alias("ga"), F.count_if(F.col("ref").isin("C", "G")).alias("editable"), F.count_if((F.col("ref") != F.col("base")) & ~edit).alias("other"), F.count("*").alias("aligned")).withColumn("edits", F.col("ct") + F.col("ga"))


def global_rate(stats: DataFrame) -> DataFrame:
    s = stats.agg(F.sum("edits").alias("edited"), F.sum("editable").alias("editable"), F.sum("other").alias("other_mismatches"))
    return s.withColumn("rate", ratio(F.col("edited"), F.col("editable")))


def spine(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("bin"))


def edits_histogram(stats: DataFrame, top: int = 100) -> DataFrame:
    """Fragments by edits, 0 to top, the last bin for all above."""
    n = stats.groupBy(F.least("edits", F.lit(top)).alias("bin")).agg(F.count("*").alias("n"))
    return spine(stats.sparkSession, top + 1).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rate_bins(stats: DataFrame, bins: int = 200) -> DataFrame:
    # floor(edits * bins / editable) in integers
    return stats.where("editable > 0").groupBy(F.least(F.expr(f"edits * {bins} div editable"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def rate_histogram(stats: DataFrame, bins: int = 200) -> DataFrame:
    return spine(stats.sparkSession, bins).join(rate_bins(stats, bins), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rate_summary(stats: DataFrame, bins: int = 200) -> DataFrame:
    """Exact mean, and median of the bins' middles."""
    mean = stats.where("editable > 0").groupBy("edits", "editable").agg(F.count("*").alias("n")).agg((F.sum(F.col("edits").cast("double") / F.col("editable") * F.col("n")) / F.sum("n")).alias("mean"))
    median = rate_bins(stats, bins).agg(((F.expr("percentile(bin, 0.5, n)") + 0.5) / bins).alias("median"))
    return mean.crossJoin(median)


def directions(stats: DataFrame) -> DataFrame:
    return stats.groupBy("ct", "ga").agg(F.count("*").alias("n"))


def zero_edit_strata(stats: DataFrame) -> DataFrame:
    """Fragments and those without an edit, by number of editable bases."""
    labels = ["0", "1-10", "11-25", "26-50", "51-100", "101+"]
    e = F.col("editable")
    which = F.when(e == 0, 0).when(e <= 10, 1).when(e <= 25, 2).when(e <= 50, 3).when(e <= 100, 4).otherwise(5)
    n = stats.groupBy(which.cast("bigint").alias("bin")).agg(F.count("*").alias("fragments"), F.count_if(F.col("edits") == 0).alias("zero"))
    return spine(stats.sparkSession, 6).join(n, "bin", "left").select(F.get(F.array(*map(F.lit, labels)), F.col("bin").cast("int")).alias("stratum"), F.coalesce("fragments", F.lit(0)).alias("fragments"), F.coalesce("zero", F.lit(0)).alias("zero_edit"))


def site_counts(reads: DataFrame, chunks: DataFrame, min_mapq: int = 20, min_baseq: int = 20) -> DataFrame:
    """chrom, pos, edits and opportunities of C and G; contexts and motifs need no more than this per-base table."""
    b = merged_bases(reads, min_mapq, min_baseq, chunks, ref_in=("C", "G")).where(F.col("base").isin(*BASES))
    return b.groupBy("chrom", "pos", "ref").agg(F.count_if(is_edit(F.col("ref"), F.col("base"))).alias("edits"), F.count("*").alias("opportunities"))


def context_bias(sites: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edits and opportunities by trinucleotide around the C of either strand; the window must lie inside and be of A, C, G and T."""
    w = with_window(sites, chunks, 1).where("length(win) = 3 and win rlike '^[ACGT]{3}$'")
    c = w.groupBy(F.when(F.col("ref") == "G", reverse_complement(F.col("win"))).otherwise(F.col("win")).alias("context")).agg(F.sum("edits").alias("edits"), F.sum("opportunities").alias("opportunities"))
    return c.withColumn("fraction", ratio(F.col("edits"), F.col("opportunities")))


def with_window(sites: DataFrame, chunks: DataFrame, half: int, width: int = 1000) -> DataFrame:
    """Adds win, the reference from pos - half to pos + half; null where that leaves the contig. chunks: (chrom, chunk, start, seq, size), pieces of ``width`` bases with at least ``half`` more on both sides."""
    s = sites.withColumn("chunk", F.expr(f"pos div {width}")).join(chunks, ["chrom", "chunk"])
    inside = (F.col("pos") >= half) & (F.col("pos") + half < F.col("size"))
    return s.withColumn("win", F.when(inside, F.substr("seq", (F.col("pos") - half - F.col("start") + 1).cast("int"), F.lit(2 * half + 1)))).drop("seq", "start", "chunk", "size")


def motif_counts(sites: DataFrame, chunks: DataFrame, half: int = 5) -> DataFrame:
    """offset, base, events and background around edited sites and around all opportunities, on the C strand; windows with another base count for neither."""
    w = with_window(sites, chunks, half).where(F.col("win").rlike(f"^[ACGT]{{{2 * half + 1}}}$"))
    w = w.select(F.when(F.col("ref") == "G", reverse_complement(F.col("win"))).otherwise(F.col("win")).alias("win"), "edits", "opportunities")
    long = w.groupBy("win").agg(F.sum("edits").alias("e"), F.sum("opportunities").alias("o")).select("e", "o", F.posexplode(F.filter(F.split("win", ""), lambda b: b != "")).alias("i", "base"))
    counts = long.groupBy((F.col("i") - half).cast("bigint").alias("offset"), "base").agg(F.sum("e").alias("events"), F.sum("o").alias("background"))
    full = sites.sparkSession.range(2 * half + 1).select((F.col("id") - half).alias("offset"), F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    return full.join(counts, ["offset", "base"], "left").select("offset", "base", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("background", F.lit(0)).alias("background"))


def motif_enrichment(counts: DataFrame) -> DataFrame:
    """Event and background frequencies and their fold, null where undefined."""
    t = counts.groupBy("offset").agg(F.sum("events").alias("te"), F.sum("background").alias("tb"))
    f = counts.join(t, "offset").select("offset", "base", ratio(F.col("events"), F.col("te")).alias("event_freq"), ratio(F.col("background"), F.col("tb")).alias("background_freq"))
    return f.withColumn("fold", F.col("event_freq") / F.nullif("background_freq", F.lit(0.0)))


def motif_bits(counts: DataFrame) -> DataFrame:
    """Letter heights p * (2 + sum p log2 p)."""
    t = counts.groupBy("offset").agg(F.sum("events").alias("te"))
    p = counts.join(t, "offset").select("offset", "base", F.coalesce(ratio(F.col("events"), F.col("te")), F.lit(0.0)).alias("p"))
    info = p.groupBy("offset").agg((F.lit(2.0) + F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("info"))
    return p.join(info, "offset").select("offset", "base", (F.col("p") * F.col("info")).alias("bits"))


def context_top(context: DataFrame) -> DataFrame:
    """The context of the highest fraction (first by name on ties), the pooled baseline and the fold over it."""
    base = context.agg(ratio(F.sum("edits"), F.sum("opportunities")).alias("baseline"))
    top = context.where("opportunities > 0").orderBy(F.desc("fraction"), "context").limit(1)
    return top.crossJoin(base).select("context", "fraction", "baseline", (F.col("fraction") / F.nullif("baseline", F.lit(0.0))).alias("fold"))
