"""Mate pairing, mate base merging and the fragment table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import has, is_edit, matched_blocks, ref_end
from .intervals import overlap_join
from .reads import flag_passing, passing

KEY = ["chrom", "qname", "pair"]


def pair_by_arrival(reads: DataFrame) -> DataFrame:
    """Adds ``pair``: records of a name on a contig pair up two by two in input order; a single one stays alone. Rows of one file_ord are one record."""
    w = Window.partitionBy("chrom", "qname").orderBy("file_ord")
    return reads.withColumn("pair", F.floor((F.dense_rank().over(w) - 1) / 2).cast("bigint"))


def stretches(reads: DataFrame, chunks: DataFrame | None = None, regions: DataFrame | None = None, width: int = 1000) -> DataFrame:
    """Records as rows a stretch [lo, hi) of the reference under them, with ``ref``, its bases.

    A record is cut at regions (disjoint: chrom, start, end; those that touch none go) and at
    chunks (chrom, chunk, start, seq: pieces of ``width`` bases), and looks its reference up once a
    piece, so that no base has to be joined. Without chunks ref is null; where the reference ends,
    it is empty.
    """
    r = reads.withColumn("_end", F.greatest(ref_end(F.col("pos"), F.col("cigar")), F.col("pos")))
    if regions is None:
        r = r.withColumn("lo", F.col("pos")).withColumn("hi", F.col("_end"))
    else:
        where = regions.select("chrom", F.col("start").alias("_ra"), F.col("end").alias("_rz"))
        r = overlap_join(r, where, ("pos", "_end"), ("_ra", "_rz")).withColumn("lo", F.greatest("pos", "_ra")).withColumn("hi", F.least("_end", "_rz")).drop("_ra", "_rz")
    if chunks is None:
        return r.withColumn("ref", F.lit(None).cast("string")).drop("_end")
    r = r.withColumn("chunk", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"greatest(hi - 1, lo) div {width}"))))
    r = r.withColumn("lo", F.greatest("lo", F.col("chunk") * width)).withColumn("hi", F.least("hi", (F.col("chunk") + 1) * width))
    j = r.join(chunks.select("chrom", "chunk", F.col("start").alias("_a"), F.col("seq").alias("_s")), ["chrom", "chunk"], "left")
    ref = F.substr("_s", (F.col("lo") - F.col("_a") + 1).cast("int"), F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).cast("int"))
    return j.withColumn("ref", F.coalesce(ref, F.lit(""))).drop("chunk", "_a", "_s", "_end")


def read_bases(pieces: DataFrame, min_baseq: int = 20, ref_in: tuple[str, ...] | None = None) -> DataFrame:
    """A row per aligned base (key, pos, base, q, ref) of at least min_baseq in stretches; missing qualities are 255, a missing sequence has no bases. ``ref_in`` keeps bases over these only."""
    rows = pieces.where("seq is not null and seq <> '*'").select(*KEY, F.col("pos").alias("start"), "lo", "hi", "seq", "qual", "ref", F.explode(matched_blocks(F.col("cigar"))).alias("b"))
    first, last = F.greatest(F.col("start") + F.col("b.r"), "lo"), F.least(F.col("start") + F.col("b.r") + F.col("b.n"), F.when(F.col("ref").isNull(), F.col("hi")).otherwise(F.least("hi", F.col("lo") + F.length("ref")))) - 1
    rows = rows.where(first <= last).select(*KEY, "lo", "seq", "qual", "ref", (F.col("b.q") - F.col("b.r") - F.col("start")).alias("shift"), F.explode(F.sequence(first, last)).alias("pos"))
    at = (F.col("pos") + F.col("shift")).cast("int")
    rows = rows.select(*KEY, "pos", F.substr("ref", (F.col("pos") - F.col("lo") + 1).cast("int"), F.lit(1)).alias("ref"), F.coalesce(F.get("qual", at), F.lit(255)).alias("q"), F.substr("seq", at + 1, F.lit(1)).alias("base"))
    if ref_in:
        rows = rows.where(F.col("ref").isin(*ref_in))
    return rows.where(F.col("q") >= min_baseq)


def _arbitrated(bases: DataFrame) -> DataFrame:
    # A fragment covers a position once or twice, so the least and greatest (quality, base) tell all. As integers they aggregate by hash, and in the pairs' own partitions.
    code = F.col("q").cast("bigint") * 256 + F.ascii("base")
    return bases.groupBy(*KEY, "pos").agg(F.max(code).alias("hi"), F.min(code).alias("lo"), F.count("*").alias("n"), F.max(F.ascii("ref")).alias("ref"))


def _agreed(arbitrated: DataFrame) -> DataFrame:
    conflict = (F.col("hi") != F.col("lo")) & (F.expr("hi div 256") == F.expr("lo div 256"))
    return arbitrated.where(~conflict).select(*KEY, "pos", F.char(F.col("hi") % 256).alias("base"), F.char(F.col("ref")).alias("ref"))


_LIGHT = ["file_ord", "chrom", "qname", "pos", "cigar", "seq", "qual"]


def merged_bases(reads: DataFrame, min_mapq: int = 20, min_baseq: int = 20, chunks: DataFrame | None = None, regions: DataFrame | None = None, ref_in: tuple[str, ...] | None = None) -> DataFrame:
    """One base a fragment and position (key, pos, base, ref): the better quality wins; equal quality with different bases drops the position. Within regions, where given."""
    r = stretches(passing(reads, min_mapq).select(*_LIGHT), chunks, regions)
    return _agreed(_arbitrated(read_bases(pair_by_arrival(r), min_baseq, ref_in)))


def overlap_diagnostics(reads: DataFrame, min_mapq: int = 20, min_baseq: int = 20) -> DataFrame:
    m = _arbitrated(read_bases(pair_by_arrival(stretches(passing(reads, min_mapq).select(*_LIGHT))), min_baseq)).where("n = 2")
    other = F.col("hi") % 256 != F.col("lo") % 256
    return m.agg(F.count("*").alias("overlap_positions"), F.count_if(other).alias("conflicts"), F.count_if(other & (F.expr("hi div 256") == F.expr("lo div 256"))).alias("equal_quality_conflicts"))


def fragment_counts(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    f = pair_by_arrival(passing(reads, min_mapq)).groupBy(*KEY).agg(F.count("*").alias("n"))
    return f.agg(F.count("*").alias("fragments"), F.count_if(F.col("n") == 2).alias("from_pairs"), F.count_if(F.col("n") == 1).alias("single"))


def fragment_table(reads: DataFrame, chunks: DataFrame, min_mapq: int = 20, min_baseq: int = 20, barcode_tag: str | None = None) -> DataFrame:
    """Fragments by edit signature: chrom, start, end, c2t, g2a (``|`` joined, ``.`` if none), barcode, n.

    Its own pairing: paired records need a proper pair with a mapped mate, orphans drop, and
    min_mapq holds for both mates; unpaired records are fragments. Barcode: the first record's
    tag, else the second's; an empty one counts as missing.
    """
    r = flag_passing(reads).where(~has(F.col("flag"), 1) | (has(F.col("flag"), 2) & ~has(F.col("flag"), 8)))
    r = pair_by_arrival(r).withColumn("is_paired", has(F.col("flag"), 1))
    tag = F.nullif(F.col("tags")[barcode_tag], F.lit("")) if barcode_tag else F.lit(None).cast("string")
    frags = r.groupBy(*KEY).agg(F.count("*").alias("k"), F.max("is_paired").alias("is_paired"), F.min("mapq").alias("mapq"), F.min("pos").alias("start"), F.max(ref_end(F.col("pos"), F.col("cigar"))).alias("end"), F.min_by(tag, F.when(tag.isNotNull(), F.col("file_ord"))).alias("barcode"))
    frags = frags.where((F.col("mapq") >= min_mapq) & ((F.col("k") == 2) | ~F.col("is_paired")))
    m = _agreed(_arbitrated(read_bases(stretches(r, chunks), min_baseq, ("C", "G"))))
    edits = m.where(is_edit(F.col("ref"), F.col("base"))).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.when(F.col("ref") == "C", F.col("pos")))).alias("c2t"), F.sort_array(F.collect_list(F.when(F.col("ref") == "G", F.col("pos")))).alias("g2a"))
    text = lambda c: F.coalesce(F.nullif(F.array_join(c, "|"), F.lit("")), F.lit("."))
    keyed = frags.join(edits, KEY, "left").select("chrom", "start", "end", text("c2t").alias("c2t"), text("g2a").alias("g2a"), F.coalesce("barcode", F.lit(".")).alias("barcode"))
    return keyed.groupBy("chrom", "start", "end", "c2t", "g2a", "barcode").agg(F.count("*").alias("n"))


def fragment_lengths(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Template lengths of proper first mates, by frequency."""
    r = passing(reads, min_mapq).where(has(F.col("flag"), 2) & has(F.col("flag"), 64) & (F.col("tlen") != 0))
    return r.groupBy(F.abs("tlen").alias("length")).agg(F.count("*").alias("n"))


def weighted_summary(freq: DataFrame, value: str, n: str = "n") -> DataFrame:
    """Mean and conventional median of a frequency table, without expanding it."""
    d = freq.select(F.col(value).cast("double").alias("v"), F.col(n).cast("bigint").alias("n"))
    return d.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.expr("percentile(v, 0.5, n)").alias("median"))
