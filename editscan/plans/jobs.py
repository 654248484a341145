"""Whole jobs from files to files, one a command."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, footprint, fragments, intervals, motif, reads as rd, tracks, windows
from ..sources import alignments, bigwig, sequences, text
from . import report
from .staging import stage


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records, and contigs in the header's order, of a BAM or SAM file."""
    if path.endswith(".sam"):
        return alignments.sam(spark, path), alignments.sam_contigs(spark, path)
    return alignments.bam(spark, path), alignments.bam_contigs(spark, path)


def genome_track(spark: SparkSession, bam: str, out: str, fasta: str | None = None, event: str = "edit", mode: str = "count", regions: str | None = None, sizes: str | None = None, plus_shift: int = 4, minus_shift: int = -5, extend: int = 0, min_coverage: int = 1, normalize: bool = False, scale: float = 1e6, min_mapq: int = 20, min_baseq: int = 20) -> None:
    """A bigWig of edits, edit ratios or cuts. A ratio is neither extended nor normalized."""
    if event not in ("edit", "tn5") or mode not in ("count", "ratio"):
        raise ValueError("event is edit or tn5, mode is count or ratio")
    if event == "tn5" and mode == "ratio":
        raise ValueError("cuts have no ratio")
    if event == "edit" and fasta is None:
        raise ValueError("edits need a reference")
    if extend < 0 or min_coverage < 1:
        raise ValueError("extend is at least 0 and min_coverage at least 1")
    records, contigs = _records(spark, bam)
    contigs = text.chrom_sizes(spark, sizes) if sizes else contigs
    whole = contigs.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    where = intervals.clip(text.bed(spark, regions), contigs) if regions else whole
    if event == "tn5":
        track = tracks.cut_counts_in(records, where, min_mapq, plus_shift, minus_shift) if regions else tracks.cut_counts(records, contigs, min_mapq, plus_shift, minus_shift)
    else:
        ref, inside = sequences.chunks(sequences.fasta(spark, fasta)), where if regions else None
        track = tracks.edit_ratio(records, ref, min_mapq, min_baseq, min_coverage, inside) if mode == "ratio" else tracks.edit_counts(records, ref, min_mapq, min_baseq, inside)
    if mode == "count" and extend:
        inside = tracks.in_regions(track, where) if regions else track.join(where, "chrom")
        track = tracks.extend(inside, extend)
    if mode == "count" and normalize:
        track = tracks.normalize(stage(track, "track"), scale)
    bigwig.write(track, contigs, out)


def converted_index(spark: SparkSession, fasta: str, out: str) -> None:
    """FASTA of the reference's two conversions, contigs f and r, for the aligner to index."""
    whole = sequences.fasta(spark, fasta)
    both = candidates.converted_reference(whole).join(whole.select(F.col("chrom").alias("_c"), F.col("ord").alias("_o")), F.substring("chrom", 2, 1 << 30) == F.col("_c"))
    sequences.write_fasta(both.select((F.col("_o") * 2 + F.startswith("chrom", F.lit("r")).cast("int")).alias("ord"), "chrom", "seq"), out)


def converted_reads(spark: SparkSession, reads: str, out: str, mates: str | None = None) -> None:
    """Both conversions of the reads as FASTQ for the aligner (interleaved where there are mates), the original sequence and the candidate in the header's comment as tags. Mates of differing names raise."""
    r = sequences.fastq(spark, reads)
    if mates:
        second = sequences.fastq(spark, mates, 2)
        checked = candidates.zip_mates(r, second).select("idx", F.col("name").alias("_n"))
        r = r.unionByName(second).join(checked, "idx").withColumn("name", F.col("_n")).drop("_n")
    c = candidates.dual_conversion(r).withColumn("candidate", F.col("candidate") if mates else F.when(F.col("candidate") == "f", "ct").otherwise("ga"))
    header = F.concat(F.lit("@"), "name", F.lit("\tYS:Z:"), "original", F.lit("\tYC:Z:"), "candidate")
    text.write_lines(c.orderBy("idx", "candidate", "mate").select(F.concat(header, F.lit("\n"), "converted", F.lit("\n+\n"), "qual").alias("value")), out)


def chosen_alignments(spark: SparkSession, sam: str, fasta: str, out: str) -> None:
    """Sorted BAM of the better candidate of every read in the aligner's output, capped and restored to the original reference."""
    records, fa = _records(spark, sam)[0], sequences.fasta(spark, fasta)
    chosen = candidates.chosen_records(records, sequences.chunks(fa))
    alignments.write_bam(stage(chosen, "chosen"), sequences.contigs(fa), out)


def fragment_file(spark: SparkSession, bam: str, fasta: str, out: str, barcode_tag: str | None = None, compress: bool = False, min_mapq: int = 20, min_baseq: int = 20) -> None:
    records, contigs = _records(spark, bam)
    ref = sequences.chunks(sequences.fasta(spark, fasta))
    text.write_fragments(fragments.fragment_table(records, ref, min_mapq, min_baseq, barcode_tag), contigs, out, bool(barcode_tag), compress)


def quality(spark: SparkSession, bam: str, fasta: str, out: str, sample: str, tss: str | None = None, n_reads: int | None = None, flank: int = 2000, min_mapq: int = 20, min_baseq: int = 20, page: bool = True, redact: bool = False, portable: bool = False) -> dict:
    """Writes the report of a sample and returns its metrics. Contigs must be in the reference at the same length."""
    if flank < 1 or n_reads is not None and n_reads < 1:
        raise ValueError("flank and n_reads are at least 1")
    records, contigs = _records(spark, bam)
    fa = sequences.fasta(spark, fasta)
    rd.require_contigs(contigs, sequences.contigs(fa))
    pieces = stage(sequences.chunks(fa), "reference")
    made = report.quality_report(records, pieces, contigs, sample, text.tss(spark, tss) if tss else None, n_reads, min_mapq, min_baseq, flank, {"bam": bam, "fasta": fasta, "tss": tss})
    report.write_report(made, out, page, redact, portable)
    return made.metrics


def motif_hits(spark: SparkSession, fasta: str, regions: str, motifs: list[str], out: str, p_value: float = 1e-4) -> None:
    """BED of the motifs' hits in merged regions, on both strands."""
    if not motifs or not 0 < p_value < 1:
        raise ValueError("motif files and a p-value between 0 and 1 are needed")
    table = motif.pwm_table(spark, text.motif_files(spark, motifs), p_value)
    fa = sequences.fasta(spark, fasta)
    where = intervals.clip(text.bed(spark, regions), sequences.contigs(fa))
    hits = motif.scan(sequences.of_regions(sequences.chunks(fa), where), table)
    text.write_motif_hits(hits.withColumn("score", F.col("score") / 1000), out)


def footprints(spark: SparkSession, track: str, sites: str, out: str, n_shuffles: int = 1000, seed: int = 0) -> int:
    """BED of the sites' scores and p-values; returns how many sites were left out, as their windows leave the contig."""
    if n_shuffles < 1:
        raise ValueError("n_shuffles is at least 1")
    contigs, rows = bigwig.contigs(spark, track), text.bed_sites(spark, sites)
    w = stage(footprint.windows(rows, bigwig.read(spark, track), contigs), "windows")
    scored = stage(footprint.exact_p_values(w, n_shuffles, seed), "footprints")
    text.write_footprints(rows, scored, contigs, out)
    return rows.count() - scored.count()


def training_file(spark: SparkSession, fasta: str, track: str, regions: str, out: str, length: int = 128, step: int | None = None, valid_fraction: float = 0.1, seed: int = 42) -> None:
    """The training set as Parquet, a folder for each part (is_valid)."""
    training_set(spark, fasta, track, regions, length, step, valid_fraction, seed).write.partitionBy("is_valid").parquet(out)


def training_set(spark: SparkSession, fasta: str, track: str, regions: str, length: int = 128, step: int | None = None, valid_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """chrom, start, end, x, y, is_valid: one-hot windows with the track over them."""
    if length < 1 or step is not None and step < 1 or not 0 <= valid_fraction < 1:
        raise ValueError("length and step are at least 1, valid_fraction is under 1")
    fa = sequences.fasta(spark, fasta)
    tiled = windows.tiles(intervals.clip(text.bed(spark, regions), sequences.contigs(fa)), length, step)
    made = windows.dataset(tiled, bigwig.read(spark, track), sequences.of_regions(sequences.chunks(fa), tiled))
    return windows.split(made, valid_fraction, seed)
