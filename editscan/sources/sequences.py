"""FASTA and FASTQ as tables, and back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import numbered

WIDTH, MORE = 1000, 8


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """ord, chrom (the header's first word), size and seq in upper case; a row a sequence, whose length must be under 2 GB."""
    t = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "^>", "").alias("v"))
    cut = F.instr(F.concat("v", F.lit("\n")), "\n")
    t = t.where(F.trim("v", F.lit(" \r\n")) != "").select("b", "i", F.regexp_extract(F.expr("substring_index(v, '\n', 1)"), r"^(\S*)", 1).alias("chrom"), F.upper(F.translate(F.substr("v", cut + 1), "\r\n \t", "")).alias("seq"))
    return t.select((F.row_number().over(Window.orderBy("b", "i")) - 1).cast("bigint").alias("ord"), "chrom", F.length("seq").cast("bigint").alias("size"), "seq")


def contigs(sequences: DataFrame) -> DataFrame:
    return sequences.select("ord", "chrom", "size")


def chunks(sequences: DataFrame, width: int = WIDTH, more: int = MORE) -> DataFrame:
    """chrom, chunk, start, seq, size: pieces of width bases with more on either side, so that windows near an edge need one row."""
    def run(batches):
        for b in batches:
            for chrom, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for at in range(0, len(seq), width * 4096):
                    k = range(at // width, min(-(-len(seq) // width), at // width + 4096))
                    starts = [max(i * width - more, 0) for i in k]
                    yield pa.RecordBatch.from_pydict({"chrom": [chrom] * len(k), "chunk": list(k), "start": starts, "seq": [seq[a : (i + 1) * width + more] for i, a in zip(k, starts)], "size": [len(seq)] * len(k)})

    return sequences.select("chrom", "seq").mapInArrow(run, "chrom string, chunk long, start long, seq string, size long")


def bases(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """chrom, pos, ref of every base of the pieces, each once."""
    own = F.substr("seq", (F.col("chunk") * width - F.col("start") + 1).cast("int"), F.lit(width))
    return pieces.select("chrom", (F.col("chunk") * width).alias("at"), F.posexplode(F.split(own, "")).alias("i", "ref")).select("chrom", (F.col("at") + F.col("i")).alias("pos"), "ref").where("ref <> ''")


def fastq(spark: SparkSession, path: str, mate: int = 1) -> DataFrame:
    """idx, mate, name (the header's first word), seq, qual of a plain or gzip file, four lines a record; a file that breaks off raises.

    Lines are numbered exactly, from their block's place; the table of blocks has a row a split.
    """
    t = numbered(spark, path)
    n = t.groupBy("block").agg(F.count("*").alias("n"))
    upto = n.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = t.join(upto, "block").select(F.expr("(before + nth) div 4").alias("idx"), ((F.col("before") + F.col("nth")) % 4).alias("k"), F.rtrim("line", F.lit("\r")).alias("line")).where("not (k = 0 and line = '')")
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    r = at.groupBy("idx").agg(of(0).alias("h"), of(1).alias("seq"), of(3).alias("qual"), F.count("*").alias("n"))
    bad = (F.col("n") != 4) | ~F.startswith("h", F.lit("@")) | (F.length("seq") != F.length("qual"))
    name = F.when(bad, F.raise_error(F.concat(F.lit("bad record "), F.col("idx").cast("string")))).otherwise(F.regexp_extract("h", r"^@(\S*)", 1))
    return r.select("idx", F.lit(mate).alias("mate"), name.alias("name"), "seq", "qual")


def write_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """Sequences (ord, chrom, seq) in order, lines of width bases."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.orderBy("ord").select(F.concat(F.lit(">"), "chrom", F.lit("\n"), body).alias("value")).write.mode("errorifexists").text(path)


def write_fastq(records: DataFrame, path: str) -> None:
    r = records.orderBy("idx").select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.coalesce("qual", F.expr("repeat('I', length(seq))"))).alias("value"))
    r.write.mode("errorifexists").text(path)


def of_regions(pieces: DataFrame, regions: DataFrame, width: int = WIDTH) -> DataFrame:
    """chrom, start, end, seq of regions within their contigs, put together from the pieces they touch; empty regions drop out."""
    r = regions.where("start < end").select("chrom", "start", "end", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("chunk"))
    own = pieces.select("chrom", "chunk", F.substr("seq", (F.col("chunk") * width - F.col("start") + 1).cast("int"), F.lit(width)).alias("own"))
    a = F.greatest(F.col("start") - F.col("chunk") * width, F.lit(0))
    z = F.least(F.col("end") - F.col("chunk") * width, F.lit(width))
    parts = r.join(own, ["chrom", "chunk"]).select("chrom", "start", "end", "chunk", F.substr("own", (a + 1).cast("int"), (z - a).cast("int")).alias("s"))
    g = parts.groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_set(F.struct("chunk", "s"))).alias("p"))
    return g.select("chrom", "start", "end", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))
