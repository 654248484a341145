"""Line formats: intervals, sites, anchors, contig sizes, motifs and report tables.

Malformed rows raise when the column that holds the bad value is computed, so a query that never
reads the column does not see the error.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals

_ORDERED = "block long, nth long, line string"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with the start of their block and their place in it: (block, nth) is the file's order.

    Spark packs a file's splits into tasks by size, so ids of tasks do not follow the file.
    """
    t = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches):
        last, n = None, 0
        for b in batches:
            blocks, nth = b.column(0).to_pylist(), []
            for k in blocks:
                last, n = (k, n + 1) if k == last else (k, 0)
                nth.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nth, pa.int64()), b.column(1)], names=["block", "nth", "line"])

    return t.mapInArrow(run, _ORDERED)


def line_order() -> Column:
    """A block has no more lines than bytes, so its start plus the place orders a file's lines uniquely."""
    return F.col("block") + F.col("nth")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """ord and the tab-separated fields of a BED file's records: blank lines and those that begin with #, track or browser are none."""
    t = numbered(spark, path).where((F.trim("line", F.lit(" \t\r")) != "") & ~F.col("line").rlike("^(#|track|browser)"))
    return t.select(line_order().alias("ord"), F.split(F.rtrim("line", F.lit("\r\n")), "\t").alias("f"))


def _int(i: int) -> Column:
    return F.get("f", F.lit(i)).try_cast("bigint")


def _checked(bad: Column, what: str, value: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join("f", "\t"))).cast("bigint")).otherwise(value)


def bed(spark: SparkSession, path: str, merged: bool = True) -> DataFrame:
    """chrom, start, end; merged where intervals overlap or touch. Values that are no integers raise, and so does start > end."""
    a, z = _int(1), _int(2)
    out = rows(spark, path).select(F.col("f")[0].alias("chrom"), _checked(a.isNull() | z.isNull() | (a > z), "bad interval", a).alias("start"), z.alias("end"))
    return intervals.merge(out) if merged else out


def bed_sites(spark: SparkSession, path: str) -> DataFrame:
    """site_id (in the file's order), chrom, start, end and name (``.`` where there is none), as they stand."""
    a, z = _int(1), _int(2)
    return rows(spark, path).select(F.col("ord").alias("site_id"), F.col("f")[0].alias("chrom"), _checked(a.isNull() | z.isNull(), "bad site", a).alias("start"), z.alias("end"), F.coalesce(F.get("f", F.lit(3)), F.lit(".")).alias("name"))


def tss(spark: SparkSession, path: str) -> DataFrame:
    """anchor_id, chrom, center (the interval's midpoint) and is_minus. The strand is in column 6, or in column 4 of a file with four."""
    a, z = _int(1), _int(2)
    strand = F.when(F.size("f") == 4, F.get("f", F.lit(3))).otherwise(F.get("f", F.lit(5)))
    center = _checked(a.isNull() | z.isNull() | (a < 0) | (z < a), "bad anchor", F.floor((a + z) / 2).cast("bigint"))
    return rows(spark, path).select(F.col("ord").alias("anchor_id"), F.col("f")[0].alias("chrom"), center.alias("center"), F.coalesce(F.trim(strand, F.lit(" \r")) == "-", F.lit(False)).alias("is_minus"))


def tss_diagnostics(anchors: DataFrame, sizes: DataFrame, span: int) -> DataFrame:
    """One row: input_records, unknown_contig, outside_contig and used_records, for windows of span on either side."""
    j = anchors.join(sizes.select("chrom", "size"), "chrom", "left")
    fits = (F.col("center") - span >= 0) & (F.col("center") + span <= F.col("size"))
    return j.agg(F.count("*").alias("input_records"), F.count_if(F.col("size").isNull()).alias("unknown_contig"), F.count_if(F.col("size").isNotNull() & ~fits).alias("outside_contig"), F.count_if(F.coalesce(fits, F.lit(False))).alias("used_records"))


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """ord (from 0, the file's order), chrom, size of a sizes file or of a sequence index's first two columns; one row a contig."""
    t = rows(spark, path).where(F.size("f") >= 2)
    size = _checked(_int(1).isNull(), "bad size", _int(1))
    return t.select((F.row_number().over(Window.orderBy("ord")) - 1).cast("bigint").alias("ord"), F.col("f")[0].alias("chrom"), size.alias("size"))


def motif_files(spark: SparkSession, paths: list[str]) -> dict[str, list[list[float]]]:
    """Count matrices by file stem, as rows of A, C, G, T per position. A file has four rows of numbers, one a base; a header line that begins with > and row labels are skipped. A missing file raises."""
    out = {}
    for r in spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("p")).collect():
        table = [[float(x) for x in line.replace("[", " ").replace("]", " ").split() if x not in set("ACGT")] for line in r["value"].splitlines() if line.strip() and line[0] not in ">#"]
        if len(table) != 4 or len({len(x) for x in table}) != 1 or not table[0]:
            raise ValueError(f"no matrix of four rows: {r['p']}")
        out[r["p"].rsplit("/", 1)[-1].rsplit(".", 1)[0]] = [list(x) for x in zip(*table)]
    return out


# --- sinks


def write_lines(df: DataFrame, path: str, compress: bool = False) -> None:
    """A one-column table as text, in its order."""
    df.write.mode("errorifexists").option("compression", "gzip" if compress else "none").text(path)


def _in_order(df: DataFrame, sizes: DataFrame, *by: str) -> DataFrame:
    return df.join(sizes.select("chrom", F.col("ord").alias("_ord")), "chrom").orderBy("_ord", *by)


def _tabs(*cols) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).alias("value")


def write_fragments(table: DataFrame, sizes: DataFrame, path: str, barcode: bool = False, compress: bool = False) -> None:
    """chrom, start, end, c2t, g2a[, barcode], n in the contigs' order, then by key: start, end, the edit positions as numbers, the barcode."""
    places = lambda c: F.transform(F.filter(F.split(c, "\\|"), lambda x: x != "."), lambda x: x.cast("bigint"))
    t = table.withColumns({"_c": places("c2t"), "_g": places("g2a")})
    out = _in_order(t, sizes, "start", "end", "_c", "_g", F.asc_nulls_first("barcode"))
    write_lines(out.select(_tabs("chrom", "start", "end", "c2t", "g2a", *["barcode"] * barcode, "n")), path, compress)


def write_motif_hits(hits: DataFrame, path: str) -> None:
    """BED of six columns, the score with four decimals."""
    write_lines(hits.orderBy("chrom", "start", "motif", "strand").select(_tabs("chrom", "start", "end", "motif", F.format_string("%.4f", F.col("score").cast("double")), "strand")), path)


def six_digits(c: Column) -> Column:
    """A double as %.6g writes it, which Spark's own format does not."""
    @F.pandas_udf("string")
    def say(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else f"{v:.6g}")

    return say(c)


def write_footprints(sites: DataFrame, scored: DataFrame, sizes: DataFrame, path: str) -> None:
    """sites (site_id, chrom, start, end, name) with their score and p-value, in the contigs' and the file's order."""
    j = sites.join(scored.select("site_id", "score", "p_value"), "site_id")
    write_lines(_in_order(j, sizes, "site_id").select(_tabs("chrom", "start", "end", "name", six_digits(F.col("score")), six_digits(F.col("p_value")))), path)


def write_bedgraph(track: DataFrame, sizes: DataFrame, path: str) -> None:
    write_lines(_in_order(track.where("value <> 0"), sizes, "pos").select(_tabs("chrom", "pos", F.col("pos") + 1, "value")), path)
