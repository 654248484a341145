"""Position weight matrices: log odds, exact score thresholds and scans of both strands."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import BASES, reverse_complement


def log_odds(counts: list[list[float]], pseudocount: float = 0.8, background: float = 0.25) -> list[list[float]]:
    """Rows of A, C, G, T counts per position as log2 odds over a flat background."""
    return [[math.log2((c + pseudocount * background) / (sum(row) + pseudocount) / background) for c in row] for row in counts]


def threshold(matrix: list[list[float]], p_value: float = 5e-5, step: float = 1e-3) -> float:
    """The lowest score that random sequence reaches at rate p_value or less, from the exact distribution of scores rounded down to ``step``."""
    dist = {0: 1.0}
    for row in matrix:
        new: dict[int, float] = {}
        for s, p in dist.items():
            for x in row:
                k = s + math.floor(x / step)
                new[k] = new.get(k, 0.0) + p / 4
        dist = new
    tail, best = 0.0, max(dist) + 1
    for s in sorted(dist, reverse=True):
        tail += dist[s]
        if tail > p_value:
            break
        best = s
    return best * step


def pwm_table(spark: SparkSession, motifs: dict[str, list[list[float]]], p_value: float = 5e-5) -> DataFrame:
    """motif, width, cutoff, matrix (integer thousandths by position and base)."""
    rows = []
    for name, counts in motifs.items():
        m = log_odds(counts)
        rows.append((name, len(m), int(round(threshold(m, p_value) * 1000)), [[math.floor(x * 1000) for x in r] for r in m]))
    return spark.createDataFrame(rows, "motif string, width int, cutoff long, matrix array<array<bigint>>")


def scan(sequences: DataFrame, pwm: DataFrame) -> DataFrame:
    """Hits (chrom, start, end, motif, score, strand) in sequences (chrom, start, seq).

    Scores are summed in integer thousandths, so they agree whatever the order; windows with
    another base than A, C, G or T are skipped. Motifs are few: they are broadcast.
    """
    w = sequences.crossJoin(F.broadcast(pwm)).where("length(seq) >= width")
    spots = w.select("chrom", "motif", "width", "cutoff", "matrix", "start", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - F.col("width"))).alias("i"))
    win = spots.select("chrom", "motif", "width", "cutoff", "matrix", (F.col("start") + F.col("i")).alias("start"), F.substr("seq", F.col("i") + 1, F.col("width")).alias("win")).where("win rlike '^[ACGT]+$'")
    both = win.select("*", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand")).withColumn("w", F.when(F.col("strand") == "-", reverse_complement(F.col("win"))).otherwise(F.col("win")))
    letters = F.translate("w", "ACGT", "0123")
    score = F.aggregate(F.col("matrix"), F.struct(F.lit(1).alias("i"), F.lit(0).cast("bigint").alias("s")), lambda a, row: F.struct((a["i"] + 1).alias("i"), (a["s"] + F.get(row, F.substr(letters, a["i"], F.lit(1)).cast("int"))).alias("s")))["s"]
    return both.withColumn("score", score).where("score >= cutoff").select("chrom", "start", (F.col("start") + F.col("width")).alias("end"), "motif", "score", "strand")


def label(matrix_id: str | None, name: str) -> str:
    return f"{matrix_id}.{name}" if matrix_id else name


assert len(BASES) == 4
