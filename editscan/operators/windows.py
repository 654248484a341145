"""Training windows: tiles, targets, one-hot rows, splits and model length arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import one_hot


def tiles(regions: DataFrame, length: int = 128, step: int | None = None) -> DataFrame:
    """[start, end) in windows of ``length``; a shorter tail is dropped."""
    step = step or length
    ok = regions.where(F.col("end") - F.col("start") >= length)
    return ok.select("chrom", F.explode(F.sequence(F.col("start"), F.col("end") - length, F.lit(step).cast("bigint"))).alias("start")).withColumn("end", F.col("start") + length)


def targets(tiled: DataFrame, track: DataFrame) -> DataFrame:
    """y: the track over each tile, 0 where it has nothing."""
    spots = tiled.select("chrom", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    y = spots.join(track.select("chrom", "pos", "value"), ["chrom", "pos"], "left").groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", F.lit(0)).alias("v")))).alias("a"))
    return y.select("chrom", "start", "end", F.transform("a", lambda x: x["v"]).alias("y"))


def dataset(tiled: DataFrame, track: DataFrame, sequences: DataFrame) -> DataFrame:
    """chrom, start, end, x (one-hot), y; sequences: (chrom, start, end, seq) of the tiles."""
    return targets(tiled, track).join(sequences.select("chrom", "start", "end", one_hot(F.col("seq")).alias("x")), ["chrom", "start", "end"])


def split(windows: DataFrame, valid_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds is_valid by a seeded hash of the window's place; raises nothing, keeps all rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "chrom", F.col("start").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return windows.withColumn("is_valid", h < int(valid_fraction * 2**32))


def profile_lengths(out: int = 1000, layers: int = 9, first: int = 21, last: int = 75) -> tuple[int, int]:
    """Input and output lengths of a dilated profile model whose convolutions are unpadded."""
    lost = (first - 1) + sum(2 * 2**k for k in range(1, layers)) + (last - 1)
    return out + lost, out
