"""Footprints: sites (site_id, chrom, start, end) scored on a sparse track against their flanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import ratio


def windows(sites: DataFrame, track: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row per position of each window of three site lengths that fits its contig: site_id, len, offset, value."""
    s = sites.withColumn("len", F.col("end") - F.col("start")).join(sizes.select("chrom", "size"), "chrom").where("len > 0 and start - len >= 0 and end + len <= size")
    spots = s.select("site_id", "len", "chrom", F.posexplode(F.sequence(F.col("start") - F.col("len"), F.col("end") + F.col("len") - 1)).alias("offset", "pos"))
    return spots.join(track.select("chrom", "pos", "value"), ["chrom", "pos"], "left").select("site_id", "len", F.col("offset").cast("bigint").alias("offset"), F.coalesce("value", F.lit(0)).alias("value"))


def scores(window: DataFrame) -> DataFrame:
    """Flank means less the centre's mean; ``total`` is the exact sum behind it."""
    third = F.expr("offset div len")
    return window.groupBy("site_id", "len").agg(F.sum(F.when(third == 1, -F.col("value")).otherwise(F.col("value"))).alias("total")).select("site_id", "len", "total", ratio(F.col("total"), F.col("len")).alias("score"))


def p_values(window: DataFrame, n_shuffles: int = 1000, seed: int = 0) -> DataFrame:
    """(as good or better shuffles + 1) / (n_shuffles + 1); scores of 0 or less have 1.

    Shuffle k orders a window by md5(seed|site|k|offset), so it needs no generator's state.
    """
    s = scores(window)
    best = s.where("total > 0")
    rows = window.join(best.select("site_id"), "site_id", "left_semi").crossJoin(window.sparkSession.range(n_shuffles).select(F.col("id").alias("k")))
    order = Window.partitionBy("site_id", "k").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("site_id").cast("string"), F.col("k").cast("string"), F.col("offset").cast("string"))), "offset")
    mixed = rows.withColumn("at", F.row_number().over(order) - 1).groupBy("site_id", "k").agg(F.sum(F.when(F.expr("at div len") == 1, -F.col("value")).otherwise(F.col("value"))).alias("shuffled"))
    hits = mixed.join(best.select("site_id", "total"), "site_id").groupBy("site_id").agg(F.count_if(F.col("shuffled") >= F.col("total")).alias("hits"))
    return s.join(hits, "site_id", "left").select("site_id", "score", F.when(F.col("total") > 0, (F.coalesce("hits", F.lit(0)) + 1) / F.lit(n_shuffles + 1.0)).otherwise(1.0).alias("p_value"))


def exact_p_values(window: DataFrame, n_shuffles: int = 1000, seed: int = 0) -> DataFrame:
    """As p_values with a seeded numpy generator per site, for very long windows or many shuffles."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        v, n = pdf["value"].to_numpy(float), int(pdf["len"].iloc[0])
        score = lambda x: x[..., :n].sum(-1) + x[..., 2 * n :].sum(-1) - x[..., n : 2 * n].sum(-1)
        got, p = score(v), 1.0
        if got > 0:
            rng = np.random.default_rng([seed, int(pdf["site_id"].iloc[0])])
            p = (sum(score(rng.permuted(np.tile(v, (min(500, n_shuffles - a), 1)), axis=1)).__ge__(got).sum() for a in range(0, n_shuffles, 500)) + 1) / (n_shuffles + 1)
        return pd.DataFrame({"site_id": [pdf["site_id"].iloc[0]], "score": [got / n], "p_value": [float(p)]})

    return window.groupBy("site_id").applyInPandas(one, "site_id long, score double, p_value double")
