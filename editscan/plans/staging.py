"""Tables written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here only where the session has none and its master is this machine alone, an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="editscan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written and reread: its rows are made once and lost executors don't undo them."""
    path = f"{shared_dir(df.sparkSession)}/editscan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
