"""The projection's shape."""

from editscan.plans import synth
from pyspark.sql import functions as F


def test_lines_are_dealt_once(spark):
    """Distinct lines and their mates by one exchange."""
    keys = synth.keys(spark, "/root/testdata/sf0.001")
    assert keys._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert keys.groupBy("ok", "ln").count().where(F.col("count") > 1).isEmpty()
