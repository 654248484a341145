"""Reports of several samples in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_reports(reports: list[DataFrame]) -> DataFrame:
    """Rows of all reports; the first one's columns come first, the others' by name, what is missing is null and so are NaN and infinities."""
    if not reports:
        raise ValueError("no report")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    first = reports[0].columns
    cols = [*first, *sorted(set(out.columns) - set(first))]
    kinds = dict(out.dtypes)
    fine = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c)
    return out.select(*[fine(c) if kinds[c] in ("double", "float") else c for c in cols])
