"""Every registered query with SQL agrees with DuckDB; those without run."""

import math
from collections import Counter

import duckdb
import pytest
from editscan.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = ["lineitem", "supplier"]


def same(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(map(same, r)) for r in df.select(*cols).collect())
    assert got
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        rel = db.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == cols
        want = Counter(tuple(map(same, r)) for r in db.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({ORACLE_SQL[name]})").fetchall())
        assert got == want
        kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        assert all({"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}[t] == kinds[c] for c, t in df.dtypes)
