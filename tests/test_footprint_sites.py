"""Footprint queries score every supplier's site, against brute force; the given small tables have at most 100 suppliers."""

import hashlib
import shutil

import pytest
from editscan.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def many(spark, small, tmp_path_factory):
    d = tmp_path_factory.mktemp("many")
    shutil.copy(f"{small}/lineitem.parquet", d)
    spark.range(450).selectExpr("id as s_suppkey").coalesce(1).write.parquet(f"{d}/supplier.parquet")
    return str(d)


def windows(spark, d):
    track = {(r["chrom"], r["pos"]): r["value"] for r in QUERIES["tn5_cut_track"](spark, d).collect()}
    for s in range(450):
        a, n = s * 733 % 19990, 5 + s % 10
        if a - n >= 0 and a + 2 * n <= 20000:
            yield s, n, [track.get((f"chr{s % 4 + 1}", a - n + x), 0) for x in range(3 * n)]


def total(v, n):
    return sum(v[:n]) - sum(v[n : 2 * n]) + sum(v[2 * n :])


def test_all_sites(spark, many):
    want = {s: total(v, n) / n for s, n, v in windows(spark, many)}
    assert sum(s > 200 for s in want) > 200
    got = {r["site_id"]: r["score"] for r in QUERIES["footprint_score"](spark, many).collect()}
    assert got == pytest.approx(want)
    assert {r["site_id"]: r["score"] for r in QUERIES["footprint_pvalue_seeded"](spark, many).collect()} == pytest.approx(want)


def test_p_values(spark, many):
    want = {}
    for s, n, v in windows(spark, many):
        got, hits = total(v, n), 0
        for k in range(50) if got > 0 else ():
            order = sorted(range(3 * n), key=lambda x: (hashlib.md5(f"0|{s}|{k}|{x}".encode()).hexdigest(), x))
            hits += total([v[x] for x in order], n) >= got
        want[s] = (hits + 1) / 51 if got > 0 else 1.0
    assert {r["site_id"]: r["p_value"] for r in QUERIES["footprint_pvalue"](spark, many).collect()} == pytest.approx(want)


def test_seeded_p_values_use_1000_shuffles(spark, many):
    p = [r["p_value"] for r in QUERIES["footprint_pvalue_seeded"](spark, many).collect()]
    assert all(abs(x * 1001 - round(x * 1001)) < 1e-6 for x in p) and any(abs(x * 201 - round(x * 201)) > 1e-6 for x in p)
