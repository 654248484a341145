"""Range joins against brute force, and how many rows meet in a bin."""

import random

from editscan.operators import intervals


def spans(rng, n, most):
    """Spans of all kinds: empty, reversed, one base, bookended, negative, some a hundred times as long, and nulls."""
    out = [(rng.choice(["c1", "c2"]), a, a + rng.choice([-3, 0, 1, 2, rng.randrange(most), rng.randrange(100 * most)])) for a in (rng.randrange(-500, 5000) for _ in range(n))]
    return [(i, *x) for i, x in enumerate([*out, *out[:5], (None, 1, 9), ("c1", None, 9), ("c1", 1, None), ("c1", 30, 60), ("c1", 60, 90)])]


def on(a, b):
    return a[1] is not None and a[1] == b[1]


def known(x):
    return None not in x[2:] and x[2] < x[3]


def test_joins_by_brute_force(spark):
    for seed, (most_a, most_b) in enumerate([(40, 200), (200, 3), (2, 2), (5, 4000)]):
        rng = random.Random(seed)
        a, b = spans(rng, 120, most_a), spans(rng, 80, most_b)
        da, db = spark.createDataFrame(a, "i long, chrom string, s long, e long"), spark.createDataFrame(b, "j long, chrom string, t long, f long")
        for least in (1, 32, 1000):
            got = intervals.overlap_join(da, db, ("s", "e"), ("t", "f"), least).select("i", "j").collect()
            assert sorted(map(tuple, got)) == [(x[0], y[0]) for x in a for y in b if on(x, y) and known(x) and known(y) and x[2] < y[3] and y[2] < x[3]]
        got = intervals.points_in(da, db, "s", ("t", "f")).select("i", "j").collect()
        assert sorted(map(tuple, got)) == [(x[0], y[0]) for x in a for y in b if on(x, y) and known(y) and x[2] is not None and y[2] <= x[2] < y[3]]
    none = db.where("false")
    assert intervals.overlap_join(da, none, ("s", "e"), ("t", "f")).count() == intervals.points_in(da, none, "s", ("t", "f")).count() == 0


def test_rows_that_meet_in_a_bin_mostly_overlap(spark):
    """Of regions of 200 bases, bins of 4,096 brought together twenty times the pairs of the result."""
    regions = spark.range(2000).selectExpr("'chr1' as chrom", "id * 37 % 20000 as start", "id * 37 % 20000 + 200 as end")
    reads = spark.range(3000).selectExpr("'chr1' as chrom", "id * 53 % 20000 as s", "id * 53 % 20000 + 40 as e")
    pairs = lambda sides: sides[0].join(sides[1], ["chrom", "_bin"]).count()
    assert pairs(intervals._sides(reads, regions, ("s", "e"), ("start", "end"), intervals.LEAST)) < 1.5 * intervals.overlap_join(reads, regions, ("s", "e"), ("start", "end")).count()
    assert pairs(intervals._binned(reads, regions, "s", ("start", "end"))) < 1.3 * intervals.points_in(reads, regions, "s").count()


def test_bins_follow_the_mean_span(spark):
    """A span as long as a contig beside many short ones takes no more bins than it has eighths of the mean."""
    regions = spark.range(1000).selectExpr("'chr1' as chrom", "id * 100 as start", "id * 100 + if(id = 0, 100000000, 50) as end")
    assert intervals._binned(regions, regions, "start", ("start", "end"))[1].count() <= 10 * 1000
