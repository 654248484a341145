"""Personal data: places in texts of many hits, what the classifier decides, and rows of every kind."""

import hashlib
import random
import re

import brute
import pytest
from editscan.llm import pii
from editscan.llm.common import running_sums
from pyspark.sql import functions as F


def test_many_hits_in_one_text(spark):
    text = " ".join(f"a{i}@b{i % 7}.com, 10.0.{i % 256}.{i % 199}\n" for i in range(20_000))
    got = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in got if s["base"]] == brute.personal(text) and len(got) == 40_000


def test_running_sums(spark):
    rng = random.Random(0)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate((0, 1, 255, 256, 257, 512, 700, 66_000))]
    got = spark.createDataFrame(rows, "i int, v array<int>").select("i", running_sums(F.col("v")).alias("s")).collect()
    for r in got:
        total, want = 0, []
        for x in rows[r["i"]][1]:
            total += x
            want.append(total)
        assert r["s"] == want


def test_decisions(spark):
    """Loose spans that the other labelers speak for are added, the others are not."""
    rng, rows, want = random.Random(1), [], {}
    word = lambda: rng.choice(["here", "we", "go", "again", "and", "then"])
    for i in range(400):
        h = hashlib.sha1(str(i).encode()).hexdigest()
        text = " ".join(word() for _ in range(rng.randint(1, 9)))
        kind = i % 4
        if kind == 0:
            text += f' mail me{i}@site.com token = "{h}" ok'
        elif kind == 1:
            text += f" commit {h} ok"
        elif kind == 2:
            text += f" order 9{rng.randrange(10**15):015d} ok"
        else:
            text += f" call +1 (555) 010-{1000 + i} from 8.{i % 256}.4.4 ok"
        want[i] = [(m.start(), m.end()) for m in re.finditer(h, text)] if kind == 0 else []
        rows.append((i, text))
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [(s["start"], s["end"]) for s in r["spans"] if not s["base"]] == want[r["doc_id"]]


def test_estimate_finds_reliabilities():
    """Votes drawn from known rates: the posterior separates the classes, and the noisy labeler is worth less."""
    rng, counts = random.Random(2), {}
    truth = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        right = (0.95, 0.9, 0.9, 0.55)
        votes = tuple((1 if real else -1) * (1 if rng.random() < p else -1) for p in right)
        counts["name", votes] = counts.get(("name", votes), 0) + 1
        truth[votes] = truth.get(votes, 0) + (1 if real else -1)
    listed = [(k, v, n) for (k, v), n in sorted(counts.items())]
    post = pii.estimate(listed)
    assert all((post["name", v] > 0.5) == (t > 0) for v, t in truth.items() if abs(t) > 30)
    weights = pii.train(listed, post)["weight"]
    assert min(weights[:3]) > 2 * abs(weights[3])


def test_rows_of_every_kind(spark):
    rows = [(None, "x@y.com", "a", 1), (1, "x@y.com", "b", 2), (1, "x@y.com", "b", 2), (2, None, None, None), (3, "", "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c string, spans int")
    df = df.unionByName(spark.createDataFrame([(4, "1" * 500_000, "d", 1)], df.schema))
    got = sorted(((r["doc_id"] or 0, len(r["spans"])) for r in pii.find_personal_data(df).collect()))
    assert got == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0)]
    assert pii.find_personal_data(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["ab@c.d" * 3000, "+1 " * 5000, "1.1.1.1" * 4000, "4" * 10_000, "x_9" * 20_000])
def test_dense_texts(spark, text):
    got = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in got if s["base"]] == brute.personal(text)
