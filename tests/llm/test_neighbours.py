"""Recall over several shards, with beams far below a shard, and the graph's own quality."""

import numpy as np
import pytest
from editscan.llm import neighbours
from pyspark.sql import functions as F


def clusters(n, dim, k, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim))
    return (centres[rng.integers(k, size=n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)


def best(unit, q, k):
    sims = unit @ unit[q]
    sims[q] = -2
    return set(np.lexsort((np.arange(len(sims)), -sims))[:k].tolist())


@pytest.mark.parametrize("made", [clusters(6000, 24, 60), np.random.default_rng(1).normal(size=(6000, 16)).astype(np.float32)])
def test_recall_over_shards(spark, made):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest_neighbours(rows, F.col("vec_id") % 50 == 0, shard_rows=1500, beam=48).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = made.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert len(got) == 120
    assert sum(len(got[q] & best(unit, q, 5)) for q in got) / (5 * len(got)) >= 0.9


def test_graph_finds_true_neighbours(spark):
    """NN-descent finds most true neighbours, its lists are in order, and no node is its own neighbour."""
    made = clusters(1200, 16, 20, 3)
    points = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(made)], "shard long, node long, vec array<double>")
    graph = {r["node"]: r["near"] for r in neighbours.build_graph(points, degree=12, rounds=5).collect()}
    unit = made.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert all(i not in near for i, near in graph.items())
    assert sum(len(best(unit, i, 5) & set(graph[i])) for i in graph) / (5 * len(graph)) > 0.9
    for i, near in list(graph.items())[:50]:
        sims = unit[near] @ unit[i]
        assert (np.diff(sims) < 1e-5).all()
