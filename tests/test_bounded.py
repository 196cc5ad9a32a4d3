"""Branch and bound against the flat search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.operators import bounded, search
from docstrata.operators.kmeans import kmeans


def ordered(df):
    return [(r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]


def both(spark, rows, queries, by, k=10):
    df = spark.createDataFrame(rows, "id long, vector array<double>, a int, b string")
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    hits, counts = bounded.exact(bounded.build(df, by), asked, k)
    assert ordered(hits) == ordered(search.flat(df, asked, k))
    return {r.query_id: (r.compared, r.pruned) for r in counts.collect()}


def test_clusters_are_pruned(spark):
    """Of well separated groups most rows are never compared, and yet the result is exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=8)).tolist(), i % 8, f"b{i % 40}") for i in range(1600)]
    counts = both(spark, rows, [(q, rows[q][1]) for q in range(12)], ["a", "b"], 5)
    assert all(c + p == 1600 for c, p in counts.values()) and sum(p for _, p in counts.values()) > 0.8 * 12 * 1600


@pytest.mark.parametrize("by", [["a"], ["a", "b"]])
def test_groups_that_overlap(spark, by):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(1).tolist(), int(rng.integers(0, 5)), None if i % 7 == 0 else str(i % 3)) for i in range(400)]
    both(spark, rows, [(q, rng.normal(size=4).tolist()) for q in range(9)], by)


def test_odd_rows(spark):
    """Ties, opposite vectors whose mean is zero, groups smaller than k, null and zero vectors, queries without a vector."""
    rows = [(i, [1.0, 0.0] if i % 2 else [-1.0, 0.0], 0, "x") for i in range(30)] + [(100, None, 1, "y"), (101, [0.0, 0.0], 1, "y"), (102, [0.0, 2.0], None, None), (103, [0.0, 3.0], 2, "z")]
    both(spark, rows, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1e-9, -1.0])], ["a", "b"], 12)
    assert both(spark, rows[:0], [(1, [1.0, 0.0])], ["a"]) == {1: (0, 0)}


def test_over_learned_clusters(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, (rng.normal(size=3) + 4 * rng.integers(0, 3, 3)).tolist()) for i in range(500)], "id long, vector array<double>")
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    once = kmeans(df, [], 6).withColumnRenamed("cluster", "l1")
    hits, counts = bounded.exact(bounded.build(kmeans(once, ["l1"], 3), ["l1", "cluster"]), asked, 3)
    assert ordered(hits) == ordered(search.flat(df, asked, 3)) and counts.agg(F.sum("pruned")).first()[0] > 0
