"""Exact quantiles against numpy and the one-buffer aggregate."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.operators import quantiles as Q

P = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


def same(found, values, p=P):
    return all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(found, np.quantile(values, p), strict=True))


@pytest.mark.parametrize("kind", ["uniform", "exponential", "powers", "two values", "mostly one", "integers"])
def test_one_group_of_many_rows(spark, kind):
    r = np.random.default_rng(7)
    n = 60_000
    values = {"uniform": lambda: r.random(n), "exponential": lambda: r.exponential(size=n), "powers": lambda: 2.0 ** r.integers(-1000, 1000, n), "two values": lambda: r.integers(5, 7, n) * 1.0,
              "mostly one": lambda: np.where(r.random(n) < 0.9, 3.5, r.normal(size=n)), "integers": lambda: np.arange(n)[::-1] * 1.0}[kind]()
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    (got,) = Q.exact_quantiles(rows, "v", P).collect()
    assert got.n == n and same(got.quantiles, values)


def test_groups_of_all_sizes_equal_the_aggregate(spark):
    """Groups of 1 to thousands of rows, one of them with a third of all."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.floor(F.sqrt(F.col("id") / 7))).cast("int").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(9973)) / 7).alias("v"))
    found = {r.g: r for r in Q.exact_quantiles(rows, "v", P, ("g",)).collect()}
    expected = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, P))).alias("q")).collect()
    assert len(found) == len(expected) > 50
    assert all(found[r.g].n == r.n and np.allclose(found[r.g].quantiles, r.q, rtol=1e-12) for r in expected)


def test_nulls_nan_infinity_and_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("a", nan), ("b", inf), ("b", inf), ("b", -0.0), ("b", 0.0), ("b", -inf), ("c", 5.0)], "v string, x double").selectExpr("v", "x", "1 AS g", "2 AS j", "x AS grid")
    found = {r.v: (r.n, r.quantiles) for r in Q.exact_quantiles(rows, "x", [0.0, 0.5, 1.0], ("v",)).collect()}
    assert found == {None: (2, [1.0, 1.5, 2.0]), "b": (5, [-inf, 0.0, inf]), "c": (1, [5.0, 5.0, 5.0])}


def test_empty_and_no_probabilities(spark):
    none = spark.createDataFrame([], "g int, v double")
    assert Q.exact_quantiles(none, "v", P).count() == 0 and Q.exact_quantiles(none, "v", P, ("g",)).count() == 0
    (got,) = Q.exact_quantiles(spark.range(3), "id", []).collect()
    assert (got.n, got.quantiles) == (3, [])


def test_bad_probability(spark):
    with pytest.raises(ValueError, match="between 0 and 1"):
        Q.exact_quantiles(spark.range(3), "id", [1.5])


def test_the_last_bit_is_that_of_sql(spark):
    """Values with many digits, and groups of equal ones."""
    rows = spark.range(900).select((F.col("id") % 30).cast("int").alias("g"), (F.when(F.col("id") % 30 < 5, 7.77).otherwise(F.pmod(F.xxhash64("id"), F.lit(99991))) / 1.7).alias("v"))
    found = {r.g: list(r.quantiles) for r in Q.exact_quantiles(rows, "v", P[:3] + P[4:], ("g",)).collect()}
    values = ", ".join(f"({r.g}, {r.v!r}::DOUBLE)" for r in rows.collect())
    assert found == dict(duckdb.sql(f"SELECT g, quantile_cont(v, {P[:3] + P[4:]}) FROM (VALUES {values}) t(g, v) GROUP BY g").fetchall())
