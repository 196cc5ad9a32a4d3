"""The stored index against the flat search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.operators import search
from docstrata.sources import vector_index as I


def frames(spark, x, every=50):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    return df, df.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector")


def found(df):
    return {(r.query_id, r.id): round(r.score, 6) for r in df.collect()}


def test_recall_and_scanned_share_of_clustered_vectors(spark, tmp_path):
    """With more rows a query reads a smaller share of them, and still finds nine of ten."""
    rng = np.random.default_rng(1)
    shares = []
    for n in (1000, 4000):
        centres = rng.normal(size=(n // 25, 16))
        df, asked = frames(spark, centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, 16)), n // 20)
        path = str(tmp_path / f"i{n}")
        I.build(df, path, clusters=n // 50, parts=8)
        hits, scanned = I.search(spark, path, asked, 10, n_probe=6)
        wanted, mine = found(search.flat(df, asked, 10)), found(hits)
        assert len(set(wanted) & set(mine)) >= 0.9 * len(wanted) and len(mine) == len(wanted)
        assert all(abs(wanted[p] - s) < 1e-6 for p, s in mine.items() if p in wanted)  # scores are exact
        shares.append(scanned.agg(F.avg("scanned")).first()[0] / n)
    assert shares[1] < 0.6 * shares[0] < 0.6


@pytest.mark.parametrize("clusters", [1, 7])
def test_all_probed_and_reranked_is_the_flat_search(spark, tmp_path, clusters):
    rng = np.random.default_rng(2)
    df, asked = frames(spark, np.concatenate([rng.normal(size=(150, 5)), np.ones((60, 5))]), 30)
    I.build(df, str(tmp_path / "i"), clusters=clusters, parts=3)
    hits, scanned = I.search(spark, str(tmp_path / "i"), asked, 10, n_probe=99, candidates=999)
    assert found(hits) == found(search.flat(df, asked, 10)) and {r.scanned for r in scanned.collect()} == {210}


def test_only_probed_clusters_are_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    df, asked = frames(spark, rng.normal(size=(300, 4)), 300)
    path = str(tmp_path / "i")
    I.build(df, path, clusters=20)
    hits, scanned = I.search(spark, path, asked, 5, n_probe=2)
    plan = hits._jdf.queryExecution().toString()
    assert "PartitionFilters: [cluster" in plan.replace("isnotnull(cluster#", "cluster") or "cluster" in plan.split("PartitionFilters")[1][:80]
    assert 0 < scanned.first().scanned < 300 and hits.count() == 5


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("codes", F.lit(1))
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None), (9, [1.0, 1.0, 1.0])], "query_id long, vector array<double>")
    I.build(df, str(tmp_path / "i"))
    hits, _ = I.search(spark, str(tmp_path / "i"), asked)
    assert [(r.query_id, r.id) for r in hits.orderBy("query_id", "rank").collect()][:1] == [(7, 5)] and {r.query_id for r in hits.collect()} == {7}
    I.build(df.limit(0), str(tmp_path / "e"))
    assert I.search(spark, str(tmp_path / "e"), asked)[0].collect() == []
