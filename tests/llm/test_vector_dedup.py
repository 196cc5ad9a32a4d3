"""The metric range join against every pair."""

from __future__ import annotations

import numpy as np
import pytest
from compare import DATA, compare
from pyspark.sql import functions as F

from docstrata.llm import vector_dedup as D


def brute(rows, least):
    good = [v is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    n, to = [0] * len(rows), list(range(len(rows)))

    def head(i):
        while to[i] != i:
            i = to[i]
        return i

    x = [np.array(v, float) if g else None for (_, v), g in zip(rows, good, strict=True)]
    x = [v / np.abs(v).max() if v is not None else None for v in x]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                to[head(i)] = head(j)
    least_of: dict = {}
    for i, (id, _) in enumerate(rows):
        if id is not None:
            least_of[head(i)] = min(least_of.get(head(i), id), id)
    out = [(id, n[i], c := None if id is None else least_of[head(i)], id is None or id == c) for i, (id, _) in enumerate(rows)]
    return sorted(out, key=str)


def made(spark, rows, held=D.HELD, least=0.9, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(map(tuple, D.near_vectors(df.withColumns(more) if more else df, least, held=held).collect()), key=str)


def clustered(rng, n, d, centres, noise):
    c = rng.normal(size=(centres, d))
    return c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["uniform", "clusters", "family", "chain", "low", "copies"])
def test_equals_every_pair(spark, monkeypatch, kind):
    monkeypatch.setattr(D, "MOVE", 2)  # many small cells
    rng = np.random.default_rng(3)
    if kind == "uniform":
        x = rng.normal(size=(700, 6))
    elif kind == "clusters":
        x = clustered(rng, 700, 16, 40, 0.12)
    elif kind == "family":  # a third of all rows are near copies of one, some of them just outside half the angle
        x = np.concatenate([clustered(rng, 300, 16, 1, 0.1), clustered(rng, 300, 16, 1, 0.25), rng.normal(size=(200, 16))])
    elif kind == "chain":  # a circle: all rows are reached, each by its neighbours only
        t = rng.random(600) * 2 * np.pi
        x = np.stack([np.cos(t), np.sin(t)], axis=1)
    elif kind == "low":
        x = rng.normal(size=(600, 3))
    else:
        x = np.concatenate([clustered(rng, 300, 8, 30, 0.1), np.ones((200, 8)), np.ones((50, 8)) * 4, np.ones((20, 8)) * 3])
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
    assert made(spark, rows, held=60) == brute(rows, 0.9)


def test_least_bound_and_sides():
    """Cells send to one another in one direction, and no partner is outside the room that is left."""
    i, j = np.meshgrid(np.arange(50), np.arange(50))
    assert (D.sends(i, j) ^ D.sends(j, i))[i != j].all()
    rng = np.random.default_rng(5)
    x = clustered(rng, 900, 4, 30, 0.3)
    x /= D.norms(x)[:, None]
    c = D.Cells(x[:30], 30, farthest=np.full(30, np.pi), nearest=np.zeros(30))
    cosine = x @ c.pivots.T
    own = cosine.argmax(axis=1)
    may = c.room(cosine, own, float(np.arccos(0.9)))
    a, b = np.nonzero((x @ x.T >= 0.9) & (own[:, None] != own[None]))
    assert len(a) > 100 and may[a, own[b]].all() and may.mean() < 0.7


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.1]), (9, None), (8, []), (7, [0.0, 0.0]), (6, [nan, 1.0]), (4, [inf, 1.0]), (2, [None, 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (5, [1.0, 0.0]), (3, [0.0, 1.0]), (11, [1e308, 0.0]), (12, [1e-300, 0.0]), (-4, [0.0, -3.0]), (-9, [0.0, -2.0])]
    found = made(spark, rows, node=F.lit(1), cell=F.lit("x"), digest=F.lit(2.0), ID=F.lit(3), Vector=F.lit(None))
    assert found == brute(rows, 0.9)
    assert made(spark, []) == [] and made(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_widths_and_large_numbers_of_links(spark, monkeypatch):
    monkeypatch.setattr(D, "WIDTHS", 1)
    rng = np.random.default_rng(6)
    rows = [(i, clustered(rng, 1, d, 1, 0).ravel().tolist()) for i, d in enumerate([4] * 200 + [3] * 150 + [1] * 80 + [9])]
    assert made(spark, rows, held=40) == brute(rows, 0.9)


def test_query(spark):
    for size in ("sf0.001", "sf0.01"):
        assert compare(spark, "op12", D.op12_vector_dedup, D.OP12_SQL, str(DATA / size)) == ""
