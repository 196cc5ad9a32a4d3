"""Exact and approximate searches against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from compare import DATA, compare
from pyspark.sql import functions as F

from docstrata.llm import ann, topk
from docstrata.llm import vectors as V


def table(spark, rows, kind="array<float>", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    return df.withColumns(more) if more else df


def brute_topk(rows, k, queries):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in queries:
        own = min(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in good if i != q and len(v) == len(own))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def float32(rng, n, d):
    return np.asarray(rng.normal(size=(n, d)), np.float32)


def test_topk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 200)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [(i, v.tolist()) for i, v in enumerate(float32(np.random.default_rng(1), 900, 8))]
    df = table(spark, rows, score=F.lit("clash"), pair=F.lit(1))
    found = sorted(map(tuple, topk.topk(df, df.where("vec_id % 100 = 0"), 10).collect()))
    assert found == brute_topk(rows, 10, range(0, 900, 100))


@pytest.mark.parametrize("kind", ["ties", "sparse", "positive"])
def test_nra_is_exact(kind):
    rng = np.random.default_rng(2)
    v = {"ties": rng.integers(-1, 2, (700, 5)), "sparse": rng.integers(-900, 900, (700, 16)) * (rng.random((700, 16)) < 0.2), "positive": rng.integers(0, 1024, (700, 12))}[kind]
    for dtype in (1, 2**18, 2**40):  # doubles, integers beyond them, integers of any size
        q, ids, score = topk.nra(np.arange(700), v * dtype if kind != "sparse" else v, np.arange(20), v[:20], 10)
        assert (np.bincount(q) == 10).all()
        for i in range(20):
            mine = sorted(zip(-score[q == i], ids[q == i], strict=True))[:10]
            s = [min(max(x, -(2**63)), 2**63 - 1) for x in ((v * dtype if kind != "sparse" else v).astype(object) @ v[i].astype(object))]
            theirs = sorted((-s[j], j) for j in range(700) if j != i)[:10]
            assert [(int(a), int(b)) for a, b in mine] == [(int(a), int(b)) for a, b in theirs]


ODD = [(0, [0.5, 0.5]), (100, [1.0, float("nan")]), (200, None), (1, [0.1, None]), (2, [float("inf"), 0.0]), (3, [0.25, 0.5]), (3, [0.25, 0.5]), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, []), (300, [1.0, 2.0, 3.0]), (6, [0.5, 0.5])]


def test_topk_odd_rows(spark):
    df = table(spark, ODD)
    found = sorted(map(tuple, topk.topk(df, df.where("vec_id % 100 = 0"), 10).collect()))
    assert found == [(0, 1, 6, 524288), (0, 2, 3, 393216), (0, 3, 3, 393216), (0, 4, 4, 0)]


def test_ann_odd_rows(spark):
    df = table(spark, ODD)
    found = sorted(map(tuple, ann.neighbours(df, df.where("vec_id % 100 = 0"), 10).collect()))
    assert [f[:3] for f in found] == [(0, 1, 6), (0, 2, 3), (0, 3, 3)]
    assert [f[3] for f in found] == [0.0, 0.25, 0.25]


def test_ann_every_width(spark, monkeypatch):
    """Vectors meet those of their own width, the rarest widths too, and columns with clashing names don't matter."""
    monkeypatch.setattr(ann, "WIDTHS", 2)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=d).round(2).tolist()) for i, d in enumerate([8] * 300 + [3] * 60 + [1] * 20 + [5])]
    df = table(spark, rows, kind="array<double>", id=F.lit("clash"), vector=F.lit(1), slot=F.lit(2), pair=F.lit(3), score=F.lit(4), width=F.lit(5))
    asked = [0, 310, 360, 379, 380]
    found = sorted(map(tuple, ann.neighbours(df, df.where(F.col("vec_id").isin(*asked)), 10, recall=1.0).collect()))
    wanted = []
    for q in asked:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(rows[q][1], v, strict=True)))), i) for i, v in rows if i != q and len(v) == len(rows[q][1]))[:10]
        wanted += [(q, r + 1, i) for r, (_, i) in enumerate(near)]
    assert [f[:3] for f in found] == wanted

def test_empty(spark):
    df = table(spark, [])
    assert topk.topk(df, df).collect() == [] and ann.neighbours(df, df).collect() == []
    one = table(spark, [(1, [1.0, 0.0])])
    assert topk.topk(one, one.where("vec_id = 0")).collect() == [] and ann.neighbours(one, one.where("vec_id = 0")).collect() == []


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1", "10,000 rows"])
def test_ann_recall_and_scores(spark, size, tmp_path):
    d = str(DATA / size)
    if "rows" in size:  # more rows than the sample has
        d = str(tmp_path)
        x = np.random.default_rng(9).normal(size=(10_000, 64))
        table(spark, [(i, v.tolist()) for i, v in enumerate(np.float32(x / np.sqrt((x**2).sum(axis=1))[:, None]))]).write.parquet(f"{d}/embeddings.parquet")
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids, m = np.array(list(x)), np.array(list(x.values()))
    found = ann.op9_ann(spark, d).collect()
    hits = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        distance = np.sqrt(((m - x[q]) ** 2).sum(axis=1))
        wanted = [i for _, i in sorted(zip(distance[ids != q], ids[ids != q], strict=True))[:10]]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(r.score == pytest.approx(float(np.sqrt(((x[r.vec_id] - x[q]) ** 2).sum())), abs=1e-12) for r in own)
        hits, total = hits + len({r.vec_id for r in own} & set(wanted)), total + 10
    assert hits / total >= 0.9


@pytest.mark.parametrize("kind", ["copies", "own copies", "equally far", "far away"])
def test_ann_rerank_keeps_ties(kind):
    """More ties than k in a block: the smaller ids win, in whatever order the rows lie."""
    rng = np.random.default_rng(5)
    ids, x = rng.permutation(6000), rng.normal(size=(6000, 16))
    asked = np.array([7, 8, 9])
    if kind == "copies":
        x[rng.permutation(6000)[:2000]] = 0.01
    elif kind == "own copies":  # the asking ids are repeated too, and come before all others
        x[:2000] = 0.01
        ids[:60] = 7
    elif kind == "equally far":
        x[:4000] = 0
        x[np.arange(4000), rng.integers(0, 16, 4000)] = rng.choice([-0.1, 0.1], 4000)
    else:
        x = np.where(rng.random(6000) < 0.4, 0.0, rng.integers(1, 9, 6000))[:, None] * 1e-9 + 1e3 + np.zeros((6000, 16))
    q = np.zeros((3, 16)) + (1e3 if kind == "far away" else 0)
    exact = np.sqrt(((x[None, :, :] - q[:, None, :]) ** 2).sum(axis=2))
    for order in (np.arange(6000), rng.permutation(6000)):
        found = ann.rerank(ids[order], x[order], asked, q, 10)
        for i, a in enumerate(asked):
            wanted = sorted((d, j) for d, j in zip(exact[i].tolist(), ids.tolist(), strict=True) if j != a)[:10]
            assert sorted(zip(found[2][found[0] == a].tolist(), found[1][found[0] == a].tolist(), strict=True)) == wanted


def test_ann_copies_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 500)
    rng = np.random.default_rng(6)
    v = float32(rng, 6000, 8)
    v[rng.permutation(6000)[:3000]] = v[0]
    rows = [(i, v[i].tolist()) for i in rng.permutation(6000).tolist()]
    same = [i for i in range(6000) if (v[i] == v[0]).all()]
    df = table(spark, rows)
    found = sorted(map(tuple, ann.neighbours(df, df.where(F.col("vec_id").isin(0, same[5])), 10).collect()))
    assert found == [(q, r + 1, i, 0.0) for q in (0, same[5]) for r, i in enumerate([j for j in same if j != q][:10])]


def test_partition_is_balanced_and_cuts_few_edges():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 6)) + 6 * rng.integers(0, 2, (800, 6))
    graph = ann.nearest(x, x, 8, np.arange(800))
    label = ann.balanced_partition(graph, 8, x, rng)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 1.06 * 100 and (label[graph] == label[:, None]).mean() > 0.7


def test_query(spark):
    from docstrata.llm.topk import OP6_SQL, op6_topk

    assert compare(spark, "op6_topk", op6_topk, OP6_SQL, str(DATA / "sf0.001")) == ""
    assert V.blocks(0, 5) == 1 and V.blocks(11, 5) == 3
