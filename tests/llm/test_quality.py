"""The quality classifier: held-out accuracy, and odd inputs."""

from __future__ import annotations

import random
import zlib

import numpy as np
from compare import DATA
from pyspark.sql import functions as F

from docstrata.llm import quality as Q


def test_held_out_accuracy(spark):
    d = str(DATA / "sf0.01")
    found = Q.op5_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    out = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) > 0.95


def plain_statistics(text):
    """The statistics of one text, written out."""
    raw = (text or "").encode()
    n, words, lines = max(len(raw), 1), raw.split(), raw.split(b"\n")
    share = lambda chars: sum(c in chars for c in raw) / n
    groups = [range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", range(128, 256), b".", b",;:", b"!?", b"|", b"#$%&*@^~<>{}[]\\/_=+", b"\"'()-`"]
    per = max(len(words), 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / per
    return [
        np.log1p(len(raw)), *map(share, groups), max(raw.count(c) for c in groups[9] + groups[10]) / n, np.log1p(len(words)), mean, np.sqrt(max(sum(x * x for x in sizes) / per - mean**2, 0)),
        sum(x > 20 for x in sizes) / per, np.log(len(lines)), len(words) / len(lines), len(set(lines)) / len(lines), sum(w[-1:] in groups[8] + groups[9] + groups[10] for w in words) / per, sum(w[:1].isupper() for w in words) / per,
    ]


def test_statistics_one_by_one():
    rng = random.Random(2)
    texts = ["", "\n", "One two.\nOne two.\n", "é|é|, #!"] + ["".join(rng.choice("aB1 \n\t.,!|#'é") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    found = Q.statistics([t.encode() for t in texts])
    names = dict(zip(Q.STATISTICS, found.T, strict=True))
    for i, t in enumerate(texts):
        wanted = dict(zip(Q.STATISTICS, plain_statistics(t), strict=True))
        assert all(abs(names[k][i] - v) < 1e-9 for k, v in wanted.items()), (t, {k: (names[k][i], v) for k, v in wanted.items() if abs(names[k][i] - v) >= 1e-9})


def test_scores_against_one_computation(spark):
    """Fourier features, ridge, out-of-fold calibration: all in one process over all rows."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = rng.normal(size=(400, len(Q.STATISTICS))) + 0.4 * y[:, None]
    rows = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(s, y, strict=True)], "stats array<double>, label int").repartition(5)
    m = Q.fit(rows)
    z, fold = m.features(s), Q.fold_of(s)
    raw = np.zeros(400)
    for f in range(Q.FOLDS):
        a, b = z[fold != f], y[fold != f]
        raw[fold == f] = z[fold == f] @ np.linalg.solve(a.T @ a + Q.RIDGE * len(a) * np.eye(a.shape[1]) / a.shape[1], a.T @ b)
    assert min(np.bincount(fold, minlength=Q.FOLDS)) > 50
    bins = np.clip((raw + 0.5) / 2 * Q.BINS, 0, Q.BINS - 1).astype(int)
    known = np.unique(bins)
    level = Q.pooled(np.array([y[bins == b].mean() for b in known]), np.array([(bins == b).sum() for b in known], float))
    knots = (known + 0.5) / Q.BINS * 2 - 0.5
    wanted = np.clip(np.interp(m.raw(s), knots, np.clip(level + 1e-4 * (knots - 0.5), 0, 1)), 0, 1)
    assert np.abs(m.score(s) - wanted).mean() < 1e-3


def test_isotonic():
    v = Q.pooled(np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.array([1.0, 1, 1, 2, 1]))
    assert (np.diff(v) >= 0).all() and v.tolist() == [0.0, 0.5, 0.5, 1.0, 1.0]


def test_normal_equations_are_exact(spark):
    """What partitions add up equals one computation over all rows."""
    rng = np.random.default_rng(0)
    s, y = rng.normal(size=(300, len(Q.STATISTICS))), rng.integers(0, 2, 300)
    rows = spark.createDataFrame([(x.tolist(), int(k)) for x, k in zip(s, y, strict=True)], "stats array<double>, label int").repartition(7)
    m = Q.fit(rows)
    z = m.features(s)
    direct = np.linalg.solve(z.T @ z + Q.RIDGE * 300 * np.eye(z.shape[1]) / z.shape[1], z.T @ y)
    assert np.allclose(z @ direct, m.raw(s), atol=1e-6)


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (2, ""), (None, "text"), (4, "\n \n"), (5, "x" * 200_000)], stats=F.lit("clash"))
    labels = spark.createDataFrame([(2, None), (None, 1)], "doc_id long, quality int")
    stats = Q.statistics_table(docs)
    m = Q.fit(Q.labelled(stats, labels))
    found = Q.score(stats, m).collect()
    assert len(found) == 6 and {r.score for r in found} == {0.5}
    assert Q.keep_good(docs, labels).count() == 6


def test_one_kind_of_label(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(30)])
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    stats = Q.statistics_table(docs)
    assert {r.score for r in Q.score(stats, Q.fit(Q.labelled(stats, labels))).collect()} == {1.0}


def test_empty(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.keep_good(documents([]), labels).collect() == []
