"""The pipeline's stages on planted documents, and its run on a whole small table."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from compare import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docstrata.functions.tables import materialize
from docstrata.llm import quality as Q
from docstrata.llm import secrets

sys.path.insert(0, str(Path(__file__).parent))
from test_minhash import brute as all_pairs  # noqa: E402
from test_quality import plain_statistics  # noqa: E402

SMALL = str(DATA / "sf0.001")


def test_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), name.replace(" ", "-"))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_clean_documents_stay(spark):
    """On a table with labels enough to learn from; with some 60 training rows (sf0.001) about 4 % of the good go."""
    d = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, d).select("doc_id").collect()}
    assert len(good - kept) <= 0.02 * len(good)


def test_planted_copies_and_secrets(spark, documents):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, text.replace("word30", "other")), (4, "wholly different words in this one"), (5, None)]
    kept = corpus_pipeline.near_duplicates(spark, documents(rows), SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    clean = corpus_pipeline.secrets(spark, documents([(1, "api_key = 'Zx81Yw72Vu63Tt'"), (2, "plain words")]), SMALL)
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "api_key = '[SECRET]'", 2: "plain words"}


def test_odd_rows_and_clashing_names(spark, documents):
    """Nulls, empty texts, repeated rows and ids, and other columns of any name and kind pass through the filtering stages."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (4, ""), (None, text), (None, None), (5, "Sole words of this text"), (5, "and others under the same id"), (6, "long " * 200_000)]
    df = documents(rows).select("*", F.lit(1).alias("_0"), F.lit("r").alias("_rest"), F.create_map(F.lit("a"), F.rand(3)).alias("m"), F.lit(b"b").alias("c0"), F.lit(2).alias("component_id"), F.lit(None).cast("int").alias("digest"), F.array(F.struct(F.lit(1).alias("x"))).alias("kept"))
    kept = materialize(corpus_pipeline.near_duplicates(spark, df, SMALL), "kept")
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (3, None), (4, ""), (None, text), (None, None), *rows[8:]], key=str)
    for stage in (corpus_pipeline.quality, corpus_pipeline.secrets):
        found = stage(spark, df, SMALL)
        assert found.columns == df.columns and found.count() <= len(rows)
    assert {r.doc_id for r in corpus_pipeline.packing(spark, kept, SMALL).collect()} == {1, 3, 4, 5, 6, None}


@pytest.mark.parametrize("stage", range(4))
def test_empty(spark, documents, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, documents([]), SMALL).collect() == []


def plain_run(docs, labels):
    """The pipeline one document after the other: (doc_id, piece, start, length, ids_crc32) of all pieces."""
    stats = np.array([plain_statistics(t) for _, t in docs])
    held_out = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in docs])
    known = np.array([i in labels for i, _ in docs]) & ~held_out
    s, y = stats[known], np.array([labels.get(i, 0) for i, _ in docs])[known]
    random = np.random.default_rng(Q.SEED)
    d = s.shape[1]
    m = Q.Model(s.mean(axis=0), s.std(axis=0) + 1e-9, random.normal(0, 1 / (Q.WIDTH * np.sqrt(d) / 2), (d, Q.FEATURES)), random.uniform(0, 2 * np.pi, Q.FEATURES), None, None, None)
    z, fold = m.features(s), Q.fold_of(s)
    ridge = lambda a, b: np.linalg.solve(a.T @ a + Q.RIDGE * len(a) * np.eye(a.shape[1]) / a.shape[1], a.T @ b)
    m.solution = ridge(z, y)
    raw = np.zeros(len(y))
    for f in range(Q.FOLDS):
        raw[fold == f] = z[fold == f] @ ridge(z[fold != f], y[fold != f])
    bins = np.clip((raw + 0.5) / 2 * Q.BINS, 0, Q.BINS - 1).astype(int)
    there = np.unique(bins)
    m.knots = (there + 0.5) / Q.BINS * 2 - 0.5
    level = Q.pooled(np.array([y[bins == b].mean() for b in there]), np.array([(bins == b).sum() for b in there], float))
    m.levels = np.clip(level + 1e-4 * (m.knots - 0.5), 0, 1)
    good = [doc for doc, ok in zip(docs, m.score(stats) >= 0.5, strict=True) if ok]
    component = all_pairs(good, 5)
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in good:
        if component[i] == i:
            ids = np.array([*tokens.encode(secrets.redacted(t or "", "[SECRET]"), add_special_tokens=False).ids, 2], "<u4")
            first = len(ids) % 1024 or min(len(ids), 1024)
            for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids) + 1, 1024)], strict=True)):
                out.append((i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return sorted(out)


def test_run_against_a_plain_one(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == plain_run(docs, labels)
    filled = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024 and len(filled) <= sum(filled.values()) // 1024 + 3
