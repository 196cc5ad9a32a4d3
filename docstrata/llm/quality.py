"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts gives each row a few statistics. Training adds up, partition by partition, the normal equations
of the Fourier features of the labelled rows (a matrix of fixed size), solves the ridge on the driver, and calibrates
with pooled adjacent violators over a fixed number of score bins. Calibration sees each labelled row through a ridge
that was fitted without the row's fold. Scoring is narrow.

Cases: a null or empty text is one empty line (``distinct_lines`` is 1, all else 0) and is scored like any other; a very long text
passes alone, in arrays of a few times its size; rows with a null or repeated id are scored each on its own; a label
that is null is no label, several labels of an id count each; without labels of both kinds every score is the share of
label 1, or 0.5 without labels. Other columns are no inputs, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions.tables import materialize
from docstrata.llm.bpe import slices, with_columns

BATCH_BYTES = 2_000_000
FEATURES, RIDGE, WIDTH, SEED, BINS, FOLDS = 256, 1e-3, 2.5, 7, 512, 4
STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "blank", "newline", "beyond_ascii", "stop", "comma", "mark", "bar", "symbol", "other_punctuation", "top_symbol",
    "log_words", "word_bytes", "word_spread", "long_words", "log_lines", "line_words", "distinct_lines", "marked_words", "capital_words",
)

CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", range(128, 256), b".", b",;:", b"!?", b"|", b"#$%&*@^~<>{}[]\\/_=+", b"\"'()-`")):
    CLASS[[*_chars]] = _i + 1
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(texts)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    octets = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    hist = np.bincount(owner * 256 + octets, minlength=n * 256).reshape(n, 256).astype(float)
    hist[:, 10] -= 1  # the byte that ends each text here
    total = hist.sum(axis=1)
    share = np.stack([hist[:, CLASS == k].sum(axis=1) for k in range(1, 13)], axis=1) / np.maximum(total, 1)[:, None]
    top = hist[:, (CLASS == 10) | (CLASS == 11)].max(axis=1) / np.maximum(total, 1)
    gap = GAP[octets]
    before = np.append(True, gap[:-1])
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    word_of, length = owner[starts], (ends - starts).astype(float)
    words = np.bincount(word_of, minlength=n).astype(float)
    per = np.maximum(words, 1)
    mean = np.bincount(word_of, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(word_of, length**2, n) / per - mean**2, 0))
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines], float)
    last = octets[np.maximum(ends - 1, 0)]
    marked = np.bincount(word_of, (CLASS[last] >= 9) & (CLASS[last] <= 11), n) / per
    capital = np.bincount(word_of, CLASS[octets[starts]] == 1, n) / per
    return np.column_stack([
        np.log1p(total), share, top, np.log1p(words), mean, spread, np.bincount(word_of, length > 20, n) / per,
        np.log(n_lines), words / n_lines, np.array([len(set(x)) for x in lines]) / n_lines, marked, capital,
    ])


def statistics_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<double>) of every row; narrow."""

    def run(batches):
        for batch in slices(batches, text, BATCH_BYTES):
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            s = statistics([x or b"" for x in column.to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.reshape(-1)))
            yield with_columns(batch, [key], {"stats": lists})

    return docs.select(key, F.col(text)).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("stats", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    """A fitted classifier; its size is fixed by the parameters."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics x features
    phase: np.ndarray
    solution: np.ndarray
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated scores there

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.solution

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("stats")).flatten().to_numpy().reshape(batch.num_rows, -1)


def sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows of ``of(stats, label)``, a vector: each partition sends one, and they are added in a tree."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch), batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        out[r.i] = r.v
    return out


def pooled(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression: the non-decreasing sequence nearest to ``value``."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fold_of(stats: np.ndarray) -> np.ndarray:
    """A fold for each row, from its statistics alone."""
    return (np.abs(stats).sum(axis=1) * 1e6).astype(np.int64) * 40503 // 64 % FOLDS


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = SEED) -> Model:
    """The model of ``labelled(stats, label)``; all labelled rows count."""
    d = len(STATISTICS)
    rows = labelled.where("label is not null").select("stats", F.col("label").cast("int").alias("label"))
    first = sums(rows, lambda s, y: np.concatenate([[len(y), y.sum()], s.sum(axis=0), (s**2).sum(axis=0)]), 2 + 2 * d)
    n, ones = first[0], first[1]
    random = np.random.default_rng(seed)
    mean = first[2 : 2 + d] / max(n, 1)
    scale = np.sqrt(np.maximum(first[2 + d :] / max(n, 1) - mean**2, 0)) + 1e-9
    m = Model(mean, scale, random.normal(0, 1 / (width * np.sqrt(d) / 2), (d, features)), random.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not 0 < ones < n:
        m.levels = np.full(2, ones / n if n else 0.5)
        return m
    k = features + 1
    upper = np.triu_indices(k)
    size = len(upper[0]) + k + 1

    def equations(s, y, m=m):
        fold, z = fold_of(s), m.features(s)
        parts = [np.concatenate([(z[at].T @ z[at])[upper], z[at].T @ y[at], [len(at)]]) for at in (np.flatnonzero(fold == f) for f in range(FOLDS))]
        return np.concatenate(parts)

    total = sums(rows, equations, FOLDS * size).reshape(FOLDS, size)

    def solved(e):
        a = np.zeros((k, k))
        a[upper] = e[: len(upper[0])]
        return np.linalg.solve(a + np.triu(a, 1).T + ridge * max(e[-1], 1) * np.eye(k) / k, e[len(upper[0]) : -1])

    m.solution = solved(total.sum(axis=0))
    others = np.stack([solved(total.sum(axis=0) - e) for e in total], axis=1)  # a ridge without each fold

    def binned(s, y, m=m):
        raw = (m.features(s) @ others)[np.arange(len(s)), fold_of(s)]
        b = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(b, minlength=BINS), np.bincount(b, y, BINS)]).astype(float)

    counts = sums(rows, binned, 2 * BINS)
    weight, hits = counts[:BINS], counts[BINS:]
    there = weight > 0
    m.knots = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[there]
    m.levels = pooled((hits / np.maximum(weight, 1))[there], weight[there])
    # between the ends the order of raw scores is kept where calibration has a plateau
    m.levels = np.clip(m.levels + 1e-4 * (m.knots - 0.5), 0, 1)
    return m


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(rows: DataFrame, m: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of rows(key, stats)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield with_columns(batch, [key], {"score": pa.array(m.score(matrix(batch)))})

    return rows.select(key, "stats").mapInArrow(run, T.StructType([rows.schema[key], T.StructField("score", T.DoubleType())]))


def labelled(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The training rows: those with a label and outside the held-out part."""
    known = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(key, F.col("quality").alias("label"))
    return stats.join(known, key).select("stats", "label")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is below ``least``; the texts are read twice and never shuffled."""
    m = fit(materialize(labelled(statistics_table(docs, key, text), labels, key), "labelled"))

    def run(batches):
        for batch in slices(batches, text, BATCH_BYTES):
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
            good = m.score(statistics([x or b"" for x in column.to_pylist()])) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents."""
    stats = materialize(statistics_table(spark.read.parquet(f"{sf_dir}/documents.parquet")), "statistics")
    m = fit(materialize(labelled(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")), "labelled"))
    return score(stats, m).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
