"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; a balanced partitioning of that graph gives labels; a small classifier learns
to predict them from a vector, and so extends the partitioning to every row. Each row is stored in its most probable
partition. A query goes to its most probable partitions, as many as reach ``recall`` on sampled vectors that the
classifier was not trained on, and is reranked there by exact distances on the original vectors.

The number of partitions is the power of two that leaves ``held`` rows in each, about, up to ``partitions``. Vectors of different
widths don't meet; each of the ``WIDTHS`` most common widths has a classifier of its own, all vectors of the rarer ones
meet every query of their width.

Bounds: a sample has at most ``sample`` rows (those of smallest hash), a classifier a fixed size; every row is indexed, and
large partitions are cut into blocks. Cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows with a null id; a query's own id is no candidate; repeated rows are candidates each; equal
distances are ordered by id before anything is cut; of several vectors for a query's id the smallest asks; other columns
are ignored, whatever their names; without queries or candidates there are no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions.tables import materialize
from docstrata.llm.vectors import CANDIDATES, QUERIES, best, block, blocks, finite, matrix, search_blocks

SAMPLE, HELD, PARTITIONS, NEIGHBOURS, RECALL, SEED = 8192, 128, 256, 10, 0.95, 11
#: Widths with a classifier of their own; queries that are compared with a block at once.
WIDTHS, TOGETHER = 4, 256
#: Rounds of the graph partitioning, and the classifier's hidden units, epochs, batch and rate.
SWEEPS, HIDDEN, EPOCHS, BATCH, RATE = 20, 96, 30, 256, 3e-3


def nearest(x: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places of the k nearest rows of x for each query, without the place ``own``."""
    squares, k, out = (x**2).sum(axis=1), min(k, len(x)), []
    for a in range(0, len(queries), TOGETHER):
        d = squares[None, :] - 2 * queries[a : a + TOGETHER] @ x.T
        if own is not None:
            d[np.arange(len(d)), own[a : a + TOGETHER]] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(graph: np.ndarray, parts: int, x: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """A part for each node of a neighbour graph: parts of nearly equal size that cut few edges.

    Starts from recursive halving at medians of the widest directions, then moves nodes to the part of most of their
    neighbours, those that gain most first, as far as the sizes allow."""
    n = len(graph)
    label = np.zeros(n, int)
    now = 1
    while now < parts:
        for p in range(now):
            here = np.flatnonzero(label == p)
            centred = x[here] - x[here].mean(axis=0)
            direction = np.linalg.svd(centred, full_matrices=False)[2][0] if len(here) > 1 else np.zeros(x.shape[1])
            label[here[np.argsort(centred @ direction, kind="stable")[len(here) // 2 :]]] = p + now
        now *= 2
    limit = int(np.ceil(1.05 * n / now))
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(SWEEPS):
        votes = np.zeros((n, now))
        np.add.at(votes, (source, label[target]), 1)
        np.add.at(votes, (target, label[source]), 1)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=now)
        movers = np.flatnonzero((gain > 0) & (random.random(n) < 0.5))
        moved = 0
        for i in movers[np.argsort(-gain[movers], kind="stable")].tolist():
            if size[wish[i]] < limit:
                size[label[i]] -= 1
                size[wish[i]] += 1
                label[i] = wish[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A classifier with one hidden layer; its size is fixed by the parameters."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x) @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, wanted: np.ndarray, random: np.random.Generator) -> Router:
    """A router for soft labels, by Adam on cross entropy."""
    d, parts = x.shape[1], wanted.shape[1]
    m = Router(random.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts))
    weights = [m.w1, m.b1, m.w2, m.b2]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = random.permutation(len(x))
        for a in range(0, len(x), BATCH):
            xb, yb = x[order[a : a + BATCH]], wanted[order[a : a + BATCH]]
            h = m.hidden(xb)
            e = (m.probabilities(xb) - yb) / len(xb)
            back = (e @ m.w2.T) * (h > 0)
            step += 1
            for w, g, u, v in zip(weights, (xb.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0)), first, second, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                w -= RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m


def fit(x: np.ndarray, partitions: int = PARTITIONS, recall: float = RECALL, k: int = NEIGHBOURS, seed: int = SEED) -> Router:
    """A router for the sample x with at most ``partitions`` partitions; ``probes`` is the least number of them that
    reaches ``recall`` on a fifth of the sample that the classifier did not see, against exact neighbours among all of it."""
    random = np.random.default_rng(seed)
    n, d = x.shape
    partitions = min(partitions, 1 << max(0, (n // 20).bit_length() - 1))  # twenty rows to learn from, at least
    if partitions == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = nearest(x, x, min(k, n - 1), np.arange(n))
    label = balanced_partition(graph, partitions, x, random)
    parts = label.max() + 1
    soft = np.zeros((n, parts))
    np.add.at(soft, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    soft[np.arange(n), label] += 0.5
    unseen = random.random(n) < 0.2
    m = train(x[~unseen], soft[~unseen], random)
    p = m.probabilities(x)
    stored = p.argmax(axis=1)
    order = np.argsort(-p[unseen], axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(order), axis=0), axis=1)
    needed = np.take_along_axis(rank, stored[graph[unseen]], axis=1)
    found = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    m.probes = int(np.searchsorted(found, recall)) + 1
    return m


def distinct_enough(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows but those that can't be among the k nearest of any query: of equal vectors, the k first rows of
    an id and then the 2k of smallest ids stay, so that k are left without a query's own id."""
    _, group = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))

    def place_within(*keys: np.ndarray) -> np.ndarray:
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
        start = np.flatnonzero(fresh)
        return np.arange(len(order)) - start[np.cumsum(fresh) - 1]

    order = order[place_within(group[order], ids[order]) < k]
    return np.sort(order[place_within(group[order]) < 2 * k])


def rerank(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a block for each query, ties to the smaller id: products rule out what is farther than k others
    whatever the rounding, exact differences rank all the rest."""
    x = vectors.astype(np.float64)
    held = distinct_enough(ids, x, k)
    ids, x = ids[held], x[held]
    squares = (x**2).sum(axis=1)
    number, most, out = np.finfo(np.float64), min(len(ids), k), []
    for a in range(0, len(queries), TOGETHER):
        q, asking = queries[a : a + TOGETHER].astype(np.float64), query_ids[a : a + TOGETHER]
        rough = squares[None, :] - 2 * q @ x.T
        # Rounding of a product or of a squared difference is below (width + 3) eps (|q| + |x|)^2.
        margin = 8 * (x.shape[1] + 16) * (number.eps * (np.sqrt((q**2).sum(axis=1))[:, None] + np.sqrt(squares)[None, :]) ** 2 + number.tiny)
        other = asking[:, None] != ids[None, :]
        limit = np.partition(np.where(other, rough + margin, np.inf), most - 1, axis=1)[:, most - 1]
        near = other & ~(rough - margin > limit[:, None])
        for i, qid in enumerate(asking.tolist()):
            chosen = np.flatnonzero(near[i])
            exact = np.sqrt(((x[chosen] - q[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[chosen], exact))[:k]
            order = order[np.isfinite(exact[order])]
            out.append((np.full(len(order), qid), ids[chosen][order], exact[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def routed(table: DataFrame, routers: dict[int, tuple[int, Router]], rest: int, every_probe: bool) -> DataFrame:
    """``table(id, vector)`` with ``slot``: a row for the most probable partition, or each of the ``probes`` most probable ones.

    ``routers`` gives the first slot and the router of a width; vectors of other widths have the slot ``rest``."""

    def run(batches):
        for batch in batches:
            widths = batch.column(1).value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                some = batch.filter(pa.array(widths == width))
                first, m = routers.get(width, (rest, None))
                part = np.zeros((some.num_rows, 1), int)
                if m is not None:
                    p = m.probabilities(matrix(pa.Table.from_batches([some]), "vector").astype(np.float64))
                    part = np.argsort(-p, axis=1, kind="stable")[:, : m.probes if every_probe else 1]
                again = some.take(pa.array(np.repeat(np.arange(some.num_rows), part.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array((first + part.ravel()).astype(np.int32))], names=["id", "vector", "slot"])

    return table.select("id", "vector").mapInArrow(run, T.StructType([table.schema["id"], table.schema["vector"], T.StructField("slot", T.IntegerType())]))


def learned(rows: DataFrame, k: int, sample: int, held: int, partitions: int, recall: float) -> list[tuple[int, Router]]:
    """(width, router) of the most common widths of ``rows(id, vector)``, each from the rows of smallest hash."""
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(WIDTHS).collect()
    out = []
    for r in common:
        drawn = rows.where(F.size("vector") == r.width).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()  # at most ``sample`` rows
        wanted = min(partitions, 1 << round(math.log2(max(1, r["count"] / held))))
        out.append((r.width, fit(matrix(drawn, "vector"), wanted, recall, k)))
    return out


def neighbours(table: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, held: int = HELD, partitions: int = PARTITIONS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest rows of each query, by Euclidean distance."""

    def whole(df: DataFrame) -> DataFrame:
        vectors = df.where(F.col(id).isNotNull() & finite(F.col(vector)) & F.exists(vector, lambda x: x != 0))
        return vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    rows, asked = whole(table), whole(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    routers: dict[int, tuple[int, Router]] = {}
    rest = 0
    for width, m in learned(rows, k, sample, held, partitions, recall):
        routers[width] = (rest, m)
        rest += m.w2.shape[1]
    index = materialize(routed(rows, routers, rest, False), "index")
    sizes = {r.slot: r["count"] for r in index.groupBy("slot").count().collect()}  # a row for each partition
    n_blocks = F.element_at(F.lit([blocks(sizes.get(p, 0), CANDIDATES) for p in range(rest + 1)]), F.col("slot") + 1)
    q = blocks(asked.count(), QUERIES)
    pair = F.struct(F.size("vector").alias("width"), "slot", "c", "q")
    left = index.withColumn("c", F.pmod(F.xxhash64("id", "vector"), n_blocks).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1)))).withColumn("pair", pair)
    right = routed(asked, routers, rest, True).withColumn("q", block(F.col("id"), q)).withColumn("c", F.explode(F.sequence(F.lit(0), n_blocks - 1))).withColumn("pair", pair)
    found = search_blocks(left, right, lambda ids, v, query_ids, qs: rerank(ids, v, query_ids, qs, k), "double")
    return best(found, k, F.col("score").asc())


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the ten nearest of every hundredth vector, among all vectors."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(table, table.where("vec_id % 100 = 0"))
