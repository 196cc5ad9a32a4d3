"""Exact top-k inner products by aggregation of sorted lists without random access.

A block of candidates keeps one list for each dimension, sorted by component; a query reads it from the end that its own
component's sign prefers, so the contributions come in falling order. After each step of sequential reading a candidate has
a lower bound (what was seen of it, and the list's last value for the rest) and an upper bound (the value read last for
the rest). Reading stops when all but a few candidates, and everything unseen, have upper bounds below the k-th
best lower bound; the scores of those few are resolved, and the blocks' lists are merged. Bounds are sums of integers
and hence exact: nothing is lost, ties included.

Cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different widths do
not meet; rows with a null id take no part; a query's own id is no candidate of it, however often it occurs; rows that
repeat are candidates each; of several vectors for a query's id the smallest asks; with fewer than k candidates all are
returned; equal scores are ordered by id within a block already, so that no block returns more than k rows for a query;
components and scores beyond 64 bits take the nearest 64-bit value; other columns are ignored, whatever their names; no
queries, no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.vectors import CANDIDATES, QUERIES, best, block, blocks, every, finite, search_blocks

#: Reading pauses to compare bounds at 1/64, 1/32, ... 1/2 of the lists, then whenever the unread part has halved, this
#: often each; and the share of a block's candidates that may be left to resolve then.
PAUSES, LEFT = 6, 0.06


def pauses(n: int) -> list[int]:
    """Depths at which bounds are compared, up to n."""
    return sorted({n >> p for p in range(1, PAUSES + 1)} | {n - (n >> p) for p in range(1, PAUSES)} | {n} - {0})


def added(at: np.ndarray, value: np.ndarray, n: int, dtype) -> np.ndarray:
    """Sums of ``value`` by ``at``; exact in integers."""
    if dtype == np.float64:
        return np.bincount(at.ravel(), value.ravel(), n)
    out = np.zeros(n, dtype)
    np.add.at(out, at.ravel(), value.ravel())
    return out


def nra(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of the k best candidates of each query, ties to the smaller id."""
    n, d = vectors.shape
    largest = max(abs(int(f(v))) for v in (vectors, queries) for f in (np.min, np.max))
    if largest * largest * d >= 2**63:
        return beyond_64_bits(ids, vectors, query_ids, queries, k)
    exact = largest * largest * d < 2**52
    x, queries = (v.astype(np.float64 if exact else np.int64) for v in (vectors, queries))
    rising = np.argsort(x, axis=0, kind="stable").T  # list j: the candidates by their component j
    entries = np.stack([rising, rising[:, ::-1]]).astype(np.int32)
    components = np.stack([v := np.take_along_axis(x.T, rising, axis=1), v[:, ::-1]])
    few = max(4 * k, int(LEFT * n))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for qid, q in zip(query_ids.tolist(), queries, strict=True):
        lists = np.flatnonzero(q)
        end = (q[lists] > 0).astype(int)  # which end of the list comes first
        weight = q[lists][:, None]
        other = ids != qid
        alive = np.flatnonzero(other)
        if len(lists) and len(alive) > few:
            least = components[end, lists, -1][:, None] * weight
            lower = np.full(n, least.sum(), x.dtype)
            read: list[tuple[np.ndarray, np.ndarray]] = []
            depth = 0
            for upto in pauses(n):
                read.append((entries[end, lists, depth:upto], components[end, lists, depth:upto] * weight))
                chunk, value = read[-1]
                lower += added(chunk, value - least, n, x.dtype)
                depth, now = upto, value[:, -1:]
                bound = np.partition(lower[other], -k)[-k]
                if now.sum() < bound or depth >= n:  # else even what no list has shown can still qualify
                    upper = sum((added(c, v - now, n, x.dtype) for c, v in read), start=now.sum())
                    alive = np.flatnonzero(other & (upper >= bound))
                    if len(alive) <= few or depth >= n:
                        break
        score = x[alive] @ q
        first = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(first), qid), ids[alive[first]], score[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def beyond_64_bits(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nra`` for components whose products don't fit: in whole numbers of any size, one query after the other."""
    x, out = vectors.astype(object), []
    for qid, q in zip(query_ids.tolist(), queries.astype(object), strict=True):
        there = np.flatnonzero(ids != qid)
        score = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in x[there] @ q], np.int64)
        first = np.array(sorted(range(len(there)), key=lambda i: (-int(score[i]), int(ids[there[i]])))[:k], int)
        out.append((np.full(len(first), qid), ids[there[first]], score[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def topk(table: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products, ties to the smaller id."""

    def whole(df: DataFrame) -> DataFrame:
        return df.where(F.col(id).isNotNull() & finite(F.col(vector))).select(F.col(id).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))

    candidates, asked = whole(table), whole(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    c, q = blocks(candidates.count(), CANDIDATES), blocks(asked.count(), QUERIES)
    pair = F.struct(F.size("vector").alias("width"), "c", "q")
    left = candidates.withColumn("c", F.pmod(F.xxhash64("id", "vector"), F.lit(c)).cast("int")).withColumn("q", every(q)).withColumn("pair", pair)
    right = asked.withColumn("q", block(F.col("id"), q)).withColumn("c", every(c)).withColumn("pair", pair)
    found = search_blocks(left, right, lambda ids, v, query_ids, qs: nra(ids, v, query_ids, qs, k), "long")
    return best(found, k, F.desc("score"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector, against all vectors."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk(table, table.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
