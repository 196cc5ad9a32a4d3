"""Blocks of vectors for searches: every query block meets every candidate block it should, none is unbounded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 8192, 2048


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False)) & (F.size(vector) > 0)


def blocks(n: int, most: int) -> int:
    return max(1, -(-n // most))


def every(n: int) -> Column:
    """0 .. n - 1, a row for each."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def block(of: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


#: (ids of candidates, candidates, ids of queries, queries) -> (query ids, vector ids, scores)
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def search_blocks(candidates: DataFrame, queries: DataFrame, search: Search, score_type: str) -> DataFrame:
    """Run ``search`` on each pair of blocks that share a value of ``pair``; (id, vector, pair) on both sides."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = search(left.column("id").to_numpy(), matrix(left, "vector"), right.column("id").to_numpy(), matrix(right, "vector"))
        kind = pa.int64() if score_type == "long" else pa.float64()
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2]).cast(kind)], names=["query_id", "vec_id", "score"])

    pairs = candidates.select("id", "vector", "pair").groupBy("pair").cogroup(queries.select("id", "vector", "pair").groupBy("pair"))
    return pairs.applyInArrow(run, f"query_id long, vec_id long, score {score_type}")


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): the k first of each query, ties to the smaller id."""
    window = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
