"""Vector columns, and blockwise top-k by cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either is null or their widths differ."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for null or zero vectors."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column without nulls, of one width, as doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def past_blocks(held: DataFrame, passing: DataFrame, on: list[str], opened: Callable[[pa.Table], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: T.StructType) -> DataFrame:
    """What ``opened(block of held)`` makes of the ``passing`` rows that share the values of ``on``.

    Each block of ``held`` is in memory once, in one task, while the rows that meet it stream past in batches, however many they are;
    ``held`` is moved once, and neither side is copied by this. Blocks that nothing passes give nothing."""
    key = F.to_json(F.struct(*on), {"ignoreNullFields": "false"}).alias("_key")
    both = held.select(key, F.lit(False).alias("_passing"), *held.columns).unionByName(passing.select(key, F.lit(True).alias("_passing"), *passing.columns), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, meet = None, [], None
        for batch in batches:
            keys, past = batch.column(0), batch.column(1)
            n = batch.num_rows
            new = pc.or_(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)), pc.not_equal(past.slice(1), past.slice(0, n - 1))) if n > 1 else pa.array([], pa.bool_())
            cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if a == b:
                    continue
                if keys[a].as_py() != now:
                    now, parts, meet = keys[a].as_py(), [], None
                if not past[a].as_py():
                    parts.append(batch.slice(a, b - a))
                elif parts or meet:
                    meet = meet or opened(pa.Table.from_batches(parts))
                    parts = []
                    yield from meet(batch.slice(a, b - a))

    return both.repartition("_key").sortWithinPartitions("_key", "_passing").mapInArrow(run, schema)


def block_topk(table: DataFrame, queries: DataFrame, k: int, block: int = 8192, id: str = "id", vector: str = "vector", by: str | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k rows with the largest cosine for each query; with ``by``, among the rows that
    share its value with the query, which may have several rows then.

    Rows come in blocks of about ``block``, which the queries pass by: each batch of them is one product of two matrices, and
    only k rows of it for each query go on."""
    group = F.col(by) if by else F.lit(0)
    usable = lambda df, name: df.select(F.col(name).alias(name), F.col(vector).alias("v"), group.alias("g")).where(F.col("v").isNotNull() & (norm(F.col("v")) > 0))
    rows, asked = usable(table, id).withColumnRenamed(id, "id"), usable(queries, "query_id")
    largest = rows.groupBy("g").count().agg(F.max("count")).first()[0] or 0  # one row
    n = max(1, -(-largest // block))
    left = rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    right = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    kinds = [asked.schema["query_id"].dataType, rows.schema["id"].dataType]
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id", kinds[1]), T.StructField("score", T.DoubleType())])

    def opened(a: pa.Table) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        ids, x = a.column("id").combine_chunks(), as_matrix(a.column("v"))
        size = np.linalg.norm(x, axis=1)
        place = np.empty(len(x), int)
        place[np.array(pc.sort_indices(ids))] = np.arange(len(x))
        most = min(k, len(x))

        def meet(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                y = as_matrix(b.column(b.schema.get_field_index("v")))
                s = (y @ x.T) / np.linalg.norm(y, axis=1)[:, None] / size[None, :]
                least = -np.partition(-s, most - 1, axis=1)[:, most - 1] - 1e-8  # ties, whatever the rounding
                who, near = np.nonzero(s >= least[:, None])
                order = np.lexsort((place[near], -np.round(s[who, near], 9), who))
                who, near = who[order], near[order]
                first = np.searchsorted(who, np.arange(len(y)))
                some = np.arange(len(who)) - first[who] < k
                who, near = who[some], near[some]
                asks = b.column(b.schema.get_field_index("query_id"))
                yield pa.RecordBatch.from_arrays([asks.take(pa.array(who, pa.int64())), ids.take(pa.array(near, pa.int64())), pa.array(s[who, near])], names=["query_id", "id", "score"])

        return meet

    return ranked(past_blocks(left, right, ["g", "c"], opened, schema), ["query_id"], k)


def ranked(scored: DataFrame, by: list[str], k: int, score: str = "score", id: str = "id") -> DataFrame:
    """The k rows of largest score for each ``by``, with their rank from 1; ties to the smaller id, null scores last."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.round(score, 9)), id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
