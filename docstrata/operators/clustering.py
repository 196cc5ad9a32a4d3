"""Clusters: small groups per parent, three levels over all vectors, centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docstrata.functions.tables import materialize
from docstrata.functions.vectors import as_matrix
from docstrata.operators.kmeans import SEED, TOGETHER, kmeans


def small_groups(vectors: DataFrame, parent: str = "parent_id", vector: str = "vector", most: int = 3) -> DataFrame:
    """Labels of groups that need no k-means: those with at most ``most`` distinct vectors get the rank of the vector
    among the sorted distinct ones; rows without a vector get 0. Other rows have null."""
    w = Window.partitionBy(parent, F.col(vector).isNull()).orderBy(vector)
    ranked = vectors.withColumn("_rank", F.dense_rank().over(w) - 1)
    distinct = F.max("_rank").over(Window.partitionBy(parent, F.col(vector).isNull())) + 1
    label = F.when(F.col(vector).isNull(), F.lit(0)).when(F.col("_distinct") <= most, F.col("_rank"))
    return ranked.withColumn("_distinct", distinct).withColumn("cluster", label).drop("_rank", "_distinct")


def per_parent(vectors: DataFrame, clusters: int = 5, parent: str = "parent_id", id: str = "id", vector: str = "vector", together: int = TOGETHER) -> DataFrame:
    """(id, parent, cluster): an independent k-means for the children of each parent, with min(``clusters``, distinct vectors)
    clusters; parents with at most three distinct vectors are as in ``small_groups``, rows without a vector get 0. A parent of any size
    goes through the same steps (see ``kmeans``)."""
    return kmeans(vectors.select(id, parent, vector), [parent], clusters, ranked=3, vector=vector, together=together).select(id, parent, "cluster")


def three_levels(vectors: DataFrame, l1: int = 50, l2: int = 10, l3: int = 10, seed: int = SEED, together: int = TOGETHER) -> DataFrame:
    """``vectors(id, vector)`` with cluster_l1, cluster_l2, cluster_l3; the row key is kept throughout. Groups of at most as many rows
    as there are clusters are not split and get 0. Rows without a vector drop out."""
    now, names = vectors.where("vector is not null"), []
    for k in (l1, l2, l3):
        names.append(f"cluster_l{len(names) + 1}")
        now = materialize(kmeans(now, names[:-1], k, more_than=k, seed=seed, together=together).withColumnRenamed("cluster", names[-1]), names[-1])
    return now


def partial_sums(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """(by..., n, sum): each task's sums of the vectors of each group, a row for a group and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(batch.schema.get_field_index(vector)))
                keys = list(zip(*(batch.column(batch.schema.get_field_index(b)).to_pylist() for b in by), strict=True))
                of = {key: i for i, key in enumerate(dict.fromkeys(keys))}
                at = np.array([of[key] for key in keys])
                sums = np.zeros((len(of), x.shape[1]))
                np.add.at(sums, at, x)
                for key, n, total in zip(of, np.bincount(at).tolist(), sums, strict=True):
                    one = held.setdefault(key, [0, np.zeros(x.shape[1])])
                    one[0] += n
                    one[1] += total
        columns = [list(c) for c in zip(*held, strict=True)] or [[]] * len(by)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tolist() for _, s in held.values()], pa.list_(pa.float64()))], names=[*by, "n", "sum"])

    fields = [to_arrow_schema(T.StructType([rows.schema[b]])).field(0) for b in by]
    schema = T.StructType([*(rows.schema[b] for b in by), T.StructField("n", T.LongType()), T.StructField("sum", T.ArrayType(T.DoubleType()))])
    return rows.select(*by, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def means(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """(by..., vector): the mean of each group's vectors, from partial sums of each task."""
    dims = partial_sums(rows, by, vector).select(*by, "n", F.posexplode("sum").alias("_dim", "_x")).groupBy(*by, "_dim").agg((F.sum("_x") / F.sum("n")).alias("_x"))
    return dims.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_dim", "_x"))), lambda p: p["_x"]).alias(vector))


def centroids(vectors: DataFrame, cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    """(cluster, vector): the mean of each cluster."""
    return means(vectors, [cluster], vector)


#: Numbers of the centroids that a task holds at once.
CENTRE_NUMBERS = 4_000_000


def nearest_centroid(vectors: DataFrame, centres: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(id, cluster, distance): the nearest of any number of centroids for each row, repeated ids included; ties to the
    smaller cluster; distances are squared and rounded to 9 places.

    Centroids that one task can hold go to all of them. More are cut into blocks, each of which all rows pass by, and a row keeps the
    best of its blocks."""
    counted = centres.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = max(1, CENTRE_NUMBERS // max(counted[1] or 1, 1))
    n_blocks = -(-counted[0] // most)
    field = to_arrow_schema(T.StructType([centres.schema[cluster]])).field(0)
    schema = T.StructType([*(vectors.select("id").schema.fields), centres.schema[cluster], T.StructField("distance", T.DoubleType())])

    def passed(part: pa.RecordBatch, c: np.ndarray, squares: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """One product shows which centroids may be nearest, whatever the rounding; exact differences decide among these."""
        for a in range(0, part.num_rows, 256):
            some = part.slice(a, 256)
            x = as_matrix(some.column(some.schema.get_field_index("vector")))
            own = (x**2).sum(axis=1)[:, None]
            rough = own - 2 * x @ c.T + squares[None]
            margin = 1e-9 + 16 * (x.shape[1] + 16) * np.finfo(float).eps * (own + squares[None])
            row, at = np.nonzero(rough - margin <= (rough + margin).min(axis=1)[:, None])
            exact = np.round(((x[row] - c[at]) ** 2).sum(axis=1), 9)
            order = np.lexsort((at, exact, row))
            first = order[np.append(True, row[order][1:] != row[order][:-1])]
            yield pa.RecordBatch.from_arrays([*(some.column(n) for n in some.schema.names if n != "vector"), names.take(pa.array(at[first])), pa.array(exact[first])], names=[*(n for n in some.schema.names if n != "vector"), cluster, "distance"])

    def held(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        table = table.sort_by(cluster)
        c = as_matrix(table.column("vector"))
        return c, (c**2).sum(axis=1), table.column(cluster).combine_chunks().cast(field.type)

    rows = vectors.select("id", "vector").where("vector is not null")
    if n_blocks <= 1:
        known = centres.select(cluster, "vector").where("vector is not null").toArrow()  # of CENTRE_NUMBERS numbers at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held(known) if known.num_rows else None
            for batch in batches:
                if c and batch.num_rows:
                    yield from passed(batch, *c)

        return rows.mapInArrow(run, schema)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [pa.Table.from_batches([r]) for batch in a.drop_columns(["pair"]).combine_chunks().to_batches() for r in passed(batch, *held(b.drop_columns(["pair"])))] if a.num_rows and b.num_rows else []
        return pa.concat_tables(out) if out else pa.table({"at": pa.array([], pa.int64()), "id": pa.array([], a.schema.field("id").type), cluster: pa.array([], field.type), "distance": pa.array([], pa.float64())})

    numbered = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "rows")  # repeated ids are rows of their own
    row_blocks = -(-numbered.count() // 16_384) or 1
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    left = numbered.withColumn("r", deal("at", row_blocks)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select("at", "id", "vector", F.struct("r", "c").alias("pair"))
    right = centres.select(cluster, "vector").where("vector is not null").withColumn("c", deal(cluster, n_blocks)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).select(cluster, "vector", F.struct("r", "c").alias("pair"))
    found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(meet, T.StructType([T.StructField("at", T.LongType()), *schema.fields]))
    return found.groupBy("at").agg(F.first("id").alias("id"), F.min(F.struct("distance", cluster)).alias("x")).select("id", f"x.{cluster}", "x.distance")


def sizes(vectors: DataFrame, levels: tuple[str, ...] = ("cluster_l1", "cluster_l2", "cluster_l3")) -> DataFrame:
    """Rows of each cluster on all levels at once; a null level means "all below"."""
    return vectors.rollup(*levels).count().where(F.col(levels[0]).isNotNull())


def quality(clustered: DataFrame, cluster: str = "cluster") -> float:
    """Silhouette with squared distances."""
    return ClusteringEvaluator(featuresCol="_v", predictionCol=cluster).evaluate(clustered.withColumn("_v", array_to_vector("vector")))
