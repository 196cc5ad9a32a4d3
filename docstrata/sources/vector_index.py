"""A stored vector index: clusters as partitions, product-quantized codes, exact rerank.

Rows are written by the cluster of their unit vector, with codes of a few bytes beside the vector. A search reads the codes of the
clusters that its queries probe, and no others (partition filters), adds up table lookups for each row, and reads whole
vectors only of the files that hold its best candidates, whose cosines are exact.

Bounds: there are at most ``clusters`` centroids and 256 codewords for each part of a vector; both are learned from at most ``SAMPLE`` rows, those of
smallest hash; every row is indexed. The driver sees the centroids, the codewords and the numbers of probed clusters. Large clusters
are read in blocks that the queries pass by.

Cases: rows and queries with a null or zero vector, or one of another width than the index, take no part; ids may repeat, each row is a candidate;
ties go to the smaller id; an empty table makes an index without hits; with fewer than k candidates all are returned; other columns are ignored."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import vectors as V
from docstrata.operators import kmeans as K

SAMPLE, ROUNDS, SEED, CODEWORDS, BLOCK = 16_384, 12, 7, 256, 65_536


def lloyd(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centres of the rows of x, from distinct rows by hash."""
    own = np.unique(x, axis=0)
    c = own[np.argsort(K.uniform(own, SEED), kind="stable")[:k]] if len(own) else np.zeros((1, x.shape[1]))
    for _ in range(ROUNDS):
        label = K.squared(x, c).argmin(axis=1)
        n = np.bincount(label, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Quantizer:
    """Centroids, and for each part of a residual its codewords."""

    def __init__(self, centroids: np.ndarray, codewords: list[np.ndarray]):
        self.centroids, self.codewords = centroids, codewords
        self.cuts = np.cumsum([0, *(c.shape[1] for c in codewords)])

    @classmethod
    def learned(cls, x: np.ndarray, clusters: int, parts: int) -> Quantizer:
        centroids = lloyd(x, clusters)
        rest = x - centroids[K.squared(x, centroids).argmin(axis=1)] if len(x) else x
        return cls(centroids, [lloyd(p, CODEWORDS) for p in np.array_split(rest, min(parts, x.shape[1]), axis=1)])

    def cluster(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest clusters of each row, nearest first."""
        return np.argsort(K.squared(x, self.centroids), axis=1, kind="stable")[:, :n]

    def codes(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cluster]
        return np.stack([K.squared(rest[:, a:b], c).argmin(axis=1) for a, b, c in zip(self.cuts, self.cuts[1:], self.codewords)], axis=1).astype(np.uint8)  # noqa: B905

    def distances(self, x: np.ndarray, cluster: int, codes: np.ndarray) -> np.ndarray:
        """About the squared distance of each row of x to each coded row of a cluster: a sum of lookups."""
        rest = x - self.centroids[cluster]
        out = np.zeros((len(x), len(codes)))
        for p, (a, b, c) in enumerate(zip(self.cuts, self.cuts[1:], self.codewords)):  # noqa: B905
            out += K.squared(rest[:, a:b], c)[:, codes[:, p]]
        return out

    def rows(self) -> list[tuple[int, int, list[float]]]:
        return [(p, i, v.tolist()) for p, m in enumerate([self.centroids, *self.codewords]) for i, v in enumerate(m)]


def unit(column: pa.Array) -> np.ndarray:
    x = V.as_matrix(column)
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(df: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    doubles = F.col(vector).cast("array<double>")
    found = df.where(F.col(vector).isNotNull() & (V.norm(doubles) > 0))
    return found if width is None else found.where(F.size(vector) == width)


def build(rows: DataFrame, path: str, clusters: int = 256, parts: int = 16, id: str = "id", vector: str = "vector") -> None:
    """Write the index of ``rows`` at ``path``, which must not exist: ``rows`` by cluster, and ``quantizer``. The index has the most common width."""
    known = usable(rows, vector).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    widest = known.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    width = widest[0].n if widest else 1
    known = known.where(F.size("vector") == width)
    drawn = known.orderBy(F.xxhash64("vector"), "id").limit(SAMPLE).select("vector").toArrow()  # at most SAMPLE rows
    q = Quantizer.learned(unit(drawn.column("vector")) if drawn.num_rows else np.zeros((0, width)), clusters, parts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                some = b.slice(a, 1024)
                x = unit(some.column(1))
                own = q.cluster(x)[:, 0]
                codes = [c.tobytes() for c in q.codes(x, own)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(codes, pa.binary()), pa.array(own.astype(np.int32))], names=["id", "vector", "codes", "cluster"])

    schema = T.StructType([known.schema["id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("codes", T.BinaryType()), T.StructField("cluster", T.IntegerType())])
    known.mapInArrow(coded, schema).hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame(q.rows(), "part int, place int, vector array<double>").coalesce(1).write.parquet(f"{path}/quantizer")
    rows.sparkSession.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/about")


def stored(spark: SparkSession, path: str) -> tuple[Quantizer, DataFrame]:
    """(quantizer, rows) of an index; the quantizer has a bounded number of rows."""
    parts: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/quantizer").orderBy("part", "place").collect():
        parts.setdefault(r.part, []).append(r.vector)
    matrices = [np.array(parts[p], float) for p in sorted(parts)]
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{path}/about").first()[0]))
    return Quantizer(matrices[0], matrices[1:]), spark.read.schema(schema).parquet(f"{path}/rows")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, n_probe: int = 8, candidates: int = 100) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank) of about the k rows of largest cosine for each of queries(query_id, vector), (query_id, scanned): rows whose codes
    were read for it). ``candidates`` rows of each query are reranked by their exact cosine."""
    q, rows = stored(spark, path)
    width = q.centroids.shape[1]
    asked = usable(queries, "vector", width).select("query_id", F.col("vector").cast("array<double>").alias("vector"))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = q.cluster(unit(b.column(1)), n_probe)
                again = b.take(pa.array(np.repeat(np.arange(b.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(near.ravel().astype(np.int32))], names=["query_id", "vector", "cluster"])

    kind = asked.schema["query_id"]
    probes = asked.mapInArrow(probed, T.StructType([kind, asked.schema["vector"], T.StructField("cluster", T.IntegerType())]))
    chosen = sorted(r.cluster for r in probes.select("cluster").distinct().collect())  # at most as many as there are clusters
    here = rows.where(F.col("cluster").isin(chosen))  # a partition filter: other clusters' files are not opened
    sizes = here.groupBy("cluster").count()
    most = sizes.agg(F.max("count")).first()[0] or 0
    n = max(1, -(-most // BLOCK))
    held = here.select("cluster", "id", "codes", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("c"))
    passing = probes.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def opened(t: pa.Table) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        t = t.sort_by("id")
        ids, cluster = t.column("id").combine_chunks(), t.column("cluster")[0].as_py()
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)

        def meet(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a in range(0, batch.num_rows, 64):
                b = batch.slice(a, 64)
                d = np.round(q.distances(unit(b.column(b.schema.get_field_index("vector"))), cluster, codes), 12)
                best = np.argsort(d, axis=1, kind="stable")[:, :candidates]
                who = np.repeat(np.arange(len(d)), best.shape[1])
                asks = b.column(b.schema.get_field_index("query_id"))
                yield pa.RecordBatch.from_arrays([asks.take(pa.array(who)), ids.take(pa.array(best.ravel())), pa.array(np.full(len(who), cluster, np.int32)), pa.array(-np.take_along_axis(d, best, axis=1).ravel())], names=["query_id", "id", "cluster", "score"])

        return meet

    rough = V.past_blocks(held, passing, ["cluster", "c"], opened, T.StructType([kind, rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    best = V.ranked(rough, ["query_id"], candidates).select("query_id", "id", "cluster").distinct()
    exact = best.join(here.select("id", "cluster", F.col("vector").alias("own")), ["cluster", "id"]).join(asked, "query_id").select("query_id", "id", V.cosine(F.col("own"), F.col("vector")).alias("score"))
    scanned = probes.join(sizes, "cluster").groupBy("query_id").agg(F.sum("count").alias("scanned"))
    return V.ranked(exact, ["query_id"], k), scanned
