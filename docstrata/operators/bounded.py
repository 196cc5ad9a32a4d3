"""Exact nearest rows through a tree of groups: branch and bound on centres and radii.

Every group of rows, on every level, has the mean of its unit vectors as centre, and the distance of its farthest row as radius. By the
triangle inequality no row of a group is nearer to a query than the centre's distance less the radius. A search goes down from the
top; a group whose bound is beyond the query's k-th best row so far is left with all that is below. A first descent to the most
promising leaf of each query gives that k-th best row; then the leaves that remain are opened in order of their bounds, twice as many in each
round, until none is left within it. The result is that of a search of all rows, and so are its ties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions import vectors as V
from docstrata.functions.tables import materialize
from docstrata.operators import clustering

#: Above the rounding of a bound; and all children of a group.
MARGIN, ALL = 1e-6, 2**31 - 1


@dataclass
class Index:
    """``levels``: for each level (node, parent, centre, radius, rows); ``rows``: (id, vector, leaf)."""

    levels: list[DataFrame]
    rows: DataFrame


def build(rows: DataFrame, by: list[str], id: str = "id", vector: str = "vector") -> Index:
    """The index of ``rows`` whose groups are, from the top, the values of by[0], by[:2] and so on; rows with a null or zero
    vector take no part."""
    path = lambda n: F.to_json(F.struct(*by[:n]), {"ignoreNullFields": "false"})
    doubles = F.col(vector).cast("array<double>")
    usable = rows.where(F.col(vector).isNotNull() & (V.norm(doubles) > 0)).withColumn("_norm", V.norm(doubles))
    named = usable.select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.transform(doubles, lambda x: x / F.col("_norm")).alias("unit"), *(path(n).alias(f"node{n}") for n in range(1, len(by) + 1)))
    named = materialize(named, "search-rows")
    levels = []
    for n in range(1, len(by) + 1):
        node = f"node{n}"
        mean = clustering.means(named, [node], "unit").withColumnRenamed("unit", "mean")
        any_ = named.groupBy(node).agg(F.min("unit").alias("any"))
        # a mean of zero has no direction, so a row of the group is its centre then
        centres = mean.join(any_, node).select(node, F.when(V.norm(F.col("mean")) > 1e-6, F.col("mean")).otherwise(F.col("any")).alias("centre"))
        up = F.lit("") if n == 1 else F.col(f"node{n - 1}")
        each = named.select(node, up.alias("parent"), "unit").join(centres, node)
        found = each.groupBy(F.col(node).alias("node"), "parent").agg(F.first("centre").alias("centre"), F.sqrt(F.max(V.squared_distance(F.col("unit"), F.col("centre")))).alias("radius"), F.count("*").alias("rows"))
        levels.append(materialize(found, "search-nodes"))
    return Index(levels, named.select("id", "vector", F.col(f"node{len(by)}").alias("leaf")))


def bounds(level: DataFrame, open_: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node, parent, bound) of all children of the open (query_id, parent): the distance, between unit vectors, that no row is nearer than."""
    asked = open_.join(queries, "query_id").select("query_id", "vector", "parent")
    near = V.block_topk(level.select(F.col("node").alias("id"), F.col("centre").alias("vector"), "parent"), asked, ALL, by="parent")
    squared = 1 - 2 * F.col("score") * V.norm(F.col("centre")) + V.dot(F.col("centre"), F.col("centre"))
    joined = near.select("query_id", F.col("id").alias("node"), "score").join(level, "node")
    return joined.select("query_id", "node", "parent", (F.sqrt(F.greatest(squared, F.lit(0.0))) - F.col("radius")).alias("bound"))


def within(found: DataFrame, limit: DataFrame) -> DataFrame:
    """Those of (query_id, bound, ...) that may hold a row as near as the query's limit."""
    return found.join(limit, "query_id", "left").where(F.col("limit").isNull() | (F.col("bound") <= F.col("limit") + MARGIN)).drop("limit")


def limits(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, limit): the distance of the k-th best hit, of the queries that have so many."""
    last = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
    return last.select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score") + 2e-9, F.lit(0.0))).alias("limit"))


def exact(index: Index, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank), as ``search.flat`` gives them; (query_id, compared, pruned): rows that a query was compared with, and that it was not).
    ``queries`` are (query_id, vector), one row for each."""
    asked = materialize(queries.where(F.col("vector").isNotNull() & (V.norm(F.col("vector")) > 0)).select("query_id", "vector"), "search-queries")
    hits = limit = None

    def opened(pairs: DataFrame) -> DataFrame:
        """The k best rows of the leaves of (query_id, leaf)."""
        return V.block_topk(index.rows, pairs.join(asked, "query_id").select("query_id", "vector", "leaf"), k, by="leaf").drop("rank")

    # one leaf for each query: the best child of the best child
    best = asked.select("query_id", F.lit("").alias("parent"))
    first_down = Window.partitionBy("query_id").orderBy("bound", "node")
    for level in index.levels:
        best = bounds(level, best, asked).withColumn("place", F.row_number().over(first_down)).where("place = 1").select("query_id", F.col("node").alias("parent"))
    seen = materialize(best.select("query_id", F.col("parent").alias("leaf")), "search-seen")
    hits = materialize(V.ranked(opened(seen), ["query_id"], k), "search-hits")
    limit = limits(hits, k)
    # all leaves that are not ruled out by then
    open_ = asked.select("query_id", F.lit("").alias("parent"))
    for level in index.levels:
        open_ = within(bounds(level, open_, asked), limit).select("query_id", F.col("node").alias("parent"), "bound")
    rest = materialize(open_.withColumnRenamed("parent", "leaf").join(seen, ["query_id", "leaf"], "left_anti"), "search-leaves")
    take = 1
    while not rest.isEmpty():
        chosen = materialize(rest.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("bound", "leaf"))).where(F.col("place") <= take).select("query_id", "leaf"), "search-chosen")
        hits = materialize(V.ranked(opened(chosen).unionByName(hits.drop("rank")), ["query_id"], k), "search-hits")
        seen = materialize(seen.unionByName(chosen), "search-seen")
        rest = materialize(within(rest.join(chosen, ["query_id", "leaf"], "left_anti"), limits(hits, k)), "search-leaves")
        take *= 2
    leaves = index.levels[-1].select(F.col("node").alias("leaf"), "rows")
    total = leaves.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]  # one number
    compared = asked.select("query_id").join(seen.join(leaves, "leaf").groupBy("query_id").agg(F.sum("rows").alias("compared")), "query_id", "left")
    counts = compared.select("query_id", F.coalesce("compared", F.lit(0)).alias("compared"), (F.lit(total) - F.coalesce("compared", F.lit(0))).alias("pruned"))
    return hits.select("query_id", "id", "score", "rank"), counts
