"""Retrieval for batches of queries: top-down through the tree, flat, or pruned by clusters.

Node tables have (id, parent_id, vector) and, where titles are searched, title. Scores are cosines in double precision;
nulls and zero vectors do not take part; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import text as X
from docstrata.functions import vectors as V
from docstrata.functions.tables import materialize
from docstrata.operators import nodes as N


@dataclass(frozen=True)
class Limits:
    """How many are kept of each level, for each parent that was hit."""

    documents: int = 3
    sections: int = 2
    subsections: int = 2
    subsubsections: int = 2
    chunks: int = 3


def best_children(hits: DataFrame, nodes: DataFrame, k: int, named: str | None = None) -> DataFrame:
    """The k best children of each (query, hit): (query_id, parent_id, id, score, rank), the nodes' other columns, and those
    of ``hits(query_id, id, query, ...)``: the query's vector travels with its hits, and so do the ids of all that is
    above, each as ``named``.

    ``hits`` are few for each query, so one equi-join on the parent finds the candidates before any score is computed."""
    more = [c for c in hits.columns if c not in ("query_id", "id", "score", "rank", "parent_id")]
    above = hits.select("query_id", F.col("id").alias("parent_id"), *more, *([F.col("id").alias(named)] if named else []))
    scored = nodes.join(above, "parent_id").withColumn("score", V.cosine(F.col("vector"), F.col("query")))
    return V.ranked(scored.where("score is not null").drop("vector"), ["query_id", "parent_id"], k)


def discover(scopes: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """Documents by their nearest scope sections: (query_id, id, score, rank); ``scopes(id, vector)`` has documents' ids."""
    return V.block_topk(scopes, queries, k)


def search_sections(hits: DataFrame, sections: DataFrame, k: int = 2, exclude: bool = True) -> DataFrame:
    """Nearest sections of each document hit, boilerplate left out where sections have titles."""
    usable = sections.where(~N.boilerplate(F.col("title"))) if exclude and "title" in sections.columns else sections
    return best_children(hits, usable, k, "parent_document")


def hierarchical(queries: DataFrame, scopes: DataFrame, sections: DataFrame, subsections: DataFrame, subsubsections: DataFrame, chunks: DataFrame, limits: Limits = Limits()) -> dict[str, DataFrame]:
    """Five frames of hits, each with its parents' ids: documents, sections, subsections, subsubsections, chunks. Hits of
    subsections, which two levels start from, are stored."""
    documents = discover(scopes, queries, limits.documents)
    asked = documents.join(queries.select("query_id", F.col("vector").alias("query")), "query_id")
    first = search_sections(asked, sections, limits.sections)
    second = materialize(best_children(first, subsections, limits.subsections, "parent_section"), "subsections")
    third = best_children(second, subsubsections, limits.subsubsections, "parent_subsection")
    direct = second.withColumn("parent_subsection", F.col("id")).withColumn("parent_subsubsection", F.lit(None).cast(third.schema["id"].dataType))
    named = ["query_id", "id", "query", "parent_document", "parent_section", "parent_subsection", "parent_subsubsection"]
    containers = direct.select(named).unionByName(third.withColumn("parent_subsubsection", F.col("id")).select(named))
    found = {"documents": documents, "sections": first, "subsections": second, "subsubsections": N.chunk_counts(third, chunks), "chunks": best_children(containers, chunks, limits.chunks)}
    return {level: f.drop("query") for level, f in found.items()}


def flat(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Nearest chunks among all."""
    return V.block_topk(chunks, queries, k)


def cluster_pruned(chunks: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 10, n_probe: int = 2, cluster: str = "cluster") -> DataFrame:
    """Nearest chunks in the ``n_probe`` clusters whose centroids are nearest to the query; a partition filter where
    chunks are stored by cluster."""
    scored = V.block_topk(centroids.withColumnRenamed(cluster, "id"), queries, n_probe)
    probed = scored.select("query_id", F.col("id").cast(chunks.schema[cluster].dataType).alias(cluster))
    return V.block_topk(chunks, probed.join(queries.select("query_id", "vector"), "query_id"), k, by=cluster)


def overlap(a: Column, b: Column) -> Column:
    """Share of common words (lower case) among all words of two texts."""
    x, y = (F.array_distinct(X.tokens(F.lower(c))) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def rerank(candidates: DataFrame, k: int, weight: float = 0.5, question: str = "question", text: str = "content") -> DataFrame:
    """Candidates(query_id, id, score, question, content) by a blend of their score and the overlap with the question."""
    own = overlap(F.col(question), F.col(text))
    blended = candidates.withColumn("overlap", own).withColumn("score", (1 - weight) * F.col("score") + weight * F.col("overlap"))
    return V.ranked(blended.drop("rank"), ["query_id"], k)


def overlap_topk(texts: DataFrame, questions: DataFrame, k: int, block: int = 512) -> DataFrame:
    """(query_id, id, overlap): the k texts(id, content) with the largest ``overlap`` with each of questions(query_id, question),
    ties to the smaller id, among all texts. Blocks of questions meet blocks of texts by key; a pair counts common words as sums of
    rows of a matrix (word of a question, question), and k texts of it for each question go on."""
    words = lambda c: F.array_distinct(X.tokens(F.lower(c)))
    rows = texts.select("id", words(F.col("content")).alias("words"))
    asked = questions.select(F.col("query_id").alias("id"), words(F.col("question")).alias("words"))
    q, c = max(1, -(-asked.count() // block)), max(1, -(-rows.count() // (8 * block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.withColumn("c", part(c)).withColumn("q", every(q)).groupBy("c", "q")
    right = asked.withColumn("q", part(q)).withColumn("c", every(c)).groupBy("c", "q")
    schema = T.StructType([T.StructField("query_id", asked.schema["id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("overlap", T.DoubleType())])

    def common(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "id": [], "overlap": []})
        known: dict[str, int] = {}
        pairs = [(known.setdefault(w, len(known)), i) for i, ws in enumerate(b["words"]) for w in (() if ws is None else ws)]
        of = np.zeros((len(known) + 1, len(b)))
        if pairs:
            of[tuple(np.array(pairs).T)] = 1
        a = a.sort_values("id", kind="stable")
        sizes = np.array([0 if ws is None else len(ws) for ws in a["words"]])
        count = np.zeros((len(a), len(b)))
        for i, ws in enumerate(a["words"]):
            count[i] = of[[known[w] for w in (() if ws is None else ws) if w in known]].sum(axis=0)
        union = sizes[:, None] + of.sum(axis=0)[None, :] - count
        share = np.divide(count, union, out=np.zeros_like(count), where=union > 0)
        best = np.argsort(-np.round(share, 9), axis=0, kind="stable")[:k]
        return pd.DataFrame({"query_id": b["id"].to_numpy()[np.repeat(np.arange(len(b)), len(best))], "id": a["id"].to_numpy()[best.T.ravel()], "overlap": np.take_along_axis(share, best, axis=0).T.ravel()})

    found = left.cogroup(right).applyInPandas(common, schema)
    return V.ranked(found, ["query_id"], k, score="overlap").drop("rank")


def context(chunks: DataFrame, cut: int = 300) -> DataFrame:
    """(query_id, context): the hits in rank order, each with its names and the first ``cut`` characters."""
    line = F.format_string("[%s] %s / %s / %s: %s", F.col("rank").cast("string"), "document", "section", "subsection", X.truncated(F.col("content"), cut))
    return chunks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def result_counts(found: dict[str, DataFrame]) -> DataFrame:
    """Hits of each query on each level, a column for a level."""
    rows = None
    for level, f in found.items():
        one = f.select("query_id", F.lit(level).alias("level"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("query_id").pivot("level", list(found)).count().fillna(0)


def nested_results(found: dict[str, DataFrame]) -> DataFrame:
    """(query_id, result): all hits of a query as one JSON object of five lists."""
    out = None
    for level, f in found.items():
        fields = [c for c in f.columns if c not in ("query_id", "vector")]
        one = f.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in fields if c != "rank")))).alias(level))
        out = one if out is None else out.join(one, "query_id", "left")
    return out.select("query_id", F.to_json(F.struct(*(F.col(level) for level in found))).alias("result"))

