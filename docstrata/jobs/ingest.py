"""From DOCX blocks to stored, clustered nodes; and the flat twin from Markdown files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.functions.tables import materialize
from docstrata.operators import chunking, clustering, embedding, nodes, stats, structure
from docstrata.sources import writers

Encoder = Callable[[DataFrame], DataFrame]


def build_tree(blocks: DataFrame, describe: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, tables, figures) of blocks(doc_id, pos, kind, style, text, images); ``describe`` adds ``description`` to
    figures, the caption by default, and descriptions take the places of figures in the texts."""
    placed = structure.assign(structure.with_headings(blocks))
    figures = structure.figures(placed)
    described = describe(structure.figure_prompts(figures)) if describe else figures.withColumn("description", F.col("figure_name"))
    # a figure's block shows its placeholder in the text
    marks = figures.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image_pos", "placeholder"))), lambda x: x["placeholder"]), "").alias("_marks"))
    marked = placed.join(marks, ["doc_id", "pos"], "left").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.coalesce("_marks", F.lit("")))).drop("_marks")
    texts = structure.write_back(structure.node_text(marked), described)
    return texts, structure.table_entries(placed), figures


def embed_tree(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """``flatten``'s rows with vectors; each distinct text is encoded once."""
    return embedding.encode_distinct(embedding.embeddable(texts), encoder)


def ingest(blocks: DataFrame, encoder: Encoder, path: str, clusters: int = 5) -> dict[str, int]:
    """Blocks to node tables at ``path``, a folder for each level with a cluster for each node; rows written of each."""
    tree, tables, figures = build_tree(blocks)
    nested = structure.assemble(chunking.tree_chunks(tree), tables=tables, figures=figures)
    documents = materialize(nested.select(F.col("doc_id").cast("string").alias("document_name"), "content"), "documents")
    texts = materialize(structure.flatten(documents), "texts")
    vectors = embed_tree(texts, encoder)
    nested = materialize(structure.renest(vectors, documents), "embedded")
    written = {}
    for level, table in nodes.load(nested).items():
        if level == "document" or "vector" not in table.columns:
            written[level] = writers.store(table, f"{path}/{level}")
            continue
        labels = clustering.per_parent(table, clusters)
        written[level] = writers.store(table.join(labels.withColumnRenamed("cluster", "cluster_id"), ["id", "parent_id"], "left"), f"{path}/{level}")
    return written


def flat_baseline(files: DataFrame, encoder: Encoder, path: str, l1: int = 50, l2: int = 10, l3: int = 10) -> DataFrame:
    """Whole files to numbered, clustered chunks at ``path``, stored by first-level cluster; returns the statistics of
    chunks per file."""
    chunks = chunking.numbered(chunking.flat_chunks(files))
    encoded = materialize(embedding.encode_distinct(chunks.withColumnRenamed("chunk", "text"), encoder).withColumn("id", F.col("chunk_number")), "flat")
    labels = clustering.three_levels(encoded.select("id", "vector"), l1, l2, l3).drop("vector")
    out = encoded.join(labels, "id").select(F.col("text").alias("content"), "source_file", "chunk_number", "cluster_l1", "cluster_l2", "cluster_l3", F.size("vector").alias("embedding_dimension"), F.col("vector").alias("embedding"))
    writers.store(out, path, ("cluster_l1",))
    return stats.chunk_distribution(stats.counts_by(encoded, "source_file"))
