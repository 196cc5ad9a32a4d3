"""Node tables: documents, sections, subsections, subsubsections and chunks with deterministic ids and parent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions import text as X

LEVELS = ("document", "section", "subsection", "subsubsection", "chunk")


def node_id(*path: Column | str) -> Column:
    """An id that a retry computes again: a hash of the path."""
    return F.sha2(F.concat_ws("/", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in path)), 256)


def text_or_struct(value: Column, field: str) -> tuple[Column, Column]:
    """(text, vector) of a VARIANT that is a string or {field, embedding}; "" and null for anything else."""
    kind = F.schema_of_variant(value)
    plain = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(F.startswith(kind, F.lit("OBJECT")), F.try_variant_get(value, f"$.{field}", "string"))
    vector = F.when(F.startswith(kind, F.lit("OBJECT")), F.try_variant_get(value, "$.embedding", "array<float>"))
    return F.coalesce(plain, F.lit("")), vector


def first_vector(*vectors: Column) -> Column:
    """The first vector that is there and not empty."""
    return F.coalesce(*(F.when(F.size(v) > 0, v) for v in vectors))


def section_vector(title: Column, description: Column) -> Column:
    return first_vector(description, title)


def subsection_vector(title: Column, description: Column) -> Column:
    return first_vector(title, description)


def chunk_text(chunk: Column, content: Column) -> Column:
    return F.coalesce(chunk, content, F.lit(""))


def is_scope(title: Column) -> Column:
    return F.contains(title, F.lit("\tScope"))


def load(documents: DataFrame) -> dict[str, DataFrame]:
    """The five node tables from documents(document_name, content) whose titles and descriptions are
    {title | description, embedding} and whose chunks are {chunk, embedding}: ids, parents' ids, and the texts that the
    level has (title, description, summary, text_content), null where the documents have no such field."""
    name = F.col("document_name")
    sections = documents.select(name, F.posexplode("content").alias("i", "n"))
    subs = sections.select("document_name", "i", F.posexplode("n.subsections").alias("j", "n"))
    id1, id2 = node_id("document_name", "i"), node_id("document_name", "i", "j")

    def texts(nodes: DataFrame, *fields: str) -> list[Column]:
        there = nodes.schema["n"].dataType.names
        nested = lambda f: F.col(f"n.{f}.{f}") if f in ("title", "description") else F.col(f"n.{f}")
        return [(nested(f) if f in there else F.lit(None).cast("string")).alias(f) for f in fields]

    def vector(nodes: DataFrame, field: str) -> Column:
        return F.col(f"n.{field}.embedding") if field in nodes.schema["n"].dataType.names else F.lit(None).cast("array<float>")

    def chunks_of(nodes: DataFrame, id: Column, level: str) -> DataFrame:
        return nodes.select(id.alias("parent_id"), F.lit(level).alias("parent_level"), F.posexplode("n.chunks").alias("k", "c"))

    section = sections.select(id1.alias("id"), node_id("document_name").alias("parent_id"), "i", *texts(sections, "title", "description", "summary"), section_vector(vector(sections, "title"), vector(sections, "description")).alias("vector"))
    subsection = subs.select(id2.alias("id"), id1.alias("parent_id"), *texts(subs, "title", "description", "summary", "text_content"), subsection_vector(vector(subs, "title"), vector(subs, "description")).alias("vector"))
    tables = {"section": section.drop("i"), "subsection": subsection}
    chunks = [chunks_of(subs, id2, "subsection")] if "chunks" in subs.schema["n"].dataType.names else []
    if "subsubsections" in subs.schema["n"].dataType.names:
        thirds = subs.select("document_name", "i", "j", F.posexplode("n.subsubsections").alias("l", "n"))
        id3 = node_id("document_name", "i", "j", "l")
        tables["subsubsection"] = thirds.select(id3.alias("id"), id2.alias("parent_id"), *texts(thirds, "title", "text_content"), vector(thirds, "title").alias("vector"))
        if "chunks" in thirds.schema["n"].dataType.names:
            chunks.append(chunks_of(thirds, id3, "subsubsection"))
    if chunks:
        every = chunks[0] if len(chunks) == 1 else chunks[0].unionByName(chunks[1])
        tables["chunk"] = every.select(node_id("parent_id", F.lit("chunks"), "k").alias("id"), "parent_id", "parent_level", F.col("c.chunk").alias("content"), F.col("c.embedding").alias("vector"))
    tables["document"] = documents.select(node_id("document_name").alias("id"), name).join(scope(section), F.col("id") == F.col("doc"), "left").drop("doc")
    return tables


def scope(sections: DataFrame, doc: str = "parent_id", order: str = "i") -> DataFrame:
    """(doc, scope, vector): the description and vector of each document's first scope section."""
    first = F.min_by(F.struct(F.col("description").alias("scope"), "vector"), order)
    return sections.where(is_scope(F.col("title"))).groupBy(F.col(doc).alias("doc")).agg(first.alias("s")).select("doc", "s.*")


def children(parents: DataFrame, nodes: DataFrame, parent_id: str = "id") -> DataFrame:
    """``nodes`` of the given parents, with the parents' columns named parent_*; parents without children drop out."""
    named = parents.select(*(F.col(c).alias(f"parent_{c}" if c != parent_id else "parent_id") for c in parents.columns))
    return nodes.join(named, "parent_id")


def restricted(nodes: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """``nodes`` whose id is among ``ids``; no ids, no nodes."""
    return nodes.join(ids.select(F.col(ids.columns[0]).alias(id)).distinct(), id, "left_semi")


def by_name(documents: DataFrame, names: DataFrame, name: str = "document_name", id: str = "id") -> DataFrame:
    """One document for each of ``names``: of equal names the one of lowest id; names that are missing drop out."""
    lowest = documents.groupBy(name).agg(F.min(id).alias(id))
    return documents.join(lowest, [name, id], "left_semi").dropDuplicates([name, id]).join(names.select(name).distinct(), name, "left_semi")


def by_title(sections: DataFrame, wanted: DataFrame, doc: str = "doc_id", title: str = "title", id: str = "id") -> DataFrame:
    """The first section of each (document, title) in ``wanted``; joined on both, as titles repeat in all documents."""
    first = Window.partitionBy(doc, title).orderBy(id)
    return sections.join(wanted.select(doc, title).distinct(), [doc, title], "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def orphan_chunks(chunks: DataFrame, *parents: DataFrame) -> DataFrame:
    """Chunks whose parent is in none of the tables."""
    for p in parents:
        chunks = chunks.join(p.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    return chunks


def levels_together(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables in one listing, with their level."""
    out = None
    for level, t in tables.items():
        named = t.withColumn("level", F.lit(level))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def boilerplate(title: Column, excluded: tuple[str, ...] = ("\tScope", "\tReferences", "Introduction", "Foreword")) -> Column:
    """Empty titles and those that contain one of ``excluded``."""
    found = F.length(F.coalesce(title, F.lit(""))) == 0
    for x in excluded:
        found = found | F.contains(title, F.lit(x))
    return F.coalesce(found, F.lit(True))


def chunk_counts(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``parents`` with chunk_count, 0 where there are none."""
    counts = chunks.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    return parents.join(counts, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def sampled(nodes: DataFrame, k: int = 3, cut: int = 50, by: str = "level", id: str = "id") -> DataFrame:
    """The first k nodes of each level, long strings cut."""
    first = nodes.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(id))).where(F.col("rank") <= k)
    return first.select(*(X.truncated(F.col(c), cut).alias(c) if t == "string" and c != by else F.col(c) for c, t in first.dtypes))
