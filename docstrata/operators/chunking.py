"""Splitting texts into overlapping chunks, counting tokens, numbering chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import text as X
from docstrata.functions.tables import materialize

#: Separators from coarse to fine ("" is characters); sizes and overlaps of the tree and of flat files.
SEPARATORS = ("\n\n", "\n", " ", "")
TREE, FLAT = (2048, 200), (1024, 100)


def word_count(text: str) -> int:
    return len(text.split())


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, length: Callable[[str], int] = word_count) -> list[str]:
    """Chunks of at most ``size``, in order; neighbours share up to ``overlap``.

    The text is cut at the first separator that occurs in it, each separator staying at the head of what follows; pieces that
    are too long are cut at the finer ones. Pieces are packed from the left; when one does not fit, the chunk is
    emitted and loses pieces from its front until what stays is within the overlap and leaves room for the next. A piece
    that cannot be cut stays whole. Chunks are stripped, empty ones left out."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def pieces(part: str, ahead: tuple[str, ...]) -> Iterator[str]:
        at = next((i for i, s in enumerate(ahead) if s in part), None)
        if at is None:
            yield part
            return
        cuts = list(part) if not ahead[at] else [p for p in re.split(f"(?={re.escape(ahead[at])})", part) if p]
        for p in cuts:
            if length(p) > size and ahead[at + 1 :] and len(p) > 1:
                yield from pieces(p, ahead[at + 1 :])
            else:
                yield p

    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for piece in pieces(text, separators):
        n = length(piece)
        if held and total + n > size:
            chunks.append("".join(p for p, _ in held))
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    chunks.append("".join(p for p, _ in held))
    return [c for c in map(str.strip, chunks) if c]


def recursive_chunks(docs: DataFrame, size: int, overlap: int, text: str = "text", separators: tuple[str, ...] = SEPARATORS, length: Callable[[str], int] = word_count) -> DataFrame:
    """``docs`` without ``text``, a row for each chunk: chunk_idx, chunk, n_tokens. Blank texts have no chunks."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    keep = [c for c in docs.columns if c != text]
    fields = [*(docs.schema[c] for c in keep), T.StructField("chunk_idx", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("n_tokens", T.IntegerType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                part = pdf.iloc[a : a + 200]
                found = [split_text(t or "", size, overlap, separators, length) if isinstance(t, str) and t.strip() else [] for t in part[text]]
                out = part[keep].loc[part.index.repeat([len(f) for f in found])].reset_index(drop=True)
                out["chunk_idx"] = pd.Series([i for f in found for i in range(len(f))], dtype="int32")
                out["chunk"] = pd.Series([c for f in found for c in f], dtype="object")
                out["n_tokens"] = pd.Series([length(c) for f in found for c in f], dtype="int32")
                yield out

    return docs.where(~X.is_blank(F.col(text))).mapInPandas(run, T.StructType(fields))


@F.udtf(returnType="chunk_idx int, chunk string")
class SplitText:
    """The splitter as a table function: ``LATERAL split_text(text, size, overlap)`` in SQL, once it is registered."""

    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(split_text(text, size, overlap) if text else [])


def register_split_text(spark: SparkSession) -> None:
    spark.udtf.register("split_text", SplitText)


def character_windows(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """The splitter with characters as pieces: windows of ``size`` that start every ``size - overlap``; no Python."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    last = F.greatest(F.length(text) - overlap, F.lit(1)) - 1
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    windows = F.transform(starts, lambda i: F.substring(F.col(text), i + 1, F.lit(size)))
    keep = [c for c in docs.columns if c != text]
    return docs.where(F.length(text) > 0).select(*keep, F.posexplode(windows).alias("chunk_idx", "chunk"))


def tree_chunks(nodes: DataFrame, size: int = TREE[0], overlap: int = TREE[1], length: Callable[[str], int] = word_count) -> DataFrame:
    """``node_text``'s rows with an array ``chunks``: the texts of subsections and subsubsections are split, those of
    sections are not."""
    keys = ["doc_id", "section_idx", "subsection_idx", "subsubsection_idx"]
    below = nodes.where("level > 1").select(*keys, X.clean_nbsp(F.col("text")).alias("text"))
    split = recursive_chunks(below, size, overlap, length=length).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    return nodes.join(split, keys, "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


def flat_chunks(files: DataFrame, size: int = FLAT[0], overlap: int = FLAT[1], length: Callable[[str], int] = word_count) -> DataFrame:
    """Whole files, whatever their structure; files without chunks drop out."""
    return recursive_chunks(files, size, overlap, length=length)


#: Files whose counts one task adds up, about.
ADDED_TOGETHER = 100_000


def numbered(chunks: DataFrame, file: str = "source_file", idx: str = "chunk_idx") -> DataFrame:
    """``chunk_number``: runs through all chunks in the order (file, idx). Only the counts per file are summed up in
    order, in ranges of files, never the chunks; files are ordered as strings."""
    counts = materialize(chunks.groupBy(file).agg(F.count("*").alias("_n")).withColumn("_name", F.col(file).cast("string")), "file-counts")
    parts = max(1, -(-counts.count() // ADDED_TOGETHER))
    ranges = materialize(counts.repartitionByRange(parts, "_name").withColumn("_range", F.spark_partition_id()), "counts")
    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("_range").agg(F.sum("_n").alias("_sum")).withColumn("_before", before("_sum", Window.orderBy("_range"))).select("_range", "_before")  # a row for each range
    offsets = ranges.withColumn("_offset", before("_n", Window.partitionBy("_range").orderBy("_name"))).join(starts, "_range").select(file, (F.col("_offset") + F.col("_before")).alias("_offset"))
    return chunks.join(offsets, file).withColumn("chunk_number", (F.col("_offset") + F.col(idx)).cast("long")).drop("_offset")
