"""Vectors for texts: a pluggable encoder in batches, and a hashing encoder for where there is no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import text as X

MAX_TOKENS = 2048
PLACEHOLDER_WIDTH = 10
#: Rows whose texts are Python's at once.
ROWS = 512


def embeddable(texts: DataFrame) -> DataFrame:
    """Rows of ``flatten`` that get a vector: text is there, and no chunk is the literal "..."."""
    return texts.where(X.is_truthy(F.col("text")) & ~((F.col("kind") == "chunk") & (F.col("text") == "...")))


def encode(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64, max_tokens: int = MAX_TOKENS, parts: int | None = None, text: str = "text", vector: str = "vector") -> DataFrame:
    """``texts`` with a vector each. ``load()`` runs once in each Python worker and returns ``encode(list of texts)``;
    texts are cut to ``max_tokens`` words and encoded in batches of similar length."""
    rows = texts.repartition(parts) if parts else texts
    rows = rows.withColumn("_cut", X.first_tokens(F.col(text), max_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):  # the texts of so many rows are Python's, the rest stays Arrow's
                part = whole.slice(first, ROWS)
                cut = part.column(len(texts_columns)).to_pylist()
                order = sorted(range(len(cut)), key=lambda i: float("inf") if cut[i] is None else len(cut[i]))  # noqa: B023
                out: list = [None] * len(cut)
                for a in range(0, len(order), batch):
                    chosen = order[a : a + batch]
                    for i, v in zip(chosen, model([cut[j] for j in chosen]), strict=True):
                        out[i] = np.asarray(v, np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.list_(pa.float32()))], names=[*texts_columns, vector])

    texts_columns = texts.columns
    return rows.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))]))


def word_chunks(texts: DataFrame, n: int = MAX_TOKENS, text: str = "text") -> DataFrame:
    """``texts`` with ``chunk_idx`` and ``chunk``: every word of a text once, in runs of n; texts without words have one empty chunk."""
    words = texts.withColumn("_words", F.explode(F.array(F.coalesce(X.tokens(F.col(text)), F.array().cast("array<string>")))))  # split once
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_words") - 1) / n).cast("int")))
    return words.select(*texts.columns, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("_words", i * n + 1, n), " "))).alias("chunk_idx", "chunk"))


def encode_distinct(texts: DataFrame, encoder: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``texts`` with vectors, each distinct text encoded once: ``encoder`` sees a frame of the one column ``text``."""
    vectors = encoder(texts.select(text).where(F.col(text).isNotNull()).distinct())
    return texts.join(vectors, text, "left").select(*texts.columns, *(c for c in vectors.columns if c != text))


def hashed_vectors(texts: DataFrame, width: int = 256, text: str = "text", vector: str = "vector") -> DataFrame:
    """A vector of unit length from hashed words, weighted by their rarity; JVM only."""
    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+").transform(texts.withColumn("_t", F.coalesce(F.col(text), F.lit(""))))
    counts = HashingTF(inputCol="_w", outputCol="_c", numFeatures=width).transform(words)
    weighted = IDF(inputCol="_c", outputCol="_i").fit(counts).transform(counts)
    unit = Normalizer(inputCol="_i", outputCol="_u").transform(weighted)
    return unit.withColumn(vector, vector_to_array("_u", "float32")).drop("_t", "_w", "_c", "_i", "_u")


def width(vector: Column) -> Column:
    """Components of a vector; null for null."""
    return F.when(vector.isNotNull(), F.size(vector))


def placeholder(vector: Column, valid: Column) -> Column:
    """The vector where ``valid``, else ten zeros."""
    return F.when(valid, vector).otherwise(F.array_repeat(F.lit(0.0), PLACEHOLDER_WIDTH).cast("array<float>"))


def vector_issues(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """``vectors`` with ``issue``: "missing", "not finite", "width" (other than the most common one), or null."""
    usual = vectors.agg(F.mode(F.size(vector)).alias("_usual"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    issue = F.when(F.col(vector).isNull() | (F.size(vector) == 0), "missing").when(odd, "not finite").when(F.size(vector) != F.col("_usual"), "width")
    return vectors.join(F.broadcast(usual)).withColumn("issue", issue).drop("_usual")  # one row
