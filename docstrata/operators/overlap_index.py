"""Texts with the largest word overlap, through an inverted index with bounds for its blocks.

The overlap of two texts is the share of common words among all their words. The index has a posting for each word and text, in blocks by
the size of the text; a table of the blocks says how many postings each has and its smallest size. A query reads its words from rare
to frequent, twice as many in each round, and computes the exact overlap of every text it meets. A text that has none of the words read so far
has at most the r that are left in common, so at most r / (n + size - r) of n words of the query: once k texts have more than any block could still offer,
the block is not read, and once none is left the query is done. The result is that of comparing everything.

Cases: texts and queries without words overlap with nothing; where fewer than k texts have a common word, those of the smallest ids
fill up with 0; ties go to the smaller id; words that occur nowhere count among the query's words; repeated ids of texts are a text each, whose words count together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import text as X
from docstrata.functions import vectors as V
from docstrata.functions.tables import materialize

MARGIN = 1e-8


@dataclass
class Index:
    """``texts``: (id, words); ``postings``: (word, block, id); ``blocks``: (word, block, n, least size)."""

    texts: DataFrame
    postings: DataFrame
    blocks: DataFrame


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_distinct(X.tokens(F.lower(text))), F.array().cast("array<string>"))


def build(texts: DataFrame, id: str = "id", text: str = "content") -> Index:
    """The index of texts(id, content); blocks hold texts whose sizes differ by a fifth at most."""
    known = texts.select(F.col(id).alias("id"), words_of(F.col(text)).alias("words"))
    known = materialize(known.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")), "overlap-texts")
    size = F.size("words")
    postings = known.where(size > 0).select(F.explode("words").alias("word"), F.floor(4 * F.log2(size)).cast("int").alias("block"), "id", size.alias("size"))
    postings = materialize(postings, "postings")
    blocks = materialize(postings.groupBy("word", "block").agg(F.count("*").alias("n"), F.min("size").alias("least")), "posting-blocks")
    return Index(known, postings.select("word", "block", "id"), blocks)


def search(index: Index, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, overlap) of the k texts of largest overlap for each of questions(query_id, question), ids once each;
    (query_id, read, postings): postings that were read for it, and all that its words have)."""
    asked = questions.select("query_id", words_of(F.col("question")).alias("asked")).withColumn("n", F.size("asked"))
    asked = materialize(asked, "overlap-queries")
    each = asked.select("query_id", "n", F.explode("asked").alias("word"))
    frequency = index.blocks.groupBy("word").agg(F.sum("n").alias("df"))
    rare_first = Window.partitionBy("query_id").orderBy("df", "word")
    each = each.join(frequency, "word").withColumn("place", F.row_number().over(rare_first)).withColumn("there", F.count("*").over(Window.partitionBy("query_id")))
    each = materialize(each, "overlap-words")
    kind = index.texts.schema["id"].dataType
    hits = asked.select("query_id", F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("overlap")).limit(0)
    met, read = hits.select("query_id", "id"), []
    done, upto = 0, 1
    limit = hits.groupBy("query_id").agg(F.min("overlap").alias("least"))
    while True:
        # a text not met yet has no word before ``done``, so ``left`` words in common at most
        open_ = each.where(F.col("place") > done).join(limit, "query_id", "left").withColumn("left", F.col("there") - done)
        open_ = open_.where(F.col("least").isNull() | (F.col("left") / F.col("n") + MARGIN >= F.col("least")))
        best = F.col("left") / (F.col("n") + F.greatest(F.col("least_size") - F.col("left"), F.lit(0)))
        now = open_.where(F.col("place") <= upto).join(index.blocks.withColumnRenamed("n", "held").withColumnRenamed("least", "least_size"), "word")
        now = materialize(now.where(F.col("least").isNull() | (best + MARGIN >= F.col("least"))).select("query_id", "word", "block", "held"), "overlap-blocks")
        if now.isEmpty() and open_.where(F.col("place") > upto).isEmpty():
            break
        read.append(now.groupBy("query_id").agg(F.sum("held").alias("read")))
        new = materialize(now.join(index.postings, ["word", "block"]).select("query_id", "id").distinct().join(met, ["query_id", "id"], "left_anti"), "overlap-met")
        common = F.size(F.array_intersect("asked", "words"))
        scored = new.join(index.texts, "id").join(asked, "query_id").select("query_id", "id", (common / (F.col("n") + F.size("words") - common)).alias("overlap"))
        hits = materialize(V.ranked(scored.unionByName(hits), ["query_id"], k, score="overlap").drop("rank"), "overlap-hits")
        met = met.unionByName(new)
        limit = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("overlap").alias("least")).where(F.col("hits") == k).select("query_id", "least")
        done, upto = upto, 2 * upto
    first = [F.lit(r.id) for r in index.texts.select("id").orderBy("id").limit(2 * k).collect()]  # of 2 k texts k are no hits where a query has fewer than k
    short = asked.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("hits")), "query_id", "left").where(F.coalesce("hits", F.lit(0)) < k).select("query_id")
    fill = short.select("query_id", F.explode(F.array(*first).cast(T.ArrayType(kind))).alias("id")).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("overlap", F.lit(0.0))
    whole = V.ranked(hits.unionByName(fill.select("query_id", "id", "overlap")), ["query_id"], k, score="overlap").drop("rank")
    every = asked.select("query_id", F.lit(0).cast("long").alias("read"))
    for r in read:
        every = every.unionByName(r)
    counts = every.groupBy("query_id").agg(F.sum("read").alias("read")).join(each.groupBy("query_id").agg(F.sum("df").alias("postings")), "query_id", "left")
    return whole, counts.select("query_id", "read", F.coalesce("postings", F.lit(0)).alias("postings"))
