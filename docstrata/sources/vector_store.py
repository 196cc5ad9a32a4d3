"""Vectors kept between runs, by the content of their texts: a run encodes only what no run before it has.

A vector's key is the SHA-256 of its text. A run first notes the keys that it refers to, then asks a Bloom filter which of these the store
may hold: the filter is a table, a row for each block of eight words of 32 bits, in which a key sets one bit a word, so it is made by
``bit_or``, added to by more rows, and asked by an equi-join on the block. Only keys that pass are looked up among the stored keys; the
others, and those not found there, are encoded once each and added. Files are listed by the manifests of ``versioned``.

``forget`` drops a run's references from the manifest, ``collected`` deletes the vectors without any, in the buckets that hold such, and builds the filter
anew. A collection that meets commits newer than those it read starts again, so a run never loses a vector it refers to.

Cases: null texts have no vector and aren't encoded; the empty text is a text; repeated texts are encoded once; a vector may be null, which is
kept as such; runs of the same name add up; two runs at once may both encode a new text, then the older vector counts; an empty store, or
no texts, give empty frames. One store is for one encoder. Columns ``_digest`` and ``_bucket`` and that of the vector are replaced.

Bounds: the driver sees manifests, counts and numbers of buckets. A filter with more keys than it was made for lets more of them through to the
lookup; results stay the same."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions.tables import materialize
from docstrata.sources import versioned

WORDS, BITS_A_KEY = 8, 10.5  # about one false hit in a hundred
RUN = "run"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def blocks_for(keys: int) -> int:
    return max(1, math.ceil(keys * BITS_A_KEY / (32 * WORDS)))


def masks(key: Column) -> list[Column]:
    """A word with one bit set, for each word of a key's block."""
    bits = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def filter_rows(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of keys(digest)."""
    marked = keys.select(block_of(F.col("digest"), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks(F.col("digest")))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def maybe_held(keys: DataFrame, held: DataFrame, blocks: int) -> DataFrame:
    """keys(digest, ...) with ``maybe``: false only for keys that the filter ``held`` has not seen."""
    merged = held.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
    asked = keys.withColumn("block", block_of(F.col("digest"), blocks)).join(merged, "block", "left")
    hit = F.lit(True)
    for i, m in enumerate(masks(F.col("digest"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    return asked.select(*keys.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def of_run(manifest: dict, made: list[tuple[str, str, list[int]]], run: str) -> dict:
    """A manifest that says of new commits to which run they belong."""
    names = {commit for _, commit, _ in made}
    manifest["entries"] = [e | {"run": run} if e["commit"] in names else e for e in manifest["entries"]]
    return manifest


@dataclass
class VectorStore:
    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self._files = versioned.Store(self.spark, self.path, "digest")
        self._blocks = versioned.Store(self.spark, self.path, "block")  # the same files, for the filter's key

    def _vectors(self, manifest: dict) -> DataFrame:
        """(bucket, digest, vector), a row for each key."""
        rows = self._files._listed("vectors", manifest)
        return rows.groupBy("bucket", "digest").agg(F.min_by("vector", "_version").alias("vector"))

    def _unseen(self, keys: DataFrame, manifest: dict) -> DataFrame:
        """Those of keys(digest) that the store does not hold."""
        asked = maybe_held(keys, self._files._listed("filter", manifest), manifest["blocks"])
        asked = asked.withColumn("bucket", versioned.bucket(F.col("digest"), manifest["buckets"]))
        stored = self._files._listed("vectors", manifest).select("bucket", "digest")  # keys only are read
        found = asked.where("maybe").join(stored, ["bucket", "digest"], "left_anti")
        return asked.where("NOT maybe").select("digest").unionByName(found.select("digest"))

    def encoded(self, texts: DataFrame, encoder: Callable[[DataFrame], DataFrame], run: str, text: str = "text", vector: str = "vector") -> tuple[DataFrame, int]:
        """(``texts`` with their vectors, how many texts were encoded). ``encoder`` takes a frame of the one column ``text`` and adds
        ``vector``; ``run`` is the name under which the texts are referred to."""
        names = {x.lower() for x in ("_digest", "_bucket", vector)}
        rows = texts.drop(*(c for c in texts.columns if c.lower() in names)).withColumn("_digest", digest(F.col(text)))
        manifest = self._files.manifest()
        wanted = materialize(rows.where(F.col("_digest").isNotNull()).select(F.col("_digest").alias("digest")).distinct(), "wanted")
        made = [self._files._written("references", wanted.withColumn(RUN, F.lit(run)), manifest["buckets"])]
        self._files._change(lambda m: of_run(versioned.with_entries(m, made), made, run))
        manifest = self._files.manifest()  # from here on no collection takes what this run refers to
        unseen = materialize(self._unseen(wanted, manifest), "unseen")
        count = 0
        if not unseen.isEmpty():
            new = rows.select(text, "_digest").join(unseen.withColumnRenamed("digest", "_digest"), "_digest", "left_semi").select(text).distinct()
            seen = Observation()
            fresh = encoder(new).select(digest(F.col(text)).alias("digest"), F.col(vector).cast("array<float>").alias("vector"))
            made = [self._files._written("vectors", fresh.observe(seen, F.count(F.lit(1)).alias("n")), manifest["buckets"])]
            count = seen.get["n"]
            self._add(made, unseen, manifest)
        now = self._files.manifest()
        rows = rows.withColumn("_bucket", versioned.bucket(F.col("_digest"), now["buckets"]))
        found = self._vectors(now).select(F.col("bucket").alias("_bucket"), F.col("digest").alias("_digest"), F.col("vector").alias(vector))
        return rows.join(found, ["_bucket", "_digest"], "left").drop("_bucket", "_digest"), count

    def _add(self, made: list, keys: DataFrame, manifest: dict) -> None:
        """Add vectors with the filter's rows for their keys; if a collection has changed the filter's size meanwhile, with rows of that size."""
        while True:
            blocks = manifest["blocks"]
            held = self._blocks._written("filter", filter_rows(keys, blocks), manifest["buckets"])
            fits = []

            def change(now: dict, blocks: int = blocks, held: tuple = held, fits: list = fits) -> dict:
                fits[:] = [now["blocks"] == blocks]
                return versioned.with_entries(now, [*made, held]) if fits[0] else now

            self._files._change(change)
            if fits[0]:
                return
            manifest = self._files.manifest()

    def references(self) -> DataFrame:
        """(digest, runs): by how many runs each text is referred to."""
        return self._files._listed("references", self._files.manifest()).groupBy("digest").agg(F.count_distinct(RUN).alias("runs"))

    def vectors(self) -> DataFrame:
        """(digest, vector) of all that is stored."""
        return self._vectors(self._files.manifest()).select("digest", "vector")

    def forget(self, run: str) -> None:
        """Drop the references of a run, by the manifest alone; its vectors stay until ``collected``."""
        self._files._change(lambda m: m | {"entries": [e for e in m["entries"] if e.get("run") != run]})

    def collected(self) -> int:
        """Delete the vectors that no run refers to; how many they were."""
        while True:
            m = self._files.manifest()
            live = self._files._listed("references", m).select("digest").distinct()
            dead = materialize(self._files._listed("vectors", m).select("bucket", "digest").distinct().join(live, "digest", "left_anti"), "dead")
            dirty = {r["bucket"]: r["count"] for r in dead.groupBy("bucket").count().collect()}  # at most as many as there are buckets
            if not dirty:
                return 0
            kept = self._vectors(m).join(dead, ["bucket", "digest"], "left_anti").where(F.col("bucket").isin(list(dirty)))
            made = [self._files._written("vectors", kept.select("digest", "vector"), m["buckets"])]
            left = self._files._listed("vectors", m).select("bucket", "digest").distinct().join(dead, ["bucket", "digest"], "left_anti")
            left = materialize(left.select("digest"), "left")
            blocks = blocks_for(max(m["texts"], left.count()))
            made.append(self._blocks._written("filter", filter_rows(left, blocks), m["buckets"]))
            if self._cleaned(m, list(dirty), made, blocks):
                return sum(dirty.values())

    def _cleaned(self, read: dict, buckets: list[int], made: list, blocks: int) -> bool:
        """Publish a collection, unless any commit has come since ``read``."""
        known, done = {e["commit"] for e in read["entries"]}, []

        def change(now: dict) -> dict:
            done[:] = [known == {e["commit"] for e in now["entries"]}]
            if not done[0]:
                return now
            for e in now["entries"]:
                if e["kind"] == "vectors":
                    e["without"] = sorted({*e["without"], *buckets})
            now["entries"] = [e for e in now["entries"] if e["kind"] != "filter" and not set(e["buckets"]) <= set(e["without"])]
            return versioned.with_entries(now, made, version=read["version"]) | {"blocks": blocks}

        self._files._change(change)
        return done[0]


def create(spark: SparkSession, path: str, texts: int = 1_000_000, buckets: int = 64) -> VectorStore:
    """A new, empty store. ``texts`` is about how many it will hold: it sets the filter's size until a collection finds more."""
    key, vector = T.StructField("digest", T.BinaryType()), T.StructField("vector", T.ArrayType(T.FloatType()))
    words = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(f"w{i}", T.IntegerType()) for i in range(WORDS))])
    schemas = {"vectors": T.StructType([key, vector]), "references": T.StructType([key, T.StructField(RUN, T.StringType())]), "filter": words}
    store = VectorStore(spark, path)
    empty = {"version": 0, "buckets": buckets, "blocks": blocks_for(texts), "texts": texts, "schemas": {k: v.jsonValue() for k, v in schemas.items()}, "entries": []}
    if not store._files._publish(empty):
        raise ValueError(f"there is a store at {path} already")
    return store
