"""Stored conversations with deletes and renames that cost what they change: merge on read over snapshots.

A store has two tables, ``conversations`` and ``messages``, and two kinds of notes, ``deleted`` and ``renamed``, all dealt into buckets by a
hash of the conversation. A change writes new files only: rows, or a note for each conversation that it concerns; a delete
is one note whatever the number of messages. A manifest lists the commits that count, each with the version at which it came; it is
written once, under the next number, and a writer that finds the number taken takes its change to the newer manifest.
A reader takes one manifest and hence one snapshot: rows lose against later notes of their conversation.
``compacted`` rewrites only the buckets where notes have gathered; ``expired`` deletes files that no kept manifest lists.

Bounds: a manifest has a line for each commit since the buckets were last compacted; the driver sees manifests and numbers of
buckets, never rows or ids. The file system must refuse to create a file that exists, as HDFS and local ones do.

Cases: rows without a conversation id are stored and can't be deleted; ids that are unknown, or deleted already, are "not found"; repeated
ids count once; a conversation that is added again after its deletion is there, with what is added then; blank titles are rejected, of
several the largest counts; an empty store has empty tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import text as X

TABLES, NOTES = ("conversations", "messages"), ("deleted", "renamed")
RETRIES, STALE = 20, 600


@dataclass
class Store:
    """The store at ``path``; ``conv`` is the conversations' key, of both tables."""

    spark: SparkSession
    path: str
    conv: str = "conv_id"

    # ---- files ----

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._at("manifest")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> dict:
        fs, path = self._at("manifest", f"{self.versions()[-1] if version is None else version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Write a manifest under its number; False if another writer was first."""
        fs, path = self._at("manifest", f"{manifest['version']:012d}.json")
        _, new = self._at("manifest", f"{uuid.uuid4().hex}.tmp")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        try:
            done = not fs.exists(path) and self._claimed(fs, path) and fs.rename(new, self._at("manifest", f"{manifest['version']:012d}.json")[1])
        finally:
            if fs.exists(new):
                fs.delete(new, False)
        return done

    def _claimed(self, fs, path) -> bool:
        """Whether this writer alone may write the manifest: it created the file beside it, which nobody can create again. That
        of a writer that died before it wrote the manifest is void after STALE seconds."""
        claim = path.suffix(".claim")
        try:
            fs.create(claim, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            if not fs.exists(path) and fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE:
                fs.delete(claim, False)
            return False
        return True

    def _change(self, change: Callable[[dict], dict]) -> int:
        """Apply a change to the newest manifest, again if another writer comes first; the version it has then."""
        for attempt in range(RETRIES):
            time.sleep(attempt / 10)
            now = self.manifest()
            after = change(json.loads(json.dumps(now))) | {"version": now["version"] + 1}
            if self._publish(after):
                return after["version"]
        raise RuntimeError(f"{RETRIES} other writers came first")

    def _written(self, kind: str, rows: DataFrame, buckets: int) -> tuple[str, str, list[int]]:
        """New files with ``rows``, a folder for each bucket; the kind, the commit's name and its buckets."""
        name = uuid.uuid4().hex
        rows.withColumn("bucket", bucket(F.col(self.conv), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path.rstrip('/')}/{kind}/commit={name}")
        fs, path = self._at(kind, f"commit={name}")
        return kind, name, sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(path) if x.isDirectory())

    def _listed(self, kind: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a kind in a snapshot, of some buckets or all, with the ``_version`` at which they came. Other files are not read."""
        schema = T.StructType.fromJson(manifest["schemas"][kind])
        entries = [e for e in manifest["entries"] if e["kind"] == kind]
        if not entries:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0)).withColumn("_version", F.lit(0).cast("long"))
        top = f"{self.path.rstrip('/')}/{kind}"
        whole = T.StructType([*schema.fields, T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(whole).option("basePath", top).parquet(*[f"{top}/commit={e['commit']}" for e in entries])
        came = F.element_at(F.create_map(*(F.lit(x) for e in entries for x in (e["commit"], e["version"]))), F.col("commit")).cast("long")
        old = [e for e in entries if e["without"]]
        for e in old:  # buckets of a commit that were compacted since
            rows = rows.where(~((F.col("commit") == e["commit"]) & F.col("bucket").isin(e["without"])))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.withColumn("_version", came).drop("commit")

    # ---- reading ----

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as it was at ``version``, or is now."""
        return self._merged(table, self.manifest(version), buckets).drop("bucket", "_version")

    def _merged(self, table: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        rows, c = self._listed(table, manifest, buckets), self.conv
        notes = {e["kind"] for e in manifest["entries"]}
        if "deleted" in notes:
            gone = self._listed("deleted", manifest, buckets).groupBy("bucket", c).agg(F.max("_version").alias("_gone"))
            rows = rows.join(gone, ["bucket", c], "left").where(F.col("_gone").isNull() | (F.col("_gone") < F.col("_version"))).drop("_gone")
        if table == "conversations" and "renamed" in notes:
            new = self._listed("renamed", manifest, buckets).groupBy("bucket", c).agg(F.max(F.struct("_version", "title")).alias("_new"))
            title = F.when(F.col("_new._version") > F.col("_version"), F.col("_new.title")).otherwise(F.col("title")).alias("title")
            rows = rows.join(new, ["bucket", c], "left").select(*(title if x == "title" else F.col(x) for x in rows.columns))
        return rows

    # ---- changes ----

    def append(self, conversations: DataFrame, messages: DataFrame) -> int:
        buckets = self.manifest()["buckets"]
        made = [self._written(kind, rows, buckets) for kind, rows in (("conversations", conversations), ("messages", messages))]
        return self._change(lambda m: with_entries(m, made))

    def _noted(self, kind: str, rows: DataFrame, good: str, bad: str | None = None) -> DataFrame:
        """Write a note for each row whose conversation is there; (conv, status) of all."""
        c, m = self.conv, self.manifest()
        rows = rows.withColumn("bucket", bucket(F.col(c), m["buckets"]))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most as many as there are buckets
        known = self._merged("conversations", m, touched).select("bucket", c).distinct().withColumn("_there", F.lit(True))
        status = F.when(F.lit(False) if bad is None else X.is_blank(F.col("title")), bad).when(F.col("_there"), good).otherwise("not found")
        found = rows.join(known, ["bucket", c], "left").withColumn("status", status)
        path = f"{self.path.rstrip('/')}/status/{uuid.uuid4().hex}"
        found.drop("_there").write.parquet(path)  # decided once, on the snapshot that was read
        found = self.spark.read.parquet(path)
        notes = found.where(F.col("status") == good)
        notes = notes.groupBy(c).agg(F.max("title").alias("title")) if kind == "renamed" else notes.select(c).distinct()
        made = [self._written(kind, notes, m["buckets"])]
        self._change(lambda m: with_entries(m, made))
        return found.select(c, "status")

    def delete(self, ids: DataFrame) -> DataFrame:
        """Delete conversations with their messages: (conv, status), "deleted" or "not found"."""
        return self._noted("deleted", ids.select(self.conv).distinct(), "deleted")

    def rename(self, updates: DataFrame) -> DataFrame:
        """Set titles: (conv, status), "renamed", "not found" or "title missing"."""
        return self._noted("renamed", updates.select(self.conv, "title"), "renamed", "title missing")

    # ---- upkeep ----

    def burden(self) -> DataFrame:
        """(bucket, notes) of the newest snapshot: what a reader has to join."""
        m = self.manifest()
        each = [self._listed(kind, m).select("bucket") for kind in NOTES]
        return each[0].unionByName(each[1]).groupBy("bucket").agg(F.count("*").alias("notes"))

    def compacted(self, notes: int = 1) -> list[int]:
        """Rewrite the buckets with at least so many notes, without these; which they were. Changes that come meanwhile stay."""
        m = self.manifest()
        chosen = sorted(r.bucket for r in self.burden().where(F.col("notes") >= notes).collect())  # at most as many as there are buckets
        if not chosen:
            return []
        made = []
        for table in TABLES:  # a row keeps its place in the order of changes: as all it is compared with is older, the newest version will do
            made.append(self._written(table, self._merged(table, m, chosen).drop("bucket", "_version"), m["buckets"]))
        seen = {e["commit"] for e in m["entries"]}

        def swap(now: dict) -> dict:
            for e in now["entries"]:
                if e["commit"] in seen:
                    e["without"] = sorted({*e["without"], *chosen})
            now["entries"] = [e for e in now["entries"] if not set(e["buckets"]) <= set(e["without"])]
            return with_entries(now, made, version=m["version"])

        self._change(swap)
        return chosen

    def expired(self, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` snapshots; the number of commits whose files are deleted. Only for when nobody reads
        older snapshots and no writer is at work."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        listed = {(e["kind"], e["commit"]) for v in kept for e in self.manifest(v)["entries"]}
        gone = {(e["kind"], e["commit"]) for v in old for e in self.manifest(v)["entries"]} - listed
        for kind, commit in gone:
            fs, path = self._at(kind, f"commit={commit}")
            fs.delete(path, True)
        for v in old:
            fs, path = self._at("manifest", f"{v:012d}.json")
            fs.delete(path, False)
            fs.delete(path.suffix(".claim"), False)
        fs, path = self._at("status")
        fs.delete(path, True)
        return len(gone)


def bucket(conv: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(buckets)).cast("int")


def with_entries(manifest: dict, made: list[tuple[str, str, list[int]]], version: int | None = None) -> dict:
    """A manifest with new commits, which come at its next version unless another is given."""
    manifest["entries"] += [{"kind": kind, "commit": commit, "version": manifest["version"] + 1 if version is None else version, "buckets": buckets, "without": []} for kind, commit, buckets in made if buckets]
    return manifest


def create(spark: SparkSession, path: str, conversations: T.StructType, messages: T.StructType, conv: str = "conv_id", buckets: int = 64) -> Store:
    """A new, empty store for rows of these schemas; conversations need a ``title``. The number of buckets is for good: choose it so that
    a bucket is some files' worth of rows."""
    store = Store(spark, path, conv)
    key = conversations[conv]
    schemas = {"conversations": conversations, "messages": messages, "deleted": T.StructType([key]), "renamed": T.StructType([key, T.StructField("title", T.StringType())])}
    if not store._publish({"version": 0, "buckets": buckets, "schemas": {k: v.jsonValue() for k, v in schemas.items()}, "entries": []}):
        raise ValueError(f"there is a store at {path} already")
    return store
