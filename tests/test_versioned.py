"""Deletes and renames in a versioned store against the batch operators on whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docstrata.operators import chat
from docstrata.sources import versioned

CONVERSATIONS, MESSAGES = "conv_id long, title string, day int", "conv_id long, turn int, text string"


def frames(spark, ids, word="m"):
    conversations = spark.createDataFrame([(i, f"t{i}", 1) for i in ids], CONVERSATIONS)
    return conversations, spark.createDataFrame([(i, t, f"{word}{i}.{t}") for i in ids for t in range(i % 4 + 1)], MESSAGES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    made = versioned.create(spark, str(tmp_path / "store"), *(x.schema for x in frames(spark, [1])), buckets=4)
    made.append(*frames(spark, range(40)))
    return made


def count_rows(spark, store, kind):
    return spark.read.option("basePath", f"{store.path}/{kind}").parquet(f"{store.path}/{kind}/commit=*/bucket=*").count()


def test_changes_equal_batch_operators(spark, store):
    c, m = frames(spark, range(40))
    ids = spark.createDataFrame([(3,), (4,), (4,), (77,), (None,)], "conv_id long")
    left, texts, status = chat.deleted(c, m, ids)
    assert rows(store.delete(ids)) == rows(status)
    assert rows(store.read("conversations")) == rows(left) and rows(store.read("messages")) == rows(texts)
    assert count_rows(spark, store, "deleted") == 2 and count_rows(spark, store, "messages") == m.count()  # a note for each, no row rewritten
    updates = spark.createDataFrame([(5, "new"), (5, "newer"), (6, " "), (3, "gone"), (78, "x"), (7, None)], "conv_id long, title string")
    renamed, said = chat.renamed(left, updates)
    assert rows(store.rename(updates)) == rows(said)
    assert rows(store.read("conversations")) == rows(renamed.select("conv_id", "title", "day"))
    assert {r.status for r in store.delete(ids).collect()} == {"not found"}


def test_snapshots_stay(spark, store):
    before = [rows(store.read(t)) for t in versioned.TABLES]
    version = store.versions()[-1]
    store.delete(spark.range(0, 40, 3).withColumnRenamed("id", "conv_id"))
    store.append(*frames(spark, [3, 100], "again"))  # 3 comes back, with its new messages only
    assert [rows(store.read(t, version)) for t in versioned.TABLES] == before
    texts = {r.text for r in store.read("messages").where("conv_id = 3").collect()}
    assert texts == {f"again3.{t}" for t in range(4)} and store.read("conversations").where("conv_id in (3, 100)").count() == 2


def test_compaction_changes_files_only(spark, store):
    store.delete(spark.createDataFrame([(1,), (2,)], "conv_id long"))
    store.rename(spark.createDataFrame([(5, "five")], "conv_id long, title string"))
    store.append(*frames(spark, [1], "late"))
    want = [rows(store.read(t)) for t in versioned.TABLES]
    notes = {r.bucket: r.notes for r in store.burden().collect()}
    assert sum(notes.values()) == 3
    assert store.compacted(99) == []
    assert store.compacted() == sorted(notes)
    assert [rows(store.read(t)) for t in versioned.TABLES] == want and store.burden().count() == 0
    store.delete(spark.createDataFrame([(1,), (9,)], "conv_id long"))  # notes count against compacted rows too
    want = [[r for r in w if r[0] not in (1, 9)] for w in want]
    assert [rows(store.read(t)) for t in versioned.TABLES] == want
    store.compacted()
    assert store.expired() > 0 and len(store.versions()) == 1
    assert [rows(store.read(t)) for t in versioned.TABLES] == want


def test_writers_meet(spark, store):
    """A change that finds its version taken goes on top of the other; a compaction keeps notes that came meanwhile."""
    other = versioned.Store(spark, store.path)
    published, once = store._publish, []

    def late(manifest):
        if not once:
            once.append(other.delete(spark.createDataFrame([(8,), (11,)], "conv_id long")))
        return published(manifest)

    store.delete(spark.createDataFrame([(1,), (2,)], "conv_id long"))
    store._publish = late
    assert store.compacted()
    assert len(once) == 1
    left = {r.conv_id for r in store.read("conversations").collect()}
    assert left == set(range(40)) - {1, 2, 8, 11} == {r.conv_id for r in store.read("messages").collect()}
    assert not published(store.manifest())  # the number is taken


def test_a_dead_writer_does_not_stop_others(spark, store, monkeypatch):
    monkeypatch.setattr(versioned, "STALE", -1)
    fs, path = store._at("manifest", f"{store.versions()[-1] + 1:012d}.json.claim")
    fs.create(path, False).close()  # and no manifest follows
    assert [r.status for r in store.delete(spark.createDataFrame([(1,)], "conv_id long")).collect()] == ["deleted"]
    assert store.read("conversations").count() == 39


def test_only_touched_buckets_are_read(spark, store):
    plan = store.read("messages", buckets=[1])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    files = store.read("messages", buckets=[1]).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("bucket=1" in r.f for r in files)


def test_empty_store(spark, tmp_path):
    made = versioned.create(spark, str(tmp_path / "s"), *(x.schema for x in frames(spark, [1])))
    assert rows(made.read("messages")) == [] and made.compacted() == []
    assert [r.status for r in made.delete(spark.createDataFrame([(1,)], "conv_id long")).collect()] == ["not found"]
    with pytest.raises(ValueError):
        versioned.create(spark, str(tmp_path / "s"), *(x.schema for x in frames(spark, [1])))
    made.append(*frames(spark, []))
    assert rows(made.read("conversations")) == []
