"""Vectors kept between runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docstrata.sources import vector_store as V


@pytest.fixture
def store(spark, tmp_path):
    return V.create(spark, str(tmp_path / "store"), texts=1000, buckets=4)


def lengths(t):
    return t.withColumn("vector", F.array(F.length("text").cast("float"), F.crc32("text").cast("float")))


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")


def got(rows):
    return {r["id"]: None if r["vector"] is None else r["vector"][0] for r in rows.collect()}


def test_second_run_encodes_nothing_and_a_change_only_itself(spark, store):
    first = [f"text {i % 500}" for i in range(1000)]
    rows, n = store.encoded(texts(spark, first), lengths, "a")
    assert n == 500 and got(rows) == {i: float(len(t)) for i, t in enumerate(first)}
    assert store.encoded(texts(spark, first), lengths, "b")[1] == 0
    changed = [t + "!" if i % 100 == 7 else t for i, t in enumerate(first)]
    rows, n = store.encoded(texts(spark, changed), lengths, "c")
    assert n == len(set(changed) - set(first)) == 5
    assert got(rows) == {i: float(len(t)) for i, t in enumerate(changed)}


def test_null_empty_repeated_and_clashing(spark, store):
    rows = texts(spark, [None, "", "", "x" * 300_000, "é", None]).selectExpr("*", "1 AS Vector", "2 AS _digest", "3 AS bucket", "4 AS digest")
    found, n = store.encoded(rows, lengths, "a")
    assert n == 3 and got(found) == {0: None, 1: 0.0, 2: 0.0, 3: 300_000.0, 4: 1.0, 5: None}
    assert [c for c in found.columns if c in ("bucket", "digest")] == ["bucket", "digest"] and [c for c in found.columns if c.lower() == "vector"] == ["vector"]
    assert {(r.bucket, r.digest) for r in found.collect()} == {(3, 4)}


def test_empty_table(spark, store):
    rows, n = store.encoded(texts(spark, []), lengths, "a")
    assert n == 0 and rows.count() == 0 and store.vectors().count() == 0 and store.collected() == 0


def test_null_vectors_are_kept(spark, store):
    none = lambda t: t.withColumn("vector", F.lit(None).cast("array<float>"))
    rows, n = store.encoded(texts(spark, ["a", "b"]), none, "a")
    assert n == 2 and got(rows) == {0: None, 1: None}
    assert store.encoded(texts(spark, ["a", "b"]), lengths, "b")[1] == 0


def test_collection_by_references(spark, store):
    store.encoded(texts(spark, ["a", "b", "c"]), lengths, "one")
    store.encoded(texts(spark, ["b", "c", "d"]), lengths, "two")
    assert sorted(r.runs for r in store.references().collect()) == [1, 1, 2, 2]
    assert store.collected() == 0
    store.forget("one")
    assert store.collected() == 1 and store.vectors().count() == 3
    assert store.encoded(texts(spark, ["b", "c", "d"]), lengths, "three")[1] == 0
    rows, n = store.encoded(texts(spark, ["a", "b"]), lengths, "four")  # the collected one comes again
    assert n == 1 and got(rows) == {0: 1.0, 1: 1.0}
    for run in ("two", "three", "four"):
        store.forget(run)
    assert store.collected() == 4 and store.vectors().count() == 0


def test_collection_that_meets_a_new_run_starts_again(spark, store, monkeypatch):
    store.encoded(texts(spark, ["a", "b"]), lengths, "one")
    store.forget("one")
    cleaned, met = store._cleaned, []

    def late(*a):
        if not met:  # a run comes between reading and publishing
            met.append(store.encoded(texts(spark, ["a"]), lengths, "two")[1])
        return cleaned(*a)

    monkeypatch.setattr(store, "_cleaned", late)
    assert store.collected() == 1 and met == [0]
    assert [r.vector[0] for r in store.vectors().collect()] == [1.0] and store.encoded(texts(spark, ["a"]), lengths, "three")[1] == 0


def test_run_whose_filter_changed_size_adds_rows_of_the_new_size(spark, store, monkeypatch):
    add = store._add

    def late(made, keys, manifest):
        store._files._change(lambda m: m | {"blocks": m["blocks"] + 7, "entries": [e for e in m["entries"] if e["kind"] != "filter"]})
        return add(made, keys, manifest)

    monkeypatch.setattr(store, "_add", late)
    store.encoded(texts(spark, [f"t{i}" for i in range(50)]), lengths, "one")
    monkeypatch.undo()
    assert store.encoded(texts(spark, [f"t{i}" for i in range(50)]), lengths, "two")[1] == 0


def test_filter_never_denies_a_key_and_seldom_lets_others_pass(spark):
    keys = spark.range(20_000).select(V.digest(F.col("id").cast("string")).alias("digest"), "id")
    blocks = V.blocks_for(10_000)
    held = V.filter_rows(keys.where("id < 10000"), blocks)
    found = V.maybe_held(keys, held, blocks)
    assert found.where("id < 10000 AND NOT maybe").count() == 0
    assert found.where("id >= 10000 AND maybe").count() < 400


def test_overfull_filter_stays_right(spark, tmp_path):
    small = V.create(spark, str(tmp_path / "small"), texts=1, buckets=2)
    values = [f"w{i}" for i in range(300)]
    assert small.encoded(texts(spark, values), lengths, "a")[1] == 300
    rows, n = small.encoded(texts(spark, [*values, "new", "newer"]), lengths, "b")
    assert n == 2 and all(v is not None for v in got(rows).values())


def test_create_twice(spark, store):
    with pytest.raises(ValueError, match="there is a store"):
        V.create(spark, store.path)
