"""K-d shards against a recursion over sorted rows."""

from __future__ import annotations

import random
import zlib

from compare import DATA
from pyspark.sql import functions as F

from docstrata.llm import kd_shards as K


def brute(rows, first, end, dims=4):
    """{place of row: shard}."""
    if end - first == 1 or not rows:
        return {id(r): first for r in rows}
    middle = (first + end) // 2
    span = [max(r[f"k{d}"] for r in rows) - min(r[f"k{d}"] for r in rows) for d in range(dims)]
    key = f"k{span.index(max(span))}"
    target = sum(r.size for r in rows) * (middle - first) / (end - first)
    sums = {}
    for r in rows:
        sums[r[key]] = sums.get(r[key], 0) + r.size
    at, last = 0, -1
    for k in sorted(sums):
        if at + sums[k] >= target:
            last = k if target - at >= sums[k] / 2 else k - 1
            break
        at += sums[k]
    left, right = [r for r in rows if r[key] <= last], [r for r in rows if r[key] > last]
    return brute(left, first, middle) | brute(right, middle, end)


def test_against_recursion(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet"))
    rows = K.keyed(docs, "doc_id", "text", ["source", "lang"], 7, K.TOGETHER).collect()
    place = brute(rows, 0, 7)
    wanted = sorted((r.id, place[id(r)]) for r in rows)
    found = K.kd_shards(docs, shards=7, tolerance=0.0).collect()
    assert sorted((r.doc_id, r.shard) for r in found) == wanted


def test_law_and_slots(spark):
    found = K.op3_kd_shards(spark, str(DATA / "sf0.01")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet")).collect()}
    sizes, slots = {}, {}
    for r in found:
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in found)


def test_hot_groups_are_cut(spark, documents):
    """A source and a text that hold most rows do not end in one shard."""
    rng = random.Random(1)
    rows = [(i, "same text in all of these" if i % 3 else "t" * rng.randint(0, 300)) for i in range(3000)]
    found = K.kd_shards(documents(rows), shards=8).collect()
    sizes = {}
    for r in found:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean


def test_copies_stay_together(spark, documents):
    """Copies under other ids and sources share a shard; a group that is larger is in neighbouring ones; bytes stay equal."""
    rng = random.Random(4)
    texts = ["t" * rng.randint(50, 900) + str(i) for i in range(500)]
    rows = [(i, texts[rng.randrange(500)] if i % 10 else "hot") for i in range(4000)]
    docs = documents(rows).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))).withColumn("lang", (F.col("doc_id") % 3).cast("string"))
    found = K.kd_shards(docs, shards=8, together=0.1).collect()
    shards, sizes, text_of = {}, {}, dict(rows)
    for r in found:
        shards.setdefault(text_of[r.doc_id], set()).add(r.shard)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    share = sum(sizes.values()) / 8
    assert all(len(s) == 1 for t, s in shards.items() if t != "hot")
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 0.25 * share


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (1, None), (2, ""), (None, "x"), (5, "y" * 100_000)], shard=F.lit("clash"), size=F.lit("c"), node=F.lit(1), hash=F.lit(2)).withColumn("source", F.lit(None).cast("string"))
    found = K.kd_shards(docs, shards=4).collect()
    assert sorted((r["size"], r.text_crc32) for r in found) == sorted([(16, 0)] * 3 + [(17, zlib.crc32(b"x")), (100_016, zlib.crc32(b"y" * 100_000))])
    assert all(0 <= r.shard < 4 for r in found)
    for s in {r.shard for r in found}:
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))


def test_empty(spark, documents):
    assert K.kd_shards(documents([])).collect() == []
