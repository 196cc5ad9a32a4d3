"""Near-duplicate documents: fast similarity sketching, banding, exact verification, connected components.

A document is the set of its distinct word shingles (64-bit hashes; A-Z lower-cased, words are runs without ASCII white
space; a text with fewer words is one shingle). A sketch has ``bands * rows`` coordinates. Round i of the first t
rounds throws every element into a hashed bin; the last t rounds visit one bin each, so every coordinate fills, and most
sets stop after a few rounds, when all are full. A coordinate keeps the smallest value of the first round that reaches it.

Equal sets are one node, so exact copies never meet in a bucket. In a bucket every
member is compared with a few hubs only, which connects most groups. What is still in different components is compared
where it can be linked after all: what two sets share is at most what both have of their hub, plus what they share
beyond it. So sets that share a rare element beyond their hub meet through that element, and by bucket meet only sets that
have enough of the hub or a frequent element beyond it, less those that the similarities to their hubs rule out. A
group of m near copies costs about m comparisons, and yet every pair of texts in a common bucket is verified,
connected or proven apart. Links are confirmed on full sets.

Cases: a text that is null or has no words has an empty set, links with nothing and is kept. Rows that share an id share
their component, whatever their texts, and each text links by its own set. A row whose id is null links with nothing, has a
null component and is kept. A very long text is read whole, as its words' hashes: about 16 bytes for each word and shingle at once. Empty tables give empty results; other columns of ``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.tables import materialize
from docstrata.llm.bpe import mix, slices, spaced, word_hashes

BATCH_BYTES = 1_000_000
#: With 42 bands of 6 rows a pair of similarity 0.8 shares no band with probability 3e-6, one of 0.9 with 3e-14.
BANDS, ROWS = 42, 6
#: Members of a bucket that all its others are compared with, before what is left of its pairs.
HUBS = 3
#: Sets that an element beyond a hub may be in for it to be joined on; sets with more frequent ones meet in full.
FEW = 64
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


SEPARATES = np.zeros(256, bool)
SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets, sorted and distinct in each; where each set starts, and the end)."""
    octets = LOWER[spaced(b"".join(t + b" " for t in texts))]
    gap = SEPARATES[octets[:-8]]
    before = np.append(True, gap[:-1])
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    h = word_hashes(octets, starts, ends - starts)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    word_at = np.append(0, np.searchsorted(starts, text_ends))
    n_words = np.diff(word_at)
    s = h.copy()
    for k in range(1, words):
        s[:-k] = mix(s[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    # a text of fewer words is one shingle of them all
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    for i in short.tolist():
        x = h[word_at[i] : word_at[i] + 1]
        for k in range(1, n_words[i]):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[word_at[i] + k : word_at[i] + k + 1])
        s[word_at[i] : word_at[i] + 1] = x ^ np.uint64(n_words[i])
    sizes = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    parts = [s[a : a + n] for a, n in zip(word_at.tolist(), sizes.tolist())]  # noqa: B905
    for p in parts:
        p.sort()
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    at = np.append(0, np.cumsum(sizes))
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    new[at[:-1][sizes > 0]] = True
    return flat[new], np.append(0, np.cumsum(new))[at]


def sketches(flat: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches of the sets; a row for each, EMPTY throughout for an empty set."""
    n = len(at) - 1
    sizes = np.diff(at)
    out = np.full((n, t), EMPTY)
    open_sets = np.flatnonzero(sizes)
    elements, owner = flat, np.repeat(np.arange(n), sizes)
    for i in range(t):
        if not len(open_sets):
            break
        x = mix(elements ^ mix(np.array([i + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        bins = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        place = np.full(n, -1)
        place[open_sets] = np.arange(len(open_sets))
        found = np.full(len(open_sets) * t, EMPTY)
        np.minimum.at(found, place[owner] * t + bins.astype(np.int64), mix(x + np.uint64(i)))
        found = found.reshape(len(open_sets), t)
        rows = out[open_sets]
        rows = np.where(rows == EMPTY, found, rows)
        out[open_sets] = rows
        still = (rows == EMPTY).any(axis=1)
        if not still.all():
            keep = np.zeros(n, bool)
            open_sets = open_sets[still]
            keep[open_sets] = True
            inside = keep[owner]
            elements, owner = elements[inside], owner[inside]
    for i in range(t):
        need = open_sets[out[open_sets, i] == EMPTY]
        if len(need):
            chosen = np.concatenate([flat[at[k] : at[k + 1]] for k in need.tolist()])
            x = mix(chosen ^ mix(np.array([t + i + 1], np.uint64) * np.uint64(0xA0761D6478BD642F)))
            out[need, i] = np.minimum.reduceat(x, np.append(0, np.cumsum(sizes[need])[:-1]))
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch; bands differ in their keys."""
    cut = sketch.reshape(len(sketch), bands, rows)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :].repeat(len(sketch), axis=0)
    for r in range(rows):
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + cut[:, :, r])
    return key


def texts_of(batch: pa.RecordBatch, text: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def sketch_table(docs: DataFrame, id: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, digest of the set, keys of its bands); narrow. The digest of an empty set is null."""

    def run(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            flat, at = shingle_sets(texts_of(batch, "text"), words)
            keys = band_keys(sketches(flat, at, bands * rows), bands, rows)
            full = np.diff(at) > 0
            cuts = np.append(0, np.cumsum(full) * bands).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[full].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), pa.array(np.diff(at)), digests_of(flat, at), lists], names=["id", "n_shingles", "digest", "keys"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_shingles long, digest binary, keys array<long>")


def digests_of(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """A digest of each set, null for an empty one."""
    return pa.array([hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if a < b else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def set_table(texts: DataFrame, words: int) -> DataFrame:
    """(digest, items) of each ``text``: the full sets, as array<long>."""

    def run(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            flat, at = shingle_sets(texts_of(batch, "text"), words)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([digests_of(flat, at), lists], names=["digest", "items"])

    return texts.select("text").mapInArrow(run, "digest binary, items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, component: smallest id reachable) of the ids in ``edges(a, b)``, by alternating large and small stars.

    Each step moves edges to the smallest neighbour; the number of rounds is logarithmic. Only two numbers a round
    reach the driver."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = None
    while (is_ := state(now)) != was:
        was = is_
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = materialize(small.where("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with ``common``, the size of their full sets' intersection, ``similar`` and ``linked``."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("of_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("items").alias("of_b")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("n"), (F.size("of_a") + F.size("of_b")).cast("long").alias("sum"))
    union = F.col("sum") - F.col("n")
    return common.select("a", "b", F.col("n").alias("common"), (F.col("n") / union).alias("similar"), (100 * F.col("n") >= percent * union).alias("linked"))


def hubs_of(members: DataFrame) -> DataFrame:
    """(key, hubs): the members that all others of a bucket are compared with: the first, and some by hash."""
    orders = [F.col("id"), *(F.xxhash64("id", F.lit(r)) for r in range(1, HUBS))]
    chosen = [F.min(F.struct(o.alias("o"), F.col("id")))["id"].alias(f"h{r}") for r, o in enumerate(orders)]
    return members.groupBy("key").agg(*chosen).select("key", F.array(*(f"h{r}" for r in range(HUBS))).alias("hubs"))


def pair(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def may_be_linked(percent: int, common: Column) -> Column:
    """Whether sets of n and n2 elements with at most ``common`` in both can be linked."""
    return F.lit(100) * common >= F.lit(percent) * (F.col("n") + F.col("n2") - common)


def between_components(members: DataFrame, of: DataFrame, tested: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of one bucket that are still in different components and may be linked after all.

    1 - similarity is a metric, so the known similarities to a common hub rule out every pair whose two differ by more
    than the similarity that is asked for leaves. And what two sets have in common is at most the smaller of what they
    share with the first hub, plus what both have beyond it: pairs for which the former is too little must share an
    element beyond the hub. Elements beyond a hub that few sets have are joined; the sets that have a frequent one meet
    each other by bucket. The members of a bucket's largest component only meet the others."""
    named = members.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component").alias("main")).where("low < high").select("key", "main")
    alive = materialize(named.join(open_keys, "key").join(hubs_of(members), "key"), "alive")
    if alive.isEmpty():
        return alive.select(*pair("id", "id"))
    each = alive.select("key", "id", F.posexplode("hubs").alias("r", "hub"))
    known = each.select("key", "id", "r", F.col("id") == F.col("hub"), *pair("id", "hub")).toDF("key", "id", "r", "own", "a", "b").join(tested, ["a", "b"], "left")
    similar = F.when(F.col("own"), 1.0).otherwise(F.col("similar"))
    profile = known.groupBy("key", "id").agg(*(F.max(F.when(F.col("r") == r, similar)).alias(f"s{r}") for r in range(HUBS)), F.max(F.when(F.col("r") == 0, F.col("common"))).alias("common"))
    alive = materialize(alive.join(profile, ["key", "id"]).where(~F.array_contains("hubs", F.col("id"))).withColumn("hub", F.col("hubs")[0]).drop("hubs"), "alive")
    once = alive.select("id", "hub", "n", "component").distinct()
    beyond = once.join(sets, "id").join(sets.toDF("hub", "of_hub"), "hub").select("hub", "id", "n", "component", F.explode(F.array_except("items", "of_hub")).alias("item"))
    beyond = materialize(beyond, "beyond")
    shared = materialize(beyond.groupBy("hub", "item").agg(F.count("*").alias("sets")).where("sets > 1"), "shared")
    frequent = beyond.join(shared.where(F.col("sets") > FEW).select("hub", "item"), ["hub", "item"], "left_semi").select("hub", "id").distinct().withColumn("frequent", F.lit(True))
    rare = beyond.join(shared.where(F.col("sets") <= FEW).select("hub", "item"), ["hub", "item"], "left_semi")
    by_item = rare.join(rare.toDF("hub", "id2", "n2", "component2", "item"), ["hub", "item"]).where((F.col("id") < F.col("id2")) & (F.col("component") != F.col("component2")) & may_be_linked(percent, F.least("n", "n2")))
    alive = alive.join(frequent, ["hub", "id"], "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    columns = ["id", "n", "component", "common", "frequent", *(f"s{r}" for r in range(HUBS))]
    other = alive.select("key", *(F.col(c).alias(f"{c}2") for c in columns))
    may = (F.col("component") != F.col("component2")) & ((F.col("component2") == F.col("main")) | (F.col("component") < F.col("component2")))
    may &= may_be_linked(percent, F.least("n", "n2")) & (may_be_linked(percent, F.least("common", "common2")) | F.col("frequent") & F.col("frequent2"))
    for r in range(HUBS):
        may &= F.coalesce(F.abs(F.col(f"s{r}") - F.col(f"s{r}2")) <= F.lit(1 - percent / 100 + 1e-9), F.lit(True))
    by_key = alive.where("component <> main").join(other, "key").where(may)
    return by_key.select(*pair("id", "id2")).unionByName(by_item.select(*pair("id", "id2"))).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept (see the module's text)."""
    table = materialize(sketch_table(docs, id, text, words, bands, rows), "sketches")
    known = table.where("id is not null and digest is not null")
    several = materialize(known.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id"), "several")
    repeats = not several.isEmpty()
    # a set is known by its smallest id, so that originals come before their copies, or by a number of its own where that id has several sets
    distinct = known.groupBy("digest").agg(F.min("id").alias("least"))
    if repeats:
        own = F.when(F.col("several"), -1 - F.monotonically_increasing_id()).otherwise(F.col("least"))
        distinct = distinct.join(several.select(F.col("id").alias("least"), F.lit(True).alias("several")), "least", "left").withColumn("node", own).drop("several")
    else:
        distinct = distinct.withColumn("node", F.col("least"))
    distinct = materialize(distinct, "distinct")
    lead = known.join(distinct.withColumnRenamed("least", "id"), ["id", "digest"]).select(F.col("node").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key")).distinct()
    shared = lead.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    members = materialize(lead.join(shared, "key"), "members")
    of_members = materialize(distinct.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi"), "of-members")
    texts = docs.select(F.col(id).cast("long").alias("least"), F.col(text).alias("text")).join(of_members.select("least").distinct(), "least", "left_semi")
    sets = set_table(texts, words).groupBy("digest").agg(F.first("items").alias("items")).join(of_members, "digest").select(F.col("node").alias("id"), "items")
    sets = materialize(sets, "sets")
    met = members.join(hubs_of(members), "key").select("id", F.explode("hubs").alias("hub")).where("id <> hub").select(*pair("id", "hub")).distinct()
    tested = materialize(compared(met, sets, percent), "tested")
    edges = tested.where("linked").select("a", "b")
    if repeats:  # the texts of one id belong together
        own = known.join(several, "id", "left_semi").join(distinct, "digest").select("id", "node").distinct()
        edges = edges.unionByName(own.join(own.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b"))
    of = components(edges)
    rest = materialize(between_components(members, of, tested, sets, percent), "rest")
    if not rest.isEmpty():
        found = materialize(compared(rest, sets, percent).where("linked").select("a", "b"), "found")
        if not found.isEmpty():
            of = components(of.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found))
    of = of.withColumnRenamed("id", "node").join(distinct, "node").select("component", "digest", "least")
    of = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("digest", "component_id")
    group = distinct.join(of, "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    out = known.select("id", "n_shingles", "digest").join(group, "digest").select("id", "n_shingles", "component_id")
    empty = table.where("id is not null and digest is null").select("id", "n_shingles")
    # an id may have a text without words and another with some
    both = materialize(table.where("id is not null").groupBy("id").agg(F.count("digest").alias("full"), F.count("*").alias("all")).where("full > 0 and full < all").select("id"), "both")
    if both.isEmpty():
        empty = empty.withColumn("component_id", F.col("id"))
    else:
        other = out.join(both, "id", "left_semi").groupBy("id").agg(F.min("component_id").alias("other"))
        empty = empty.join(other, "id", "left").select("id", "n_shingles", F.coalesce("other", "id").alias("component_id"))
    out = out.unionByName(empty).unionByName(table.where("id is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id. Rows whose id is null stay. Of rows that repeat an
    id and a text one stays, the smallest by its other columns as JSON, whatever their kinds and names; texts that differ stay, whatever their id."""
    kept = near_duplicates(docs, id, text, **parameters).where(F.col("kept") & F.col(id).isNotNull())
    place = [f"c{i}" for i in range(len(docs.columns))]  # columns by their places, so that no name clashes
    rows = docs.toDF(*place)
    of, said = (place[docs.columns.index(c)] for c in (id, text))
    rest = [c for c in place if c not in (of, said)]
    found = rows.where(F.col(of).isNotNull()).join(kept.select(F.col(id).alias(of)).distinct(), of, "left_semi")
    if rest:
        other = F.struct(*rest)
        once = found.groupBy(of, said).agg(F.min_by(other, F.to_json(other, {"ignoreNullFields": "false"})).alias("rest")).select(of, said, "rest.*").select(*place)
    else:
        once = found.distinct()
    return once.unionByName(rows.where(F.col(of).isNull())).toDF(*docs.columns)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


#: An inverted index of the shingles gives all pairs that share one; components by a recursive walk.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [w[1]] END)) AS s
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""
