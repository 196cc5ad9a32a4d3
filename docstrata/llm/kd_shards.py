"""Sharding by a K-d tree over document metadata, native DataFrame operations only.

A node that stands for m shards is split at the weighted median (by bytes) for its two halves of m shards, along the
metadata dimension in which it is widest, until each leaf is one shard of about total / shards bytes. Dimensions are
scaled to the whole table: log of the size, the place of the id, source, and language. Copies of a text move as one: all have
the coordinates of their smallest id, and the text's CRC breaks ties. Only a group of copies that exceeds the share
``together`` of a shard, in bytes or in rows, is made of several parts, by a hash of the id; they are neighbours in
every order, so that it is cut only where a median falls inside it. A hot source is cut like anything else.

A median is found without sorting: sort keys are 63-bit integers, and four rounds sum the sizes by 16 bits of the key
within the one bucket that holds the median. Rounds send one row for each open node to the driver (at most
``shards``), never a row of the table; they end early where the bucket holds less than ``tolerance`` of a shard. Law: ``bytes``.

Cases: a null text counts as empty; null metadata is one value of its own; rows that repeat are a group of copies; texts
that agree in size and CRC count as copies; an empty table has no shards; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstrata.functions.tables import materialize

SHARDS, OVERHEAD = 40, 16
#: What a group of copies may weigh, as a share of a shard, to be sure not to be cut.
TOGETHER = 0.05
#: Rows that one task numbers within a shard, about.
NUMBERED_TOGETHER = 200_000
#: Bits of a sort key: dimension, text CRC, hash of the id; and the widths of the rounds that read it.
DIMENSION_BITS, CRC_BITS, HASH_BITS = 16, 32, 15
ROUNDS = (16, 16, 16, 15)
TOP, LARGEST = 1 << DIMENSION_BITS, (1 << 63) - 1


def coordinates(docs: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """(key, size, crc, one number for each dimension)."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + OVERHEAD
    named = [F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(-1)).cast("double").alias(f"d{i + 2}") for i, c in enumerate(columns)]
    return docs.select(F.col(key).alias("id"), size.alias("size"), crc.alias("crc"), F.ln(size.cast("double")).alias("d0"), F.coalesce(F.col(key).cast("double"), F.lit(0.0)).alias("d1"), *named)


def grouped(base: DataFrame, dims: list[str], shards: int, together: float) -> DataFrame:
    """``base`` with every copy at the coordinates of its group's smallest id, and ``hash``: the part of its group, 0 but in
    groups that weigh more than ``together`` of a shard. There are at most 2 * shards / together of the latter, so that they
    are broadcast, and no key of the other join is hot."""
    groups = base.groupBy("crc", "size").agg(F.min(F.struct("id", *dims)).alias("lead"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups, "groups")
    whole = base.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    most_bytes, most_rows = max(1.0, together * (whole["size"] or 0) / shards), max(1.0, together * whole["n"] / shards)
    parts = F.ceil(F.greatest(F.col("n") * F.col("size") / most_bytes, F.col("n") / most_rows))
    groups = groups.select("crc", "size", "lead", F.least(parts, F.lit(1 << HASH_BITS)).alias("parts"))
    heavy, light = F.broadcast(groups.where("parts > 1")), groups.where("parts <= 1")
    of_lead = [F.coalesce(F.col(f"lead.{d}"), F.col(d)).alias(d) for d in dims]
    cut = base.join(heavy, ["crc", "size"]).select("id", "size", "crc", *of_lead, F.pmod(F.xxhash64("id"), F.col("parts")).alias("hash"))
    rest = base.join(heavy, ["crc", "size"], "left_anti").join(light, ["crc", "size"], "left").select("id", "size", "crc", *of_lead, F.lit(0).cast("long").alias("hash"))
    return cut.unionByName(rest)


def scaled(value: str, low: float, high: float) -> Column:
    """A dimension as an integer of DIMENSION_BITS bits."""
    return F.least(F.floor((F.col(value) - low) / ((high - low) or 1.0) * TOP), F.lit(TOP - 1)).cast("long")


def of_node(values: list[int | float]) -> Column:
    """The value for a row's node, from a list by node."""
    return F.element_at(F.lit(values), F.col("node") + 1)


def medians(table: DataFrame, targets: dict[int, tuple[int, float]], keys: list[str], shards: int, tolerance: float) -> dict[int, int]:
    """For each node -> (dimension, bytes that go left): the last key of the left child, exact or within ``tolerance``."""
    dimension = [targets[n][0] if n in targets else 0 for n in range(shards)]
    prefix = [0 if n in targets else -1 for n in range(shards)]
    left = [float(targets[n][1]) if n in targets else 0.0 for n in range(shards)]
    sized = [0.0] * shards
    shift = sum(ROUNDS)
    key = F.element_at(F.array(*keys), of_node(dimension) + 1)
    for width in ROUNDS:
        above, shift = shift, shift - width
        sums = table.where(F.shiftright(key, above) == of_node(prefix)).groupBy("node", F.shiftright(key, shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = sums.withColumn("sum", F.sum("size").over(Window.partitionBy("node").orderBy("bucket")))
        # the bucket in which the running sum reaches the target
        reached = running.where(F.col("sum") >= of_node(left)).groupBy("node").agg(F.min(F.struct("sum", "bucket", "size")).alias("b")).select("node", "b.*")
        for r in reached.collect():  # a row for each node
            prefix[r.node], sized[r.node] = r.bucket, float(r.size)
            left[r.node] -= r.sum - r.size
        if max(sized) <= tolerance:
            break
    # the last bucket goes to the side that it brings nearer to its target
    return {n: ((prefix[n] + (left[n] >= sized[n] / 2)) << shift) - 1 for n in targets}


def keyed(docs: DataFrame, key: str, text: str, columns: list[str], shards: int, together: float) -> DataFrame:
    """(id, size, crc, a sort key for each dimension, node 0) of every row."""
    base = materialize(coordinates(docs, key, text, columns), "coordinates")
    dims = [f"d{i}" for i in range(2 + len(columns))]
    ends = base.agg(*(f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max))).first()
    tie = F.col("crc") * F.lit(1 << HASH_BITS) + F.col("hash")
    keys = ((scaled(d, ends[f"{d}_min"] or 0.0, ends[f"{d}_max"] or 0.0) * F.lit(1 << (CRC_BITS + HASH_BITS)) + tie).alias(f"k{i}") for i, d in enumerate(dims))
    return materialize(grouped(base, dims, shards, together).select("id", "size", "crc", *keys, F.lit(0).alias("node")), "keys")


def kd_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS, tolerance: float = 1e-4, together: float = TOGETHER) -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row's shard, and its place there, gapless from 0."""
    table = keyed(docs, key, text, list(columns), shards, together)
    keys = [f"k{i}" for i in range(2 + len(columns))]
    whole = table.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    rows = whole["n"]
    ends = {0: shards} if rows else {}  # open nodes: the first of their shards -> the end of them
    while ends := {a: b for a, b in ends.items() if b - a > 1}:
        wide = [(F.max(k) - F.min(k)).alias(k) for k in keys]
        spans = {r.node: r for r in table.groupBy("node").agg(F.sum("size").alias("size"), *wide).collect()}  # a row for each node
        ends = {a: b for a, b in ends.items() if a in spans}
        middle = {a: (a + b) // 2 for a, b in ends.items()}
        widest = {a: max(range(len(keys)), key=lambda i, a=a: spans[a][keys[i]]) for a in ends}
        targets = {a: (widest[a], spans[a]["size"] * (middle[a] - a) / (b - a)) for a, b in ends.items()}
        last = medians(table, targets, keys, shards, tolerance * whole["size"] / shards)
        dimension, cut, right = ([x.get(a, d) for a in range(shards)] for x, d in ((widest, 0), (last, LARGEST), (middle, 0)))
        beyond = F.element_at(F.array(*keys), of_node(dimension) + 1) > of_node(cut)
        table = materialize(table.withColumn("node", F.when(beyond, of_node(right)).otherwise(F.col("node"))), "nodes")
        ends = {c: d for a, b in ends.items() for c, d in ((a, middle[a]), (middle[a], b))}
    placed = table.select("id", "size", "crc", F.col("node").alias("shard"), F.pmod(F.xxhash64("id", "crc"), F.lit(max(1, rows // shards // NUMBERED_TOGETHER))).alias("part"))
    counts = placed.groupBy("shard", "part").count()
    before = counts.select("shard", "part", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size")) - 1
    out = placed.withColumn("slot", slot.cast("long")).join(before, ["shard", "part"])
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot") + F.col("before")).alias("slot"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of nearly equal bytes."""
    found = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
