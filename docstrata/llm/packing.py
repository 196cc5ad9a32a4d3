"""Packing of tokenized documents into sequences of a fixed length, by bulk-synchronous best-fit.

A document longer than the capacity is cut into full pieces, its remainder first; full pieces, and pieces longer than half
the capacity, are sequences of their own. The other pieces are put into the gaps that these leave, in rounds. A round
sorts waiting pieces and gaps together by size, from the largest down, over range partitions. Each task sweeps its range:
a piece takes its successor, the smallest gap of the range that holds it, and what it leaves of the gap is used again.
Pieces whose range has no gap left take one from the nearest range above that has some: the k-th of these pieces the
k-th of those gaps, the smallest first, so no gap is claimed twice. All gaps are brought up to date, those too small
for any piece are closed, and the next round begins. Where a piece is longer than every gap, its task opens new sequences: one task
for the longest pieces as many as they need, the others as many as their bytes fill. Each round places or opens
something, and most pieces are placed in the first two. In one range the result is that of best-fit decreasing.

The driver sees, each round, two counts of each task and three numbers about the whole; never a row of a table.

Cases: a null or empty text is the end token alone; rows that share an id are packed each on its own; rows with a null
id too; an empty table packs into nothing; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.tables import materialize
from docstrata.llm.bpe import encoder, read_vocabulary, slices

CAPACITY, END = 1024, 2
#: Pieces and gaps that one task sweeps, about.
SWEPT_TOGETHER = 100_000


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the remainder first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(a, capacity) for a in range(first, n, capacity)]


def piece_table(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every whole text; narrow. Without ids: they stay where they are made."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        e = encoder(shared.value)
        for batch in slices(batches, text):
            keys = batch.column(batch.schema.get_field_index("id")).to_pylist()
            out: list[tuple] = []
            for k, ids in zip(keys, e.encode(batch.column(batch.schema.get_field_index(text)).to_pylist()), strict=True):
                raw = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                out += [(k, i, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)])) for i, (a, n) in enumerate(pieces(len(raw) // 4, capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias(text)).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


#: Rows of a sweep: pieces that found a place, pieces that wait, gaps that any later range may use, and smaller gaps.
PLACED, WAITING, OPEN, SMALL = range(4)
SWEPT = "what int, part int, rank long, id long, size long, sequence_id long, offset long"


def best_fit(pieces: list[int], gaps: list[int], capacity: int, allowed: float, beyond: int = 0) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit of ``pieces``, sizes from the largest down, into ``gaps`` and new sequences.

    At most ``allowed`` sequences are opened, for pieces longer than ``beyond`` only. ([(sequence, offset)] by piece, with -1
    for none; what is left of each gap). Gaps are numbered as given, new ones after them."""
    left = list(gaps)
    free: dict[int, list[int]] = {}  # size -> gaps of that size
    for i, g in enumerate(left):
        free.setdefault(g, []).append(i)
    sizes = sorted(free)
    places: list[tuple[int, int]] = []
    opened = 0
    for n in pieces:
        at = bisect.bisect_left(sizes, n)
        if at < len(sizes):
            g = sizes[at]
            i = free[g].pop()
            if not free[g]:
                del free[g], sizes[at]
        elif n > beyond and opened < allowed:
            g, i = capacity, len(left)
            left.append(capacity)
            opened += 1
        else:
            places.append((-1, -1))
            continue
        places.append((i, capacity - g))
        left[i] = rest = g - n
        if rest not in free:
            free[rest] = []
            bisect.insort(sizes, rest)
        free[rest].append(i)
    return places, left


def swept(items: DataFrame, n: int, capacity: int, largest: int) -> DataFrame:
    """One sweep over ``items(kind: 0 gap, 1 piece; id, size)`` in about n range partitions, largest sizes first (see SWEPT);
    ``largest`` is the size of the largest gap of all."""
    order = [F.desc("size"), "kind", F.xxhash64("id"), "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not table:
            return
        kind, id_, size = (table.column(c).to_numpy() for c in ("kind", "id", "size"))
        gap_ids, gaps = id_[kind == 0], size[kind == 0].tolist()
        ids, pieces = id_[kind == 1], size[kind == 1].tolist()
        # nothing lies above the first range, so that what finds no gap there finds none at all
        allowed, beyond = (float("inf"), 0) if part == 0 else (-(-sum(x for x in pieces if x > largest) // capacity), largest)
        places, left = best_fit(pieces, gaps, capacity, allowed, beyond)
        sequence = gap_ids.tolist()
        rows: list[tuple] = []
        waiting = 0
        for i, (uid, n, (at, offset)) in enumerate(zip(ids.tolist(), pieces, places, strict=True)):
            if at < 0:
                rows.append((WAITING, part, waiting, uid, n, None, None))
                waiting += 1
                continue
            if at == len(sequence):
                sequence.append(uid)
            rows.append((PLACED, part, i, uid, n, sequence[at], offset))
        lowest = int(size[-1])
        usable = sorted((g, i) for i, g in enumerate(left) if g >= lowest)
        rows += [(OPEN, part, r, None, g, sequence[i], None) for r, (g, i) in enumerate(usable)]
        rows += [(SMALL, part, 0, None, g, sequence[i], None) for i, g in enumerate(left) if 0 < g < lowest]
        kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5)
        for a in range(0, len(rows), 10_000):
            columns = zip(*rows[a : a + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SWEPT.split(", ")])

    return items.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, SWEPT)


#: From rank ``piece_rank`` on, ``n`` pieces of task ``piece_part`` take as many gaps of task ``gap_part``, from rank ``gap_rank`` on.
Interval = tuple[int, int, int, int, int]


def carried(counts: dict[int, tuple[int, int]]) -> list[Interval]:
    """(piece_part, piece_rank, gap_part, gap_rank, n): which waiting pieces take which gaps of the ranges above, from
    (waiting pieces, open gaps) of each task."""
    above: list[list[int]] = []  # (task, first rank, gaps): the nearest last
    plan: list[Interval] = []
    for part in sorted(counts):
        waiting, gaps = counts[part]
        done = 0
        while done < waiting and above:
            task, first, there = above[-1]
            n = min(there, waiting - done)
            plan.append((part, done, task, first, n))
            done += n
            above[-1] = [task, first + n, there - n]
            if there == n:
                above.pop()
        if gaps:
            above.append([part, 0, gaps])
    return plan


def labelled(rows: DataFrame, plan: list[Interval], of: int) -> DataFrame:
    """Rows of a sweep with their interval of the plan and their place in it, null for none; ``of`` is 0 for pieces and 2
    for gaps. Narrow; the plan has at most two entries for a task."""
    first = np.array([(*p[of : of + 2], i, p[4]) for i, p in enumerate(plan)], np.int64).reshape(-1, 4)
    first = first[np.lexsort((first[:, 1], first[:, 0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("part", "rank"))
            interval, place = np.full(len(part), -1), np.zeros(len(part), np.int64)
            for p in np.unique(part).tolist():
                own = first[first[:, 0] == p]
                here = np.flatnonzero(part == p)
                if len(own):
                    at = np.searchsorted(own[:, 1], rank[here], "right") - 1
                    inside = (at >= 0) & (rank[here] < own[at, 1] + own[at, 3])
                    interval[here[inside]], place[here[inside]] = own[at[inside], 2], (rank[here] - own[at, 1])[inside]
            none = interval < 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(interval, mask=none), pa.array(place, mask=none)], names=[*batch.schema.names, "interval", "place"])

    return rows.mapInArrow(run, f"{SWEPT}, interval long, place long")


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``table(uid, length, ...)`` with sequence_id, the uid of a sequence's first piece, and offset; uids are distinct.
    ``table`` is read several times: it is to be stored."""
    alone = F.col("length") > capacity // 2
    first = table.where(alone)
    waiting = table.where(~alone).select(F.col("uid").alias("id"), F.col("length").alias("size"))
    gaps = first.select(F.col("uid").alias("id"), (capacity - F.col("length")).alias("size"))
    placed: list[DataFrame] = []
    while True:
        has = waiting.agg(F.count("*").alias("n"), F.min("size").alias("least")).first()
        if not has.n:
            break
        gaps = gaps.where(F.col("size") >= has.least)
        room = gaps.agg(F.count("*").alias("n"), F.max("size").alias("largest")).first()
        items = waiting.select(F.lit(1).alias("kind"), "id", "size").unionByName(gaps.select(F.lit(0).alias("kind"), "id", "size"))
        done = materialize(swept(items, -(-(has.n + room.n) // SWEPT_TOGETHER), capacity, room.largest or 0), "swept")
        placed.append(done.where(F.col("what") == PLACED).select("id", "sequence_id", "offset"))
        counts = done.groupBy("part").agg(F.count_if(F.col("what") == WAITING).alias("waiting"), F.count_if(F.col("what") == OPEN).alias("open")).collect()  # a row for each task
        plan = carried({r.part: (r.waiting, r.open) for r in counts})
        waiting, gaps = done.where(F.col("what") == WAITING), done.where(F.col("what") == OPEN)
        small = done.where(F.col("what") == SMALL).select(F.col("sequence_id").alias("id"), "size")
        if plan:
            waiting, gaps = labelled(waiting, plan, 0), labelled(gaps, plan, 2)
            taken = gaps.where("interval is not null").select("interval", "place", F.col("size").alias("gap"), F.col("sequence_id").alias("to"))
            matched = waiting.where("interval is not null").select("interval", "place", "id", "size").join(taken, ["interval", "place"])
            matched = materialize(matched.select("id", F.col("to").alias("sequence_id"), (capacity - F.col("gap")).alias("offset"), (F.col("gap") - F.col("size")).alias("rest")), "matched")
            placed.append(matched.select("id", "sequence_id", "offset"))
            small = small.unionByName(matched.where("rest > 0").select(F.col("sequence_id").alias("id"), F.col("rest").alias("size")))
            waiting, gaps = waiting.where("interval is null"), gaps.where("interval is null")
        waiting = waiting.select("id", "size")
        gaps = gaps.select(F.col("sequence_id").alias("id"), "size").unionByName(small)
    own = first.withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    if not placed:
        return own
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    return own.unionByName(table.where(~alone).join(found.withColumnRenamed("id", "uid"), "uid").select(own.columns))


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    table = materialize(piece_table(docs, vocabulary, key, text, capacity, end).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(table, capacity).drop("uid").withColumnRenamed("id", key)


def op7_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_vocabulary(path or public_tokenizers.path("byte_bpe_50k.json")))
