"""The splitter over many tasks: chunks of texts that no task should hold.

``split_distributed`` gives the same chunks as ``chunking.split_text`` with lengths in words, of texts that come in slices. Nothing larger than a
cell of ``GRID`` characters or a block of pieces is in one task:

1. Cells. Slices are dealt anew into cells of equal size; a cell also knows the characters beside it.
2. Pieces. A place is a cut of level j if the j-th separator stands there and the stretch between the coarser separators around it has too many
   words. Stretches run through cells, so each cell reports, for every level, its words before the first and after the last
   separator; sums over the cells of a text say how many words an unfinished stretch has on either side. That decides every cut exactly.
3. Packing. When a chunk that begins at piece s is full, the next one begins at a piece that depends on s alone: the state of the
   splitter is where the open chunk begins. Blocks of pieces (with the pieces of a chunk's length after them) tabulate, for every
   piece that can be the first to begin a chunk in them, which piece begins the first chunk after them. These tables are composed in a tree
   over the blocks of a text, up and down again, and tell each block where its chunks begin.
4. Texts. Chunks are ranges of characters, cut out of the cells and put together.

Cases: a text that is null, empty or blank has no chunks; slices may be empty, and a gap in their numbers means nothing; rows that repeat a key and
a number are ordered by their text; keys may be null; other columns are ignored; an empty table gives no rows. A stretch
without any word is one piece however long it is, but only as two numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions.tables import materialize
from docstrata.operators.chunking import SEPARATORS, recursive_chunks, word_count

#: Characters of a cell; words of a block of pieces, at least four chunks; tables that are composed in one task.
GRID, BLOCK, FAN_IN = 1_000_000, 200_000, 64
#: What str.split takes for white space.
SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def text_slices(docs: DataFrame, text: str = "text", chars: int = GRID) -> DataFrame:
    """``docs`` with a row for each ``chars`` characters of the text, numbered by ``part``."""
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("part", T.LongType()), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column(batch.schema.get_field_index(text))):
                t = t.as_py() or ""
                for a in range(0, len(t), chars):
                    yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in keep), pa.array([a // chars]), pa.array([t[a : a + chars]])], names=[*keep, "part", text])

    return docs.mapInArrow(run, schema)


def cells_of(slices: DataFrame, keys: list[str], part: str, text: str, grid: int) -> DataFrame:
    """(key, cell, text): each text anew in cells of ``grid`` characters."""
    rows = slices.where(F.length(text) > 0).select(F.struct(*keys).alias("key"), F.col(part).alias("part"), F.col(text).alias("text"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "slices")
    order = Window.partitionBy("key").orderBy("part", "head", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.select("key", "part", "row", F.length("text").alias("n"), F.substring("text", 1, 64).alias("head"))  # a few bytes for each slice
    at = at.select("row", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("at"))
    schema = T.StructType([rows.schema["key"], T.StructField("cell", T.LongType()), T.StructField("at", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            for i, (at_, t) in enumerate(zip(b.column("at").to_pylist(), b.column("text").to_pylist(), strict=True)):
                for cell in range(at_ // grid, (at_ + len(t) - 1) // grid + 1):
                    some = t[max(cell * grid - at_, 0) : (cell + 1) * grid - at_]
                    yield pa.RecordBatch.from_arrays([b.column("key").slice(i, 1), pa.array([cell]), pa.array([max(at_, cell * grid)]), pa.array([some])], names=["key", "cell", "at", "text"])

    cut = rows.join(at, "row").select("key", "at", "text").mapInArrow(run, schema)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return cut.groupBy("key", "cell").agg(whole.alias("text"))


class Cell:
    """The characters of a cell: where words begin, and the coarsest separator at each place (``levels`` where there is none)."""

    def __init__(self, number: int, text: str, before: str | None, ahead: str | None, separators: tuple[str, ...]):
        codes = np.frombuffer((text + (ahead or "")).encode("utf-32-le"), np.uint32)
        n = self.n = len(text)
        space = np.isin(codes[:n], SPACES)
        self.said = ~space
        self.begins = self.said & np.append(before is None or before.isspace(), space[:-1])
        self.levels = len(separators)
        self.level = np.full(n, self.levels)
        for j in reversed(range(self.levels)):
            here = np.ones(n, bool)
            for k, c in enumerate(separators[j]):
                here &= np.append(codes[k:], np.zeros(k, np.uint32))[:n] == ord(c)
            self.level[here] = j
        self.seen = [bool((self.level == j).any()) for j in range(self.levels)]
        if number == 0:
            self.level[0] = -1  # every stretch begins with the text
        self.sum = np.append(0, np.cumsum(self.begins))

    def words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The words of stretches that begin at a, where one may begin within a word, and end before b."""
        return self.sum[b] - self.sum[a] + (self.said[a] & ~self.begins[a])

    def edges(self) -> list[dict]:
        """Of each level whether a separator up to it is here, and the words before the first and from the last."""
        out = []
        for j in range(self.levels):
            at = np.flatnonzero(self.level <= j)
            out.append({"there": len(at) > 0, "head": int(self.sum[at[0]]) if len(at) else 0, "tail": int(self.words(at[-1:], np.array([self.n]))[0]) if len(at) else 0})
        return out

    def pieces(self, top: int, before: list[int], after: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, words) of the pieces that begin here; ``top`` is the coarsest separator of the text, ``before`` and
        ``after`` are the words of the unfinished stretches of each level on either side."""
        cut = self.level <= min(top, self.levels - 1)
        stretch = []
        for j in range(self.levels):
            at = np.flatnonzero(self.level <= j)
            ends = np.append(at[1:], self.n)
            words = self.words(at, ends) if len(at) else np.zeros(0, int)
            words = np.append((self.sum[at[0]] if len(at) else self.sum[-1]) + before[j], words)
            words[-1] += after[j]
            stretch.append((at, words))
            if j > top:
                here = np.flatnonzero(self.level == j)
                coarser, n = stretch[j - 1]
                cut[here[n[np.searchsorted(coarser, here, side="right")] > size]] = True
        at = np.flatnonzero(cut)
        if not len(at):
            return at, at
        n = self.words(at, np.append(at[1:], self.n))
        for j in range(min(top, self.levels - 1), self.levels):  # the last piece ends with the stretch that it is
            coarser, words = stretch[j]
            if words[-1] <= size or j == self.levels - 1:
                n[-1] = words[-1]
                break
        return at, n


def next_chunks(idx: np.ndarray, start: np.ndarray, n: np.ndarray, total: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece that a chunk may begin with: how many pieces further (from the first of these) the chunk ends, and the number of
    the piece that the next chunk begins with, -1 at the end. ``start`` is the words before each piece."""
    end = start + n
    full = np.maximum(np.searchsorted(end, start + size, side="right"), np.arange(len(idx)) + 1)
    inside = full < len(idx)
    at = np.minimum(full, len(idx) - 1)
    back = np.minimum(np.searchsorted(start, np.maximum(start[at] - overlap, end[at] - size)), at)
    after = np.where(inside, idx[back], np.where(idx[0] + full < total, idx[0] + full, -1))
    return full, after


def followed(after: np.ndarray, first: int, own: int) -> np.ndarray:
    """Of each of the ``own`` pieces from number ``first`` on: the piece that begins the first chunk after these, by doubling."""
    to = after[:own].copy()
    while len(at := np.flatnonzero((to >= first) & (to < first + own))):
        to[at] = to[to[at] - first]
    return to


def split_distributed(slices: DataFrame, size: int, overlap: int, keys: tuple[str, ...] = ("doc_id",), part: str = "part", text: str = "text", separators: tuple[str, ...] = SEPARATORS, grid: int = GRID, block: int = BLOCK) -> DataFrame:
    """(keys, chunk_idx, chunk, n_tokens) of the texts whose slices, in the order of ``part``, are the rows of each key."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    block, levels = max(block, 4 * size), len(separators)
    cells = materialize(cells_of(slices, list(keys), part, text, grid), "cells")
    key = cells.schema["key"]
    lists = lambda *names: T.StructType([key, T.StructField("cell", T.LongType()), *(T.StructField(x, T.ArrayType(T.LongType())) for x in names)])
    longest = max(1, *map(len, separators))
    ends = lambda step, ahead, before: F.struct((F.col("cell") + step).alias("cell"), ahead.alias("ahead"), before.alias("before"))
    nothing = F.lit(None).cast("string")
    beside = cells.select("key", F.explode(F.array(ends(-1, F.substring("text", 1, longest), nothing), ends(1, nothing, F.right("text", F.lit(1))))).alias("x")).select("key", "x.*")
    cells = materialize(cells.join(beside.groupBy("key", "cell").agg(F.max("ahead").alias("ahead"), F.max("before").alias("before")), ["key", "cell"], "left"), "cells")

    def read(b: pa.RecordBatch) -> Iterator[tuple[int, Cell]]:
        for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "text", "before", "ahead")), strict=True)):
            yield i, Cell(*row, separators)

    def edged(batches):
        for b in batches:
            for i, c in read(b):
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, 1), b.column("cell").slice(i, 1), pa.array([int(c.sum[-1])]), pa.array([c.seen]), pa.array([c.edges()], edge)], names=["key", "cell", "words", "seen", "edges"])

    edge = pa.list_(pa.struct([("there", pa.bool_()), ("head", pa.int64()), ("tail", pa.int64())]))
    edges = cells.mapInArrow(edged, T.StructType([key, T.StructField("cell", T.LongType()), *T.StructType.fromDDL("words long, seen array<boolean>, edges array<struct<there: boolean, head: long, tail: long>>")]))
    # a row for each cell: the words of the stretches that it shares with others
    w = Window.partitionBy("key").orderBy("cell")
    text_ = Window.partitionBy("key")
    so_far = F.sum("words").over(w)
    past, to_come = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    edges = materialize(edges.withColumn("upto", so_far), "edges")
    mark = lambda j, side, how, over: how(F.when(F.col("edges")[j]["there"], F.struct(F.col("edges")[j][side].alias("n"), F.col("upto"), F.col("words"))), ignorenulls=True).over(over)
    before = [F.coalesce(m["n"] + F.col("upto") - F.col("words") - m["upto"], F.lit(0)) for m in (mark(j, "tail", F.last, past) for j in range(levels))]
    after = [F.coalesce(m["n"] + m["upto"] - m["words"] - F.col("upto"), F.sum("words").over(text_) - F.col("upto")) for m in (mark(j, "head", F.first, to_come) for j in range(levels))]
    top = F.least(*(F.when(F.max(F.col("seen")[j].cast("int")).over(text_) == 1, F.lit(j)).otherwise(levels) for j in range(levels)), F.lit(levels))
    shared = edges.select("key", "cell", top.alias("top"), F.array(*before).alias("shared_before"), F.array(*after).alias("shared_after"))

    def cut(batches):
        for b in batches:
            for i, c in read(b):
                at, n = c.pieces(*(b.column(x)[i].as_py() for x in ("top", "shared_before", "shared_after")), size)
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, 1), b.column("cell").slice(i, 1), pa.array([at + grid * b.column("cell")[i].as_py()], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], names=["key", "cell", "at", "n"])

    pieces = materialize(cells.join(shared, ["key", "cell"]).mapInArrow(cut, lists("at", "n")), "pieces")
    ends = cells.groupBy("key").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    sums = pieces.select("key", "cell", F.size("at").cast("long").alias("count"), F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("words"), F.get("at", F.lit(0)).alias("first"))
    known = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    sums = sums.join(ends, "key").select("key", "cell", known("count", past).alias("pieces_before"), known("words", past).alias("words_before"), F.coalesce(F.first("first", ignorenulls=True).over(to_come), "chars").alias("next"), F.sum("count").over(text_).alias("total"))

    def dealt(batches):
        for b in batches:
            for i in range(b.num_rows):
                at, n = (b.column(x)[i].values.to_numpy() for x in ("at", "n"))
                if not len(at):
                    continue
                base, words, end, total = (b.column(x)[i].as_py() for x in ("pieces_before", "words_before", "next", "total"))
                start = words + np.cumsum(n) - n
                ends = np.append(at[1:], end)
                of = start // block
                for k in np.unique(of).tolist():  # the pieces of a block, and for the block before it those of a chunk's length
                    for to, chosen in ((k, of == k), (k - 1, (of == k) & (start <= k * block + size))):
                        if to >= 0 and chosen.any():  # they follow one another
                            i0, some = int(chosen.argmax()), int(chosen.sum())
                            arrays = [pa.array([c.astype(np.int32)], pa.list_(pa.int32())) for c in (at[chosen] - at[i0], n[chosen])]
                            firsts = [pa.array([int(x)]) for x in (total, base + i0, at[i0], ends[i0 + some - 1], start[i0])]
                            yield pa.RecordBatch.from_arrays([b.column("key").slice(i, 1), pa.array([to]), *firsts, *arrays], names=["key", "block", "total", "idx", "at", "end", "start", "ats", "n"])

    schema = T.StructType([key, *T.StructType.fromDDL("block long, total long, idx long, at long, end long, start long, ats array<int>, n array<int>")])
    blocks = materialize(pieces.join(sums, ["key", "cell"]).mapInArrow(dealt, schema), "piece-blocks")

    def steps(t: pa.Table) -> tuple | None:
        """The pieces of a block with their next chunks: (columns, number of own pieces, full, after); None if it only has others'."""
        runs = []
        for r in sorted(zip(*(t.column(c).to_pylist() for c in ("idx", "at", "end", "start")), t.column("ats"), t.column("n"), strict=True), key=lambda r: r[0]):
            at, n = r[1] + r[4].values.to_numpy().astype(np.int64), r[5].values.to_numpy().astype(np.int64)
            runs.append((r[0] + np.arange(len(at)), at, np.append(at[1:], r[2]), r[3] + np.cumsum(n) - n, n))
        columns = [np.concatenate(c) for c in zip(*runs, strict=True)]
        own = int((columns[3] // block == t.column("block")[0].as_py()).sum())
        return (columns, own, *next_chunks(columns[0], columns[3], columns[4], t.column("total")[0].as_py(), size, overlap)) if own else None

    table = T.StructType([key, *T.StructType.fromDDL("block long, entry array<long>, exit array<long>")])

    def tabled(t: pa.Table) -> pa.Table:
        found, exits = [], []
        if (s := steps(t)) is not None:
            (idx, _, _, start, _), own, _, after = s
            can = np.flatnonzero(start[:own] <= t.column("block")[0].as_py() * block + size)
            can = can if len(can) else np.array([0])
            found, exits = [idx[can]], [followed(after, int(idx[0]), own)[can]]
        return pa.table([t.column("key").slice(0, len(found)), t.column("block").slice(0, len(found)), pa.array(found, pa.list_(pa.int64())), pa.array(exits, pa.list_(pa.int64()))], names=["key", "block", "entry", "exit"])

    tables = materialize(blocks.groupBy("key", "block").applyInArrow(tabled, table), "tables")
    entries = first_chunks(tables, key)

    def ranged(t: pa.Table, entry: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and entry.num_rows and (s := steps(t)) is not None:
            (idx, at, end, start, n), own, full, after = s
            now = entry.column("entry")[0].as_py() - int(idx[0])
            while 0 <= now < own:
                last = int(full[now]) - 1
                if start[last] + n[last] > start[now]:  # else it is blank
                    out.append((int(at[now]), int(end[last])))
                now = int(after[now]) - int(idx[0]) if after[now] >= 0 else -1
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([t.column("key").take(pa.array([0] * len(out), pa.int64())), t.column("block").take(pa.array([0] * len(out), pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "block", "a", "b"])

    ranges = blocks.groupBy("key", "block").cogroup(entries.groupBy("key", "block")).applyInArrow(ranged, T.StructType([key, *T.StructType.fromDDL("block long, a long, b long")]))
    ranges = materialize(ranges, "ranges")
    counts = ranges.groupBy("key", "block").agg(F.count("*").alias("n")).withColumn("chunks_before", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranges.join(counts.select("key", "block", "chunks_before"), ["key", "block"]).withColumn("chunk_idx", F.row_number().over(Window.partitionBy("key", "block").orderBy("a", "b")) - 1 + F.col("chunks_before"))
    wanted = numbered.select("key", "chunk_idx", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / grid), F.floor((F.col("b") - 1) / grid))).alias("cell"))

    def read_out(texts: pa.Table, some: pa.Table) -> pa.Table:
        cell, t = texts.column("cell")[0].as_py(), texts.column("text")[0].as_py()
        at = [(max(a - cell * grid, 0), b - cell * grid) for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True)]
        return pa.table([some.column("key"), some.column("chunk_idx"), some.column("cell"), pa.array([t[a:b] for a, b in at], pa.string())], names=["key", "chunk_idx", "cell", "text"])

    bits = cells.select("key", "cell", "text").groupBy("key", "cell").cogroup(wanted.groupBy("key", "cell")).applyInArrow(read_out, T.StructType([key, *T.StructType.fromDDL("chunk_idx long, cell long, text string")]))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"]), "")

    def told(batches):
        for b in batches:
            chunks = [t.strip() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("chunk_idx").cast(pa.int32()), pa.array(chunks, pa.string()), pa.array(map(word_count, chunks), pa.int32())], names=["key", "chunk_idx", "chunk", "n_tokens"])

    done = bits.groupBy("key", "chunk_idx").agg(whole.alias("text")).mapInArrow(told, T.StructType([key, *T.StructType.fromDDL("chunk_idx int, chunk string, n_tokens int")]))
    return done.select("key.*", "chunk_idx", "chunk", "n_tokens")


def chunks_of_any_length(docs: DataFrame, size: int, overlap: int, keys: tuple[str, ...] = ("doc_id",), text: str = "text", longer_than: int = GRID, separators: tuple[str, ...] = SEPARATORS, grid: int = GRID) -> DataFrame:
    """(keys, chunk_idx, chunk, n_tokens) of ``docs``, a row for each text: those of more than ``longer_than`` characters go over many tasks,
    all others are split where they are. The chunks are the same either way; rows that repeat a key are texts of their own."""
    long_ = F.coalesce(F.length(text) > longer_than, F.lit(False))
    short = recursive_chunks(docs.where(~long_).select(*keys, text), size, overlap, text, separators)
    rows = docs.where(long_).select(*keys, text).withColumn("_row", F.monotonically_increasing_id())
    apart = split_distributed(text_slices(rows, text, grid), size, overlap, (*keys, "_row"), text=text, separators=separators, grid=grid)
    return short.select(*keys, "chunk_idx", "chunk", "n_tokens").unionByName(apart.drop("_row"))


def first_chunks(tables: DataFrame, key: T.StructField) -> DataFrame:
    """(key, block, entry): the piece that begins the first chunk of each block, from ``tables(key, block, entry, exit)`` composed in a tree."""
    found = T.StructType([key, T.StructField("block", T.LongType()), T.StructField("entry", T.LongType())])

    def walk(t: pa.Table, entry: int) -> tuple[list[int], int]:
        """The entries of tables in order, and the last exit; -1 after the end."""
        entries = []
        for e, x in zip(t.column("entry").to_pylist(), t.column("exit").to_pylist(), strict=True):
            entries.append(entry)
            entry = dict(zip(e, x, strict=True))[entry] if entry >= 0 else -1
        return entries, entry

    def composed(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        enter = t.column("entry")[0].as_py()
        return pa.table([t.column("key").slice(0, 1), pa.array([t.column("block")[0].as_py() // FAN_IN]), pa.array([enter]), pa.array([[walk(t, e)[1] for e in enter]], pa.list_(pa.int64()))], names=["key", "block", "entry", "exit"])

    def walked(t: pa.Table, entry: int) -> pa.Table:
        t = t.sort_by("block")
        return pa.table([t.column("key"), t.column("block"), pa.array(walk(t, entry)[0], pa.int64())], names=["key", "block", "entry"])

    if (tables.agg(F.max("block")).first()[0] or 0) < FAN_IN:  # the first piece of a text begins its first chunk
        return tables.groupBy("key").applyInArrow(lambda t: walked(t, 0), found)
    group = F.floor(F.col("block") / FAN_IN).alias("group")
    above = first_chunks(materialize(tables.groupBy("key", group).applyInArrow(composed, tables.schema), "tables"), key).withColumnRenamed("block", "group")
    return tables.groupBy("key", group).cogroup(above.groupBy("key", "group")).applyInArrow(lambda t, e: walked(t, e.column("entry")[0].as_py()), found)
