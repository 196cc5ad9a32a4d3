"""Near-duplicate vectors by an exact metric range join.

Vectors are points of the sphere, and two are linked if their angle is at most that of ``least``. Pivots, no two of them
within that angle, partition the vectors: each belongs to its nearest pivot. A vector is replicated to another cell only
where the triangle inequality leaves room for a partner there: its distance from the plane between the two pivots, and
its distance to the other pivot less the cell's radius, must not exceed the angle. Cells then join independently, in
blocks of at most ``held`` rows that stay in memory while all others of the cell stream past. Of two cells only one sends to the
other, so each pair is met once. Vectors within half the angle of a pivot are all linked with one another by the triangle
inequality; they are counted without any comparison, so a large family of near copies costs as much as its rows.

Equal vectors (up to powers of two) are one node with a number of copies. A block gives counts and a spanning forest of
its links, never the links themselves. The number of pivots is the one with the least work by an estimate on the sample; it
changes no result. Pivots come from at most ``SAMPLE`` rows of each of the ``WIDTHS`` most common widths, at most ``PIVOTS`` of them;
vectors of rarer widths are one cell for each width, in blocks. All vectors are compared, whatever was sampled.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows with a null
id: n_links 0, a component of their own (null for a null id), kept. Vectors of different widths don't meet. Rows that repeat are linked
with each other; rows that share an id are rows of their own, each with its own links. Very long vectors are met in smaller blocks.
Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions.tables import materialize
from docstrata.llm.minhash import components
from docstrata.llm.vectors import finite, matrix

LEAST, HELD, PIVOTS, SAMPLE, WIDTHS = 0.9, 8192, 1024, 8192, 4
#: Angles have errors below this; cosines of unit vectors below that.
MARGIN, DOUBT = 1e-6, 1e-12
#: Rows that are compared with a block at once; numbers of a block; products of two vectors that cost as much as moving one.
TOGETHER, NUMBERS, MOVE = 256, 4_000_000, 1000
NODE = "node binary, copies long, vector array<double>, cell int, angle double, core boolean"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component is about 1; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) + 0.0


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def by_width(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        widths = batch.column("vector").value_lengths().to_numpy()
        for w in np.unique(widths).tolist():
            yield w, batch.filter(pa.array(widths == w))


def units(rows: DataFrame) -> DataFrame:
    """(id, digest, vector) of ``rows(id, vector)``: scaled vectors and their digests."""

    def run(batches):
        for _, b in by_width(batches):
            x = scaled(matrix(pa.Table.from_batches([b]), "vector"))
            digests = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), digests, vector_lists(x)], names=["id", "digest", "vector"])

    return rows.mapInArrow(run, "id long, digest binary, vector array<double>")


def vector_lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def sends(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of two cells, or blocks, sends its rows to the other: one of them, evenly."""
    return (i < j) ^ ((i + j) % 2 == 1)


@dataclass
class Cells:
    """The pivots of a width, and what is known of their cells: the numbers of blocks of core and other rows, radii, and the
    copies and the smallest node of the core. ``pivots`` is None for one cell without a pivot."""

    pivots: np.ndarray | None = None
    n: int = 1
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((1, 2), int))
    nearest: np.ndarray = field(default_factory=lambda: np.zeros(1))
    farthest: np.ndarray = field(default_factory=lambda: np.zeros(1))
    core: dict[int, tuple[int, bytes]] = field(default_factory=dict)

    def room(self, cosine: np.ndarray, own: np.ndarray, angle: float) -> np.ndarray:
        """For each row and cell whether the cell may hold a partner of the row, its own aside."""
        gap = np.sqrt(np.maximum(((self.pivots[:, None, :] - self.pivots[None]) ** 2).sum(axis=2), 1e-300)) if self.n <= 64 else np.sqrt(np.maximum(2 - 2 * self.pivots @ self.pivots.T, 1e-300))
        off = cosine[np.arange(len(own)), own][:, None] - cosine
        to = angles(cosine)
        limit = angle + MARGIN
        may = (np.arcsin(np.clip(off / gap[own], 0, 1)) <= limit) & (to - self.farthest <= limit) & (self.nearest - to <= limit)
        may[np.arange(len(own)), own] = False
        return may


def fit(x: np.ndarray, rows: int, least: float, held: int) -> Cells:
    """Pivots from the sampled unit vectors ``x`` of a table of ``rows``: as many as make the least work, by the sample."""
    near, chosen = np.full(len(x), -1.0), []
    while len(chosen) < PIVOTS and (left := np.flatnonzero(near < least)).size:
        chosen.append(int(left[0]))
        near = np.maximum(near, x @ x[left[0]])
        near[left[0]] = 1
    best, angle, part = None, float(np.arccos(least)), x[-2048:]
    for n in sorted({min(1 << p, len(chosen)) for p in range(len(chosen).bit_length() + 1)}):
        c = Cells(x[chosen[:n]], n)
        cosine = part @ c.pivots.T
        own, to = cosine.argmax(axis=1), angles(cosine.max(axis=1))
        c.farthest, c.nearest = np.zeros(n), np.full(n, np.pi)
        np.maximum.at(c.farthest, own, to)
        np.minimum.at(c.nearest, own, to)
        may = c.room(cosine, own, angle) & sends(own[:, None], np.arange(n)[None])
        inside = to <= angle / 2 - MARGIN
        size, core = (np.bincount(own[m], minlength=n) * (rows / len(part)) for m in (~inside, inside))
        come = may.sum(axis=0) * (rows / len(part))
        blocks, cores = np.ceil(size / held), np.ceil(core / held)
        moved = (come * (blocks + cores) + size * (np.maximum(blocks - 1, 0) / 2 + cores)).sum()
        work = MOVE * moved + (size * (size / 2 + come + core) + core * come).sum()
        if best is None or work < best[0]:
            best = work, c
    return best[1]


def assigned(nodes: DataFrame, cells: dict[int, Cells], least: float) -> DataFrame:
    """``nodes(digest, least, copies, vector)`` with their cells, NODE; a node is named by its smallest id and its digest, and sorted so."""
    half = float(np.arccos(least)) / 2 - MARGIN

    def run(batches):
        for w, b in by_width(batches):
            c, n = cells.get(w), b.num_rows
            names = [struct.pack(">Q", i + 2**63) + d for i, d in zip(b.column("least").to_pylist(), b.column("digest").to_pylist(), strict=True)]
            own, to, core = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool)
            if c is not None:
                x = matrix(pa.Table.from_batches([b]), "vector")
                cosine = (x / norms(x)[:, None]) @ c.pivots.T
                own, to = cosine.argmax(axis=1).astype(np.int32), angles(cosine.max(axis=1))
                core = to <= half
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), b.column("copies"), b.column("vector"), pa.array(own), pa.array(to), pa.array(core)], names=["node", "copies", "vector", "cell", "angle", "core"])

    return nodes.select("digest", "least", "copies", "vector").mapInArrow(run, NODE)


def spread(homes: DataFrame, cells: dict[int, Cells], least: float) -> DataFrame:
    """A row for each block that a node belongs to or streams past (``streamed``); angles are those to that cell's pivot."""
    angle = float(np.arccos(least))

    def run(batches):
        for w, b in by_width(batches):
            c = cells[w]
            for a in range(0, b.num_rows, 1024):
                yield from replicas(b.slice(a, 1024), c, w)

    def replicas(b: pa.RecordBatch, c: Cells, w: int):
        n = b.num_rows
        own, to, core = b.column("cell").to_numpy(), b.column("angle").to_numpy(), b.column("core").to_numpy(zero_copy_only=False)
        drawn = np.array([int.from_bytes(x[-8:], "big") >> 1 for x in b.column("node").to_pylist()], np.int64)
        cores, others = c.blocks[own, 0], c.blocks[own, 1]
        block = np.where(core, drawn % np.maximum(cores, 1), cores + drawn % np.maximum(others, 1))
        row, cell, into, at = [np.arange(n)], [own], [block], [to]
        # other rows stream past all cores of their cell and half of its other blocks
        free = np.flatnonzero(~core)
        all_blocks = (cores + others)[free]
        i = np.repeat(free, all_blocks)
        k = np.arange(len(i)) - np.repeat(np.cumsum(all_blocks) - all_blocks, all_blocks)
        go = (k < cores[i]) | (k != block[i]) & sends(block[i], k)
        row, cell, into, at = [*row, i[go]], [*cell, own[i[go]]], [*into, k[go]], [*at, to[i[go]]]
        if c.n > 1:
            x = matrix(pa.Table.from_batches([b]), "vector")
            cosine = (x / norms(x)[:, None]) @ c.pivots.T
            i, j = np.nonzero(c.room(cosine, own, angle) & sends(own[:, None], np.arange(c.n)[None]))
            times = c.blocks.sum(axis=1)[j]
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            i, j = np.repeat(i, times), np.repeat(j, times)
            row, cell, into, at = [*row, i], [*cell, j], [*into, k], [*at, angles(cosine[i, j])]
        streamed = np.arange(sum(map(len, row))) >= n
        row, cell, into, at = (np.concatenate(v) for v in (row, cell, into, at))
        for s in range(0, len(row), 1024):
            p = slice(s, s + 1024)
            some = b.select(["node", "copies", "vector"]).take(pa.array(row[p]))
            more = [pa.array(at[p]), pa.array(np.full(len(row[p]), w, np.int32)), pa.array(cell[p].astype(np.int32)), pa.array(into[p].astype(np.int32)), pa.array(streamed[p])]
            yield pa.RecordBatch.from_arrays([*some.columns, *more], names=["node", "copies", "vector", "angle", "width", "cell", "block", "streamed"])

    return homes.mapInArrow(run, "node binary, copies long, vector array<double>, angle double, width int, cell int, block int, streamed boolean")


class Block:
    """The rows of a block, the copies they are linked with, and a label for each: those of one label are connected by links."""

    def __init__(self, parts: list[pa.RecordBatch], least: float, core: tuple[int, bytes] | None):
        t = pa.Table.from_batches(parts)
        self.least, self.core, self.reach = least, core, float(np.arccos(least)) + MARGIN
        order = np.argsort(t.column("angle").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        self.names, self.copies, self.angle = t.column("node").to_pylist(), t.column("copies").to_numpy().astype(np.float64), t.column("angle").to_numpy()
        self.x = matrix(t, "vector")
        self.size = norms(self.x)
        self.u = self.x / self.size[:, None]
        self.label, self.links = np.arange(len(self.x)), np.zeros(len(self.x), np.int64)
        if core:
            self.links += core[0] - self.copies.astype(np.int64)
            self.label[:] = 0
        else:
            for a in range(0, len(self.x), TOGETHER):
                p = np.arange(a, min(a + TOGETHER, len(self.x)))
                self.links[p] += self.compared(self.x[p], self.size[p], self.angle[p], self.copies[p], p)[0]

    def compared(self, x: np.ndarray, size: np.ndarray, angle: np.ndarray, copies: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the copies of the block that it is linked with, and a row of the block among them, or -1."""
        a, b = np.searchsorted(self.angle, [angle.min() - self.reach, angle.max() + self.reach])
        first = np.full(len(x), -1)
        if a == b:
            return np.zeros(len(x), np.int64), first
        cosine = (x / size[:, None]) @ self.u[a:b].T
        linked = cosine >= self.least
        for i, j in zip(*np.nonzero(np.abs(cosine - self.least) <= DOUBT), strict=True):
            linked[i, j] = float(x[i] @ self.x[a + j]) / (float(size[i]) * float(self.size[a + j])) >= self.least
        if own is not None:
            linked[np.arange(len(x)), own - a] = False
        some = np.flatnonzero(linked.any(axis=1))
        count = np.zeros(len(x), np.int64)
        if len(some):
            linked = linked[some]
            count[some] = linked @ self.copies[a:b]
            if own is None:
                self.links[a:b] += (copies[some] @ linked).astype(np.int64)
            first[some] = a + linked.argmax(axis=1)
            low = np.where(linked, self.label[a:b], len(self.x)).min(axis=1)
            high = np.where(linked, self.label[a:b], -1).max(axis=1)
            if own is not None:
                low, high = np.minimum(low, self.label[own[some]]), np.maximum(high, self.label[own[some]])
            for r in np.flatnonzero(low < high).tolist():
                labels = self.label[a:b][linked[r]]
                labels = np.unique(labels if own is None else np.append(labels, self.label[own[some[r]]]))
                if len(labels) > 1:
                    new = np.arange(len(self.x))
                    new[labels] = labels[0]
                    self.label = new[self.label]
        return count, first

    def met(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Links of the rows that stream past."""
        for s in range(0, b.num_rows, TOGETHER):
            p = b.slice(s, TOGETHER)
            x = matrix(pa.Table.from_batches([p]), "vector")
            count, first = self.compared(x, norms(x), p.column("angle").to_numpy(), p.column("copies").to_numpy().astype(np.float64))
            some = np.flatnonzero(count)
            yield found(p.column("node").take(pa.array(some)), count[some], [self.names[i] for i in first[some].tolist()])

    def closed(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.links)
        heads = [self.core[1]] * len(some) if self.core else [self.names[i] for i in self.label[some].tolist()]
        yield found(pa.array([self.names[i] for i in some.tolist()], pa.binary()), self.links[some], heads)


def found(nodes: pa.Array, links: np.ndarray, others: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([nodes, pa.array(links, pa.int64()), pa.array(others, pa.binary())], names=["node", "links", "other"])


def joined(rows: DataFrame, cells: dict[int, Cells], least: float) -> DataFrame:
    """(node, links, other): the copies that a node is linked with in a block, and a node of the block that links lead to."""

    def run(batches):
        key, parts, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "cell", "block", "streamed")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if a == b:
                    continue
                now, part = tuple(keys[a, :3].tolist()), batch.slice(a, b - a)
                if now != key:
                    yield from ended(key, parts, block)
                    key, parts, block = now, [], None
                if not keys[a, 3]:
                    parts.append(part)
                else:
                    if block is None and parts:
                        block = opened(key, parts)
                    if block is not None:
                        yield from block.met(part)
        yield from ended(key, parts, block)

    def opened(key, parts):
        c = cells[key[0]]
        return Block(parts, least, c.core[key[1]] if key[2] < c.blocks[key[1], 0] else None)

    def ended(key, parts, block):
        if block is not None or parts:
            yield from (block or opened(key, parts)).closed()

    sorted_ = rows.repartition("width", "cell", "block").sortWithinPartitions("width", "cell", "block", "streamed")
    return sorted_.mapInArrow(run, "node binary, links long, other binary")


def id_of(node: str) -> Column:
    """The smallest id that a node is named by."""
    return (F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def near_vectors(table: DataFrame, least: float = LEAST, id: str = "vec_id", vector: str = "embedding", held: int = HELD) -> DataFrame:
    """One row per row of ``table``: id, n_links, component_id, kept (see the module's text)."""
    rows = table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.col("id").isNotNull() & finite(F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    known = materialize(units(rows.where(whole)), "vectors")
    nodes = materialize(known.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector")), "nodes")
    cells: dict[int, Cells] = {}
    for place, r in enumerate(nodes.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").collect()):  # a row for each width
        if place >= WIDTHS:
            break
        drawn = nodes.where(F.size("vector") == r.width).orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("vector").toArrow()  # at most SAMPLE rows
        x = matrix(drawn, "vector")
        cells[r.width] = fit(x / norms(x)[:, None], r["count"], least, min(held, max(TOGETHER, NUMBERS // r.width)))
    homes = materialize(assigned(nodes, cells, least), "homes")
    core = F.col("core")
    sizes = homes.groupBy(F.size("vector").alias("width"), "cell").agg(
        F.count_if(core).alias("cores"), F.count_if(~core).alias("others"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.sum(F.when(core, F.col("copies"))).alias("copies"), F.min(F.when(core, F.col("node"))).alias("first")
    )
    for r in sizes.collect():  # a row for each pivot
        c = cells.setdefault(r.width, Cells())
        if len(c.blocks) != c.n:
            c.blocks = np.zeros((c.n, 2), int)
            c.nearest, c.farthest = np.full(c.n, np.inf), np.full(c.n, -np.inf)
        most = min(held, max(TOGETHER, NUMBERS // r.width))
        c.blocks[r.cell] = -(-r.cores // most), -(-r.others // most)
        c.nearest[r.cell], c.farthest[r.cell] = r.near, r.far
        if r.cores:
            c.core[r.cell] = r.copies, bytes(r.first)
    links = materialize(joined(spread(homes, cells, least), cells, least), "links")
    of = components(links.select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "node")
    each = homes.select("node", "copies").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(of, "node", "left")
    digest = F.expr("substring(node, 9)")
    each = each.select(digest.alias("digest"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), id_of("component").alias("linked_to"), id_of("node").alias("own"))
    out = known.select("id", "digest").join(each.select("digest", "n_links", F.coalesce("linked_to", "own").alias("component_id")), "digest").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where(~whole).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors at cosine 0.9 or more, whatever their labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair; components by a recursive walk. Ids are unique there.
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND list_inner_product(x.v, y.v) / (x.n * y.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT m.vec_id, coalesce(k.k, 0) AS n_links, c.c AS component_id, m.vec_id = c.c AS kept
FROM embeddings m JOIN c ON c.a = m.vec_id LEFT JOIN k ON k.a = m.vec_id
"""
