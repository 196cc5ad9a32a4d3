"""k-means of any number of groups at once, of any size.

A group is its distinct vectors with their numbers of rows, cut into blocks of ``together`` vectors by hash. Each step of the
algorithm is a pass over the blocks (``partial``), a sum of what they give (``added``) and a new state of the group
(``advanced``): k-means|| oversampling, the weights of its candidates, k-means++ among these, Lloyd rounds until nothing
moves; ``STARTS`` starts go side by side and the one of least inertia counts. A group of as many blocks as one task can hold takes its
steps within one task; a larger one takes them as Spark jobs that join blocks with states and add up partial results in a
tree, as a job for each step costs seconds whatever its size. Both call the same functions on the same blocks in the same order, so a
size changes where a step runs and nothing else.

Draws are hashes of a vector, the start and the round: they depend neither on partitions nor on retries. There are
min(k, distinct vectors) clusters, none of them empty: an empty one moves to the vector that lies farthest from its centre.
No state of a group reaches the driver, only the number of groups that are not done.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions.tables import materialize
from docstrata.functions.vectors import as_matrix

SEED, STARTS, OVERSAMPLING_ROUNDS, LLOYD_ROUNDS = 42, 10, 5, 50
#: Vectors of a block, and numbers of a block.
TOGETHER, NUMBERS = 4096, 1_000_000
#: Numbers of the vectors of a group that takes its steps within one task.
ALONE = 8_000_000
#: Partial results that are added in one task; blocks of a group that meet one copy of its state.
FAN_IN, BLOCKS_PER_STATE = 32, 32


@dataclass
class State:
    """A group's k and what its starts have: candidates while ``phase`` is "draw" or "weigh", centres in "lloyd" and "done"."""

    k: int
    starts: int
    seed: int
    phase: str = "draw"
    round: int = 0
    candidates: list[np.ndarray] = field(default_factory=list)
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))
    best: list[tuple[float, np.ndarray] | None] = field(default_factory=list)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and c; zero between equal rows."""
    d = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None], 0)
    near = np.argwhere(d <= 1e-9 * (1 + (x**2).sum(axis=1)[:, None]))
    if len(near):  # where rounding could make equal rows differ
        d[near[:, 0], near[:, 1]] = ((x[near[:, 0]] - c[near[:, 1]]) ** 2).sum(axis=1)
    return d


def uniform(x: np.ndarray, *numbers: int) -> np.ndarray:
    """A number in (0, 1) for each row of x and the given numbers."""
    h = np.full(len(x), np.uint64(0x9E3779B97F4A7C15))
    for column in [*(x + 0.0).view(np.uint64).T, *(np.full(len(x), n, np.uint64) for n in numbers)]:
        h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def partial(x: np.ndarray, n: np.ndarray, s: State) -> list:
    """What a block of vectors x, with n rows each, adds to a step."""
    if s.phase == "draw":  # the smallest of exponential times at rates n * squared distance: a weighted sample
        out = []
        for start in range(s.starts):
            d = squared(x, s.candidates[start]).min(axis=1) if s.round else np.ones(len(x))
            with np.errstate(divide="ignore"):
                time = -np.log(uniform(x, s.seed, start, s.round)) / (n * d)
            first = np.argsort(time, kind="stable")[: 2 * s.k if s.round else 1]
            first = first[np.isfinite(time[first])]
            out.append((time[first], x[first]))
        return out
    if s.phase == "weigh":
        return [np.bincount(squared(x, c).argmin(axis=1), n, len(c)) for c in s.candidates]
    starts, k, width = s.centres.shape
    d = squared(x, s.centres.reshape(-1, width)).reshape(len(x), starts, k)
    label = d.argmin(axis=2)
    least = np.take_along_axis(d, label[:, :, None], axis=2)[:, :, 0]
    held = np.zeros((len(x), starts, k))
    np.put_along_axis(held, label[:, :, None], n[:, None, None].astype(float), axis=2)
    far = least.argmax(axis=0)
    return [held.sum(axis=0), (held.reshape(len(x), -1).T @ x).reshape(starts, k, width), n @ least, least[far, np.arange(starts)], x[far]]


def added(parts: list[list], s: State) -> list:
    """The sum of partial results of a step."""
    if len(parts) == 1:
        return parts[0]
    if s.phase == "draw":
        out = []
        for drawn in zip(*parts, strict=True):
            time, x = (np.concatenate(c) for c in zip(*drawn, strict=True))
            first = np.argsort(time, kind="stable")[: 2 * s.k if s.round else 1]
            out.append((time[first], x[first]))
        return out
    if s.phase == "weigh":
        return [np.sum(c, axis=0) for c in zip(*parts, strict=True)]
    held, sums, inertia, far, at = zip(*parts, strict=True)
    which = np.argmax(far, axis=0)
    return [np.sum(held, axis=0), np.sum(sums, axis=0), np.sum(inertia, axis=0), np.max(far, axis=0), np.stack([at[w][i] for i, w in enumerate(which)])]


def chosen(c: np.ndarray, weight: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k of the candidates by k-means++: the best of a few draws each time."""
    at = [int(random.choice(len(c), p=weight / weight.sum()))]
    near = squared(c, c[at])[:, 0]
    while len(at) < k:
        rate = weight * near
        if not rate.sum():  # candidates without rows of their own
            rate = near
        tries = random.choice(len(c), 2 + int(np.log(k)), p=rate / rate.sum())
        cost = [(weight * np.minimum(near, squared(c, c[[t]])[:, 0])).sum() for t in tries]
        at.append(int(tries[int(np.argmin(cost))]))
        near = np.minimum(near, squared(c, c[[at[-1]]])[:, 0])
    return c[at]


def advanced(s: State, sum_: list) -> State:
    """The state after a step."""
    if s.phase == "draw":
        new = [x for _, x in sum_]
        s.candidates = [np.concatenate([c, x]) for c, x in zip(s.candidates, new, strict=True)] if s.round else new
        s.round += 1
        if s.round > OVERSAMPLING_ROUNDS or not any(map(len, new)):
            s.phase = "weigh"
    elif s.phase == "weigh":
        s.centres = np.stack([chosen(c, w, s.k, np.random.default_rng([s.seed, i])) for i, (c, w) in enumerate(zip(s.candidates, sum_, strict=True))])
        s.phase, s.round, s.candidates, s.best = "lloyd", 0, [], [None] * s.starts
    else:
        held, sums, inertia, far, at = sum_
        moved = s.centres.copy()
        full = held > 0
        moved[full] = sums[full] / held[full][:, None]
        for i in np.flatnonzero(~full.all(axis=1)):
            moved[i, np.flatnonzero(~full[i])[0]] = at[i]
        for i in np.flatnonzero(full.all(axis=1)):  # with none empty, these centres may stand
            s.best[i] = min((float(f"{inertia[i]:.9g}"), s.centres[i]), s.best[i] or (np.inf, None), key=lambda b: b[0])
        s.round += 1
        still = np.allclose(moved, s.centres, rtol=1e-9, atol=1e-12) or s.round >= LLOYD_ROUNDS
        if still and any(s.best):
            s.centres, s.phase = min((b for b in s.best if b), key=lambda b: b[0])[1][None], "done"
        else:
            s.centres = moved
    return s


def labels_of(x: np.ndarray, s: State) -> np.ndarray:
    return squared(x, s.centres[0]).argmin(axis=1).astype(np.int32)


def points(row: pa.StructScalar | pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, rows of each) of a block."""
    return as_matrix(row.values.field("v")), row.values.field("n").to_numpy()


def kmeans(vectors: DataFrame, by: list[str], k: int, more_than: int = 0, ranked: int = 0, seed: int = SEED, starts: int = STARTS, together: int = TOGETHER, vector: str = "vector") -> DataFrame:
    """``vectors`` with ``cluster``: from 0 to min(k, distinct vectors) - 1 within the rows that share the values of ``by`` (nulls
    are a value like any other). Groups of at most ``more_than`` rows are not split and get 0, as do rows without a vector; in those
    of at most k or ``ranked`` distinct vectors each is a cluster, numbered in the order of the vectors."""
    rows = vectors.withColumn("_g", F.struct(F.lit(0).alias("_"), *by)).withColumn("_v", F.col(vector).cast("array<double>"))
    nodes = rows.where("_v is not null").groupBy("_g", "_v").agg(F.count("*").alias("n"))
    sizes = nodes.groupBy("_g").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct"), F.max(F.size("_v")).alias("width")).where((F.col("rows") > more_than) & (F.col("distinct") > 1))
    most = F.least(F.lit(max(together, ranked)), F.greatest(F.lit(64), F.floor(F.lit(NUMBERS) / F.col("width"))))
    dealt = nodes.join(sizes, "_g").withColumn("blocks", F.ceil(F.col("distinct") / most).cast("int")).withColumn("block", F.pmod(F.xxhash64("_v"), "blocks").cast("int"))
    blocks = dealt.groupBy("_g", "blocks", "block", "distinct", "width").agg(F.sort_array(F.collect_list(F.struct(F.col("_v").alias("v"), "n"))).alias("points"))
    blocks = materialize(blocks, "kmeans-blocks")
    group = blocks.schema["_g"]

    def state(distinct: int) -> State:
        return State(min(k, distinct), starts, seed)

    def labelled(name: str, label) -> T.StructType:
        return T.StructType([group, T.StructField("_v", T.ArrayType(T.DoubleType())), T.StructField(name, label)])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, n = points(b.column("points")[i])
                if len(x) <= max(k, ranked):
                    yield told(b, i, np.arange(len(x), dtype=np.int32))
                    continue
                s = state(len(x))
                while s.phase != "done":
                    s = advanced(s, partial(x, n, s))
                yield told(b, i, labels_of(x, s))

    def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of one group, whole."""
        held = sorted(((b.slice(i, 1), b.column("block")[i].as_py()) for b in batches for i in range(b.num_rows)), key=lambda h: h[1])
        parts = [points(b.column("points")[0]) for b, _ in held]
        s = state(held[0][0].column("distinct")[0].as_py())
        while s.phase != "done":
            s = advanced(s, added([partial(x, n, s) for x, n in parts], s))
        for (b, _), (x, _) in zip(held, parts, strict=True):
            yield told(b, 0, labels_of(x, s))

    def told(b: pa.RecordBatch, i: int, label: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("_g").take(pa.array([i] * len(label))), b.column("points")[i].values.field("v"), pa.array(label)], names=["_g", "_v", "cluster"])

    found = blocks.where("blocks = 1").mapInArrow(alone, labelled("cluster", T.IntegerType()))
    several = blocks.where("blocks > 1")
    small = (F.col("blocks") <= FAN_IN) & (F.col("distinct") * F.col("width") <= ALONE)
    found = found.unionByName(several.where(small).groupBy("_g").applyInArrow(in_one_task, labelled("cluster", T.IntegerType())))
    large = several.where(~small)
    if not large.isEmpty():
        found = found.unionByName(by_all_tasks(large, state, told, labelled("cluster", T.IntegerType())))
    out = rows.join(found, ["_g", "_v"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))
    return out.select(*vectors.columns, "cluster")


def by_all_tasks(blocks: DataFrame, state, told, schema: T.StructType) -> DataFrame:
    """(_g, _v, cluster) of groups of several blocks: each step is a join of blocks and states, and sums in a tree."""
    group = blocks.schema["_g"]
    levels, most = 0, blocks.agg(F.max("blocks")).first()[0]
    while most > FAN_IN:
        levels, most = levels + 1, -(-most // FAN_IN)
    kept = T.StructType([group, T.StructField("blocks", T.IntegerType()), T.StructField("state", T.BinaryType()), T.StructField("done", T.BooleanType())])
    given = T.StructType([group, T.StructField("block", T.IntegerType()), T.StructField("state", T.BinaryType()), T.StructField("part", T.BinaryType())])

    def started(batches):
        for b in batches:
            yield from stated(b.column("_g"), b.column("blocks"), [state(d) for d in b.column("distinct").to_pylist()])

    def stated(g: pa.Array, n_blocks: pa.Array, states: list[State]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([g, n_blocks, pa.array(map(pickle.dumps, states), pa.binary()), pa.array([s.phase == "done" for s in states])], names=["_g", "blocks", "state", "done"])

    def met(states: DataFrame) -> DataFrame:
        """Blocks with their group's state, of which there is a copy for so many blocks."""
        copies = states.select("_g", "state", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / BLOCKS_PER_STATE).cast("int"))).alias("salt"))
        return blocks.withColumn("salt", F.floor(F.col("block") / BLOCKS_PER_STATE).cast("int")).join(copies, ["_g", "salt"]).select("_g", "block", "points", "state")

    def stepped(batches):
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column("state")[i].as_py()
                x, n = points(b.column("points")[i])
                part = pickle.dumps(partial(x, n, pickle.loads(raw)))
                yield pa.RecordBatch.from_arrays([b.column("_g").slice(i, 1), pa.array([b.column("block")[i].as_py()], pa.int32()), pa.array([raw], pa.binary()), pa.array([part], pa.binary())], names=["_g", "block", "state", "part"])

    def sums(t: pa.Table) -> tuple[bytes, list]:
        t = t.sort_by("block")
        raw = t.column("state")[0].as_py()
        return raw, added([pickle.loads(p) for p in t.column("part").to_pylist()], pickle.loads(raw))

    def merged(t: pa.Table) -> pa.Table:
        raw, sum_ = sums(t)
        return pa.table([t.column("_g").slice(0, 1), pa.array([t.column("block")[0].as_py() // FAN_IN], pa.int32()), pa.array([raw], pa.binary()), pa.array([pickle.dumps(sum_)], pa.binary())], names=["_g", "block", "state", "part"])

    def stepped_on(t: pa.Table) -> pa.Table:
        raw, sum_ = sums(t)
        s = advanced(pickle.loads(raw), sum_)
        return pa.table([t.column("_g").slice(0, 1), pa.array([pickle.dumps(s)], pa.binary()), pa.array([s.phase == "done"])], names=["_g", "state", "done"])

    def last(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield told(b, i, labels_of(points(b.column("points")[i])[0], pickle.loads(b.column("state")[i].as_py())))

    n_blocks = materialize(blocks.groupBy("_g", "blocks").agg(F.max("distinct").alias("distinct")), "kmeans-groups")
    states = materialize(n_blocks.mapInArrow(started, kept), "kmeans-states")
    while not (alive := states.where("not done")).isEmpty():
        parts = met(alive).mapInArrow(stepped, given)
        for _ in range(levels):
            parts = parts.groupBy("_g", F.floor(F.col("block") / FAN_IN).alias("_at")).applyInArrow(merged, given)
        on = parts.groupBy("_g").applyInArrow(stepped_on, T.StructType([f for f in kept if f.name != "blocks"]))
        states = materialize(on.join(n_blocks.select("_g", "blocks"), "_g").select(*kept.names).unionByName(states.where("done")), "kmeans-states")
    return met(states).mapInArrow(last, schema)
