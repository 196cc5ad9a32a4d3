"""Exact, interpolated quantiles of many groups, of groups of any size, with buffers that do not grow with the values.

``percentile`` keeps all distinct values of a group in one buffer. Here a mergeable sketch of each group gives a grid of values, and with it
a bracket that surely holds the wanted rank. One pass counts the rows below each bracket and, by value, those inside. Then rounds follow: a
sketch of the distinct values inside cuts them into about equal parts, counts say in which part the rank lies, and only that part goes on,
until one value is left. A round divides the values by about ``PARTS`` whatever their distribution and however many rows share a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstrata.functions.tables import materialize

GRID, PARTS = 200, 64
ACCURACY = 10  # a sketch is off by a tenth of a step of its grid at most


def exact_quantiles(rows: DataFrame, value: str | Column, probabilities: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``..., n, quantiles): how many values each group has, and its quantile at each probability, in their order, interpolated
    between neighbours.

    Cases: values are taken as doubles; nulls and NaN take no part, a group without others has no row; null is a group
    like any other; equal values count as often as they come; an empty table has no rows; no probabilities give empty arrays. A column may be
    called anything, but not ``n`` or ``quantiles`` if it is in ``by``. Raises ValueError for a probability outside 0 to 1."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("_all"))
    values = rows.select(group.alias("g"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("v"))
    values = values.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + F.lit(0.0))  # one zero
    grid = F.percentile_approx("v", F.array(*(F.lit(i / GRID) for i in range(GRID + 1))), F.lit(ACCURACY * GRID))
    groups = materialize(values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), grid.alias("grid")), "sketches")
    if not probabilities:
        return shown(groups.withColumn("quantiles", F.array().cast("array<double>")), by)
    brackets = groups.select("g", F.array(*(bracket(j, p) for j, p in enumerate(probabilities))).alias("targets"))
    met = values.join(brackets, "g") if by else values.join(F.broadcast(brackets.select("targets")))  # one row without groups
    met = met.select("g", "v", F.explode("targets").alias("t"))
    inside = F.when(F.col("v") >= F.col("t.low"), F.col("v"))  # null: below
    counts = met.where(F.col("v") <= F.col("t.high")).groupBy("g", F.col("t.j").alias("j"), inside.alias("v")).agg(F.count("*").alias("n"))
    counts = materialize(counts, "brackets")
    below = counts.where("v IS NULL").select("g", "j", F.col("n").alias("below"))
    targets = groups.select("g", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), rank(p).alias("r")) for j, p in enumerate(probabilities)))).alias("t")).select("g", "t.*")
    targets = targets.join(below, ["g", "j"], "left").select("g", "j", (F.col("r") - F.coalesce("below", F.lit(0))).alias("r"))
    left = materialize(counts.where("v IS NOT NULL").join(targets, ["g", "j"]), "inside")
    found = lower_values(left)
    after = left.drop("r").join(found, ["g", "j"])  # the rank after it: the same value again, or the next one inside
    upto = F.sum(F.when(F.col("v") <= F.col("low"), F.col("n")))
    after = after.join(targets.withColumnRenamed("r", "rank"), ["g", "j"]).groupBy("g", "j").agg(F.first("low").alias("low"), F.min(F.when(F.col("v") > F.col("low"), F.col("v"))).alias("next"), upto.alias("upto"), F.first("rank").alias("rank"))
    high = F.when(F.col("rank") + 1 < F.col("upto"), F.col("low")).otherwise(F.coalesce("next", "low"))
    pairs = after.select("g", F.struct("j", "low", high.alias("high")).alias("x")).groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("x"))  # one for each probability
    parts = [interpolated(F.col("x")[j]["low"], F.col("x")[j]["high"], place(p) - F.floor(place(p))) for j, p in enumerate(probabilities)]
    return shown(groups.select("g", "n").join(pairs, "g").withColumn("quantiles", F.array(*parts)), by)


def shown(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return rows.select(*(F.col("g").getField(c).alias(c) for c in by), "n", "quantiles")


def place(p: float) -> Column:
    return (F.col("n").cast("double") - 1) * p


def rank(p: float) -> Column:
    """The rank, from 0, at or just below the quantile."""
    return F.floor(place(p)).cast("long")


def bracket(j: int, p: float) -> Column:
    """(j, low, high): values between which ranks ``rank(p)`` and the next lie. Two steps of the grid on either side are more than a
    sketch's error and the next rank, where a step is several rows; of smaller groups all values are inside."""
    a, b = int(p * GRID) - 2, -int(-p * GRID // 1) + 2
    small = F.col("n") < 4 * GRID
    low = F.col("least") if a < 0 else F.when(small, F.col("least")).otherwise(F.col("grid")[a])
    high = F.col("most") if b > GRID else F.when(small, F.col("most")).otherwise(F.col("grid")[b])
    return F.struct(F.lit(j).alias("j"), low.alias("low"), high.alias("high"))


def lower_values(left: DataFrame) -> DataFrame:
    """(g, j, low): the value of rank r among left(g, j, v, n, r), whose v are distinct within (g, j)."""
    done, key = [], ["g", "j"]
    steps = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    while True:
        split = left.groupBy(*key).agg(F.percentile_approx("v", steps, F.lit(ACCURACY * PARTS)).alias("s"), F.min("v").alias("least"), F.max("v").alias("most"))
        split = materialize(split, "splits")
        done.append(split.where("least = most").select(*key, F.col("least").alias("low")))
        split = split.where("least < most").select(*key, "s")
        if split.isEmpty():
            break
        dealt = left.join(split, key).withColumn("part", F.size(F.filter("s", lambda x: x <= F.col("v"))))
        sizes = dealt.groupBy(*key, "part").agg(F.sum("n").alias("size"), F.first("r").alias("r"))  # PARTS rows a target at most
        before = F.sum("size").over(Window.partitionBy(*key).orderBy("part")) - F.col("size")
        chosen = sizes.withColumn("before", before).where("before <= r AND r < before + size").select(*key, "part", (F.col("r") - F.col("before")).alias("r"))
        left = materialize(dealt.select(*key, "part", "v", "n").join(chosen, [*key, "part"]).select(*key, "v", "n", "r"), "part")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share, as SQL's ``quantile_cont`` rounds it: the second product, then the sum with the exact first one."""
    between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share)  # gives a string that reads as the same double
    return F.when(share == 0, low).otherwise(between.cast("double"))
