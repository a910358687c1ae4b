"""Ranks and running sums of groups of any size: a group's values are cut into blocks, each ordered in a task of its own."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks that a group's values are cut into, and rows of a group whose values the cuts are found among.
PIECES, PICKED = 256, 2_048


def blocks(rows: DataFrame, by: list[str], value: str, pieces: int = PIECES) -> DataFrame:
    """``rows`` with ``_block``, ascending with ``value``; equal values share a block. The knots are one array a group.

    Knots are quantiles of the rows that a hash ranks first in each of PICKED parts of the group. Thus they do not depend on
    the order in which rows come, and a plan that finds them once for the rows and again for the blocks' sums has the same.
    """
    hashed = rows.select(*by, F.col(value).alias("_v"), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).alias("_hash"))
    picked = hashed.groupBy(*by, F.pmod("_hash", F.lit(PICKED)).alias("_part")).agg(F.min_by("_v", "_hash").alias("_v"))
    values = picked.groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("_values"))
    quantile = lambda i: F.floor(i * pieces / F.size("_values"))
    knots = values.select(*by, F.filter("_values", lambda _, i: (i > 0) & (quantile(i) > quantile(i - 1))).alias("_knots"))
    block = F.size(F.filter("_knots", lambda k: k < F.col(value)))
    return rows.join(knots, by).withColumn("_block", block).drop("_knots")


def offsets(blocked: DataFrame, by: list[str], sums: dict[str, str], descending: bool = False) -> DataFrame:
    """by, _block and for each ``name: column`` the sum over all earlier blocks of the group; PIECES rows a group."""
    per = blocked.groupBy(*by, "_block").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    order = F.desc("_block") if descending else F.asc("_block")
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*by, "_block", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums))


def counted(rows: DataFrame, by: list[str], value: str, many: str | None = None) -> DataFrame:
    """by, value, n (rows of the value), before (rows of lesser ones) and total (rows) of each distinct value of a group.

    A row stands for as many as its column ``many`` says, if it is given.
    """
    distinct = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(many) if many else F.count("*")).alias("n"))
    blocked = blocks(distinct, by, value)
    start = offsets(blocked, by, {"_start": "n"})
    total = distinct.groupBy(*by).agg(F.sum("n").alias("total"))
    within = Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(start, [*by, "_block"]).join(total, by)
    return out.select(*by, value, "n", (F.col("_start") + F.col("_in")).alias("before"), "total")


#: Sought values that are followed on the driver: two a group and share. Of more groups the values are ordered in blocks.
SOUGHT = 20_000
#: Rows in the parts that hold the sought ranks whose values are counted without cutting the parts further.
COUNTED_AT_ONCE = 1_000_000
#: Parts of an octave, and of what an octave's part spans, that values are counted by.
OCTAVE_PARTS, SPAN_PARTS = 1 << 10, 1 << 20


def _octave(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: the octave's part of its size, by sign; NaN is the greatest."""
    part = F.floor(F.log2(F.abs(v)) * OCTAVE_PARTS).cast("long") + 1_100 * OCTAVE_PARTS
    most = F.lit(1 << 40)
    return F.when(F.isnan(v), most + 1).when(v == float("inf"), most).when(v == float("-inf"), -most).when(v > 0, part).when(v < 0, -part).otherwise(F.lit(0))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and for each ``name: share`` the exact percentile with linear interpolation.

    Found by counting, with no exchange of values: first how many there are in each part of an octave, then in each small part
    of the parts that hold the sought ranks, last of each value in those. Of more than SOUGHT ranks over all groups the
    values are ordered in blocks instead; either way no task holds all values of a group, and the results are the same.
    """
    keys = by or ["_all"]
    v = (rows if by else rows.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + 0.0).alias("_v")).persist()
    try:
        found = _sought(v, keys, shares)
    finally:
        v.unpersist()
    if found is None:
        return _percentiles_in_blocks(rows, by, value, shares)

    def between(name: str) -> Column:
        lo, hi = (F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_v"))) for side in (0, 1))
        part = F.max(F.when(F.col("name") == name, F.col("part")))
        return F.when((part == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * part).alias(name)

    return found.groupBy(*keys).agg(*map(between, shares)).select(*by, *shares)


def _sought(v: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame | None:
    """keys, name, side (0 or 1: the lower or the upper rank), part, _v of the sought values; None if they are too many."""
    spark = v.sparkSession

    def picked(counts: DataFrame, partition: list[str], order: str, keep: list[str]) -> DataFrame:
        before = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        hit = (F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_n"))
        return placed.where(hit).select(*keys, "name", "side", "part", (F.col("rank") - F.col("_before")).alias("rank"), *keep)

    def local(table: DataFrame) -> pa.Table | None:
        some = table.limit(SOUGHT + 1).toArrow()
        return some if some.num_rows <= SOUGHT else None

    span = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    octaves = v.groupBy(*keys, _octave(F.col("_v")).alias("_o")).agg(*span)
    total = F.sum("_n").over(Window.partitionBy(*keys)) - 1
    ranks = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("side"), f(total * p).alias("rank"), (total * p - F.floor(total * p)).alias("part")) for n, p in shares.items() for s, f in ((0, F.floor), (1, F.ceil))))
    each = octaves.withColumn("_r", ranks).select(*keys, "_o", "_n", "_lo", "_hi", F.explode("_r").alias("_r")).select("*", "_r.*").drop("_r")
    first = local(picked(each, [*keys, "name", "side"], "_o", ["_o", "_n", "_lo", "_hi"]))
    if first is None:
        return None
    held = pa.compute.sum(first.column("_n")).as_py() or 0  # a part counts once for each rank in it
    first = spark.createDataFrame(first)
    if held <= COUNTED_AT_ONCE:
        values = v.withColumn("_o", _octave(F.col("_v"))).join(F.broadcast(first.select(*keys, "_o").distinct()), [*keys, "_o"]).groupBy(*keys, "_o", "_v").agg(F.count("*").alias("_n"))
        return spark.createDataFrame(local(picked(values.join(F.broadcast(first.drop("_n")), [*keys, "_o"]), [*keys, "name", "side"], "_v", ["_v"])))
    first = first.drop("_n")
    inside = F.broadcast(first.select(*keys, "_o", "_lo", "_hi").distinct())
    small_part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPAN_PARTS)).otherwise(F.lit(0)).alias("_p")
    in_octave = v.withColumn("_o", _octave(F.col("_v"))).join(inside, [*keys, "_o"]).select(*keys, "_o", small_part, "_v")
    spans = in_octave.groupBy(*keys, "_o", "_p").agg(F.count("*").alias("_n"))
    second = spark.createDataFrame(local(picked(spans.join(F.broadcast(first), [*keys, "_o"]), [*keys, "name", "side"], "_p", ["_o", "_p"])))
    values = in_octave.join(F.broadcast(second.select(*keys, "_o", "_p").distinct()), [*keys, "_o", "_p"]).groupBy(*keys, "_o", "_p", "_v").agg(F.count("*").alias("_n"))
    return spark.createDataFrame(local(picked(values.join(F.broadcast(second), [*keys, "_o", "_p"]), [*keys, "name", "side"], "_v", ["_v"])))


def _percentiles_in_blocks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """As ``percentiles``, for any number of groups, as one aggregate of the counts of ordered values."""
    keys = by or ["_all"]
    per = counted(rows if by else rows.withColumn("_all", F.lit(0)), keys, value)
    found = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * share
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
            found.append(F.max(F.when(held, F.col(value))).alias(f"_{side}_{name}"))
    out = per.groupBy(*keys).agg(F.max("total").alias("_n"), *found)
    part = lambda share: (F.col("_n") - 1) * share - F.floor((F.col("_n") - 1) * share)
    same = lambda n, s: (part(s) == 0) | (F.col(f"_lo_{n}") == F.col(f"_hi_{n}"))
    return out.select(*by, *(F.when(same(n, s), F.col(f"_lo_{n}")).otherwise(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * part(s)).alias(n) for n, s in shares.items()))


#: Knots of an order, and equal parts between two of them.
KNOTS = 64


def range_of(rows: DataFrame, value: str) -> Column:
    """Number of the range that holds ``value``; ranges ascend. Knots are approximate quantiles, so that an outlier stretches
    no range but the one that it is in; between two knots there are KNOTS parts of equal width."""
    knots = sorted(set(rows.select(F.percentile_approx(value, [i / KNOTS for i in range(KNOTS + 1)], 10_000)).first()[0] or []))
    if not knots:
        return F.lit(0)
    v, los = F.col(value).cast("double"), F.array(*(F.lit(float(k)) for k in knots))
    piece = F.greatest(F.size(F.filter(los, lambda k: k <= v)), F.lit(1))
    lo, hi = F.element_at(los, piece), F.element_at(los, F.least(piece + 1, F.lit(len(knots))))
    part = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * KNOTS)).otherwise(0)
    return (piece * KNOTS + F.least(F.greatest(part, F.lit(0)), F.lit(KNOTS - 1))).cast("int")


#: Keys that ``places`` looks at to cut its ranges, and the ranges.
SAMPLED_KEYS, KEY_RANGES = 4_096, 256


def places(rows: DataFrame, by: list[str], name: str = "ix") -> DataFrame:
    """``rows``, one a key, with ``name``: 0, 1, ... in the order of the columns ``by``, of any types that have an order.

    The keys are cut into ranges at those that a hash ranks first, and each range is ordered in a task of its own; only the
    ranges' sizes (KEY_RANGES rows) are ordered in one. Nulls come first.
    """
    key = F.struct(*by)
    hashed = rows.select(*by).orderBy(F.xxhash64(*by), *by).limit(SAMPLED_KEYS)
    some = hashed.orderBy(*by).collect()  # SAMPLED_KEYS rows at most
    step = max(1, len(some) // KEY_RANGES)
    knots = rows.sparkSession.createDataFrame([(some[step::step],)], f"_knots array<{rows.select(key.alias('k')).schema['k'].dataType.simpleString()}>")
    ranged = rows.crossJoin(F.broadcast(knots)).withColumn("_range", F.size(F.filter("_knots", lambda k: k <= key))).drop("_knots")  # one row of knots
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    out = ranged.withColumn("_within", within).join(F.broadcast(starts), "_range")
    return out.withColumn(name, (F.col("_start") + F.col("_within") - 1).cast("long")).drop("_range", "_within", "_start")
