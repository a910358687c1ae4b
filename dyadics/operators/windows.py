"""Windows over a step clock: smoothing, adjacent rows, ranks, shares and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import blocks, counted, offsets


def _number(value: str) -> Column:
    return F.when(~F.isnan(value), F.col(value))


def trailing_mean(rows: DataFrame, by: list[str], order: list[str], value: str, width: int, out: str = "smoothed", guard: bool = False) -> DataFrame:
    """Mean of the last ``width`` values, fewer at the start; NaN is skipped. With ``guard`` shorter curves stay as they are."""
    mean = F.avg(_number(value)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0))
    if guard:
        mean = F.when(F.count("*").over(Window.partitionBy(*by)) < width, F.col(value)).otherwise(mean)
    return rows.withColumn(out, mean)


def centred_mean(rows: DataFrame, by: list[str], order: list[str], value: str, width: int = 5, out: str = "smoothed") -> DataFrame:
    """Mean of the ``width`` values about each row, fewer at the ends; curves shorter than ``width`` stay as they are."""
    half = width // 2
    mean = F.avg(_number(value)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, width - 1 - half))
    return rows.withColumn(out, F.when(F.count("*").over(Window.partitionBy(*by)) < width, F.col(value)).otherwise(mean))


def last_mean(rows: DataFrame, by: list[str], order: list[str], value: str, n: int = 20) -> DataFrame:
    """Mean of each group's last ``n`` values."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).groupBy(*by).agg(F.avg(value).alias("last_mean"), F.count("*").alias("n"))


def monotonicity(rows: DataFrame, curve: list[str], order: list[str], value: str, hard: str, slack: float = 1e-12) -> DataFrame:
    """One row: counts and rates of falls between neighbours and of Yes before No, by transition and by curve."""
    w = Window.partitionBy(*curve).orderBy(*order)
    steps = rows.select(*curve, F.lag(value).over(w).alias("_v"), F.col(value).alias("_now"), F.lag(hard).over(w).alias("_h"), F.col(hard).alias("_hard"))
    per = steps.groupBy(*curve).agg(
        F.count("_v").alias("transitions"),
        F.count_if(F.col("_now") + slack < F.col("_v")).alias("falls"),
        F.count_if((F.lower("_h") == "yes") & (F.lower("_hard") == "no")).alias("hard_falls"),
    )
    rate = lambda a, b: F.when(b > 0, a.cast("double") / b)
    t = F.sum("transitions")
    return per.agg(
        F.count("*").alias("curve_count"),
        t.alias("adjacent_transitions"),
        F.sum("falls").alias("probability_violation_count"),
        rate(F.sum("falls"), t).alias("probability_violation_rate"),
        F.sum("hard_falls").alias("hard_choice_violation_count"),
        rate(F.sum("hard_falls"), t).alias("hard_choice_violation_rate"),
        rate(F.count_if(F.col("falls") > 0), F.count("*")).alias("nonmonotonic_probability_curve_rate"),
        rate(F.count_if(F.col("hard_falls") > 0), F.count("*")).alias("nonmonotonic_hard_choice_curve_rate"),
    )


def first_differences(rows: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Second minus first of groups of exactly two rows; other groups have ``pairs_ok`` false and null differences."""
    agg = [F.count("*").alias("n")]
    for v in values:
        agg += [F.min_by(v, order).alias(f"_a_{v}"), F.max_by(v, order).alias(f"_b_{v}")]
    out = rows.groupBy(*by).agg(*agg)
    ok = F.col("n") == 2
    return out.select(*by, ok.alias("pairs_ok"), *(F.when(ok, F.col(f"_b_{v}") - F.col(f"_a_{v}")).alias(f"d_{v}") for v in values))


def average_rank(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1 in ascending order; equal values share the mean of theirs. A null value has no rank."""
    ranks = counted(rows, by, value).select(*by, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    return rows.join(ranks, [*by, value], "left")


def rank_correlation(rows: DataFrame, by: list[str], a: str, b: str, out: str = "spearman") -> DataFrame:
    """by and Spearman's correlation of ``a`` and ``b`` with average ranks, each among all rows of the group that have it.

    Rows of equal values are one row with their number after a single exchange; the ranks are joined to these.
    """
    pairs = rows.groupBy(*by, a, b).agg(F.count("*").alias("_many"))

    def about_middle(value: str, name: str) -> DataFrame:
        rank = F.col("before") + (F.col("n") + 1) / 2.0
        return counted(pairs, by, value, "_many").select(*by, value, (rank - (F.col("total") + 1) / 2.0).alias(name))

    ranked = pairs.join(about_middle(a, "_x"), [*by, a], "left").join(about_middle(b, "_y"), [*by, b], "left")
    x, y = F.col("_x"), F.col("_y")
    w = F.when(x.isNotNull() & y.isNotNull(), F.col("_many"))
    total = lambda c: F.sum(w * c)
    sums = ranked.groupBy(*by).agg(F.sum(w).alias("_n"), total(x).alias("_sx"), total(y).alias("_sy"), total(x * x).alias("_xx"), total(y * y).alias("_yy"), total(x * y).alias("_xy"))
    part = lambda s, one, two: F.col(s) - F.col(one) * F.col(two) / F.col("_n")
    rho = F.try_divide(part("_xy", "_sx", "_sy"), F.sqrt(part("_xx", "_sx", "_sx")) * F.sqrt(part("_yy", "_sy", "_sy")))
    return sums.select(*by, rho.alias(out))


def cumulative_share(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """rank by descending value (ties by ``tie``) and the share of the total up to it."""
    blocked = blocks(rows.withColumn("_one", F.lit(1)), by, value)
    start = offsets(blocked, by, {"_rows": "_one", "_sum": value}, descending=True)
    total = rows.groupBy(*by).agg(F.sum(value).alias("_total"))
    w = Window.partitionBy(*by, "_block").orderBy(F.desc(value), tie)
    held = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = blocked.withColumns({"_r": F.row_number().over(w), "_h": held}).join(start, [*by, "_block"]).join(total, by)
    return out.select(*rows.columns, (F.col("_rows") + F.col("_r")).cast("int").alias("rank"), ((F.col("_sum") + F.col("_h")) / F.col("_total")).alias("cum_share"))


def step_audit(rows: DataFrame, run: str, step: str, value: str, every: int) -> DataFrame:
    """Of each run: rows, distinct and duplicate steps, steps missing between first and last, non-finite values."""
    bad = F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    per = rows.groupBy(run, step).agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad"))
    return per.groupBy(run).agg(
        F.sum("_n").alias("rows"),
        F.count("*").alias("steps"),
        F.count_if(F.col("_n") > 1).alias("duplicate_steps"),
        ((F.max(step) - F.min(step)) / every + 1 - F.count("*")).cast("long").alias("missing_steps"),
        F.sum("_bad").alias("non_finite"),
    )


def missing_steps(rows: DataFrame, run: str, step: str, every: int) -> DataFrame:
    """run, step: the steps on the grid between a run's first and last that it lacks. Gaps are filled from neighbours."""
    w = Window.partitionBy(run).orderBy(step)
    gaps = rows.select(run, F.col(step)).distinct().withColumn("_next", F.lead(step).over(w)).where(F.col("_next") - F.col(step) > every)
    return gaps.select(run, F.explode(F.sequence(F.col(step) + every, F.col("_next") - every, F.lit(every))).alias(step))


def describe_run(rows: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """First, last, least and greatest value with their steps, and the largest one-step rise."""
    w = Window.partitionBy(run).orderBy(step)
    good = rows.where(~F.isnan(value)).withColumn("_rise", F.col(value) - F.lag(value).over(w))
    return good.groupBy(run).agg(
        F.count("*").alias("n"),
        F.min_by(value, step).alias("first"),
        F.max_by(value, step).alias("last"),
        F.min(value).alias("least"),
        F.min_by(step, F.struct(F.col(value), F.col(step))).alias("least_at"),
        F.max(value).alias("greatest"),
        F.max_by(step, F.struct(F.col(value), -F.col(step))).alias("greatest_at"),
        F.max("_rise").alias("largest_rise"),
    )
