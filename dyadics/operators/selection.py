"""Choosing a checkpoint from a complete grid, and verdicts over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = tuple(range(2_000, 30_001, 2_000))
CONSISTENCY_FLOOR, D_TOLERANCE, CONSISTENCY_TOLERANCE = 0.5, 0.05, 0.02


def finite_positive(value: str) -> Column:
    v = F.col(value)
    return F.coalesce(~F.isnan(v) & (v > 0) & (v < float("inf")), F.lit(False))


def candidates(rows: DataFrame, grid: tuple[int, ...] = GRID) -> DataFrame:
    """``rows`` (step, lambda, lambda_se, eta, eta_se, consistency) with d, on_grid, eligible and why not."""
    why = (
        F.when(~F.col("step").isin(*grid), "off grid")
        .when(F.col("consistency").isNull(), "no behavioral data")
        .when(F.col("consistency") < CONSISTENCY_FLOOR, "consistency below floor")
        .when(~finite_positive("lambda_se"), "lambda_se not finite and positive")
        .when(~finite_positive("eta_se"), "eta_se not finite and positive")
        .otherwise("")
    )
    return rows.withColumns({"d": F.hypot("lambda", "eta"), "on_grid": F.col("step").isin(*grid), "why": why}).withColumn("eligible", F.col("why") == "")


def missing(rows: DataFrame, by: list[str], grid: tuple[int, ...] = GRID) -> DataFrame:
    """Each group's steps of the grid that it lacks, as an array."""
    have = rows.groupBy(*by).agg(F.collect_set("step").alias("_have"))  # a set of steps: as long as a run's grid
    steps = F.array(*map(F.lit, grid))
    return have.select(*by, F.array_except(steps, F.transform("_have", lambda s: s.cast("int"))).alias("missing"))


def select(rows: DataFrame, by: list[str], grid: tuple[int, ...] = GRID) -> DataFrame:
    """One row a group: the selected step and why. Least d; within D_TOLERANCE of it the greatest consistency; within
    CONSISTENCY_TOLERANCE of that the least step. A group whose grid is not complete selects nothing.
    """
    cand = candidates(rows, grid)
    good = cand.where("eligible")
    best = good.groupBy(*by).agg(F.min("d").alias("_d"))
    near = good.join(best, by).where(F.abs(F.col("d") - F.col("_d")) < D_TOLERANCE)
    top = near.groupBy(*by).agg(F.max("consistency").alias("_c"))
    close = near.join(top, by).where(F.abs(F.col("consistency") - F.col("_c")) < CONSISTENCY_TOLERANCE)
    chosen = close.groupBy(*by).agg(F.min_by(F.struct("step", "d", "consistency"), "step").alias("_pick"))
    status = missing(cand.where("on_grid"), by, grid)
    groups = rows.select(*by).distinct().join(status, by, "left").join(chosen, by, "left")
    complete = F.coalesce(F.size("missing"), F.lit(len(grid))) == 0
    reason = F.when(~complete, "incomplete grid").when(F.col("_pick").isNull(), "no eligible checkpoint").otherwise("min d")
    return groups.select(*by, F.when(complete, F.col("_pick.step")).alias("selected_step"), F.when(complete, F.col("_pick.d")).alias("d"), reason.alias("reason"))


def bucketed_order(rows: DataFrame, keys: list[tuple[str, float, bool]], by: list[str]) -> DataFrame:
    """``rows`` with ``place`` by keys (column, tolerance, descending): values round to multiples of the tolerance, half to even."""
    from pyspark.sql.window import Window

    order = []
    for name, tolerance, descending in keys:
        key = F.bround(F.col(name) / tolerance, 0) if tolerance else F.col(name)
        order.append(key.desc() if descending else key.asc())
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def replication(checks: DataFrame, seed: str, names: list[str]) -> DataFrame:
    """seed, status of check columns that are true, false or null: PENDING with a null, else PASS or FAIL."""
    cols = [F.col(n) for n in names]
    pending, passed = cols[0].isNull(), cols[0]
    for c in cols[1:]:
        pending, passed = pending | c.isNull(), passed & c
    return checks.select(seed, F.when(pending, "PENDING").when(passed, "PASS").otherwise("FAIL").alias("status"))
