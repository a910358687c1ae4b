"""Two perspectives of a case as one row, with the integrity rules of the join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("X", "Y")


def wide(rows: DataFrame, key: str, side: str, values: list[str]) -> DataFrame:
    """One row a key: each value as ``value_x`` and ``value_y``, and the counts ``rows_x`` and ``rows_y``.

    One aggregate by key, combined before the exchange; with several rows of a side the least struct is taken.
    """
    pick = [F.min(F.when(F.col(side) == s, F.struct(*values))).alias(f"_{s}") for s in SIDES]
    count = [F.count_if(F.col(side) == s).alias(f"rows_{s.lower()}") for s in SIDES]
    out = rows.groupBy(key).agg(*pick, *count)
    return out.select(key, *(F.col(f"_{s}")[v].alias(f"{v}_{s.lower()}") for v in values for s in SIDES), "rows_x", "rows_y")


def rules(same: list[str], required: list[str]) -> list[tuple[str, Column]]:
    """(name, condition that breaks it): one row a side, equal metadata, required values."""
    out = [("duplicate", (F.col("rows_x") > 1) | (F.col("rows_y") > 1)), ("missing_x", F.col("rows_x") == 0), ("missing_y", F.col("rows_y") == 0)]
    both = (F.col("rows_x") > 0) & (F.col("rows_y") > 0)
    out += [(f"mismatch_{c}", both & ~F.col(f"{c}_x").eqNullSafe(F.col(f"{c}_y"))) for c in same]
    out += [(f"no_{c}", both & (F.col(f"{c}_x").isNull() | F.col(f"{c}_y").isNull())) for c in required]
    return out


def violations(pairs: DataFrame, key: str, broken: list[tuple[str, Column]]) -> DataFrame:
    """key, rule: a row for each rule that a pair breaks."""
    names = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in broken)))
    return pairs.select(key, F.explode(names).alias("rule"))


def joined(rows: DataFrame, key: str, side: str, values: list[str], same: list[str] | None = None, required: list[str] | None = None, mode: str = "strict") -> DataFrame:
    """Pairs without a broken rule ('inner'), or all pairs if no rule is broken, else an error as the rows are read ('strict')."""
    pairs = wide(rows, key, side, values)
    broken = rules(same or [], required or [])
    wrong = reduce(lambda a, b: a | b, (c for _, c in broken))
    if mode == "inner":
        return pairs.where(~wrong).drop("rows_x", "rows_y")
    if mode != "strict":
        raise ValueError("mode is 'strict' or 'inner'")
    first = reduce(lambda out, x: out.when(x[1], x[0]), broken[1:], F.when(broken[0][1], broken[0][0]))
    name = F.concat(first, F.lit(" at "), F.col(key).cast("string"))
    return pairs.withColumn(key, F.when(wrong, F.raise_error(name)).otherwise(F.col(key))).drop("rows_x", "rows_y")


def long(pairs: DataFrame, keep: list[str], swap: list[tuple[str, str]]) -> DataFrame:
    """Two rows a pair with ``perspective``; of each swapped couple (a, b), Y's row has b in a's place."""
    sides = [F.struct(F.lit(s).alias("perspective"), *(F.col(c).alias(a) for a, b in swap for a, c in ((a, a if s == "X" else b), (b, b if s == "X" else a)))) for s in SIDES]
    return pairs.select(*keep, F.explode(F.array(*sides)).alias("_side")).select(*keep, "_side.*")


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, missing_from ('left' or 'right'): ids that one side alone has. One aggregate over both id columns."""
    both = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    found = both.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a != _b")
    return found.select(key, F.when(F.col("_a") == 0, "left").otherwise("right").alias("missing_from"))


def aligned(rows: DataFrame, group: list[str], side: str, order: str, values: list[str]) -> DataFrame:
    """The g-th row of X next to the g-th of Y within each group, in the order of ``order``; the rest has nulls."""
    from pyspark.sql.window import Window

    numbered = rows.withColumn("slot", F.row_number().over(Window.partitionBy(*group, side).orderBy(order)))
    out = numbered.groupBy(*group, "slot").agg(*(F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{v}_{s.lower()}") for v in values for s in SIDES))
    return out
