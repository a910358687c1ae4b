"""Integrity audits: each gives a table of what is wrong, empty if nothing is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AuditError(ValueError):
    """Raised by ``require`` with the first findings."""


def require(findings: DataFrame, what: str, shown: int = 5) -> None:
    """Raises AuditError if there is any finding; names up to ``shown`` of them."""
    rows = findings.limit(shown).collect()
    if rows:
        raise AuditError(f"{what}: {[r.asDict() for r in rows]}")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, n of keys that come more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_texts(rows: DataFrame, text: str, ids: str) -> DataFrame:
    """text_key, n, first_id of texts that are equal once white space is single and case is lower."""
    key = F.sha2(F.encode(F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")), "UTF-8"), 256)
    return rows.where(F.col(text).isNotNull()).groupBy(key.alias("text_key")).agg(F.count("*").alias("n"), F.min(ids).alias("first_id")).where("n > 1")


def bad_cases(lists: DataFrame, goods: int, expected: int) -> DataFrame:
    """x, y, rule of case lists (x, y, codes): order, range, number of codes, their range and uniqueness, repeated pairs."""
    codes = F.col("codes")
    per = F.array_compact(
        F.array(
            F.when(~((F.col("x") >= 0) & (F.col("x") < F.col("y")) & (F.col("y") < goods)), F.lit("pair out of order or range")),
            F.when(F.size(codes) != expected, F.lit("number of codes")),
            F.when(~F.forall(codes, lambda c: c.between(0, 80)), F.lit("code out of range")),
            F.when(F.size(F.array_distinct(codes)) != F.size(codes), F.lit("repeated code")),
        )
    )
    again = lists.groupBy("x", "y").agg(F.count("*").alias("_n")).where("_n > 1").select("x", "y", F.lit("repeated pair").alias("rule"))
    return lists.select("x", "y", F.explode(per).alias("rule")).unionByName(again)


def differences(one: DataFrame, two: DataFrame, key: list[str], value: str, rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """key, kind ('left only', 'right only', 'value') of values that differ beyond the tolerances; NaN equals NaN."""
    a = one.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = two.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full_outer")
    close = F.col("_a").eqNullSafe(F.col("_b")) | (F.abs(F.col("_a") - F.col("_b")) <= F.greatest(rtol * F.greatest(F.abs("_a"), F.abs("_b")), F.lit(atol)))
    kind = F.when(F.col("_in_b").isNull(), "left only").when(F.col("_in_a").isNull(), "right only").when(~F.coalesce(close, F.lit(False)), "value")
    return both.select(*key, kind.alias("kind")).where("kind IS NOT NULL")


def infinite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n of infinite values, for columns that have any."""
    counts = rows.agg(*(F.count_if(F.abs(F.col(c)) == float("inf")).alias(c) for c in columns))
    return counts.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("column", "n")).where("n > 0")


def grid_cells(rows: DataFrame, cell: list[str], expected: int, key: str, p_yes: str, p_no: str) -> DataFrame:
    """cell, rule: cells of another number of rows, repeated ids, or probabilities that are no numbers."""
    bad = F.col(p_yes).isNull() | F.col(p_no).isNull() | F.isnan(p_yes) | F.isnan(p_no)
    per = rows.groupBy(*cell, key).agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad")).groupBy(*cell).agg(F.sum("_n").alias("_rows"), F.count_if(F.col("_n") > 1).alias("_again"), F.sum("_bad").alias("_bad"))
    names = F.array_compact(F.array(F.when(F.col("_rows") != expected, F.lit("rows")), F.when(F.col("_again") > 0, F.lit("repeated ids")), F.when(F.col("_bad") > 0, F.lit("probabilities"))))
    return per.select(*cell, F.explode(names).alias("rule"))
