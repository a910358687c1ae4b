"""Small conversions of recorded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(value: Column, digits: int = 1) -> Column:
    """A share as text in percent, '-' for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), "-").otherwise(F.format_string(f"%.{digits}f%%", value * 100))


def completion_text(completion: Column) -> Column:
    """Text of a completion recorded as JSON: a string, an object with ``content``, or a list whose last item is either."""
    as_list = F.from_json(completion, "array<string>")
    last = F.when(completion.rlike(r"^\s*\["), F.coalesce(F.get(as_list, F.size(as_list) - 1), F.lit(""))).otherwise(completion)
    inner = F.when(last.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(last, "$.content"), F.lit("")))
    plain = F.when(last.rlike(r'^\s*".*"\s*$'), F.get(F.from_json(F.concat(F.lit("["), last, F.lit("]")), "array<string>"), F.lit(0)))
    return F.coalesce(inner, plain, last)


def preferred_good(delta: Column, x: Column, y: Column) -> Column:
    """x for a delta above 0, else y."""
    return F.when(delta > 0, x).otherwise(y)


def significant(value: Column, digits: int = 6) -> Column:
    """A number with so many significant digits; what is not finite stays."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.format_string(f"%.{digits - 1}e", value).cast("double")).otherwise(value)


def canonical_deviation(value: Column, floor: float = 1e-12) -> Column:
    """0 below the floor, else six significant digits: equal on all machines."""
    return F.when(F.abs(value) < floor, 0.0).otherwise(significant(value))


def json_safe(value: Column) -> Column:
    """Null in place of NaN and infinite numbers."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def first_of(fields: Column, names: tuple[str, ...]) -> Column:
    """The number under the first of some names that a map of strings has; null if none is a number."""
    return F.coalesce(*(F.try_element_at(fields, F.lit(n)) for n in names)).try_cast("double")


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a, b)


def interval_ends(estimate: Column, error: Column, z: float = 1.96) -> Column:
    """Struct (low, high) of a normal interval."""
    return F.struct((estimate - z * error).alias("low"), (estimate + z * error).alias("high"))


def wald_diagonal(a: Column, a_error: Column, b: Column, b_error: Column) -> Column:
    """Distance from 0 in units of the errors, as if the two were uncorrelated; a part without an error counts 0."""
    part = lambda x, e: F.when(e != 0, x / F.nullif(e, F.lit(0.0))).otherwise(0.0)
    return F.hypot(part(a, a_error), part(b, b_error))
