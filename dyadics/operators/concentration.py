"""Inequality and spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import counted


def gini(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, total, gini of each group, by the identity on ascending ranks; equal values add up in one term."""
    v, n = F.col(value), F.col("n")
    term = v * n * (2 * F.col("before") + n - F.col("total"))
    per = counted(rows, by, value).select(*by, n, (v * n).alias("_v"), term.alias("_t"))
    return per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("_v").alias("total"), (F.sum("_t") / (F.sum("n") * F.sum("_v"))).alias("gini"))


def top_share(rows: DataFrame, by: list[str], value: str, k: int, fraction: float) -> DataFrame:
    """Shares of the total that the k greatest and the greatest ``fraction`` (rounded up) hold; ties do not matter."""
    above = F.col("total") - F.col("before") - F.col("n")
    taken = lambda most: F.greatest(F.least(F.col("n"), most - above), F.lit(0))
    v = F.col(value)
    per = counted(rows, by, value).select(*by, (v * F.col("n")).alias("_v"), (v * taken(F.lit(k))).alias("_k"), (v * taken(F.ceil(F.col("total") * fraction))).alias("_f"))
    return per.groupBy(*by).agg((F.sum("_k") / F.sum("_v")).alias("top_k_share"), (F.sum("_f") / F.sum("_v")).alias("top_fraction_share"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def energies(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("double") * v.cast("double"))


def stable_rank(values: Column) -> Column:
    """Sum of squared singular values over the greatest."""
    e = energies(values)
    return F.try_divide(_sum(e), F.array_max(e))


def entropy_rank(values: Column) -> Column:
    """exp of the entropy of the energy shares."""
    e = energies(values)
    total = _sum(e)
    return F.exp(-_sum(F.transform(e, lambda x: F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))))


def energy_kept(values: Column, r: int) -> Column:
    """Share of energy in the r greatest."""
    e = F.sort_array(energies(values), asc=False)
    return F.try_divide(_sum(F.slice(e, 1, r)), _sum(e))


def rank_for_energy(values: Column, share: float) -> Column:
    """The least rank whose energies reach ``share`` of all."""
    e = F.sort_array(energies(values), asc=False)
    cut = _sum(e) * share
    steps = F.aggregate(e, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("r")), lambda a, x: F.when(a["s"] < cut, F.struct((a["s"] + x).alias("s"), (a["r"] + 1).alias("r"))).otherwise(a))
    return steps["r"]
