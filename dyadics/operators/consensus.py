"""Utilities, deltas of several models, and how they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codes import bin_of
from .ordered import percentiles, range_of


def with_utilities(cases: DataFrame, utilities: DataFrame, missing: str = "null") -> DataFrame:
    """``cases`` (x_num, y_num, i, j, k, l) with u_x and u_y from ``utilities`` (idx, a1, a2, utility).

    ``missing``: 'null' keeps cases without a utility, 'skip' drops them, 'error' fails as they are read. The utility table
    has nine rows a good; it is joined by hash, broadcast if Spark's own size estimate allows it.
    """
    if missing not in ("null", "skip", "error"):
        raise ValueError("missing is 'null', 'skip' or 'error'")
    how = "inner" if missing == "skip" else "left"
    out = cases
    for side, good, a, b in (("u_x", "x_num", "i", "j"), ("u_y", "y_num", "k", "l")):
        table = utilities.select(F.col("idx").alias(good), F.col("a1").alias(a), F.col("a2").alias(b), F.col("utility").alias(side))
        out = out.join(table, [good, a, b], how)
    if missing == "error":
        for side in ("u_x", "u_y"):
            out = out.withColumn(side, F.coalesce(F.col(side), F.raise_error(F.lit(f"no utility for {side}")).cast("double")))
    return out


def biased_deltas(rows: DataFrame, lam: float, eta: float, digits: int = 4) -> DataFrame:
    """``rows`` (u_x, u_y) with delta_x and delta_y as an owner sees them, and delta_tilde_x and delta_tilde_y without the bias."""
    x, y = F.col("u_x"), F.col("u_y")
    seen = {"delta_x": eta + (1 + lam) * x - y, "delta_y": eta + (1 + lam) * y - x, "delta_tilde_x": x - y, "delta_tilde_y": y - x}
    return rows.withColumns({n: F.bround(c, digits) for n, c in seen.items()})


def utility_grid(alpha: DataFrame, beta: DataFrame, spec: int = 1, gamma: float = 0.0) -> DataFrame:
    """idx, a1, a2, utility of all goods (idx, alpha) and profiles (a1, a2, beta); a missing parameter counts as 0."""
    u = F.coalesce("alpha", F.lit(0.0)), F.coalesce("beta", F.lit(0.0))
    both, apart = F.exp(u[0] + u[1]), F.exp(u[0]) + F.exp(u[1])
    value = {1: both, 2: apart, 3: both + gamma * apart}[spec]
    # profiles are nine at most: each good is taken nine times, not joined
    profiles = beta.agg(F.collect_list(F.struct("a1", "a2", "beta")).alias("_profiles"))
    rows = alpha.crossJoin(F.broadcast(profiles)).select("idx", "alpha", F.explode("_profiles").alias("_p")).select("idx", "alpha", "_p.*")
    return rows.select("idx", "a1", "a2", value.alias("utility"))


def consensus(deltas: DataFrame, key: str, model: str, delta: str) -> DataFrame:
    """Of each case: models, mean_delta, spread (greatest less least), unanimous_sign; zeros have no sign."""
    signs = F.count_if(F.col(delta) > 0), F.count_if(F.col(delta) < 0)
    return deltas.groupBy(key).agg(F.count_distinct(model).alias("models"), F.avg(delta).alias("mean_delta"), (F.max(delta) - F.min(delta)).alias("spread"), ((signs[0] == 0) | (signs[1] == 0)).alias("unanimous_sign"))


def sign_agreement(rows: DataFrame, a: str, b: str, edges: list[float]) -> DataFrame:
    """bucket of |a| (open on the left; null: all), n, agreement of signs; |a| under 1e-9 and b = 0 are left out."""
    ok = rows.where((F.abs(a) >= 1e-9) & (F.col(b) != 0)).select((F.signum(a) == F.signum(b)).cast("double").alias("same"), bin_of(F.abs(a), edges, "right").alias("bucket"))
    return ok.rollup("bucket").agg(F.count("*").alias("n"), F.avg("same").alias("agreement"), F.grouping("bucket").alias("_all")).where("_all = 1 OR bucket IS NOT NULL").drop("_all")


def moments(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean_abs, rms, median (exact), population sd, least and greatest of |value| and value, of each group."""
    v = F.col(value)
    plain = rows.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(F.abs(v)).alias("mean_abs"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.stddev_pop(F.abs(v)).alias("sd_abs"),
        F.min(v).alias("least"),
        F.max(v).alias("greatest"),
    )
    return plain.join(percentiles(rows.select(*by, F.abs(v).alias("_size")), by, "_size", {"median_abs": 0.5}), by, "left")


def mass_by_bin(rows: DataFrame, value: str, edges: list[float], closed: str = "right") -> DataFrame:
    """bin, n, share of cases and share of |value|."""
    bins = rows.select(F.abs(value).alias("_v")).withColumn("bin", bin_of(F.col("_v"), edges, closed)).where("bin IS NOT NULL")
    sums = bins.groupBy("bin").agg(F.count("*").alias("n"), F.sum("_v").alias("mass"))
    total = Window.partitionBy(F.lit(1))  # one row a bin
    return sums.select("bin", "n", (F.col("n") / F.sum("n").over(total)).alias("case_share"), (F.col("mass") / F.sum("mass").over(total)).alias("mass_share"))


def nearest_rank(values: Column, p: float) -> Column:
    """Element floor(p * n) of an ascending array, the last at most: the nearest-rank quantile."""
    return F.element_at(values, F.least(F.floor(F.size(values) * p).cast("int") + 1, F.size(values)))


def nearest_rank_quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """share, value: nearest-rank quantiles without gathering the values: counts by value range, then ranks in the ranges hit."""
    spark, total = rows.sparkSession, rows.agg(F.count(value)).first()[0]
    if not total:
        return spark.createDataFrame([], "share double, value double")
    ranged = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"), range_of(rows, value).alias("part")).groupBy("part", "value").agg(F.count("*").alias("n"))
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a range, some thousands
    wanted, before = [], 0
    for p in sorted(counts):
        here = counts[p]
        for s in shares:
            at = min(int(s * total), total - 1)
            if before <= at < before + here:
                wanted.append((s, p, at - before + 1))
        before += here
    table = spark.createDataFrame(wanted, "share double, part int, place long")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.where(F.col("part").isin(sorted({w[1] for w in wanted}))).withColumn("upto", upto)
    hit = (F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("n"))
    return placed.join(F.broadcast(table), "part").where(hit).select("share", "value")


def modal(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equal counts the one that came first."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias("modal"), F.sum("_n").alias("n"))


def simpson_flip(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Chance that two different rows of a group differ in ``value``; 0 for a single row."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    n, same = F.sum("_c"), F.sum(F.col("_c") * (F.col("_c") - 1))
    return counts.groupBy(*by).agg(n.alias("n"), F.when(n < 2, 0.0).otherwise(1 - same / (n * (n - 1))).alias("flip"))


def axis_means(rows: DataFrame, axes: list[str], value: str) -> DataFrame:
    """axis, level, n, mean: one pass over the rows, unpivoted by a map."""
    spread = rows.select(value, F.explode(F.create_map(*(x for a in axes for x in (F.lit(a), F.col(a).cast("string"))))).alias("axis", "level"))
    return spread.groupBy("axis", "level").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def anchors(rows: DataFrame, key: str, p: str, margin: float = 0.1, agree: float = 0.75) -> DataFrame:
    """Of each case: n, p_x (mean, 4 digits), agree (share on the mean's side, 3 digits), pref 'X', 'Y' or null if unstable."""
    mean = rows.groupBy(key).agg(F.avg(p).alias("_mean"), F.count("*").alias("n"), F.avg((F.col(p) > 0.5).cast("double")).alias("_above"))
    side = F.when(F.col("_mean") > 0.5, F.col("_above")).otherwise(1 - F.col("_above"))
    stable = (F.abs(F.col("_mean") - 0.5) > margin) & (side >= agree)
    return mean.select(key, "n", F.bround("_mean", 4).alias("p_x"), F.bround(side, 3).alias("agree"), F.when(stable, F.when(F.col("_mean") > 0.5, "X").otherwise("Y")).alias("pref"))
