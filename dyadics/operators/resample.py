"""Bootstraps and jackknives by clusters, with a counter-based generator.

Replicates are made from cluster sums, never from rows: a draw names a cluster by its place, and the sums of the drawn
clusters are added up. The draws of all replicates are spread over the cluster; clusters are joined by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import hash_draw, hash_uniforms
from .ordered import places


def clusters(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """ix (0, 1, ... in the order of ``by``), by, value_sum, value_count of each cluster."""
    sums = rows.groupBy(*by).agg(F.sum(value).alias("value_sum"), F.count(value).alias("value_count"))
    return places(sums, by).select("ix", *by, "value_sum", "value_count")


def mean_replicates(sums: DataFrame, n_clusters: int, reps: int, seed: int, slots: int | None = None) -> DataFrame:
    """rep, estimate: the ratio of summed values to summed counts of ``slots`` (all by default) drawn clusters."""
    spark, slots = sums.sparkSession, slots or n_clusters
    draws = spark.range(reps * slots).select((F.floor(F.col("id") / slots)).cast("long").alias("rep"), F.pmod("id", F.lit(slots)).alias("slot"))
    draws = draws.select("rep", hash_draw(n_clusters, seed, F.col("rep"), F.col("slot")).alias("ix"))
    weights = draws.groupBy("rep", "ix").agg(F.count("*").alias("w"))
    return weights.join(sums, "ix").groupBy("rep").agg((F.sum(F.col("w") * F.col("value_sum")) / F.sum(F.col("w") * F.col("value_count"))).alias("estimate"))


def equally_weighted(sums: DataFrame) -> DataFrame:
    """Clusters that count alike, whatever their sizes: replicates then average the clusters' means."""
    return sums.withColumns({"value_sum": F.col("value_sum") / F.col("value_count"), "value_count": F.lit(1)})


#: Draws of a replicate that a row of the plan stands for.
DRAWS_A_ROW = 1 << 18


def item_replicates(rows: DataFrame, value: str, reps: int, seed: int) -> DataFrame:
    """rep, estimate: means of as many items as there are, drawn with replacement. For values of few kinds, as differences of right answers.

    A draw is a place among the items in the order of their values. Where each value ends is a table of a row a kind, turned
    into bounds of the generator's numbers, so that tasks count the numbers below each bound and exchange these counts.
    """
    kinds = sorted((float(r[value]), r["n"]) for r in rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).collect())
    n = sum(c for _, c in kinds)
    if not n:
        return rows.sparkSession.createDataFrame([], "rep long, estimate double")
    bounds, upto = [], 0
    for _, c in kinds:
        upto += c
        bounds.append(_first_number(upto, n))
    blocks = -(-n // DRAWS_A_ROW)

    def drawn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in part["id"].tolist():
                rep, block = divmod(at, blocks)
                below = np.zeros(len(bounds), dtype=np.int64)
                for numbers in hash_uniforms(f"{seed}:{rep}:", block * DRAWS_A_ROW, min(n, (block + 1) * DRAWS_A_ROW)):
                    below += [np.count_nonzero(numbers < b) if b < 2**32 else len(numbers) for b in bounds]
                count = np.diff(below, prepend=0)
                yield pd.DataFrame({"rep": rep, "kind": np.arange(len(bounds)), "count": count})

    spark = rows.sparkSession
    many = spark.range(reps * blocks, numPartitions=min(reps * blocks, 4 * spark.sparkContext.defaultParallelism))
    found = F.element_at(F.array(*(F.lit(x) for x, _ in kinds)), F.col("kind") + 1)
    counts = many.mapInPandas(drawn, "rep long, kind int, count long")
    return counts.groupBy("rep").agg((F.sum(found * F.col("count")) / F.lit(float(n))).alias("estimate"))


def _first_number(place: int, n: int) -> int:
    """The least number of ``hash_uniform`` whose draw of ``n`` is ``place`` or more, by the same arithmetic in doubles; 2**32 if none is."""
    low, high = 0, 2**32
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if float(middle * n) / 2.0**32 >= place else (middle + 1, high)
    return low


#: Distinct values that one task draws counts of, about.
VALUES_A_GROUP = 4_096
_BLOCK = 250


def count_replicates(rows: DataFrame, value: str, reps: int, seed: int) -> DataFrame:
    """rep, estimate: means of as many items as there are, drawn with replacement, at a cost that rows do not enter.

    How often a replicate draws each distinct value is multinomial. The values are dealt into groups: a replicate first
    draws how many items come from each group, then each group, in its own task, how many of these are of each value. Both
    are exact draws by conditional binomials, so the law is that of drawing items one by one. Null values are no items;
    without items there are no replicates.
    """
    kinds = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    groups = 1 + kinds.count() // VALUES_A_GROUP
    kinds = kinds.withColumn("group", F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int"))
    sizes = sorted((r["group"], r["n"]) for r in kinds.groupBy("group").agg(F.sum("n").alias("n")).collect())  # one row VALUES_A_GROUP values
    n = sum(c for _, c in sizes)
    if not n:
        return rows.sparkSession.createDataFrame([], "rep long, estimate double")
    names, share = [g for g, _ in sizes], np.array([c for _, c in sizes]) / n

    def dealt(parts):
        for part in parts:
            for rep in part["id"]:
                drawn = np.random.default_rng([seed, int(rep)]).multinomial(n, share)
                yield pd.DataFrame({"rep": int(rep), "group": names, "drawn": drawn})

    def of_group(key: tuple, own: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        own, drawn = own.sort_values("v"), drawn.sort_values("rep")
        draw, v = np.random.default_rng([seed, 1 + int(key[0]), 7]), own["v"].to_numpy()
        share = own["n"].to_numpy() / own["n"].sum()
        totals = [draw.multinomial(drawn["drawn"].to_numpy()[a : a + _BLOCK], share) @ v for a in range(0, len(drawn), _BLOCK)]
        return pd.DataFrame({"rep": drawn["rep"].to_numpy(), "total": np.concatenate(totals)})

    draws = rows.sparkSession.range(reps).mapInPandas(dealt, "rep long, group int, drawn long")
    sums = kinds.groupBy("group").cogroup(draws.groupBy("group")).applyInPandas(of_group, "rep long, total double")
    return sums.groupBy("rep").agg((F.sum("total") / F.lit(n)).alias("estimate"))


def interval(replicates: DataFrame, alpha: float = 0.05) -> DataFrame:
    """reps, mean, sd and the percentile interval of the estimates."""
    return replicates.agg(
        F.count("estimate").alias("reps"),
        F.avg("estimate").alias("mean"),
        F.stddev_samp("estimate").alias("sd"),
        F.percentile("estimate", F.lit(alpha / 2)).alias("low"),
        F.percentile("estimate", F.lit(1 - alpha / 2)).alias("high"),
    )


def jackknife(sums: DataFrame) -> DataFrame:
    """clusters, mean, variance of a ratio by leaving one cluster out: totals less the cluster, never a second scan."""
    total = sums.agg(F.sum("value_sum").alias("_s"), F.sum("value_count").alias("_c"), F.count("*").alias("_g"))
    left = sums.crossJoin(F.broadcast(total)).select(((F.col("_s") - F.col("value_sum")) / (F.col("_c") - F.col("value_count"))).alias("e"), "_g")
    return left.agg(F.count("*").alias("clusters"), F.avg("e").alias("mean"), ((F.count("*") - 1) * F.var_pop("e")).alias("variance"))


def leave_one_good_out(rows: DataFrame, a: str, b: str, sums: list[str]) -> DataFrame:
    """good and the sums over all rows that do not touch it: totals less the rows of either side (a differs from b)."""
    touched = rows.select(F.explode(F.array(F.col(a), F.col(b))).alias("good"), *sums).groupBy("good").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    total = rows.agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    return touched.crossJoin(F.broadcast(total)).select("good", *((F.col(f"_t_{c}") - F.col(f"_{c}")).alias(c) for c in sums))
