"""Case lists, unused codes, hash-ranked samples, balance checks and ordered batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codes import CODES, hash_rank_key, level
from .ordered import range_of


def numbered(rows: DataFrame, order: str, size: str, first: int = 1) -> DataFrame:
    """``rows`` with ``first_id``: ``first`` plus the sizes of all rows before, in the order of the whole-number ``order``.

    The order is cut into ranges, each summed in a task of its own; only the ranges' sums are ordered in one task.
    """
    ranged = rows.withColumn("_range", range_of(rows, order))
    sums = ranged.groupBy("_range").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return out.join(F.broadcast(starts), "_range").withColumn("first_id", F.col("_start") + F.col("_within") + first).drop("_range", "_start", "_within")


def cases(lists: DataFrame, order: str, codes: str = "codes") -> DataFrame:
    """One row a code with its running ``case_id``; lists are numbered in ``order``, codes by their place."""
    sized = numbered(lists.withColumn("_size", F.size(codes)), order, "_size")
    others = [c for c in lists.columns if c != codes]
    return sized.select(*others, "first_id", F.posexplode(codes).alias("pos", "code")).withColumn("case_id", F.col("first_id") + F.col("pos")).drop("first_id", "pos")


def unused_codes(used: DataFrame, pair: list[str], code: str = "code") -> DataFrame:
    """Each pair with the codes 0 to 80 that it has not used, one a row. One aggregate by pair; no join."""
    have = used.groupBy(*pair).agg(F.collect_set(code).alias("_have"))  # 81 codes at most
    every = F.sequence(F.lit(0), F.lit(CODES - 1))
    return have.select(*pair, F.explode(F.array_except(every, F.transform("_have", lambda c: c.cast("int")))).alias(code))


def ranked(rows: DataFrame, by: list[str], seed: str | int, key: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group by the SHA-256 of ``seed:key...``, with their ``rank``."""
    keyed = rows.withColumn("_key", hash_rank_key(str(seed), *(F.col(c) for c in key)))
    return keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_key", *key))).where(F.col("rank") <= n).drop("_key")


def code_counts(rows: DataFrame, code: str = "code") -> DataFrame:
    """code, n for all 81 codes, 0 where none."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(code).cast("int").alias("code")).agg(F.count("*").alias("n"))
    return spark.range(CODES).select(F.col("id").cast("int").alias("code")).join(F.broadcast(counts), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def balance(counts: DataFrame) -> DataFrame:
    """place (-1: the joint code; 0 to 3: a level), chi2 against equal counts, max_deviation relative to the mean."""
    parts = [counts.select(F.lit(-1).alias("place"), F.col("code").alias("value"), "n")]
    parts += [counts.select(F.lit(p).alias("place"), level(F.col("code"), p).alias("value"), "n") for p in range(4)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = rows.groupBy("place", "value").agg(F.sum("n").alias("n"))
    mean = sums.groupBy("place").agg(F.avg("n").alias("mean"))
    joined = sums.join(F.broadcast(mean), "place")
    return joined.groupBy("place").agg(F.sum((F.col("n") - F.col("mean")) ** 2 / F.col("mean")).alias("chi2"), F.max(F.abs(F.col("n") - F.col("mean")) / F.col("mean")).alias("max_deviation"))


def rotating_codes(pairs: DataFrame, index: str, shuffled: list[int], take: int) -> DataFrame:
    """Each pair's ``take`` codes: a window that rotates over one shuffled list."""
    table = F.array(*map(F.lit, shuffled))
    place = F.pmod(F.col(index) * take + F.col("offset"), F.lit(len(shuffled))).cast("int") + 1
    return pairs.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(take - 1)))).withColumn("code", F.element_at(table, place)).drop("offset")


def batches(pairs: DataFrame, key: str, seed: int, epoch: int, size: int, repeats: int, ranks: int = 1, blocks: int = 1_024) -> DataFrame:
    """Shuffled batches of whole pairs: rank, batch, slot, repeat; pairs that fill no batch on all ranks are left out.

    The shuffle is by hash, in ``blocks`` ranges of the hash that are ordered apart.
    """
    shuffled = pairs.withColumn("_h", hash_rank_key(seed + epoch, F.col(key))).withColumn("_block", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * blocks / 65536))
    counts = shuffled.groupBy("_block").agg(F.count("*").alias("_n"))
    starts = counts.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_h", key)) - 1
    out = shuffled.withColumn("_p", place).join(F.broadcast(starts), "_block").withColumn("_p", F.col("_p") + F.col("_start"))
    total = counts.agg(F.floor(F.sum("_n") / (size * ranks)).alias("_whole"))
    out = out.crossJoin(F.broadcast(total)).where(F.col("_p") < F.col("_whole") * size * ranks)
    out = out.withColumns({"batch": F.floor(F.col("_p") / (size * ranks)), "rank": F.pmod(F.col("_p"), F.lit(ranks)), "slot": F.floor(F.pmod(F.col("_p"), F.lit(size * ranks)) / ranks)})
    return out.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).drop("_h", "_block", "_p", "_start", "_whole")
