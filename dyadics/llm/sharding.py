"""Uniform shuffle of rows into shards of exact sizes.

Each input partition permutes its rows locally. A communication matrix says how many of a partition's rows go to
each shard; its rows are drawn from the multivariate hypergeometric law, so the whole is distributed as a uniform
permutation would be, while both margins (partition sizes, shard sizes) hold exactly. After the exchange each shard
permutes its rows again. Only narrow rows are exchanged, never the texts.

The matrix is drawn in two steps of the same law: the driver deals the shards' rows to groups of partitions, as many as the
square root of their number, and tasks deal each group's to its partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small, stored

SHARDS = 40
SEED = 20_240_117
#: Standard deviations on either side of the mode that a draw looks at.
SPREADS = 12
#: Rows that one task orders in the second permutation.
ROWS_A_BLOCK = 200_000
#: Bytes that a row weighs besides its text.
ROW_OVERHEAD = 16


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement from ``good + bad`` are good: one way at every size.

    The law is inverted about its mode, where each chance is that of its neighbour times a ratio of whole numbers.
    What lies beyond SPREADS standard deviations is less than a uniform number's resolution.
    """
    total = good + bad
    least, most = max(0, n - bad), min(n, good)
    if least == most:
        return least
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(SPREADS * (n * share * (1 - share) * (total - n) / max(total - 1, 1)) ** 0.5) + 40
    lo, hi = max(least, mode - reach), min(most, mode + reach)
    x = np.arange(lo, hi, dtype=np.float64)
    with np.errstate(divide="ignore"):
        steps = np.log((good - x) * (n - x)) - np.log((x + 1) * (bad - n + x + 1))
    logs = np.r_[0.0, np.cumsum(steps)]
    chance = np.cumsum(np.exp(logs - logs[mode - lo]))
    return lo + int(np.searchsorted(chance, draw.random() * chance[-1], side="right"))


def communication_matrix(partition_rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts [partition, shard]: rows sum to ``partition_rows``, columns differ by one row at most.

    Each partition's rows are drawn from what the shards have left, one shard after the other.
    """
    total = int(sum(partition_rows))
    left = [total // shards + (s < total % shards) for s in range(shards)]
    draw, out = np.random.default_rng(seed), np.zeros((len(partition_rows), shards), dtype=np.int64)
    for p, n in enumerate(map(int, partition_rows)):
        others = sum(left)
        for s in range(shards):
            others -= left[s]
            out[p, s] = got = hypergeometric(draw, left[s], others, n)
            left[s] -= got
            n -= got
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drawn(good: Column, bad: Column, n: Column, u: Column) -> Column:
    """As ``hypergeometric``, of columns: the law is inverted by the uniform number ``u``, from the mode outwards.

    Chances are relative to the mode's. Beyond the least and the most possible count a factor is 0, so they end there.
    """
    total = good + bad
    share = F.coalesce(F.try_divide(good, total), F.lit(0.0))
    least, most = F.greatest(F.lit(0).cast("long"), n - bad), F.least(n, good)
    mode = F.least(most, F.greatest(least, F.floor((n + 1) * ((good + 1) / (total + 2)))))
    spread = F.sqrt(F.greatest(n * share * (1 - share) * (total - n) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    reach = F.floor(SPREADS * spread).cast("int") + 40

    def walked(s: Column) -> Column:
        steps = F.sequence(F.lit(1), s["reach"])

        def next_to(a: Column, k: Column) -> Column:
            x, y = s["mode"] + k - 1, s["mode"] - k + 1
            up = a["up"] * (s["good"] - x) * (s["n"] - x) / ((x + 1) * (s["bad"] - s["n"] + x + 1))
            down = a["down"] * y * (s["bad"] - s["n"] + y) / ((s["good"] - y + 1) * (s["n"] - y + 1))
            return F.struct(up.alias("up"), down.alias("down"))

        one = F.lit(1.0)
        mass = F.aggregate(steps, F.struct(one.alias("up"), one.alias("down"), one.alias("sum")), lambda a, k: _let(next_to(a, k), lambda q: F.struct(q["up"].alias("up"), q["down"].alias("down"), (a["sum"] + q["up"] + q["down"]).alias("sum"))))["sum"]

        def found(goal: Column) -> Column:
            def step(a: Column, k: Column) -> Column:
                def hit(q: Column) -> Column:
                    upper, both = a["sum"] + q["up"], a["sum"] + q["up"] + q["down"]
                    at = F.coalesce(a["at"], F.when(goal < upper, s["mode"] + k).when(goal < both, s["mode"] - k))
                    return F.struct(q["up"].alias("up"), q["down"].alias("down"), both.alias("sum"), at.alias("at"))

                return _let(next_to(a, k), hit)

            start = F.struct(one.alias("up"), one.alias("down"), one.alias("sum"), F.when(goal < 1, s["mode"]).alias("at"))
            return F.coalesce(F.aggregate(steps, start, step)["at"], s["mode"])

        return _let(mass * s["u"], found)

    state = F.struct(good.alias("good"), bad.alias("bad"), n.alias("n"), mode.alias("mode"), reach.alias("reach"), u.alias("u"))
    return F.when(least >= most, least).otherwise(_let(state, walked))


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1, by a hash, with 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def dealt_counts(sizes: Column, left: Column, shards: int, seed: Column) -> Column:
    """Array of (part, counts by shard) of the partitions ``sizes`` (part, n) of a group that has ``left`` rows of each shard.

    Each partition's rows are drawn from what the shards have left, one shard after the other.
    """

    def of_part(now: Column, p: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            def draw(own: Column) -> Column:
                others = a["others"] - own
                return _let(drawn(own, others, a["n"], uniform(seed, p["part"], k)), lambda x: F.struct((a["n"] - x).alias("n"), others.alias("others"), F.concat(a["got"], F.array(x)).alias("got")))

            return _let(F.get(now, k), draw)

        start = F.struct(p["n"].alias("n"), F.aggregate(now, F.lit(0).cast("long"), lambda a, x: a + x).alias("others"), F.array().cast("array<bigint>").alias("got"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step)["got"]

    def fold(a: Column, p: Column) -> Column:
        return _let(of_part(a["left"], p), lambda got: F.struct(F.zip_with(a["left"], got, lambda x, y: x - y).alias("left"), F.concat(a["out"], F.array(F.struct(p["part"].alias("part"), got.alias("counts")))).alias("out")))

    start = F.struct(left.alias("left"), F.array().cast("array<struct<part: bigint, counts: array<bigint>>>").alias("out"))
    return F.aggregate(sizes, start, fold)["out"]


def matrix_of(parts: DataFrame, shards: int, seed: int) -> DataFrame:
    """part, counts (by shard) of partitions (part: 0, 1, ..., n); what the driver draws grows as the root of their number."""
    spark = parts.sparkSession
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return spark.createDataFrame([], "part long, counts array<long>")
    step = int(np.ceil((most + 1) ** 0.5))
    grouped = parts.groupBy(F.floor(F.col("part") / step).alias("group")).agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("part", F.col("n").cast("long").alias("n")))).alias("sizes"))  # ``step`` partitions
    sizes = {r["group"]: r["rows"] for r in grouped.select("group", "rows").collect()}  # as many groups
    groups = sorted(sizes)
    margins = communication_matrix([sizes[g] for g in groups], shards, seed)
    left = spark.createDataFrame([(g, row.tolist()) for g, row in zip(groups, margins, strict=True)], "group long, left array<long>")
    dealt = grouped.repartition(len(groups), "group").join(F.broadcast(left), "group").select(F.explode(dealt_counts(F.col("sizes"), F.col("left"), shards, F.lit(seed))).alias("d"))
    return dealt.select("d.part", "d.counts")


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) for each row of ``docs``.

    A null text counts as empty (size 16, CRC 0). Null or repeated ids are rows like others: each row gets a slot of
    its own. An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    # the first permutation stays within the input partition; the id below is its number and the row's place in it
    local = rows.withColumn("key", key).sortWithinPartitions("key", "doc_id", "text_crc32", "size").drop("key").withColumn("at", F.monotonically_increasing_id())
    local = stored(local, "shard-rows").withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = stored(local.groupBy("part").agg(F.count("*").alias("n")), "shard-sizes")
    parts, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = matrix_of(sizes, shards, seed).withColumn("ends", F.transform("counts", lambda _, k: F.aggregate(F.slice("counts", F.lit(1), k + 1), F.lit(0).cast("long"), lambda a, x: a + x)))
    ends = stored(ends.select("part", "ends"), "shard-matrix")
    # an array of the shards for each partition: its bound counts every number in it
    dealt = local.join(small(ends, parts * shards), "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    # the second permutation: by a fresh hash within the shard, in blocks that one task can order
    blocks = max(1, -(-total // (shards * ROWS_A_BLOCK)))
    dealt = dealt.withColumn("again", F.xxhash64(F.lit(seed + 1), "at")).withColumn("block", F.pmod("again", F.lit(blocks)))
    by_block = Window.partitionBy("shard", "block").orderBy("again", "at")
    slots = dealt.withColumn("slot", F.row_number().over(by_block).cast("long") - 1)
    if blocks > 1:
        # one row a block; each shard's blocks are laid one after the other
        before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        firsts = dealt.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
        slots = slots.join(small(firsts, shards * blocks), ["shard", "block"]).withColumn("slot", F.col("slot") + F.col("first"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
