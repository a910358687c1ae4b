"""Streams of answers. Each job is a transformation of a streaming DataFrame, so sources and sinks stay the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def answer_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 8) -> DataFrame:
    """Files of JSON lines as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def parquet_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_of_each(rows: DataFrame, key: list[str], clock: str, late: str) -> DataFrame:
    """The first row of each key; a key is remembered until the watermark passes its event time."""
    return rows.withWatermark(clock, late).dropDuplicatesWithinWatermark(key)


def completed_pairs(rows: DataFrame, key: str, side: str, value: str, clock: str, within: str, late: str) -> DataFrame:
    """key, value_x, value_y: X joined to Y of the same key no further apart than ``within``.

    Both sides have watermarks and the join bounds their distance, so state is dropped once a partner cannot come.
    """
    timed = rows.withWatermark(clock, late)
    x = timed.where(F.col(side) == "X").select(F.col(key).alias(key), F.col(value).alias(f"{value}_x"), F.col(clock).alias("_tx"))
    y = timed.where(F.col(side) == "Y").select(F.col(key).alias("_key"), F.col(value).alias(f"{value}_y"), F.col(clock).alias("_ty"))
    near = (F.col("_ty") >= F.col("_tx") - F.expr(f"INTERVAL {within}")) & (F.col("_ty") <= F.col("_tx") + F.expr(f"INTERVAL {within}"))
    return x.join(y, (F.col(key) == F.col("_key")) & near).select(key, f"{value}_x", f"{value}_y")


def running_summary(rows: DataFrame, by: list[str], p_yes: str, p_no: str) -> DataFrame:
    """by, n, yes_rate over all rows so far (complete or update mode)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(p_yes) > F.col(p_no)).cast("double")).alias("yes_rate"))


def windowed_summary(rows: DataFrame, clock: str, width: str, late: str, value: str) -> DataFrame:
    """start, n, mean by tumbling window of event time; late rows are dropped once the watermark has passed."""
    w = rows.withWatermark(clock, late).groupBy(F.window(clock, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("window.start").alias("start"), "n", "mean")


def upsert(path: str, key: list[str], order: str):
    """A foreachBatch function that keeps the last row of each key in a Parquet table, one folder a batch.

    A batch that comes again overwrites its own folder, so replays do no harm; ``latest`` reads the state and ``compacted``
    writes it anew as one folder.
    """
    from ..sources.readers import keep_last

    def run(batch: DataFrame, number: int) -> None:
        last = keep_last(batch.withColumn("_order", F.col(order)), key, "_order").drop("_order")
        last.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def latest(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    from ..sources.readers import keep_last

    return keep_last(spark.read.parquet(f"{path}/batch=*"), key, order).drop("_batch")


def run_once(stream: DataFrame, checkpoint: str, table: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, into a memory table (tests and replays) or until it is done."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def compacted(spark: SparkSession, path: str, into: str, key: list[str], order: str) -> None:
    """The state of an upserted table written to a new place as its first batch; the old folders may go afterwards."""
    latest(spark, path, key, order).withColumn("_batch", F.lit(-1)).write.mode("overwrite").parquet(f"{into}/batch=-1")


def progress(lines: DataFrame, run: str, order: str, value: str = "value") -> DataFrame:
    """run, done, total, share, seconds_left by the last progress bar of each run; works on streams in complete mode."""
    bar = r"(\d+)/(\d+)\s*\[(?:(\d+):)?(\d+):(\d+)<"
    part = lambda n: F.regexp_extract(value, bar, n).try_cast("long")
    seen = lines.where(F.col(value).rlike(bar)).select(run, order, part(1).alias("done"), part(2).alias("total"), (F.coalesce(part(3), F.lit(0)) * 3600 + part(4) * 60 + part(5)).alias("spent"))
    last = seen.groupBy(run).agg(F.max_by(F.struct("done", "total", "spent"), order).alias("_l")).select(run, "_l.*")
    left = F.try_divide(F.col("spent") * (F.col("total") - F.col("done")), F.col("done"))
    return last.select(run, "done", "total", F.try_divide("done", "total").alias("share"), left.alias("seconds_left"))


def retrying(score, attempts: int = 15, wait: float = 2.0):
    """A scorer (iterator of frames to iterator of frames) that tries each frame again after n * ``wait`` seconds; the last error stands."""
    import time

    def run(parts):
        for part in parts:
            for n in range(1, attempts + 1):
                try:
                    out = list(score(iter([part])))
                    break
                except Exception:
                    if n == attempts:
                        raise
                    time.sleep(n * wait)
            yield from out

    return run
