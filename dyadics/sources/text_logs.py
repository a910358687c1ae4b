"""Metrics in text logs: lines that print a mapping, and an end-of-run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import metric


def metric_lines(lines: DataFrame, names: tuple[str, ...], value: str = "value") -> DataFrame:
    """One column a metric for each line that has any of them; nothing in a line is evaluated."""
    rows = lines.select("*", *(metric(F.col(value), n).alias(n) for n in names))
    found = F.coalesce(*(F.col(n) for n in names))
    return rows.where(found.isNotNull())


def steps_from_epochs(rows: DataFrame, lines: DataFrame, epochs: float) -> DataFrame:
    """``rows`` with step = epoch / epochs * total; the total is the greatest denominator of any progress bar."""
    total = lines.agg(F.max(F.regexp_extract("value", r"\|\s*\d+/(\d+)\s*\[", 1).try_cast("long")).alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("step", F.round(F.col("epoch") / epochs * F.col("_total")).cast("long")).drop("_total")


def run_summary(spark: SparkSession, path: str, epoch: float, tolerance: float = 5e-4) -> DataFrame:
    """train_runtime, train_loss of the one summary whose epoch fits; no row if none or several fit."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(\{[^{}]*'train_runtime'[^{}]*\})"), F.lit(1))).alias("value"))
    rows = text.select(*(metric(F.col("value"), n).alias(n) for n in ("train_runtime", "train_loss", "epoch"))).where(F.abs(F.col("epoch") - epoch) <= tolerance)
    counted = rows.agg(F.count("*").alias("_n"), F.first("train_runtime").alias("train_runtime"), F.first("train_loss").alias("train_loss"))
    return counted.where("_n = 1").drop("_n")
