"""Relations of paired choices derived from the driver tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.choices import ratio
from ..functions.codes import levels
from ..operators.pairing import wide


def predictions(spark, d: str) -> DataFrame:
    """One answer an event: even ids are X, odd ids Y of the same case; probabilities from the event's value."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    case = F.expr("event_id div 2")
    rows = e.select(case.alias("case_id"), F.when(F.col("event_id") % 2 == 0, "X").otherwise("Y").alias("perspective"), "event_id", "value")
    v = F.col("value")
    return rows.select(
        "event_id",
        "case_id",
        "perspective",
        F.concat(F.lit("m"), F.col("case_id") % 5).alias("model"),
        ((F.col("case_id") * 7) % 50).alias("x_num"),
        (50 + (F.col("case_id") * 13) % 50).alias("y_num"),
        ((F.col("case_id") * 5) % 81).cast("int").alias("code"),
        ratio(v, v + 50.0).alias("p_yes"),
        ratio(F.lit(50.0), v + 50.0).alias("p_no"),
    )


PREDS = """preds AS (SELECT event_id, event_id // 2 AS case_id, CASE WHEN event_id % 2 = 0 THEN 'X' ELSE 'Y' END AS perspective,
 'm' || ((event_id // 2) % 5) AS model, ((event_id // 2) * 7) % 50 AS x_num, 50 + ((event_id // 2) * 13) % 50 AS y_num,
 ((event_id // 2) * 5) % 81 AS code, value / (value + 50.0::DOUBLE) AS p_yes, 50.0::DOUBLE / (value + 50.0::DOUBLE) AS p_no FROM events)"""


def paired(spark, d: str) -> DataFrame:
    """One row a case with p_yes and p_no of both sides: one exchange of the narrow answers."""
    rows = predictions(spark, d)
    pairs = wide(rows, "case_id", "perspective", ["model", "x_num", "y_num", "code", "p_yes", "p_no"])
    return pairs.where("rows_x = 1 AND rows_y = 1").select("case_id", F.col("model_x").alias("model"), F.col("x_num_x").alias("x_num"), F.col("y_num_x").alias("y_num"), F.col("code_x").alias("code"), "p_yes_x", "p_no_x", "p_yes_y", "p_no_y")


PAIRS = PREDS + """, pairs AS (SELECT x.case_id, x.model, x.x_num, x.y_num, x.code, x.p_yes AS p_yes_x, x.p_no AS p_no_x,
 y.p_yes AS p_yes_y, y.p_no AS p_no_y FROM preds x JOIN preds y USING (case_id) WHERE x.perspective = 'X' AND y.perspective = 'Y')"""


def cases(spark, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    return o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 50).cast("int").alias("x_num"), (50 + F.col("o_orderkey") % 50).cast("int").alias("y_num"), ((F.col("o_orderkey") * 7) % 81).cast("int").alias("code"))


CASES = """cases AS (SELECT o_orderkey AS case_id, (o_custkey % 50)::INT AS x_num, (50 + o_orderkey % 50)::INT AS y_num, ((o_orderkey * 7) % 81)::INT AS code FROM orders)"""


def with_levels(rows: DataFrame) -> DataFrame:
    parts = levels(F.col("code"))
    return rows.withColumn("_l", parts).select("*", *(F.col("_l")[n].alias(c) for n, c in enumerate("ijkl"))).drop("_l")


LEVELS = "(code % 3)::INT AS i, ((code // 3) % 3)::INT AS j, ((code // 9) % 3)::INT AS k, ((code // 27) % 3)::INT AS l"


def utilities(spark, d: str) -> DataFrame:
    """Utility of good and profile: the mean price of the parts that map to them. 900 rows at most."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice")
    k = F.col("p_partkey")
    return p.groupBy((k % 100).cast("int").alias("idx"), (F.floor(k / 100) % 3).cast("int").alias("a1"), (F.floor(k / 300) % 3).cast("int").alias("a2")).agg((F.avg("p_retailprice") / 1000.0).alias("utility"))


UTIL = """util AS (SELECT (p_partkey % 100)::INT AS idx, ((p_partkey // 100) % 3)::INT AS a1, ((p_partkey // 300) % 3)::INT AS a2,
 avg(p_retailprice) / 1000.0::DOUBLE AS utility FROM part GROUP BY 1, 2, 3)"""


def deltas(spark, d: str) -> DataFrame:
    """A delta a line item, with three models by return flag; a case is a pair of part and supplier classes."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    x, y = F.col("l_partkey") % 50, 50 + F.col("l_suppkey") % 50
    return li.select(x.alias("x_num"), y.alias("y_num"), (x * 100 + y).alias("case_id"), F.col("l_returnflag").alias("model"), (F.col("l_discount") - F.col("l_tax")).alias("delta"), "l_quantity")


DELTAS = """deltas AS (SELECT l_partkey % 50 AS x_num, 50 + l_suppkey % 50 AS y_num, (l_partkey % 50) * 100 + 50 + l_suppkey % 50 AS case_id,
 l_returnflag AS model, l_discount - l_tax AS delta, l_quantity FROM lineitem)"""


def curves(spark, d: str) -> DataFrame:
    """Values of each user over a step clock: the minutes of the events."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", "value")
    return e.select(F.col("user_id").alias("run"), F.floor(F.unix_timestamp("ts") / 60).alias("step"), "event_id", "value")


CURVES = "curves AS (SELECT user_id AS run, epoch_us(ts) // 60000000 AS step, event_id, value FROM events)"


def grid(spark, d: str) -> DataFrame:
    """Checkpoints: four runs of 15 steps, their estimates summed from the events."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    seed, step = F.col("event_id") % 4, 2000 * (1 + F.floor(F.col("event_id") / 4) % 15)
    sums = e.groupBy(seed.alias("seed"), step.cast("int").alias("step")).agg(F.round(F.avg("value"), 6).alias("m"), F.round(F.avg(F.when(F.col("value") > 60, 1.0).otherwise(0.0)), 6).alias("c"), F.count("*").alias("n"))
    return sums.select("seed", "step", F.round((F.col("m") - 50) / 25, 6).alias("lambda"), F.lit(0.1).alias("lambda_se"), F.round((F.col("c") - 0.4) * 2, 6).alias("eta"), F.lit(0.1).alias("eta_se"), F.round(F.col("c") + 0.2, 6).alias("consistency"))


GRID = """sums AS (SELECT event_id % 4 AS seed, (2000 * (1 + (event_id // 4) % 15))::INT AS step, round(avg(value), 6) AS m,
 round(avg(CASE WHEN value > 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS c FROM events GROUP BY 1, 2),
grid AS (SELECT seed, step, round((m - 50) / 25, 6) AS lambda, 0.1::DOUBLE AS lambda_se, round((c - 0.4) * 2, 6) AS eta, 0.1::DOUBLE AS eta_se,
 round(c + 0.2, 6) AS consistency FROM sums)"""


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without negative zeros."""
    return rows.select(*((F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in rows.dtypes))
