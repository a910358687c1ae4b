"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def connected(links: DataFrame, a: str = "id", b: str = "pivot") -> DataFrame:
    """``id``, ``group`` for each id that a link names; ``group`` is the least id that it can reach.

    Each round gives every id the least label of its neighbours, then the label of its label, so long chains shorten
    by half. Labels are written between rounds; nothing but whether any changed comes to the driver. Labels only fall, so
    the rounds end.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    edges = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("group")).withColumnRenamed("u", "id"), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("group").alias("heard"))
        nearer = labels.join(heard, "id").select("id", F.col("group").alias("old"), F.least("group", "heard").alias("group"))
        jumped = nearer.join(labels.select(F.col("id").alias("group"), F.col("group").alias("further")), "group", "left")
        now = stored(jumped.select("id", "old", F.least("group", F.coalesce("further", "group")).alias("group")), "labels")
        labels = now.select("id", "group")
        if now.where("group != old").isEmpty():
            return labels
