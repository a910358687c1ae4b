"""Rates and counts of paired answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.choices import choice, pair_class, rational, rational_for_anchor


def rates(pairs: DataFrame, by: list[str], tie: str) -> DataFrame:
    """n, consistency, keep_both_rate, trade_both_rate of each group; pairs hold p_yes_x, p_no_x, p_yes_y, p_no_y."""
    kind = pair_class(choice(F.col("p_yes_x"), F.col("p_no_x"), tie), choice(F.col("p_yes_y"), F.col("p_no_y"), tie))
    rows = pairs.withColumn("_kind", kind).where("_kind != 'unparsed'")
    share = lambda name: F.avg((F.col("_kind") == name).cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share("consistent").alias("consistency"), share("keep_both").alias("keep_both_rate"), share("trade_both").alias("trade_both_rate"))


def full_rates(pairs: DataFrame, by: list[str], tie: str, delta: str) -> DataFrame:
    """``rates`` with parse failures and the yes rate of X over all ids, and the agreement with the rational answers."""
    rows = pairs.withColumns({"_x": choice(F.col("p_yes_x"), F.col("p_no_x"), tie), "_y": choice(F.col("p_yes_y"), F.col("p_no_y"), tie)})
    rows = rows.withColumn("_kind", pair_class(F.col("_x"), F.col("_y")))
    parsed = F.col("_kind") != "unparsed"
    targets, hits = [], []
    for s in ("x", "y"):
        target = rational(F.lit(s.upper()), F.col(delta))
        counts = parsed & F.coalesce(target != "", F.lit(False))
        targets.append(counts.cast("long"))
        hits.append((counts & (F.col(f"_{s}") == target)).cast("long"))
    n = F.count_if(parsed)
    share = lambda name: F.try_divide(F.count_if(F.col("_kind") == name).cast("double"), n)
    return rows.groupBy(*by).agg(
        n.alias("n"),
        share("consistent").alias("consistency"),
        share("keep_both").alias("keep_both_rate"),
        share("trade_both").alias("trade_both_rate"),
        F.avg(F.coalesce(F.col("_x") == "Yes", F.lit(False)).cast("double")).alias("hard_choice_yes_rate"),
        F.avg((~parsed).cast("double")).alias("parse_failure_rate"),
        F.try_divide(F.sum(hits[0] + hits[1]).cast("double"), F.sum(targets[0] + targets[1])).alias("target_agreement"),
    )


def matrix(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Three-way counts: a row for each answer of X with columns yes, tie, no for Y's, and the percentages of all."""
    rows = pairs.select(*by, choice(F.col("p_yes_x"), F.col("p_no_x"), "tie").alias("x_choice"), choice(F.col("p_yes_y"), F.col("p_no_y"), "tie").alias("_y"))
    counts = rows.groupBy(*by, "x_choice").agg(*(F.count_if(F.col("_y") == v).alias(v.lower()) for v in ("Yes", "tie", "No")))
    total = counts.groupBy(*by).agg(F.sum(F.col("yes") + F.col("tie") + F.col("no")).alias("_n"))
    out = counts.join(F.broadcast(total), by) if by else counts.crossJoin(F.broadcast(total))
    return out.select(*by, "x_choice", "yes", "tie", "no", *(F.round(100.0 * F.col(v) / F.col("_n"), 2).alias(f"{v}_pct") for v in ("yes", "tie", "no")))


def soft_mass(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Mean joint probability of the four pairs of answers."""
    names = {"yes": "p_yes", "no": "p_no"}
    return pairs.groupBy(*by).agg(*(F.avg(F.col(f"{names[a]}_x") * F.col(f"{names[b]}_y")).alias(f"{a}_{b}") for a in names for b in names))


def guardrails(pairs: DataFrame, by: list[str], anchor: str, tie: str = "yes") -> DataFrame:
    """Agreement with the anchor given consistency, and consistent agreement over all anchored cases; NaN over none."""
    x, y = choice(F.col("p_yes_x"), F.col("p_no_x"), tie), choice(F.col("p_yes_y"), F.col("p_no_y"), tie)
    rows = pairs.withColumns({"_same": x != y, "_stable": F.coalesce(F.col(anchor).isin("X", "Y"), F.lit(False)), "_right": F.coalesce(x == rational_for_anchor(F.lit("X"), F.col(anchor)), F.lit(False))})
    judged, correct = F.count_if(F.col("_same") & F.col("_stable")), F.count_if(F.col("_same") & F.col("_right"))
    over = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(float("nan"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("_stable").alias("n_stable"),
        F.count_if("_same").alias("consistent"),
        correct.alias("correct"),
        judged.alias("n_judged"),
        over(correct, judged).alias("anchor_match_given_consistent"),
        over(correct, F.count_if("_stable")).alias("joint_anchored_success"),
    )


def caveats(eta: Column, consistency: Column, parse_failures: Column, keep_both: Column, trade_both: Column) -> Column:
    """Names of the limits that a row of the behaviour table passes."""
    marks = [("status_quo_bias", F.abs(eta) > 1.0), ("low_consistency", consistency < 0.5), ("parse_failures", parse_failures > 0.02), ("choice_collapse", (keep_both < 0.02) | (trade_both < 0.02))]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in marks)))


def histogram(rows: DataFrame, by: list[str], value: str, bins: int = 51) -> DataFrame:
    """bin, n of values in [0, 1]; the last bin holds 1."""
    return rows.where(F.col(value).between(0, 1)).groupBy(*by, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def auto_histogram(rows: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """bin (0 to bins - 1), n over equal bins from the least to the greatest value, empty ones too; the last bin is closed."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    # one row of ends beside each value
    placed = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col(value) - F.col("_lo")) * bins / width), F.lit(bins - 1)).cast("int").alias("bin"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(placed.groupBy("bin").agg(F.count("*").alias("n"))), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def alignment(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """n, mean score and share of scores that reach 1, over rows that have a score; and the rows without."""
    return rows.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("w"), F.avg((F.col(score) == 1).cast("double")).alias("rational_rate"), F.count_if(F.col(score).isNull()).alias("skipped"))


def reward_rates(rows: DataFrame, by: list[str], answer: str) -> DataFrame:
    """Shares of yes, no and unparsed answers."""
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col(answer) == "Yes").alias("yes_rate"), share(F.col(answer) == "No").alias("no_rate"), share(F.col(answer) == "").alias("unparsed_rate"))
