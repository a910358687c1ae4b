"""Summaries of models, forms, runs and parameter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.records import preferred_good
from .consensus import modal, simpson_flip
from .ordered import percentiles
from .windows import average_rank

AXES = ("answer_style", "display_order", "attr_order", "paraphrase")


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted values: of an even number the upper of the middle two."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def model_survey(parameters: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """model, per kind ('alpha', 'beta') the number, nonzero standard errors and their upper median; valid; yes rates.

    ``parameters``: model, kind, std_err; a model has about a hundred. ``answers``: model, yes_x, yes_y (0 or 1).
    """
    of = lambda kind: F.when(F.col("kind") == kind, F.col("std_err"))
    aggs = []
    for kind in ("alpha", "beta"):
        aggs += [F.count(of(kind)).alias(f"n_{kind}s"), F.count_if(of(kind) > 0).alias(f"n_{kind}_se_nonzero"), upper_median(F.collect_list(of(kind))).alias(f"median_{kind}_se")]
    out = parameters.groupBy("model").agg(*aggs)
    out = out.withColumn("valid", (F.col("n_alpha_se_nonzero") > 0) & (F.col("n_beta_se_nonzero") > 0))
    if answers is None:
        return out
    rates = answers.groupBy("model").agg(F.avg("yes_x").alias("yes_x_rate"), F.avg("yes_y").alias("yes_y_rate"), F.count("*").alias("total"))
    return out.join(rates, "model", "full").withColumn("valid", F.coalesce("valid", F.lit(False)))


def scale_constant(deltas: DataFrame, value: str, rule: str = "mean_abs") -> DataFrame:
    """scale: the constant by which rewards of the sign alone match those of the size, by 'mean_abs' or 'rms'."""
    if rule not in ("mean_abs", "rms"):
        raise ValueError("rule is 'mean_abs' or 'rms'")
    size = F.avg(F.abs(value)) if rule == "mean_abs" else F.sqrt(F.avg(F.col(value) * F.col(value)))
    return deltas.agg(size.alias("scale"))


def form_units(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each unit ``by`` (case and perspective): forms, invariant, modal good, flip rate, spread of p_trade.

    ``rows``: by, final_good, p_trade and ``pos``, the order in which forms came.
    """
    whole = rows.groupBy(*by).agg(F.count("*").alias("forms"), (F.count_distinct(F.coalesce(F.col("final_good").cast("string"), F.lit(""))) == 1).alias("invariant"), (F.max("p_trade") - F.min("p_trade")).alias("prob_spread"))
    flips = simpson_flip(rows, by, "final_good").select(*by, "flip")
    return whole.join(modal(rows, by, "final_good", "pos").select(*by, "modal"), by).join(flips, by)


def form_summary(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a model: invariance, fidelity, worst form, flip rate, spread, keep-both rate.

    ``rows``: model, case_id, perspective, the four axes, final_good, p_trade, pos. ``cases``: case_id, x_num, y_num, delta.
    """
    unit = ["model", "case_id", "perspective"]
    target = cases.select("case_id", "x_num", "y_num", preferred_good(F.col("delta"), F.col("x_num"), F.col("y_num")).alias("_preferred"))
    hits = rows.join(target, "case_id").select("model", *AXES, F.coalesce(F.col("final_good") == F.col("_preferred"), F.lit(False)).cast("double").alias("hit"))
    forms = hits.groupBy("model", *AXES).agg(F.avg("hit").alias("fidelity"), F.sum("hit").alias("_hits"), F.count("*").alias("_n"))
    # of forms of equal fidelity the least by name is the worst
    fidelity = forms.groupBy("model").agg((F.sum("_hits") / F.sum("_n")).alias("fidelity_mean"), F.min(F.struct("fidelity", *AXES)).alias("_worst"))
    units = form_units(rows, unit)
    per = units.groupBy("model").agg(F.count("*").alias("n_units"), F.sum("forms").alias("n_rows"), rate(F.col("invariant")).alias("invariance_rate"), F.avg("flip").alias("flip_rate"), F.avg("prob_spread").alias("mean_prob_spread"))
    side = lambda s: F.max(F.when(F.col("perspective") == s, F.col("modal")))
    both = units.groupBy("model", "case_id").agg(side("X").alias("_x"), side("Y").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL").join(target, "case_id")
    kept = both.groupBy("model").agg(rate((F.col("_x") == F.col("x_num")) & (F.col("_y") == F.col("y_num"))).alias("keep_both_rate"))
    out = per.join(fidelity, "model").join(kept, "model", "left")
    return out.select("model", "n_units", "n_rows", "invariance_rate", "fidelity_mean", F.col("_worst.fidelity").alias("worst_fidelity"), F.concat_ws("/", *(F.col(f"_worst.{a}").cast("string") for a in AXES)).alias("worst_form"), "flip_rate", "mean_prob_spread", "keep_both_rate")


def form_strata(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """model, stratum, invariance (over units), fidelity (over forms). ``cases`` also has ``stratum``."""
    target = cases.select("case_id", "stratum", preferred_good(F.col("delta"), F.col("x_num"), F.col("y_num")).alias("_preferred"))
    units = rows.join(target, "case_id").groupBy("model", "case_id", "perspective", "stratum").agg((F.count_distinct("final_good") == 1).alias("_same"), F.count_if(F.col("final_good") == F.col("_preferred")).alias("_hits"), F.count("*").alias("_n"))
    return units.groupBy("model", "stratum").agg(rate(F.col("_same")).alias("invariance"), (F.sum("_hits") / F.sum("_n")).alias("fidelity"))


def neutral_summary(rows: DataFrame, cases: DataFrame, base: str, by: list[str] | None = None) -> DataFrame:
    """model (and ``by`` of the cases): n_cases, preservation of the base model's choice, agreement with the target, order invariance.

    ``rows``: model, case_id, order, chosen_good, pos. The modal choice counts; of equal ones the first.
    """
    choice = modal(rows, ["model", "case_id"], "chosen_good", "pos").select("model", "case_id", "modal")
    blocks = modal(rows, ["model", "case_id", "order"], "chosen_good", "pos").groupBy("model", "case_id").agg((F.count_distinct("modal") == 1).alias("_same_order"))
    of_base = choice.where(F.col("model") == base).select("case_id", F.col("modal").alias("_base"))
    target = cases.select("case_id", *(by or []), preferred_good(F.col("delta"), F.col("x_num"), F.col("y_num")).alias("_preferred"))
    each = choice.join(blocks, ["model", "case_id"]).join(of_base, "case_id", "left").join(target, "case_id")
    hit = lambda other: rate(F.coalesce(F.col("modal") == F.col(other), F.lit(False)))
    return each.groupBy("model", *(by or [])).agg(F.count("*").alias("n_cases"), hit("_base").alias("preservation"), hit("_preferred").alias("target_agreement"), rate(F.col("_same_order")).alias("order_invariance"))


def question_summary(rows: DataFrame, total: int) -> DataFrame:
    """evaluated, correct, accuracy, parsed, parse_rate, complete; rates are null over no rows. ``rows``: predicted_answer, correct."""
    n = F.count("*")
    out = rows.agg(n.alias("evaluated"), F.count_if("correct").alias("correct"), F.count("predicted_answer").alias("parsed"))
    return out.select("evaluated", "correct", F.try_divide("correct", "evaluated").alias("accuracy"), "parsed", F.try_divide("parsed", "evaluated").alias("parse_rate"), (F.col("evaluated") == total).alias("complete"))


def dataset_stats(rows: DataFrame, case: str, facets: list[str]) -> DataFrame:
    """facet, value, n of each value of the facets, and one row (facet 'distinct') with the number of distinct cases; one pass."""
    long = rows.select(case, F.explode(F.create_map(*(x for f in facets for x in (F.lit(f), F.col(f).cast("string"))))).alias("facet", "value"))
    counts = long.groupBy("facet", "value").agg(F.count("*").alias("n"))
    return counts.unionByName(rows.agg(F.lit("distinct").alias("facet"), F.lit(case).alias("value"), F.count_distinct(case).alias("n")))


def energy_shares(rows: DataFrame, run: list[str], dimensions: list[str], value: str) -> DataFrame:
    """run, dimension, level, total, share: totals by each dimension by itself in one pass (grouping sets)."""
    long = rows.select(*run, value, F.explode(F.create_map(*(x for d in dimensions for x in (F.lit(d), F.col(d).cast("string"))))).alias("dimension", "level"))
    sums = long.groupBy(*run, "dimension", "level").agg(F.sum(value).alias("total"))
    whole = Window.partitionBy(*run, "dimension")  # a row a level
    return sums.withColumn("share", F.try_divide("total", F.sum("total").over(whole)))


def weighted_summary(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """by: n, mean, weighted_mean, least, greatest, median of the finite values."""
    ok = rows.withColumn("_v", finite(F.col(value))).where("_v IS NOT NULL")
    out = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.try_divide(F.sum(F.col("_v") * F.col(weight)), F.sum(weight)).alias("weighted_mean"), F.min("_v").alias("least"), F.max("_v").alias("greatest"))
    return out.join(percentiles(ok.select(*by, "_v"), by, "_v", {"median": 0.5}), by)


def vector_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by: least, greatest, p01, p50, p99 of the finite values, and n_nonfinite."""
    ok = rows.select(*by, finite(F.col(value)).alias("_v"))
    out = ok.groupBy(*by).agg(F.min("_v").alias("least"), F.max("_v").alias("greatest"), F.count_if(F.col("_v").isNull()).alias("n_nonfinite"))
    return out.join(percentiles(ok.where("_v IS NOT NULL"), by, "_v", {"p01": 0.01, "p50": 0.5, "p99": 0.99}), by, "left")


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by: n, least, greatest and their difference over finite values; 0 for one value, null for none."""
    v = finite(F.col(value))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), (F.max(v) - F.min(v)).alias("spread"))


def run_summary(rows: DataFrame, run: list[str], step: str, columns: list[str]) -> DataFrame:
    """run: steps, last_step and of each column the first, last, mean and greatest value that is a number, in the order of steps."""
    aggs = [F.count("*").alias("n_steps"), F.max(step).alias("last_step")]
    for c in columns:
        v = F.when(~F.isnan(c), F.col(c))
        at = F.when(v.isNotNull(), F.col(step))
        aggs += [F.min_by(v, at).alias(f"{c}_first"), F.max_by(v, at).alias(f"{c}_last"), F.avg(v).alias(f"{c}_mean"), F.max(v).alias(f"{c}_max")]
    return rows.groupBy(*run).agg(*aggs)


def condition_proxy(rows: DataFrame, by: list[str], variance: str) -> DataFrame:
    """by: greatest over least of the positive finite variances; null without one."""
    v = F.when(F.col(variance) > 0, finite(F.col(variance)))
    return rows.groupBy(*by).agg(F.try_divide(F.max(v), F.min(v)).alias("condition_proxy"))


def snapshot_counts(rows: DataFrame, small: float = 0.5) -> DataFrame:
    """rows, clean, not_clean, small_with_caveat, large. ``rows``: lambda, caveats (array); clean is small without a caveat."""
    size, caveat = F.abs("lambda"), F.size("caveats") > 0
    clean = (size < small) & ~caveat
    return rows.agg(F.count("*").alias("rows"), F.count_if(clean).alias("clean"), F.count_if(~clean).alias("not_clean"), F.count_if((size < small) & caveat).alias("small_with_caveat"), F.count_if(size >= small).alias("large"))


def positional_rank(rows: DataFrame, by: list[str], value: str, ties: str) -> DataFrame:
    """``rows`` with ``rank`` from 0: places in ascending order, equal values by ``ties``. A group is a bounded table."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(value, ties)) - 1)


def latest_checkpoint(paths: DataFrame, path: str, by: list[str]) -> DataFrame:
    """by, path, step of the greatest number after ``checkpoint-``; other paths do not count."""
    step = F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1).try_cast("long")
    return paths.withColumn("step", step).where("step IS NOT NULL").groupBy(*by).agg(F.max_by(path, "step").alias(path), F.max("step").alias("step"))


def most_influential(rows: DataFrame, value: str, ok: Column) -> DataFrame:
    """The row of the greatest |value| among those that are ok."""
    return rows.where(ok).agg(F.max_by(F.struct(*rows.columns), F.abs(F.col(value))).alias("_r")).where("_r IS NOT NULL").select("_r.*")


def parameter_agreement(target: DataFrame, base: DataFrame, by: list[str], excluded: list[str]) -> DataFrame:
    """by (of target), kind, n, pearson, spearman, mae, rmse of parameters matched by name; 'alpha' once more without the excluded.

    ``target``: by, parameter, kind, estimate; ``base``: parameter, estimate.
    """
    both = target.join(base.select("parameter", F.col("estimate").alias("_base")), "parameter").where(F.col("kind").isin("alpha", "beta"))
    again = both.where((F.col("kind") == "alpha") & ~F.col("parameter").isin(excluded)).withColumn("kind", F.lit("alpha_without_excluded"))
    rows = both.unionByName(again)
    key = [*by, "kind"]
    for c, out in (("estimate", "_ra"), ("_base", "_rb")):
        rows = average_rank(rows, key, c, out)
    diff = F.col("estimate") - F.col("_base")
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.corr("estimate", "_base").alias("pearson"), F.corr("_ra", "_rb").alias("spearman"), F.avg(F.abs(diff)).alias("mae"), F.sqrt(F.avg(diff * diff)).alias("rmse"))


def enriched(rows: DataFrame, other: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with columns of ``other`` where the key is found there, else null. A repeated key of ``other`` takes its least row."""
    one = other.groupBy(*key).agg(F.min(F.struct(*columns)).alias("_r")).select(*key, "_r.*")
    return rows.join(one, key, "left")


def stable_modules(rows: DataFrame, key: list[str], seeds: tuple[int, int], similar: DataFrame, n: int = 200) -> DataFrame:
    """key, the worse of two seeds' ranks by energy and by size, the lesser shares, cosine (null if unknown): the ``n`` best.

    ``rows``: seed, key, energy_share, energy_rank, norm_rank. ``similar``: key, cosine.
    """
    of = lambda s: rows.where(F.col("seed") == s).select(*key, F.struct("energy_share", "energy_rank", "norm_rank").alias(f"s{s}"))
    a, b = f"s{seeds[0]}", f"s{seeds[1]}"
    both = of(seeds[0]).join(of(seeds[1]), key).join(similar.select(*key, "cosine"), key, "left")
    worse = [F.greatest(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias(f"{c}_worse") for c in ("energy_rank", "norm_rank")]
    out = both.select(*key, *worse, F.least(F.col(f"{a}.energy_share"), F.col(f"{b}.energy_share")).alias("energy_share_min"), "cosine")
    return out.orderBy(F.greatest("energy_rank_worse", "norm_rank_worse"), F.col("energy_rank_worse") + F.col("norm_rank_worse"), *key).limit(n)
