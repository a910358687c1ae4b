"""Queries on step clocks, ranks, checkpoints, resampling and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codes import hash_rank_key
from ..functions.rewards import learning_rate
from ..operators import consensus, pairing, resample, selection
from ..operators import windows as win
from ..sources.readers import keep_last, scored
from ..streaming import jobs
from . import views as v
from .register import registry
from .stream_folder import shared_folder

QUERIES, ORACLES, query = registry()


@query(f"WITH {v.CURVES} SELECT event_id, run, step, round(avg(value) OVER (PARTITION BY run ORDER BY step, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM curves")
def trailing_mean(spark, d):
    return win.trailing_mean(v.curves(spark, d), ["run"], ["step", "event_id"], "value", 5).select("event_id", "run", "step", "smoothed")


@query(f"WITH {v.CURVES} SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY run) < 5 THEN value ELSE avg(value) OVER (PARTITION BY run ORDER BY step, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS smoothed FROM curves")
def trailing_mean_guarded(spark, d):
    return win.trailing_mean(v.curves(spark, d), ["run"], ["step", "event_id"], "value", 5, guard=True).select("event_id", "smoothed")


@query(f"WITH {v.CURVES} SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY run) < 5 THEN value ELSE avg(value) OVER (PARTITION BY run ORDER BY step, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smoothed FROM curves")
def centred_mean(spark, d):
    return win.centred_mean(v.curves(spark, d), ["run"], ["step", "event_id"], "value").select("event_id", "smoothed")


@query(f"WITH {v.CURVES}, r AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY step DESC, event_id DESC) AS r FROM curves) SELECT run, round(avg(value), 6) AS last_mean, count(*) AS n FROM r WHERE r <= 20 GROUP BY 1")
def last20_mean(spark, d):
    return win.last_mean(v.curves(spark, d), ["run"], ["step", "event_id"], "value")


STEPS = v.CURVES + ", hours AS (SELECT run % 20 AS run, step // 60 AS step, value FROM curves)"


def _hours(spark, d):
    return v.curves(spark, d).select((F.col("run") % 20).alias("run"), F.floor(F.col("step") / 60).alias("step"), "value")


@query(f"WITH {STEPS}, s AS (SELECT run, step, count(*) AS n FROM hours GROUP BY 1, 2) SELECT run, sum(n)::BIGINT AS rows, count(*) AS steps, count(*) FILTER (n > 1) AS duplicate_steps, (max(step) - min(step) + 1 - count(*))::BIGINT AS missing_steps, 0::BIGINT AS non_finite FROM s GROUP BY 1")
def step_gap_audit(spark, d):
    return win.step_audit(_hours(spark, d), "run", "step", "value", 1)


@query(f"WITH {STEPS}, b AS (SELECT run, min(step) AS a, max(step) AS z FROM hours GROUP BY 1), e AS (SELECT run, unnest(range(a, z + 1)) AS step FROM b) SELECT run, step FROM e EXCEPT SELECT run, step FROM hours")
def missing_steps(spark, d):
    return win.missing_steps(_hours(spark, d), "run", "step", 1)


@query(
    f"""WITH {v.CURVES}, c AS (SELECT run, step * 100000 + event_id % 100000 AS t, value FROM curves), w AS (SELECT *, value - lag(value) OVER (PARTITION BY run ORDER BY t) AS rise FROM c)
SELECT run, count(*) AS n, round(min_by(value, t), 6) AS first, round(max_by(value, t), 6) AS last, round(min(value), 6) AS least, arg_min(t, (value, t)) AS least_at, round(max(value), 6) AS greatest, arg_max(t, (value, -t)) AS greatest_at, round(max(rise), 6) AS largest_rise FROM w GROUP BY 1"""
)
def run_description(spark, d):
    rows = v.curves(spark, d).select("run", (F.col("step") * 100_000 + F.col("event_id") % 100_000).alias("t"), "value")
    return win.describe_run(rows, "run", "t", "value")


@query(f"WITH {v.PREDS}, g AS (SELECT case_id, count(*) AS n, arg_max(p_no, event_id) - arg_min(p_no, event_id) AS d_p_no FROM preds GROUP BY 1) SELECT case_id, n = 2 AS pairs_ok, CASE WHEN n = 2 THEN round(d_p_no, 6) END AS d_p_no FROM g")
def first_difference_pairs(spark, d):
    return win.first_differences(v.predictions(spark, d), ["case_id"], "event_id", ["p_no"])


LINES = "li AS (SELECT l_returnflag, l_quantity AS a, l_extendedprice AS b FROM lineitem)"


@query(
    f"""WITH {LINES}, r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY a) + (count(*) OVER (PARTITION BY l_returnflag, a) - 1) / 2.0::DOUBLE AS x,
 rank() OVER (PARTITION BY l_returnflag ORDER BY b) + (count(*) OVER (PARTITION BY l_returnflag, b) - 1) / 2.0::DOUBLE AS y FROM li) SELECT l_returnflag, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1"""
)
def avg_rank_spearman(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return win.rank_correlation(rows, ["l_returnflag"], "a", "b")


@query(f"WITH {LINES} SELECT l_returnflag, count(*) AS n, round(corr(a, b / 1000), 6) AS pearson, round(avg(abs(a - b / 1000)), 6) AS mae, round(sqrt(avg((a - b / 1000) * (a - b / 1000))), 6) AS rmse FROM li GROUP BY 1")
def pearson_mae_rmse(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    off = F.col("a") - F.col("b")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"))


PICK = v.GRID + """, c AS (SELECT seed, step, round(sqrt("lambda" * "lambda" + eta * eta), 9) AS d, consistency FROM grid WHERE consistency >= 0.5),
full_seed AS (SELECT seed, count(*) = 15 AS complete FROM grid GROUP BY 1), b AS (SELECT seed, min(d) AS m FROM c GROUP BY 1),
n AS (SELECT c.* FROM c JOIN b USING (seed) WHERE abs(d - m) < 0.05), t AS (SELECT seed, max(consistency) AS m FROM n GROUP BY 1),
p AS (SELECT n.seed, min(step) AS step, arg_min(d, step) AS d FROM n JOIN t USING (seed) WHERE abs(consistency - m) < 0.02 GROUP BY 1)"""


@query(f"WITH {PICK} SELECT seed, CASE WHEN complete THEN step END AS selected_step, CASE WHEN complete THEN round(d, 6) END AS d, CASE WHEN NOT complete THEN 'incomplete grid' WHEN step IS NULL THEN 'no eligible checkpoint' ELSE 'min d' END AS reason FROM full_seed LEFT JOIN p USING (seed)")
def checkpoint_select(spark, d):
    return selection.select(v.grid(spark, d), ["seed"])


@query(f"WITH {PICK} SELECT seed, CASE WHEN seed = 1 THEN 'incomplete grid' WHEN NOT complete THEN 'incomplete grid' WHEN step IS NULL THEN 'no eligible checkpoint' ELSE 'min d' END AS reason, CASE WHEN seed = 1 OR NOT complete THEN NULL ELSE step END AS selected_step FROM full_seed LEFT JOIN p USING (seed)")
def checkpoint_select_incomplete(spark, d):
    rows = v.grid(spark, d).where("NOT (seed = 1 AND step = 8000)")
    return selection.select(rows, ["seed"]).select("seed", "reason", "selected_step")


@query(f"""WITH {v.GRID} SELECT seed, step, round(sqrt("lambda" * "lambda" + eta * eta), 6) AS d, CASE WHEN consistency < 0.5 THEN 'consistency below floor' ELSE '' END AS why FROM grid""")
def checkpoint_eligibility(spark, d):
    return selection.candidates(v.grid(spark, d)).select("seed", "step", "d", "why")


@query(f"WITH {v.GRID} SELECT seed, step, (row_number() OVER (PARTITION BY seed ORDER BY round_even(consistency / 0.05, 0) DESC, step))::INT AS place FROM grid")
def bucketed_rank_select(spark, d):
    return selection.bucketed_order(v.grid(spark, d), [("consistency", 0.05, True), ("step", 0, False)], ["seed"]).select("seed", "step", "place")


@query(f"WITH {PICK}, q AS (SELECT seed, CASE WHEN seed = 3 THEN NULL ELSE step IS NOT NULL END AS s1, coalesce(d < 0.5, FALSE) AS s2 FROM full_seed LEFT JOIN p USING (seed)) SELECT seed, CASE WHEN s1 IS NULL OR s2 IS NULL THEN 'PENDING' WHEN s1 AND s2 THEN 'PASS' ELSE 'FAIL' END AS status FROM q")
def replication_verdict(spark, d):
    rows = selection.select(v.grid(spark, d), ["seed"])
    checks = rows.select("seed", F.when(F.col("seed") != 3, F.col("selected_step").isNotNull()).alias("s1"), F.coalesce(F.col("d") < 0.5, F.lit(False)).alias("s2"))
    return selection.replication(checks, "seed", ["s1", "s2"])


@query("WITH s AS (SELECT event_id, 1 + event_id % 1000 AS step FROM events) SELECT event_id, step, round(CASE WHEN step - 1 < 100 THEN 1e-4::DOUBLE * (step - 1) / 100 ELSE 1e-4::DOUBLE * 0.5 * (1 + cos(pi() * least(greatest((step - 1 - 100) / 900.0::DOUBLE, 0), 1))) END, 12) AS lr FROM s", digits=12)
def learning_rate_schedule(spark, d):
    """The rate at the step of each event."""
    steps = spark.read.parquet(f"{d}/events.parquet").select("event_id", (1 + F.col("event_id") % 1000).alias("step"))
    return steps.withColumn("lr", learning_rate(F.col("step"), 1e-4, 100, 1000))


BOOT = v.PAIRS + """, cl AS (SELECT row_number() OVER (ORDER BY x_num, y_num) - 1 AS ix, sum(p_no_x - p_no_y) AS s, count(*) AS c FROM pairs GROUP BY x_num, y_num),
g AS (SELECT count(*) AS n FROM cl), dr AS (SELECT r.range AS rep, floor(('0x' || substr(md5('7:' || r.range || ':' || s.range), 1, 8))::BIGINT * n / 4294967296::DOUBLE)::BIGINT AS ix FROM g, range(2000) r, range((SELECT n FROM g)) s),
reps AS (SELECT rep, sum(s) / sum(c) AS estimate FROM dr JOIN cl USING (ix) GROUP BY 1)"""


def _clusters(spark, d):
    rows = v.paired(spark, d).withColumn("value", F.col("p_no_x") - F.col("p_no_y"))
    return resample.clusters(rows, ["x_num", "y_num"], "value")


@query(f"WITH {BOOT} SELECT count(*) AS reps, round(avg(estimate), 6) AS mean, round(stddev_samp(estimate), 6) AS sd, round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high FROM reps")
def cluster_bootstrap_mean_ci(spark, d):
    sums = _clusters(spark, d)
    return resample.interval(resample.mean_replicates(sums, sums.count(), 2000, 7))


@query(f"WITH {BOOT} SELECT rep, round(estimate, 6) AS estimate FROM reps")
def cluster_bootstrap_replicates(spark, d):
    sums = _clusters(spark, d)
    return resample.mean_replicates(sums, sums.count(), 2000, 7)


@query(f"WITH {BOOT}, t AS (SELECT sum(s) AS s, sum(c) AS c FROM cl), j AS (SELECT (t.s - cl.s) / (t.c - cl.c) AS e FROM cl, t) SELECT count(*) AS clusters, round(avg(e), 6) AS mean, round((count(*) - 1) * var_pop(e), 9) AS variance FROM j", digits=9)
def cluster_jackknife(spark, d):
    return resample.jackknife(_clusters(spark, d)).withColumn("mean", F.round("mean", 6))


@query(
    f"""WITH {v.PAIRS}, i AS (SELECT (p_yes_y > p_no_y)::INT - (p_yes_x > p_no_x)::INT AS diff FROM pairs), t AS (SELECT count(*) AS n, count(*) FILTER (diff < 0) AS minus, count(*) FILTER (diff <= 0) AS upto FROM i),
dr AS (SELECT r.range AS rep, floor(('0x' || substr(md5('11:' || r.range || ':' || s.range), 1, 8))::BIGINT * n / 4294967296::DOUBLE)::BIGINT AS spot, minus, upto, n FROM t, range(2000) r, range((SELECT n FROM t)) s),
e AS (SELECT rep, sum(CASE WHEN spot < minus THEN -1 WHEN spot < upto THEN 0 ELSE 1 END) / any_value(n)::DOUBLE AS estimate FROM dr GROUP BY 1)
SELECT count(*) AS reps, round(avg(estimate), 6) AS mean, round(stddev_samp(estimate), 6) AS sd, round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high FROM e"""
)
def paired_bootstrap_ci(spark, d):
    """Draws as many items as there are, with replacement, in each of 2,000 replicates."""
    rows = v.paired(spark, d).select(((F.col("p_yes_y") > F.col("p_no_y")).cast("int") - (F.col("p_yes_x") > F.col("p_no_x")).cast("int")).alias("diff"))
    return resample.interval(resample.item_replicates(rows, "diff", 2000, 11))


ITEMS = v.PAIRS + ", i AS (SELECT (p_yes_y > p_no_y)::INT - (p_yes_x > p_no_x)::INT AS diff FROM pairs)"


def _items(spark, d):
    return v.paired(spark, d).select(((F.col("p_yes_y") > F.col("p_no_y")).cast("int") - (F.col("p_yes_x") > F.col("p_no_x")).cast("int")).alias("diff"))


@query()
def paired_bootstrap_counts(spark, d):
    """The interval over 10,000 replicates, drawn as counts of the distinct differences."""
    return resample.interval(resample.count_replicates(_items(spark, d), "diff", 10_000, 11))


@query(f"WITH {ITEMS} SELECT count(*) AS items, 10000::BIGINT AS reps, round(avg(diff), 6) AS mean, round(stddev_pop(diff) / sqrt(count(*)), 6) AS law_sd, true AS mean_fits, true AS sd_fits FROM i")
def paired_bootstrap_law(spark, d):
    """Whether mean and spread of the 10,000 replicates are those that the law of drawing items has, within five errors."""
    items = _items(spark, d)
    law = items.agg(F.count("*").alias("items"), F.avg("diff").alias("mean"), (F.stddev_pop("diff") / F.sqrt(F.count("*"))).alias("law_sd"))
    found = resample.interval(resample.count_replicates(items, "diff", 10_000, 11)).select("reps", F.col("mean").alias("_mean"), "sd")
    error = F.col("law_sd") / F.sqrt(F.col("reps"))
    one = law.crossJoin(F.broadcast(found))  # a row each
    return one.select("items", "reps", "mean", "law_sd", (F.abs(F.col("_mean") - F.col("mean")) <= 5 * error).alias("mean_fits"), (F.abs(F.col("sd") - F.col("law_sd")) <= 5 * error / F.sqrt(F.lit(2.0))).alias("sd_fits"))


@query(f"WITH {v.PAIRS}, t AS (SELECT sum(p_no_x) AS s, count(*) AS n FROM pairs), s AS (SELECT g, sum(p_no_x) AS s, count(*) AS n FROM (SELECT x_num AS g, p_no_x FROM pairs UNION ALL SELECT y_num, p_no_x FROM pairs) GROUP BY 1) SELECT g AS good, round(t.s - s.s, 6) AS p_no_x, t.n - s.n AS n FROM s, t")
def leave_one_good_out(spark, d):
    return resample.leave_one_good_out(v.paired(spark, d).select("x_num", "y_num", "p_no_x", F.lit(1).alias("n")), "x_num", "y_num", ["p_no_x", "n"])


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1")
def keep_last_upsert(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "value")
    return keep_last(rows.withColumn("_at", F.col("event_id")), ["user_id"], "event_id").drop("_at")


@query(f"WITH {v.PREDS} SELECT case_id FROM preds GROUP BY 1 HAVING count(DISTINCT CASE WHEN event_id % 7 <> 0 THEN perspective END) < 2")
def resume_antijoin(spark, d):
    rows = v.predictions(spark, d)
    done = pairing.wide(rows.where("event_id % 7 != 0"), "case_id", "perspective", ["model"]).where("rows_x > 0 AND rows_y > 0")

    def score(parts):
        for part in parts:
            yield part[["case_id"]]

    return scored(rows.select("case_id").distinct(), done, ["case_id"], score, "case_id long")


@query("SELECT user_id % 50 AS batch, event_type, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY batch ORDER BY n DESC, min(event_id)) = 1")
def modal_choice_first_tie(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 50).alias("batch"), "event_type", "event_id")
    modal = consensus.modal(rows, ["batch"], "event_type", "event_id")
    counts = rows.groupBy("batch", "event_type").agg(F.count("*").alias("n"))
    return modal.select("batch", F.col("modal").alias("event_type")).join(counts, ["batch", "event_type"])


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) SELECT user_id, sum(c)::BIGINT AS n, round(CASE WHEN sum(c) < 2 THEN 0.0::DOUBLE ELSE 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1))::DOUBLE END, 6) AS flip FROM c GROUP BY 1")
def simpson_flip(spark, d):
    return consensus.simpson_flip(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type"), ["user_id"], "event_type")


FORMS = "forms AS (SELECT event_id % 4 AS style, (event_id // 4) % 2 AS display, (event_id // 8) % 2 AS attr, (event_id // 16) % 3 AS phrase, (value > 60)::INT AS hit FROM events)"


@query(
    f"""WITH {FORMS} SELECT 'style' AS axis, style::VARCHAR AS level, count(*) AS n, round(avg(hit), 6) AS mean FROM forms GROUP BY 2 UNION ALL SELECT 'display', display::VARCHAR, count(*), round(avg(hit), 6) FROM forms GROUP BY 2
UNION ALL SELECT 'attr', attr::VARCHAR, count(*), round(avg(hit), 6) FROM forms GROUP BY 2 UNION ALL SELECT 'phrase', phrase::VARCHAR, count(*), round(avg(hit), 6) FROM forms GROUP BY 2"""
)
def form_axes_unpivot(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    rows = e.select((F.col("event_id") % 4).alias("style"), (F.floor(F.col("event_id") / 4) % 2).alias("display"), (F.floor(F.col("event_id") / 8) % 2).alias("attr"), (F.floor(F.col("event_id") / 16) % 3).alias("phrase"), (F.col("value") > 60).cast("int").alias("hit"))
    return consensus.axis_means(rows, ["style", "display", "attr", "phrase"], "hit")


@query(
    f"""WITH {v.PREDS}, a AS (SELECT case_id % 500 AS case_id, avg(p_yes) AS m, count(*) AS n, avg((p_yes > 0.5)::INT) AS above FROM preds GROUP BY 1)
SELECT case_id, n, round_even(m, 4) AS p_x, round_even(CASE WHEN m > 0.5 THEN above ELSE 1 - above END, 3) AS agree,
 CASE WHEN abs(m - 0.5) > 0.1 AND CASE WHEN m > 0.5 THEN above ELSE 1 - above END >= 0.75 THEN CASE WHEN m > 0.5 THEN 'X' ELSE 'Y' END END AS pref FROM a"""
)
def anchor_stability(spark, d):
    rows = v.predictions(spark, d).select((F.col("case_id") % 500).alias("case_id"), "p_yes")
    return consensus.anchors(rows, "case_id", "p_yes")


@query("SELECT pair, epoch_batch, slot FROM (SELECT p AS pair, floor(r / 8)::BIGINT AS epoch_batch, r % 8 AS slot, r FROM (SELECT o_custkey AS p, row_number() OVER (ORDER BY sha256('45:' || o_custkey), o_custkey) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE r < floor(n / 8) * 8)")
def pair_sampler(spark, d):
    from ..operators.sampling import batches

    pairs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("pair")).distinct()
    return batches(pairs, "pair", 42, 3, 8, 1).select("pair", F.col("batch").alias("epoch_batch"), "slot")


@query(f"WITH {v.PAIRS} SELECT case_id, round(p_yes_x, 6) AS p_yes_x, round(p_yes_y, 6) AS p_yes_y FROM pairs")
def stream_pair_completion(spark, d):
    """The stream of answers joined into pairs by a stream-stream join; the clock is the case's place."""
    rows = _replayed(spark, d)
    timed = rows.withColumn("at", F.timestamp_seconds(F.floor(F.col("event_id") / 2) + 1_000_000_000))
    pairs = jobs.completed_pairs(timed, "case_id", "perspective", "p_yes", "at", "10 seconds", "1 day")
    return _now(spark, pairs, "append")


@query(f"WITH {v.PREDS} SELECT model, count(*) AS n, round(avg((p_yes > p_no)::INT), 6) AS yes_rate FROM preds GROUP BY 1")
def stream_running_summary(spark, d):
    return _now(spark, jobs.running_summary(_replayed(spark, d), ["model"], "p_yes", "p_no"), "complete")


LOGS = """lines AS (SELECT 'r' || user_id % 40 AS run, event_id AS place, event_id % 3 = 0 AS bar, event_id % 1000 AS done, event_id % 7200 AS spent, printf('%.2f', (event_id % 200 - 100) / 100.0::DOUBLE) AS reward, printf('%.3f', (event_id % 1000) / 1000.0::DOUBLE) AS zero FROM events),
bars AS (SELECT run, arg_max(done, place) AS done, arg_max(spent, place) AS spent FROM lines WHERE bar GROUP BY 1), tails AS (SELECT run, place, reward, zero FROM lines WHERE NOT bar QUALIFY row_number() OVER (PARTITION BY run ORDER BY place DESC) <= 5)"""


@query(
    f"""WITH {LOGS}, m AS (SELECT run, string_agg(printf('%.3f', reward::DOUBLE), ',' ORDER BY place) AS rewards, string_agg(zero, ',' ORDER BY place) AS zero_stds FROM tails GROUP BY 1), l AS (SELECT run, max(place) AS last_place FROM lines GROUP BY 1)
SELECT run, done, 1000::BIGINT AS total, round(done / 1000.0::DOUBLE, 6) AS share, round(CASE WHEN done > 0 THEN spent / done::DOUBLE * (1000 - done) END, 6) AS seconds_left, rewards, zero_stds, last_place, false AS stalled FROM l LEFT JOIN bars USING (run) LEFT JOIN m USING (run)"""
)
def stream_progress(spark, d):
    """Runs followed as their logs come in, in files of any order: progress, time left, the last five metrics, silence."""
    from ..session import STATE_STORE
    from ..streaming import monitor

    k = F.col("event_id")
    bar = F.format_string("%3d%%|##  | %d/1000 [%02d:%02d:%02d<01:00,  5.0s/it]", F.floor(k % 1000 / 10), k % 1000, F.floor(k % 7200 / 3600), F.floor(k % 3600 / 60), k % 60)
    metric = F.format_string("{'loss': '0.5', 'reward': '%.2f', 'frac_reward_zero_std': '%.3f'}", (k % 200 - 100) / 100.0, (k % 1000) / 1000.0)
    lines = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("r"), F.col("user_id") % 40).alias("run"), k.alias("place"), F.when(k % 3 == 0, bar).otherwise(metric).alias("value"))
    folder = shared_folder(spark)
    lines.repartition(4).write.parquet(f"{folder}/lines")
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        stream = monitor.monitored(jobs.parquet_stream(spark, f"{folder}/lines", lines.schema, 1), 3_600_000)
        keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/status/n={number}")
        query = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="200 milliseconds").start()
        monitor.until_read(query, lines.count())
    finally:
        spark.conf.set(STATE_STORE[0], before)
    last = keep_last(spark.read.parquet(f"{folder}/status"), ["run"], "batch")
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.format_string("%.3f", x)))
    return last.select("run", "done", "total", "share", "seconds_left", text("reward").alias("rewards"), text("frac_reward_zero_std").alias("zero_stds"), "last_place", "stalled")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value, 2 AS folders FROM events GROUP BY 1")
def stream_upsert(spark, d):
    """The last event of each user from a stream in batches: one comes again, and a compaction comes between others."""
    from ..streaming.table import UpsertTable

    folder = shared_folder(spark)
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "value")
    rows.repartition(6).write.parquet(f"{folder}/events")
    table = UpsertTable(spark, f"{folder}/table", ["user_id"], "event_id")

    def take(batch, number):
        table.write(batch, number)
        if number == 2:
            table.write(batch, 1)  # a batch that has been taken in comes again
        if number == 4:
            table.compact()

    stream = jobs.parquet_stream(spark, f"{folder}/events", rows.schema, 1)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.latest().withColumn("folders", F.lit(len(table.manifest()["folders"])))


def _replayed(spark, d):
    """The predictions as a stream of the files of a folder to which they were written."""
    folder = shared_folder(spark)
    rows = v.predictions(spark, d)
    rows.write.parquet(folder)
    return jobs.parquet_stream(spark, folder, rows.schema)


def _now(spark, stream, mode):
    """All that a stream gives on what is there now, written by its sink and read back."""
    out = shared_folder(spark)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    else:
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(out)
        query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY sha256('5:' || event_id), event_id) AS r FROM events) WHERE r <= 25")
def hash_ranked_report(spark, d):
    """The 25 events that rank first by hash: a report of a fixed size."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", hash_rank_key(5, F.col("event_id")).alias("_k"))
    return rows.orderBy("_k", "event_id").limit(25).select("event_id")
