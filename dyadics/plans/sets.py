"""Queries on case lists, codes, utilities and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import choices as ch
from ..functions.codes import levels, profile_difference, stratum
from ..operators import audit, behavior, concentration, consensus, sampling
from . import views as v
from .register import registry

QUERIES, ORACLES, query = registry()
SEED = 20_260_710


@query(f"WITH {v.CASES} SELECT case_id, code, {v.LEVELS} FROM cases")
def decode_codes(spark, d):
    rows = v.cases(spark, d).select("case_id", "code", levels(F.col("code")).alias("_l"))
    return rows.select("case_id", "code", *(F.col("_l")[n].alias(c) for n, c in enumerate("ijkl")))


@query(f"WITH {v.CASES}, c AS (SELECT case_id, {v.LEVELS} FROM cases) SELECT case_id, array_to_string(list_transform(range(1, 9), lambda p: (i * 3 + j = p)::INT - (k * 3 + l = p)::INT), ',') AS difference FROM c")
def profile_differences(spark, d):
    rows = v.with_levels(v.cases(spark, d))
    diff = profile_difference(F.col("i") * 3 + F.col("j"), F.col("k") * 3 + F.col("l"))
    return rows.select("case_id", F.array_join(F.transform(diff, lambda x: x.cast("string")), ",").alias("difference"))


@query(f"WITH {v.CASES} SELECT c.range::INT AS code, count(case_id) AS n FROM range(81) c LEFT JOIN cases ON code = c.range GROUP BY 1")
def code_counts_zero_filled(spark, d):
    return sampling.code_counts(v.cases(spark, d))


@query(
    f"""WITH {v.CASES}, n AS (SELECT code, count(*) AS n FROM cases GROUP BY 1), f AS (SELECT c.range::INT AS code, coalesce(n.n, 0) AS n FROM range(81) c LEFT JOIN n ON n.code = c.range),
p AS (SELECT -1 AS place, code AS value, n FROM f UNION ALL SELECT 0, code % 3, n FROM f UNION ALL SELECT 1, (code // 3) % 3, n FROM f UNION ALL SELECT 2, (code // 9) % 3, n FROM f UNION ALL SELECT 3, (code // 27) % 3, n FROM f),
s AS (SELECT place, value, sum(n)::DOUBLE AS n FROM p GROUP BY 1, 2), m AS (SELECT place, avg(n) AS mean FROM s GROUP BY 1)
SELECT place, round(sum((n - mean) * (n - mean) / mean), 6) AS chi2, round(max(abs(n - mean) / mean), 6) AS max_deviation FROM s JOIN m USING (place) GROUP BY 1"""
)
def marginal_balance_chi2(spark, d):
    return sampling.balance(sampling.code_counts(v.cases(spark, d)))


def _lists(spark, d):
    """A list of codes an order: one to four of them, by its key."""
    o = v.cases(spark, d)
    codes = F.transform(F.sequence(F.lit(0), (F.col("case_id") % 4).cast("int")), lambda i: ((F.col("code") + i * 7) % 81).cast("int"))
    return o.select(F.col("case_id").alias("list_id"), "x_num", "y_num", codes.alias("codes"))


LISTS = v.CASES + ", lists AS (SELECT case_id AS list_id, x_num, y_num, list_transform(range(case_id % 4 + 1), lambda i: ((code + i * 7) % 81)::INT) AS codes FROM cases)"


@query(f"WITH {LISTS}, e AS (SELECT list_id, x_num, y_num, unnest(codes) AS code, generate_subscripts(codes, 1) AS pos FROM lists) SELECT row_number() OVER (ORDER BY list_id, pos) AS case_id, list_id, x_num, y_num, code FROM e")
def explode_cases_running_id(spark, d):
    return sampling.cases(_lists(spark, d), "list_id").select("case_id", "list_id", "x_num", "y_num", "code")


@query(f"WITH {LISTS}, f AS (SELECT x_num AS file, sum(len(codes))::BIGINT AS cases FROM lists GROUP BY 1) SELECT file, cases, (coalesce(sum(cases) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_id FROM f")
def offsets_by_file(spark, d):
    files = _lists(spark, d).groupBy(F.col("x_num").alias("file")).agg(F.sum(F.size("codes")).alias("cases"))
    return sampling.numbered(files, "file", "cases")


@query(
    f"""WITH {LISTS}, b AS (SELECT list_id, x_num, y_num, list_concat(codes, CASE WHEN list_id % 50 = 0 THEN [99] ELSE [] END) AS codes FROM lists)
SELECT x_num AS x, y_num AS y, 'number of codes' AS rule, count(*) AS n FROM b WHERE len(codes) <> 2 GROUP BY 1, 2 UNION ALL
SELECT x_num, y_num, 'code out of range', count(*) FROM b WHERE list_id % 50 = 0 GROUP BY 1, 2 UNION ALL
SELECT x_num, y_num, 'repeated pair', 1 FROM b GROUP BY 1, 2 HAVING count(*) > 1"""
)
def case_list_violations(spark, d):
    lists = _lists(spark, d).select(F.col("x_num").alias("x"), F.col("y_num").alias("y"), F.concat("codes", F.when(F.col("list_id") % 50 == 0, F.array(F.lit(99))).otherwise(F.array().cast("array<int>"))).alias("codes"))
    return audit.bad_cases(lists, 100, 2).groupBy("x", "y", "rule").agg(F.count("*").alias("n"))


UNUSED = v.CASES + """, u AS (SELECT DISTINCT x_num, y_num, code FROM cases), p AS (SELECT DISTINCT x_num, y_num FROM cases),
unused AS (SELECT x_num, y_num, c.range::INT AS code FROM p, range(81) c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.x_num = p.x_num AND u.y_num = p.y_num AND u.code = c.range))"""


@query(f"WITH {UNUSED} SELECT x_num, y_num, count(*) AS unused, min(code) AS first_code, sum(code)::BIGINT AS total FROM unused GROUP BY 1, 2")
def unused_codes_antijoin(spark, d):
    rows = sampling.unused_codes(v.cases(spark, d), ["x_num", "y_num"])
    return rows.groupBy("x_num", "y_num").agg(F.count("*").alias("unused"), F.min("code").alias("first_code"), F.sum("code").alias("total"))


@query(f"WITH {UNUSED} SELECT x_num, y_num, code, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY x_num, y_num ORDER BY sha256('{SEED}:' || x_num || ':' || y_num || ':' || code), x_num, y_num, code) AS rank FROM unused) WHERE rank <= 4")
def hash_rank_topn(spark, d):
    return sampling.ranked(sampling.unused_codes(v.cases(spark, d), ["x_num", "y_num"]), ["x_num", "y_num"], SEED, ["x_num", "y_num", "code"], 4)


_BIN = "CASE WHEN abs(delta) < 0.02 THEN '<0.02' WHEN abs(delta) < 0.04 THEN '0.02-0.04' WHEN abs(delta) < 0.06 THEN '0.04-0.06' ELSE '>=0.06' END"


@query(
    f"""WITH {v.DELTAS}, m AS (SELECT case_id, round(avg(delta), 6) AS delta FROM deltas GROUP BY 1), s AS (SELECT case_id, (CASE WHEN delta > 0 THEN '+' ELSE '-' END) || '|' || {_BIN} AS stratum FROM m)
SELECT stratum, case_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || case_id), case_id) AS rank FROM s) WHERE rank <= 12"""
)
def stratified_hash_sample(spark, d):
    means = v.deltas(spark, d).groupBy("case_id").agg(F.round(F.avg("delta"), 6).alias("delta"))
    rows = means.select("case_id", stratum(F.col("delta"), (0.02, 0.04, 0.06)).alias("stratum"))
    return sampling.ranked(rows, ["stratum"], 7, ["case_id"], 12)


@query(f"WITH {v.CASES} SELECT case_id, n::INT AS slot, list_extract(range(81), ((case_id * 8 + n) % 81 + 1))::INT AS code FROM cases, range(8) t(n)")
def rotating_window(spark, d):
    rows = sampling.rotating_codes(v.cases(spark, d).select("case_id"), "case_id", list(range(81)), 8)
    return rows.withColumn("slot", F.pmod(F.col("code") - F.col("case_id") * 8, F.lit(81)).cast("int"))


LOOKUP = v.CASES + f""", {v.UTIL}, l AS (SELECT case_id, x_num, y_num, {v.LEVELS} FROM cases),
j AS (SELECT l.case_id, l.x_num, l.y_num, a.utility AS u_x, b.utility AS u_y FROM l LEFT JOIN util a ON a.idx = x_num AND a.a1 = i AND a.a2 = j LEFT JOIN util b ON b.idx = y_num AND b.a1 = k AND b.a2 = l)"""


def _looked_up(spark, d, missing="null"):
    return consensus.with_utilities(v.with_levels(v.cases(spark, d)), v.utilities(spark, d), missing)


@query(f"WITH {LOOKUP} SELECT case_id, round(u_x, 6) AS u_x, round(u_y, 6) AS u_y FROM j")
def utility_lookup_two_sided(spark, d):
    return _looked_up(spark, d).select("case_id", "u_x", "u_y")


@query(f"WITH {LOOKUP} SELECT case_id, round(u_x, 6) AS u_x, round(u_y, 6) AS u_y FROM j WHERE u_x IS NOT NULL AND u_y IS NOT NULL")
def utility_lookup_skip(spark, d):
    return _looked_up(spark, d, "skip").select("case_id", "u_x", "u_y")


SCORES = LOOKUP + ", s AS (SELECT x_num, CASE WHEN case_id % 3 = 0 THEN u_x ELSE u_y END / greatest(u_x, u_y) AS w, u_x, u_y FROM j)"


def _scores(spark, d):
    rows = _looked_up(spark, d)
    chosen = F.when(F.col("case_id") % 3 == 0, "X").otherwise("Y")
    return rows.select("x_num", ch.utility_score(chosen, F.col("u_x"), F.col("u_y")).alias("w"))


@query(f"WITH {SCORES}, t AS (SELECT x_num, CASE WHEN u_x IS NOT NULL AND u_y IS NOT NULL THEN w END AS w FROM s) SELECT x_num, count(w) AS n, round(avg(w), 6) AS w, round(avg((w = 1)::INT), 6) AS rational_rate, count(*) FILTER (w IS NULL) AS skipped FROM t GROUP BY 1")
def w_alignment(spark, d):
    return behavior.alignment(_scores(spark, d), ["x_num"], "w")


@query(f"WITH {SCORES} SELECT CASE WHEN w = 1 THEN 5 ELSE floor(w * 5)::INT END AS bucket, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM s WHERE u_x IS NOT NULL AND u_y IS NOT NULL GROUP BY 1")
def w_distribution(spark, d):
    from pyspark.sql.window import Window

    rows = _scores(spark, d).where("w IS NOT NULL").groupBy(F.when(F.col("w") == 1, 5).otherwise(F.floor(F.col("w") * 5).cast("int")).alias("bucket")).agg(F.count("*").alias("n"))
    return rows.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


_BUCKET = "CASE WHEN d > 0 AND d <= 0.02 THEN 0 WHEN d > 0.02 AND d <= 0.05 THEN 1 WHEN d > 0.05 THEN 2 END"


@query(f"WITH {v.DELTAS}, s AS (SELECT abs(delta) AS d, (sign(delta) = sign(25 - l_quantity))::INT AS same FROM deltas WHERE abs(delta) >= 1e-9 AND l_quantity <> 25), b AS (SELECT {_BUCKET} AS bucket, same FROM s) SELECT bucket, count(*) AS n, round(avg(same), 6) AS agreement FROM b GROUP BY ROLLUP (bucket)")
def sign_agreement_buckets(spark, d):
    rows = v.deltas(spark, d).select("delta", (25 - F.col("l_quantity")).alias("other"))
    return consensus.sign_agreement(rows, "delta", "other", [0, 0.02, 0.05, float("inf")])


CONSENSUS = v.DELTAS + """, c AS (SELECT case_id, count(DISTINCT model) AS models, avg(d) AS mean_delta, max(d) - min(d) AS spread,
 count(*) FILTER (d > 0) = 0 OR count(*) FILTER (d < 0) = 0 AS unanimous_sign FROM (SELECT case_id, model, round(avg(delta), 6) AS d FROM deltas GROUP BY 1, 2) GROUP BY 1)"""


def _consensus(spark, d):
    per = v.deltas(spark, d).groupBy("case_id", "model").agg(F.round(F.avg("delta"), 6).alias("delta"))
    return consensus.consensus(per, "case_id", "model", "delta")


@query(f"WITH {CONSENSUS} SELECT case_id, models, round(mean_delta, 6) AS mean_delta, round(spread, 6) AS spread, unanimous_sign FROM c")
def consensus_delta(spark, d):
    return _consensus(spark, d)


@query(f"WITH {CONSENSUS} SELECT case_id, round(spread, 6) AS spread FROM c ORDER BY round(spread, 6) DESC, case_id LIMIT 10")
def top_disagreement(spark, d):
    return _consensus(spark, d).select("case_id", F.round("spread", 6).alias("spread")).orderBy(F.desc("spread"), "case_id").limit(10)


@query(f"WITH {v.DELTAS}, s AS (SELECT abs(delta) AS v, row_number() OVER (ORDER BY abs(delta)) - 1 AS r, count(*) OVER () AS n FROM deltas) SELECT q AS share, round(v, 6) AS value FROM s, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (0.95)) t(q) WHERE r = least(floor(q * n), n - 1)")
def quantile_nearest_rank(spark, d):
    return consensus.nearest_rank_quantiles(v.deltas(spark, d).select(F.abs("delta").alias("delta")), "delta", [0.0, 0.25, 0.5, 0.75, 0.95])


@query(f"WITH {v.DELTAS} SELECT model, count(delta) AS n, round(avg(abs(delta)), 6) AS mean_abs, round(sqrt(avg(delta * delta)), 6) AS rms, round(quantile_cont(abs(delta), 0.5), 6) AS median_abs, round(stddev_pop(abs(delta)), 6) AS sd_abs, round(min(delta), 6) AS least, round(max(delta), 6) AS greatest FROM deltas GROUP BY 1")
def delta_moments(spark, d):
    return consensus.moments(v.deltas(spark, d), "delta", ["model"])


@query(f"WITH {v.DELTAS}, s AS (SELECT abs(delta) AS d FROM deltas), b AS (SELECT {_BUCKET} AS bin, d FROM s) SELECT bin, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS case_share, round(sum(d) / sum(sum(d)) OVER (), 6) AS mass_share FROM b WHERE bin IS NOT NULL GROUP BY 1")
def mass_concentration(spark, d):
    return consensus.mass_by_bin(v.deltas(spark, d), "delta", [0, 0.02, 0.05, float("inf")])


def _spend(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_custkey") % 25).alias("segment"), "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))


SPEND = "spend AS (SELECT o_custkey % 25 AS segment, o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1, 2)"


@query(f"WITH {SPEND} SELECT segment, o_custkey, spend, row_number() OVER w::INT AS rank, round(sum(spend) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(spend) OVER (PARTITION BY segment), 6) AS cum_share FROM spend WINDOW w AS (PARTITION BY segment ORDER BY spend DESC, o_custkey)".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def cumulative_share(spark, d):
    from ..operators.windows import cumulative_share as shares

    return shares(_spend(spark, d), ["segment"], "spend", "o_custkey")


@query(f"WITH {SPEND}, r AS (SELECT segment, spend, 2 * row_number() OVER (PARTITION BY segment ORDER BY spend) - count(*) OVER (PARTITION BY segment) - 1 AS k FROM spend) SELECT segment, count(*) AS n, round(sum(spend), 2) AS total, round(sum(k * spend) / (count(*) * sum(spend)), 6) AS gini FROM r GROUP BY 1")
def gini(spark, d):
    return concentration.gini(_spend(spark, d), ["segment"], "spend").withColumn("total", F.round("total", 2))


@query(f"WITH {SPEND}, r AS (SELECT segment, spend, row_number() OVER (PARTITION BY segment ORDER BY spend DESC, o_custkey) AS r, count(*) OVER (PARTITION BY segment) AS n FROM spend) SELECT segment, round(sum(CASE WHEN r <= 5 THEN spend ELSE 0 END) / sum(spend), 6) AS top_k_share, round(sum(CASE WHEN r <= ceil(n * 0.1::DOUBLE) THEN spend ELSE 0 END) / sum(spend), 6) AS top_fraction_share FROM r GROUP BY 1")
def top_share(spark, d):
    return concentration.top_share(_spend(spark, d), ["segment"], "spend", 5, 0.1)


@query(
    f"""WITH {SPEND}, b AS (SELECT segment, o_custkey AS k, spend * CASE WHEN o_custkey % 40 = 0 THEN 1.001 ELSE 1 END AS v FROM spend WHERE o_custkey % 33 <> 0)
SELECT coalesce(a.o_custkey, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'left only' ELSE 'value' END AS kind FROM spend a LEFT JOIN b ON a.o_custkey = b.k WHERE b.k IS NULL OR abs(a.spend - b.v) > greatest(1e-9 * greatest(abs(a.spend), abs(b.v)), 1e-12)"""
)
def deep_compare_tolerance(spark, d):
    one = _spend(spark, d)
    two = one.where("o_custkey % 33 != 0").withColumn("spend", F.col("spend") * F.when(F.col("o_custkey") % 40 == 0, 1.001).otherwise(1.0))
    return audit.differences(one, two, ["o_custkey"], "spend")
