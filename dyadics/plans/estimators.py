"""Queries that fit models. Those of one or two regressors have closed forms in SQL; the iterative ones have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus, estimate, lowrank, survey
from . import views as v
from .register import registry

QUERIES, ORACLES, query = registry()

XY = "xy AS (SELECT l_suppkey AS g, l_partkey AS h, 1.0::DOUBLE AS one, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem)"
FIT = XY + """, t AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM xy),
b AS (SELECT n, n * sxx - sx * sx AS det, sx, sxx, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM t),
s AS (SELECT g, sum(y - b0 - b1 * x) AS u, sum(x * (y - b0 - b1 * x)) AS w FROM xy, b GROUP BY 1), m AS (SELECT count(*) AS k, sum(u * u) AS uu, sum(u * w) AS uw, sum(w * w) AS ww FROM s)"""


def _xy(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("h"), F.lit(1.0).alias("one"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10_000).alias("y"))


@query(
    f"""WITH {FIT}, v AS (SELECT b.*, k, (k / (k - 1)::DOUBLE) * ((n - 1) / (n - 2)::DOUBLE) AS f,
 (sxx * sxx * uu - 2 * sxx * sx * uw + sx * sx * ww) / (det * det) AS v0, (sx * sx * uu - 2 * sx * n * uw + n * n::DOUBLE * ww) / (det * det) AS v1 FROM b, m)
SELECT 'one' AS parameter, round(b0, 6) AS estimate, round(sqrt(f * v0), 6) AS std_err FROM v UNION ALL SELECT 'x', round(b1, 6), round(sqrt(f * v1), 6) FROM v"""
)
def ols_cluster_se(spark, d):
    return estimate.ols(_xy(spark, d), ["one", "x"], "y", ["g"]).table(spark).select("parameter", "estimate", "std_err")


PAIRS_XY = "xy AS (SELECT l_suppkey % 50 AS a, 50 + l_partkey % 50 AS b, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem)"


@query(
    f"""WITH {PAIRS_XY}, t AS (SELECT count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM xy),
g AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM (SELECT a AS g, x, y FROM xy UNION ALL SELECT b, x, y FROM xy) GROUP BY 1),
l AS (SELECT t.n - g.n AS n, t.sx - g.sx AS sx, t.sxx - g.sxx AS sxx, t.sy - g.sy AS sy, t.sxy - g.sxy AS sxy FROM t, g), e AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1 FROM l)
SELECT count(*) AS goods, round(avg(b1), 6) AS mean_slope, round(sqrt((count(*) - 1) * var_pop(b1)), 6) AS jackknife_se FROM e"""
)
def loo_good_jackknife(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = li.select((F.col("l_suppkey") % 50).alias("a"), (50 + F.col("l_partkey") % 50).alias("b"), F.lit(1.0).alias("one"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10_000).alias("y"))
    estimates, covariance = estimate.leave_one_good_out_ols(rows, ["one", "x"], "y", "a", "b")
    return spark.createDataFrame([(len(estimates), float(estimates[:, 1].mean()), float(covariance[1, 1]) ** 0.5)], "goods long, mean_slope double, jackknife_se double")


@query(
    f"""WITH {XY}, p AS (SELECT g, dense_rank() OVER (ORDER BY g) - 1 AS r, x, y FROM xy), f AS (SELECT (r % 5)::INT AS fold, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM p GROUP BY 1),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy FROM f), o AS (SELECT f.*, t.n - f.n AS tn, t.sx - f.sx AS tsx, t.sxx - f.sxx AS tsxx, t.sy - f.sy AS tsy, t.sxy - f.sxy AS tsxy FROM f, t),
b AS (SELECT *, (tn * tsxy - tsx * tsy) / (tn * tsxx - tsx * tsx) AS b1, (tsxx * tsy - tsx * tsxy) / (tn * tsxx - tsx * tsx) AS b0 FROM o)
SELECT fold, n::BIGINT AS n, round((syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n, 6) AS mse FROM b"""
)
def grouped_cv_mse(spark, d):
    return estimate.grouped_folds(_xy(spark, d), ["one", "x"], "y", ["g"], 5)


def _pairs(spark, d):
    rows = v.with_levels(v.paired(spark, d))
    return rows.where("p_no_x IS NOT NULL AND p_no_y IS NOT NULL")


#: The structural answers are made with these; the events' values are their noise.
LAMBDA, ETA = 0.5, -0.5


def _answered(spark, d):
    """Pairs whose probabilities follow the goods' utilities, so that the parameters are there to be found."""
    # the mean prices hardly differ; their powers do, about 1
    spread = v.utilities(spark, d).withColumn("utility", F.pow(F.col("utility") / 0.95, F.lit(16.0)))
    rows = consensus.with_utilities(_pairs(spark, d), spread, "skip")
    chance = lambda own, other, p: 1 / (1 + F.exp(-((1 + LAMBDA) * F.col(own) - F.col(other) + ETA + (F.col(p) - 0.5) / 4)))
    return rows.withColumns({"p_no_x": chance("u_x", "u_y", "p_no_x"), "p_no_y": chance("u_y", "u_x", "p_no_y")})


def _with_utilities(spark, d):
    return _answered(spark, d).select("model", "x_num", "y_num", "u_x", "u_y", "p_no_x", "p_no_y")


@query()
def fit_lambda_eta(spark, d):
    """Two parameters for each model, given the utilities."""
    return estimate.lambda_eta(_with_utilities(spark, d), ["model"]).select("model", "lambda", "eta", "cost", "n", "converged", "jac_cond")


@query()
def bootstrap_lambda_eta(spark, d):
    """Both parameters of all answers with errors and intervals over 2,000 draws of whole pairs of goods."""
    return estimate.lambda_eta_bootstrap(_with_utilities(spark, d), ["x_num", "y_num"])


@query()
def refit_without_each_good(spark, d):
    """Both parameters without each good, and whether it is the good whose absence gives the largest |lambda|."""
    fits = estimate.lambda_eta_without_each_good(_with_utilities(spark, d), "x_num", "y_num")
    most = survey.most_influential(fits, "lambda", F.col("converged")).select("good", F.lit(True).alias("most_influential"))
    return fits.join(most, "good", "left").withColumn("most_influential", F.coalesce("most_influential", F.lit(False)))


def _structural(spark, d):
    return estimate.panel(_answered(spark, d))


@query()
def start_values(spark, d):
    """Start values of all parameters by the pooled regression in levels and by two stages of least squares."""
    rows = _structural(spark, d)
    ols, nls = estimate.starts(rows, 100, "ols"), estimate.starts(estimate.cells(rows), 100, "nls")
    return spark.createDataFrame(list(zip(estimate.parameter_names(100), ols.tolist(), nls.tolist(), strict=True)), "parameter string, ols double, nls double")


@query()
def nls_full(spark, d):
    """All parameters of model A by bounded least squares from the pooled regression's start, to convergence."""
    rows = _structural(spark, d)
    return estimate.fit(rows, 100, "nls", start=estimate.ols_start(rows, 100)).table(spark)


@query()
def nls_diagnostics(spark, d):
    """Model A without lambda and eta (restricted), in full, and what its Jacobian tells."""
    rows = _structural(spark, d)
    start = estimate.ols_start(rows, 100)
    full = estimate.fit(rows, 100, "nls", start=start)
    restricted = estimate.fit(rows, 100, "nls", start=start, free=list(range(2, 109)), bounds={})
    return full.diagnostics(spark).withColumn("restricted_objective", F.lit(restricted.objective))


@query()
def multistart_refits(spark, d):
    """Model A from several starts: how far the estimates depend on them."""
    rows = _structural(spark, d)
    return estimate.refits(rows, 100, estimate.perturbed_starts(estimate.ols_start(rows, 100), 3, 7, 0.1))


@query()
def mle_full(spark, d):
    """All parameters of model C by logit likelihood, to convergence."""
    rows = _structural(spark, d)
    return estimate.fit(rows, 100, "mle", start=estimate.ols_start(rows, 100), bounds={0: (-1.0, float("inf"))}).table(spark)


@query()
def sms_fit(spark, d):
    """Model B: smoothed maximum score from model A's estimates, with errors over 500 draws of cases."""
    rows = _structural(spark, d)
    found = estimate.smoothed_maximum_score(rows, 100)
    return estimate.bootstrap_errors(rows, found, 100, found.width).withColumn("converged", F.lit(found.converged))


@query()
def latent_index(spark, d):
    """Moments of the latent index and its density at 0 at model A's estimates, for the three utility specifications."""
    rows = _structural(spark, d)
    out = None
    for spec in (1, 2, 3):
        found = estimate.fit(rows, 100, "nls", spec, start=estimate.ols_start(rows, 100, spec))
        one = estimate.latent(rows, found, 100, spec).select(F.lit(spec).alias("spec"), "*", F.lit(found.objective).alias("objective"), F.lit(found.converged).alias("converged"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def levels_diagnostic(spark, d):
    """How much profiles explain beyond items, in levels and across folds of pairs."""
    rows = _structural(spark, d)
    pair = F.least("own_item", "other_item") * 100 + F.greatest("own_item", "other_item")
    return estimate.levels_diagnostic(rows.withColumn("fold", F.pmod(pair, F.lit(10))), 100, "fold")


@query(
    f"""WITH {v.PAIRS}, g AS (SELECT case_id // 2 AS g, arg_min(p_no_x, case_id) AS ax, arg_max(p_no_x, case_id) AS bx, arg_min(p_no_y, case_id) AS ay, arg_max(p_no_y, case_id) AS dy FROM pairs GROUP BY 1 HAVING count(*) = 2),
f AS (SELECT abs(bx - ax) AS cx, abs(dy - ay) AS cy, (ax >= 0.5) <> (bx >= 0.5) AS fx, (ay >= 0.5) <> (dy >= 0.5) AS fy FROM g), m AS (SELECT quantile_cont(c, 0.5) AS med FROM (SELECT cx AS c FROM f UNION ALL SELECT cy FROM f))
SELECT count(*) AS pairs, round((avg(cx) + avg(cy)) / 2, 6) AS mean_abs_change, count(*) FILTER (fx) AS x_flips, count(*) FILTER (fy) AS y_flips, count(*) FILTER (fx OR fy) AS either_flips, count(*) FILTER (fx AND fy) AS both_flips, round(any_value(med), 6) AS median_abs_change FROM f, m"""
)
def first_difference_sensitivity(spark, d):
    rows = v.paired(spark, d).withColumn("group", F.floor(F.col("case_id") / 2))
    return estimate.first_difference_sensitivity(rows, ["group"], "case_id", "p_no_x", "p_no_y")


@query(
    f"""WITH {v.PAIRS}, {v.UTIL}, p AS (SELECT case_id, x_num, y_num, {v.LEVELS} FROM pairs), j AS (SELECT p.case_id, a.utility * 1.0137::DOUBLE AS ux, b.utility * 0.9871::DOUBLE AS uy FROM p JOIN util a ON a.idx = x_num AND a.a1 = i AND a.a2 = j JOIN util b ON b.idx = y_num AND b.a1 = k AND b.a2 = l)
SELECT case_id, round_even(0.5 + 1.25 * ux - uy, 4) AS delta_x, round_even(0.5 + 1.25 * uy - ux, 4) AS delta_y, round_even(ux - uy, 4) AS delta_tilde_x, round_even(uy - ux, 4) AS delta_tilde_y FROM j"""
)
def delta_tilde(spark, d):
    rows = consensus.with_utilities(_pairs(spark, d).select("case_id", "x_num", "y_num", "i", "j", "k", "l"), v.utilities(spark, d), "skip")
    scaled = rows.withColumns({"u_x": F.col("u_x") * 1.0137, "u_y": F.col("u_y") * 0.9871})  # no value lies between two roundings
    return consensus.biased_deltas(scaled, 0.25, 0.5).drop("x_num", "y_num", "i", "j", "k", "l", "u_x", "u_y")


@query("SELECT p_partkey % 100 AS idx, a.range::INT AS a1, b.range::INT AS a2, round(exp((p_partkey % 100) / 100.0::DOUBLE + (a.range * 3 + b.range) / 10.0::DOUBLE), 6) AS utility FROM (SELECT DISTINCT p_partkey % 100 AS p_partkey FROM part), range(3) a, range(3) b")
def utility_grid(spark, d):
    goods = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 100).alias("idx")).distinct().withColumn("alpha", F.col("idx") / 100.0)
    beta = spark.range(9).select(F.floor(F.col("id") / 3).cast("int").alias("a1"), (F.col("id") % 3).cast("int").alias("a2"), (F.col("id") / 10.0).alias("beta"))
    return consensus.utility_grid(goods, beta)


def _design(spark, d):
    """Pairs of forty goods with their utilities, from the prices of all parts, and how many orders are cases of each."""
    price = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_partkey") % 40).alias("g")).agg(F.pow(F.avg("p_retailprice") / 950.0, F.lit(16.0)).alias("u"))
    o = spark.read.parquet(f"{d}/orders.parquet")
    pairs = o.groupBy((F.col("o_custkey") % 20).alias("x"), (20 + F.col("o_orderkey") % 20).alias("y")).agg(F.count("*").alias("weight"))
    return pairs.join(price.select(F.col("g").alias("x"), F.col("u").alias("u_x")), "x").join(price.select(F.col("g").alias("y"), F.col("u").alias("u_y")), "y")


@query()
def recovery_study(spark, d):
    """Bias, spread and coverage of two-parameter fits to answers by chance on the orders' design: the whole grid, and the parameters fitted to the answers."""
    fitted = estimate.lambda_eta(_with_utilities(spark, d).withColumn("all", F.lit(1)), ["all"]).first()
    grid = [(a, b) for a in (0.05, 0.5, 2.0, 5.0) for b in (0.0, 0.5, 1.0)]
    return estimate.recovery(spark, [*grid, (fitted["lambda"], fitted["eta"])], seed=20_260_730, design=_design(spark, d))


@query("WITH p AS (SELECT p_partkey % 40 AS g, avg(p_retailprice) AS u FROM part GROUP BY 1), o AS (SELECT o_custkey % 20 AS x, 20 + o_orderkey % 20 AS y, count(*) AS weight FROM orders GROUP BY 1, 2) SELECT x, y, weight, round(power(a.u / 950.0::DOUBLE, 16), 6) AS u_x, round(power(b.u / 950.0::DOUBLE, 16), 6) AS u_y FROM o JOIN p a ON a.g = x JOIN p b ON b.g = y")
def recovery_design(spark, d):
    """The design that the recovery study takes its cases from."""
    return _design(spark, d).select("x", "y", "weight", "u_x", "u_y")


def _factors(spark, d):
    """Embeddings taken as factors: A of 4 x 8 and B of 8 x 4."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    rows = lambda n, k, at: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("embedding", i * k + 1 + at, F.lit(k)))
    return e.select("vec_id", rows(4, 8, 0).alias("A"), rows(8, 4, 32).alias("B"))


@query(
    """WITH f AS (SELECT vec_id, unnest(range(8)) AS o, embedding AS e FROM embeddings), g AS (SELECT vec_id, o, unnest(range(8)) AS i, e FROM f),
p AS (SELECT vec_id, list_sum(list_transform(range(4), lambda r: e[33 + o * 4 + r]::DOUBLE * e[1 + r * 8 + i]::DOUBLE)) AS x FROM g) SELECT vec_id, round(sqrt(sum(x * x)), 6) AS fro FROM p GROUP BY 1"""
)
def lowrank_norms(spark, d):
    return lowrank.module_table(_factors(spark, d), ["vec_id"]).select("vec_id", "fro")


@query(
    """WITH f AS (SELECT vec_id, unnest(range(8)) AS o, embedding AS e FROM embeddings), g AS (SELECT vec_id, o, unnest(range(8)) AS i, e FROM f),
p AS (SELECT vec_id, list_sum(list_transform(range(4), lambda r: e[33 + o * 4 + r]::DOUBLE * e[1 + r * 8 + i]::DOUBLE)) AS x, list_sum(list_transform(range(4), lambda r: e[33 + o * 4 + r]::DOUBLE * e[1 + (3 - r) * 8 + i]::DOUBLE)) AS y FROM g)
SELECT vec_id, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS cosine, round(sqrt(sum(x * x)), 6) AS fro_one, round(sqrt(sum(y * y)), 6) AS fro_two, round(sqrt(sum((x - y) * (x - y))), 6) AS difference FROM p GROUP BY 1"""
)
def lowrank_compare(spark, d):
    """Each module against itself with its rows reversed."""
    f = _factors(spark, d)
    return lowrank.compare(f, f.select("vec_id", F.reverse("A").alias("A"), "B"), ["vec_id"])


@query(
    """WITH f AS (SELECT vec_id, unnest(range(8)) AS o, embedding AS e FROM embeddings), g AS (SELECT vec_id, o, unnest(range(8)) AS i, e FROM f),
p AS (SELECT vec_id, list_sum(list_transform(range(4), lambda r: e[33 + o * 4 + r]::DOUBLE * e[1 + r * 8 + i]::DOUBLE)) AS x FROM g) SELECT vec_id, round(sqrt(sum(x * x)), 5) AS fro, true AS spectral_agrees FROM p GROUP BY 1"""
)
def lowrank_power(spark, d):
    """Norms by chunks, and whether subspace iteration and the QR factors agree on the spectral norm."""
    f = _factors(spark, d)
    exact = lowrank.module_table(f, ["vec_id"]).select("vec_id", "spectral")
    both = lowrank.power_norms(f, ["vec_id"]).join(exact, "vec_id")
    return both.select("vec_id", F.round("fro", 5).alias("fro"), (F.abs(F.col("spectral_power") - F.col("spectral")) <= 1e-6 * F.col("spectral")).alias("spectral_agrees"))


@query(
    """WITH f AS (SELECT vec_id, unnest(range(8)) AS o, embedding AS e FROM embeddings), g AS (SELECT vec_id, o, unnest(range(8)) AS i, e FROM f),
p AS (SELECT vec_id, o, i, list_sum(list_transform(range(4), lambda r: e[33 + o * 4 + r]::DOUBLE * e[1 + r * 8 + i]::DOUBLE)) AS x FROM g),
r AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('5:' || vec_id), vec_id) - 1 AS ix, count(*) OVER () AS n FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS other FROM r a JOIN r b ON b.ix = (a.ix + 1) % a.n),
c AS (SELECT d.vec_id, d.other, sum(x.x * y.x) / sqrt(sum(x.x * x.x) * sum(y.x * y.x)) AS cosine FROM d JOIN p x ON x.vec_id = d.vec_id JOIN p y ON y.vec_id = d.other AND y.o = x.o AND y.i = x.i GROUP BY 1, 2)
SELECT vec_id, other, round(cosine, 6) AS cosine, round((SELECT quantile_cont(abs(cosine), 0.95) FROM c), 6) AS null_95 FROM c"""
)
def cosine_null(spark, d):
    """Each module's cosine with the one that a derangement gives it, and how far 95 % of these are from 0."""
    found = lowrank.permuted_cosines(_factors(spark, d), "vec_id", 5).select("vec_id", "other", "cosine").persist()
    return found.crossJoin(F.broadcast(found.agg(F.percentile(F.abs("cosine"), F.lit(0.95)).alias("null_95"))))  # one row


@query("SELECT vec_id, vec_id % 28 AS layer, CASE WHEN vec_id % 3 = 0 THEN 'q_proj' END AS module, vec_id % 3 = 0 AS fits FROM embeddings")
def adapter_names(spark, d):
    """Layer and module taken from the names of tensors; others do not fit."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id")
    k = F.col("vec_id")
    name = F.when(k % 3 == 0, F.format_string("base.model.layers.%d.self_attn.q_proj.lora_A.weight", k % 28)).otherwise(F.format_string("model.layers.%d.norm.weight", k % 28))
    parts = lowrank.module_key(name, ("q_proj", "v_proj"))
    return e.select("vec_id", (k % 28).alias("layer"), parts["module"].alias("module"), (parts["layer"] == k % 28).alias("fits")).withColumn("fits", F.coalesce("fits", F.lit(False)))
