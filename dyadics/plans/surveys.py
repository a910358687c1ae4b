"""Queries on designs, surveys of models and forms, gates and records."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions import records as rec
from ..operators import designs, gates, survey
from ..sources.sinks import canonical_json
from . import views as v
from .register import registry

QUERIES, ORACLES, query = registry()


def _goods(spark, d):
    """A catalogue of 40 goods from all parts, each good a class of them: names, two attributes of three levels; some goods share their attributes."""
    p = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_partkey") % 40).alias("k")).agg(F.min("p_brand").alias("p_brand"))
    k = F.col("k")
    attribute = lambda n: F.struct(F.concat(F.lit(f"trait {n} "), (k % (5 - n)).cast("string")).alias("name"), F.array(*(F.concat(F.lit(f"level {m} of "), k.cast("string")) for m in range(3))).alias("levels"))
    return p.select(k.cast("int").alias("idx"), F.col("p_brand").alias("category"), F.concat(F.lit("Good "), k.cast("string")).alias("name"), F.array(attribute(0), attribute(1)).alias("attrs"))


GOODS = "goods AS (SELECT DISTINCT (p_partkey % 40)::INT AS idx, 'good ' || p_partkey % 40 AS name, 'trait 0 ' || p_partkey % 40 % 5 AS a, 'trait 1 ' || p_partkey % 40 % 4 AS b FROM part)"


@query("WITH n AS (SELECT DISTINCT p_partkey % 40 AS x FROM part), p AS (SELECT a.x::INT AS x_num, b.x::INT AS y_num, row_number() OVER (ORDER BY a.x, b.x) - 1 AS pair FROM n a JOIN n b ON a.x < b.x) SELECT x_num, y_num, pair, ((pair * 8 + k) * 2 % 81)::INT AS code, k::INT AS pos FROM p, range(8) r(k)")
def goods_pairs(spark, d):
    codes = [2 * n % 81 for n in range(81)]
    rows = designs.goods_pairs(_goods(spark, d), codes, 8)
    return rows.select("x_num", "y_num", "pair", F.posexplode("codes").alias("pos", "code"))


@query("WITH n AS (SELECT DISTINCT p_partkey % 40 AS x FROM part), p AS (SELECT a.x::INT AS x_num, b.x::INT AS y_num, row_number() OVER (ORDER BY a.x, b.x) - 1 AS pair FROM n a JOIN n b ON a.x < b.x) SELECT 1 + pair * 8 + k AS case_id, x_num, y_num, ((pair * 8 + k) % 81)::INT AS code FROM p, range(8) r(k)")
def numbered_cases(spark, d):
    return designs.numbered_cases(designs.goods_pairs(_goods(spark, d), designs.rotating_codes(0, 81), 8))


def _small_cases(spark, d):
    """Cases over the forty goods."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    x, y = (F.col("o_custkey") % 20).cast("int"), (20 + F.col("o_orderkey") % 20).cast("int")
    return o.select(F.col("o_orderkey").alias("case_id"), x.alias("x_num"), y.alias("y_num"), ((F.col("o_orderkey") * 7) % 81).cast("int").alias("code"))


SMALL = "small AS (SELECT o_orderkey AS case_id, (o_custkey % 20)::INT AS x_num, (20 + o_orderkey % 20)::INT AS y_num, ((o_orderkey * 7) % 81)::INT AS code FROM orders)"
_LEVEL = "'level ' || {0} || ' of ' || {1}"


def _filled(template: str) -> str:
    """A prompt's template as SQL: its texts joined to the columns that it names."""
    parts = re.split(r"[{}]", template)
    texts = ["'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if n % 2 == 0 else t for n, t in enumerate(parts)]
    return "(" + " || ".join(t for t in texts if t != "''") + ")"


def _by(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {_filled(t)}" for k, t in table.items()) + " END"


def _goods_named(e: str, o: str, e1: str, e2: str, o1: str, o2: str) -> str:
    """The names and values that fill the places of two goods' prompts."""
    out = [f"'good ' || {e} AS e", f"'good ' || {o} AS o"]
    for side, good, levels in (("e", e, (e1, e2)), ("o", o, (o1, o2))):
        for n, (letter, level) in enumerate(zip("ab", levels, strict=True)):
            out += [f"'trait {n} ' || {good} % {5 - n} AS {side}{letter}", f"{_LEVEL.format(level, good)} AS {side}{letter}v"]
    return ", ".join(out)


@query(
    f"""WITH {SMALL}, f AS (SELECT case_id, CASE WHEN p = 'X' THEN x_num ELSE y_num END AS keep_good, CASE WHEN p = 'X' THEN y_num ELSE x_num END AS trade_good,
 case_id || ':' || p || ':' || s || ':' || o || ':' || a || ':' || h AS form_id FROM small, (VALUES ('X'), ('Y')) pp(p), (VALUES ('yes_no'), ('keep_trade'), ('ab_kt'), ('ab_tk')) ss(s), (VALUES ('endowed_first'), ('offered_first')) oo(o), (VALUES ('normal'), ('reversed')) aa(a), (VALUES ('p0'), ('p1'), ('p2')) hh(h))
SELECT keep_good, trade_good, count(*) AS forms, count(DISTINCT form_id) AS ids, min(form_id) AS first_id, max(form_id) AS last_id FROM f GROUP BY 1, 2"""
)
def surface_forms(spark, d):
    return designs.surface_summary(_small_cases(spark, d))


_IN_TERMS = {
    "normal": "In terms of {%a}, the {%} is {%av}. In terms of {%b}, it is {%bv}.",
    "reversed": "In terms of {%b}, the {%} is {%bv}. In terms of {%a}, it is {%av}.",
}
_SIDES = f"""l AS (SELECT *, {v.LEVELS} FROM small), t AS (SELECT case_id, 'X' AS perspective, {_goods_named('x_num', 'y_num', *'ijkl')} FROM l UNION ALL SELECT case_id, 'Y', {_goods_named('y_num', 'x_num', *'klij')} FROM l)"""
_NL = " || chr(10) || "


@query(
    f"""WITH {SMALL}, {_SIDES}, f AS (SELECT * FROM t, (VALUES ('yes_no'), ('keep_trade'), ('ab_kt'), ('ab_tk')) ss(style), (VALUES ('endowed_first'), ('offered_first')) dd(display), (VALUES ('normal'), ('reversed')) aa(attr), (VALUES ('p0'), ('p1'), ('p2')) hh(phrase)),
b AS (SELECT *, {_by('phrase', pr.INTRO)} AS intro, {_by('phrase', pr.OPTION)} AS opt, {_by('style', pr.QUESTIONS)} AS question, {_by('attr', {k: t.replace('%', 'e') for k, t in _IN_TERMS.items()})} AS own, {_by('attr', {k: t.replace('%', 'o') for k, t in _IN_TERMS.items()})} AS other FROM f),
q AS (SELECT case_id, perspective, md5(CASE display WHEN 'offered_first' THEN intro{_NL}opt{_NL}other{_NL}'For the ' || e || ' you currently hold: ' || own ELSE intro{_NL}own{_NL}opt{_NL}other END{_NL}question) AS m FROM b)
SELECT case_id, perspective, count(*) AS forms, count(DISTINCT m) AS prompts, md5(string_agg(m, ',' ORDER BY m)) AS prompts_md5 FROM q GROUP BY 1, 2"""
)
def surface_prompts(spark, d):
    """The prompts of all 48 forms of both sides of each case, in whole."""
    return designs.surface_prompt_digests(_small_cases(spark, d), _goods(spark, d))


@query(
    f"""WITH {SMALL}, l AS (SELECT *, {v.LEVELS} FROM small), b AS (SELECT case_id, 'AX_BY' AS ord, x_num AS good_for_a, y_num AS good_for_b, {_goods_named('x_num', 'y_num', *'ijkl')} FROM l UNION ALL SELECT case_id, 'AY_BX', y_num, x_num, {_goods_named('y_num', 'x_num', *'klij')} FROM l)
SELECT case_id, ord AS "order", phrase AS paraphrase, good_for_a, good_for_b, case_id || ':neutral:' || ord || ':' || phrase AS form_id, md5({_by('phrase', pr.NEUTRAL)}) AS prompt_md5 FROM b, (VALUES ('p0'), ('p1')) hh(phrase)"""
)
def neutral_forms(spark, d):
    forms = designs.neutral_forms(_small_cases(spark, d), _goods(spark, d))
    return forms.select("case_id", "order", "paraphrase", "good_for_a", "good_for_b", "form_id", F.md5("prompt").alias("prompt_md5"))


@query(f"""WITH {SMALL}, l AS (SELECT *, {v.LEVELS} FROM small), t AS (SELECT case_id, {_goods_named('x_num', 'y_num', *'ijkl')} FROM l) SELECT case_id, {', '.join(f'md5({_filled(pr.BASE + text)}) AS {name}' for name, text in pr.TREATMENTS.items())} FROM t""")
def treatment_prompts(spark, d):
    """Each case's prompt without a treatment, with a warning of the biases, and with a forced switch."""
    cases = _small_cases(spark, d)
    placed = designs._placed(cases, _goods(spark, d), "x_num", "y_num", F.lit(True))
    e, o = pr.good_places("e", F.col("_e"), F.col("_e1"), F.col("_e2")), pr.good_places("o", F.col("_o"), F.col("_o1"), F.col("_o2"))
    return placed.select("case_id", *(F.md5(pr.treatment(e, o, name)).alias(name) for name in pr.TREATMENTS))


_SHOWN = [("Two and two?", "#### 4"), ("Ten less one?", "#### 9")]


@query("SELECT item_id, 5 AS turns, md5('Q: Two and two?' || chr(10) || 'A:|#### 4|Q: Ten less one?' || chr(10) || 'A:|#### 9|Q: ' || text || chr(10) || 'A:') AS contents_md5 FROM benchmark")
def few_shot_prompts(spark, d):
    """Questions after two worked examples, as turns of a conversation."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", pr.few_shot(_SHOWN, F.col("text")).alias("turns"))
    return b.select("item_id", F.size("turns").alias("turns"), F.md5(F.concat_ws("|", "turns.content")).alias("contents_md5"))


@query(
    """WITH g AS (SELECT p_partkey % 200 AS k, count(*) AS n FROM part GROUP BY 1) SELECT k::INT AS idx, rule FROM g, (VALUES ('number of attributes', 0), ('number of levels', 1), ('repeated level', 2)) r(rule, c) WHERE CASE c WHEN 0 THEN k % 7 = 0 WHEN 1 THEN k % 5 = 0 ELSE k % 3 = 0 END"""
)
def catalogue_faults(spark, d):
    """Goods of a catalogue with too few attributes, too few levels or a level twice."""
    p = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_partkey") % 200).cast("int").alias("idx")).agg(F.count("*").alias("n"))
    k = F.col("idx")
    level = lambda n: F.concat(F.lit("level "), F.lit(n).cast("string"))
    levels = F.array(level(0), F.when(k % 3 == 0, level(0)).otherwise(level(1)), level(2))
    first = F.struct(F.lit("a").alias("name"), F.when(k % 5 == 0, F.concat(levels, F.array(level(7)))).otherwise(levels).alias("levels"))
    second = F.struct(F.lit("b").alias("name"), F.array(level(0), level(1), level(2)).alias("levels"))
    return gates.catalogue_faults(p.select("idx", F.when(k % 7 == 0, F.array(first)).otherwise(F.array(first, second)).alias("attrs")))


@query(
    """WITH s AS (SELECT s_suppkey AS scenario_id, 'd' || s_suppkey % 4 AS domain, s_name AS name FROM supplier), p AS (SELECT * FROM (VALUES (1, 0.1::DOUBLE), (3, 0.35::DOUBLE)) t(i, p)),
c AS (SELECT *, CASE WHEN f = 'positive' THEN p ELSE 1 - p END AS shown, CASE WHEN f = 'positive' THEN ' wins' ELSE ' loses' END AS what FROM s, p, (VALUES ('positive'), ('negative')) ff(f))
SELECT printf('s%03d_p%02d_%s', scenario_id, i, f) AS case_id, scenario_id, i AS probability_index, domain, f AS frame, p AS underlying_probability, round(shown, 6) AS displayed_probability, name || what || ' with X' || '%' AS _t FROM c""".replace(
        "name || what || ' with X' || '%' AS _t", "name || what || ' with ' || round(shown * 100)::INT || '%' AS question, 'Please consider the following option: ' || name || what || ' with ' || round(shown * 100)::INT || '%' || chr(10) || 'Answer with the single word Yes or No.' AS prompt"
    )
)
def framing_cases(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    text = lambda what: F.concat("s_name", F.lit(f" {what} with XX%"))
    rows = s.select(F.col("s_suppkey").alias("scenario_id"), F.concat(F.lit("d"), F.col("s_suppkey") % 4).alias("domain"), text("wins").alias("positive"), text("loses").alias("negative"))
    return designs.framing_cases(rows, [0.1, 0.2, 0.35], wanted=[0.1, 0.35])


@query(f"WITH {GOODS} SELECT x.idx AS a, y.idx AS b FROM goods x JOIN goods y ON x.a = y.a AND x.b = y.b AND x.idx < y.idx UNION ALL SELECT x.idx, y.idx FROM goods x JOIN goods y ON x.a = y.b AND x.b = y.a AND x.idx < y.idx")
def sharing_pairs(spark, d):
    return designs.sharing_pairs(_goods(spark, d).withColumn("attrs", F.col("attrs")))


@query(
    f"""WITH {SMALL}, l AS (SELECT *, {v.LEVELS} FROM small), m AS (SELECT x_num, y_num, (i < 2)::INT + (j < 2)::INT + (k < 2)::INT + (l < 2)::INT AS better, x_num % 5 = y_num % 5 AND x_num % 4 = y_num % 4 AS shares, (i >= k AND j >= l OR k >= i AND l >= j) AND NOT (i = k AND j = l) AS dom FROM l)
SELECT count(*) AS cases, count(DISTINCT (x_num, y_num)) AS pairs, count(*) FILTER (better > 0) AS improvable, sum(better)::BIGINT AS variants, count(*) FILTER (shares) AS sharing, count(*) FILTER (shares AND dom) AS dominated FROM m"""
)
def design_coverage(spark, d):
    return designs.coverage(_small_cases(spark, d), _goods(spark, d))


@query(
    f"""WITH {v.CASES}, l AS (SELECT {v.LEVELS} FROM cases), n AS (SELECT i, j, k, l, count(*) AS cases FROM l GROUP BY ALL) SELECT i, j, k, l, coalesce(cases, 0) AS cases FROM (SELECT i.range::INT AS i, j.range::INT AS j, k.range::INT AS k, l.range::INT AS l FROM range(3) i, range(3) j, range(3) k, range(3) l WHERE i.range >= k.range AND j.range >= l.range AND NOT (i.range = k.range AND j.range = l.range)) d LEFT JOIN n USING (i, j, k, l)"""
)
def dominance_pairs(spark, d):
    """The pairs of profiles of which the first dominates, and how many cases have each."""
    cases = v.with_levels(v.cases(spark, d)).groupBy(*"ijkl").agg(F.count("*").alias("cases"))
    return F.broadcast(designs.dominance_pairs(spark)).join(cases, list("ijkl"), "left").fillna(0, ["cases"])  # 27 pairs


def _parameters(spark, d):
    """Estimates by model: the suppliers' balances, by nation."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    return s.select((F.col("s_nationkey") % 5).alias("model"), F.when(k % 5 == 0, "beta").otherwise("alpha").alias("kind"), F.concat(F.lit("p"), k.cast("string")).alias("parameter"), F.when(k % 11 == 0, 0.0).otherwise(F.abs("s_acctbal")).alias("std_err"), F.col("s_acctbal").alias("estimate"))


PARAMS = "params AS (SELECT s_nationkey % 5 AS model, CASE WHEN s_suppkey % 5 = 0 THEN 'beta' ELSE 'alpha' END AS kind, 'p' || s_suppkey AS parameter, CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE abs(s_acctbal) END::DOUBLE AS std_err, s_acctbal AS estimate FROM supplier)"
_MEDIAN = "list_sort(list(std_err) FILTER (kind = '{0}'))[count(*) FILTER (kind = '{0}') // 2 + 1]"


@query(
    f"""WITH {PARAMS}, {v.PAIRS}, s AS (SELECT model, count(*) FILTER (kind = 'alpha') AS n_alphas, count(*) FILTER (kind = 'alpha' AND std_err > 0) AS n_alpha_se_nonzero, round({_MEDIAN.format('alpha')}, 6) AS median_alpha_se,
 count(*) FILTER (kind = 'beta') AS n_betas, count(*) FILTER (kind = 'beta' AND std_err > 0) AS n_beta_se_nonzero, round({_MEDIAN.format('beta')}, 6) AS median_beta_se FROM params GROUP BY 1), a AS (SELECT case_id % 5 AS model, avg((p_yes_x > p_no_x)::INT) AS x, avg((p_yes_y > p_no_y)::INT) AS y, count(*) AS n FROM pairs GROUP BY 1)
SELECT s.*, n_alpha_se_nonzero > 0 AND n_beta_se_nonzero > 0 AS valid, round(x, 6) AS yes_x_rate, round(y, 6) AS yes_y_rate, n AS total FROM s JOIN a USING (model)"""
)
def model_survey(spark, d):
    answers = v.paired(spark, d).select((F.col("case_id") % 5).cast("int").alias("model"), (F.col("p_yes_x") > F.col("p_no_x")).cast("int").alias("yes_x"), (F.col("p_yes_y") > F.col("p_no_y")).cast("int").alias("yes_y"))
    return survey.model_survey(_parameters(spark, d), answers)


@query(f"WITH {v.DELTAS} SELECT round(avg(abs(delta)), 6) AS mean_abs, round(sqrt(avg(delta * delta)), 6) AS rms FROM deltas")
def scale_constants(spark, d):
    rows = v.deltas(spark, d)
    return survey.scale_constant(rows, "delta", "mean_abs").withColumnRenamed("scale", "mean_abs").crossJoin(survey.scale_constant(rows, "delta", "rms").withColumnRenamed("scale", "rms"))  # one row each


def _forms(spark, d):
    """Answers in forms: 40 cases of two models, in both perspectives."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    k = F.col("event_id")
    case = (k % 40).cast("int")
    axes = {"answer_style": k % 4, "display_order": F.floor(k / 4) % 2, "attr_order": F.floor(k / 8) % 2, "paraphrase": F.floor(k / 16) % 3}
    side = F.when(F.floor(k / 40) % 2 == 0, "X").otherwise("Y")
    final = F.when(F.col("value") + case > 70, case).otherwise(100 + case)
    return e.select(F.concat(F.lit("m"), F.floor(k / 80) % 2).alias("model"), case.alias("case_id"), side.alias("perspective"), *(x.cast("int").alias(n) for n, x in axes.items()), final.alias("final_good"), (F.col("value") / 487.3).alias("p_trade"), k.alias("pos"))


FORMS = """forms AS (SELECT 'm' || (event_id // 80) % 2 AS model, (event_id % 40)::INT AS case_id, CASE WHEN (event_id // 40) % 2 = 0 THEN 'X' ELSE 'Y' END AS perspective, (event_id % 4)::INT AS answer_style, ((event_id // 4) % 2)::INT AS display_order, ((event_id // 8) % 2)::INT AS attr_order, ((event_id // 16) % 3)::INT AS paraphrase,
 CASE WHEN value + event_id % 40 > 70 THEN event_id % 40 ELSE 100 + event_id % 40 END AS final_good, value / 487.3::DOUBLE AS p_trade, event_id AS pos FROM events)"""


def _form_cases(spark, d):
    k = F.col("id").cast("int")
    return spark.range(40).select(k.alias("case_id"), k.alias("x_num"), (100 + k).alias("y_num"), F.when(k % 3 == 0, -1.0).otherwise(1.0).alias("delta"), F.concat(F.lit("s"), k % 4).alias("stratum"))


TARGET = "target AS (SELECT range AS case_id, CASE WHEN range % 3 = 0 THEN 100 + range ELSE range END AS preferred, 's' || range % 4 AS stratum FROM range(40))"
_MODAL = "arg_min(final_good, (-c, first))"


@query(
    f"""WITH {FORMS}, {TARGET}, g AS (SELECT model, case_id, perspective, final_good, count(*) AS c, min(pos) AS first FROM forms GROUP BY 1, 2, 3, 4), u AS (SELECT model, case_id, perspective, sum(c) AS n, count(*) = 1 AS inv, arg_min(final_good, -c * 1000000000 + first) AS modal, CASE WHEN sum(c) < 2 THEN 0.0::DOUBLE ELSE 1 - sum(c * (c - 1)) / (sum(c) * (sum(c) - 1))::DOUBLE END AS flip FROM g GROUP BY 1, 2, 3),
sp AS (SELECT model, case_id, perspective, max(p_trade) - min(p_trade) AS spread FROM forms GROUP BY 1, 2, 3), us AS (SELECT model, count(*) AS n_units, sum(n)::BIGINT AS n_rows, avg(inv::INT) AS invariance_rate, avg(flip) AS flip_rate, avg(spread) AS mean_prob_spread FROM u JOIN sp USING (model, case_id, perspective) GROUP BY 1),
h AS (SELECT model, answer_style || '/' || display_order || '/' || attr_order || '/' || paraphrase AS form, avg((final_good = preferred)::INT) AS fid, sum((final_good = preferred)::INT) AS hits, count(*) AS n FROM forms JOIN target USING (case_id) GROUP BY 1, 2),
f AS (SELECT model, sum(hits) / sum(n)::DOUBLE AS fidelity_mean, min(fid) AS worst_fidelity, arg_min(form, (fid * 1000000)::BIGINT::VARCHAR.lpad(10, '0') || form) AS worst_form FROM h GROUP BY 1),
k AS (SELECT model, avg((x.modal = case_id AND y.modal = 100 + case_id)::INT) AS keep_both_rate FROM (SELECT * FROM u WHERE perspective = 'X') x JOIN (SELECT * FROM u WHERE perspective = 'Y') y USING (model, case_id) GROUP BY 1)
SELECT model, n_units, n_rows, round(invariance_rate, 6) AS invariance_rate, round(fidelity_mean, 6) AS fidelity_mean, round(worst_fidelity, 6) AS worst_fidelity, worst_form, round(flip_rate, 6) AS flip_rate, round(mean_prob_spread, 6) AS mean_prob_spread, round(keep_both_rate, 6) AS keep_both_rate FROM us JOIN f USING (model) LEFT JOIN k USING (model)"""
)
def form_summary(spark, d):
    return survey.form_summary(_forms(spark, d), _form_cases(spark, d))


@query(
    f"""WITH {FORMS}, {TARGET}, u AS (SELECT model, case_id, perspective, stratum, count(DISTINCT final_good) = 1 AS inv, count(*) FILTER (final_good = preferred) AS h, count(*) AS n FROM forms JOIN target USING (case_id) GROUP BY 1, 2, 3, 4)
SELECT model, stratum, round(avg(inv::INT), 6) AS invariance, round(sum(h) / sum(n)::DOUBLE, 6) AS fidelity FROM u GROUP BY 1, 2"""
)
def form_strata(spark, d):
    return survey.form_strata(_forms(spark, d), _form_cases(spark, d))


@query(
    f"""WITH {FORMS}, {TARGET}, g AS (SELECT model, case_id, perspective AS o, final_good, count(*) AS c, min(pos) AS first FROM forms GROUP BY 1, 2, 3, 4), w AS (SELECT model, case_id, final_good, sum(c) AS c, min(first) AS first FROM g GROUP BY 1, 2, 3),
m AS (SELECT model, case_id, arg_min(final_good, -c * 1000000000 + first) AS modal FROM w GROUP BY 1, 2), o AS (SELECT model, case_id, count(DISTINCT modal) = 1 AS same FROM (SELECT model, case_id, o, arg_min(final_good, -c * 1000000000 + first) AS modal FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2),
j AS (SELECT m.model, stratum, m.modal = b.modal AS keeps, m.modal = preferred AS hits, same FROM m JOIN o USING (model, case_id) JOIN target USING (case_id) LEFT JOIN (SELECT case_id, modal FROM m WHERE model = 'm0') b USING (case_id))
SELECT model, stratum, count(*) AS n_cases, round(avg(coalesce(keeps, false)::INT), 6) AS preservation, round(avg(hits::INT), 6) AS target_agreement, round(avg(same::INT), 6) AS order_invariance FROM j GROUP BY 1, 2"""
)
def neutral_summary(spark, d):
    rows = _forms(spark, d).select("model", "case_id", F.col("perspective").alias("order"), F.col("final_good").alias("chosen_good"), "pos")
    return survey.neutral_summary(rows, _form_cases(spark, d), "m0", ["stratum"])


@query("SELECT count(*) AS evaluated, count(*) FILTER (turn % 3 = 0 AND role = 'user') AS correct, round(count(*) FILTER (turn % 3 = 0 AND role = 'user') / count(*)::DOUBLE, 6) AS accuracy, count(*) FILTER (role = 'user') AS parsed, round(count(*) FILTER (role = 'user') / count(*)::DOUBLE, 6) AS parse_rate, count(*) = 7 AS complete FROM conversations")
def question_summary(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    answer = F.when(F.col("role") == "user", F.col("turn").cast("string"))
    return survey.question_summary(c.select(answer.alias("predicted_answer"), F.coalesce(answer.isNotNull() & (F.col("turn") % 3 == 0), F.lit(False)).alias("correct")), 7)


@query("SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'side', CASE WHEN event_id % 2 = 0 THEN 'X' ELSE 'Y' END, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'distinct', 'user_id', count(DISTINCT user_id) FROM events")
def dataset_stats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.when(F.col("event_id") % 2 == 0, "X").otherwise("Y").alias("side"))
    return survey.dataset_stats(e, "user_id", ["event_type", "side"])


def _modules(spark, d):
    """Energies of modules in layers of two runs."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return li.select((F.col("l_orderkey") % 2).cast("int").alias("seed"), (F.floor(F.col("l_orderkey") / 2) % 28).cast("int").alias("layer"), F.concat(F.lit("m"), F.col("l_linenumber") % 7).alias("module"), F.when(F.col("l_linenumber") % 7 < 4, "attention").otherwise("mlp").alias("family"), F.col("l_quantity").alias("energy"))


MODULES = "modules AS (SELECT (l_orderkey % 2)::INT AS seed, ((l_orderkey // 2) % 28)::INT AS layer, 'm' || l_linenumber % 7 AS module, CASE WHEN l_linenumber % 7 < 4 THEN 'attention' ELSE 'mlp' END AS family, l_quantity AS energy FROM lineitem)"


@query(f"WITH {MODULES}, u AS (SELECT seed, 'layer' AS dimension, layer::VARCHAR AS level, energy FROM modules UNION ALL SELECT seed, 'module', module, energy FROM modules UNION ALL SELECT seed, 'family', family, energy FROM modules) SELECT seed, dimension, level, round(sum(energy), 6) AS total, round(sum(energy) / sum(sum(energy)) OVER (PARTITION BY seed, dimension), 6) AS share FROM u GROUP BY 1, 2, 3")
def energy_shares(spark, d):
    return survey.energy_shares(_modules(spark, d), ["seed"], ["layer", "module", "family"], "energy")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value * (user_id % 10 + 1)) / sum(user_id % 10 + 1), 6) AS weighted_mean, min(value) AS least, max(value) AS greatest, round(quantile_cont(value, 0.5), 6) AS median FROM events WHERE event_id % 9 <> 0 GROUP BY 1")
def weighted_summary(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).otherwise(float("nan")).alias("value"), (F.col("user_id") % 10 + 1).alias("weight"))
    return survey.weighted_summary(e, ["event_type"], "value", "weight")


@query("SELECT event_type, min(value) FILTER (event_id % 9 <> 0) AS least, max(value) FILTER (event_id % 9 <> 0) AS greatest, count(*) FILTER (event_id % 9 = 0) AS n_nonfinite, round(quantile_cont(value, 0.01) FILTER (event_id % 9 <> 0), 6) AS p01, round(quantile_cont(value, 0.5) FILTER (event_id % 9 <> 0), 6) AS p50, round(quantile_cont(value, 0.99) FILTER (event_id % 9 <> 0), 6) AS p99 FROM events GROUP BY 1")
def vector_summary(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.when(F.col("event_id") % 9 != 0, F.col("value")).when(F.col("event_id") % 2 == 0, float("inf")).otherwise(float("nan")).alias("value"))
    return survey.vector_summary(e, ["event_type"], "value")


@query("SELECT user_id % 100 AS g, count(v) AS n, min(v) AS least, max(v) AS greatest, round(max(v) - min(v), 6) AS spread FROM (SELECT user_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events) GROUP BY 1")
def spread(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 100).alias("g"), F.when(F.col("event_id") % 4 != 0, F.col("value")).otherwise(float("inf")).alias("v"))
    return survey.spread(e, ["g"], "v")


@query("WITH r AS (SELECT user_id % 6 AS run, event_id AS step, CASE WHEN event_id % 5 <> 0 THEN value END AS reward, value / (event_id % 7 + 1) AS kl FROM events) SELECT run, count(*) AS n_steps, max(step) AS last_step, arg_min(reward, step) FILTER (reward IS NOT NULL) AS reward_first, arg_max(reward, step) FILTER (reward IS NOT NULL) AS reward_last, round(avg(reward), 6) AS reward_mean, max(reward) AS reward_max, round(arg_min(kl, step), 6) AS kl_first, round(arg_max(kl, step), 6) AS kl_last, round(avg(kl), 6) AS kl_mean, round(max(kl), 6) AS kl_max FROM r GROUP BY 1")
def run_summary(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select((F.col("user_id") % 6).alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 5 != 0, F.col("value")).otherwise(float("nan")).alias("reward"), (F.col("value") / (F.col("event_id") % 7 + 1)).alias("kl"))
    return survey.run_summary(rows, ["run"], "step", ["reward", "kl"])


@query(f"WITH {PARAMS} SELECT model, round(max(std_err) / min(std_err), 6) AS condition_proxy FROM params WHERE std_err > 0 GROUP BY 1")
def condition_proxy(spark, d):
    return survey.condition_proxy(_parameters(spark, d), ["model"], "std_err")


@query(f"""WITH {v.GRID}, c AS (SELECT abs("lambda") AS a, consistency < 0.55 AS caveat FROM grid) SELECT count(*) AS rows, count(*) FILTER (a < 0.5 AND NOT caveat) AS clean, count(*) FILTER (NOT (a < 0.5 AND NOT caveat)) AS not_clean, count(*) FILTER (a < 0.5 AND caveat) AS small_with_caveat, count(*) FILTER (a >= 0.5) AS large FROM c""")
def snapshot_counts(spark, d):
    rows = v.grid(spark, d).withColumn("caveats", F.when(F.col("consistency") < 0.55, F.array(F.lit("inconsistent"))).otherwise(F.array().cast("array<string>")))
    return survey.snapshot_counts(rows)


@query(f"WITH {MODULES}, t AS (SELECT seed, layer, module, sum(energy) AS energy FROM modules GROUP BY 1, 2, 3) SELECT seed, layer, module, energy, row_number() OVER (PARTITION BY seed ORDER BY energy, layer * 10 + substr(module, 2)::INT) - 1 AS rank FROM t")
def positional_rank(spark, d):
    rows = _modules(spark, d).groupBy("seed", "layer", "module").agg(F.sum("energy").alias("energy")).withColumn("_t", F.col("layer") * 10 + F.substring("module", 2, 1).cast("int"))
    return survey.positional_rank(rows, ["seed"], "energy", "_t").drop("_t").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT user_id % 20 AS run, max(event_id) FILTER (event_id % 3 <> 0) AS step, 'runs/' || user_id % 20 || '/checkpoint-' || max(event_id) FILTER (event_id % 3 <> 0) AS path FROM events GROUP BY 1")
def latest_checkpoint(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    run = F.col("user_id") % 20
    name = F.when(F.col("event_id") % 3 != 0, F.lit("checkpoint-")).otherwise("draft-")
    return survey.latest_checkpoint(e.select(run.alias("run"), F.concat(F.lit("runs/"), run, F.lit("/"), name, F.col("event_id")).alias("path")), "path", ["run"])


@query(
    f"""WITH {PARAMS}, b AS (SELECT parameter, estimate * 0.7::DOUBLE + length(parameter) * 100 AS base FROM params), j AS (SELECT model, kind, estimate, base, parameter FROM params JOIN b USING (parameter)),
u AS (SELECT model, kind, estimate, base FROM j UNION ALL SELECT model, 'alpha_without_excluded', estimate, base FROM j WHERE kind = 'alpha' AND parameter NOT IN ('p3', 'p37')),
r AS (SELECT *, rank() OVER (PARTITION BY model, kind ORDER BY estimate) AS ra, rank() OVER (PARTITION BY model, kind ORDER BY base) AS rb FROM u)
SELECT model, kind, count(*) AS n, round(CASE WHEN count(*) > 1 THEN corr(estimate, base) END, 6) AS pearson, round(CASE WHEN count(*) > 1 THEN corr(ra, rb) END, 6) AS spearman, round(avg(abs(estimate - base)), 6) AS mae, round(sqrt(avg((estimate - base) * (estimate - base))), 6) AS rmse FROM r GROUP BY 1, 2"""
)
def parameter_agreement(spark, d):
    target = _parameters(spark, d).select("model", "parameter", "kind", "estimate")
    base = target.select("parameter", (F.col("estimate") * 0.7 + F.length("parameter") * 100).alias("estimate"))
    return survey.parameter_agreement(target, base, ["model"], ["p3", "p37"])


@query(f"""WITH {v.GRID}, w AS (SELECT event_id % 5 AS seed, (2000 * (1 + event_id % 20))::INT AS step, max(value) AS w FROM events GROUP BY 1, 2), o AS (SELECT seed, step, min(w) AS w FROM w GROUP BY 1, 2) SELECT seed, step, "lambda", w FROM grid LEFT JOIN o USING (seed, step)""")
def enriched_grid(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    other = e.groupBy((F.col("event_id") % 5).alias("seed"), (2000 * (1 + F.col("event_id") % 20)).cast("int").alias("step")).agg(F.max("value").alias("w"))
    return survey.enriched(v.grid(spark, d).select("seed", "step", "lambda"), other, ["seed", "step"], ["w"])


@query(
    f"""WITH {MODULES}, t AS (SELECT seed, layer, module, sum(energy) AS e, max(energy) + count(*) AS s FROM modules GROUP BY 1, 2, 3), r AS (SELECT *, e / sum(e) OVER (PARTITION BY seed) AS share, row_number() OVER (PARTITION BY seed ORDER BY e DESC, layer, module) AS er, row_number() OVER (PARTITION BY seed ORDER BY s DESC, layer, module) AS nr FROM t)
SELECT layer, module, greatest(a.er, b.er)::INT AS energy_rank_worse, greatest(a.nr, b.nr)::INT AS norm_rank_worse, round(least(a.share, b.share), 6) AS energy_share_min, CASE WHEN layer % 2 = 0 THEN layer / 100.0::DOUBLE END AS cosine FROM (SELECT * FROM r WHERE seed = 0) a JOIN (SELECT * FROM r WHERE seed = 1) b USING (layer, module)
ORDER BY greatest(energy_rank_worse, norm_rank_worse), energy_rank_worse + norm_rank_worse, layer, module LIMIT 50"""
)
def stable_modules(spark, d):
    from pyspark.sql.window import Window

    t = _modules(spark, d).groupBy("seed", "layer", "module").agg(F.sum("energy").alias("e"), (F.max("energy") + F.count("*")).alias("s"))
    whole = Window.partitionBy("seed")  # some two hundred modules
    rank = lambda c: F.row_number().over(whole.orderBy(F.desc(c), "layer", "module"))
    rows = t.select("seed", "layer", "module", (F.col("e") / F.sum("e").over(whole)).alias("energy_share"), rank("e").alias("energy_rank"), rank("s").alias("norm_rank"))
    similar = rows.where("layer % 2 = 0").select("layer", "module", (F.col("layer") / 100.0).alias("cosine")).distinct()
    return survey.stable_modules(rows, ["layer", "module"], (0, 1), similar, 50)


@query(f"WITH {v.CASES} SELECT CASE WHEN case_id % 2 = 0 THEN 'validation' ELSE 'frozen' END AS split, count(*) AS n, count(*) FILTER (case_id BETWEEN 1000 AND 9000) AS in_range, count(*) FILTER (case_id <= 500) AS clipped FROM cases GROUP BY 1")
def split_filters(spark, d):
    rows = v.cases(spark, d)
    ids = gates.id_range(rows, "case_id", 1000, 9000).select("case_id", F.lit(1).alias("r")).join(gates.up_to(rows, "case_id", 500).select("case_id", F.lit(1).alias("c")), "case_id", "full")
    named = rows.select("case_id", F.when(gates.parity(F.col("case_id"), True), "validation").otherwise("frozen").alias("split"))
    return named.join(ids, "case_id", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("r").alias("in_range"), F.count("c").alias("clipped"))


@query("SELECT doc_id, CASE WHEN contains(lower(source || '/' || lang), 'src1') THEN 'SRC1' WHEN contains(lower(source || '/' || lang), '/fr') THEN '/fr' END AS token FROM documents")
def forbidden_names(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang")
    return docs.select("doc_id", gates.forbidden(F.concat_ws("/", "source", "lang"), ("SRC1", "/fr")).alias("token"))


@query(f"WITH {v.CASES}, {v.DELTAS}, d AS (SELECT case_id % 15000 AS case_id, round(min(delta), 2) AS delta FROM deltas GROUP BY 1) SELECT CASE WHEN delta IS NULL THEN 'missing' WHEN delta = 0 THEN 'zero' ELSE 'kept' END AS outcome, count(*) AS n FROM cases LEFT JOIN d USING (case_id) GROUP BY 1")
def delta_outcomes(spark, d):
    deltas = v.deltas(spark, d).groupBy((F.col("case_id") % 15000).alias("case_id")).agg(F.round(F.min("delta"), 2).alias("delta"))
    return gates.delta_outcomes(v.cases(spark, d), deltas, "case_id", "delta")


_CATALOGUES = """goods AS (SELECT 'Good ' || p_partkey % 300 AS name, min(p_brand) AS category, 'trait ' || p_partkey % 300 % 7 AS attribute, 'level ' || p_partkey % 300 % 11 AS level FROM part GROUP BY p_partkey % 300),
others AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'Good ' || s_suppkey % 400 ELSE s_name END AS name, CASE WHEN s_suppkey % 25 = 0 THEN 'Brand#1' ELSE 'Nation ' || s_nationkey END AS category, 'trait ' || s_suppkey % 12 AS attribute, 'Level ' || s_suppkey % 13 AS level FROM supplier)"""


def _catalogues(spark, d):
    """Two catalogues of goods: one of the parts' classes, one of the suppliers."""
    p = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_partkey") % 300).alias("k")).agg(F.min("p_brand").alias("category"))
    k = F.col("k")
    goods = p.select(F.concat(F.lit("Good "), k).alias("name"), "category", F.concat(F.lit("trait "), k % 7).alias("attribute"), F.concat(F.lit("level "), k % 11).alias("level"))
    n = F.col("s_suppkey")
    s = spark.read.parquet(f"{d}/supplier.parquet")
    others = s.select(F.when(n % 9 == 0, F.concat(F.lit("Good "), n % 400)).otherwise(F.col("s_name")).alias("name"), F.when(n % 25 == 0, "Brand#1").otherwise(F.concat(F.lit("Nation "), "s_nationkey")).alias("category"), F.concat(F.lit("trait "), n % 12).alias("attribute"), F.concat(F.lit("Level "), n % 13).alias("level"))
    return goods, others


@query(f"WITH {_CATALOGUES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", value FROM (SELECT DISTINCT {c} AS value FROM goods) WHERE value IN (SELECT {c} FROM others)" for c in ("name", "category", "attribute", "level")))
def common_values(spark, d):
    """What two whole catalogues share: names, categories, attributes and values."""
    goods, others = _catalogues(spark, d)
    return gates.common_values(goods, others, {c: c for c in ("name", "category", "attribute", "level")})


@query("SELECT r_regionkey AS k, r_name AS name, NULL::INT AS region FROM region UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation")
def filled_union(spark, d):
    r = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"))
    return gates.filled_union(r, n)


@query("WITH q AS (SELECT (doc_id // 2)::VARCHAR AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS question, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE doc_id::VARCHAR END AS target FROM documents) SELECT 'number of records' AS rule, count(*) AS n FROM q UNION ALL SELECT 'target is no integer', count(*) FILTER (target = 'x') FROM q UNION ALL SELECT 'repeated id', sum(c)::BIGINT FROM (SELECT count(*) AS c FROM q GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'repeated question', sum(c)::BIGINT FROM (SELECT count(*) AS c FROM q GROUP BY question HAVING count(*) > 1)")
def record_faults(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.floor(F.col("doc_id") / 2).cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("doc_id").cast("string")).alias("target"))
    return gates.record_faults(rows, 7)


@query(f"WITH {v.PREDS}, r AS (SELECT case_id, perspective FROM preds WHERE event_id % 50 <> 0), p AS (SELECT case_id, count(*) FILTER (perspective = 'X') AS x, count(*) FILTER (perspective = 'Y') AS y FROM r GROUP BY 1), f AS (SELECT 'not one X and one Y' AS rule, count(*) FILTER (NOT (x = 1 AND y = 1)) AS n FROM p UNION ALL SELECT 'id out of range', count(*) FILTER (case_id < 10) FROM p UNION ALL SELECT 'no stable anchor', count(*) FILTER (case_id % 3 = 0) FROM p) SELECT * FROM f WHERE n > 0")
def startup_faults(spark, d):
    rows = v.predictions(spark, d)
    anchors = rows.select("case_id", F.when(F.col("case_id") % 3 == 1, "X").when(F.col("case_id") % 3 == 2, "Y").alias("pref")).distinct()
    return gates.startup_faults(rows.where("event_id % 50 != 0").select("case_id", "perspective"), anchors, 10, 10**12)


@query(f"WITH {v.PREDS}, a AS (SELECT case_id, CASE WHEN case_id % 7 = 0 THEN 'Z' WHEN case_id % 7 = 1 THEN NULL ELSE 'X' END AS pref FROM preds), f AS (SELECT 'invalid preference' AS rule, count(*) FILTER (pref = 'Z') AS n FROM a UNION ALL SELECT 'id out of range', count(*) FILTER (case_id > 100) FROM a) SELECT * FROM f WHERE n > 0")
def anchor_faults(spark, d):
    rows = v.predictions(spark, d).select("case_id", F.when(F.col("case_id") % 7 == 0, "Z").when(F.col("case_id") % 7 == 1, None).otherwise("X").alias("pref"))
    return gates.anchor_faults(rows, 0, 100)


@query("SELECT n_name AS name, CASE WHEN n_nationkey <> 3 THEN n_regionkey::VARCHAR END AS found, CASE WHEN n_nationkey % 5 = 0 THEN '9' ELSE n_regionkey::VARCHAR END AS expected FROM nation WHERE n_nationkey = 3 OR n_nationkey % 5 = 0 AND n_regionkey <> 9")
def setting_differences(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    found = n.where("n_nationkey != 3").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    expected = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "9").otherwise(F.col("n_regionkey").cast("string")).alias("value"))
    return gates.setting_differences(found, expected)


@query("SELECT DISTINCT r_name || ': not resolved' AS problem FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_regionkey = 2 UNION ALL SELECT r_name || ', ' || n_name || ': no hash of the selection' FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_regionkey <> 2 AND n_nationkey % 6 = 0 UNION ALL SELECT 'no hash of the suite'")
def unready_families(spark, d):
    r, n = spark.read.parquet(f"{d}/region.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    rows = r.join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    sha = F.when(F.col("n_nationkey") % 6 != 0, F.sha2("n_name", 256))
    return gates.unready(rows.select(F.col("r_name").alias("family"), (F.col("r_regionkey") != 2).alias("resolved"), F.col("n_name").alias("seed"), sha.alias("sha256")), None)


@query("SELECT n_name AS name, n_nationkey < 4 AS fatal FROM nation WHERE n_nationkey % 2 = 0")
def unsupported_settings(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    names = n.select(F.col("n_name").alias("name"))
    critical = [r[0] for r in n.where("n_nationkey < 4").select("n_name").collect()]  # four settings
    return gates.unsupported_settings(names, n.where("n_nationkey % 2 = 1").select(F.col("n_name").alias("name")), critical)


@query(f"""WITH {v.GRID}, e AS (SELECT seed, step, round("lambda" + (step % 3) * 0.015::DOUBLE, 6) AS expected FROM grid UNION ALL SELECT 9, 1, 0.0::DOUBLE) SELECT seed, step, "lambda", expected FROM e LEFT JOIN grid USING (seed, step) WHERE "lambda" IS NULL OR abs("lambda" - expected) > 0.02""")
def off_reference(spark, d):
    g = v.grid(spark, d).select("seed", "step", "lambda")
    expected = g.select("seed", "step", F.round(F.col("lambda") + (F.col("step") % 3) * 0.015, 6).alias("lambda")).unionByName(spark.createDataFrame([(9, 1, 0.0)], "seed long, step int, lambda double"))
    return gates.off_reference(g, expected, ["seed", "step"], "lambda")


@query(f"WITH {v.PREDS}, c AS (SELECT model, perspective, count(*) AS n FROM preds GROUP BY 1, 2), f AS (SELECT model, perspective FROM c WHERE n <> (SELECT max(n) FROM c) OR model = 'm3') SELECT (SELECT count(*) FROM c) AS cells, (SELECT count(*) FROM c) - count(*) AS verified, count(*) AS failed, count(*) = 0 AS complete, coalesce(string_agg(model || '/' || perspective || ': rows', '; ' ORDER BY model, perspective), '') AS problems FROM f")
def grid_roll_up(spark, d):
    from ..operators import audit

    rows = v.predictions(spark, d)
    most = rows.groupBy("model", "perspective").count().agg(F.max("count")).first()[0]
    short = rows.where("model != 'm3' OR case_id != 3")  # one case of model m3 is missing
    findings = audit.grid_cells(short, ["model", "perspective"], most, "case_id", "p_yes", "p_no")
    return gates.grid_roll_up(findings, rows.select("model", "perspective"), ["model", "perspective"])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'said ' || event_id WHEN 1 THEN 'in ' || event_id WHEN 2 THEN 'last ' || event_id ELSE '' END AS text FROM events")
def completion_texts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    k, q = F.col("event_id"), F.lit('"')
    say = lambda what: F.concat(F.lit(f'{{"role": "assistant", "content": "{what} '), k.cast("string"), q, F.lit("}"))
    form = F.when(k % 4 == 0, F.concat(F.lit("said "), k.cast("string"))).when(k % 4 == 1, say("in")).when(k % 4 == 2, F.concat(F.lit("["), say("first"), F.lit(", "), say("last"), F.lit("]"))).otherwise("[]")
    return e.select("event_id", rec.completion_text(form).alias("text"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN NULL END::INT AS final_good, round(CASE event_id % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.7 WHEN 2 THEN 0.2 ELSE 0.0 END::DOUBLE, 6) AS keep_mass FROM events")
def final_goods(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    k = F.col("event_id") % 4
    style = F.when(k == 0, "yes_no").when(k == 1, "keep_trade").when(k == 2, "ab_kt").otherwise("ab_tk")
    token = F.when(k == 0, " No.").when(k == 1, "Trade").when(k == 2, "(A)").otherwise("yes")
    tops = F.create_map(F.lit("No"), F.lit(0.2), F.lit("keep"), F.lit(0.7), F.lit("A"), F.lit(0.2))
    masses = F.when(k == 3, F.create_map(F.lit("zz"), F.lit(0.3))).otherwise(tops)
    return e.select("event_id", pr.final_good(style, token, F.lit(1), F.lit(2)).alias("final_good"), pr.action_mass(style, masses, "keep").alias("keep_mass"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0 WHEN event_id % 10 = 1 THEN NULL ELSE printf('%.5e', value * 1.2345678)::DOUBLE END AS deviation, printf('%.1f%%', value * 0.997131) AS share FROM events")
def canonical_numbers(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    x = F.when(F.col("event_id") % 10 == 0, 1e-14).when(F.col("event_id") % 10 == 1, float("nan")).otherwise(F.col("value") * 1.2345678)
    return e.select("event_id", rec.json_safe(rec.canonical_deviation(x)).alias("deviation"), rec.percent(F.col("value") * 0.997131 / 100).alias("share"))


@query("SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS json, sha256('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS json_sha256 FROM nation")
def canonical_records(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = canonical_json(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))
    return rows.select(F.col("key").alias("n_nationkey"), "json", "json_sha256")


@query(f"WITH {v.PREDS}, a AS (SELECT case_id, x_num AS t FROM preds WHERE perspective = 'X' AND case_id % 11 <> 0), b AS (SELECT case_id, x_num + (case_id % 13 = 0)::INT AS t FROM preds WHERE perspective = 'Y' AND case_id % 7 <> 0) SELECT case_id, CASE WHEN a.t IS NULL THEN 'second run alone' WHEN b.t IS NULL THEN 'first run alone' ELSE 'target' END AS rule FROM a FULL JOIN b USING (case_id) WHERE a.t IS NULL OR b.t IS NULL OR a.t <> b.t")
def prediction_faults(spark, d):
    rows = v.predictions(spark, d)
    one = rows.where("perspective = 'X' AND case_id % 11 != 0").select("case_id", F.col("x_num").alias("t"))
    two = rows.where("perspective = 'Y' AND case_id % 7 != 0").select("case_id", (F.col("x_num") + (F.col("case_id") % 13 == 0).cast("int")).alias("t"))
    return gates.prediction_faults(one, two, "case_id", "t")


@query(f"WITH {v.CASES} SELECT DISTINCT value FROM (SELECT x_num AS value FROM cases UNION ALL SELECT y_num FROM cases UNION ALL SELECT code FROM cases)")
def used_values(spark, d):
    return gates.used_values(v.cases(spark, d), ["x_num", "y_num", "code"])


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), p AS (SELECT least(floor((value - lo) * 100 / (hi - lo)), 99)::INT AS bin FROM events, e) SELECT b.range::INT AS bin, count(p.bin) AS n FROM range(100) b LEFT JOIN p ON p.bin = b.range GROUP BY 1")
def auto_histogram(spark, d):
    from ..operators import behavior

    return behavior.auto_histogram(spark.read.parquet(f"{d}/events.parquet").select("value"), "value")


@query(
    f"""WITH {v.PAIRS}, cl AS (SELECT row_number() OVER (ORDER BY x_num) - 1 AS ix, avg(p_no_x - p_no_y) AS m FROM pairs GROUP BY x_num), g AS (SELECT count(*) AS n FROM cl),
dr AS (SELECT r.range AS rep, floor(('0x' || substr(md5('5:' || r.range || ':' || s.range), 1, 8))::BIGINT * n / 4294967296::DOUBLE)::BIGINT AS ix FROM g, range(2000) r, range((SELECT n FROM g)) s), e AS (SELECT rep, avg(m) AS estimate FROM dr JOIN cl USING (ix) GROUP BY 1)
SELECT count(*) AS reps, round(avg(estimate), 6) AS mean, round(stddev_samp(estimate), 6) AS sd, round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high FROM e"""
)
def scenario_bootstrap_ci(spark, d):
    """Scenarios count alike: means of drawn scenarios' means."""
    from ..operators import resample

    rows = v.paired(spark, d).withColumn("value", F.col("p_no_x") - F.col("p_no_y"))
    sums = resample.equally_weighted(resample.clusters(rows, ["x_num"], "value"))
    return resample.interval(resample.mean_replicates(sums, sums.count(), 2000, 5))


@query("WITH p AS (SELECT event_id % 7 AS g, CASE WHEN event_id % 9 = 0 THEN 0.0::DOUBLE WHEN event_id % 9 = 1 THEN 1.0::DOUBLE ELSE value / 500 END AS p FROM events) SELECT g, count(*) FILTER (p < 1e-12 OR 1 - p < 1e-12) AS clipped_rows, round(avg(greatest(p, 1e-6::DOUBLE) / (greatest(p, 1e-6::DOUBLE) + greatest(1 - p, 1e-6::DOUBLE))), 6) AS mean FROM p GROUP BY 1")
def clipped_rows(spark, d):
    from ..functions.choices import clipped, was_clipped

    e = spark.read.parquet(f"{d}/events.parquet")
    p = F.when(F.col("event_id") % 9 == 0, 0.0).when(F.col("event_id") % 9 == 1, 1.0).otherwise(F.col("value") / 500)
    rows = e.select((F.col("event_id") % 7).alias("g"), p.alias("p"))
    return rows.groupBy("g").agg(F.count_if(was_clipped(F.col("p"))).alias("clipped_rows"), F.avg(clipped(F.col("p"), 1e-6)).alias("mean"))


@query(f"WITH {v.GRID} SELECT seed, step, round(\"lambda\" - 1.96 * lambda_se, 6) AS low, round(\"lambda\" + 1.96 * lambda_se, 6) AS high, round(sqrt(\"lambda\" * \"lambda\" + eta * eta), 6) AS distance, round(sqrt(pow(\"lambda\" / lambda_se, 2) + pow(eta / eta_se, 2)), 6) AS wald FROM grid")
def estimate_transforms(spark, d):
    ends = rec.interval_ends(F.col("lambda"), F.col("lambda_se"))
    return v.grid(spark, d).select("seed", "step", ends["low"].alias("low"), ends["high"].alias("high"), rec.distance(F.col("lambda"), F.col("eta")).alias("distance"), rec.wald_diagonal(F.col("lambda"), F.col("lambda_se"), F.col("eta"), F.col("eta_se")).alias("wald"))


@query("WITH r AS (SELECT user_id % 9 AS cell, event_id AS place, CASE WHEN event_id % 50 = 3 THEN 0 ELSE event_id END AS key FROM events), l AS (SELECT cell, key <= lag(key) OVER (PARTITION BY cell ORDER BY place) AS back FROM r) SELECT cell, count(*) FILTER (back) AS n FROM l GROUP BY 1 HAVING count(*) FILTER (back) > 0")
def out_of_order(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select((F.col("user_id") % 9).alias("cell"), F.col("event_id").alias("place"), F.when(F.col("event_id") % 50 == 3, 0).otherwise(F.col("event_id")).alias("key"))
    return gates.out_of_order(rows, ["cell"], "key", "place")


@query("SELECT s_name AS file, n AS name, CASE WHEN n = 'r' THEN (s_suppkey % 3 * 8)::VARCHAR ELSE CASE WHEN s_suppkey % 4 <> 0 THEN '32' END END AS found, CASE n WHEN 'r' THEN '16' ELSE '32' END AS expected FROM supplier, (VALUES ('r'), ('alpha')) t(n) WHERE (n = 'r' AND s_suppkey % 3 <> 2) OR (n = 'alpha' AND s_suppkey % 4 = 0)")
def adapter_config_faults(spark, d):
    from ..operators import lowrank

    s = spark.read.parquet(f"{d}/supplier.parquet")
    r = F.create_map(F.lit("r"), (F.col("s_suppkey") % 3 * 8).cast("string"))
    alpha = F.when(F.col("s_suppkey") % 4 != 0, F.create_map(F.lit("alpha"), F.lit("32"))).otherwise(F.create_map(F.lit("beta"), F.lit("32")))
    return lowrank.config_faults(s.select(F.col("s_name").alias("file"), F.map_concat(r, alpha).alias("settings")), {"r": "16", "alpha": "32"})


@query(f"WITH {v.PREDS} SELECT event_id, CASE WHEN p_yes = p_no THEN NULL WHEN p_yes < p_no THEN perspective WHEN perspective = 'X' THEN 'Y' ELSE 'X' END AS good FROM preds")
def chosen_goods(spark, d):
    from ..functions.choices import choice, chosen_good

    rows = v.predictions(spark, d)
    return rows.select("event_id", chosen_good(F.col("perspective"), choice(F.col("p_yes"), F.col("p_no"), "tie")).alias("good"))
