"""Queries on free text: answers, numbers, logs, vectors and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import choices as ch
from ..functions.tests import chi2_log10_survival, interval_verdict, wald_two
from ..operators import audit, behavior
from ..operators import concentration as con
from . import views as v
from .register import registry

QUERIES, ORACLES, query = registry()

NUM = an.NUMBER.replace("'", "''")


def _replies(spark, d):
    """Replies in several answer forms, built around the numbers of the turns."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    n = F.concat((F.col("conv_id") % 9 + 1).cast("string"), F.lit(","), F.format_string("%03d", F.col("turn") * 37 % 1000))
    t = F.col("text")
    k = (F.col("conv_id") + F.col("turn")) % 5
    reply = F.when(k == 0, F.concat(t, F.lit(" The answer is $"), n, F.lit("."))).when(k == 1, F.concat(t, F.lit("\n#### "), n, F.lit("\nend"))).when(k == 2, F.concat(t, F.lit(" \\boxed{ "), n, F.lit(" }"))).when(k == 3, F.concat(n, F.lit(" "), t)).otherwise(t)
    return c.select("conv_id", "turn", reply.alias("reply"))


REPLIES = """n AS (SELECT conv_id, turn, text, (conv_id % 9 + 1)::VARCHAR || ',' || lpad((turn * 37 % 1000)::VARCHAR, 3, '0') AS n, (conv_id + turn) % 5 AS k FROM conversations),
replies AS (SELECT conv_id, turn, CASE k WHEN 0 THEN text || ' The answer is $' || n || '.' WHEN 1 THEN text || chr(10) || '#### ' || n || chr(10) || 'end' WHEN 2 THEN text || ' \\boxed{ ' || n || ' }'
 WHEN 3 THEN n || ' ' || text ELSE text END AS reply FROM n)"""
_CLEAN = "regexp_replace(translate(trim({0}), ',$', ''), '\\.+$', '')"
_FORM = {m: p.replace("'", "''") for m, p in an.FORMS}


@query(
    f"""WITH {REPLIES}, f AS (SELECT *, regexp_extract_all(reply, '{_FORM['answer_is']}', 1) AS a, regexp_extract_all(reply, '{_FORM['hash_marker']}', 1) AS h, regexp_extract_all(reply, '{_FORM['boxed']}', 1) AS b, regexp_extract_all(reply, '{_FORM['last_number']}', 1) AS l FROM replies),
p AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN a[-1] WHEN len(h) > 0 THEN h[-1] WHEN len(b) > 0 THEN b[-1] WHEN len(l) > 0 THEN l[-1] END AS x,
 CASE WHEN len(a) > 0 THEN 'answer_is' WHEN len(h) > 0 THEN 'hash_marker' WHEN len(b) > 0 THEN 'boxed' WHEN len(l) > 0 THEN 'last_number' ELSE 'unparsed' END AS method FROM f)
SELECT conv_id, turn, {_CLEAN.format('x')} AS answer, method FROM p"""
)
def extract_prediction(spark, d):
    return _replies(spark, d).select("conv_id", "turn", an.predicted_answer(F.col("reply")).alias("_p")).select("conv_id", "turn", "_p.*")


@query(f"WITH {REPLIES} SELECT conv_id, turn, CASE WHEN contains(reply, '####') THEN {_CLEAN.format(chr(39).join(['string_split(trim(list_extract(string_split(reply, ', '####', '), -1)), chr(10))[1]']))} END AS answer FROM replies")
def solution_answers(spark, d):
    return _replies(spark, d).select("conv_id", "turn", an.solution_answer(F.col("reply")).alias("answer"))


@query(f"WITH {REPLIES} SELECT conv_id, turn, {_CLEAN.format('reply')} AS answer FROM replies")
def normalize_answer(spark, d):
    return _replies(spark, d).select("conv_id", "turn", an.normalized_number(F.col("reply")).alias("answer"))


def _spoken(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    k = (F.col("conv_id") * 3 + F.col("turn")) % 7
    word = F.element_at(F.array(*map(F.lit, ("Yes.", "no,", "y", "maybe", "", "<think>no</think> Yes", "(N) because"))), (k + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(word, F.when(k == 4, "").otherwise(F.concat(F.lit(" "), "text"))).alias("reply"))


SPOKEN = """s AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 7 AS k, text FROM conversations), spoken AS (SELECT conv_id, turn,
 ['Yes.', 'no,', 'y', 'maybe', '', '<think>no</think> Yes', '(N) because'][k + 1] || CASE WHEN k = 4 THEN '' ELSE ' ' || text END AS reply FROM s)"""


@query(f"WITH {SPOKEN}, w AS (SELECT conv_id, turn, lower(regexp_replace(regexp_extract(list_extract(string_split(reply, '</think>'), -1), '[^\\s]+'), '[^a-zA-Z]', '', 'g')) AS w FROM spoken) SELECT conv_id, turn, CASE WHEN w IN ('yes', 'y') THEN 'Yes' WHEN w IN ('no', 'n') THEN 'No' ELSE '' END AS answer FROM w")
def parse_response(spark, d):
    return _spoken(spark, d).select("conv_id", "turn", an.yes_no(F.col("reply")).alias("answer"))


@query(f"WITH {SPOKEN}, w AS (SELECT conv_id, turn, CASE WHEN lower(trim(reply)) LIKE 'yes%' THEN 'Yes' WHEN lower(trim(reply)) LIKE 'no%' THEN 'No' ELSE '' END AS a FROM spoken) SELECT turn % 4 AS part, count(*) AS n, round(avg((a = 'Yes')::INT), 6) AS yes_rate, round(avg((a = 'No')::INT), 6) AS no_rate, round(avg((a = '')::INT), 6) AS unparsed_rate FROM w GROUP BY 1")
def option_tokens(spark, d):
    token = an.option_token(F.col("reply"))
    answer = F.when(token == "yes", "Yes").when(token == "no", "No").otherwise("")
    return behavior.reward_rates(_spoken(spark, d).select((F.col("turn") % 4).alias("part"), answer.alias("answer")), ["part"], "answer")


@query("WITH t AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS k FROM documents) SELECT k AS text_key, count(*) AS n, min(doc_id) AS first_id FROM t GROUP BY 1 HAVING count(*) > 1")
def duplicate_questions(spark, d):
    return audit.duplicate_texts(spark.read.parquet(f"{d}/documents.parquet"), "text", "doc_id")


@query("SELECT event_id, event_id % 9 AS loss, round(value, 2) AS reward FROM events WHERE event_id % 3 <> 0")
def text_log_metrics(spark, d):
    from ..sources.text_logs import metric_lines

    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.when(F.col("event_id") % 3 == 0, F.lit("saving checkpoint")).otherwise(F.format_string("step %d {'loss': '%d', 'reward': %.2f}", "event_id", F.col("event_id") % 9, F.round("value", 2)))
    return metric_lines(e.select("event_id", line.alias("value")), ("loss", "reward")).select("event_id", F.col("loss").cast("long").alias("loss"), "reward")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 3 WHEN c_custkey % 3 = 1 THEN 0 END::INT AS seed, CASE WHEN c_custkey % 3 < 2 THEN (c_custkey * 200)::INT ELSE (c_custkey * 10)::INT END AS step FROM customer")
def model_name_ids(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.format_string("M-seed%d-ckpt%d", k % 3, k * 200)).when(k % 3 == 1, F.format_string("M-ckpt%d", k * 200)).otherwise(F.format_string("M-step%d-EXPLORATORY", k * 10))
    return c.select("c_custkey", an.run_ids(name).alias("_i")).select("c_custkey", "_i.*")


@query("SELECT event_id, round(exp(value / 100 - greatest(value, 100 - value, 50) / 100) / (exp(value / 100 - greatest(value, 100 - value, 50) / 100) + exp((100 - value) / 100 - greatest(value, 100 - value, 50) / 100) + exp(0.5 - greatest(value, 100 - value, 50) / 100)), 6) AS p_first FROM events")
def candidate_softmax(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    p = ch.softmax(F.array(F.col("value") / 100, (100 - F.col("value")) / 100, F.lit(0.5)))
    return e.select("event_id", p[0].alias("p_first"))


@query("SELECT event_id, round(exp(-value / 100) + exp(-value / 50), 6) AS yes, round(exp(-2.0::DOUBLE), 6) AS no FROM events")
def token_log_probabilities(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    entry = lambda t, lp: F.struct(F.lit(t).alias("token"), lp.alias("logprob"))
    tops = F.array(entry(" Yes", -F.col("value") / 100), entry("y", -F.col("value") / 50), entry("No", F.lit(-2.0)), entry("The", F.lit(-0.1)))
    return e.select("event_id", ch.token_mass(tops, ("yes", "y")).alias("yes"), ch.token_mass(tops, ("no", "n")).alias("no"))


@query("SELECT s_suppkey, round((l * l * ve - 2 * l * e * c + e * e * vl) / (vl * ve - c * c), 6) AS wald, round(log10(exp(-(l * l * ve - 2 * l * e * c + e * e * vl) / (vl * ve - c * c) / 2)), 6) AS log10_p, CASE WHEN l - 1 > 0 THEN 'clear_increase' WHEN l + 1 < 0 THEN 'clear_decrease' ELSE 'no_clear_change' END AS verdict FROM (SELECT s_suppkey, s_acctbal / 2000 AS l, (s_suppkey % 7) / 3.0::DOUBLE AS e, 1.0::DOUBLE AS vl, 2.0::DOUBLE AS ve, 0.3::DOUBLE AS c FROM supplier)")
def wald_test(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_acctbal") / 2000).alias("l"), ((F.col("s_suppkey") % 7) / F.lit(3.0)).alias("e"))
    w = wald_two(F.col("l"), F.col("e"), F.lit(1.0), F.lit(2.0), F.lit(0.3))
    return s.select("s_suppkey", w.alias("wald"), chi2_log10_survival(w, 2).alias("log10_p"), interval_verdict(F.col("l") - 1, F.col("l") + 1).alias("verdict"))


@query("SELECT p_partkey, round(log10(1 + h + h * h / 2 + h * h * h / 6) - h / ln(10), 6) AS log10_survival FROM (SELECT p_partkey, p_retailprice / 100 AS h FROM part)")
def chi_square_8(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", chi2_log10_survival(F.col("p_retailprice") / 50, 8).alias("log10_survival"))


VECS = "vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query(f"WITH {VECS}, c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vecs) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS m FROM c GROUP BY 1) SELECT vec_id, round(list_dot_product(e, m) / sqrt(list_dot_product(e, e) * list_dot_product(m, m)), 6) AS cosine FROM vecs JOIN m USING (label)")
def vector_cosine(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))  # a vector a label
    return rows.join(F.broadcast(centre), "label").select("vec_id", con.cosine(F.col("embedding"), F.col("m")).alias("cosine"))


ENERGY = VECS + ", en AS (SELECT vec_id, list_reverse_sort(list_transform(e, lambda x: x * x)) AS s FROM vecs)"


@query(f"WITH {ENERGY} SELECT vec_id, round(list_sum(s) / list_max(s), 6) AS stable_rank, round(exp(-list_sum(list_transform(s, lambda x: CASE WHEN x > 0 THEN x / list_sum(s) * ln(x / list_sum(s)) ELSE 0 END))), 6) AS entropy_rank, round(list_sum(s[1:8]) / list_sum(s), 6) AS energy_8 FROM en")
def stable_rank(spark, d):
    e = F.col("embedding")
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", con.stable_rank(e).alias("stable_rank"), con.entropy_rank(e).alias("entropy_rank"), con.energy_kept(e, 8).alias("energy_8"))


@query(f"WITH {ENERGY}, r AS (SELECT vec_id, s, unnest(range(1, len(s) + 1)) AS k FROM en) SELECT vec_id, min(k)::INT AS rank90 FROM r WHERE list_sum(s[1:k]) >= 0.9 * list_sum(s) GROUP BY 1")
def energy_rank(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", con.rank_for_energy(F.col("embedding"), 0.9).alias("rank90"))


@query("SELECT (n_nationkey + 2)::INT AS line, n_nationkey::VARCHAR || ',' || n_name AS cells FROM nation UNION ALL SELECT 0, 'n_nationkey,n_name'")
def markdown_rows(spark, d):
    """The nations as a Markdown table, written by the sink and read by the source."""
    from ..sources.readers import markdown_table
    from ..sources.sinks import markdown
    from .stream_folder import shared_folder

    folder = shared_folder(spark)
    text = markdown(spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").select("n_nationkey", "n_name"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    return markdown_table(spark, folder).select("line", F.array_join("cells", ",").alias("cells"))


@query("SELECT s_suppkey, 'a chance of ' || round_even((s_suppkey % 97) / 97.0::DOUBLE * 100, 0)::INT || '% to win' AS text, lpad(s_suppkey::VARCHAR, 5, '0') AS id FROM supplier")
def prompt_templates(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select("s_suppkey", an.percent_placeholder(F.lit("a chance of XX% to win"), (F.col("s_suppkey") % 97) / F.lit(97.0)).alias("text"), F.format_string("%05d", "s_suppkey").alias("id"))


