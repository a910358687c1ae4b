"""Queries that write the driver's rows with the sinks and read them back with the scans, one a family of files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import audit
from ..sources import readers, sinks
from . import views as v
from .register import registry
from .stream_folder import shared_folder

QUERIES, ORACLES, query = registry()


def _array_file(rows, path, by):
    """Rows (by, item: a JSON text) as files of one JSON array each."""
    texts = rows.groupBy(by).agg(F.concat(F.lit("["), F.concat_ws(",\n ", F.array_sort(F.collect_list("item"))), F.lit("]")).alias("value"))
    texts.write.partitionBy(by).text(path)


@query(
    """WITH p AS (SELECT vec_id, embedding AS e, vec_id // 256 AS block, row_number() OVER (PARTITION BY vec_id // 256 ORDER BY vec_id) - 1 AS place FROM embeddings)
SELECT 'block.' || block AS name, place, len(e) AS numbers, list_sum(list_transform(e, lambda x: floor(x::DOUBLE * 1000000)::BIGINT))::BIGINT AS micros, floor(e[1]::DOUBLE * 1000000)::BIGINT AS first FROM p"""
)
def tensor_round_trip(spark, d):
    """Embeddings as matrices of 256 rows in tensor files, read back in slices of 32 rows, a partition each."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    blocks = e.groupBy(F.floor(F.col("vec_id") / 256).alias("block")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))  # 256 rows
    width = F.size(F.get(F.col("r.embedding"), F.lit(0))).cast("long")
    path = shared_folder(spark)
    sinks.write_tensors(blocks.select(F.concat(F.lit("block."), "block").alias("name"), F.lit("F32").alias("dtype"), F.array(F.size("r").cast("long"), width).alias("shape"), F.flatten("r.embedding").cast("array<float>").alias("values")), path, file_bytes=1 << 20)
    slices = readers.tensors(spark, path, "name string, shape array<long>, start long, values array<float>", slice_bytes=32 * 4 * 64)
    wide = F.get("shape", F.lit(1)).cast("int")
    rows = slices.select("name", "start", wide.alias("w"), F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("values") / wide).cast("int") - 1), lambda k: F.slice("values", k * wide + 1, wide))).alias("k", "e"))
    micros = F.transform("e", lambda x: F.floor(x.cast("double") * 1_000_000))
    return rows.select("name", (F.floor(F.col("start") / F.col("w")) + F.col("k")).alias("place"), F.size("e").cast("long").alias("numbers"), F.aggregate(micros, F.lit(0).cast("long"), lambda a, x: a + x).alias("micros"), F.get(micros, F.lit(0)).alias("first"))


@query("SELECT 'block.' || vec_id // 256 AS name, count(*) AS rows, sum(floor(embedding[1]::DOUBLE * 1000000))::BIGINT AS firsts FROM embeddings WHERE vec_id // 256 IN (0, 2) GROUP BY 1")
def tensors_by_name(spark, d):
    """Two matrices of the tensor files by their names: the filter is the source's, the other slices are not planned."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    one = e.groupBy(F.floor(F.col("vec_id") / 256).alias("block")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.get("embedding", F.lit(0)).alias("x")))).alias("r"))
    path = shared_folder(spark)
    sinks.write_tensors(one.select(F.concat(F.lit("block."), "block").alias("name"), F.lit("F32").alias("dtype"), F.array(F.size("r").cast("long")).alias("shape"), F.col("r.x").cast("array<float>").alias("values")), path)
    found = readers.tensors(spark, path).where(F.col("name").isin("block.0", "block.2")).select("name", F.explode("values").alias("x"))
    return found.groupBy("name").agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("x").cast("double") * 1_000_000)).alias("firsts"))


@query(f"WITH {v.PREDS}, a AS (SELECT *, {v.LEVELS} FROM preds) SELECT case_id, perspective, x_num, y_num, i, j, k, l, round(p_yes, 6) AS p_yes, round(p_no, 6) AS p_no, CASE WHEN p_yes > p_no THEN 'Yes' ELSE 'No' END AS output FROM a")
def answer_files(spark, d):
    """Answers as files of JSON arrays, a path a perspective, read strictly: a missing field or a repeated id would fail."""
    path = shared_folder(spark)
    rows = v.with_levels(v.predictions(spark, d))
    prob = F.concat(F.lit("["), F.col("p_yes").cast("string"), F.lit(", "), F.col("p_no").cast("string"), F.lit("]"))
    item = F.to_json(F.struct("case_id", F.col("x_num").alias("X_num"), F.col("y_num").alias("Y_num"), F.array("i", "j", "k", "l").alias("attr"), prob.alias("Yes / No prob"), F.when(F.col("p_yes") > F.col("p_no"), "Yes").otherwise("No").alias("output")))
    for side in "XY":
        _array_file(rows.where(F.col("perspective") == side).select(F.pmod("case_id", F.lit(16)).alias("part"), item.alias("item")), f"{path}/{side}", "part")
    out = readers.predictions(spark, {s: f"{path}/{s}" for s in "XY"}, strict=True)
    return out.withColumns({"x_num": F.col("x_num").cast("long"), "y_num": F.col("y_num").cast("long")})


@query("SELECT user_id % 500 AS case_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, d):
    """Ids that a file of JSON lines has more than once, which a strict scan would refuse."""
    path = shared_folder(spark)
    sinks.write_json(spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 500).alias("case_id"), "event_type"), path)
    return audit.duplicates(readers.json_lines(spark, path, "case_id long, event_type string"), ["case_id"])


GOODS = "g AS (SELECT p_partkey % 40 AS k, min(p_brand) AS category FROM part GROUP BY 1)"


@query(f"WITH {GOODS}, n AS (SELECT k, category, printf('Good %02d', k) AS name FROM g) SELECT (row_number() OVER (ORDER BY category, name) - 1)::INT AS idx, category, name, 'trait ' || k % 5 AS first_attribute, 'level 0 of ' || k AS first_level, 6 AS levels FROM n")
def goods_catalogue(spark, d):
    """A catalogue of goods by category as one JSON object; a good's number is its place in the file."""
    p = spark.read.parquet(f"{d}/part.parquet")
    goods = p.groupBy((F.col("p_partkey") % 40).alias("k")).agg(F.min("p_brand").alias("category"))  # 40 goods
    level = lambda n: F.array(*(F.concat(F.lit(f"level {m + 3 * n} of "), F.col("k").cast("string")) for m in range(3)))
    attrs = F.map_from_arrays(F.array(F.concat(F.lit("trait "), (F.col("k") % 5).cast("string")), F.lit("other")), F.array(level(0), level(1)))
    named = goods.select("category", F.format_string("Good %02d", "k").alias("name"), attrs.alias("attrs"))
    inner = named.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("name", F.to_json("attrs").alias("a")))).alias("own"))
    texts = [(r["category"], r["own"]) for r in inner.orderBy("category").collect()]
    path = shared_folder(spark)
    whole = json.dumps({c: {n: json.loads(a) for n, a in own} for c, own in texts})
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(path)
    out = readers.goods(spark, path)
    first = F.get("attrs", F.lit(0))
    return out.select("idx", "category", "name", first["name"].alias("first_attribute"), F.get(first["levels"], F.lit(0)).alias("first_level"), F.aggregate("attrs", F.lit(0), lambda a, x: a + F.size(x["levels"])).alias("levels"))


@query("WITH p AS (SELECT p_partkey % 100 AS g, avg(p_retailprice) / 1000::DOUBLE AS e, count(*) AS n FROM part GROUP BY 1) SELECT 'alpha_' || g + 2 AS parameter, 'alpha' AS kind, (g + 2)::INT AS item, round(e, 6) AS estimate, round(e / n, 6) AS std_err, NULL::DOUBLE AS variance FROM p WHERE g % 9 <> 0 UNION ALL SELECT 'beta_' || (g // 9 % 3) + 1 || ',' || (g // 27) + 1, 'beta', NULL, round(e, 6), round(e / n, 6), round(e / n * (e / n), 6) FROM p WHERE g % 9 = 0")
def parameter_files(spark, d):
    """Estimates by name as CSV with eight digits; a table may lack a number."""
    p = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_partkey") % 100).alias("g")).agg((F.avg("p_retailprice") / 1000).alias("e"), F.count("*").alias("n"))
    g, beta = F.col("g"), F.col("g") % 9 == 0
    name = F.when(beta, F.concat(F.lit("beta_"), F.floor(g / 9) % 3 + 1, F.lit(","), F.floor(g / 27).cast("long") + 1)).otherwise(F.concat(F.lit("alpha_"), g + 2))
    error = F.col("e") / F.col("n")
    path = shared_folder(spark)
    sinks.write_csv(p.select(name.alias("Parameter"), F.col("e").alias("Estimate"), error.alias("Std. Err."), F.when(beta, error * error).alias("Variance")), path)
    return readers.parameter_parts(readers.parameters(spark, path)).select("parameter", "kind", "item", "estimate", "std_err", F.when(F.col("kind") == "beta", F.col("variance")).alias("variance"))


@query(f"WITH {v.UTIL} SELECT idx, a1, a2, round(utility, 6) AS utility FROM util")
def utility_files(spark, d):
    """Utilities as CSV, numbered from 1 in the file and from 0 in the table; one that is not positive would fail."""
    path = shared_folder(spark)
    u = v.utilities(spark, d)
    sinks.write_csv(u.select((F.col("idx") + 1).alias("index"), (F.col("a1") + 1).alias("attr_1"), (F.col("a2") + 1).alias("attr_2"), "utility"), path)
    return readers.utilities(spark, path)


_CHOICE = "CASE WHEN {0} >= 0.6 THEN 'Y' WHEN {0} <= 0.4 THEN 'X' ELSE 'Indifferent' END"


@query(
    f"""WITH {v.PAIRS}, c AS (SELECT {_CHOICE.format('p_yes_x')} AS x_choice, {_CHOICE.format('p_yes_y')} AS y_choice FROM pairs), k AS (SELECT 'X' AS o UNION ALL SELECT 'Y' UNION ALL SELECT 'Indifferent'),
n AS (SELECT a.o AS x_choice, b.o AS y_choice, (SELECT count(*) FROM c WHERE c.x_choice = a.o AND c.y_choice = b.o) AS n, (SELECT count(*) FROM c) AS total FROM k a, k b)
SELECT x_choice, y_choice, n::DOUBLE AS counted, round(n / total::DOUBLE, 6) AS share FROM n"""
)
def choice_tables(spark, d):
    """The 3 x 3 table of choices as CSV of counts and of percents 'mean (median)', read by one scan."""
    kinds = ["X", "Y", "Indifferent"]
    p = v.paired(spark, d)
    rows = p.select(*(F.expr(_CHOICE.format(f"p_yes_{s}")).alias(f"{s}_choice") for s in "xy"))
    total = rows.count()
    wide = rows.groupBy("x_choice").pivot("y_choice", kinds).count().na.fill(0)
    wide = spark.createDataFrame([(k,) for k in kinds], "x_choice string").join(wide, "x_choice", "left").na.fill(0)
    path = shared_folder(spark)
    wide.coalesce(1).write.csv(f"{path}/counts", header=True)
    percent = lambda c: F.concat(F.format_string("%.8f", F.col(c) / total * 100), F.lit(" (50.0)"))
    wide.select("x_choice", *(percent(c).alias(c) for c in kinds)).coalesce(1).write.csv(f"{path}/percent", header=True)
    counts = readers.choice_counts(spark, f"{path}/counts").withColumnRenamed("value", "counted")
    return counts.join(readers.choice_counts(spark, f"{path}/percent").withColumnRenamed("value", "share"), ["x_choice", "y_choice"])


@query("SELECT c_custkey AS case_id, CASE c_custkey % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'X' END AS pref FROM customer")
def anchor_files(spark, d):
    """Anchors in both forms, plain and below 'anchors'; what is neither X nor Y gives none."""
    c, path = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), shared_folder(spark)
    k = F.col("c_custkey")
    pref = F.when(k % 4 == 0, '"X"').when(k % 4 == 1, '{"pref": "Y", "n": 3}').when(k % 4 == 2, '{"pref": "X"}').otherwise('{"pref": "Z"}')
    item = F.concat(F.lit('"'), k.cast("string"), F.lit('": '), pref)
    inside = c.select((k % 8).alias("part"), item.alias("item")).groupBy("part").agg(F.concat(F.lit("{"), F.concat_ws(", ", F.collect_list("item")), F.lit("}")).alias("value"))
    inside.select("part", F.when(F.col("part") < 4, F.col("value")).otherwise(F.concat(F.lit('{"seed": 1, "anchors": '), "value", F.lit("}"))).alias("value")).write.partitionBy("part").text(path)
    return readers.anchors(spark, path)


@query("SELECT printf('q%06d', item_id) AS id, trim(text) AS question, (item_id * 7 % 1000)::VARCHAR AS target FROM benchmark")
def question_files(spark, d):
    """Questions as CSV and as JSON lines: a target of its own, or the number that ends the solution."""
    b, path = spark.read.parquet(f"{d}/benchmark.parquet"), shared_folder(spark)
    k = F.col("item_id")
    number = (k * 7 % 1000).cast("string")
    rows = b.select(F.format_string("q%06d", k).alias("id"), F.col("text").alias("question"), F.when(k % 2 == 0, number).otherwise("").alias("target"), F.concat(F.lit("So it is.\n#### "), number).alias("answer"))
    rows.where(k % 3 == 0).write.option("escape", '"').csv(f"{path}/a.csv", header=True)
    sinks.write_json(rows.where(k % 3 != 0), f"{path}/b.jsonl")
    out = None
    for name in ("a.csv", "b.jsonl"):
        one = readers.question_records(readers.question_file(spark, f"{path}/{name}"), "place")
        out = one if out is None else out.unionByName(one)
    return out


STATES = "s AS (SELECT user_id % 30 AS run, (row_number() OVER (PARTITION BY user_id % 30 ORDER BY event_id) - 1)::INT AS pos, event_id, value FROM events)"


def _states(spark, d):
    from pyspark.sql.window import Window

    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 30).alias("run"), "event_id", "value")
    place = F.row_number().over(Window.partitionBy("run").orderBy("event_id")) - 1  # the log of one run
    return e.withColumn("pos", place)


@query(f"WITH {STATES} SELECT run, pos, pos * 10 AS step, round(CASE WHEN pos % 4 <> 3 THEN value END, 6) AS loss, round(CASE WHEN pos % 2 = 0 THEN value / 10 END, 6) AS reward FROM s")
def trainer_state_files(spark, d):
    """Logs of trainers as state files, a file a run; what an entry lacks is null."""
    path = shared_folder(spark)
    k, x = F.col("pos"), F.col("value").cast("string")
    item = F.to_json(F.map_filter(F.create_map(F.lit("step"), (k * 10).cast("string"), F.lit("loss"), F.when(k % 4 != 3, x), F.lit("reward"), F.when(k % 2 == 0, (F.col("value") / 10).cast("string"))), lambda _, x: x.isNotNull()))
    logs = _states(spark, d).groupBy("run").agg(F.concat(F.lit('{"best": null, "log_history": ['), F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda r: r["item"])), F.lit("]}")).alias("value"))
    logs.write.partitionBy("run").text(path)
    rows = readers.trainer_states(spark, path, ("loss", "reward"))
    return rows.select(F.regexp_extract("file", r"run=(\d+)", 1).cast("long").alias("run"), "pos", "step", "loss", "reward")


@query(f"WITH {STATES} SELECT run, pos AS step, round(value / 10, 6) AS reward, round(value, 6) AS loss, round(CASE WHEN pos % 3 = 0 THEN value / 2 END, 6) AS kl, run % 3 AS kind FROM s WHERE pos % 5 <> 4")
def run_metrics(spark, d):
    """Metrics of a run from the first of its sources that exists: state files, tables or logs, a third of the runs each.

    Entries without a loss are no steps; metrics go by several names, and a table lacks what it was not given.
    """
    path, rows = shared_folder(spark), _states(spark, d).where("pos % 5 <> 4")
    k, x = F.col("pos"), F.col("value")
    text = lambda c: c.cast("string")
    kl = F.when(k % 3 == 0, x / 2)
    state = F.to_json(F.map_filter(F.create_map(F.lit("step"), text(k), F.lit("loss"), text(x), F.lit("rewards/reward_fn/mean"), text(x / 10), F.lit("kl"), text(kl)), lambda _, y: y.isNotNull()))
    files = rows.where("run % 3 = 0").groupBy("run").agg(F.concat(F.lit('{"log_history": ['), F.concat_ws(", ", F.collect_list(state)), F.lit(', {"step": "9", "note": "x"}]}')).alias("value"))
    files.write.partitionBy("run").text(f"{path}/state")
    rows.where("run % 3 = 1").select("run", k.alias("step"), (x / 10).alias("reward"), x.alias("loss"), kl.alias("kl")).write.partitionBy("run").csv(f"{path}/table", header=True)
    line = F.concat(F.lit("{'loss': '"), text(x), F.lit("', 'reward': '"), text(x / 10), F.lit("', "), F.when(kl.isNotNull(), F.concat(F.lit("'kl': '"), text(kl), F.lit("', "))).otherwise(""), F.lit("'step': '"), text(k), F.lit("'}"))
    rows.where("run % 3 = 2").select("run", line.alias("value")).write.partitionBy("run").text(f"{path}/log")
    out = None
    for run in range(30):  # a plan a run, as a survey of thirty runs is made
        own, _ = readers.metrics_of(spark, *(f"{path}/{kind}/run={run}" for kind in ("state", "table", "log")))
        kind = {"state": 0, "table": 1, "log": 2, None: -1}[_]
        one = own.select(F.lit(run).cast("long").alias("run"), F.col("step").cast("long").alias("step"), "reward", "loss", F.nanvl("kl", F.lit(None).cast("double")).alias("kl"), F.lit(kind).cast("long").alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey AS case_id, o_orderstatus AS answer, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS round FROM orders")
def resumed_outputs(spark, d):
    """Outputs in rounds: the second adds what the first has not, and a run goes on past outputs only if they are whole."""
    path = shared_folder(spark)
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("answer"))
    if sinks.complete(spark, path, 1):
        raise ValueError("outputs before the first round")
    sinks.append_json(o.where("case_id % 3 <> 0").withColumn("round", F.lit(1)), path)
    if not sinks.complete(spark, path, o.count()):
        done = readers.json_lines(spark, path, "case_id long, answer string, round long", ["case_id"])
        sinks.append_json(o.join(done, "case_id", "left_anti").withColumn("round", F.lit(2)), path)
    if not sinks.complete(spark, path, o.count()):
        raise ValueError("the outputs are not whole")
    return readers.json_lines(spark, path, "case_id long, answer string, round long", ["case_id"])


@query("SELECT conv_id, turn, role, md5(text) AS content_md5, 3 AS messages FROM conversations")
def message_files(spark, d):
    """Turns as training messages in JSON lines, read back."""
    path = shared_folder(spark)
    c = spark.read.parquet(f"{d}/conversations.parquet")
    sinks.write_json(sinks.messages(c, "You are the owner.", "text", "role").select("conv_id", "turn", "messages"), path)
    rows = readers.json_lines(spark, path, "conv_id long, turn int, messages array<struct<role: string, content: string>>")
    return rows.select("conv_id", "turn", F.get("messages.content", F.lit(2)).alias("role"), F.md5(F.get("messages.content", F.lit(1))).alias("content_md5"), F.size("messages").alias("messages"))
