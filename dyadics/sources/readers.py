"""Scans with explicit schemas. Row order, where it has meaning, comes from the data and never from the files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PREDICTION = "case_id long, X_num int, Y_num int, attr array<int>, `Yes / No prob` string, output string"


def predictions(spark: SparkSession, paths: dict[str, str], strict: bool = False) -> DataFrame:
    """case_id, perspective, x_num, y_num, i, j, k, l, p_yes, p_no, output of JSON arrays, a path a perspective.

    A probability may be an array or a string that holds one; other forms give nulls, which the audits report. ``strict``
    fails the read at a missing field, a probability that is none, or an id that a perspective has twice.
    """
    from ..functions.choices import valid_probability

    out = None
    for side, path in paths.items():
        rows = spark.read.schema(PREDICTION).json(path, multiLine=True)
        prob = F.from_json(F.col("`Yes / No prob`"), "array<double>")
        levels = [F.get(F.col("attr"), F.lit(n)).alias(c) for n, c in enumerate("ijkl")]
        rows = rows.select("case_id", F.lit(side).alias("perspective"), F.col("X_num").alias("x_num"), F.col("Y_num").alias("y_num"), *levels, F.when(F.size(prob) == 2, prob[0]).alias("p_yes"), F.when(F.size(prob) == 2, prob[1]).alias("p_no"), "output")
        out = rows if out is None else out.unionByName(rows)
    if not strict:
        return out
    needed = [c for c in out.columns if c != "output"]
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    bad = F.raise_error(F.concat(F.lit("bad or repeated answer of case "), F.coalesce(F.col("case_id").cast("string"), F.lit("without id")))).cast("long")
    again = F.count("*").over(Window.partitionBy("perspective", "case_id"))
    fine = whole & valid_probability(F.col("p_yes"), F.col("p_no")).isNotNull() & (F.col("_n") == 1)
    return out.withColumn("_n", again).withColumn("case_id", F.when(fine, F.col("case_id")).otherwise(bad)).drop("_n")


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of each key the row of the greatest ``order``. One aggregate: the winner travels as a struct."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*key, "_row.*")


def case_lists(spark: SparkSession, path: str) -> DataFrame:
    """x, y, codes, row of a JSON list of [x, y, [codes]]; malformed rows are left out (``bad_case_rows`` has them)."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("row", "item"))
    parts = rows.select("row", F.from_json("item", "array<string>").alias("p"))
    out = parts.select("row", F.get("p", F.lit(0)).try_cast("int").alias("x"), F.get("p", F.lit(1)).try_cast("int").alias("y"), F.from_json(F.get("p", F.lit(2)), "array<int>").alias("codes"))
    return out.where("x IS NOT NULL AND y IS NOT NULL AND codes IS NOT NULL")


def goods(spark: SparkSession, path: str) -> DataFrame:
    """idx, category, name, attrs of a catalogue {category: {good: {attribute: [levels]}}}; idx is the place in the file."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # a catalogue of a hundred goods
    rows = [(i, c, g, [(a, [str(x) for x in lv]) for a, lv in attrs.items()]) for i, (c, g, attrs) in enumerate((c, g, attrs) for c, names in json.loads(text).items() for g, attrs in names.items())]
    return spark.createDataFrame(rows, "idx int, category string, name string, attrs array<struct<name: string, levels: array<string>>>")


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """parameter, estimate, std_err, variance, file of parameter tables; a glob reads many at once."""
    rows = spark.read.csv(path, header=True).withColumn("file", F.input_file_name())
    return rows.select(F.col("Parameter").alias("parameter"), *(F.col(f"`{a}`").try_cast("double").alias(b) for a, b in (("Estimate", "estimate"), ("Std. Err.", "std_err"), ("Variance", "variance"))), "file")


def parameter_parts(rows: DataFrame) -> DataFrame:
    """``rows`` with kind ('lambda', 'eta', 'alpha', 'beta', 'gamma'), item, a1, a2 taken from the names."""
    name = F.col("parameter")
    number = lambda p, g: F.regexp_extract(name, p, g).try_cast("int")
    return rows.withColumns({"kind": F.regexp_extract(name, "^([a-z]+)", 1), "item": number(r"^alpha_(\d+)$", 1), "a1": number(r"^beta_(\d+),(\d+)$", 1), "a2": number(r"^beta_(\d+),(\d+)$", 2)})


def utilities(spark: SparkSession, path: str) -> DataFrame:
    """idx, a1, a2 (all from 0) and utility; a utility that is not positive fails as it is read."""
    rows = spark.read.schema("index int, attr_1 int, attr_2 int, utility double").csv(path, header=True)
    bad = F.raise_error(F.concat(F.lit("utility of good "), F.col("index").cast("string"), F.lit(" is not positive"))).cast("double")
    return rows.select((F.col("index") - 1).alias("idx"), (F.col("attr_1") - 1).alias("a1"), (F.col("attr_2") - 1).alias("a2"), F.when(F.col("utility") > 0, F.col("utility")).otherwise(bad).alias("utility"))


def choice_counts(spark: SparkSession, path: str) -> DataFrame:
    """x_choice, y_choice, value of a 3 x 3 table; cells are numbers or 'mean (median)' in percent, then as shares."""
    rows = spark.read.csv(path, header=True)
    first, *others = rows.columns
    cells = F.explode(F.create_map(*(x for c in others for x in (F.lit(c), F.col(f"`{c}`")))))
    out = rows.select(F.trim(F.col(f"`{first}`")).alias("x_choice"), cells.alias("y_choice", "_cell"))
    number = F.element_at(F.split(F.trim("_cell"), " "), 1).try_cast("double")
    return out.select("x_choice", F.trim("y_choice").alias("y_choice"), F.when(F.col("_cell").contains("("), number / 100).otherwise(number).alias("value"))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and the fields of ``value`` (a schema) of a JSON object of objects or scalars, one row a key."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "item"))
    fields = F.from_json("item", value)
    return text.select("key", fields.alias("_v"), "item").select("key", "_v.*", "item")


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """case_id, pref of an anchor file: {id: 'X'} or {id: {pref: 'X'}}, plain or below 'anchors'; other values give null."""
    whole = spark.read.text(path, wholetext=True)
    top = F.from_json("value", "map<string,string>")
    inner = F.coalesce(F.from_json(F.try_element_at(top, F.lit("anchors")), "map<string,string>"), top)
    rows = whole.select(F.explode(inner).alias("key", "item"))
    pref = F.coalesce(F.get_json_object("item", "$.pref"), F.col("item"))
    return rows.select(F.col("key").try_cast("long").alias("case_id"), F.when(pref.isin("X", "Y"), pref).alias("pref"))


def json_lines(spark: SparkSession, path: str, schema: str, key: list[str] | None = None) -> DataFrame:
    """JSON lines in a schema; a malformed line fails the read. With ``key``, so does a repeated key."""
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    if not key:
        return rows
    again = F.count("*").over(Window.partitionBy(*key))
    return rows.withColumn("_n", again).withColumn(key[0], F.when(F.col("_n") == 1, F.col(key[0])).otherwise(F.raise_error(F.lit("repeated key")).cast(rows.schema[key[0]].dataType))).drop("_n")


def question_file(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """The fields of a CSV or JSON-lines file of questions as strings, with ``place`` in the file; a byte-order mark is dropped."""
    if path.rstrip("/").endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        rows = spark.read.json(path, primitivesAsString=True)
    named = rows.select(*(F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in rows.columns))
    return named.withColumn(place, F.monotonically_increasing_id())


def question_records(rows: DataFrame, order: str) -> DataFrame:
    """id, question, target: ids default to test_00000 by the place in ``order``; targets fall back on the solution."""
    from ..functions.answers import normalized_number, solution_answer
    from ..operators.sampling import numbered

    has = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    kept = rows.where(F.coalesce(has("split"), F.lit("test")) == "test")
    placed = numbered(kept.withColumn("_one", F.lit(1)), order, "_one", first=0)
    return placed.select(F.coalesce(has("id"), F.format_string("test_%05d", "first_id")).alias("id"), F.trim("question").alias("question"), F.coalesce(normalized_number(has("target")), solution_answer(has("answer")), normalized_number(has("answer"))).alias("target"))


def trainer_states(spark: SparkSession, path: str, fields: tuple[str, ...] = ("epoch", "loss", "grad_norm", "learning_rate", "reward", "reward_std", "kl", "entropy")) -> DataFrame:
    """file, pos, step and the named fields of each entry of ``log_history``; what an entry lacks is null."""
    state = F.from_json("value", "log_history array<map<string,string>>", {"allowNonNumericNumbers": "true"})
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), state.alias("state"))
    rows = whole.select("file", F.posexplode("state.log_history").alias("pos", "item"))
    number = lambda c: F.try_element_at("item", F.lit(c)).try_cast("double")
    return rows.select("file", "pos", F.try_element_at("item", F.lit("step")).try_cast("int").alias("step"), *(number(c).alias(c) for c in fields))


#: The names under which trainers log a metric, the first one found counts.
METRIC_NAMES = {
    "reward": ("reward", "rewards/reward_fn/mean"),
    "reward_std": ("reward_std", "rewards/reward_fn/std"),
    "loss": ("loss",),
    "kl": ("kl",),
    "entropy": ("entropy",),
    "frac_reward_zero_std": ("frac_reward_zero_std",),
    "grad_norm": ("grad_norm",),
    "learning_rate": ("learning_rate",),
    "epoch": ("epoch",),
}


def training_steps(spark: SparkSession, path: str, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """file, step and the metrics of the entries that have a step and a loss, each metric by the first of its names."""
    from ..functions.records import first_of

    state = F.from_json("value", "log_history array<map<string,string>>", {"allowNonNumericNumbers": "true"})
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(state["log_history"]).alias("item"))
    kept = rows.where(F.map_contains_key("item", "step") & F.map_contains_key("item", "loss"))
    return kept.select("file", F.try_element_at("item", F.lit("step")).try_cast("int").alias("step"), *(first_of(F.col("item"), n).alias(c) for c, n in (names or METRIC_NAMES).items()))


def metric_table(spark: SparkSession, path: str, metrics: tuple[str, ...] = tuple(METRIC_NAMES)) -> DataFrame:
    """file, step and the metrics of CSV tables; a metric that a table lacks, or an empty cell, is NaN."""
    rows = spark.read.csv(path, header=True).withColumn("file", F.input_file_name())
    number = lambda c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(float("nan"))) if c in rows.columns else F.lit(float("nan"))
    return rows.select("file", F.col("step").try_cast("double").cast("int").alias("step"), *(number(c).alias(c) for c in metrics))


def metrics_of(spark: SparkSession, states: str, tables: str, logs: str) -> tuple[DataFrame, str | None]:
    """The metrics of a run and their kind, from the first of its sources that exists: 'state', 'table', 'log', or none (no rows)."""
    from .text_logs import metric_lines

    names = tuple(METRIC_NAMES)
    empty = spark.createDataFrame([], "step int, " + ", ".join(f"{n} double" for n in names))
    for kind, path in (("state", states), ("table", tables), ("log", logs)):
        if not _exists(spark, path):
            continue
        if kind == "log":
            lines = metric_lines(spark.read.text(path), ("step", *(n for _, found in METRIC_NAMES.items() for n in found)))
            rows = lines.where("step IS NOT NULL AND loss IS NOT NULL").select(F.col("step").cast("int").alias("step"), *(F.coalesce(*(F.col(f"`{n}`") for n in found)).alias(c) for c, found in METRIC_NAMES.items()))
        else:
            rows = (training_steps if kind == "state" else metric_table)(spark, path).select("step", *names)
        return rows, kind
    return empty, None


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except Exception as missing:  # Spark tells of a path that does not exist by an analysis error
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


def framing_benchmark(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """scenario_id, domain, domain_mismatch, positive, negative of rows (row, text, domain, probabilities) that alternate the frames.

    Both frames need a placeholder and complementary probabilities, or the read fails. Where both frames state a domain and
    differ, the negative one counts; where neither does, it is 'Unknown'.
    """
    of = lambda column, parity: F.max(F.when(F.pmod(F.col("row"), F.lit(2)) == parity, column))
    stated = F.nullif(F.trim("domain"), F.lit(""))
    pairs = rows.groupBy(F.floor(F.col("row") / 2).alias("scenario_id")).agg(of(F.col("text"), 0).alias("positive"), of(F.col("text"), 1).alias("negative"), of(stated, 0).alias("_p"), of(stated, 1).alias("_n"), of(F.col("probabilities"), 0).alias("_pp"), of(F.col("probabilities"), 1).alias("_pn"))
    complement = (F.size("_pp") == F.size("_pn")) & F.forall(F.zip_with("_pp", "_pn", lambda x, y: F.abs(x + y - 1) <= tolerance), lambda ok: ok)
    fine = F.col("positive").rlike("X{1,2}%") & F.col("negative").rlike("X{1,2}%") & complement
    bad = F.raise_error(F.concat(F.lit("frames of scenario "), F.col("scenario_id").cast("string"))).cast("string")
    differ = F.coalesce(F.col("_p") != F.col("_n"), F.lit(False))
    domain = F.when(differ, F.col("_n")).otherwise(F.coalesce("_p", "_n", F.lit("Unknown")))
    return pairs.select("scenario_id", domain.alias("domain"), differ.alias("domain_mismatch"), F.when(F.coalesce(fine, F.lit(False)), F.col("positive")).otherwise(bad).alias("positive"), "negative")


def spreadsheet(spark: SparkSession, path: str, columns: list[str], sheet: str | int = 0) -> DataFrame:
    """row and the named columns, as strings, of a sheet of a workbook; ``sheets.sheets`` reads many workbooks at once."""
    from .sheets import named, sheets

    return named(sheets(spark, path, sheet), {c: c for c in columns}).drop("file")


def framing_pairs(rows: DataFrame, order: str = "row") -> DataFrame:
    """scenario_id and the two frames of rows that alternate positive and negative: rows 2n and 2n + 1 form scenario n."""
    scenario = F.floor(F.col(order) / 2).alias("scenario_id")
    text = lambda parity: F.max(F.when(F.pmod(F.col(order), F.lit(2)) == parity, F.col("text")))
    return rows.groupBy(scenario).agg(text(0).alias("positive"), text(1).alias("negative"), F.max("domain").alias("domain"))


def markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """line, cells of the table rows of a Markdown text; the rule below the head is left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    inner = F.regexp_replace(F.trim("text"), r"^\||\|$", "")
    return rows.where(F.trim("text").startswith("|") & ~F.trim("text").rlike(r"^\|[\s:|-]+\|?$")).select("line", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def tensors(spark: SparkSession, path: str, columns: str | None = None, slice_bytes: int | None = None) -> DataFrame:
    """file, name, dtype, shape, start, values of tensor files: one row a slice, ``start`` being its first value's place.

    ``columns`` (a schema) leaves out what is not asked for, or asks for values as doubles. A slice goes to a partition of its
    own; a tensor within ``slice_bytes`` is a single one. Filters on the name are the source's.
    """
    from .tensor_files import SCHEMA, SLICE_BYTES, registered

    return registered(spark).read.format("tensors").schema(columns or SCHEMA).option("sliceBytes", slice_bytes or SLICE_BYTES).load(path)


def whole_tensors(spark: SparkSession, path: str) -> DataFrame:
    """file, name, dtype, shape, values of tensors that fit a row: their slices in order. For factors and vectors."""
    parts = tensors(spark, path).groupBy("file", "name", "dtype", "shape").agg(F.array_sort(F.collect_list(F.struct("start", "values"))).alias("_s"))
    return parts.select("file", "name", "dtype", "shape", F.flatten("_s.values").alias("values"))


def scored(cases: DataFrame, done: DataFrame, key: list[str], score: Callable, schema: str) -> DataFrame:
    """Answers of cases that are not done: ``score`` takes and gives iterators of pandas frames, as a model's wrapper."""
    return cases.join(done.select(*key), key, "left_anti").mapInPandas(score, schema)
