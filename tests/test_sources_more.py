"""Sources and sinks of recorded runs, questions and benchmarks."""

import json

import pytest
from pyspark.sql import functions as F

from dyadics.functions import prompts, records
from dyadics.sources import readers, sinks
from dyadics.streaming import jobs


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_training_steps_take_the_first_name_and_rows_with_a_loss(spark, tmp_path):
    history = [{"step": 1, "loss": 0.5, "rewards/reward_fn/mean": 0.25}, {"step": 2, "eval_loss": 9.0}, {"step": 3, "loss": 0.25, "reward": 1.0, "rewards/reward_fn/mean": 7.0}]
    path = write(tmp_path / "trainer_state.json", json.dumps({"log_history": history}))
    rows = readers.training_steps(spark, path).select("step", "loss", "reward", "kl").collect()
    assert sorted(map(tuple, rows)) == [(1, 0.5, 0.25, None), (3, 0.25, 1.0, None)]


def test_a_metric_table_fills_absent_columns_with_nan(spark, tmp_path):
    path = write(tmp_path / "m.csv", "step,reward\n5,0.5\n6,\n")
    rows = sorted(readers.metric_table(spark, path).selectExpr("step", "reward", "isnan(reward)", "isnan(kl)").collect())
    assert [tuple(r)[0] for r in rows] == [5, 6] and rows[0][1] == 0.5 and rows[1][2] and rows[0][3]


def test_the_first_source_that_exists_counts(spark, tmp_path):
    none = str(tmp_path / "none.json")
    table = write(tmp_path / "m.csv", "step,loss\n5,0.5\n")
    log = write(tmp_path / "run.log", "x {'loss': 0.5, 'step': 7, 'rewards/reward_fn/mean': 2}\nnothing\n")
    state = write(tmp_path / "s.json", json.dumps({"log_history": [{"step": 9, "loss": 1.0}]}))
    for paths, kind, step in (((state, table, log), "state", 9), ((none, table, log), "table", 5), ((none, none, log), "log", 7)):
        rows, found = readers.metrics_of(spark, *paths)
        assert found == kind and [r["step"] for r in rows.collect()] == [step]
    rows, found = readers.metrics_of(spark, none, none, none)
    assert found is None and rows.count() == 0 and "reward" in rows.columns


def test_questions_from_csv_with_a_mark_and_from_json(spark, tmp_path):
    csv = write(tmp_path / "q.csv", '﻿question,answer\n"How many, then?","so #### 1,200"\n')
    row = readers.question_records(readers.question_file(spark, csv), "place").first()
    assert tuple(row) == ("test_00000", "How many, then?", "1200")
    lines = write(tmp_path / "q.jsonl", json.dumps({"id": "a", "question": " q ", "target": 7}) + "\n")
    assert tuple(readers.question_records(readers.question_file(spark, lines), "place").first()) == ("a", "q", "7")


def test_framing_benchmark(spark):
    schema = "row long, text string, domain string, probabilities array<double>"
    rows = [(0, "wins X%", "a", [0.1, 0.2]), (1, "loses XX%", "b", [0.9, 0.8]), (2, "p X%", None, [0.5]), (3, "n X%", " ", [0.5])]
    got = sorted(map(tuple, readers.framing_benchmark(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, "b", True, "wins X%", "loses XX%"), (1, "Unknown", False, "p X%", "n X%")]
    for bad in ([(0, "wins", "a", [0.1]), (1, "loses X%", "a", [0.9])], [(0, "wins X%", "a", [0.1]), (1, "loses X%", "a", [0.8])]):
        with pytest.raises(Exception, match="frames of scenario"):
            readers.framing_benchmark(spark.createDataFrame(bad, schema)).collect()


def test_strict_predictions(spark, tmp_path):
    good = {"case_id": 1, "X_num": 0, "Y_num": 1, "attr": [0, 1, 2, 0], "Yes / No prob": [0.4, 0.6], "output": "No"}
    path = write(tmp_path / "x.json", json.dumps([good, good | {"case_id": 2}]))
    assert readers.predictions(spark, {"X": path}, strict=True).count() == 2
    for bad in ([good, good], [good | {"Yes / No prob": [0.4, -1]}], [{k: v for k, v in good.items() if k != "Y_num"}]):
        path = write(tmp_path / "bad.json", json.dumps(bad))
        assert readers.predictions(spark, {"X": path}).count() == len(bad)
        with pytest.raises(Exception, match="bad or repeated answer"):
            readers.predictions(spark, {"X": path}, strict=True).collect()


def test_manifest_tracked_and_complete(spark, tmp_path):
    (tmp_path / "a").mkdir()
    write(tmp_path / "a" / "one.json", '{"x": 1}\n{"x": 2}\n')
    write(tmp_path / "a" / "two.json", '{"x": 1}\n')
    tracked = spark.createDataFrame([("a/one.json",)], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r["tracked"] for r in sinks.manifest(spark, str(tmp_path / "a"), tracked).collect()}
    assert got == {"one.json": True, "two.json": False}
    assert sinks.complete(spark, str(tmp_path / "a" / "one.json"), 2) and not sinks.complete(spark, str(tmp_path / "a" / "two.json"), 2)
    assert not sinks.complete(spark, str(tmp_path / "nowhere"), 0)


def test_prompt_places_are_filled_once(spark):
    row = spark.range(1).select(prompts.fill("{a} and {b}", {"a": F.lit("{b}"), "b": F.lit("x")}).alias("t"), prompts.few_shot([("1+1?", "2")], F.lit("2+2?")).alias("m")).first()
    assert row["t"] == "{b} and x"
    assert [tuple(m) for m in row["m"]] == [("user", "Q: 1+1?\nA:"), ("assistant", "2"), ("user", "Q: 2+2?\nA:")]


def test_significant_digits(spark):
    values = [(123456.789, 123457.0), (1e-13, 0.0), (-0.00012345678, -0.000123457), (float("inf"), float("inf"))]
    rows = spark.createDataFrame(values, "x double, want double").select(records.canonical_deviation(F.col("x")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_progress_and_retries(spark):
    lines = spark.createDataFrame([("r", 1, " 10%|#  | 10/100 [00:50<07:30, 5s/it]"), ("r", 2, "x 20/100 [01:40<06:40, 5s/it]"), ("r", 3, "no bar")], "run string, n int, value string")
    assert tuple(jobs.progress(lines, "run", "n").first()) == ("r", 20, 100, 0.2, 400.0)
    calls = []

    def flaky(parts):
        for part in parts:
            calls.append(part)
            if len(calls) < 3:
                raise OSError
            yield part * 2

    assert list(jobs.retrying(flaky, 3, 0)(iter([5]))) == [10]
    with pytest.raises(ZeroDivisionError):
        list(jobs.retrying(lambda parts: (1 / 0 for _ in parts), 2, 0)(iter([1])))


def test_upserts_keep_the_last_and_compact(spark, tmp_path):
    schema = "k int, n int, v string"
    write_batch = jobs.upsert(str(tmp_path / "t"), ["k"], "n")
    write_batch(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema), 0)
    write_batch(spark.createDataFrame([(2, 5, "d")], schema), 1)
    want = [(1, 2, "b"), (2, 5, "d")]
    jobs.compacted(spark, str(tmp_path / "t"), str(tmp_path / "u"), ["k"], "n")
    for path in ("t", "u"):
        assert sorted((r["k"], r["n"], r["v"]) for r in jobs.latest(spark, str(tmp_path / path), ["k"], "n").collect()) == want
