import json
import struct

import numpy as np
import pytest

from dyadics.sources import readers, sinks, text_logs


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_predictions(spark, tmp_path):
    row = {"case_id": 1, "X_num": 0, "Y_num": 3, "attr": [0, 1, 2, 0], "Yes / No prob": [0.2, 0.8], "output": "No"}
    x = put(tmp_path / "x.json", json.dumps([row, row | {"case_id": 2, "Yes / No prob": "[0.3, 0.7]"}, row | {"case_id": 3, "Yes / No prob": [1]}]))
    y = put(tmp_path / "y.json", json.dumps([row]))
    got = {(r["perspective"], r["case_id"]): (r["p_yes"], r["l"]) for r in readers.predictions(spark, {"X": x, "Y": y}).collect()}
    assert got == {("X", 1): (0.2, 0), ("X", 2): (0.3, 0), ("X", 3): (None, 0), ("Y", 1): (0.2, 0)}


def test_case_lists_and_goods(spark, tmp_path):
    path = put(tmp_path / "cases.json", "[[0, 1, [3, 4]], [2, 5, []], [7], \"x\", [1, 2, [80]]]")
    assert [(r["x"], r["y"], r["codes"]) for r in readers.case_lists(spark, path).orderBy("row").collect()] == [(0, 1, [3, 4]), (2, 5, []), (1, 2, [80])]
    path = put(tmp_path / "goods.json", json.dumps({"b": {"lamp": {"size": ["s", "m", "l"], "light": [1, 2, 3]}}, "a": {"cup": {"size": ["s", "m", "l"], "use": ["x", "y", "z"]}}}))
    rows = readers.goods(spark, path).orderBy("idx").collect()
    assert [(r["idx"], r["category"], r["name"], r["attrs"][1]["levels"][1]) for r in rows] == [(0, "b", "lamp", "2"), (1, "a", "cup", "y")]


def test_tables(spark, tmp_path):
    path = put(tmp_path / "p.csv", "Parameter,Estimate,Std. Err.,Variance\nlambda,7.6,0.6,0.36\nalpha_12,0.1,bad,\n\"beta_2,3\",0.2,0.1,0.01\n")
    rows = {r["parameter"]: r for r in readers.parameter_parts(readers.parameters(spark, path)).collect()}
    assert rows["alpha_12"]["item"] == 12 and rows["alpha_12"]["std_err"] is None and (rows["beta_2,3"]["a1"], rows["beta_2,3"]["a2"]) == (2, 3)
    path = put(tmp_path / "u.csv", "index,attr_1,attr_2,utility\n1,1,1,1.5\n1,1,2,-1\n")
    with pytest.raises(Exception, match="not positive"):
        readers.utilities(spark, path).collect()
    path = put(tmp_path / "m.csv", ",yes,tie,no\nyes,0,1,35\nno,30 (29.5),2,3\n")
    cells = {(r["x_choice"], r["y_choice"]): r["value"] for r in readers.choice_counts(spark, path).collect()}
    assert cells[("yes", "no")] == 35 and cells[("no", "yes")] == pytest.approx(0.3)


def test_anchors_and_maps(spark, tmp_path):
    plain = put(tmp_path / "a.json", json.dumps({"1": "X", "2": None, "3": "Z"}))
    nested = put(tmp_path / "b.json", json.dumps({"anchors": {"1": {"pref": "Y", "p_x": 0.2}, "2": {"pref": None}}}))
    assert {r["case_id"]: r["pref"] for r in readers.anchors(spark, plain).collect()} == {1: "X", 2: None, 3: None}
    assert {r["case_id"]: r["pref"] for r in readers.anchors(spark, nested).collect()} == {1: "Y", 2: None}
    path = put(tmp_path / "d.json", json.dumps({"7": {"mean_delta": 0.5, "per_model": {"m": 1.0}}}))
    row = readers.json_map(spark, path, "mean_delta double, per_model map<string,double>").first()
    assert (row["key"], row["mean_delta"], row["per_model"]) == ("7", 0.5, {"m": 1.0})


def test_json_lines(spark, tmp_path):
    good = put(tmp_path / "g.jsonl", '{"id": "a", "correct": true}\n{"id": "b", "correct": false}\n')
    assert readers.json_lines(spark, good, "id string, correct boolean", ["id"]).count() == 2
    for bad in ('{"id": "a", "correct": true}\n{"id": "a", "correct": true}\n', '{"id": "a", "correct": 1}\n', "{not json\n"):
        with pytest.raises(Exception):
            readers.json_lines(spark, put(tmp_path / "b.jsonl", bad), "id string, correct boolean", ["id"]).collect()


def test_question_records(spark):
    rows = spark.createDataFrame([(0, "train", None, " q0 ", "#### 1"), (1, "test", None, " q1 ", "x\n#### 1,200"), (2, "", "own", "q2", "7.")], "at int, split string, id string, question string, answer string")
    got = [tuple(r) for r in readers.question_records(rows, "at").orderBy("question").collect()]
    assert got == [("test_00000", "q1", "1200"), ("own", "q2", "7")]


def test_states_and_logs(spark, tmp_path):
    path = put(tmp_path / "trainer_state.json", json.dumps({"log_history": [{"step": 10, "loss": 0.5}, {"step": 20, "loss": float("nan"), "kl": 1}, {"eval": 1}]}))
    rows = readers.trainer_states(spark, path).orderBy("pos").collect()
    assert [(r["step"], r["kl"]) for r in rows] == [(10, None), (20, 1.0), (None, None)]
    lines = spark.createDataFrame([("{'loss': '1.5', 'epoch': 0.5}",), (" 10%|#   | 10/200 [00:01<",), ("other",)], "value string")
    found = text_logs.steps_from_epochs(text_logs.metric_lines(lines, ("loss", "epoch")), lines, 2.0).collect()
    assert [(r["loss"], r["step"]) for r in found] == [(1.5, 50)]
    log = put(tmp_path / "run.log", "x {'train_runtime': 9.5, 'train_loss': 0.1, 'epoch': 1.0} y {'train_runtime': 7, 'train_loss': 0.2, 'epoch': 2.0}")
    assert tuple(text_logs.run_summary(spark, log, 1.0002).first()) == (9.5, 0.1)
    twice = put(tmp_path / "two.log", "{'train_runtime': 1, 'epoch': 1.0}\n{'train_runtime': 2, 'epoch': 1.0}")
    assert text_logs.run_summary(spark, twice, 1.0).count() == 0


def test_tensors(spark, tmp_path):
    values = np.array([1.5, -2.0, 3.25], dtype=np.float32)
    bf16 = (values.view(np.uint32) >> 16).astype("<u2").tobytes()
    head = json.dumps({"a": {"dtype": "F32", "shape": [3], "data_offsets": [0, 12]}, "b": {"dtype": "BF16", "shape": [1, 3], "data_offsets": [12, 18]}, "__metadata__": {}}).encode()
    (tmp_path / "m.tensors").write_bytes(struct.pack("<Q", len(head)) + head + values.tobytes() + bf16)
    rows = {r["name"]: (r["shape"], r["values"]) for r in readers.whole_tensors(spark, str(tmp_path / "m.tensors")).collect()}
    assert rows == {"a": ([3], values.tolist()), "b": ([1, 3], values.tolist())}


def test_markdown_and_frames(spark, tmp_path):
    path = put(tmp_path / "t.md", "# Title\n\n| a | b |\n|---|---|\n| 1 | x y |\n")
    assert [r["cells"] for r in readers.markdown_table(spark, path).orderBy("line").collect()] == [["a", "b"], ["1", "x y"]]
    rows = spark.createDataFrame([(0, "p0", "d"), (1, "n0", None), (2, "p1", "e"), (3, "n1", "e")], "row int, text string, domain string")
    assert sorted(map(tuple, readers.framing_pairs(rows).collect())) == [(0, "p0", "n0", "d"), (1, "p1", "n1", "e")]


def test_scored_resumes(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")

    def score(parts):
        for part in parts:
            part["answer"] = "No"
            yield part

    out = readers.scored(cases, spark.createDataFrame([(2,)], "case_id int"), ["case_id"], score, "case_id int, answer string")
    assert sorted(r["case_id"] for r in out.collect()) == [1, 3]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.1), (2, 1 / 3)], "k int, v double")
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == [("1", "0.10000000"), ("2", "0.33333333")]
    sinks.append_json(rows, str(tmp_path / "j"))
    sinks.append_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    put(tmp_path / "f.txt", "abc")
    row = sinks.manifest(spark, str(tmp_path / "f.txt")).first()
    assert row["bytes"] == 3 and row["sha256"].startswith("ba7816bf")
    assert sinks.markdown(rows.limit(1)) == "| k | v |\n|---|---|\n| 1 | 0.1 |"
    out = sinks.messages(spark.createDataFrame([("q", "a")], "p string, r string"), "s", "p", "r").first()["messages"]
    assert [(m["role"], m["content"]) for m in out] == [("system", "s"), ("user", "q"), ("assistant", "a")]
