import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadics.sources import readers, sinks
from dyadics.sources.tensor_files import SCHEMA, TensorReader, head


def put(path, tensors):
    at, info, body = 0, {}, b""
    for name, dtype, shape, raw in tensors:
        info[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at, body = at + len(raw), body + raw
    text = json.dumps(info | {"__metadata__": {"k": "v"}}).encode()
    path.write_bytes(struct.pack("<Q", len(text)) + text + body)
    return str(path)


@pytest.fixture
def file(tmp_path):
    wide = np.arange(1000 * 6, dtype="<f4").reshape(1000, 6)
    half = np.array([1.5, -2.0, 3.25], "<f4")
    rows = [("m.wide", "F32", [1000, 6], wide.tobytes()), ("m.half", "BF16", [3], (half.view("<u4") >> 16).astype("<u2").tobytes()), ("n.ints", "I64", [2, 2], np.array([1, -2, 3, 4], "<i8").tobytes()), ("n.none", "F64", [0, 4], b""), ("n.one", "F16", [], np.array(0.5, "<f2").tobytes())]
    return put(tmp_path / "a.tensors", rows), wide


def test_slices_are_partitions_of_whole_rows(spark, file):
    path, wide = file
    rows = readers.tensors(spark, path, slice_bytes=100 * 24 + 5)
    assert rows.rdd.getNumPartitions() == 10 + 4
    got = sorted((r["start"], r["values"]) for r in rows.where("name = 'm.wide'").collect())
    assert [a for a, _ in got] == list(range(0, 6000, 600)) and sum((v for _, v in got), []) == wide.ravel().tolist()
    other = {r["name"]: (r["dtype"], r["shape"], r["values"]) for r in rows.where("name != 'm.wide'").collect()}
    assert other == {"m.half": ("BF16", [3], [1.5, -2.0, 3.25]), "n.ints": ("I64", [2, 2], [1, -2, 3, 4]), "n.none": ("F64", [0, 4], []), "n.one": ("F16", [], [0.5])}


def test_names_and_columns_are_the_sources(spark, file):
    path, _ = file
    for rule, names in (("name = 'n.ints'", {"n.ints"}), ("name IN ('n.ints', 'm.half', 'x')", {"n.ints", "m.half"}), ("name LIKE 'n.%'", {"n.ints", "n.none", "n.one"}), ("name LIKE 'n.%' AND start = 0 AND dtype = 'F16'", {"n.one"})):
        rows = readers.tensors(spark, path).where(rule)
        assert {r["name"] for r in rows.collect()} == names
    assert readers.tensors(spark, path, slice_bytes=600).where("name = 'n.ints'").rdd.getNumPartitions() == 1
    narrow = readers.tensors(spark, path, "name string, shape array<long>")
    assert narrow.columns == ["name", "shape"] and narrow.count() == 5
    exact = readers.tensors(spark, path, "name string, values array<double>").where("name = 'n.ints'").first()
    assert exact["values"] == [1.0, -2.0, 3.0, 4.0]


def test_numbers_are_not_read_unless_asked_for(spark, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    path = put(tmp_path / "b.tensors", [("x", "F32", [4], b"\0" * 16)])
    reader = TensorReader(_parse_datatype_string("name string, start long"), {"path": path, "slicebytes": "8"})
    parts = reader.partitions()
    (tmp_path / "b.tensors").write_bytes(b"")  # nothing is left to read
    assert [b.to_pylist() for p in parts for b in reader.read(p)] == [[{"name": "x", "start": 0}]]
    assert "values" in SCHEMA


@pytest.mark.parametrize("info", [{"dtype": "F32", "shape": [5], "data_offsets": [0, 16]}, {"dtype": "F32", "shape": [4], "data_offsets": [8, 24]}, {"dtype": "Q7", "shape": [4], "data_offsets": [0, 16]}])
def test_damaged_heads_are_named(tmp_path, info):
    text = json.dumps({"x": info}).encode()
    (tmp_path / "c.tensors").write_bytes(struct.pack("<Q", len(text)) + text + b"\0" * 16)
    with pytest.raises(ValueError, match="c.tensors"):
        head(str(tmp_path / "c.tensors"))
    (tmp_path / "c.tensors").write_bytes(struct.pack("<Q", 10**9))
    with pytest.raises(ValueError, match="c.tensors"):
        head(str(tmp_path / "c.tensors"))


def test_what_is_written_is_read(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("t"), "id").alias("name"), F.when(F.col("id") % 2 == 0, "F32").otherwise("BF16").alias("dtype"), F.array(F.col("id"), F.lit(2)).alias("shape"), F.expr("transform(sequence(1, int(id) * 2), x -> float(x) / 4)").alias("values"))
    rows = rows.withColumn("values", F.when(F.col("name") == "t0", F.array().cast("array<float>")).otherwise(F.col("values")))
    path = str(tmp_path / "out")
    sinks.write_tensors(rows.repartition(3), path, file_bytes=500)
    files = [f for f in (tmp_path / "out").iterdir()]
    assert len(files) > 3 and all(f.suffix == ".tensors" for f in files)
    got = sorted((r["name"], r["dtype"], r["shape"], r["values"]) for r in readers.whole_tensors(spark, path).collect())
    assert got == sorted((r["name"], r["dtype"], r["shape"], r["values"]) for r in rows.collect())
    sinks.write_tensors(rows.limit(2), path)
    assert readers.tensors(spark, path, "name string").distinct().count() == 2
    sinks.write_tensors(rows.where("name = 't9'"), path, mode="append")
    assert {r["name"] for r in readers.tensors(spark, path).collect()} == {"t0", "t1", "t9"}
    with pytest.raises(Exception, match="values for the shape"):
        sinks.write_tensors(rows.withColumn("shape", F.array(F.lit(7))), path)
    assert {r["name"] for r in readers.tensors(spark, path).collect()} == {"t0", "t1", "t9"}  # all or none
    assert not [f for f in (tmp_path / "out").iterdir() if f.is_dir()]


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        readers.tensors(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "empty").mkdir()
    assert readers.tensors(spark, str(tmp_path / "empty")).count() == 0
