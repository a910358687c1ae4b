import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from dyadics.llm import warc
from dyadics.llm.shared import fresh_path


def trip(spark, pages):
    path = fresh_path(spark, "archives")
    warc.write_archives(spark, warc.records(pages), path)
    return path, warc.read_archives(spark, path)


def brute(rows):
    out, last = [], {}
    for p, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            last[data] = max(p, last.get(data, p))
    for p, html in rows:
        data = (html or "").encode()
        first = last.get(data, p)
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if first == p else "revisit", None if first == p else first))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    long = "".join(f"<p>é{i}𝄞</p>\r\n\r\n" for i in range(4000))
    return [(1, "a" * 1000), (2, "a" * 1000), (9, "a" * 1000), (3, "a" * 999), (4, "a" * 999), (5, None), (6, ""), (7, long), (8, long), (10, "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40), (11, "0\r\n\r\n" * 5000)]


def test_odd_pages(spark, rows):
    pages = spark.createDataFrame([(p, None if p == 3 else f"http://x/{p}\r\nbad: 1", h, "clash") for p, h in rows], "page_id long, url string, html string, value string")
    path, got = trip(spark, pages)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == brute(rows)
    kinds = [f["warc-type"] for r in spark.read.format("binaryFile").load(f"{path}/*.gz").select("content").collect() for f, _ in warc.parse(io.BytesIO(gzip.decompress(r[0])))]
    assert kinds.count("continuation") > 3 and kinds.count("revisit") == 3


def test_pages(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    _, got = trip(spark, pages)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == brute([(r["page_id"], r["html"]) for r in pages.collect()])


def test_empty_table(spark):
    _, got = trip(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.count() == 0


def test_repeated_long_pages_and_null_ids(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    long, other = "é𝄞" * 20_000, "z" * 40_000
    rows = [(1, long), (1, long), (2, long), (2, long), (2, other), (3, other), (3, other), (None, other), (None, other), (None, "n" * 50_000), (None, "n" * 50_000), (None, None), (None, "s"), (4, "s"), (4, "s")]
    pages = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({warc.OP8_SQL})").fetchall(), key=str)
    path, got = trip(spark, pages)
    assert len(want) == len(rows)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want
    assert sorted(map(tuple, warc.op8_warc(spark, str(tmp_path)).select(*names).collect()), key=str) == want
    ids = [f["warc-record-id"] for r in spark.read.format("binaryFile").load(f"{path}/*.gz").select("content").collect() for f, _ in warc.parse(io.BytesIO(gzip.decompress(r[0])))]
    assert len(ids) == len(set(ids))


def test_lost_segment_is_named(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "b" * 60_000), (2, "u", "b" * 60_000), (3, "u", "c")], "page_id long, url string, html string")
    kept = warc.records(pages).where("value NOT LIKE '%WARC-Segment-Number: 3%'")
    path = str(tmp_path / "archives")
    warc.write_archives(spark, kept, path)
    rows = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert "missing" in rows[2]["problem"] and rows[2]["payload_digest"] is None
    assert rows[1]["problem"] == "no such response" and rows[1]["record_type"] == "revisit"
    assert rows[3]["problem"] is None and rows[3]["payload_bytes"] == 1


def record(name, block, kind="response", length=None, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "Content-Length": str(len(block) if length is None else length)} | more
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_damaged_and_foreign_records(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"good").digest()).decode()
    sound = record("a", http + b"good", **{"WARC-Payload-Digest": digest})
    parts = [
        record("info", b"software: x\r\n", "warcinfo"),
        sound,
        record("b", http + b"bad", **{"WARC-Payload-Digest": digest}),
        record("c", http + b"short", length=3),
        b"noise\r\nmore noise\r\n",
        record("d", http + b"after"),
        record("e", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"),
        record("f", b"", length="many"),
        record("g", http + b"last"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(sound.replace(b"<a>", b"<z>") * 2)[:-12])
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    fine = sorted((r["record_id"], r["payload_bytes"]) for r in rows if r["problem"] is None)
    assert ("<a>", 4) in fine and ("<d>", 5) in fine and ("<g>", 4) in fine and all(r["page_id"] is None for r in rows)
    problems = {r["record_id"]: r["problem"] for r in rows if r["problem"]}
    assert problems["<b>"] == "digest of the payload" and problems["<c>"] == "length of the block" and "chunk" in problems["<e>"] and problems["<f>"] == "incomplete header"
    assert any("compressed stream" in (r["problem"] or "") for r in rows)


def test_chunked_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.body_of(head + b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == b"abcde"
    assert warc.body_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError):
        warc.body_of(head + b"9\r\nabc\r\n0\r\n\r\n")


def test_bodies_are_not_exchanged(spark, small_dir):
    plan = warc.records(spark.read.parquet(f"{small_dir}/pages.parquet"), row=F.col("page_id"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert all("body" not in line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line)
