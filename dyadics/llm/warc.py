"""WARC archives: records written through Spark's text sink, and read back with segments reassembled.

A page's payload is the body of an HTTP response in chunked transfer framing. Of pages with equal payloads of
REVISIT_BYTES or more, those with the greatest page_id are ``response`` records; the others are ``revisit`` records
that refer to one of them and carry no body. A block longer than SEGMENT_CHARS is cut into a first record and ``continuation``
records that name it as their origin; the last one states the total length.

A record is one row of a text table whose line separator is the blank lines that end a WARC record, so the files are
plain archives and the sink's commit protocol covers them. Reading goes through the compressed stream record by record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, small, stored

REVISIT_BYTES = 1_000
#: Characters of a record's block; a longer block is segmented.
SEGMENT_CHARS = 16_000
#: Characters of each chunk of the transfer framing.
CHUNK_CHARS = 4_096
#: Characters of records that one archive file may hold, before compression.
FILE_CHARS = 64_000_000
NEWLINE = "\r\n"
#: The fields and profile of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = NEWLINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", "Transfer-Encoding: chunked", "", ""])


def _record_id(name: Column) -> Column:
    """A URN from any name: the hash laid out as a UUID."""
    h = F.md5(name.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _chunked(body: Column) -> Column:
    """``body`` in chunked transfer framing; chunks end between code points."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(body), F.lit(1)), F.lit(CHUNK_CHARS))

    def chunk(at: Column) -> Column:
        part = F.substring(body, at, F.lit(CHUNK_CHARS))
        return F.when(F.octet_length(part) == 0, "").otherwise(F.concat(F.lower(F.hex(F.octet_length(part))), F.lit(NEWLINE), part, F.lit(NEWLINE)))

    return F.concat(F.array_join(F.transform(starts, chunk), ""), F.lit("0" + NEWLINE * 2))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """A record's header; fields whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in pairs]
    return F.concat(F.concat_ws(NEWLINE, F.lit(VERSION), *lines), F.lit(NEWLINE * 2))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", row: Column | None = None) -> DataFrame:
    """``value``: the text of each record, in header and block, without the blank lines that end it.

    A null payload is empty; a null url is written as ``about:blank``. A row with a null page_id is a response without a
    WARC-Page-ID. Records are named by page_id and ``row``, so rows that repeat a page_id are records of their own.
    ``row`` must differ between rows and be the same whenever they are read; without it the rows are numbered and stored.
    """
    columns = (F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("about:blank")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    if row is None:
        rows = stored(pages.select(*columns, F.monotonically_increasing_id().cast("string").alias("row")), "pages")
    else:
        rows = pages.select(*columns, row.cast("string").alias("row"))
    rows = rows.withColumn("bytes", F.octet_length("body")).withColumn("digest", F.sha1(F.encode("body", "UTF-8")))
    equal = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("many")).where("many > 1")
    # narrow rows tell which pages revisit; only those lose their bodies, and while they are within the bound no body is exchanged
    again = stored(rows.select("page_id", "digest", "bytes").join(equal.select("digest", "bytes", "first"), ["digest", "bytes"]).where("page_id != first.page_id").select("page_id", "digest", "first").distinct(), "revisits")
    rows = rows.join(small(again, again.count()), ["page_id", "digest"], "left")

    def full(number: Column, row: Column) -> Column:
        return F.concat(F.lit("page "), F.coalesce(number.cast("string"), F.lit("without id")), F.lit(" row "), row)

    full_name = full(F.col("page_id"), F.col("row"))
    name = _record_id(full_name)
    date = F.lit("2024-01-01T00:00:00Z")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    page = F.col("page_id").cast("string")
    revisit = F.concat(
        _fields(
            ("WARC-Type", F.lit("revisit")),
            ("WARC-Record-ID", name),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
            ("WARC-Page-ID", page),
            ("WARC-Profile", F.lit(PROFILE)),
            ("WARC-Refers-To", _record_id(full(F.col("first.page_id"), F.col("first.row")))),
            ("WARC-Payload-Digest", digest),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.lit("0")),
        )
    )
    block = F.concat(F.lit(HTTP_HEAD), _chunked(F.col("body")))
    whole = rows.withColumn("block", F.when(F.col("first").isNull(), block).otherwise("")).drop("body")
    whole = whole.withColumn("parts", F.greatest(F.ceil(F.char_length("block") / SEGMENT_CHARS).cast("int"), F.lit(1)))
    parts = whole.select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("number"))
    part = F.substring("block", (F.col("number") - 1) * SEGMENT_CHARS + 1, F.lit(SEGMENT_CHARS))
    one, many = F.col("number") == 1, F.col("parts") > 1
    segment_name = F.when(one, name).otherwise(_record_id(F.concat(full_name, F.lit(" segment "), F.col("number").cast("string"))))
    response = F.concat(
        _fields(
            ("WARC-Type", F.when(one, "response").otherwise("continuation")),
            ("WARC-Record-ID", segment_name),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
            ("WARC-Page-ID", F.when(one, page)),
            ("WARC-Payload-Digest", F.when(one, digest)),
            ("WARC-Segment-Number", F.when(many, F.col("number").cast("string"))),
            ("WARC-Segment-Origin-ID", F.when(~one, name)),
            ("WARC-Segment-Total-Length", F.when(many & (F.col("number") == F.col("parts")), F.octet_length("block").cast("string"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length("part").cast("string")),
        ),
        F.col("part"),
    )
    return parts.withColumn("part", part).select(F.when(F.col("first").isNull(), response).otherwise(revisit).alias("value"))


def write_archives(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes records as gzip-compressed archives below ``path``; a file holds FILE_CHARS or a little more at most."""
    # the records' mean length is known from what they are cut to: SEGMENT_CHARS and a header
    most = max(1, FILE_CHARS // (SEGMENT_CHARS + 1_000))
    rows.write.option("lineSep", NEWLINE * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)


class Damaged(ValueError):
    """A record that is not as its header says."""


def parse(stream) -> Iterator[tuple[dict[str, str], bytes | Damaged]]:
    """(fields by lower-case name, block) of each record of a stream of bytes, read record by record.

    A damaged record comes as what is known of its fields and the fault; reading goes on at the next line that begins a record.
    """
    line, lost = stream.readline(), False
    while line:
        if not line.startswith(b"WARC/1."):
            if line.strip() and not lost:
                yield {}, Damaged("bytes between records")
                lost = True
            line = stream.readline()
            continue
        lost, fields, end = False, {}, False
        while line := stream.readline():
            text = line.decode("utf-8", "replace").rstrip(NEWLINE)
            if not text:
                end = True
                break
            key, colon, value = text.partition(":")
            if colon:
                fields[key.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not end or not size.isdigit() or "warc-type" not in fields or "warc-record-id" not in fields:
            yield fields, Damaged("incomplete header")
            line = stream.readline()
            continue
        block = stream.read(int(size))
        tail = stream.readline() + stream.readline()
        if len(block) != int(size) or tail != b"\r\n\r\n":
            yield fields, Damaged("length of the block")
            # the next record may begin within what was taken for the block, but is sought after it
            line = tail[tail.index(b"WARC/1.") :] if b"WARC/1." in tail else stream.readline()
            continue
        yield fields, block
        line = stream.readline()


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP response: its body, taken out of the chunked framing if it has one."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            raise Damaged("framing of a chunk")
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if len(out[-1]) != size or body[at : at + 2] != b"\r\n":
            raise Damaged("length of a chunk")
        at += 2


def _hex_sha1(stated: str) -> str:
    value = stated.partition(":")[2] or stated
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


_READ = "kind string, id string, page_id long, refers string, stated string, bytes long, digest string, origin string, number int, total long, block binary, problem string"


def _number(text: str | None) -> int | None:
    return int(text) if text and text.removeprefix("-").isdigit() else None


def _row(fields: dict[str, str], block: bytes | Damaged) -> tuple:
    kind, name = fields.get("warc-type"), fields.get("warc-record-id")
    number, page = _number(fields.get("warc-segment-number")) or 0, _number(fields.get("warc-page-id"))
    stated = size = digest = problem = None
    try:
        stated = _hex_sha1(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None
        if isinstance(block, Damaged):
            raise block
        if kind == "response" and not number:
            payload = body_of(block)
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    except ValueError as fault:
        problem = str(fault) or "damaged"
    origin = fields.get("warc-segment-origin-id", name) if number else None
    kept = block if number and not problem else None
    return kind, name, page, fields.get("warc-refers-to"), stated, size, digest, origin, number, _number(fields.get("warc-segment-total-length")), kept, problem


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, problem of each response and revisit below ``path``.

    Unsegmented records are decoded where they are read, one at a time, from the compressed stream. Segments meet by
    origin id, are ordered by number, must be complete and of the stated total length. A payload must have the digest that
    its record states. A revisit's length is that of the response it refers to. A record for which this does not hold has
    ``problem`` set and no payload columns; it does not touch the others. Foreign archives have no page_id; record_id
    names their records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [x.split()[0] for x in _READ.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _READ.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 16)
                try:
                    for fields, block in parse(stream):
                        rows.append(_row(fields, block))
                        held += len(block) if isinstance(block, bytes) else 0
                        if len(rows) == 500 or held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                except (EOFError, OSError, zlib.error) as fault:
                    rows.append(_row({}, Damaged(f"compressed stream: {fault}")))
                yield batch_of(rows)

    def join(group: pa.Table) -> pa.Table:
        parts = sorted(group.to_pylist(), key=lambda r: r["number"])
        first, last = parts[0], parts[-1]
        try:
            if any(p["problem"] for p in parts):
                raise Damaged("a damaged segment")
            block = b"".join(p["block"] for p in parts)
            if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or last["total"] != len(block):
                raise Damaged("segments are missing, repeated or of another total length")
            payload = body_of(block)
            first |= {"bytes": len(payload), "digest": hashlib.sha1(payload).hexdigest()}
        except ValueError as fault:
            first["problem"] = str(fault)
        return pa.Table.from_pylist([first | {"block": None}], arrow)

    parsed = stored(files.mapInArrow(read, _READ), "warc-records")
    joined = parsed.where("number > 0 AND origin IS NOT NULL").groupBy("origin").applyInArrow(join, _READ)
    lone = parsed.where("kind = 'response' AND number = 0").unionByName(joined)
    other = parsed.where("kind IS NULL OR (kind NOT IN ('response', 'revisit') AND problem IS NOT NULL AND number = 0) OR (number > 0 AND origin IS NULL)")
    wrong = F.when(F.col("stated").isNotNull() & (F.col("stated") != F.col("digest")), "digest of the payload")
    responses = lone.withColumn("problem", F.coalesce("problem", wrong))
    fine = F.col("problem").isNull()
    # of records with one id, which a sound archive does not have, the least payload counts for those that refer to it
    referred = responses.where(fine).groupBy(F.col("id").alias("refers")).agg(F.min(F.struct("digest", "bytes", F.col("page_id").alias("refers_to"))).alias("_r")).select("refers", "_r.*")
    again = parsed.where("kind = 'revisit'").drop("bytes", "digest").join(referred, "refers", "left")
    lost = F.when(F.col("digest").isNull(), "no such response").when(F.col("digest") != F.col("stated"), "digest of the response")
    again = again.withColumn("problem", F.coalesce("problem", lost))

    def out(rows: DataFrame, kind: str, refers: Column) -> DataFrame:
        sound = lambda c: F.when(fine, c)
        return rows.select("page_id", sound(F.col("bytes")).alias("payload_bytes"), sound(F.col("digest")).alias("payload_digest"), F.lit(kind).alias("record_type"), sound(refers).alias("refers_to"), F.col("id").alias("record_id"), "problem")

    none = F.lit(None).cast("long")
    return out(responses, "response", none).unionByName(out(again, "revisit", F.col("refers_to"))).unionByName(out(other, "unknown", none))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    # a row's file and its place there name it in every scan, so that nothing needs to be stored
    row = F.concat(F.col("_metadata.file_path"), F.lit(":"), F.col("_metadata.row_index").cast("string"))
    write_archives(spark, records(spark.read.parquet(f"{sf_dir}/pages.parquet"), row=row), path)
    rows = read_archives(spark, path)
    # archives written just now have to be whole
    whole = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", F.col("problem"), F.lit("of"), F.col("record_id"))))
    return rows.withColumn("record_type", whole).drop("record_id", "problem")


OP8_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m
"""
