"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

A string of LENGTH bytes is repeated if it also starts anywhere else, in the same text or another. Of all suffixes those are
indexed that begin where the least hash of a LENGTH-long string's HEAD-byte grams stands; equal strings have theirs in
the same place, so they meet under the same head. A run of neighbouring strings that share this place is one entry: its
head, a digest of its body (all bytes of the run), where it starts, how many strings it has.

New texts come in batches. A batch's entries are sorted by head and body into a level; a scan of that level with all earlier
ones finds the heads that are not alone; levels of like size are then merged, so an entry is rewritten a logarithmic number of
times. Equal bodies are repeats as they stand. Different bodies under one head are cut from their texts, and suffix arrays
over these bytes, in tasks, tell which of their strings are equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, fresh_path, stored
from .text_arrays import chunks, mix

LENGTH, HEAD = 400, 96
#: Batches of the query; texts are dealt to them by digest.
BATCHES = 4
#: Bytes over which one suffix array is built. The bodies under one head that are more are told apart string by string.
ARRAY_BYTES = 500_000
CROWDED_BYTES = 1_000_000
_LOW = np.uint64((1 << 20) - 1)
ENTRY = "head long, body long, text binary, start int, many int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the HEAD bytes from each place on, by doubling from eight bytes."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = mix(np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))[: max(len(data) - 7, 0)])

    def joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
        n = max(min(len(a), len(b) - gap), 0)
        x = a[:n] * np.uint64(0xD6E8FEB86659FD93) + b[gap : gap + n]
        return x ^ (x >> np.uint64(29))

    sixteen = joined(eight, eight, 8)
    thirty_two = joined(sixteen, sixteen, 16)
    return mix(joined(joined(thirty_two, thirty_two, 32), thirty_two, 64))  # 32 + 32 + 32 bytes


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Head, first string, last string and text number of each run of strings with their least gram in the same place."""
    none = np.zeros(0, np.int64)
    strings = len(data) - LENGTH + 1
    if strings <= 0:
        return none.view(np.uint64), none, none, none
    # the place in the low bits breaks ties to the left; the head is the hash above them
    least = (gram_hashes(data) & ~_LOW) | (np.arange(len(data) - HEAD + 1, dtype=np.uint64) & _LOW)
    span, reach = LENGTH - HEAD + 1, 1
    while 2 * reach <= span:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    rest = span - reach
    least = np.minimum(least[: len(least) - rest], least[rest:])[:strings]
    inside = np.zeros(strings + 1, dtype=np.int8)
    size = np.diff(offsets)
    whole = np.flatnonzero(size >= LENGTH)
    np.add.at(inside, offsets[whole], 1)
    np.add.at(inside, offsets[whole + 1] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    same = np.zeros(strings + 1, dtype=bool)
    same[1:-1] = inside[1:] & inside[:-1] & (least[1:] == least[:-1])
    first, last = np.flatnonzero(inside & ~same[:-1]), np.flatnonzero(inside & ~same[1:])
    return mix(least[first] >> np.uint64(20)), first, last, np.searchsorted(offsets, first, side="right") - 1


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for part, data, offsets in chunks(batch):
            head, first, last, owner = entries(data, offsets)
            seen = memoryview(np.ascontiguousarray(data))
            body = b"".join([hashlib.blake2b(seen[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)])
            columns = [head.view(np.int64), np.frombuffer(body, dtype=np.int64), (first - offsets[owner]).astype(np.int32), (last - first + 1).astype(np.int32)]
            head, body, start, many = (pa.array(c) for c in columns)
            yield pa.RecordBatch.from_arrays([head, body, part.column(0).take(pa.array(owner)), start, many], names=["head", "body", "text", "start", "many"])


def ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of each place in the suffix array of ``data`` cut to ``length`` bytes (a multiple of 8), equal strings sharing theirs.

    Prefix doubling: places are sorted by eight bytes, then by pairs of ranks. Places less than ``length`` from the end have none.
    """
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    rank = np.unique(np.ndarray(len(data) + 1, dtype=">u8", buffer=padded, strides=(1,))[: max(len(data) - 7, 0)].astype(np.uint64), return_inverse=True)[1]
    known = 8
    while known < length:
        step = min(known, length - known)
        n = max(len(rank) - step, 0)
        rank = np.unique((rank[:n].astype(np.uint64) << np.uint64(32)) | rank[step : step + n].astype(np.uint64), return_inverse=True)[1]
        known += step
    return rank


def repeated(bodies: list[bytes], counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs (first, last) of the strings of each body that stand in another place too; ``counts``: places of each body."""
    size = np.array([len(b) for b in bodies])
    begins = np.cumsum(size) - size
    rank = ranks(np.frombuffer(b"".join(bodies), dtype=np.uint8))
    strings = size - LENGTH + 1
    at = np.arange(int(strings.sum())) + np.repeat(begins - np.r_[0, np.cumsum(strings)[:-1]], strings)
    many = np.bincount(rank[at], weights=np.repeat(counts, strings))
    hit = many[rank[at]] > 1
    ends = np.cumsum(strings)
    return [_runs(hit[b - n : b]) for b, n in zip(ends.tolist(), strings.tolist(), strict=True)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats within heads, of rows (head, body, places, bytes) sorted by head; whole heads share a suffix array."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        spans = repeated([r[3] for r in rows], np.array([r[2] for r in rows]))
        flat = [(r[0], r[1], a, b) for r, own in zip(rows, spans, strict=True) for a, b in own]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [()] * 4, kinds, strict=True)], names=["head", "body", "first", "last"])

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= ARRAY_BYTES and row[0] != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield done(rows)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each string of each body."""
    import hashlib

    for batch in batches:
        for head, body, places, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(data) - LENGTH + 1
            digest = [hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([head] * n), pa.array([body] * n), pa.array(range(n), pa.int32()), pa.array([places] * n), pa.array(digest, pa.binary())], names=["head", "body", "at", "places", "string"])


def _alone(crowded: DataFrame) -> DataFrame:
    """head, body, first, last for bodies under crowded heads: strings are counted wherever they stand, combined before the
    exchange. One that stands once names its place, so the others are the repeated ones without a join."""
    each = crowded.mapInArrow(_strings, "head long, body long, at int, places long, string binary")
    once = each.groupBy("string").agg(F.sum("places").alias("places"), F.min(F.struct("head", "body", "at")).alias("of")).where("places = 1")
    alone = once.groupBy("of.head", "of.body").agg(F.array_sort(F.collect_list("of.at")).alias("alone"))  # of one body: LENGTH at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = []
            for head, body, many, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit = np.ones(many, dtype=bool)
                hit[own or []] = False
                flat += [(head, body, a, b) for a, b in _runs(hit)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else [()] * 4, kinds, strict=True)], names=["head", "body", "first", "last"])

    bodies = crowded.select("head", "body", (F.octet_length("bytes") - LENGTH + 1).alias("many"))
    return bodies.join(alone, ["head", "body"], "left").select("head", "body", "many", "alone").mapInArrow(run, "head long, body long, first int, last int")


class Levels:
    """The index. ``add`` takes batches of (digest, value) texts; ``spans`` gives what is repeated among all of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        #: (entries, table, path), the oldest and largest first
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.places: list[DataFrame] = []
        self.met: list[DataFrame] = []

    def add(self, texts: DataFrame) -> None:
        """Indexes a batch and notes the heads that its entries share with each other or with earlier ones."""
        places = stored(texts.select("digest", F.col("value").alias("text")).mapInArrow(_entries, ENTRY), "places")
        self.places.append(places)
        self._push(self._sorted(places.select("head", "body", F.lit(1).cast("long").alias("places"), F.struct("text", "start").alias("at"), "many")))
        seen = [t.select("head", "places", F.lit(k == len(self.levels) - 1).alias("new")) for k, (_, t, _) in enumerate(self.levels)]
        scan = reduce(DataFrame.unionByName, seen).groupBy("head").agg(F.sum("places").alias("places"), F.bool_or("new").alias("new"))
        self.met.append(stored(scan.where("new AND places > 1").select("head"), "heads"))
        while len(self.levels) > 1 and self.levels[-2][0] <= 2 * self.levels[-1][0]:
            (_, one, a), (_, two, b) = self.levels[-2:]
            del self.levels[-2:]
            self._push(self._sorted(one.unionByName(two)))
            discard(self.spark, a, b)

    def _sorted(self, rows: DataFrame) -> DataFrame:
        classes = rows.groupBy("head", "body").agg(F.sum("places").alias("places"), F.min("at").alias("at"), F.first("many").alias("many"))
        return classes.sortWithinPartitions("head", "body")

    def _push(self, rows: DataFrame) -> None:
        path = fresh_path(self.spark, "level")
        rows.write.parquet(path)
        table = self.spark.read.schema(rows.schema).parquet(path)
        self.levels.append((table.count(), table, path))

    def spans(self, texts: DataFrame) -> DataFrame:
        """digest, spans (start, stop in bytes; unordered, they may overlap) of the texts with repeated strings."""
        met = reduce(DataFrame.unionByName, self.met).distinct()
        own = self._sorted(reduce(DataFrame.unionByName, [t for _, t, _ in self.levels])) if len(self.levels) > 1 else self.levels[0][1]
        classes = stored(own.join(met, "head", "left_semi"), "classes")
        whole = classes.where("places > 1").select("head", "body", F.lit(0).alias("first"), (F.col("many") - 1).alias("last"))
        kinds = classes.groupBy("head").agg(F.count("*").alias("kinds"), F.sum(F.col("many") + LENGTH - 1).alias("bytes")).where("kinds > 1")
        open_ = classes.join(kinds, "head").select("head", "body", "places", "many", F.col("at.text").alias("digest"), F.col("at.start").alias("start"), (F.col("bytes") > CROWDED_BYTES).alias("crowded"))
        cut = open_.join(texts.select("digest", "value"), "digest").selectExpr("head", "body", "places", "crowded", f"substring(cast(value AS binary), start + 1, many + {LENGTH - 1}) AS bytes")
        cut = stored(cut, "bodies")
        fine = cut.where("NOT crowded").select("head", "body", "places", "bytes").repartition("head").sortWithinPartitions("head").mapInArrow(_told_apart, "head long, body long, first int, last int")
        found = whole.unionByName(fine)
        crowded = cut.where("crowded").select("head", "body", "places", "bytes")
        if not crowded.isEmpty():
            found = found.unionByName(_alone(crowded.repartition("head", "body")))
        found = stored(found.distinct(), "repeats")
        hit = reduce(DataFrame.unionByName, self.places).join(found, ["head", "body"])
        hit = hit.select(F.col("text").alias("digest"), F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + LENGTH).alias("stop")).alias("span"))
        return hit.groupBy("digest").agg(F.collect_list("span").alias("spans"))  # of one text: as many as it has entries, about


def removal(value: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes and maximal runs removed, and what is left of the bytes."""
    cover = np.zeros(len(value) + 1, dtype=np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, stops, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return int(gone.sum()), len(_runs(gone)), value[~gone].tobytes()


def _remover(keep_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            values, copies, spans = batch.column(1).cast(pa.large_binary()), batch.column(2).to_numpy(), batch.column(3)
            at = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
            data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
            size = pa.compute.list_value_length(spans).fill_null(0).to_numpy()
            ends = np.cumsum(size)
            starts, stops = (spans.flatten().field(k).to_numpy() for k in (0, 1))
            out = []
            for i, (n, end) in enumerate(zip(size.tolist(), ends.tolist(), strict=True)):
                value = data[at[i] : at[i + 1]]
                whole = copies[i] > 1
                removed, runs, left = removal(value, np.array([0]) if whole else starts[end - n : end], np.array([len(value)]) if whole else stops[end - n : end])
                out.append((removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if keep_texts else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["digest", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def whole_texts(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """digest, value, copies, batch of each different text of LENGTH bytes or more, in buckets by digest.

    Equal texts are combined before the exchange. Later joins by digest exchange no text, as the buckets lie together.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("value")).where(F.octet_length("value") >= LENGTH)
    texts = texts.groupBy(_digest(F.sha2("value", 256)).alias("digest")).agg(F.first("value").alias("value"), F.count("*").alias("copies"))
    texts = texts.withColumn("batch", F.pmod(F.xxhash64("digest"), F.lit(batches)).cast("int"))
    name = f"dyadics_texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.partitionBy("batch").bucketBy(parts, "digest").sortBy("digest").option("path", fresh_path(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def _digest(sha: F.Column) -> F.Column:
    return F.substring(F.unhex(sha), 1, 16)


def dedup(docs: DataFrame, batches: int = BATCHES, keep_texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text of each row of ``docs``.

    Null texts are empty; texts shorter than LENGTH bytes stay whole. Rows that repeat a text lose all of it, as each of its
    strings stands elsewhere too. ``kept_text`` is null where nothing goes (and without ``keep_texts``); bytes of a character cut in two become U+FFFD in it, while
    the digest is of the bytes as they are. Rows with a null doc_id are rows like others; other columns are ignored.
    """
    texts = whole_texts(docs, batches)
    index = Levels(docs.sparkSession)
    for k in range(batches):
        index.add(texts.where(F.col("batch") == k))
    spans = stored(index.spans(texts), "spans")
    gone = texts.select("digest", F.col("value").cast("binary").alias("value"), "copies").join(spans, "digest", "left").where("copies > 1 OR spans IS NOT NULL")
    gone = stored(gone.mapInArrow(_remover(keep_texts), "digest binary, n_removed long, n_spans long, kept_sha256 string, kept_text string"), "removed")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), sha.alias("sha")).withColumn("digest", _digest(F.col("sha")))
    out = rows.join(gone, "digest", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_texts=False).drop("kept_text")
