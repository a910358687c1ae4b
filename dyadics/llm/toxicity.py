"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A window of WINDOW words is the bag of its words and their byte n-grams (with word ends), each hashed to a bucket
with an embedding; their mean goes through a linear softmax. Embeddings and softmax are trained jointly. A text's score
is that of its most toxic window, so a few words count alike in short and long texts. Training sees labels of whole
texts only: it starts from the windows drawn of a text, then goes on with the one that scores highest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text_arrays import LOWER, bounds, chunks, hashes, mix, words

WINDOW = 8
GRAMS = (3, 5, 7)
BUCKETS = 1 << 18
DIM = 8
#: The bounded sample: so many labelled rows of each class, the first by a hash of doc_id. A text whose windows make up more
#: than so many bytes is trained on windows drawn from all over it, and no word of theirs counts beyond so many bytes.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES, SAMPLE_WORD_BYTES = 1_500, 8_192, 64
#: A gram of fewer sampled texts has no embedding; a window counts as so many grams at least.
LEAST_TEXTS, LEAST_GRAMS = 4, 130
#: Passes over the highest windows after the first one over all windows; of fewer texts more, up to so many steps.
PASSES, STEPS, RATE, INIT = 12, 80_000, 0.4, 0.01
HELD_OUT_OF, HELD_OUT = 4, 2
THRESHOLD = 0.3
SEED = 9


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, window number of each, and the text number of each window, windows in text order."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = bounds(owner, len(offsets) - 1)
    within = (np.arange(len(starts)) - first[owner]) // WINDOW
    opens = np.r_[True, (owner[1:] != owner[:-1]) | (within[1:] != within[:-1])]
    window = np.cumsum(opens) - 1  # of each word
    text = owner[opens]
    # a word that its window repeats counts once
    value = hashes(data, starts, ends)
    order = np.lexsort((value, window))
    keep = np.ones(len(order), dtype=bool)
    keep[order[1:]] = (value[order[1:]] != value[order[:-1]]) | (window[order[1:]] != window[order[:-1]])
    starts, ends, window, value = starts[keep], ends[keep], window[keep], value[keep]
    # the words with one space before and after, one after the other
    sizes = ends - starts + 2
    begins = np.cumsum(sizes) - sizes
    laid = np.full(int(sizes.sum()), 32, dtype=np.uint8)
    inner = np.arange(len(laid)) - np.repeat(begins, sizes)
    body = (inner > 0) & (inner < np.repeat(sizes, sizes) - 1)
    laid[body] = data[np.repeat(starts - begins - 1, sizes)[body] + np.flatnonzero(body)]
    of = np.repeat(window, sizes)
    word = np.repeat(np.arange(len(starts)), sizes)
    values, owners = [(value >> np.uint64(46)).astype(np.int64)], [window]
    wide = laid.astype(np.uint64) + np.uint64(1)
    for n in GRAMS:
        if len(laid) < n:
            continue
        code = np.zeros(len(laid) - n + 1, dtype=np.uint64)
        for j in range(n):
            code = code * np.uint64(0x100000001B3) + wide[j : len(laid) - n + 1 + j]
        fits = np.flatnonzero(word[: len(code)] == word[n - 1 :])
        values.append((mix(code[fits] + np.uint64(n)) >> np.uint64(46)).astype(np.int64))
        owners.append(of[fits])
    value, at = np.concatenate(values), np.concatenate(owners)
    return value & (BUCKETS - 1), at, text


def window_scores(table: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The greatest window probability of each text; the bias alone for a text without words."""
    value, window, text = grams(data, offsets)
    best = np.full(len(offsets) - 1, -np.inf)
    if len(text):
        total = np.bincount(window, weights=table[value], minlength=len(text))
        mean = total / np.maximum(np.bincount(window, minlength=len(text)), LEAST_GRAMS)
        np.maximum.at(best, text, mean)
    best[np.isneginf(best)] = 0.0
    return 1 / (1 + np.exp(-np.clip(best + bias, -40, 40)))


def _as_text(texts: list[str] | list[bytes]) -> pa.Array:
    """Bytes go as they are: a word cut within a character is no UTF-8."""
    return pa.array(texts, pa.large_binary()).view(pa.large_string()) if isinstance(texts[0], bytes) else pa.array(texts)


def train(texts: list[str] | list[bytes], labels: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, float]:
    """A score for each bucket (embedding times softmax weights, toxic minus clean) and the bias."""
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        return np.zeros(BUCKETS, np.float32), float(np.log((share * len(texts) + 1) / ((1 - share) * len(texts) + 1)))
    bags, sizes, of, seen, many_texts = [], [], [], 0, np.zeros(BUCKETS, np.int32)
    for _, data, offsets in chunks(pa.RecordBatch.from_arrays([_as_text(texts)], names=["text"])):
        value, window, text = grams(data, offsets)
        order = np.argsort(window, kind="stable")
        in_text = np.unique(value[order] * len(offsets) + text[window[order]]) // len(offsets)
        many_texts += np.bincount(in_text, minlength=BUCKETS).astype(np.int32)
        bags.append(value[order].astype(np.int32))
        sizes.append(np.bincount(window, minlength=len(text)).astype(np.int32))
        of.append((seen + text).astype(np.int32))
        seen += len(offsets) - 1
    # grams of too few texts tell nothing of others; they stay at zero
    known = many_texts >= LEAST_TEXTS
    kept = [np.add.reduceat(known[b], np.r_[0, np.cumsum(s)[:-1]], dtype=np.int64) if len(s) else s for b, s in zip(bags, sizes, strict=True)]
    flat = np.concatenate([b[known[b]] for b in bags])
    del bags
    size, of = np.maximum(np.concatenate(sizes), LEAST_GRAMS).astype(np.float32), np.concatenate(of)
    ends = np.r_[0, np.cumsum(np.concatenate(kept))]
    draw = np.random.default_rng(seed)
    embedding = draw.uniform(-INIT, INIT, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = draw.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)

    def epoch(chosen: np.ndarray, rate: float) -> None:
        """Gradient steps, one bag at a time; a gram's step does not shrink with the size of its bag."""
        for i in draw.permutation(chosen):
            ids = flat[ends[i] : ends[i + 1]]
            own = embedding[ids]
            hidden = own.sum(axis=0) / size[i]
            z = hidden @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[of[i]])] -= 1
            back = weight @ p
            weight[:] -= rate * np.outer(hidden, p)
            bias[:] -= 0.1 * rate * p
            embedding[ids] = own - rate * back

    def highest() -> np.ndarray:
        table = embedding @ (weight[:, 1] - weight[:, 0])
        value = np.zeros(len(size))
        for a in range(0, len(size), 10_000):
            b = min(a + 10_000, len(size))
            total = np.r_[0.0, np.cumsum(table[flat[ends[a] : ends[b]]], dtype=np.float64)]
            value[a:b] = np.diff(total[ends[a : b + 1] - ends[a]]) / size[a:b]
        order = np.lexsort((-value, of))
        return order[np.r_[True, of[order][1:] != of[order][:-1]]]

    everything = np.arange(len(size))
    clean = everything[labels[of] == 0]
    epoch(everything, RATE)
    rounds = max(PASSES, STEPS // (2 * len(texts)))
    for k in range(rounds):
        top = highest()
        epoch(np.r_[top, draw.choice(clean, min(len(clean), len(top)), replace=False)], RATE * (1 - k / rounds))
    return np.where(known, embedding @ (weight[:, 1] - weight[:, 0]), 0).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def drawn(data: np.ndarray, offsets: np.ndarray, most: int = SAMPLE_TEXT_BYTES) -> list[bytes]:
    """The windows of each text that training sees, in their order. A text of at most ``most`` bytes keeps them all; of a
    longer one, windows are drawn by a hash of their number until the next would pass the bound."""
    starts, ends, owner = words(data, offsets)
    ends = np.minimum(ends, starts + SAMPLE_WORD_BYTES)
    first, out = bounds(owner, len(offsets) - 1), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        opens = np.arange(a, b, WINDOW)
        size = np.add.reduceat(ends[a:b] - starts[a:b] + 1, opens - a) if b > a else np.zeros(0, np.int64)
        order = np.argsort(mix(np.arange(len(size), dtype=np.uint64)), kind="stable") if size.sum() > most else np.arange(len(size))
        chosen = np.sort(order[np.cumsum(size[order]) <= most])
        out.append(b" ".join(data[starts[i] : ends[i]].tobytes() for k in opens[chosen] for i in range(k, min(k + WINDOW, b))))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, windows (bytes), toxic of the sampled rows; the length of one text changes nothing for the others.

    Of a doc_id with several labels the greatest counts, of one with several texts the one whose drawn windows come first.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    picked = [marks.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(SAMPLE_ROWS) for t in (0, 1)]
    both = picked[0].unionByName(picked[1])  # 2 * SAMPLE_ROWS rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(both), "doc_id").select("doc_id", "toxic", "text")
    most = SAMPLE_TEXT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(drawn(data, offsets, most), pa.binary())], names=["doc_id", "toxic", "windows"])

    return texts.mapInArrow(run, "doc_id long, toxic int, windows binary").groupBy("doc_id", "toxic").agg(F.min("windows").alias("windows"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Trains on the sample in one task; it is bounded in rows and in bytes a row. The held-out rows are left out.

    Only the score table (one megabyte) comes to the driver.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        table, bias = train(part["windows"].tolist(), part["toxic"].to_numpy())
        return pd.DataFrame({"table": [table.tobytes()], "bias": [bias]})

    got = labelled_sample(docs, labels).groupBy(F.lit(0).alias("one")).applyInPandas(run, "table binary, bias double").first()
    if got is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(got["table"], dtype=np.float32), got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with all its columns and ``toxic_score`` (0 to 1); a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("toxic_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch):
                yield part.append_column("toxic_score", pa.array(window_scores(table, bias, data, offsets), pa.float64()))

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("toxic_score", DoubleType())]))


def filter_toxic(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch):
                yield part.filter(pa.array(window_scores(table, bias, data, offsets) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null and empty texts get the score of no words. Repeated rows score alike; a null doc_id counts as not held out.
    Without labels of both classes every text gets the labels' share. Other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
