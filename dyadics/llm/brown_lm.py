"""Brown class-based bigram language model: classes by exchange clustering, scores for every text.

P(text) is the product over its tokens of P(class | class before) * P(word | class). Units are clustered: each of the
most frequent words is a unit, all other words belong to the unit of their last two bytes at first. Exchange clustering
moves one unit after the other to the class that gains most mutual information between adjacent classes. Then each of
the other training words goes, by its own counts of classes before and after it, to the class where it gains most;
unseen words have the class of their last two bytes.

Counts of words and of adjacent units are summed over all training texts by shuffles. Sent to the driver are tables
bounded by the numbers of units and classes alone. Scoring looks the more frequent words up in a bounded broadcast
table; all other words meet their counts and classes in a join, at any vocabulary size. Words are told apart by 56 bits of
a hash and their suffix group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text_arrays import LOWER, chunks, hashes, mix, words

HELD_OUT_OF = 10
#: Units: words of their own at most, and suffix groups of all others.
FREQUENT, SUFFIXES = 4_096, 256
CLASSES = 64
#: Rounds end when the mutual information of adjacent classes rises by less than this share: they have settled. After so many
#: they end anyway, which the results tell.
LEAST_GAIN, ROUNDS = 2e-4, 40
#: Words whose counts a worker holds at most (12 bytes each).
LOOKED_UP = 1 << 18
#: Distinct keys that a worker gathers before it hands them on.
HELD_KEYS = 2_000_000
#: Added to each word's count, as in the base; and the weight of the unigram class law in P(class | class before).
ADDED, BACK_OFF = 0.1, 2.0
END_HASH = -(2**62) - 11
#: Stands for the class of a word that has yet to meet it in the join.
PENDING = 255
END = FREQUENT + SUFFIXES
UNITS = END + 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, suffix group and text number of each word, lower-cased."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    last = data[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return hashes(data, starts, ends).view(np.int64), (mix(last * np.uint64(256) + before) % np.uint64(SUFFIXES)).astype(np.int64), owner


class Sums:
    """Counts by an integer key, summed over batches in bounded memory."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, key: np.ndarray, count: np.ndarray | None = None) -> None:
        key, back = np.unique(key, return_inverse=True)
        self.keys.append(key)
        self.counts.append(np.bincount(back, weights=count, minlength=len(key)).astype(np.int64))
        self.size += len(key)
        if self.size > HELD_KEYS and len(self.keys) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate(self.counts), minlength=len(key)).astype(np.int64)
        self.keys, self.counts, self.size = [key], [count], len(key)
        return key, count

    def full(self) -> bool:
        return self.size > HELD_KEYS

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.__init__()
        return out


def word_counts(training: DataFrame) -> DataFrame:
    """word (hash), suffix, n of all words of the training texts, and of their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the suffix group takes the place of the hash's lowest byte, so that one key carries both
        sums, texts = Sums(), 0

        def out() -> pa.RecordBatch:
            key, n = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for _, data, offsets in chunks(batch):
                word, suffix, _ = tokens(data, offsets)
                sums.add(_named(word, suffix))
                texts += len(offsets) - 1
                if sums.full():
                    yield out()
        sums.add(np.array([END_HASH]), np.array([texts]))
        yield out()

    return training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _named(word: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """A word's key: its hash, with the suffix group in the lowest byte."""
    return (word & ~np.int64(SUFFIXES - 1)) | suffix


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more. What is collected: one row a bin of like counts."""
    rows = counts.groupBy("n").count()
    bins = rows.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.min("n").alias("n"), F.sum("count").alias("many")).orderBy(F.desc("bin")).collect()  # 4032 rows at most
    seen, least = 0, 1 << 62
    for r in bins:
        seen += r["many"]
        if seen > most:
            break
        least = r["n"]
    return least


def units(key: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The unit of each word key; ``frequent`` has the keys of the word units, ascending."""
    if not len(frequent):
        return FREQUENT + (key & (SUFFIXES - 1))
    at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
    return np.where(frequent[at] == key, at, FREQUENT + (key & (SUFFIXES - 1)))


def _sequence(unit: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The units of each text with one END before and after, in one array; and where each text's words begin in it."""
    counts = np.bincount(owner, minlength=texts)
    begins = np.r_[0, np.cumsum(counts + 1)]
    out = np.full(int(begins[-1]) + 1, END, dtype=np.int64)
    out[np.arange(len(unit)) + owner + 1] = unit
    return out, begins


def unit_pairs(training: DataFrame, frequent: np.ndarray) -> DataFrame:
    """pair (first * UNITS + second), n of all adjacent units; a text's END is also what its first word follows."""
    shared = training.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()

        def out() -> pa.RecordBatch:
            key, n = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for _, data, offsets in chunks(batch):
                word, suffix, owner = tokens(data, offsets)
                line, _ = _sequence(units(_named(word, suffix), shared.value), owner, len(offsets) - 1)
                sums.add(line[:-1] * UNITS + line[1:])
                if sums.full():
                    yield out()
        yield out()

    return training.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def contexts(pairs: DataFrame, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts [unit, class] of the classes after and before each unit: 2 * UNITS * (CLASSES + 1) numbers at most."""
    k = CLASSES + 1
    shared = pairs.sparkSession.sparkContext.broadcast(label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, total = shared.value, np.zeros(2 * UNITS * k)
        for batch in batches:
            pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first, second = pair // UNITS, pair % UNITS
            total += np.bincount(np.r_[first * k + label[second], (UNITS + second) * k + label[first]], weights=np.r_[n, n], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["at", "n"])

    got = pairs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * UNITS * k)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    after, before = out.reshape(2, UNITS, k)
    return after, before


def _gainful(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(now: np.ndarray, of: np.ndarray, context: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class where each word gains most against the classes' ``table``, in which it counts for the class ``now``.

    ``of`` (ascending, without gaps) has the word of each context; a context is the class after the word, or the number
    of classes and the class before it.
    """
    k, f, out = CLASSES + 1, _gainful, np.empty(len(now), dtype=np.int64)
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    begins = np.r_[np.searchsorted(of, np.arange(len(now))), len(of)]
    at = 0
    while at < len(now):  # some thousand contexts at a time
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + 8_192, side="right")) - 1)
        part = slice(begins[at], begins[to])
        own, d, m = of[part] - at, context[part] % k, n[part].astype(np.float64)
        after, home = context[part] < k, now[at:to]
        base = np.where(after[:, None], table[:, d].T, table[d])
        place = np.arange(len(own)), home[own]
        base[place] = np.maximum(base[place] - m, 0)
        gain = np.add.reduceat(f(base + m[:, None]) - f(base), begins[at:to] - begins[at], axis=0)
        for total, each in ((rows, after), (columns, ~after)):
            size = np.bincount(own, weights=m * each, minlength=to - at)
            left = np.tile(total, (to - at, 1))
            left[np.arange(to - at), home] = np.maximum(left[np.arange(to - at), home] - size, 0)
            gain -= f(left + size[:, None]) - f(left)
        gain[:, CLASSES] = -np.inf
        out[at:to] = gain.argmax(axis=1)
        at = to
    return out


def rare_classes(training: DataFrame, frequent: np.ndarray, label: np.ndarray, table: np.ndarray) -> DataFrame:
    """word, n, class of each training word that is no unit of its own, by its contexts' classes."""
    shared = training.sparkSession.sparkContext.broadcast((frequent, label, table))
    k = CLASSES + 1

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, label, _ = shared.value
        for batch in batches:
            for _, data, offsets in chunks(batch):
                word, suffix, owner = tokens(data, offsets)
                key = _named(word, suffix)
                unit = units(key, frequent)
                line, _ = _sequence(unit, owner, len(offsets) - 1)
                rare = np.flatnonzero(unit >= FREQUENT)
                place, classes = rare + owner[rare] + 1, label[line]
                names, of = np.unique(key[rare], return_inverse=True)
                both, n = np.unique(np.r_[of * 2 * k + classes[place + 1], of * 2 * k + k + classes[place - 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[both // (2 * k)]), pa.array((both % (2 * k)).astype(np.int32)), pa.array(n)], names=["word", "context", "n"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, label, table = shared.value

        def done(word: np.ndarray, context: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            names, of = np.unique(word, return_inverse=True)
            to = best_classes(label[FREQUENT + (names & (SUFFIXES - 1))], of, context, n, table)
            size = np.bincount(of, weights=n * (context < k), minlength=len(names)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(size), pa.array(to)], names=["word", "n", "class"])

        rest = [np.zeros(0, np.int64)] * 3  # contexts of the last word, which may go on: 2 * k at most
        for batch in batches:
            word, context, n = (np.r_[x, c.to_numpy().astype(np.int64)] for x, c in zip(rest, batch.columns, strict=True))
            if not len(word):
                continue
            whole = int(np.searchsorted(word, word[-1]))
            rest = [x[whole:] for x in (word, context, n)]
            if whole:
                yield done(word[:whole], context[:whole], n[:whole])
        if len(rest[0]):
            yield done(*rest)

    counted = training.select("text").mapInArrow(around, "word long, context int, n long").groupBy("word", "context").agg(F.sum("n").alias("n"))
    return counted.repartition("word").sortWithinPartitions("word").mapInArrow(assign, "word long, n long, class long")


def information(label: np.ndarray, after: np.ndarray) -> float:
    """Mutual information of adjacent classes times the number of pairs; ``after`` counts the current classes after each unit."""
    table = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(table, label, after)
    return float(_gainful(table).sum() - _gainful(table.sum(axis=1)).sum() - _gainful(table.sum(axis=0)).sum() + _gainful(table.sum()))


def exchange(label: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One round of the exchange algorithm over all units, the frequent ones first; END keeps the class of its own.

    Neighbours count by the classes that they had at the start of the round. The two tables, of the units' classes now with
    the classes after and before them then, are exact sums throughout, so a unit is taken out and put in without remainder.
    """
    f, label, k = _gainful, label.copy(), CLASSES + 1
    follow, lead = np.zeros((k, k)), np.zeros((k, k))
    np.add.at(follow, label, after)
    np.add.at(lead, label, before)
    rows, columns = follow.sum(axis=1), lead.sum(axis=1)
    weight = after.sum(axis=1) + before.sum(axis=1)
    for u in np.argsort(-weight, kind="stable"):
        if u == END or not weight[u]:
            continue
        a, r, c = label[u], after[u], before[u]
        nr, nc = r.sum(), c.sum()
        follow[a] -= r
        lead[a] -= c
        rows[a] -= nr
        columns[a] -= nc
        to, of = np.flatnonzero(r), np.flatnonzero(c)
        gain = (f(follow[:, to] + r[to]) - f(follow[:, to])).sum(axis=1) + (f(lead[:, of] + c[of]) - f(lead[:, of])).sum(axis=1)
        gain -= f(rows + nr) - f(rows) + f(columns + nc) - f(columns)
        gain[CLASSES] = -np.inf
        b = int(np.argmax(gain))
        label[u] = b
        follow[b] += r
        lead[b] += c
        rows[b] += nr
        columns[b] += nc
    return label


def cluster(pairs: DataFrame, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The labels of greatest information that rounds of exchange from ``label`` come to, the classes after each unit, and
    whether the rounds have settled."""
    after, before = contexts(pairs, label)
    best = information(label, after), label, after
    for _ in range(ROUNDS):
        label = exchange(label, after, before)
        after, before = contexts(pairs, label)
        now = information(label, after)
        risen = now - best[0]
        if risen > 0:
            best = now, label, after
        if risen <= LEAST_GAIN * max(abs(best[0]), 1.0):
            return best[1], best[2], True
    return best[1], best[2], False


class Model:
    """What a worker needs to give words their classes: bounded arrays."""

    def __init__(self, label, looked_up, looked_count, looked_class, settled):
        self.label, self.looked_up, self.looked_count, self.looked_class, self.settled = label, looked_up, looked_count, looked_class, settled


def fit(docs: DataFrame) -> tuple[Model, DataFrame, np.ndarray, int, int, int]:
    """The classes: a model, the other words' n and class, the words of each class; and the sum N of all counts, the number V of words and the number of ends."""
    training = docs.where(~held_out()).select("text")
    counts = stored(word_counts(training), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words_only = counts.where(F.col("word") != END_HASH)
    looked = _least_count(words_only, LOOKED_UP)
    # the word units: of words of the same count those that a hash puts first, so that a tie leaves no unit unused
    often = words_only.orderBy(F.desc("n"), F.xxhash64("word"), "word").limit(FREQUENT).toArrow()
    above = words_only.where(F.col("n") >= looked).toArrow()
    top = dict(zip(often.column("word").to_pylist(), often.column("n").to_pylist(), strict=True)) | dict(zip(above.column("word").to_pylist(), above.column("n").to_pylist(), strict=True))
    looked_up = np.array(sorted(top), dtype=np.int64)
    looked_count = np.array([top[w] for w in looked_up.tolist()], dtype=np.int64)
    frequent = np.sort(often.column("word").to_numpy())
    own = np.isin(looked_up, frequent)
    groups = {r["suffix"]: r["n"] for r in words_only.groupBy((F.pmod("word", F.lit(SUFFIXES))).alias("suffix")).agg(F.sum("n").alias("n")).collect()}
    for w, n in zip(often.column("word").to_pylist(), often.column("n").to_pylist(), strict=True):
        groups[w % SUFFIXES] -= n
    pairs = stored(unit_pairs(training, frequent), "unit-pairs")
    # to begin with, units are dealt to classes in the order of their counts
    size = np.zeros(UNITS)
    size[: len(frequent)] = looked_count[own]
    for s, n in groups.items():
        size[FREQUENT + s] = n
    label = np.zeros(UNITS, dtype=np.int64)
    label[np.argsort(-size, kind="stable")] = np.arange(UNITS) % CLASSES
    label[END] = CLASSES
    label, after, settled = cluster(pairs, label)
    k = CLASSES + 1
    table = np.zeros((k, k))
    np.add.at(table, label, after)
    rare = stored(rare_classes(training, frequent, label, table), "rare-classes")
    looked_class = np.zeros(len(looked_up), dtype=np.int64)
    looked_class[own] = label[: len(frequent)]
    known = rare.where(F.col("n") >= looked).select("word", "class").toArrow()
    looked_class[np.searchsorted(looked_up, known.column("word").to_numpy())] = known.column("class").to_numpy()
    # words and slots for unseen words of each class; every suffix group has one slot
    words_of = np.bincount(label[: len(frequent)], minlength=k).astype(float)
    np.add.at(words_of, label[FREQUENT : FREQUENT + SUFFIXES], 1.0)
    for r in rare.groupBy("class").count().collect():
        words_of[r["class"]] += r["count"]
    words_of[CLASSES] = 1
    ends = counts.where(F.col("word") == END_HASH).first()
    return Model(label, looked_up, looked_count, looked_class, settled), rare.where(F.col("n") < looked), words_of, total, kinds, ends["n"] if ends else 0


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts' words with one END before and after each text, and where each text begins."""
    texts = column.to_pylist()
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.r_[0, np.cumsum(size + 1)]
    out = np.full(int(begins[-1]) + 1, CLASSES, dtype=np.int64)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(texts)), size) + 1] = np.frombuffer(b"".join(texts), np.uint8)
    return out, begins


def _transitions(rows: DataFrame) -> np.ndarray:
    """Counts of adjacent classes in the rows' texts."""
    k = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            line, _ = _lines(batch.column(0))
            total += np.bincount(line[:-1] * k + line[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = rows.select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(k, k)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, settled for each row of ``docs``.

    ``settled`` says whether the rounds of exchange came to an end of their own.

    A null or empty text is one end. Rows with a null doc_id train and are not held out. Repeated rows are counted and
    scored like others. Without training rows every count is 0. Other columns are ignored.
    """
    model, rare, words_of, total, kinds, end_n = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, up double, classes binary, rest array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 40
        end_up = np.log10(end_n + ADDED)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                texts = len(offsets) - 1
                word, suffix, owner = tokens(data, offsets)
                key = _named(word, suffix)
                if len(m.looked_up):
                    at = np.minimum(np.searchsorted(m.looked_up, key), len(m.looked_up) - 1)
                    hit = m.looked_up[at] == key
                else:
                    at, hit = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
                up = np.bincount(owner[hit], weights=np.log10(m.looked_count[at[hit]] + ADDED), minlength=texts) + end_up
                classes = np.full(len(key), PENDING, dtype=np.uint8)
                classes[hit] = m.looked_class[at[hit]]
                cuts = np.searchsorted(owner, np.arange(texts + 1))
                rest, of = key[~hit], owner[~hit]
                ends = np.searchsorted(of, np.arange(texts + 1))
                n = np.bincount(owner, minlength=texts) + 1
                known = np.bincount(owner[hit], minlength=texts) + (end_n > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(texts)),
                        part.column(0),
                        part.column(1),
                        pa.array(n),
                        pa.array(known),
                        pa.array(up),
                        pa.array([classes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest)),
                    ],
                    names=[x.split()[0] for x in schema.split(", ")],
                )
                row += texts

    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, schema), "text-words")
    unseen = F.element_at(F.array(*(F.lit(int(c)) for c in model.label[FREQUENT : FREQUENT + SUFFIXES])), (F.pmod("word", F.lit(SUFFIXES)) + 1).cast("int"))
    found = rows.select("row", F.posexplode("rest").alias("pos", "word")).join(rare, "word", "left").select("row", "pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", unseen).cast("int").alias("class"))
    found = found.groupBy("row").agg(F.sum(F.log10(F.col("n") + F.lit(ADDED))).alias("more"), F.count_if(F.col("n") > 0).alias("more_known"), F.sort_array(F.collect_list(F.struct("pos", "class"))).alias("late"))
    joined = rows.drop("rest").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("up") + F.coalesce("more", F.lit(0.0))).alias("up"),
        "classes",
        F.coalesce(F.transform("late", lambda x: x["class"]), F.array().cast("array<int>")).alias("late"),
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(5).to_pylist()
            classes = np.frombuffer(b"".join(texts), np.uint8).copy()
            classes[classes == PENDING] = batch.column(6).flatten().to_numpy()
            cuts = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
            filled = pa.array([classes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], filled], names=[*batch.schema.names[:5], "classes"])

    lines = stored(joined.mapInArrow(fill, "doc_id long, held_out boolean, n_tokens long, n_known long, up double, classes binary"), "text-classes")
    k = CLASSES + 1
    table = _transitions(lines.where("NOT held_out"))
    share = (table.sum(axis=0) + ADDED) / (table.sum() + ADDED * k)
    jump = np.log10((table + BACK_OFF * share) / (table.sum(axis=1, keepdims=True) + BACK_OFF))
    laws = docs.sparkSession.sparkContext.broadcast((jump, np.log10(table.sum(axis=0) + ADDED * words_of)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jump, down = laws.value
        for batch in batches:
            line, begins = _lines(batch.column(5))
            step = jump[line[:-1], line[1:]] - down[line[1:]]
            path = np.add.reduceat(step, begins[:-1]) if batch.num_rows else step
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(path)], names=[*batch.schema.names[:5], "path"])

    down = float(np.log10(total + ADDED * (kinds + 1)))
    scored = lines.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, up double, path double")
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("up") - F.col("n_tokens") * F.lit(down)).alias("base_score"),
        (F.col("up") + F.col("path")).alias("score"),
        F.lit(model.settled).alias("settled"),
    )


def op4_brown_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
