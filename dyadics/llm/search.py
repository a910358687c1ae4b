"""Ranked lexical search by Block-Max WAND over an inverted index in shards of documents.

Terms are the runs ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A shard holds some thousand documents and
one posting list a term, cut into compressed blocks of BLOCK postings, each with the greatest impact in it. The index is a
table of such blocks. A search of a shard bounds the score of every cell of CELL neighbouring documents by the blocks that
reach into it, which needs no block opened, and goes through the cells from the highest bound down. It opens a block only
while a document of one of its cells may still come among the best.

A document of n terms has m = 50 + (50 * n * N) div L, and a term that it holds tf times has there the impact
(1000000000 * tf) div (1000 * tf + 20 * m); a score sums them times the terms' weights. N documents hold terms, L in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .text_arrays import LOWER, NOT_LETTER, by_hash, chunks, hashes, runs_of, words

BLOCK = 64
CELL = 32
#: A shard ends with the chunk of texts that brings it to so many documents or bytes.
SHARD_DOCS, SHARD_BYTES = 8_192, 32_000_000
#: Lists of so many blocks at most are opened at once: they say exactly where their term is.
SHORT = 2
TOP = 50
#: So many cells are scored before the threshold rises.
STRIDE = 16
#: Terms of queries that one broadcast holds, about; more go in several rounds over the index.
QUERY_TERMS = 200_000
#: Distinct terms of queries for which alone an index is made; of more, it is made for every term.
INDEXED_TERMS = 2_000_000
NOT_TERM = NOT_LETTER.copy()
NOT_TERM[0x30:0x3A] = False
SCHEMA = "shard long, term string, block int, first int, last int, n int, impact long, gaps binary, counts binary, ids array<long>, lengths array<long>"


def _numbers(x: np.ndarray, block: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each block's numbers in as many bytes apiece (1, 2 or 4) as its greatest one needs."""
    most = np.maximum.reduceat(x, first)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    size = np.diff(np.r_[first, len(x)]) * width
    to = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(to[-1]), dtype=np.uint8)
    at = to[block] + (np.arange(len(x)) - first[block]) * width[block]
    for k in range(4):
        has = width[block] > k
        out[at[has] + k] = (x[has] >> (8 * k)) & 255
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def _opened(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{len(packed) // n}").astype(np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)


def lengths(n: np.ndarray, with_terms: int, terms: int) -> np.ndarray:
    """m of documents of n terms."""
    return 50 + (50 * n * with_terms) // max(terms, 1)


class _Shard:
    """Postings of the documents that a task has read since the last shard."""

    def __init__(self, known: np.ndarray | None):
        self.known, self.ids, self.n, self.bytes, self.parts, self.spelt, self.places = known, [], [], 0, [], [], 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends, owner = words(data, offsets, NOT_TERM)
        before, texts = sum(len(x) for x in self.n), len(offsets) - 1
        self.ids.append(ids)
        self.n.append(np.bincount(owner, minlength=texts))
        self.bytes += len(data)
        value = hashes(data, starts, ends)
        if self.known is not None:
            found = np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)] == value) if len(self.known) else np.zeros(0, np.int64)
            starts, ends, owner, value = starts[found], ends[found], owner[found], value[found]
        if not len(value):
            return
        order = by_hash(value)
        value, owner = value[order], owner[order]
        term = np.r_[True, value[1:] != value[:-1]]
        first = np.flatnonzero(np.r_[True, term[1:] | (owner[1:] != owner[:-1])])
        self.parts.append((value[first], before + owner[first], np.diff(np.r_[first, len(value)]), self.places + np.cumsum(term)[first] - 1))
        shown = order[np.flatnonzero(term)]
        self.spelt.append(runs_of(data, starts[shown], ends[shown]))
        self.places += len(shown)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or sum(len(x) for x in self.n) >= SHARD_DOCS

    def rows(self, number: int, with_terms: int, terms: int) -> Iterator[pa.RecordBatch]:
        """A row with the documents (term null), then a row a block."""
        if not self.n:
            return
        n = np.concatenate(self.n)
        m = lengths(n, with_terms, terms)
        every = pa.array([pa.concat_arrays(self.ids).to_pylist()], pa.list_(pa.int64())), pa.array([m], pa.list_(pa.int64()))
        types = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        nothing = [pa.nulls(1, t) for t in types]
        yield pa.RecordBatch.from_arrays([pa.array([number]), *nothing[1:9], *every], names=names)
        if not self.parts:
            return
        value, doc, tf, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(value, kind="stable")
        value, doc, tf, place = value[order], doc[order], tf[order], place[order]
        opens = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        inner = np.arange(len(value)) - np.repeat(opens, np.diff(np.r_[opens, len(value)]))
        first = np.flatnonzero(inner % BLOCK == 0)
        size = np.diff(np.r_[first, len(value)])
        block = np.repeat(np.arange(len(first)), size)
        gaps = np.r_[0, np.diff(doc)]
        gaps[first] = 0
        spelt = pa.concat_arrays(self.spelt).take(pa.array(place[first])).cast(pa.string())
        columns = [np.full(len(first), number), spelt, inner[first] // BLOCK, doc[first], doc[first + size - 1], size, np.maximum.reduceat(impacts(tf, m[doc]), first), _numbers(gaps, block, first), _numbers(tf, block, first)]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=False)]
        yield from pa.Table.from_arrays([*arrays, *(pa.nulls(len(first), t) for t in types[9:])], names=names).to_batches(20_000)


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and terms in all; two sums a batch are all that leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with_terms = terms = 0
            for _, data, offsets in chunks(batch):
                owner = words(data, offsets, NOT_TERM)[2]
                terms += len(owner)
                with_terms += int((np.bincount(owner, minlength=1) > 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([with_terms]), pa.array([terms])], names=["with_terms", "terms"])

    got = docs.select("text").mapInArrow(run, "with_terms long, terms long").agg(F.sum("with_terms"), F.sum("terms")).first()
    return (got[0] or 0, got[1] or 0)


def index(docs: DataFrame, size: tuple[int, int], terms: np.ndarray | None = None) -> DataFrame:
    """The table of blocks of all documents, for all terms or for those with the given hashes (ascending)."""
    with_terms, all_terms = size
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard(shared.value)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                shard.add(part.column(0), data, offsets)
                if shard.full():
                    yield from shard.rows(number, with_terms, all_terms)
                    number, shard = number + 1, _Shard(shared.value)
        yield from shard.rows(number, with_terms, all_terms)

    # numbers are those of the tasks that wrote them, so the table is written before anything reads it
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA), "index")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, hash: the distinct terms of each item; rows that repeat an item_id are one item with all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                data = LOWER[data]
                starts, ends, owner = words(data, offsets, NOT_TERM)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), runs_of(data, starts, ends).cast(pa.string()), pa.array(hashes(data, starts, ends).view(np.int64))], names=["item_id", "term", "hash"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, term string, hash long").distinct()


class _Lists:
    """The posting lists of a shard, by term, and the bounds of all cells."""

    def __init__(self, table: pa.Table):
        meta = table.column("term").is_null()
        docs = table.filter(meta)
        self.ids = docs.column("ids").combine_chunks().flatten()
        self.m = docs.column("lengths").combine_chunks().flatten().to_numpy()
        blocks = table.filter(pa.compute.invert(meta)).sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
        self.first, self.last, self.n, self.impact = (blocks.column(c).to_numpy() for c in ("first", "last", "n", "impact"))
        self.gaps, self.counts = (blocks.column(c).to_pylist() for c in ("gaps", "counts"))
        spelt = blocks.column("term").combine_chunks().dictionary_encode() if blocks.num_rows else pa.array([], pa.string()).dictionary_encode()
        code = spelt.indices.to_numpy()
        self.opens = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        self.number = {t: k for k, t in enumerate(spelt.dictionary.to_pylist())}
        self.to = np.r_[self.opens[1:], len(code)]
        self.cells = -(-len(self.m) // CELL)
        #: where each block's postings are, once it is open
        self.at = np.r_[0, np.cumsum(self.n, dtype=np.int64)]
        self.doc, self.value, self.ready = np.zeros(self.at[-1], np.int64), np.zeros(self.at[-1], np.int64), np.zeros(len(code), bool)
        self.bound = np.zeros((len(self.number), self.cells), dtype=np.int64)
        if len(code):
            short = np.flatnonzero((self.to - self.opens)[code] <= SHORT)
            self.open(short)
            long = np.flatnonzero((self.to - self.opens)[code] > SHORT)
            reach = self.last[long] // CELL - self.first[long] // CELL + 1
            cell = np.repeat(self.first[long] // CELL - np.r_[0, np.cumsum(reach)[:-1]], reach) + np.arange(int(reach.sum()))
            np.maximum.at(self.bound, (np.repeat(code[long], reach), cell), np.repeat(self.impact[long], reach))
            post = np.flatnonzero(np.repeat(self.ready, self.n))
            np.maximum.at(self.bound, (np.repeat(code, self.n)[post], self.doc[post] // CELL), self.value[post])

    def open(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.ready[blocks]].tolist():
            a, z, n = self.at[b], self.at[b + 1], int(self.n[b])
            self.doc[a:z] = self.first[b] + np.cumsum(_opened(self.gaps[b], n))
            self.value[a:z] = _opened(self.counts[b], n)
            self.value[a:z] = impacts(self.value[a:z], self.m[self.doc[a:z]])
            self.ready[b] = True

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and scores of the ``top`` best; with equal scores at the end there may be more."""
        bounds = self.bound[terms] * weights[:, None]
        order = np.argsort(-bounds.max(axis=1), kind="stable")
        terms, weights, bounds = terms[order], weights[order], bounds[order]
        total = bounds.sum(axis=0)
        # what the terms after each one can still add to each cell
        rest = np.vstack([total - np.cumsum(bounds, axis=0)])
        cells = np.argsort(-total, kind="stable")
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        score = np.zeros(self.cells * CELL, dtype=np.int64)
        for k in range(0, len(cells), STRIDE):
            chosen = cells[k : k + STRIDE]
            chosen = chosen[total[chosen] >= least]
            if not len(chosen):
                break
            wanted = np.zeros(self.cells + 1, dtype=bool)
            wanted[chosen] = True
            score[:] = 0
            for i, (t, w) in enumerate(zip(terms.tolist(), weights.tolist(), strict=True)):
                reach = np.r_[0, np.cumsum(wanted)]
                blocks = np.arange(self.opens[t], self.to[t])
                blocks = blocks[reach[self.last[blocks] // CELL + 1] > reach[self.first[blocks] // CELL]]  # a shallow move: no block is open yet
                if len(blocks):
                    self.open(blocks)
                    if blocks[-1] - blocks[0] + 1 == len(blocks):
                        doc, value = self.doc[self.at[blocks[0]] : self.at[blocks[-1] + 1]], self.value[self.at[blocks[0]] : self.at[blocks[-1] + 1]]
                    else:
                        at = np.concatenate([np.arange(self.at[b], self.at[b + 1]) for b in blocks.tolist()])
                        doc, value = self.doc[at], self.value[at]
                    inside = wanted[doc // CELL]
                    score[doc[inside]] += w * value[inside]
                if i % 4 == 3 and least > 1:
                    wanted[: self.cells] &= score.reshape(-1, CELL).max(axis=1) + rest[i] >= least
                    if not wanted.any():
                        break
            # cells that were left early hold documents below the threshold alone
            found = np.flatnonzero(np.repeat(wanted[: self.cells], CELL) & (score >= least))
            docs, scores = np.r_[docs, found], np.r_[scores, score[found]]
            if len(scores) > top:
                least = int(np.partition(scores, len(scores) - top)[len(scores) - top])
                kept = scores >= least
                docs, scores = docs[kept], scores[kept]
        return docs, scores


def _of_shard(items: list[tuple[list[str], np.ndarray]], top: int):
    def run(table: pa.Table) -> pa.Table:
        lists = _Lists(table)
        out = []
        for k, (terms, weights) in enumerate(items):
            number = np.array([lists.number.get(t, -1) for t in terms])
            here = number >= 0
            if not here.any():
                continue
            docs, scores = lists.best(number[here], weights[here], top)
            ids = lists.ids.take(pa.array(docs))
            rows = pa.table({"item": pa.array(np.full(len(docs), k), pa.int32()), "doc_id": ids, "score": pa.array(scores)})
            out.append(rows.sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, top))  # nulls are last
        return pa.concat_tables(out) if out else pa.table({"item": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best rows of ``docs`` for each item, scores above 0 alone.

    Equal scores go by ascending doc_id, a null doc_id last. Rows of ``docs`` that repeat an id are ranked each for itself;
    rows of ``items`` that repeat an item_id are one item. Null and empty texts hold no terms: such documents are never found
    and such items find none. Other columns are ignored. ``docs`` are read twice: for the totals and for the index.
    """
    spark = docs.sparkSession
    wanted = stored(item_terms(items), "item-terms")
    size = totals(docs)
    hashed = wanted.select("hash").distinct()
    few = hashed.limit(INDEXED_TERMS + 1).count() <= INDEXED_TERMS
    blocks = index(docs, size, np.sort(hashed.toArrow().column(0).to_numpy().view(np.uint64)) if few else None)
    found = blocks.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1_000 * F.ln((2 * F.lit(size[0]) + 2) / (2 * F.col("df") + 1)))
    weighted = stored(wanted.join(found, "term").select("item_id", "term", weight.alias("weight")), "weighted-terms")
    rounds = 1 + weighted.count() // QUERY_TERMS
    weighted = weighted.withColumn("round", F.pmod(F.xxhash64("item_id"), F.lit(rounds)))
    out = None
    for k in range(rounds):  # a stated query set, in blocks: each is bounded
        part = weighted.where(F.col("round") == k).orderBy("item_id", "term").toArrow()
        ids, terms, weights = part.column("item_id").to_pylist(), part.column("term").to_pylist(), part.column("weight").to_numpy()
        opens = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        if not opens:
            continue
        lists = [(terms[a:b], weights[a:b]) for a, b in zip(opens, [*opens[1:], len(ids)], strict=True)]
        used = spark.createDataFrame(pa.table({"term": pa.array(sorted(set(terms)))}))
        own = blocks.where("term IS NULL").unionByName(blocks.join(F.broadcast(used), "term", "left_semi"))  # QUERY_TERMS terms, about
        best = own.groupBy("shard").applyInArrow(_of_shard(lists, top), "item int, doc_id long, score long")
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(opens)), pa.int32()), "item_id": pa.array([ids[a] for a in opens], part.schema.field("item_id").type)}))
        best = best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The definition with every posting of every term scored.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
size AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT rid, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM d, size),
s AS (SELECT item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
