"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one measured number. On a bounded sample the cost of each measure and the rules that reject
each text are found. The order is built rule by rule: next comes the rule that rejects most of what is left for what it
costs beyond the measures already taken. Each rule runs on the texts that all earlier ones kept. The order changes the
work, never the verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import chunks, hashes, lines, shingles, words

#: Rows of the bounded sample on which cost and selectivity are estimated, the first by a hash of doc_id.
SAMPLE_ROWS = 500
SEED = 10
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


class Texts:
    """Some texts of a chunk and what is measured of them, each measure once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n, self._has = data, offsets, len(offsets) - 1, {}

    def only(self, kept: np.ndarray) -> Texts:
        """The kept texts, copied together; measures of one number a text are carried over."""
        at = np.flatnonzero(kept)
        sizes = np.diff(self.offsets)[at]
        ends = np.r_[0, np.cumsum(sizes)]
        take = np.repeat(self.offsets[at] - ends[:-1], sizes) + np.arange(int(ends[-1]))
        out = Texts(self.data[take], ends)
        place, back = np.full(self.n, -1), self.offsets[:-1].copy()
        place[at] = np.arange(len(at))
        back[at] -= ends[:-1]  # how far each kept text moves to the front

        def moved(starts: np.ndarray, stops: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            stay = kept[owner]
            return starts[stay] - back[owner[stay]], stops[stay] - back[owner[stay]], place[owner[stay]]

        for name, value in self._has.items():
            if name in ("words", "full_lines"):
                out._has[name] = moved(*value)
            elif name == "word_hashes":
                out._has[name] = (value[0][kept[self.get("words")[2]]],)
            else:
                out._has[name] = value[at]
        return out

    def get(self, name: str):
        if name not in self._has:
            self._has[name] = getattr(self, f"_{name}")()
        return self._has[name]

    def _sum(self, marks: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(marks)]
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _words(self):
        return words(self.data, self.offsets)

    def _word_hashes(self):
        starts, ends, _ = self.get("words")
        return (hashes(self.data, starts, ends),)

    def _n_words(self):
        return np.bincount(self.get("words")[2], minlength=self.n)

    def _word_chars(self):
        starts, ends, owner = self.get("words")
        chars = np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]
        return np.bincount(owner, weights=chars[ends] - chars[starts], minlength=self.n).astype(np.int64)

    def _n_symbols(self):
        return self._sum(_SYMBOL[self.data])

    def _n_upper(self):
        return self._sum(_UPPER[self.data])

    def _n_letters(self):
        return self._sum(_LETTER[self.data] | (self.data >= 0xC0))  # of a character beyond ASCII the first byte

    def _full_lines(self):
        starts, ends, owner = lines(self.data, self.offsets)
        first_word = self.get("words")[0]
        at = np.searchsorted(first_word, starts)
        full = (at < len(first_word)) & (first_word[np.minimum(at, max(len(first_word) - 1, 0))] < ends) if len(first_word) else np.zeros(len(starts), bool)
        return starts[full], ends[full], owner[full]

    def _n_lines(self):
        return np.bincount(self.get("full_lines")[2], minlength=self.n)

    def _n_dup_lines(self):
        starts, ends, owner = self.get("full_lines")
        return self._repeats(hashes(self.data, starts, ends), owner)

    def _repeats(self, value: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How many of a text's values equal an earlier one."""
        order = np.lexsort((value, owner))
        same = (value[order[1:]] == value[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        return np.bincount(owner[order[1:]][same], minlength=self.n)

    def _n_distinct(self):
        return self.get("n_words") - self._repeats(self.get("word_hashes")[0], self.get("words")[2])

    def _n_repeat_words(self):
        """Words in 5-word windows that the text has twice or more, the first included."""
        owner = self.get("words")[2]
        value, of, at = shingles(self.get("word_hashes")[0], owner, 5, short=False)
        order = np.lexsort((value, of))
        same = (value[order[1:]] == value[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        twice = np.zeros(len(order), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        step = np.zeros(len(owner) + 1, dtype=np.int64)
        np.add.at(step, at[twice], 1)
        np.add.at(step, at[twice] + 5, -1)
        return np.bincount(owner[np.cumsum(step)[:-1] > 0], minlength=self.n)


#: What each measure is taken from; a measure is taken once for a text.
FROM = {
    "words": (),
    "word_hashes": ("words",),
    "full_lines": ("words",),
    "n_words": ("words",),
    "word_chars": ("words",),
    "n_symbols": (),
    "n_upper": (),
    "n_letters": (),
    "n_lines": ("full_lines",),
    "n_dup_lines": ("full_lines",),
    "n_distinct": ("n_words", "word_hashes"),
    "n_repeat_words": ("word_hashes",),
}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]
    measures: tuple[str, ...]

    def needs(self) -> set[str]:
        """All measures that the rule takes, directly or not."""
        todo, out = list(self.measures), set()
        while todo:
            m = todo.pop()
            if m not in out:
                out.add(m)
                todo += FROM[m]
        return out


def _share(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * a > percent * b


#: The rules; each rejects a text whose number passes the limit. A text without words has failed the base.
RULES = (
    Rule("few_words", lambda t: t.get("n_words") < 10, ("n_words",)),
    Rule("repeated_words", lambda t: _share(t.get("n_repeat_words"), t.get("n_words"), 20), ("n_repeat_words", "n_words")),
    Rule("symbols", lambda t: _share(t.get("n_symbols"), t.get("n_words"), 40), ("n_symbols", "n_words")),
    Rule("duplicate_lines", lambda t: _share(t.get("n_dup_lines"), t.get("n_lines"), 50), ("n_dup_lines", "n_lines")),
    Rule("upper_case", lambda t: _share(t.get("n_upper"), t.get("n_letters"), 60), ("n_upper", "n_letters")),
    Rule("few_distinct_words", lambda t: _share(t.get("n_words"), t.get("n_distinct"), 2000), ("n_words", "n_distinct")),
    Rule("word_length", lambda t: (t.get("word_chars") < 2 * t.get("n_words")) | (t.get("word_chars") > 25 * t.get("n_words")), ("word_chars", "n_words")),
)
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Estimates:
    """Of the sample: seconds a text of each measure, and how many texts each set of rules (by place, as bits) rejects."""

    seconds: dict[str, float]
    rejected: dict[int, int]


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> Estimates:
    # ids alone are ordered; then the texts of SAMPLE_ROWS ids are read
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(SAMPLE_ROWS)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, sets, seen = dict.fromkeys(FROM, 0.0), {}, 0
        for batch in batches:
            for _, data, offsets in chunks(batch):
                texts = Texts(data, offsets)
                for measure in FROM:  # each after those it is taken from
                    began = time.perf_counter()
                    texts.get(measure)
                    spent[measure] += time.perf_counter() - began
                bits = np.zeros(texts.n, dtype=np.int64)
                for k, rule in enumerate(rules):
                    bits |= rule.rejects(texts).astype(np.int64) << k
                for value, n in zip(*np.unique(bits, return_counts=True), strict=True):
                    sets[int(value)] = sets.get(int(value), 0) + int(n)
                seen += texts.n
        keys = [*spent, *map(str, sets)]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([*spent.values(), *map(float, sets.values())]), pa.array([seen] * len(keys), pa.int64())], names=["name", "value", "seen"])

    # a row a measure and a set of rules
    got = sample.mapInArrow(run, "name string, value double, seen long").groupBy("name").agg(F.sum("value").alias("value")).collect()
    by = {r["name"]: r["value"] for r in got}
    texts = max(sum(v for k, v in by.items() if k not in FROM), 1.0)
    return Estimates({m: by.get(m, 0.0) / texts for m in FROM}, {int(k): int(v) for k, v in by.items() if k not in FROM})


def ordered(found: Estimates, rules: tuple[Rule, ...] = RULES) -> list[str]:
    """Names by rejections among the texts that are left per second beyond the measures taken, the greatest first; ties by name."""
    left, taken, out = dict(found.rejected), set(), []
    places = {r.name: k for k, r in enumerate(rules)}
    rest = sorted(rules, key=lambda r: r.name)
    while rest:

        def worth(rule: Rule) -> float:
            gone = sum(n for bits, n in left.items() if bits >> places[rule.name] & 1)
            return gone / (sum(found.seconds.get(m, 0.0) for m in rule.needs() - taken) + 1e-9)

        best = max(rest, key=worth)
        out.append(best.name)
        rest.remove(best)
        taken |= best.needs()
        left = {bits: n for bits, n in left.items() if not bits >> places[best.name] & 1}
    return out


def verdicts(texts: Texts, order: list[str], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """Whether each text is kept. Each rule measures the texts that no earlier rule rejected, and only those."""
    by = {r.name: r for r in rules}
    kept, left, at = np.ones(texts.n, dtype=bool), texts, np.arange(texts.n)
    for name in order:
        if not len(at):
            break
        gone = by[name].rejects(left)
        kept[at[gone]] = False
        if gone.any():
            left, at = left.only(~gone), at[~gone]
    return kept


def quality_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row of ``docs``.

    The base numbers are measured for every text; the other rules run on those that pass the base. A null text has no
    words and fails the base. Repeated rows and null ids are rows like others; other columns are ignored.
    """
    rules = tuple(r for r in RULES if r.name not in BASE_RULES)
    order = ordered(estimate(docs, rules), rules)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                texts = Texts(data, offsets)
                base = [texts.get(c) for c in BASE]
                failed = (base[0] < 10) | _share(base[4], base[0], 20)
                kept = ~failed
                if kept.any():
                    kept[kept] = verdicts(texts.only(kept), order, rules)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in base), pa.array(failed), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "kept"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns. The whole cascade short-circuits."""
    order = ordered(estimate(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                yield part.filter(pa.array(verdicts(Texts(data, offsets), order)))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The base and the rules in DuckDB SQL. Words are cut as in Python; a window is five words joined by a space.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, unnest([array_to_string(ws[i:i+4], ' ')]) AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM r, range(0, 5) AS o(j) GROUP BY rid),
m AS (SELECT w.rid, w.doc_id, len(ws) AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(c.n_repeat_words, 0) AS n_repeat_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters,
             len(list_distinct(ws)) AS n_distinct
      FROM w LEFT JOIN c ON w.rid = c.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 40 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * n_upper > 60 * n_letters OR 100 * n_words > 2000 * n_distinct
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM f
"""
