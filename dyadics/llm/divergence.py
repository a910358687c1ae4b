"""How far the sources of a language are from each other and from the whole, by joint histograms of term counts.

Terms are the runs ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a language keeps those that at least
``LEAST_DOCS`` of its documents hold. A term of count c in a group of N kept occurrences has
``p = 1 + floor(SCALE * (c + 2) / (N + 2 * V))``, V being the kept terms of the language; two shares differ by
``floor((p - q) ** 2 / (p + q))``. A pair of sources needs that once per distinct pair of counts: its joint histogram holds how
many terms have each, those in one source alone and those in neither included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, small, stored
from .text_arrays import LOWER, NOT_LETTER, by_hash, chunks, hashes, runs_of, words

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Counts that a task keeps before it hands them on.
COUNTS_A_TASK = 1_500_000


class _Counts:
    """Counts of (group, term) in one task: hashes, group numbers, occurrences, documents, and where each term is spelt."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.rows, self.spelt, self.waiting, self.known = [], [], 0, 0

    def add(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> None:
        """Counts one chunk of texts; a term counts its document once."""
        data = LOWER[data]
        starts, ends, owner = words(data, offsets, NOT_LETTER)
        if not len(starts):
            return
        value = hashes(data, starts, ends)
        order = by_hash(value)
        value, owner = value[order], owner[order]
        term = np.r_[True, value[1:] != value[:-1]]
        first = np.flatnonzero(np.r_[True, term[1:] | (owner[1:] != owner[:-1])])
        place = np.cumsum(term)[first] - 1 + self.known
        self.rows.append((group[owner[first]], value[first], np.diff(np.r_[first, len(value)]), np.ones(len(first), np.int64), place))
        shown = order[np.flatnonzero(term)]
        self.spelt.append(runs_of(data, starts[shown], ends[shown]))
        self.known += len(shown)
        self.waiting += len(first)

    def combine(self) -> None:
        group, value, n, docs, place = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((value, group))
        first = np.flatnonzero(np.r_[True, (np.diff(value[order]) != 0) | (np.diff(group[order]) != 0)])
        self.rows = [(group[order][first], value[order][first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first), place[order][first])]
        self.waiting = len(first)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        self.combine()
        group, _, n, docs, place = self.rows[0]
        names = list(self.groups)
        spelt = pa.concat_arrays(self.spelt).take(pa.array(place))
        keys = (pa.array([g[k] for g in names]).take(pa.array(group)) for k in (0, 1))
        yield from pa.Table.from_arrays([*keys, spelt, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"]).to_batches(50_000)
        self.clear()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, combined = _Counts(), 0
    for batch in batches:
        for part, data, offsets in chunks(batch):
            keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            counts.add(data, offsets, np.array([counts.groups.setdefault(k, len(counts.groups)) for k in keys]))
            if counts.waiting > combined + COUNTS_A_TASK:
                counts.combine()
                combined = counts.waiting
                if combined > COUNTS_A_TASK:
                    yield from counts.batches()
                    combined = 0
    yield from counts.batches()


def counted(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, by_source (source, n; ordered) of the terms that each language keeps.

    Tasks count their own texts and hand on one row a group and term, so one exchange by language and term is enough.
    ``by_source`` is as long as the language has sources.
    """
    rows = docs.select(_key("lang"), _key("source"), "text").mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    by = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = by.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return every.where(F.col("docs") >= least_docs).select("lang", "term", "total", "by_source")


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def share(n: str, of: str, v: str) -> str:
    """p of a count, exact for all counts below 10**19."""
    return f"1 + ({SCALE}BD * (cast({n} AS decimal(20, 0)) + 2) div (cast({of} AS decimal(20, 0)) + 2 * {v}))"


def distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def joint(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, x, y, terms: how many kept terms occur x times in source a and y times in source b, for a before b.

    ``terms`` is of ``counted``, ``groups`` of ``sized``. Only terms that both sources hold are paired. The others follow
    from the histogram of each source: what both hold is taken off the cells (x, 0) and (0, y), and (0, 0) has the rest.
    """
    each = terms.select("lang", "by_source", F.posexplode("by_source").alias("at", "l"))
    each = each.select("lang", "l", F.explode(F.slice("by_source", F.col("at") + 2, F.size("by_source"))).alias("r"))
    both = each.groupBy("lang", F.col("l.source").alias("a"), F.col("r.source").alias("b"), F.col("l.n").alias("x"), F.col("r.n").alias("y")).agg(F.count("*").alias("k"))
    both = _spread(both, "(x, y, k), (x, 0, -k), (0, y, -k), (0, 0, k)")
    own = terms.select("lang", F.explode("by_source").alias("s")).groupBy("lang", "s.source", "s.n").agg(F.count("*").alias("k"))
    pairs = groups.select("lang", "v", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    left = _spread(pairs.join(own.select("lang", F.col("source").alias("a"), F.col("n").alias("x"), "k"), ["lang", "a"]), "(x, 0, k), (0, 0, -k)")
    right = _spread(pairs.join(own.select("lang", F.col("source").alias("b"), F.col("n").alias("y"), "k"), ["lang", "b"]), "(0, y, k), (0, 0, -k)")
    neither = pairs.selectExpr("lang", "a", "b", "0L AS x", "0L AS y", "v AS k")
    cells = both.unionByName(left).unionByName(right).unionByName(neither)
    return cells.groupBy("lang", "a", "b", "x", "y").agg(F.sum("k").alias("terms")).where("terms != 0 OR x = 0 AND y = 0")


def _spread(rows: DataFrame, cells: str) -> DataFrame:
    tuples = ", ".join(f"struct(cast({x} AS long) AS x, cast({y} AS long) AS y, cast({k} AS long) AS k)" for x, y, k in (c.split(", ") for c in cells.strip("()").split("), (")))
    return rows.selectExpr("lang", "a", "b", f"inline(array({tuples}))")


def sized(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, n, v of every group that occurs: its kept occurrences and its language's kept terms, 0 if none."""
    groups = docs.select(_key("lang"), _key("source")).distinct()
    inside = terms.select("lang", F.explode("by_source").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"))
    return groups.join(inside, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["n", "v"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: of each source the other sources of its language (``pair``) and the terms that it
    has more of than the language (``term``, the first ``top_terms``).

    Null text, lang and source are ''. A group without kept terms counts 0 of each; a language without any gives pairs of
    value 0 and no terms. Repeated rows count as often as they stand; an empty table gives no rows; other columns are ignored.
    """
    terms = stored(counted(docs, least_docs), "terms")
    groups = stored(sized(docs, terms), "groups")
    known = groups.limit(BROADCAST_ROWS + 1).count()

    def of(side: str) -> DataFrame:
        return small(groups.select("lang", F.col("source").alias(side), F.col("n").alias(f"n_{side}"), *(["v"] if side == "a" else [])), known)

    cells = joint(terms, groups).join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    cells = cells.selectExpr("lang", "a", "b", "terms", f"if(v = 0, 0L, {share('x', 'n_a', 'v')}) AS p", f"if(v = 0, 0L, {share('y', 'n_b', 'v')}) AS q")
    pairs = cells.groupBy("lang", "a", "b").agg(F.sum(F.expr(f"if(p + q = 0, 0L, terms * ({distance('p', 'q')}))")).alias("value"))
    pairs = pairs.selectExpr("lang", "inline(array(struct(a AS source, b AS item), struct(b AS source, a AS item)))", "value").withColumn("part", F.lit("pair"))

    whole = groups.groupBy("lang").agg(F.sum("n").alias("n_all"))
    found = terms.select("lang", "term", "total", F.explode("by_source").alias("s")).select("lang", F.col("s.source").alias("a"), "term", "s.n", "total")
    found = found.join(of("a"), ["lang", "a"]).join(small(whole, known), "lang")
    found = found.selectExpr("lang", "a AS source", "term AS item", f"{share('n', 'n_a', 'v')} AS p", f"{share('total', 'n_all', 'v')} AS q").where("p > q")
    found = found.selectExpr("lang", "source", "item", f"{distance('p', 'q')} AS value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(order)).select(*columns).unionByName(found.select(*columns))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The definition term by term: every kept term of a language stands for every group, with no histogram.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
vs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n_all FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n,
                  sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_group
           FROM groups g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (n_group::HUGEINT + 2 * v) AS p,
             1 + (1000000000::HUGEINT * (total + 2)) // (n_all + 2 * v) AS q
      FROM full_c JOIN vs USING (lang)),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
          FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every_pair AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pairs.value, 0) AS value
               FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
               LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
