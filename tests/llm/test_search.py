import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyadics.llm import search as s
from dyadics.llm.text_arrays import chunks


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        rows = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, k, None if gone else i, -v) for k, (v, gone, i) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=str)


def check(docs, items, top=50):
    got = sorted((tuple(r) for r in s.search(docs, items, top).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], top)
    return got


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    got = check(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet"))
    assert len(got) == 40 * 50


def test_odd_rows(odd, nothing, spark):
    items = spark.createDataFrame([(1, "the QUICK w3 w3 é", "x"), (2, None, "x"), (3, "", "x"), (1, "one", "x"), (4, "nowhere", "x"), (None, "row a", "x")], "item_id long, text string, term string")
    check(odd, items)
    check(odd, items, 1)
    assert s.search(nothing, items).count() == 0 and s.search(odd, items.where("false")).count() == 0


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300, 0, -1)] + [(None, "same words here"), (7, "same words here")], "doc_id long, text string")
    got = check(docs, spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])][:8] == [1, 2, 3, 4, 5, 6, 7, 7]


def test_terms_in_rounds_and_a_whole_index(docs, spark, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    monkeypatch.setattr(s, "QUERY_TERMS", 100)
    monkeypatch.setattr(s, "INDEXED_TERMS", 10)
    check(docs.select("doc_id", "text"), items)


def lists(texts, known=None):
    shard = s._Shard(known)
    n_docs, n_terms = sum(1 for t in texts if terms(t)), sum(len(terms(t)) for t in texts)
    for a in range(0, len(texts), 97):
        part = texts[a : a + 97]
        batch = pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part))), pa.array(part)], names=["doc_id", "text"])
        for rows, data, offsets in chunks(batch):
            shard.add(rows.column(0), data, offsets)
    return s._Lists(pa.Table.from_batches(list(shard.rows(5, n_docs, n_terms)))), n_docs


@pytest.mark.parametrize("seed", range(4))
def test_blocks_below_the_threshold_stay_shut(seed):
    draw = random.Random(seed)
    texts = [" ".join(f"w{int(draw.paretovariate(0.6)) % 3000}" for _ in range(draw.choice((5, 40, 200)))) for _ in range(3000)]
    texts += ["w1 rare gem", "rare gem gem", "gem rare w2"] * 25
    shard, n_docs = lists(texts)
    assert len(shard.m) == len(texts) and shard.at[-1] == sum(len(set(terms(t))) for t in texts)
    for query in (["rare", "gem", "w1", "w2", "w3"], ["w1", "w17", "w900"], ["w1"], [f"w{i}" for i in range(40)]):
        number = np.array([shard.number[t] for t in query if t in shard.number])
        held = [Counter(terms(t)) for t in texts]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for c in held) + 1))) for t in query if t in shard.number])
        before = shard.ready.copy()
        got, scores = shard.best(number, weight, 50)
        want = [sum(int(w) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * int(m))) for t, w in zip([q for q in query if q in shard.number], weight, strict=True) if t in c) for c, m in zip(held, shard.m, strict=True)]
        least = sorted(want, reverse=True)[min(49, len(want) - 1)]
        assert {d: v for d, v in zip(got.tolist(), scores.tolist(), strict=True)} == {i: v for i, v in enumerate(want) if v >= max(least, 1)}
        if query[0] == "rare":  # seventy-five documents hold both rare terms; most blocks of the common ones cannot matter
            own = np.concatenate([np.arange(shard.opens[t], shard.to[t]) for t in number])
            assert (shard.ready & ~before)[own].sum() < 0.5 * len(own)


def test_numbers_of_every_width():
    x = np.array([0, 255, 3, 256, 1, 70_000, 5, 2, 2**32 - 1])
    first = np.array([0, 2, 4, 6, 8])
    size = np.diff(np.r_[first, len(x)])
    packed = s._numbers(x, np.repeat(np.arange(5), size), first).to_pylist()
    assert [len(p) for p in packed] == [2, 4, 8, 2, 4]
    assert np.concatenate([s._opened(p, n) for p, n in zip(packed, size.tolist(), strict=True)]).tolist() == x.tolist()


def test_totals(odd, docs):
    for rows in (odd, docs):
        held = [len(terms(r["text"])) for r in rows.collect()]
        assert s.totals(rows) == (sum(n > 0 for n in held), sum(held))
    assert odd.agg(F.count("*")).first()[0] == 12
