import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadics.llm import suffix_dedup as s


def brute(rows, length=400):
    seen, twice = set(), set()
    for _, text in rows:
        value = (text or "").encode()
        for i in range(len(value) - length + 1):
            (twice if value[i : i + length] in seen else seen).add(value[i : i + length])
    out = []
    for doc_id, text in rows:
        value = (text or "").encode()
        gone = np.zeros(len(value), dtype=bool)
        for i in range(len(value) - length + 1):
            if value[i : i + length] in twice:
                gone[i : i + length] = True
        left = np.frombuffer(value, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(value), int(gone.sum()), len(s._runs(gone)), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def check(docs, batches=s.BATCHES):
    got = s.dedup(docs, batches).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for r in got:
        assert (r["kept_text"] is None) == (r["n_removed"] == 0)
    return {r["doc_id"]: r for r in got}


def letters(draw, n):
    return "".join(draw.choice("abcdefgh ") for _ in range(n))


def passages(seed, docs=60):
    draw = random.Random(seed)
    shared = [letters(draw, n) for n in (399, 400, 401, 450, 700, 2500)] + ["é" * 300, "xy" * 900]
    rows = []
    for i in range(docs):
        parts = [letters(draw, draw.choice((0, 1, 30, 500)))]
        for _ in range(draw.choice((0, 1, 2))):
            parts += [draw.choice(shared), letters(draw, draw.choice((0, 1, 700)))]
        rows.append((i, "".join(parts)))
    base = letters(draw, 3000)
    rows += [(1000 + i, base[: 97 * i] + "#" + base[97 * i :]) for i in range(25)]  # near copies
    rows += [(2000 + i, base[50 * i : 50 * i + 600]) for i in range(20)] + [(3000, base), (3001, base), (3001, base)]
    return rows


@pytest.fixture(scope="module")
def shared(spark):
    return spark.createDataFrame(passages(1), "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_passages_in_batches(shared, batches):
    got = check(shared, batches)
    assert got[3000]["n_removed"] == 3000 and any(0 < r["n_removed"] < r["n_bytes"] for r in got.values())


def test_crowded_heads_are_told_apart_string_by_string(shared, monkeypatch):
    monkeypatch.setattr(s, "CROWDED_BYTES", 0)
    check(shared, 2)
    monkeypatch.setattr(s, "CROWDED_BYTES", 20_000)
    check(shared, 2)


def test_documents(docs):
    check(docs.select("doc_id", "text"))


def test_odd_rows(odd, nothing):
    got = check(odd)
    assert got[8]["n_removed"] == 5000  # one letter over and over: overlaps count
    assert s.dedup(nothing).count() == 0
    assert {"doc_id", "kept_text"} <= set(s.dedup(odd).columns)


def test_edges_and_characters_cut_in_two(spark):
    draw = random.Random(5)
    a = letters(draw, 400)
    rows = [(1, a), (2, "é" + a), (3, a[:399]), (4, a[1:] + "z"), (5, "日" * 140 + a[:5]), (6, "x" + "日" * 140), (7, None), (8, "")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1]["n_removed"] == 400 and got[2]["kept_text"] == "é" and got[4]["n_removed"] == 0 and got[5]["n_removed"] > 400


def test_levels_merge_geometrically(spark, shared):
    texts = s.whole_texts(shared, 8)
    index = s.Levels(spark)
    sizes = []
    for k in range(8):
        index.add(texts.where(F.col("batch") == k))
        sizes.append([n for n, _, _ in index.levels])
        assert all(a > 2 * b for a, b in zip(sizes[-1], sizes[-1][1:]))  # noqa: B905
    assert any(len(x) > 1 for x in sizes)
    for _, table, _ in index.levels:
        parts = table.select(F.spark_partition_id().alias("p"), "head", "body").collect()
        assert len({(r["head"], r["body"]) for r in parts}) == len(parts)


def test_entries_cover_every_string_once():
    draw = random.Random(3)
    texts = [letters(draw, n).encode() for n in (0, 399, 400, 401, 5000, 1)] + [b"ab" * 2000]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    head, first, last, owner = s.entries(data, offsets)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    want = np.concatenate([np.arange(a, b - 399) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a >= 400])
    assert (covered == want).all() and (offsets[owner] <= first).all() and (last + 400 <= offsets[owner + 1]).all()
    # equal strings elsewhere have the same head
    again, at, to, _ = s.entries(np.frombuffer(b"q" * 777 + texts[4], np.uint8), np.array([0, 777 + 5000]))
    of = {i: h for h, a, b in zip(head, first, last, strict=True) for i in range(a - offsets[4], b + 1 - offsets[4])}
    assert all(of[i - 777] == h for h, a, b in zip(again, at, to, strict=True) for i in range(max(a, 777), b + 1))


def test_ranks_order_the_suffixes():
    data = np.frombuffer(letters(random.Random(2), 600).encode() * 2, np.uint8)
    rank, value = s.ranks(data, 24), data.tobytes()
    n = len(value) - 24 + 1
    order = sorted({value[i : i + 24] for i in range(n)})
    assert [order.index(value[i : i + 24]) for i in range(n)] == np.unique(rank[:n], return_inverse=True)[1].tolist()
    assert (np.argsort(rank[:n], kind="stable") == np.argsort([order.index(value[i : i + 24]) for i in range(n)], kind="stable")).all()
