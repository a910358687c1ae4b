import random

import numpy as np
import pytest

from dyadics.llm import near_dedup
from dyadics.llm.near_dedup import M, PERCENT, SLACK, deduplicate, likely, near_groups, promising, registers


def sets_of(rows):
    out = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        out.append((r["doc_id"], frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(rows):
    """Component of each id by comparing all pairs."""
    sets = [(i, s) for i, s in sets_of(rows) if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in root}


def check(docs):
    rows, want = docs.collect(), None
    want = brute(rows)
    got = near_groups(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, s in sets_of(rows):
        sizes[i] = len(s)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == sizes[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_documents(docs):
    check(docs)


def test_odd_rows(odd, nothing):
    check(odd)
    assert near_groups(nothing).count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    """A family of near copies about the threshold, exact copies, chains, and texts that share a passage."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = [" ".join(base)] * 40
    for _ in range(160):
        own = list(base)
        for _ in range(draw.randrange(1, 6)):
            own[draw.randrange(150)] = word()
        rows.append(" ".join(own))
    chain = list(base)
    for n in range(30):
        chain[(n * 5) % 150] = word()
        rows.append(" ".join(chain).upper())
    passage = [word() for _ in range(60)]
    rows += [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(40)]) for _ in range(60)]
    draw.shuffle(rows)
    return spark.createDataFrame([(1000 - i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def test_family_about_the_threshold(copies):
    check(copies)


def test_blocks_of_large_buckets(copies, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "SHINGLES_A_TASK", 500)
    check(copies)


def test_deduplicate_keeps_columns_and_the_least(copies, odd):
    want = brute(copies.collect())
    kept = {r["doc_id"] for r in deduplicate(copies).collect()}
    assert kept == {i for i, c in want.items() if i == c}
    assert deduplicate(odd).columns == odd.columns


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(1)
    x, y, both = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (300, 300, 2400))
    a, b = np.r_[x, both], np.r_[y, both]
    values = np.concatenate([a, b, np.unique(np.r_[a, b])])
    ends = np.r_[0, len(a), len(a) + len(b), len(values)]
    sketch = registers(values, ends)
    assert (np.maximum(sketch[0], sketch[1]) == sketch[2]).all()
    assert abs(likely(sketch[:1], sketch[1:2], np.array([2700]), np.array([2700]))[0] - 0.8) < 5 * (0.16 / M) ** 0.5


def templates(draw, many, own):
    """Texts that share a passage of 300 words and have ``own`` words of their own: alike, but not near."""
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(300)]
    rows = []
    for _ in range(many):
        tail = [word() for _ in range(own)]
        rows.append(" ".join(passage + tail))
        if draw.random() < 0.2:
            tail[draw.randrange(own)] = word()
            rows.append(" ".join(passage + tail))
    return rows


def test_crowded_buckets(spark, monkeypatch):
    """Hundreds of texts of one template fall into the same buckets; the rare shingles find the near ones among them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "ROWS_A_PARTITION", 200)
    prefixes, real = [], near_dedup._prefixes
    monkeypatch.setattr(near_dedup, "_prefixes", lambda own: prefixes.append(own) or real(own))
    draw = random.Random(3)
    rows = templates(draw, 150, 40) + templates(draw, 60, 70)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    check(docs)
    assert prefixes


@pytest.mark.parametrize("size", [40, 80, 160])
def test_blocks_are_bounded_and_all_pairs_meet(spark, monkeypatch, size):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = [(1, i, i) for i in range(size)] + [(1, 1000 + i, 5000) for i in range(50)]
    members = spark.createDataFrame(rows, "key long, id long, group long")
    reps = members.selectExpr("id", "1L AS n", "cast('' AS binary) AS sketch")
    bucket = near_dedup._buckets(members)
    assert bucket.collect() == [(1, 5000, size, 50)]
    rows = members.join(bucket, "key").selectExpr("*", "0 AS band", "true AS leads")
    blocks, met = {}, set()
    for r in near_dedup._dealt(rows, reps).collect():
        blocks.setdefault((r["key"], r["inside"], r["i"], r["j"]), []).append(r)
    assert max(map(len, blocks.values())) <= 4 * 16
    for (_, inside, i, j), part in blocks.items():
        guests, home = [r for r in part if r["guest"]], [r for r in part if not r["guest"]]
        for a in guests:
            for b in guests if inside and i == j else home:
                if a["group"] != b["group"]:
                    met.add(frozenset((a["id"], b["id"])))
    assert len(met) == size * (size - 1) // 2 + size * 50


def test_rows_that_repeat_an_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "a b c d e f g"), (5, text), (7, text + " x"), (9, text + " y"), (9, "q w e r t z u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(docs).collect())
    assert got == [(5, 3, 5, True), (5, 56, 5, True), (7, 57, 5, False), (9, 3, 9, True), (9, 57, 5, False)]
    assert sorted((r["doc_id"], r["text"]) for r in deduplicate(docs).collect()) == sorted([rows[0], rows[1], rows[4]])


def test_promising_pairs_are_those_of_the_estimate():
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 60_000, (2, 4000, M))
    same = draw.random((4000, M)) < draw.uniform(0.4, 1, (4000, 1))
    b = np.where(same, a, b)
    na = draw.integers(100, 1000, 4000)
    nb = (na * draw.uniform(0.86, 1 / 0.86, 4000)).astype(int)
    estimate, limit = likely(a, b, na, nb), PERCENT / 100 - SLACK
    clear = np.abs(estimate - limit) > 1e-3
    assert (promising(a, b, na, nb) == (estimate >= limit))[clear].all() and 0.2 < promising(a, b, na, nb).mean() < 0.8


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text, "x"), (1, text, "x"), (2, text + " more", "y"), (3, "alone here", "z"), (3, "alone here", "z"), (3, "other words", "q"), (None, text, "n"), (None, text, "n"), (4, "", "e"), (4, "", "e"), (4, None, "e"), (5, text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"] or "") for r in deduplicate(docs).collect())
    assert [g for g in got if g[0] == 1] == [(1, text)] and not [g for g in got if g[0] in (2, 5)]
    assert len([g for g in got if g[0] == -1]) == 2 and len([g for g in got if g[0] == 4]) == 3
    # two texts of one id that are no near duplicates of each other
    assert len([g for g in got if g[0] == 3]) == 2
