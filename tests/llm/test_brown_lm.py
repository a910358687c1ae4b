import math
import zlib
from collections import Counter

import numpy as np

from dyadics.llm import brown_lm
from dyadics.llm.brown_lm import score_documents


def check(docs):
    rows, counts = docs.collect(), Counter()
    words = lambda t: (t or "").encode().lower().split() + [None]
    for r in rows:
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10:
            counts.update(words(r["text"]))
    total, kinds = sum(counts.values()), len(counts)
    down = math.log10(total + 0.1 * (kinds + 1))
    want = sorted((r["doc_id"] or -1, len(words(r["text"])), sum(counts[w] > 0 for w in words(r["text"])), round(sum(math.log10(counts[w] + 0.1) - down for w in words(r["text"])), 5)) for r in rows)
    got = score_documents(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} <= {total}
    assert all(r["score"] <= 1e-9 and math.isfinite(r["score"]) for r in got)
    return got


def test_documents_beat_the_base_on_held_out_texts(docs):
    got = [r for r in check(docs) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_odd_rows(odd, nothing):
    check(odd)
    assert score_documents(nothing).count() == 0


def test_rare_words_meet_their_counts_in_the_join(docs, monkeypatch):
    monkeypatch.setattr(brown_lm, "LOOKED_UP", 50)
    check(docs)


def test_probabilities_sum_to_at_most_one(spark):
    texts = ["a b", "b a a", "a", "b b a"]
    rows = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    vocabulary = ["a", "b", "zz"]
    probe = [(100_000 + i, w) for i, w in enumerate(["", *vocabulary, *(f"{x} {y}" for x in vocabulary for y in vocabulary)])]
    held = [(i, t) for i, t in ((_held(n), t) for n, t in enumerate(t for _, t in probe))]
    got = score_documents(rows.unionByName(spark.createDataFrame(held, "doc_id long, text string"))).collect()
    assert sum(10 ** r["score"] for r in got if r["held_out"] and r["doc_id"] > 1000) <= 1 + 1e-9


def _held(n):
    """The n-th id above 1000 that is held out."""
    found = (i for i in range(1001, 10**6) if zlib.crc32(str(i).encode()) % 10 == 0)
    for _ in range(n):
        next(found)
    return next(found)


def test_least_count(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 1, 1, 2, 2, 5, 9)], "n long")
    assert [brown_lm._least_count(rows, k) for k in (1, 2, 4, 7)] == [9, 5, 2, 1]


def test_least_count_of_very_frequent_words(spark):
    rows = spark.createDataFrame([(2**21,), (2**22,), (2**23,), (2**40,)], "n long")
    assert [brown_lm._least_count(rows, k) for k in (1, 2, 4)] == [2**40, 2**23, 2**21]


def test_rare_words_of_one_suffix_go_by_their_contexts(spark):
    def key(w):
        data = np.frombuffer(w.encode(), np.uint8)
        word, suffix, _ = brown_lm.tokens(data, np.array([0, len(data)]))
        return int(brown_lm._named(word, suffix)[0])

    texts = ["the dog runs"] * 40 + ["on lane street"] * 40 + ["the aazz runs", "the aazz runs", "on bbzz street"]
    frequent = {key(w): c for w, c in {"the": 0, "dog": 1, "runs": 2, "on": 3, "lane": 4, "street": 5}.items()}
    label = np.full(brown_lm.UNITS, 6)
    label[: len(frequent)] = [frequent[w] for w in sorted(frequent)]
    label[brown_lm.END] = brown_lm.CLASSES
    training = spark.createDataFrame([(t,) for t in texts], "text string")
    named = np.array(sorted(frequent))
    after, _ = brown_lm.contexts(brown_lm.unit_pairs(training, named), label)
    table = np.zeros((brown_lm.CLASSES + 1,) * 2)
    np.add.at(table, label, after)
    got = {r["word"]: (r["n"], r["class"]) for r in brown_lm.rare_classes(training, named, label, table).collect()}
    assert got == {key("aazz"): (2, 1), key("bbzz"): (1, 4)}


def test_ties_leave_no_unit_unused(spark, monkeypatch):
    """More words of the same count than there are units: each unit gets one, whatever the order of the rows."""
    words = [f"w{i:05d}" for i in range(5_530)]
    rows = [(n * 3 + 1, " ".join(words[n * 79 : (n + 1) * 79])) for n in range(70)]
    docs = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 10], "doc_id long, text string")
    kinds = len({w for r in docs.collect() for w in r["text"].split()})
    assert kinds > brown_lm.FREQUENT
    chosen, pairs = [], brown_lm.unit_pairs
    monkeypatch.setattr(brown_lm, "unit_pairs", lambda training, frequent: chosen.append(frequent) or pairs(training, frequent))
    model, *_ = brown_lm.fit(docs)
    again, *_ = brown_lm.fit(docs.repartition(7))
    assert [len(f) for f in chosen] == [brown_lm.FREQUENT] * 2 and (chosen[0] == chosen[1]).all()
    assert len(model.looked_up) == kinds and (model.looked_up == again.looked_up).all() and (model.label == again.label).all()
    check(docs)


def test_units_beyond_the_table_of_looked_up_words(docs, monkeypatch):
    """A tie at the cut of the looked-up words keeps them out of its table; those that are units are added to it."""
    monkeypatch.setattr(brown_lm, "LOOKED_UP", 3)
    check(docs)


def test_what_has_not_settled_is_told(docs, monkeypatch):
    monkeypatch.setattr(brown_lm, "ROUNDS", 1)
    monkeypatch.setattr(brown_lm, "LEAST_GAIN", -1.0)
    assert {r["settled"] for r in score_documents(docs).collect()} == {False}
