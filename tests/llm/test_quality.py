import re
from collections import Counter

import numpy as np

from dyadics.llm.quality import FROM, RULES, Estimates, Rule, Texts, estimate, filter_quality, ordered, quality_documents, verdicts


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z\x80-\U0010ffff]", text))
    n, chars, symbols, dups = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(covered) > 20 * n
    bad = failed or 100 * symbols > 40 * n or 100 * dups > 50 * len(lines) or 100 * upper > 60 * letters or 100 * n > 2000 * len(set(words)) or chars < 2 * n or chars > 25 * n
    return n, chars, symbols, dups, len(covered), failed, not bad


def check(docs):
    rows = quality_documents(docs).collect()
    want = sorted((str(r["doc_id"]), *base(r["text"])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), *r[1:]) for r in rows) == want
    return {r["doc_id"] for r in rows if r["kept"]}


def test_documents(docs):
    kept = check(docs)
    assert {r["doc_id"] for r in filter_quality(docs).collect()} == kept


def test_odd_rows(odd, nothing):
    check(odd)
    assert filter_quality(odd).columns == odd.columns
    assert quality_documents(nothing).count() == 0 and filter_quality(nothing).count() == 0


def test_repeats_and_lines(spark):
    texts = ["a b c d e " * 6, "x y z\nx y z\n\nx y z\n" * 5, "one two three four five six seven eight nine ten", "ab " * 300, "Y" * 40 + " " + " ".join("ABCDEFGHIJK")]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_order_by_rejection_per_cost(docs):
    found = estimate(docs)
    assert set(found.seconds) == set(FROM) and all(v >= 0 for v in found.seconds.values())
    assert sum(found.rejected.values()) == min(docs.count(), 500) and max(found.rejected) < 1 << len(RULES)
    assert sorted(ordered(found)) == sorted(r.name for r in RULES)


def test_order_counts_what_is_left_and_measures_once():
    rules = tuple(Rule(n, None, m) for n, m in (("a", ("n_words",)), ("b", ("n_words", "word_chars")), ("c", ("n_symbols",)), ("d", ("n_upper",))))
    seconds = {"words": 10.0, "n_words": 1.0, "word_chars": 1.0, "n_symbols": 5.0, "n_upper": 5.0}
    # d rejects most, but all of its texts after c has gone; once words are cut for a, b costs little
    found = Estimates(seconds, {0b0000: 50, 0b0100: 10, 0b1100: 20, 0b0001: 11, 0b0010: 9})
    assert ordered(found, rules) == ["c", "a", "b", "d"]


def test_each_rule_measures_only_what_is_left():
    seen = []

    def rule(name, limit):
        def rejects(texts):
            words = texts.get("n_words")
            seen.append((name, words.tolist()))
            return words < limit

        return Rule(name, rejects, ("n_words",))

    texts = ["a", "a b", "a b c", "a b c d"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    kept = verdicts(Texts(np.frombuffer(data, np.uint8), offsets), ["two", "three"], (rule("two", 2), rule("three", 3)))
    assert kept.tolist() == [False, False, True, True]
    assert seen == [("two", [1, 2, 3, 4]), ("three", [2, 3, 4])]


def test_measures_are_carried_over_when_texts_go():
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(list("ab é\n#X"), draw.integers(0, 60))) for _ in range(60)]
    data = [t.encode() for t in texts]
    whole = Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for m in FROM:
        whole.get(m)
    kept = draw.random(60) < 0.6
    part, left = whole.only(kept), [d for d, k in zip(data, kept, strict=True) if k]
    fresh = Texts(np.frombuffer(b"".join(left), np.uint8), np.cumsum([0, *map(len, left)]))
    for m in FROM:
        a, b = part.get(m), fresh.get(m)
        for x, y in zip(a, b, strict=True) if isinstance(a, tuple) else [(a, b)]:
            assert x.tolist() == y.tolist(), m


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1")
    rows = quality_documents(spark.read.parquet(f"{d}/documents.parquet")).where("NOT base_failed").join(labels, "doc_id").collect()
    assert sum(r["kept"] for r in rows) > 0.99 * len(rows)
