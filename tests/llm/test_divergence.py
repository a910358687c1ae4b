import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from dyadics.llm.divergence import audit, counted, joint, sized


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top=10):
    docs = [(a or "", b or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or "")))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update({t: words[t] for t in kept})
        whole = Counter()
        for c in counts.values():
            whole.update(c)

        def p(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(shares[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] > 0 and shares[s][t] > q[t]]
            out += [(lang, s, "pair", i, -v, k) for k, (v, _, i) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", i, -v, k) for k, (v, _, i) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def check(docs, least, top=10):
    got = sorted(tuple(r) for r in audit(docs, least, top).collect())
    assert got == brute([(r["lang"], r["source"], r["text"]) for r in docs.collect()], least, top)
    return got


def test_documents(docs):
    got = check(docs, 10)
    assert any(r[2] == "term" for r in got) and max(r[5] for r in got if r[2] == "term") == 10


def test_null_and_missing_groups(spark):
    rows = [
        ("en", "a", "The the THE cat É"), ("en", "b", "the dog é"), ("en", "b", "the cat\x00cat x1y"), ("en", "c", None), ("en", "d", "..."),
        ("en", None, "the cat dog"), (None, "a", "alone"), (None, "b", ""), ("de", "a", "nur hier"), ("", "z", "the alone"), ("en", "a", "The the THE cat É"),
    ]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit("clash") for c in ("term", "n", "value", "rank", "at", "terms", "v")})
    for least in (1, 2, 100):
        got = check(docs, least)
        assert {r[3] for r in got if r[:3] == ("en", "c", "pair")} == {"", "a", "b", "d"}
    assert all(r[4] == 0 and r[2] == "pair" for r in audit(docs, 100).collect())


def test_odd_rows(odd, nothing):
    check(odd, 1)
    assert audit(nothing).count() == 0


def test_histogram_holds_every_kept_term(docs):
    terms = counted(docs, 3)
    cells = joint(terms, sized(docs, terms)).collect()
    v = {r["lang"]: r["v"] for r in terms.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    total = Counter()
    for r in cells:
        assert r["terms"] >= 0 and r["a"] < r["b"]
        total[r["lang"], r["a"], r["b"]] += r["terms"]
    assert all(n == v.get(k[0], 0) for k, n in total.items())
