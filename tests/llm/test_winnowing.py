import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from dyadics.llm.winnowing import BASE, LONGEST, PRIME, K, W, as_text, fingerprint_edits, neighbours, winnow


def grams(text):
    return {g.split(":")[0] for g in text.split()}


def check(rows, texts):
    """``texts``: doc_id to text, the least first text of repeated ids."""
    ids = sorted(texts)
    for row in rows:
        if row["doc_id"] is None:
            continue
        text = texts[row["doc_id"]] or ""
        after = texts[ids[(ids.index(row["doc_id"]) + 1) % len(ids)]] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = grams(row["fingerprint"]), grams(row["edited_fingerprint"])
        assert row["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_documents_against_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = fingerprint_edits(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    by = {r["doc_id"]: r for r in rows}
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        x, y = grams(by[a]["fingerprint"]), grams(by[b]["fingerprint"])
        assert by[a]["near_next"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_odd_rows(odd):
    rows = fingerprint_edits(odd).collect()
    assert len(rows) == 12
    check(rows, {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None})
    equal = {r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}
    assert len(equal) == 1
    lone = next(r for r in rows if r["doc_id"] is None)
    assert lone["near_next"] is None


def test_empty_table_and_single_row(spark, nothing):
    assert fingerprint_edits(nothing).count() == 0
    one = fingerprint_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def plain(text, k=K, w=W):
    """The fingerprint one window at a time, each gram's hash from its own tokens."""
    tokens = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        tokens += [word] if len(word) <= LONGEST else list(word)
    values = [xxhash.xxh64(t.encode(), seed=42).intdigest() >> 33 for t in tokens]
    if not values:
        return ""
    hashes = []
    for i in range(max(len(values) - k + 1, 1)):
        h = 0
        for v in (values[i : i + k] + [0] * k)[:k]:
            h = (h * BASE + v) % PRIME
        hashes.append(h)
    kept = []
    for at in range(max(len(hashes) - w + 1, 1)):
        least = min(hashes[at : at + w])
        kept.append(max(i for i in range(at, min(at + w, len(hashes))) if hashes[i] == least))
    return " ".join(f"{hashes[i]:X}:{i}" for i in dict.fromkeys(kept))


def test_grams_and_positions_against_brute_force(docs, odd):
    for rows in (docs, odd):
        want = {(r["doc_id"], plain(r["text"])) for r in rows.collect()}
        got = {(r["doc_id"], r["fingerprint"]) for r in fingerprint_edits(rows).collect()}
        assert got == want


@pytest.mark.parametrize("k, w", [(1, 1), (2, 3), (3, 5), (5, 8), (7, 4)])
def test_other_sizes_and_ties(spark, k, w):
    texts = [" ".join(f"w{i % m}" for i in range(n)) for m in (1, 2, 9) for n in (1, 2, 3, 6, 12, 60)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", as_text(winnow(F.col("text"), k, w)).alias("kept"))
    assert all(r["kept"] == plain(r["text"], k, w) for r in rows.collect())


def test_a_passage_without_spaces_is_found_at_any_offset(spark):
    draw = random.Random(1)
    passage = "".join(chr(0x4E00 + draw.randrange(2000)) for _ in range(40))
    before = "".join(chr(0x3041 + draw.randrange(80)) for _ in range(37))
    rows = spark.createDataFrame([(1, before + passage + "end" * 9), (2, "x" + passage + before)], "doc_id long, text string")
    a, b = (grams(r["fingerprint"]) for r in fingerprint_edits(rows).collect())
    assert len(a & b) >= 3


def test_rows_without_ids_are_spread(spark):
    rows = spark.createDataFrame([(None, f"text {i} of many words to fingerprint here") for i in range(50)] + [(-(2**63), "the least id there is")], "doc_id long, text string")
    out = fingerprint_edits(rows).collect()
    assert len(out) == 51 and all(r["near_next"] is None for r in out if r["doc_id"] is None)


def test_a_shared_passage_is_found(spark):
    shared = " ".join(f"s{i}" for i in range(W + K - 1))
    rows = spark.createDataFrame([(1, f"a b c {shared} d e"), (2, f"{shared} z y x w v u")], "doc_id long, text string")
    a, b = (grams(r["fingerprint"]) for r in fingerprint_edits(rows).collect())
    assert a & b


def test_neighbours_of_sparse_ids(spark):
    ids = [-(2**40), -5, 0, 1, 2, 3, 7, 1000, 10**15]
    rows = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, n_chars long")
    got = {r["doc_id"]: r["prev_id"] for r in neighbours(rows).collect()}
    assert got == {b: a for a, b in zip([ids[-1], *ids[:-1]], ids, strict=True)}
