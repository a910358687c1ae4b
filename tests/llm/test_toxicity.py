import zlib

import numpy as np
import pytest

from dyadics.llm import toxicity
from dyadics.llm.toxicity import fit, held_out, labelled_sample, score, score_documents, train


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = np.array([r["toxic"] for r in rows])
    found = np.array([r["predicted"] for r in rows])
    assert (toxic == found).mean() > 0.95
    assert found[toxic == 1].mean() > 0.8 and found[toxic == 0].mean() < 0.04


def test_labels_of_held_out_rows_are_not_learnt(spark, docs, labels):
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic", "quality")
    a, b = fit(docs, labels), fit(docs, flipped)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_odd_rows(odd, nothing, docs, labels):
    rows = score_documents(odd, labels).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 7)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == (r["score"] >= 0.3)
    assert score_documents(nothing, labels).count() == 0
    assert score_documents(docs, labels.where("false")).count() == docs.count()


def test_extra_columns_stay(odd, labels):
    scored = score(odd, fit(odd, labels))
    assert set(scored.columns) == set(odd.columns)  # a column named toxic_score is replaced
    assert dict(scored.dtypes)["toxic_score"] == "double"


def test_misspellings_share_grams():
    clean = [f"plain words number {i} about a garden and a river" for i in range(300)]
    bad = [f"plain words number {i} about an {w} and a river" for i in range(100) for w in ("imbecilic", "imbeciles", "imbecile")]
    table, bias = train(clean + bad, np.array([0] * 300 + [1] * 300))
    import pyarrow as pa

    from dyadics.llm.text_arrays import chunks
    from dyadics.llm.toxicity import window_scores

    batch = pa.RecordBatch.from_arrays([pa.array(["plain words number 7 about an imbecill and a river", "about a garden and a river", ""])], names=["text"])
    _, data, offsets = next(chunks(batch))
    odd, good, empty = window_scores(table, bias, data, offsets)
    assert odd > 0.3 > good and 0 <= empty <= 1


@pytest.mark.parametrize("n", [0, 1, 5])
def test_too_few_labels(n):
    table, bias = train(["a b"] * n, np.zeros(n, int))
    assert not table.any() and bias <= 0


def test_the_sample_is_bounded_in_rows_and_in_bytes_a_row(spark, docs, labels, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 40)
    everything = labelled_sample(docs, labels).collect()
    assert max(sum(r["toxic"] == t for r in everything) for t in (0, 1)) <= 40
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT_BYTES", 500)
    fewer = labelled_sample(docs, labels).collect()
    assert {r["doc_id"] for r in fewer} == {r["doc_id"] for r in everything}
    assert all(len(r["windows"]) <= 500 for r in fewer) and any(len(r["windows"]) > 300 for r in fewer)
    assert labelled_sample(docs.unionByName(docs), labels).count() == len(fewer)
    whole = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    for r in fewer:
        got = r["windows"].decode().split()
        windows = [whole[r["doc_id"]][k : k + 8] for k in range(0, len(whole[r["doc_id"]]), 8)]
        assert all(got[k : k + 8] in windows for k in range(0, len(got), 8))


def test_words_are_cut_and_short_texts_are_whole():
    import pyarrow as pa

    from dyadics.llm.text_arrays import chunks

    texts = ["a b  c", "", "é" * 5000 + " end", None]
    _, data, offsets = next(chunks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])))
    assert toxicity.drawn(data, offsets) == [b"a b c", b"", "é".encode() * 32 + b" end", b""]


@pytest.mark.parametrize("kind", [0, 1])
def test_a_very_long_labelled_text_does_not_exclude_others(spark, kind):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    first = labels.where(~held_out("doc_id") & (F.col("toxic") == kind)).orderBy(F.xxhash64(F.lit(toxicity.SEED), "doc_id")).first()["doc_id"]
    filler = F.expr("concat_ws(' ', transform(sequence(1, 700000), i -> concat('w', i % 9000)))")
    longer = docs.withColumn("text", F.when(F.col("doc_id") == first, F.concat("text", F.lit(" "), filler)).otherwise(F.col("text")))
    assert longer.agg(F.max(F.octet_length("text"))).first()[0] > 3_000_000
    a, b = labelled_sample(docs, labels), labelled_sample(longer, labels)
    assert {r["doc_id"] for r in a.select("doc_id").collect()} == {r["doc_id"] for r in b.select("doc_id").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.where(held_out("doc_id")).collect()}

    def accuracy(rows):
        return np.mean([truth[r["doc_id"]] == r["predicted"] for r in rows if r["doc_id"] in truth])

    plain, odd = score_documents(docs, labels).collect(), score_documents(longer, labels).collect()
    assert len({round(r["score"], 9) for r in odd}) > 500
    assert abs(accuracy(plain) - accuracy(odd)) <= 0.05
