import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

from dyadics.llm.sentencepiece_bpe import encode_documents  # noqa: E402

PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(rows, texts, library):
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), texts[r["doc_id"]][:50]
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_documents(docs, library):
    check(encode_documents(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()}, library)


def test_odd_rows(odd, nothing, library):
    rows = encode_documents(odd, PATH, with_ids=True).collect()
    assert len(rows) == 12
    check(rows, {r["doc_id"]: r["text"] for r in odd.collect()}, library)
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert encode_documents(nothing, PATH).count() == 0


def test_random_texts(spark, library):
    draw = random.Random(3)
    texts = ["".join(draw.choice("aabeth  inrs\n▁.é日𝄞1") for _ in range(draw.randrange(80))) for _ in range(1500)]
    texts += ["".join(draw.choice(["the", "in", "er", "  ", "th", "a", "   ", "ng", "aaaa"]) for _ in range(draw.randrange(60))) for _ in range(500)]
    texts += [" " * n for n in range(40)] + ["ab" * n for n in range(40)]
    rows = encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    check(rows, dict(enumerate(texts)), library)
