import hashlib

import public_tokenizers
import sentencepiece
from test_near_dedup import brute
from test_quality import base

import corpus_pipeline
from dyadics.llm import mixing, toxicity


def test_against_brute_force(spark, small_dir, docs, labels):
    rows = {r["doc_id"]: r for r in docs.collect()}
    table = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs, table).collect()}
    kept = [r for i, r in rows.items() if scores[i] < toxicity.THRESHOLD and base(r["text"])[-1]]
    roots = brute(kept)
    kept = [r for r in kept if roots[r["doc_id"]] == r["doc_id"]]
    left = spark.createDataFrame(kept, docs.schema)
    mixed = mixing.mix(left, labels, corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_CLEAN_SCALE, docs).collect()
    copies = {r["doc_id"]: r["copies"] for r in mixed}
    # no clean document goes; the fit has converged, and poor and toxic shares rise towards their targets
    clean = {r["doc_id"] for r in labels.where("quality = 1 AND toxic = 0").collect()} & set(copies)
    assert all(r["converged"] for r in mixed) and sum(copies[i] >= 1 for i in clean) > 0.97 * len(clean)
    shares = [[sum(r[rate] * r["tokens"] * r["posterior"][k] if rate else r["tokens"] * r["posterior"][k] for r in mixed) for k in range(3)] for rate in (None, "rate")]
    before, after = ([x / sum(row) for x in row] for row in shares)
    off = [sum(abs(x - corpus_pipeline.MIX_WEIGHTS[d]) for x, d in zip(row, mixing.DOMAINS, strict=True)) for row in (before, after)]
    assert off[1] < off[0]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], hashlib.sha256(",".join(map(str, library.encode(r["text"]))).encode()).hexdigest()) for r in kept for _ in range(copies[r["doc_id"]]))
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, small_dir).collect()) == want


def test_stages_keep_the_columns(spark, small_dir, docs, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small_dir).columns == docs.columns, name
        out = stage(spark, odd, small_dir)
        assert out.columns == odd.columns, name
        assert {r["toxic_score"] for r in out.collect()} <= {"clash"}, name
        assert stage(spark, odd.where("false"), small_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, small_dir).count() == 12
