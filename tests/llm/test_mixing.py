import math
from collections import Counter

import numpy as np
import pytest

from dyadics.llm import mixing
from dyadics.llm.mixing import BINS, DOMAINS, WEIGHTS, fit_rates, mix, resample


def least_squares(posterior, share, target):
    """The nonnegative rates of least squares by many plain projected steps."""
    p, w, r = np.array(posterior), np.array(share), np.ones(len(share))
    step = 1 / (np.linalg.eigvalsh((p * w[:, None]).T @ p).max() + mixing.RIDGE)
    for _ in range(40_000):
        r = np.maximum(0, r + step * (p @ (target - p.T @ (w * r)) - mixing.RIDGE * (r - 1)))
    return r


@pytest.mark.parametrize("weights", [{"clean": 0.94, "poor": 0.05, "toxic": 0.01}, {"clean": 0.6, "poor": 0.2, "toxic": 0.2}, {"clean": 0.2, "poor": 0.0, "toxic": 0.8}])
def test_rates_against_plain_least_squares(spark, weights):
    """With few groups some targets are out of reach; the rates are the nearest ones all the same."""
    draw = np.random.default_rng(2)
    for n, sharp in ((40, 1.0), (40, 0.2), (3, 1.0), (1, 1.0)):
        p = draw.dirichlet([4 * sharp, 1 * sharp, 0.3 * sharp], n)
        tokens = draw.integers(1, 10_000, n)
        rows = spark.createDataFrame([(i, x.tolist(), int(t)) for i, (x, t) in enumerate(zip(p, tokens, strict=True))], "id long, posterior array<double>, tokens long")
        got = sorted(fit_rates(rows, weights, 1.25).collect())
        share = tokens / tokens.sum()
        budget = 1.25 * (share * p[:, 0]).sum() / weights["clean"]
        target = budget * np.array([weights[d] for d in DOMAINS])
        rates = np.array([r["rate"] for r in got])
        totals = p.T @ (share * rates)
        assert len(got) == n and (rates >= 0).all() and got[0]["converged"]
        assert rates == pytest.approx(least_squares(p, share, target), abs=1e-3)
        assert got[0]["missed"] == pytest.approx(np.abs(totals - target).max() / budget, abs=1e-9)


def test_posteriors_against_plain_naive_bayes(spark, docs, labels):
    sample = mixing.measured(mixing.labelled(docs, labels)).drop("text")
    cues = mixing.cue_words(sample)
    train = mixing.binned(sample, cues).collect()
    counts = Counter((r["domain"], b, r[b]) for r in train for b in BINS)
    texts = Counter(r["domain"] for r in train)
    want = {}
    for r in mixing.binned(mixing.measured(docs), cues).collect():
        odds = []
        for d in DOMAINS:
            terms = [(counts[d, b, r[b]] + 0.5) / (texts[d] + 0.5 * (len(ends) + 1)) for b, ends in BINS.items()]
            odds.append((texts[d] + 1) / (sum(texts.values()) + 3) * math.prod(terms))
        want[r["doc_id"]] = [x / sum(odds) for x in odds]
    for r in mix(docs, labels).collect():
        assert r["posterior"] == pytest.approx(want[r["doc_id"]], abs=1e-9)


def test_a_class_without_labels(spark, docs, labels):
    rows = mix(docs, labels.where("toxic = 0")).collect()
    assert len(rows) == docs.count() and all(r["posterior"][2] < 0.5 for r in rows)


def test_targets_are_met(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = mix(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    total = sum(r["rate"] * r["tokens"] for r in rows)
    for k, name in enumerate(DOMAINS):
        assert sum(r["rate"] * r["tokens"] * r["posterior"][k] for r in rows) / total == pytest.approx(WEIGHTS[name], abs=3e-3)
    assert {(r["missed"] <= 3e-3, r["converged"]) for r in rows} == {(True, True)}
    expected, drawn = sum(r["rate"] for r in rows), sum(r["copies"] for r in rows)
    assert drawn == pytest.approx(expected, rel=0.05)


def test_clean_documents_stay(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    whole = spark.read.parquet(f"{d}/documents.parquet")
    docs = whole.join(labels.where("quality = 1 AND toxic = 0").select("doc_id"), "doc_id", "left_semi")
    rows = mix(docs, labels, {"clean": 0.985, "poor": 0.01, "toxic": 0.005}, training=whole).collect()
    assert sum(r["copies"] >= 1 for r in rows) > 0.97 * len(rows)


def test_odd_rows(odd, nothing, labels):
    rows = mix(odd, labels).collect()
    assert len(rows) == 12 and all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in rows)
    assert len({(r["rate"], r["copies"]) for r in rows if r["doc_id"] == 5}) == 1
    out = resample(odd, labels)
    assert out.columns == odd.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mix(nothing, labels).count() == 0 and resample(nothing, labels).count() == 0
    assert mix(odd, labels.where("false")).count() == 12
