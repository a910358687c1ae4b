import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadics.operators import audit, behavior, concentration, consensus, estimate, framing, lowrank, pairing, resample, sampling, selection, windows

PAIR = "id int, side string, x int, p double"


def test_strict_join(spark):
    good = [(1, "X", 3, 0.2), (1, "Y", 3, 0.8)]
    join = lambda rows, mode="strict": pairing.joined(spark.createDataFrame(rows, PAIR), "id", "side", ["x", "p"], ["x"], ["p"], mode)
    assert join(good).select("x_x", "p_y").first() == (3, 0.8)
    for bad, rule in (([(1, "X", 3, 0.3)], "duplicate"), ([(2, "X", 3, 0.3)], "missing_y"), ([(2, "X", 3, 0.3), (2, "Y", 4, 0.3)], "mismatch_x"), ([(2, "X", 3, None), (2, "Y", 3, 0.3)], "no_p")):
        with pytest.raises(Exception, match=rule):
            join(good + bad).collect()
        assert join(good + bad, "inner").count() == (0 if rule == "duplicate" else 1)


def test_tie_rules_change_the_rates(spark):
    rows = [("m", *p, *q) for p, q, n in (((0.6, 0.4), (0.4, 0.6), 35), ((0.5, 0.5), (0.4, 0.6), 9), ((0.4, 0.6), (0.6, 0.4), 30), ((0.4, 0.6), (0.5, 0.5), 12), ((0.4, 0.6), (0.4, 0.6), 9804)) for _ in range(n)]
    pairs = spark.createDataFrame(rows, "m string, p_yes_x double, p_no_x double, p_yes_y double, p_no_y double")
    assert behavior.rates(pairs, ["m"], "no").first()["consistency"] == pytest.approx(65 / 9890)
    assert behavior.rates(pairs, ["m"], "yes").first()["consistency"] == pytest.approx(86 / 9890)
    cells = {r["x_choice"]: (r["yes"], r["tie"], r["no"]) for r in behavior.matrix(pairs, ["m"]).collect()}
    assert cells == {"Yes": (0, 0, 35), "tie": (0, 0, 9), "No": (30, 12, 9804)}


def test_guardrails_over_nothing(spark):
    row = behavior.guardrails(spark.createDataFrame([("m", 0.1, 0.9, 0.2, 0.8, None)], "m string, p_yes_x double, p_no_x double, p_yes_y double, p_no_y double, a string"), ["m"], "a").first()
    assert row["n"] == 1 and np.isnan(row["joint_anchored_success"])


def test_running_ids(spark):
    lists = spark.createDataFrame([(7, [5, 6]), (5000, [1]), (-3, []), (90_000, [2, 3, 4])], "at long, codes array<int>")
    got = sorted((r["case_id"], r["at"], r["code"]) for r in sampling.cases(lists, "at").collect())
    assert got == [(1, 7, 5), (2, 7, 6), (3, 5000, 1), (4, 90_000, 2), (5, 90_000, 3), (6, 90_000, 4)]


def test_sampler_keeps_pairs_whole(spark):
    rows = sampling.batches(spark.range(103).withColumnRenamed("id", "pair"), "pair", 1, 0, 4, 3, ranks=2).collect()
    assert len(rows) == 12 * 8 * 3
    seen = {(r["batch"], r["rank"], r["slot"]): r["pair"] for r in rows}
    assert len(seen) == 96 == len(set(seen.values())) and {k[2] for k in seen} == {0, 1, 2, 3}
    again = sampling.batches(spark.range(103).withColumnRenamed("id", "pair"), "pair", 1, 1, 4, 1, ranks=2).collect()
    assert [r["pair"] for r in again] != [r["pair"] for r in rows if r["repeat"] == 0]


def test_trailing_mean_has_no_look_ahead(spark):
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate([0.0, 0.0, 0.0, 10.0, 0.0, float("nan")])], "r string, s int, v double")
    got = [r["smoothed"] for r in windows.trailing_mean(rows, ["r"], ["s"], "v", 3).orderBy("s").collect()]
    assert got == pytest.approx([0, 0, 0, 10 / 3, 10 / 3, 5])


def test_gaps_and_duplicates(spark):
    rows = spark.createDataFrame([("r", 10, 1.0), ("r", 20, float("inf")), ("r", 20, 2.0), ("r", 50, float("nan"))], "r string, s int, v double")
    assert tuple(windows.step_audit(rows, "r", "s", "v", 10).first()) == ("r", 4, 3, 1, 2, 2)
    assert sorted(r["s"] for r in windows.missing_steps(rows, "r", "s", 10).collect()) == [30, 40]


def test_framing_drops_incomplete_pairs(spark):
    schema = "s int, p double, f string, y double, h string, d string"
    rows = [(1, 0.5, "positive", 0.7, "Yes", "a"), (1, 0.5, "negative", 0.2, "No", "a"), (1, 0.6, "positive", 0.7, "Yes", "a")]
    pairs = framing.pairs(spark.createDataFrame(rows, schema), ["s"], "p", "f", "y", "h", ["d"])
    row = framing.summary(pairs).first()
    assert row["complete_pairs"] == 1 and row["classical_flip_rate"] == 1 and row["mean_gap"] == pytest.approx(-0.5)
    nothing = framing.summary(framing.pairs(spark.createDataFrame([], schema), ["s"], "p", "f", "y", "h", ["d"])).first()
    assert nothing["complete_pairs"] == 0 and nothing["mean_gap"] is None


GRID = "run string, step int, lambda double, lambda_se double, eta double, eta_se double, consistency double"


def grid(change=None, skip=()):
    rows = {s: ["r", s, 1.0, 0.1, 1.0, 0.1, 0.7] for s in selection.GRID if s not in skip}
    for step, values in (change or {}).items():
        rows[step] = ["r", step, *values]
    return [tuple(v) for v in rows.values()]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (grid({6000: (0.1, 0.1, 0.0, 0.1, 0.7)}), 6000),
        (grid({6000: (0.1, 0.1, 0.0, 0.1, 0.7), 4000: (0.12, 0.1, 0.0, 0.1, 0.8)}), 4000),
        (grid({6000: (0.1, 0.1, 0.0, 0.1, 0.79), 4000: (0.12, 0.1, 0.0, 0.1, 0.8), 8000: (0.13, 0.1, 0.0, 0.1, 0.8)}), 4000),
        (grid({6000: (0.0, 0.1, 0.0, 0.1, 0.4), 8000: (0.3, 0.1, 0.0, 0.1, 0.6)}), 8000),
        (grid({6000: (0.0, float("nan"), 0.0, 0.1, 0.9), 8000: (0.3, 0.1, 0.0, 0.1, 0.6)}), 8000),
        (grid({500: (0.0, 0.1, 0.0, 0.1, 0.9), 2000: (0.3, 0.1, 0.0, 0.1, 0.6)}), 2000),
        (grid(skip=(4000,)), None),
    ],
)
def test_selection_rules(spark, rows, want):
    assert selection.select(spark.createDataFrame(rows, GRID), ["run"]).first()["selected_step"] == want


def test_replication(spark):
    rows = spark.createDataFrame([(1, True, True), (2, True, False), (3, None, False)], "seed int, a boolean, b boolean")
    assert {r["seed"]: r["status"] for r in selection.replication(rows, "seed", ["a", "b"]).collect()} == {1: "PASS", 2: "FAIL", 3: "PENDING"}


def test_bootstrap_covers_the_mean(spark):
    draw = np.random.default_rng(2)
    rows = [(int(c), float(draw.normal(c % 3, 1))) for c in range(60) for _ in range(4)]
    frame = spark.createDataFrame(rows, "c int, v double")
    sums = resample.clusters(frame, ["c"], "v")
    row = resample.interval(resample.mean_replicates(sums, 60, 400, 5)).first()
    mean = np.mean([v for _, v in rows])
    by = np.array([np.mean([v for c, v in rows if c == k]) for k in range(60)])
    assert row["low"] < mean < row["high"] and row["sd"] == pytest.approx(by.std() / 60**0.5, rel=0.2)
    jack = resample.jackknife(sums).first()
    assert jack["variance"] == pytest.approx(by.var(ddof=1) / 60, rel=0.05)


def test_consensus_and_modal(spark):
    rows = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.0), (1, "c", 0.5), (2, "a", -1.0), (2, "b", 1.0)], "id int, m string, d double")
    got = {r["id"]: (r["models"], r["unanimous_sign"]) for r in consensus.consensus(rows, "id", "m", "d").collect()}
    assert got == {1: (3, True), 2: (2, False)}
    ties = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "g int, v string, o int")
    assert consensus.modal(ties, ["g"], "v", "o").first()["modal"] == "b"


def test_nearest_rank(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    got = {r["share"]: r["value"] for r in consensus.nearest_rank_quantiles(rows, "v", [0.0, 0.25, 0.5, 0.95]).collect()}
    assert got == {0.0: 0, 0.25: 2, 0.5: 5, 0.95: 9}
    assert consensus.nearest_rank_quantiles(rows.where("v > 99"), "v", [0.5]).count() == 0


@pytest.mark.parametrize("missing", ["null", "skip", "error"])
def test_missing_utilities(spark, missing):
    cases = spark.createDataFrame([(1, 0, 1, 0, 0, 0, 0), (2, 0, 9, 0, 0, 0, 0)], "case_id int, x_num int, y_num int, i int, j int, k int, l int")
    table = spark.createDataFrame([(0, 0, 0, 2.0), (1, 0, 0, 1.0)], "idx int, a1 int, a2 int, utility double")
    out = consensus.with_utilities(cases, table, missing)
    if missing == "error":
        with pytest.raises(Exception, match="no utility"):
            out.collect()
    else:
        assert out.count() == {"null": 2, "skip": 1}[missing]


def test_concentration(spark):
    rows = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 0.0), ("g", 3, 0.0), ("g", 4, 8.0)], "g string, k int, v double")
    assert concentration.gini(rows, ["g"], "v").first()["gini"] == pytest.approx(0.75)
    assert tuple(concentration.top_share(rows, ["g"], "v", 1, 0.5).first()[1:]) == (1.0, 1.0)
    row = spark.createDataFrame([([3.0, 1.0, 0.0],)], "s array<double>").select(concentration.stable_rank(F.col("s")), concentration.entropy_rank(F.col("s")), concentration.energy_kept(F.col("s"), 1), concentration.rank_for_energy(F.col("s"), 0.95)).first()
    p = np.array([0.9, 0.1])
    assert tuple(row) == pytest.approx((10 / 9, np.exp(-(p * np.log(p)).sum()), 0.9, 2))


def test_average_ranks_in_blocks(spark):
    draw = np.random.default_rng(5)
    values = [float(x) for x in draw.integers(0, 400, 3000)]
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    got = {r["i"]: r["r"] for r in windows.average_rank(rows, ["g"], "v", "r").collect()}
    order = sorted(values)
    for i, v in enumerate(values):
        first = order.index(v) if i < 50 else None
        if first is not None:
            assert got[i] == first + (order.count(v) + 1) / 2
    shares = {r["i"]: (r["rank"], r["cum_share"]) for r in windows.cumulative_share(rows, ["g"], "v", "i").collect()}
    want = sorted(range(3000), key=lambda i: (-values[i], i))
    running = np.cumsum([values[i] for i in want]) / sum(values)
    assert all(shares[i] == (n + 1, pytest.approx(running[n])) for n, i in enumerate(want))


def test_blocks_do_not_depend_on_the_order_of_rows(spark):
    from dyadics.operators import ordered

    values = F.when(F.col("id") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("g"), F.col("id").alias("i"), (F.xxhash64("id") % 100_003 / 7.0).alias("v")
    rows = spark.range(120_000).select(*values)
    one, two = (ordered.blocks(rows.repartition(n, F.col("v") % n), ["g"], "v") for n in (3, 11))
    blocks = one.join(two.select("i", F.col("_block").alias("_other")), "i").groupBy("g", "_block").agg(F.count_if(F.col("_block") != F.col("_other")).alias("differ"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    for group in "ab":
        got = blocks.where(F.col("g") == group).orderBy("_block").collect()
        assert not sum(b["differ"] for b in got)
        assert sum(b["n"] for b in got) == 60_000 and len(got) > 200 and max(b["n"] for b in got) < 1_500
        assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:], strict=False))


def test_low_rank_equals_dense(spark):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=(2, 5)).tolist(), draw.normal(size=(4, 2)).tolist()) for i in range(3)]
    f = spark.createDataFrame(rows, "id int, A array<array<double>>, B array<array<double>>")
    dense = {i: np.array(b) @ np.array(a) for i, a, b in rows}
    for r in lowrank.module_table(f, ["id"], 2.0).collect():
        s = np.linalg.svd(2 * dense[r["id"]], compute_uv=False)
        assert r["fro"] == pytest.approx(np.linalg.norm(2 * dense[r["id"]])) and r["singular"][:2] == pytest.approx(s[:2])
    other = f.withColumn("id", 2 - F.col("id"))
    for r in lowrank.compare(f, other, ["id"]).collect():
        x, y = dense[r["id"]], dense[2 - r["id"]]
        assert r["cosine"] == pytest.approx((x * y).sum() / np.linalg.norm(x) / np.linalg.norm(y)) and r["difference"] == pytest.approx(np.linalg.norm(x - y), abs=1e-6)


def panel(draw, n=4000, items=6, lam=0.8, eta=-0.3):
    alpha, beta = np.r_[0, draw.normal(0, 0.4, items - 1)], np.r_[0, draw.normal(0, 0.3, 8)]
    own, other = draw.integers(0, items, n), draw.integers(0, items, n)
    a, b = draw.integers(0, 9, n), draw.integers(0, 9, n)
    z = (1 + lam) * np.exp(alpha[own] + beta[a]) - np.exp(alpha[other] + beta[b]) + eta
    rows = [(int(o), int(p), int(q), int(r), float(y)) for o, p, q, r, y in zip(own, a, other, b, 1 / (1 + np.exp(-z)), strict=True)]
    return rows, np.r_[lam, eta, alpha[1:], beta[1:]]


@pytest.mark.parametrize("kind", ["nls", "mle"])
def test_structural_fit_recovers(spark, kind):
    rows, truth = panel(np.random.default_rng(4))
    frame = spark.createDataFrame(rows, "own_item int, own_profile int, other_item int, other_profile int, p_no double").repartition(3)
    got = estimate.fit(frame, 6, kind)
    assert got.values == pytest.approx(truth, abs=2e-3) and got.converged
    assert [r["parameter"] for r in got.table(spark).collect()][:3] == ["lambda", "eta", "alpha_2"]


def test_lambda_eta_recovers(spark):
    draw = np.random.default_rng(1)
    vx, vy = np.exp(draw.normal(0, 0.5, 300)), np.exp(draw.normal(0, 0.5, 300))
    p = [1 / (1 + np.exp(-(1.7 * a - b + 0.4))) for a, b in ((vx, vy), (vy, vx))]
    frame = spark.createDataFrame([("m", *map(float, r)) for r in zip(vx, vy, *p, strict=True)], "m string, u_x double, u_y double, p_no_x double, p_no_y double")
    row = estimate.lambda_eta(frame, ["m"]).first()
    assert (row["lambda"], row["eta"]) == pytest.approx((0.7, 0.4), abs=1e-5) and row["multistart_sd"] < 1e-4


def test_ols_with_clusters(spark):
    draw = np.random.default_rng(3)
    g, x = np.repeat(np.arange(40), 5), draw.normal(size=200)
    y = 1 + 2 * x + np.repeat(draw.normal(size=40), 5) + draw.normal(size=200)
    frame = spark.createDataFrame([(int(a), 1.0, float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)], "g int, one double, x double, y double")
    got = estimate.ols(frame, ["one", "x"], "y", ["g"])
    design = np.c_[np.ones(200), x]
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    e, bread = y - design @ beta, np.linalg.inv(design.T @ design)
    scores = np.array([design[g == k].T @ e[g == k] for k in range(40)])
    want = 40 / 39 * 199 / 198 * bread @ scores.T @ scores @ bread
    assert got.values == pytest.approx(beta) and got.covariance == pytest.approx(want)


def test_audits(spark):
    lists = spark.createDataFrame([(1, 2, [0, 1]), (2, 1, [0, 81]), (1, 2, [3, 3])], "x int, y int, codes array<int>")
    found = {(r["x"], r["y"], r["rule"]) for r in audit.bad_cases(lists, 100, 2).collect()}
    assert found == {(2, 1, "pair out of order or range"), (2, 1, "code out of range"), (1, 2, "repeated code"), (1, 2, "repeated pair")}
    with pytest.raises(audit.AuditError, match="lists"):
        audit.require(audit.bad_cases(lists, 100, 2), "lists")
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, float("nan"))], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, 2.1), (3, float("nan")), (4, 0.0)], "k int, v double")
    assert {(r["k"], r["kind"]) for r in audit.differences(a, b, ["k"], "v").collect()} == {(2, "value"), (4, "right only")}
    assert audit.infinite(spark.createDataFrame([(1.0, float("-inf"))], "a double, b double"), ["a", "b"]).collect() == [("b", 1)]
