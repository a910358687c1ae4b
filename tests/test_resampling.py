import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadics.operators import estimate, ordered, resample


def test_counts_follow_the_multinomial_law(spark):
    """Three items of two values: the mean of a replicate is 0, 1/3, 2/3 or 1 with binomial chances."""
    rows = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (None,)], "v double")
    reps = 20_000
    got = Counter(round(r["estimate"] * 3) for r in resample.count_replicates(rows, "v", reps, 3).collect())
    want = [reps * math.comb(3, k) * (1 / 3) ** k * (2 / 3) ** (3 - k) for k in range(4)]
    assert sum(got.values()) == reps
    assert sum((got[k] - w) ** 2 / w for k, w in enumerate(want)) < 16.3  # 0.1 % of the chi-square law with 3 degrees


def test_counts_over_groups_have_the_same_law(spark, monkeypatch):
    monkeypatch.setattr(resample, "VALUES_A_GROUP", 10)
    draw = np.random.default_rng(1)
    values = np.round(draw.gamma(2, 3, 3_000), 1)
    rows = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = np.array([r["estimate"] for r in resample.count_replicates(rows, "v", 2_000, 5).collect()])
    assert len(got) == 2_000
    error = values.std() / math.sqrt(len(values))
    assert abs(got.mean() - values.mean()) < 4 * error / math.sqrt(2_000)
    assert abs(got.std() / error - 1) < 0.08
    again = sorted(r["estimate"] for r in resample.count_replicates(rows, "v", 2_000, 5).collect())
    assert again == pytest.approx(sorted(got.tolist()), abs=1e-12)


def test_counts_cost_no_rows(spark):
    """A thousand million items of three values are drawn as fast as three."""
    rows = spark.range(3).select((F.col("id") - 1).cast("double").alias("v"))
    many = spark.range(0, 1_000_000, numPartitions=4).select(F.pmod("id", F.lit(3)).alias("id")).select((F.col("id") - 1).cast("double").alias("v"))
    plan = resample.count_replicates(many, "v", 100, 1)
    assert plan.count() == 100 and resample.count_replicates(rows, "v", 100, 1).count() == 100
    assert resample.count_replicates(rows.where("v > 5"), "v", 100, 1).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_places_are_a_dense_order_of_any_keys(spark, monkeypatch, ranges):
    monkeypatch.setattr(ordered, "KEY_RANGES", ranges)
    rows = spark.range(3_000).select(F.concat(F.lit("k"), F.pmod(F.col("id") * 7919, F.lit(40))).alias("a"), F.when(F.col("id") % 50 != 0, F.col("id")).alias("b"), "id").distinct()
    got = ordered.places(rows, ["a", "b", "id"]).collect()
    key = lambda r: (r["a"], r["b"] is not None, r["b"] or 0, r["id"])
    assert [r["ix"] for r in sorted(got, key=key)] == list(range(3_000))
    assert ordered.places(rows.where("false"), ["a", "b"]).count() == 0


def test_no_window_goes_over_all_clusters(spark):
    rows = spark.range(500).select((F.col("id") % 50).alias("g"), F.col("id").cast("double").alias("v"))
    plan = resample.clusters(rows, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line:  # a window without a partition orders the ranges' sizes alone
            assert "_range" in line


def test_sums_go_up_a_tree(spark, monkeypatch):
    monkeypatch.setattr(estimate, "FAN_IN", 3)
    parts = spark.range(50, numPartitions=20).select(F.spark_partition_id().cast("long").alias("part"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("a"))
    assert estimate._total(parts).tolist() == [sum(range(50)), 50]


def _panel(spark, binary):
    draw = np.random.default_rng(4)
    rows = []
    for case in range(3_000):
        x, y, p, q = draw.integers(0, 3), draw.integers(3, 6), draw.integers(0, 9), draw.integers(0, 9)
        a, b = draw.random(2)
        rows += [(case, int(x), int(p), int(y), int(q), float(a < 0.6) if binary else float(a)), (case, int(y), int(q), int(x), int(p), float(b < 0.4) if binary else float(b))]
    return spark.createDataFrame(rows + [(9_999, 0, 0, 3, 0, None)], "case_id long, own_item long, own_profile long, other_item long, other_profile long, p_no double")


def test_joint_cells_keep_both_answers_of_a_case(spark):
    panel = _panel(spark, True)
    got = estimate.joint_cells(panel, "case_id").collect()
    want = Counter()
    for rows in panel.where("p_no IS NOT NULL").toPandas().groupby("case_id"):
        want[tuple(sorted(map(tuple, rows[1].drop(columns="case_id").to_numpy().tolist())))] += 1
    assert Counter({tuple(tuple(map(float, a)) for a in r["answers"]): r["cases"] for r in got}) == Counter({tuple(tuple(map(float, a)) for a in k): n for k, n in want.items()})
    assert len(got) < 3_000  # cases of equal answers are one


def test_a_replicate_weighs_both_answers_alike():
    cell, of, at, p = np.array([[0, 0, 1, 0], [1, 0, 0, 0]]), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([0.2, 0.7, 0.4, 0.9])
    table = estimate._drawn_cells(cell, of, at, p, np.array([3, 1]))
    assert table["n"].tolist() == [4, 4] and table["p_no"].tolist() == pytest.approx([(3 * 0.2 + 0.4) / 4, (3 * 0.7 + 0.9) / 4])
    assert table["rest"].tolist() == pytest.approx([3 * 0.04 + 0.16 - 4 * 0.25**2, 3 * 0.49 + 0.81 - 4 * 0.75**2])
    assert len(estimate._drawn_cells(cell, of, at, p, np.array([0, 0]))) == 0


@pytest.mark.parametrize("binary", [True, False])
def test_both_ways_of_drawing_scores_agree(spark, monkeypatch, binary):
    panel = _panel(spark, binary)
    found = estimate.smoothed_maximum_score(panel, 6)
    one = {r["parameter"]: r for r in estimate.bootstrap_errors(panel, found, 6, found.width, reps=60).collect()}
    monkeypatch.setattr(estimate, "JOINT_ROWS", 5)
    two = {r["parameter"]: r for r in estimate.bootstrap_errors(panel, found, 6, found.width, reps=60).collect()}
    assert one.keys() == two.keys() and all(r["reps"] + r["failures"] == 60 for r in [*one.values(), *two.values()])
    ratio = np.median([one[p]["std_err"] / two[p]["std_err"] for p in one if one[p]["std_err"]])
    assert 0.7 < ratio < 1.4


def test_a_fit_that_stalls_has_not_converged():
    """An objective that no step lowers although its gradient says otherwise; and one at its least."""
    info, free = np.eye(2), np.arange(2)

    def rising(theta):
        return info, np.ones(2), 1.0 + float(np.abs(theta).sum()), 5.0

    *_, ended, _ = estimate._descend(rising, np.zeros(2), free, {}, 200, 1e-8)
    assert ended == "stalled" and ended not in estimate.CONVERGED

    def least(theta):
        return info, np.full(2, 1e-9), 1.0 + float(np.any(theta != 0)), 5.0

    *_, ended, _ = estimate._descend(least, np.zeros(2), free, {}, 200, 1e-8)
    assert ended == "gradient"
    assert estimate.flat(info, np.array([-1.0, 0.0]), free, np.zeros(2), {0: (0.0, 1.0)}, 1.0, 1e-8)  # a bound stops it


def test_two_parameter_fits_tell_a_stall_from_the_least():
    v = np.array([1.0, 2.0, 0.5])
    p = 1 / (1 + np.exp(-(1.5 * v - v[::-1] - 0.2)))
    q = 1 / (1 + np.exp(-(1.5 * v[::-1] - v - 0.2)))
    lam, eta, cost, ok, _ = estimate.two_parameter_fits(v, v[::-1], p, q, np.ones((1, 3)))
    assert ok[0] and lam[0] == pytest.approx(0.5, abs=1e-5) and eta[0] == pytest.approx(-0.2, abs=1e-5)
    *_, ok, _ = estimate.two_parameter_fits(v, v[::-1], p, q, np.ones((1, 3)), iterations=1)
    assert not ok[0]


def test_a_derangement_pairs_no_module_with_itself(spark):
    from dyadics.operators import lowrank

    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(size=(2, 5)).tolist(), draw.normal(size=(6, 2)).tolist()) for k in range(41)]
    factors = spark.createDataFrame(rows, "k int, A array<array<double>>, B array<array<double>>")
    got = {r["k"]: r for r in lowrank.permuted_cosines(factors, "k", 3).collect()}
    assert len(got) == 41 and sorted(r["other"] for r in got.values()) == list(range(41)) and all(k != r["other"] for k, r in got.items())
    for k, r in got.items():
        x, y = (np.array(rows[i][2]) @ np.array(rows[i][1]) for i in (k, r["other"]))
        assert r["cosine"] == pytest.approx(float((x * y).sum() / np.linalg.norm(x) / np.linalg.norm(y)))
    again = {r["k"]: r["other"] for r in lowrank.permuted_cosines(factors.repartition(7), "k", 3).collect()}
    assert again == {k: r["other"] for k, r in got.items()}


def test_recovery_on_a_given_design(spark):
    draw = np.random.default_rng(1)
    design = spark.createDataFrame([(float(a), float(b), int(n)) for a, b, n in zip(draw.gamma(4, 0.4, 60), draw.gamma(4, 0.4, 60), draw.integers(5, 60, 60), strict=True)], "u_x double, u_y double, weight long")
    rows = estimate.recovery(spark, [(0.3, -0.4), (1.5, 0.2)], reps=60, boots=80, seed=4, design=design).collect()
    for r in rows:
        assert r["reps"] == 60 and r["failures"] == 0
        assert abs(r["bias_lambda"]) < 4 * r["sd_lambda"] / math.sqrt(60) + 0.05 and abs(r["bias_eta"]) < 0.1
        assert r["coverage_lambda"] > 0.8 and r["coverage_eta"] > 0.8 and not r["weak_identification"]
    with pytest.raises(ValueError, match="design"):
        estimate.DESIGN_ROWS, old = 5, estimate.DESIGN_ROWS
        try:
            estimate.recovery(spark, [(0.3, 0.0)], reps=1, design=design)
        finally:
            estimate.DESIGN_ROWS = old


@pytest.mark.parametrize(("most", "at_once"), [(20_000, 10**6), (20_000, 0), (3, 0)])
def test_percentiles_by_counting_are_exact(spark, monkeypatch, most, at_once):
    monkeypatch.setattr(ordered, "SOUGHT", most)
    monkeypatch.setattr(ordered, "COUNTED_AT_ONCE", at_once)
    draw = np.random.default_rng(8)
    groups = {
        "normal": draw.normal(size=999), "wide": np.exp(draw.normal(0, 40, 500)) * draw.choice([-1, 1], 500), "same": np.full(50, 0.1), "two": np.array([1.0, 2.0]), "one": np.array([-3.5]),
        "close": 1 + draw.integers(0, 5, 400) * 2.0**-52, "zeros": np.array([0.0, -0.0, 0.0, 5e-324, -5e-324]), "ties": draw.integers(-3, 4, 700).astype(float), "odd": np.array([-np.inf, 1.0, 2.0, np.inf, 3.0]),
    }
    rows = spark.createDataFrame(pd.DataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None)], columns=["g", "v"])).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    shares = {"low": 0.025, "half": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}
    got = {r["g"]: r for r in ordered.percentiles(rows, ["g"], "v", shares).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        ordered_ = np.sort(xs)
        for name, share in shares.items():
            at = (len(xs) - 1) * share
            lo, hi = ordered_[math.floor(at)], ordered_[math.ceil(at)]
            want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
            assert got[g][name] == want or np.isclose(got[g][name], want, rtol=1e-15, atol=0) or (np.isnan(want) and np.isnan(got[g][name])), (g, name)
    whole = ordered.percentiles(rows.where("g = 'ties'"), [], "v", {"half": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["half"] == np.median(groups["ties"])
    assert ordered.percentiles(rows.where("false"), ["g"], "v", shares).count() == 0


def test_numbers_of_many_draws_are_those_of_the_generator(spark):
    import hashlib

    from dyadics.functions.codes import hash_uniform, hash_uniforms
    from dyadics.operators.resample import _first_number

    for prefix, begin, end in [("11:3:", 0, 1_234), ("7:1999:", 99_990, 100_020), ("123456:1:", 8_190, 20_000), ("11:1:", 9_999_999, 10_000_003)]:
        got = np.concatenate(list(hash_uniforms(prefix, begin, end)))
        assert got.tolist() == [int(hashlib.md5(f"{prefix}{k}".encode()).hexdigest()[:8], 16) for k in range(begin, end)]
    assert next(hash_uniforms("11:5:", 17, 18))[0] == spark.range(1).select(hash_uniform(11, 5, 17)).first()[0]
    for n in (1, 3, 1_000, 18_000_001):
        for place in {0, 1, n // 2, n - 1, n}:
            first = _first_number(place, n)
            assert first == 2**32 or int(float(first * n) / 2.0**32) >= place
            assert first == 0 or int(float((first - 1) * n) / 2.0**32) < place


def test_rank_correlation_of_equal_rows_is_that_of_all_rows(spark):
    from dyadics.operators import windows

    draw = np.random.default_rng(3)
    table = pd.DataFrame({"g": draw.integers(0, 3, 4_000), "a": draw.integers(0, 9, 4_000) / 2.0})
    table["b"] = table["a"] + draw.integers(0, 40, 4_000)
    got = {r["g"]: r["spearman"] for r in windows.rank_correlation(spark.createDataFrame(table), ["g"], "a", "b").collect()}
    for g, own in table.groupby("g"):
        assert got[g] == pytest.approx(own["a"].rank().corr(own["b"].rank()), abs=1e-12)
    odd = spark.createDataFrame([(1, 1.0, None), (1, None, 2.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (2, 3.0, None)], "g int, a double, b double")
    assert {r["g"]: r["spearman"] for r in windows.rank_correlation(odd, ["g"], "a", "b").collect()} == {1: None, 2: pytest.approx(1.0)}


def test_errors_of_a_large_table_do_not_depend_on_how_it_is_dealt(spark, monkeypatch):
    panel = _panel(spark, True)
    found = estimate.smoothed_maximum_score(panel, 6)
    monkeypatch.setattr(estimate, "JOINT_ROWS", 5)
    errors = []
    for task, held, deal in ((50_000, 1_000, 2_000_000), (20, 1, 10)):
        monkeypatch.setattr(estimate, "CASES_A_TASK", task)
        monkeypatch.setattr(estimate, "CELLS_HELD", held)
        monkeypatch.setattr(estimate, "CASES_A_DEAL", deal)
        errors.append({r["parameter"]: r["std_err"] for r in estimate.bootstrap_errors(panel, found, 6, found.width, reps=12).collect()})
    assert errors[0] == pytest.approx(errors[1], rel=1e-4, abs=1e-9, nan_ok=True)
