"""Estimators against plain numpy versions on small panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadics.operators import estimate

ITEMS = 6


def world(n=1500, lam=0.7, eta=0.2, noise=0.02, seed=1):
    draw = np.random.default_rng(seed)
    alpha, beta = np.r_[0, draw.normal(0, 0.4, ITEMS - 1)], np.r_[0, draw.normal(0, 0.3, 8)]
    rows = []
    for i in range(n):
        x, y = sorted(draw.choice(ITEMS, 2, replace=False).tolist())
        p, q = draw.integers(0, 9, 2).tolist()
        u, w = np.exp(alpha[x] + beta[p]), np.exp(alpha[y] + beta[q])
        chance = [1 / (1 + np.exp(-((1 + lam) * a - b + eta))) + draw.normal(0, noise) for a, b in ((u, w), (w, u))]
        rows.append((i, x, y, p // 3, p % 3, q // 3, q % 3, *map(float, np.clip(chance, 0, 1)), float(u), float(w)))
    return rows


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(world(), "case_id long, x_num int, y_num int, i int, j int, k int, l int, p_no_x double, p_no_y double, u_x double, u_y double").persist()


@pytest.fixture(scope="module")
def panel(pairs):
    return estimate.panel(pairs).persist()


def residuals(theta, t):
    a, b = np.r_[0, theta[2 : ITEMS + 1]], np.r_[0, theta[ITEMS + 1 : ITEMS + 9]]
    v, w = np.exp(a[t[:, 0]] + b[t[:, 1]]), np.exp(a[t[:, 2]] + b[t[:, 3]])
    return 1 / (1 + np.exp(-((1 + theta[0]) * v - w + theta[1])))


def plain_nls(t, y, theta):
    """Levenberg-Marquardt with differences for derivatives."""
    damping = 1e-3
    for _ in range(300):
        r = y - residuals(theta, t)
        jac = np.stack([(residuals(theta + d, t) - residuals(theta - d, t)) / 2e-6 for d in np.eye(len(theta)) * 1e-6], 1)
        move = np.linalg.solve(jac.T @ jac + damping * np.eye(len(theta)), jac.T @ r)
        if ((y - residuals(theta + move, t)) ** 2).sum() <= (r**2).sum():
            theta, damping = theta + move, damping / 5
            if np.abs(move).max() < 1e-10:
                break
        else:
            damping *= 5
    return theta


def table(panel):
    rows = np.array([tuple(r) for r in panel.select(*estimate.CELL, "p_no").collect()])
    return rows[:, :4].astype(int), rows[:, 4]


def test_least_squares_agrees_with_a_plain_fit(panel):
    t, y = table(panel)
    start = estimate.ols_start(panel, ITEMS)
    found = estimate.fit(panel, ITEMS, start=start, tolerance=1e-14)
    want = plain_nls(t, y, np.zeros(len(start)))
    assert found.converged and found.values == pytest.approx(want, abs=1e-4)
    assert found.objective == pytest.approx(((y - residuals(want, t)) ** 2).sum(), rel=1e-6)
    assert found.values[:2] == pytest.approx([0.7, 0.2], abs=0.1)


def test_start_values_are_those_of_pooled_least_squares(panel):
    t, y = table(panel)
    x = np.zeros((len(y), ITEMS + 8))
    x[:, 0] = 1
    for row, (a, p, b, q) in zip(x, t, strict=True):
        for at, sign in ((a, 1), (b, -1)):
            row[at] += sign * (at > 0)
        for at, sign in ((p, 1), (q, -1)):
            row[ITEMS - 1 + at] += sign * (at > 0)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert estimate.ols_start(panel, ITEMS)[2:] == pytest.approx(beta[1:], abs=1e-8)
    full = ((y - x @ beta) ** 2).sum()
    items = ((y - x[:, :ITEMS] @ np.linalg.lstsq(x[:, :ITEMS], y, rcond=None)[0]) ** 2).sum()
    row = estimate.levels_diagnostic(panel.withColumn("fold", F.pmod(F.least("own_item", "other_item"), F.lit(3))), ITEMS, "fold").first()
    assert row["full_r2"] == pytest.approx(1 - full / ((y - y.mean()) ** 2).sum()) and row["partial_r2"] == pytest.approx((items - full) / items)
    errors = 0.0
    for f in range(3):
        out = np.minimum(t[:, 0], t[:, 2]) % 3 == f
        errors += ((y[out] - x[out] @ np.linalg.lstsq(x[~out], y[~out], rcond=None)[0]) ** 2).sum()
    assert row["full_cv_mse"] == pytest.approx(errors / len(y), rel=1e-6)


def test_starts_restrictions_and_refits(panel):
    for kind in ("zero", "nls"):
        assert len(estimate.starts(panel, ITEMS, kind)) == ITEMS + 9
    prior = estimate.starts(panel, ITEMS, "prior", {"lambda": 0.5, "alpha_3": 1.0})
    assert prior[0] == 0.5 and prior[3] == 1.0 and prior.sum() == 1.5
    start = estimate.ols_start(panel, ITEMS)
    got = {r["start"]: r for r in estimate.refits(panel, ITEMS, estimate.perturbed_starts(start, 2, 1, 0.1)).collect()}
    assert set(got) == {"ols", "zero", "perturb1", "perturb2"}
    assert all(r["converged"] and r["objective"] <= r["start_objective"] for r in got.values())
    assert max(r["lambda"] for r in got.values()) - min(r["lambda"] for r in got.values()) < 0.01
    two = estimate.fit(panel, ITEMS, start=start, free=[0, 1])
    assert (two.values[2:] == start[2:]).all() and two.objective < estimate.fit(panel, ITEMS, start=start, free=[1]).objective


def test_likelihood_has_no_slope_at_its_estimates(panel):
    found = estimate.fit(panel, ITEMS, "mle", start=estimate.ols_start(panel, ITEMS), tolerance=1e-14)
    t, y = table(panel)

    def loss(theta):
        p = residuals(theta, t)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    slope = [(loss(found.values + d) - loss(found.values - d)) / 2e-5 for d in np.eye(len(found.values)) * 1e-5]
    assert np.abs(slope).max() < 0.02


@pytest.mark.parametrize("spec", [2, 3])
def test_other_specifications_and_the_step(panel, spec):
    found = estimate.fit(panel, ITEMS, spec=spec, start=estimate.ols_start(panel, ITEMS, spec))
    assert np.isfinite(found.objective) and len(found.values) == ITEMS + 9 + (spec == 3)
    row = estimate.latent(panel, found, ITEMS, spec).first()
    assert row["n"] == 3000 and row["sd"] > 0
    assert estimate.link(np.array([-1.0, 0.0, 2.0]), 0).tolist() == [0, 0, 1]


def test_smoothed_maximum_score_and_its_errors(panel, spark):
    found = estimate.smoothed_maximum_score(panel, ITEMS)
    rows = estimate.bootstrap_errors(panel, found, ITEMS, found.width, reps=4).collect()
    assert len(rows) == ITEMS + 9 and all(r["reps"] + r["failures"] == 4 for r in rows)
    assert found.objective <= estimate.fit(panel, ITEMS, "nls", scale=found.width, start=estimate.ols_start(panel, ITEMS), iterations=1, bounds={}).objective
    assert found.diagnostics(spark).first()["parameters"] == ITEMS + 9


def plain_two(vx, vy, px, py, w):
    theta = np.zeros(2)
    v, o, y, w = np.r_[vx, vy], np.r_[vy, vx], np.r_[px, py], np.r_[w, w]
    for _ in range(200):
        p = 1 / (1 + np.exp(-((1 + theta[0]) * v - o + theta[1])))
        jac = np.c_[v, np.ones(len(v))] * (p * (1 - p))[:, None]
        theta = theta + np.linalg.solve(jac.T @ (jac * w[:, None]) + 1e-9 * np.eye(2), jac.T @ (w * (y - p)))
    return theta


def test_two_parameters_by_group_and_without_each_good(pairs):
    data = pairs.toPandas()
    columns = ["u_x", "u_y", "p_no_x", "p_no_y"]
    row = estimate.lambda_eta(pairs.withColumn("g", F.lit(1)), ["g"]).first()
    want = plain_two(*(data[c].to_numpy() for c in columns), np.ones(len(data)))
    assert (row["lambda"], row["eta"]) == pytest.approx(tuple(want), abs=1e-6) and row["n"] == len(data)
    for r in estimate.lambda_eta_without_each_good(pairs, "x_num", "y_num").collect():
        left = data[(data.x_num != r["good"]) & (data.y_num != r["good"])]
        want = plain_two(*(left[c].to_numpy() for c in columns), np.ones(len(left)))
        assert (r["lambda"], r["eta"]) == pytest.approx(tuple(want), abs=1e-5) and r["n"] == len(left)
    assert estimate.lambda_eta_without_each_good(pairs.limit(9), "x_num", "y_num").count() == 0


def test_bootstrap_covers_the_estimate(pairs):
    row = estimate.lambda_eta_bootstrap(pairs, ["x_num", "y_num"], reps=100).first()
    assert row["lambda_low"] <= row["lambda"] <= row["lambda_high"] and row["clusters"] == 15 and row["reps"] + row["failures"] == 100
    assert 0 < row["lambda_se"] < 0.5


def test_recovery_covers_the_truth(spark):
    rows = estimate.recovery(spark, [(0.1, 0.0), (2.0, 0.5)], reps=20, n=200, boots=80, binary=True).collect()
    for r in rows:
        assert abs(r["bias_lambda"]) < 5 * r["sd_lambda"] / 20**0.5 + 0.05 and r["coverage_lambda"] > 0.7 and not r["weak_identification"]
