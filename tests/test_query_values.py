"""Values of the queries that fit models and have no SQL, against numpy on the same answers."""

import numpy as np
import pytest

from dyadics.operators import estimate
from dyadics.plans import estimators
from dyadics.plans.catalogue import QUERIES

SF, ITEMS = "/root/testdata/sf0.001", 100


@pytest.fixture(scope="module")
def panel(spark):
    return estimators._structural(spark, SF).toPandas()


def design(t, profiles=True):
    """A constant, an indicator of each item but the first (endowed less offered), and of each profile but the first."""
    out = [np.ones(len(t))]
    for own, other, n in (("own_item", "other_item", ITEMS), *([("own_profile", "other_profile", 9)] if profiles else [])):
        out += [(t[own] == k).to_numpy(float) - (t[other] == k).to_numpy(float) for k in range(1, n)]
    return np.stack(out, 1)


def residuals(x, y):
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def test_start_values_are_the_pooled_regression(spark, panel):
    got = {r["parameter"]: r for r in QUERIES["start_values"](spark, SF).collect()}
    assert list(got) and len(got) == ITEMS + 9 and got["lambda"]["ols"] == 0 and got["eta"]["ols"] == 0
    x, y = design(panel), panel["p_no"].to_numpy()
    beta = np.r_[0.0, 0.0, np.linalg.lstsq(x, y, rcond=None)[0][1:]]
    found = np.array([got[n]["ols"] for n in estimate.parameter_names(ITEMS)])
    # the fitted values are unique, the coefficients of goods that no answer tells apart are not
    assert x[:, 1:] @ found[2:] - x[:, 1:] @ beta[2:] == pytest.approx(0, abs=1e-4)


def test_levels_diagnostic_is_numpys(spark, panel):
    got = QUERIES["levels_diagnostic"](spark, SF).first()
    y = panel["p_no"].to_numpy()
    items, full = design(panel, False), design(panel)
    tss = ((y - y.mean()) ** 2).sum()
    one, two = (residuals(x, y) @ residuals(x, y) for x in (items, full))
    assert got["observations"] == len(panel)
    assert (got["item_r2"], got["full_r2"], got["partial_r2"]) == pytest.approx((1 - one / tss, 1 - two / tss, (one - two) / one), abs=2e-5)
    low, high = panel[["own_item", "other_item"]].min(axis=1), panel[["own_item", "other_item"]].max(axis=1)
    fold = ((low * 100 + high) % 10).to_numpy()
    for x, name in ((items, "item_cv_mse"), (full, "full_cv_mse")):
        errors = [((y[fold == f] - x[fold == f] @ np.linalg.lstsq(x[fold != f], y[fold != f], rcond=None)[0]) ** 2).sum() for f in np.unique(fold)]
        assert got[name] == pytest.approx(sum(errors) / len(y), rel=0.02)


def test_starts_agree_on_the_least_objective(spark, panel):
    rows = QUERIES["multistart_refits"](spark, SF).collect()
    fit = {r["parameter"]: r for r in QUERIES["nls_full"](spark, SF).collect()}
    assert len(rows) == 5 and all(r["objective"] <= r["start_objective"] for r in rows)
    least = min(r["objective"] for r in rows)
    assert next(iter(fit.values()))["objective"] == pytest.approx(least, rel=1e-3, abs=2e-6)
    assert sum(r["objective"] <= least * 1.01 + 2e-6 for r in rows) >= 3
    # the objective is the sum of squares at the published estimates
    theta = np.array([fit[n]["estimate"] for n in estimate.parameter_names(ITEMS)])
    a, b = np.r_[0, theta[2 : ITEMS + 1]], np.r_[0, theta[ITEMS + 1 :]]
    v, w = (np.exp(a[panel[f"{s}_item"]] + b[panel[f"{s}_profile"]]) for s in ("own", "other"))
    p = 1 / (1 + np.exp(-((1 + theta[0]) * v - w + theta[1])))
    assert ((panel["p_no"] - p) ** 2).sum() == pytest.approx(next(iter(fit.values()))["objective"], rel=1e-3, abs=2e-6)
