"""Structural and linear estimators on panels that stay distributed.

A panel row is one answer: item and profile of the endowed and of the offered good and the probability of 'No'. Answers
of equal items and profiles are summed to one cell first, so what a fit iterates over is bounded by the design, not by the
answers. Each iteration sums the normal equations of the cells in the tasks, and solves a system of the size of the
parameters (about a hundred) on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILES = 9


@dataclass
class Fit:
    """Estimates by name with covariance, objective, and the trace of (iteration, objective, lambda, eta)."""

    names: list[str]
    values: np.ndarray
    covariance: np.ndarray
    objective: float
    n: int
    converged: bool
    trace: list[tuple[int, float, float, float]]
    information: np.ndarray | None = None
    width: float | None = None
    #: Why the fit ended: 'tolerance', 'gradient', 'stalled' or 'iterations'; the first two are converged.
    ended: str | None = None

    def table(self, spark) -> DataFrame:
        """parameter, estimate, std_err, variance, objective, converged."""
        var = np.diag(self.covariance)
        rows = [(n, float(v), float(np.sqrt(s)) if s >= 0 else None, float(s), self.objective, self.converged) for n, v, s in zip(self.names, self.values, var, strict=True)]
        return spark.createDataFrame(rows, "parameter string, estimate double, std_err double, variance double, objective double, converged boolean")

    def diagnostics(self, spark) -> DataFrame:
        """One row: n, parameters, objective, rank and condition of the Jacobian, least and greatest singular value, whether all errors are finite and above 0."""
        singular = np.sqrt(np.maximum(np.linalg.eigvalsh(self.information)[::-1], 0))
        rank = int((singular > singular[0] * len(singular) * np.finfo(float).eps ** 0.5).sum()) if len(singular) else 0
        cond = float(singular[0] / singular[-1]) if singular[-1] > 0 else float("inf")
        var = np.diag(self.covariance)
        row = (self.n, len(singular), self.objective, rank, cond, float(singular[-1]), float(singular[0]), bool(np.isfinite(var).all() and (var > 0).all()), self.converged)
        return spark.createDataFrame([row], "n long, parameters int, objective double, rank int, cond_jacobian double, least_singular double, greatest_singular double, errors_positive boolean, converged boolean")


def panel(pairs: DataFrame) -> DataFrame:
    """Two rows a pair: own_item, own_profile, other_item, other_profile (from 0), p_no; pairs with x_num >= y_num go."""
    sides = F.array(
        F.struct(F.col("x_num").alias("own_item"), (F.col("i") * 3 + F.col("j")).alias("own_profile"), F.col("y_num").alias("other_item"), (F.col("k") * 3 + F.col("l")).alias("other_profile"), F.col("p_no_x").alias("p_no")),
        F.struct(F.col("y_num").alias("own_item"), (F.col("k") * 3 + F.col("l")).alias("own_profile"), F.col("x_num").alias("other_item"), (F.col("i") * 3 + F.col("j")).alias("other_profile"), F.col("p_no_y").alias("p_no")),
    )
    return pairs.where("x_num < y_num").select("case_id", F.explode(sides).alias("_s")).select("case_id", "_s.*")


def parameter_names(items: int, spec: int = 1) -> list[str]:
    """lambda, eta, alpha_2..., beta_1,2...3,3 and gamma for spec 3; item 1 and profile 1,1 are the references."""
    return ["lambda", "eta", *(f"alpha_{i}" for i in range(2, items + 1)), *(f"beta_{p // 3 + 1},{p % 3 + 1}" for p in range(1, PROFILES)), *(["gamma"] if spec == 3 else [])]


def _utility(theta: np.ndarray, item: np.ndarray, profile: np.ndarray, items: int, spec: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """V, dV/dalpha, dV/dbeta and dV/dgamma of each row."""
    alpha = np.r_[0.0, theta[2 : items + 1]][item]
    beta = np.r_[0.0, theta[items + 1 : items + PROFILES]][profile]
    both, a, b = np.exp(np.clip(alpha + beta, -50, 50)), np.exp(np.clip(alpha, -50, 50)), np.exp(np.clip(beta, -50, 50))
    if spec == 1:
        return both, both, both, np.zeros_like(both)
    if spec == 2:
        return a + b, a, b, np.zeros_like(a)
    gamma = theta[-1]
    return both + gamma * (a + b), both + gamma * a, both + gamma * b, a + b


CELL = ("own_item", "own_profile", "other_item", "other_profile")


def cells(rows: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, own_item, own_profile, other_item, other_profile, n, p_no (mean) and rest (squares about it): all that a fit needs."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = rows.where("p_no IS NOT NULL").groupBy(*(by or []), *CELL).agg(F.sum(w).alias("n"), F.sum(w * F.col("p_no")).alias("_s"), F.sum(w * F.col("p_no") * F.col("p_no")).alias("_q"))
    mean = F.col("_s") / F.col("n")
    return sums.where("n > 0").select(*(by or []), *CELL, "n", mean.alias("p_no"), F.greatest(F.col("_q") - F.col("n") * mean * mean, F.lit(0.0)).alias("rest"))


def link(z: np.ndarray, scale: float) -> np.ndarray:
    """Probability of 'No' from the latent index: logistic, or a step at scale 0."""
    return (z > 0).astype(float) if scale == 0 else 1 / (1 + np.exp(-np.clip(z / scale, -500, 500)))


def _sums(part: pd.DataFrame, theta: np.ndarray, items: int, spec: int, kind: str, scale: float, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Information, score, objective and answers of cells. A row of the Jacobian has eight entries at most."""
    own, own_p, other, other_p = (part[c].to_numpy(dtype=np.int64) for c in CELL)
    y, n, rest = (part[c].to_numpy(dtype=float) for c in ("p_no", "n", "rest"))
    v, va, vb, vg = _utility(theta, own, own_p, items, spec)
    w, wa, wb, wg = _utility(theta, other, other_p, items, spec)
    lam, k = 1 + theta[0], len(theta)
    z = lam * v - w + theta[1]
    p = link(z, scale)
    value = np.c_[v, np.ones(len(y)), np.where(own > 0, lam * va, 0), np.where(own_p > 0, lam * vb, 0), np.where(other > 0, -wa, 0), np.where(other_p > 0, -wb, 0)]
    at = np.c_[np.zeros(len(y), int), np.ones(len(y), int), 1 + own, items + own_p, 1 + other, items + other_p]
    if spec == 3:
        value, at = np.c_[value, lam * vg - wg], np.c_[at, np.full(len(y), k - 1)]
    slope = p * (1 - p) / scale
    if kind == "nls":
        weight, pull = n * slope * slope, n * slope * (y - p)
        objective = float((n * (y - p) ** 2 + rest).sum())
    else:
        weight, pull = n * slope / scale, n * (y - p) / scale
        q = np.clip(p, 1e-15, 1 - 1e-15)
        objective = float(-(n * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum())
    entries = value[:, :, None] * value[:, None, :] * weight[:, None, None]
    info = np.bincount((at[:, :, None] * k + at[:, None, :]).ravel(), weights=entries.ravel(), minlength=k * k).reshape(k, k)
    score = np.bincount(at.ravel(), weights=(value * pull[:, None]).ravel(), minlength=k)
    return info[np.ix_(free, free)], score[free], objective, float(n.sum())


BOUNDS = {0: (-1.0, 200.0), 1: (-200.0, 200.0)}


def flat(info: np.ndarray, score: np.ndarray, free_at: np.ndarray, theta: np.ndarray, limits: dict[int, tuple[float, float]], objective: float, tolerance: float) -> bool:
    """Whether a full step would lower the objective by less than ``tolerance`` of itself; what a bound stops does not count."""
    inside = np.array([not (at in limits and (theta[at] <= limits[at][0] and g < 0 or theta[at] >= limits[at][1] and g > 0)) for at, g in zip(free_at.tolist(), score, strict=True)])
    if not inside.any():
        return True
    g = score[inside]
    gain = float(g @ np.linalg.lstsq(info[np.ix_(inside, inside)], g, rcond=None)[0])
    return bool(np.isfinite(gain) and gain <= tolerance * (abs(objective) + tolerance))


def _descend(evaluate, theta: np.ndarray, free_at: np.ndarray, limits: dict[int, tuple[float, float]], iterations: int, tolerance: float):
    """Damped steps from ``theta`` until the objective falls by less than ``tolerance`` of itself. Bounds hold by projection.

    Where no step lowers the objective, the fit has converged only if its gradient is flat; how it ended is returned.
    """
    info, score, objective, n = evaluate(theta)
    damping, trace, ended = 1e-3, [(0, objective, theta[0], theta[1])], "iterations"
    for step in range(1, iterations + 1):
        lift = damping * np.maximum(np.diag(info), 1e-12)
        move = np.linalg.lstsq(info + np.diag(lift), score, rcond=None)[0]
        trial = theta.copy()
        trial[free_at] += move
        for at, (lo, hi) in limits.items():
            trial[at] = min(max(trial[at], lo), hi)
        new = evaluate(trial)
        if np.isfinite(new[2]) and new[2] <= objective:
            gain = objective - new[2]
            theta, (info, score, objective, n), damping = trial, new, damping / 5
            trace.append((step, objective, theta[0], theta[1]))
            if gain <= tolerance * (abs(objective) + tolerance):
                ended = "tolerance"
                break
        else:
            damping *= 8
            if damping > 1e12:
                ended = "gradient" if flat(info, score, free_at, theta, limits, objective, tolerance) else "stalled"
                break
    return theta, info, objective, n, ended, trace


#: How a converged fit ends.
CONVERGED = ("tolerance", "gradient")
#: Cells that a task sums, and partial sums that one task adds up.
CELLS_A_TASK, FAN_IN = 20_000, 32


def _total(parts: DataFrame) -> np.ndarray:
    """The sum of the arrays ``a`` of rows numbered by ``part``, as a tree: FAN_IN of them at most reach the driver."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN_IN], "a": [np.sum(np.stack(rows["a"].to_numpy()), axis=0).tolist()]})

    many = parts.rdd.getNumPartitions()
    while many > FAN_IN:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(add, "part long, a array<double>")
        many = -(-many // FAN_IN)
    return np.sum([r["a"] for r in parts.collect()], axis=0)


def fit(rows: DataFrame, items: int, kind: str = "nls", spec: int = 1, scale: float = 1.0, start: np.ndarray | None = None, free: list[int] | None = None, bounds: dict[int, tuple[float, float]] | None = None, iterations: int = 1_000, tolerance: float = 1e-8) -> Fit:
    """Bounded least squares ('nls') or logit likelihood ('mle') by damped Gauss-Newton or Fisher steps.

    ``rows`` is a panel or its cells. ``free`` restricts the fit to some parameters. A smoothed maximum score fit is 'nls'
    with ``scale`` set to the kernel's width. ``converged`` says whether the tolerance was reached or the gradient is flat.
    """
    names = parameter_names(items, spec)
    theta = np.zeros(len(names)) if start is None else np.asarray(start, dtype=float).copy()
    free_at = np.arange(len(names)) if free is None else np.asarray(free)
    summed = (rows if "rest" in rows.columns else cells(rows)).select(*CELL, "n", "p_no", "rest")
    k = len(free_at)
    summed = summed.persist()
    # by the number of cells, so that neither the tasks nor their sums grow with the cluster
    kept = summed.repartition(1 + summed.count() // CELLS_A_TASK).persist()

    def evaluate(at: np.ndarray):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            total = np.zeros(k * k + k + 2)
            for part in parts:
                for begin in range(0, len(part), CELLS_A_TASK):
                    a, g, objective, n = _sums(part.iloc[begin : begin + CELLS_A_TASK], at, items, spec, kind, scale, free_at)
                    total += np.r_[a.ravel(), g, objective, n]
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "a": [total.tolist()]})

        got = _total(kept.mapInPandas(run, "part long, a array<double>"))
        if not got[-1]:
            raise ValueError("no rows to fit")
        return got[: k * k].reshape(k, k), got[k * k : k * k + k], got[-2], got[-1]

    theta, info, objective, n, ended, trace = _descend(evaluate, theta, free_at, BOUNDS if bounds is None else bounds, iterations, tolerance)
    kept.unpersist()
    summed.unpersist()
    n = int(round(n))
    spread = objective / max(n - k, 1) if kind == "nls" else 1.0
    covariance = np.full((len(names), len(names)), 0.0)
    covariance[np.ix_(free_at, free_at)] = np.linalg.pinv(info) * spread
    return Fit(names, theta, covariance, float(objective), n, ended in CONVERGED, trace, info, ended=ended)


def linear_sums(rows: DataFrame, items: int, by: list[str] | None = None) -> dict[tuple, np.ndarray]:
    """X'X, X'y, y'y, sum of y and n in one array, for each group ``by``: the design of levels.

    Its columns are a constant, an item's indicator (endowed less offered) for each item but the first, and likewise eight
    profiles'. The groups are bounded tables (folds, goods).
    """
    summed, keys = cells(rows, by), by or []
    k = items + PROFILES - 1
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in summed.select(*keys).schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for part in parts:
            groups = part.groupby(keys, sort=False) if keys else [((), part)]
            for key, group in groups:
                own, own_p, other, other_p = (group[c].to_numpy(dtype=np.int64) for c in CELL)
                y, n, rest = (group[c].to_numpy(dtype=float) for c in ("p_no", "n", "rest"))
                at = np.c_[np.zeros(len(y), int), own, items - 1 + own_p, other, items - 1 + other_p]
                value = np.c_[np.ones(len(y)), own > 0, own_p > 0, -1.0 * (other > 0), -1.0 * (other_p > 0)]
                at = np.where(value != 0, at, 0)
                xx = np.bincount((at[:, :, None] * k + at[:, None, :]).ravel(), weights=(value[:, :, None] * value[:, None, :] * n[:, None, None]).ravel(), minlength=k * k)
                xy = np.bincount(at.ravel(), weights=(value * (n * y)[:, None]).ravel(), minlength=k)
                total[key] = total.get(key, 0) + np.r_[xx, xy, (n * y * y + rest).sum(), (n * y).sum(), n.sum()]
        for key, a in total.items():
            yield pd.DataFrame({c: [x] for c, x in zip(keys, key if isinstance(key, tuple) else (key,), strict=True)} | {"a": [a.tolist()]})

    out: dict[tuple, np.ndarray] = {}
    for r in summed.mapInPandas(run, f"{types}a array<double>").collect():
        key = tuple(r[c] for c in keys)
        out[key] = out.get(key, 0) + np.array(r["a"])
    return out


def _linear(total: np.ndarray, k: int, used: int | None = None) -> tuple[np.ndarray, float]:
    """Coefficients of the first ``used`` columns by least squares, and the residual sum of squares."""
    used = used or k
    xx, xy = total[: k * k].reshape(k, k)[:used, :used], total[k * k : k * k + k][:used]
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    return beta, float(total[-3] - 2 * beta @ xy + beta @ xx @ beta)


def ols_start(rows: DataFrame, items: int, spec: int = 1) -> np.ndarray:
    """Start values: lambda, eta (and gamma) 0, items and profiles from pooled least squares in levels."""
    total = linear_sums(rows, items).get(())
    if total is None:
        raise ValueError("no rows to fit")
    beta, _ = _linear(total, items + PROFILES - 1)
    return np.r_[0.0, 0.0, beta[1:], [0.0] * (spec == 3)]


def starts(rows: DataFrame, items: int, kind: str = "ols", prior: dict[str, float] | None = None, spec: int = 1) -> np.ndarray:
    """Start values by 'ols', 'zero', 'prior' (a table of estimates by name; what it lacks is 0) or 'nls' (two stages)."""
    names = parameter_names(items, spec)
    if kind == "ols":
        return ols_start(rows, items, spec)
    if kind == "zero":
        return np.zeros(len(names))
    if kind == "prior":
        return np.array([(prior or {}).get(n, 0.0) for n in names])
    if kind != "nls":
        raise ValueError("kind is 'ols', 'zero', 'prior' or 'nls'")
    first = fit(rows, items, spec=spec, free=list(range(2, len(names))), bounds={})
    return fit(rows, items, spec=spec, start=first.values, free=[0, 1], bounds={}).values


def perturbed_starts(start: np.ndarray, many: int, seed: int, scale: float) -> dict[str, np.ndarray]:
    """The start, zeros and ``many`` normal perturbations of the start, by name."""
    draw = np.random.default_rng(seed)
    return {"ols": start, "zero": np.zeros_like(start)} | {f"perturb{n + 1}": start + draw.normal(0, scale, start.shape) for n in range(many)}


def _local_fit(part: pd.DataFrame, items: int, kind: str, spec: int, scale: float, start: np.ndarray, bounds, iterations: int, tolerance: float):
    free = np.arange(len(start))
    clipped = start.copy()
    for at, (lo, hi) in bounds.items():
        clipped[at] = min(max(clipped[at], lo), hi)
    return _descend(lambda t: _sums(part, t, items, spec, kind, scale, free), clipped, free, bounds, iterations, tolerance)


def refits(rows: DataFrame, items: int, by_start: dict[str, np.ndarray], kind: str = "nls", spec: int = 1, iterations: int = 1_000, tolerance: float = 1e-8) -> DataFrame:
    """start, start_objective, objective, lambda, eta, converged of a fit from each start; a start's fit runs in one task.

    Each of them sees the whole table of cells, whose size the design bounds.
    """
    table = cells(rows) if "rest" not in rows.columns else rows
    names = F.array(*map(F.lit, by_start))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        name = part["start"].iloc[0]
        theta, _, objective, _, ended, trace = _local_fit(part, items, kind, spec, 1.0, np.asarray(by_start[name], float), BOUNDS, iterations, tolerance)
        return pd.DataFrame({"start": [name], "start_objective": [trace[0][1]], "objective": [objective], "lambda": [theta[0]], "eta": [theta[1]], "converged": [ended in CONVERGED]})

    each = table.select(*CELL, "n", "p_no", "rest", F.explode(names).alias("start"))
    return each.groupBy("start").applyInPandas(run, "start string, start_objective double, objective double, lambda double, eta double, converged boolean")


def levels_diagnostic(rows: DataFrame, items: int, fold: str) -> DataFrame:
    """One row: observations, R2 of items alone and with profiles, partial R2, errors of both across the folds and their reduction.

    ``rows``: a panel with ``fold``, a whole number; all rows of a pair of goods are in one fold.
    """
    k = items + PROFILES - 1
    folds = linear_sums(rows.withColumn("_fold", F.col(fold).cast("int")), items, ["_fold"])
    total = sum(folds.values())
    rss = {used: _linear(total, k, used)[1] for used in (items, k)}
    tss = float(total[-3] - total[-2] ** 2 / total[-1])
    errors = {items: 0.0, k: 0.0}
    for part in folds.values():
        for used in errors:
            beta, _ = _linear(total - part, k, used)
            xx, xy = part[: k * k].reshape(k, k)[:used, :used], part[k * k : k * k + k][:used]
            errors[used] += float(part[-3] - 2 * beta @ xy + beta @ xx @ beta)
    mse = {used: e / total[-1] for used, e in errors.items()}
    row = (int(total[-1]), 1 - rss[items] / tss, 1 - rss[k] / tss, (rss[items] - rss[k]) / rss[items], mse[items], mse[k], (mse[items] - mse[k]) / mse[items])
    return rows.sparkSession.createDataFrame([tuple(map(float, row[1:]))], "item_r2 double, full_r2 double, partial_r2 double, item_cv_mse double, full_cv_mse double, cv_reduction double").withColumn("observations", F.lit(row[0]).cast("long"))


def first_difference_sensitivity(rows: DataFrame, by: list[str], order: str, p_x: str, p_y: str) -> DataFrame:
    """One row over groups of exactly two cases: groups, mean and median absolute change of both probabilities, flips of either, both, each."""
    agg = [F.count("*").alias("_n")]
    for c in (p_x, p_y):
        agg += [F.min_by(c, order).alias(f"_a_{c}"), F.max_by(c, order).alias(f"_b_{c}")]
    two = rows.groupBy(*by).agg(*agg).where("_n = 2")
    flip = lambda c: (F.col(f"_a_{c}") >= 0.5) != (F.col(f"_b_{c}") >= 0.5)
    change = lambda c: F.abs(F.col(f"_b_{c}") - F.col(f"_a_{c}"))
    each = two.select(change(p_x).alias("_cx"), change(p_y).alias("_cy"), flip(p_x).alias("_fx"), flip(p_y).alias("_fy"))
    counts = each.agg(F.count("*").alias("pairs"), ((F.avg("_cx") + F.avg("_cy")) / 2).alias("mean_abs_change"), F.count_if("_fx").alias("x_flips"), F.count_if("_fy").alias("y_flips"), F.count_if(F.col("_fx") | F.col("_fy")).alias("either_flips"), F.count_if(F.col("_fx") & F.col("_fy")).alias("both_flips"))
    from .ordered import percentiles

    changes = each.select(F.lit(1).alias("_g"), F.explode(F.array("_cx", "_cy")).alias("_c"))
    return counts.withColumn("_g", F.lit(1)).join(percentiles(changes, ["_g"], "_c", {"median_abs_change": 0.5}), "_g", "left").drop("_g")


def latent(rows: DataFrame, result: Fit, items: int, spec: int = 1) -> DataFrame:
    """n, mean and sd of the latent index z at the estimates, and its kernel density at 0 with Scott's width."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = _utility(result.values, part["own_item"].to_numpy(), part["own_profile"].to_numpy(), items, spec)[0]
            w = _utility(result.values, part["other_item"].to_numpy(), part["other_profile"].to_numpy(), items, spec)[0]
            yield pd.DataFrame({"z": (1 + result.values[0]) * v - w + result.values[1]})

    z = rows.select("own_item", "own_profile", "other_item", "other_profile").mapInPandas(run, "z double")
    width = z.agg((F.stddev_samp("z") * F.pow(F.count("z").cast("double"), F.lit(-0.2))).alias("h"))
    h = F.col("h")
    mean_kernel = F.avg(F.exp(-F.try_divide(F.col("z") * F.col("z"), 2 * h * h)))
    density = F.try_divide(mean_kernel, F.max("h") * F.lit((2 * np.pi) ** 0.5))  # null if z does not vary
    return z.crossJoin(F.broadcast(width)).agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"), density.alias("density_at_0"))


def smoothed_maximum_score(rows: DataFrame, items: int, spec: int = 1, start: Fit | None = None, last_nonneg: bool = True, tolerance: float = 1e-6) -> Fit:
    """Smoothed maximum score: logistic kernel of width sd(z) * n**(-1/5) at the starting fit."""
    start = start or fit(rows, items, "nls", spec, start=ols_start(rows, items, spec))
    row = latent(rows, start, items, spec).first()
    width = max(row["sd"] * row["n"] ** -0.2, 1e-6)
    out = fit(rows, items, "nls", spec, width, start.values, bounds=_score_bounds(len(start.values), last_nonneg), tolerance=tolerance)
    out.width = width
    return out


def _score_bounds(k: int, last_nonneg: bool) -> dict[int, tuple[float, float]]:
    return {0: (-1.0, float("inf"))} | ({k - 1: (0.0, float("inf"))} if last_nonneg else {})


#: Joint cells that are broadcast, some hundred bytes each.
JOINT_ROWS = 1_000_000
#: Of a larger table: joint cells a task draws, cells it holds the sums of, and joint cells of one cell in a task, about.
CASES_A_TASK, CELLS_HELD, CASES_A_DEAL = 50_000, 1_000, 2_000_000


def joint_cells(rows: DataFrame, case: str) -> DataFrame:
    """answers (CELL and p_no of both answers of a case, ordered), cases: cases of equal answers are one row."""
    answers = rows.where("p_no IS NOT NULL").groupBy(case).agg(F.array_sort(F.collect_list(F.struct(*CELL, "p_no"))).alias("answers"))
    return answers.groupBy("answers").agg(F.count("*").alias("cases"))


def _drawn_cells(cell: np.ndarray, of: np.ndarray, at: np.ndarray, p: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
    """The table of cells in which joint cell k counts ``weight[k]`` times."""
    w = weight[of].astype(float)
    n, s, q = (np.bincount(at, weights=w * x, minlength=len(cell)) for x in (1.0, p, p * p))
    drawn = n > 0
    mean = s[drawn] / n[drawn]
    return pd.DataFrame(cell[drawn], columns=list(CELL)).assign(n=n[drawn], p_no=mean, rest=np.maximum(q[drawn] - n[drawn] * mean * mean, 0))


def bootstrap_errors(rows: DataFrame, estimate: Fit, items: int, width: float, case: str = "case_id", reps: int = 500, seed: int = 0, spec: int = 1, last_nonneg: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """parameter, estimate, std_err, reps, failures: errors of a smoothed maximum score fit by drawing cases.

    A case has a Poisson weight with mean 1 in each replicate, and both its answers move together. Cases of equal answers
    are one joint cell, whose weight is a single Poisson draw with their number as mean. Each replicate is drawn and fitted in
    a task. The table of joint cells is broadcast within JOINT_ROWS; a larger one is drawn where it lies, for all
    replicates at once, and its sums by replicate and cell are exchanged.
    """
    joint = joint_cells(rows, case).persist()
    start, bounds = estimate.values, _score_bounds(len(estimate.values), last_nonneg)
    spark = rows.sparkSession
    schema = "rep int, values array<double>, ok boolean"

    def fitted(rep: int, table: pd.DataFrame) -> pd.DataFrame:
        theta, _, _, _, ended, _ = _local_fit(table, items, "nls", spec, width, start, bounds, 1_000, tolerance)
        return pd.DataFrame({"rep": [rep], "values": [theta.tolist()], "ok": [bool(ended in CONVERGED and np.isfinite(theta).all())]})

    if joint.limit(JOINT_ROWS + 1).count() <= JOINT_ROWS:
        each = joint.orderBy("answers").toPandas()
        flat_ = [(k, *a) for k, own in enumerate(each["answers"]) for a in own]
        of, p = np.array([f[0] for f in flat_], dtype=np.int64), np.array([f[5] for f in flat_], dtype=float)
        cell, at = np.unique(np.array([f[1:5] for f in flat_], dtype=np.int64).reshape(-1, 4), axis=0, return_inverse=True)
        shared = spark.sparkContext.broadcast((cell, of, at.ravel(), p, each["cases"].to_numpy(dtype=float)))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cell, of, at, p, cases = shared.value
            for part in parts:
                for rep in part["id"]:
                    yield fitted(int(rep), _drawn_cells(cell, of, at, p, np.random.default_rng([seed, int(rep)]).poisson(cases)))

        fits = spark.range(reps, numPartitions=reps).mapInPandas(run, schema)
    else:
        many = joint.count()
        own = F.get("answers", F.lit(0))
        keyed = joint.select(F.xxhash64("answers").alias("key"), "answers", "cases")
        # cases of one cell lie together, in some tasks if they are many; numbers of partitions are given, so none are joined
        keyed = keyed.repartition(1 + many // CASES_A_TASK, *(own[c] for c in CELL), F.pmod("key", F.lit(1 + many // CASES_A_DEAL)))

        def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, np.ndarray] = {}

            def summed() -> Iterator[pd.DataFrame]:
                for cell, total in held.items():
                    drawn = np.flatnonzero(total[0] > 0)
                    yield pd.DataFrame(dict(zip(CELL, cell, strict=True)) | {"n": total[0][drawn], "s": total[1][drawn], "q": total[2][drawn], "rep": drawn})
                held.clear()

            for part in parts:
                for begin in range(0, len(part), 2_000):
                    some = part.iloc[begin : begin + 2_000]
                    weight = np.stack([np.random.default_rng([seed, int(k) & (2**63 - 1)]).poisson(c, reps) for k, c in zip(some["key"], some["cases"], strict=True)])
                    flat_ = [(k, *(a[c] for c in CELL), a["p_no"]) for k, own in enumerate(some["answers"]) for a in own]
                    of, p = np.array([f[0] for f in flat_]), np.array([f[5] for f in flat_])
                    cell, at = np.unique(np.array([f[1:5] for f in flat_]).reshape(-1, 4), axis=0, return_inverse=True)
                    order = np.argsort(at.ravel(), kind="stable")
                    starts, w, p = np.searchsorted(at.ravel()[order], np.arange(len(cell))), weight[of[order]].astype(float), p[order, None]
                    sums = np.stack([np.add.reduceat(w * x, starts, axis=0) for x in (1.0, p, p * p)], axis=1)
                    for name, total in zip(map(tuple, cell.tolist()), sums, strict=True):
                        held[name] = held[name] + total if name in held else total
                    if len(held) > CELLS_HELD:
                        yield from summed()
            yield from summed()

        parts = keyed.mapInPandas(draw, ", ".join(f"{c} long" for c in CELL) + ", n double, s double, q double, rep int")
        table = parts.groupBy("rep", *CELL).agg(F.sum("n").alias("n"), F.sum("s").alias("_s"), F.sum("q").alias("_q")).withColumn("p_no", F.col("_s") / F.col("n"))
        table = table.select("rep", *CELL, "n", "p_no", F.greatest(F.col("_q") - F.col("_s") * F.col("p_no"), F.lit(0.0)).alias("rest"))
        fits = table.repartition(reps, "rep").groupBy("rep").applyInPandas(lambda part: fitted(int(part["rep"].iloc[0]), part), schema)
    spread = fits.select("ok", F.posexplode("values").alias("pos", "v")).groupBy("pos").agg(F.stddev_samp(F.when(F.col("ok"), F.col("v"))).alias("std_err"), F.count_if("ok").alias("reps"), F.count_if(~F.col("ok")).alias("failures"))
    names = spark.createDataFrame([(n, name, float(v)) for n, (name, v) in enumerate(zip(estimate.names, estimate.values, strict=True))], "pos int, parameter string, estimate double")
    return names.join(spread, "pos").select("parameter", "estimate", "std_err", "reps", "failures")


def two_parameter_fits(vx: np.ndarray, vy: np.ndarray, px: np.ndarray, py: np.ndarray, weights: np.ndarray, start: tuple[float, float] = (0.0, 0.0), iterations: int = 200):
    """lambda, eta, cost, converged and 2 x 2 information of each row of ``weights`` [fits, cells], all fits at once."""
    v, o, y = np.r_[vx, vy], np.r_[vy, vx], np.r_[px, py]
    w = np.concatenate([weights, weights], axis=1)
    many = len(weights)
    theta, damping = np.tile(np.array(start, float), (many, 1)), np.full(many, 1e-3)

    def parts(t: np.ndarray):
        p = 1 / (1 + np.exp(-np.clip((1 + t[:, :1]) * v - o + t[:, 1:], -500, 500)))
        r, s = y - p, p * (1 - p)
        ws2 = w * s * s
        a11, a12, a22 = (ws2 * v * v).sum(1), (ws2 * v).sum(1), ws2.sum(1)
        g = np.stack([(w * s * r * v).sum(1), (w * s * r).sum(1)], 1)
        return a11, a12, a22, g, 0.5 * (w * r * r).sum(1)

    now = parts(theta)
    open_, met = np.ones(many, bool), np.zeros(many, bool)
    for _ in range(iterations):
        a11, a12, a22, g, cost = now
        b11, b22 = a11 + damping * np.maximum(a11, 1e-12), a22 + damping * np.maximum(a22, 1e-12)
        det = b11 * b22 - a12 * a12
        det = np.where(np.abs(det) > 1e-300, det, 1e-300)
        move = np.stack([(b22 * g[:, 0] - a12 * g[:, 1]) / det, (b11 * g[:, 1] - a12 * g[:, 0]) / det], 1)
        trial = np.where(open_[:, None], theta + move, theta)
        new = parts(trial)
        better = open_ & (new[4] <= cost)
        settled = better & (cost - new[4] <= 1e-12 * (cost + 1e-12))
        theta = np.where(better[:, None], trial, theta)
        now = tuple(np.where(better[:, None] if x.ndim == 2 else better, x, z) for x, z in zip(new, now, strict=True))
        damping = np.where(better, damping / 5, np.where(open_, damping * 8, damping))
        met |= settled
        stuck = open_ & ~settled & (damping > 1e12)
        if stuck.any():  # no step lowers the cost: at the least of it if the gradient is flat
            a11, a12, a22, g, cost = now
            det = a11 * a22 - a12 * a12
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (a22 * g[:, 0] ** 2 - 2 * a12 * g[:, 0] * g[:, 1] + a11 * g[:, 1] ** 2) / det
            met |= stuck & (gain <= 1e-12 * (cost + 1e-12))
        open_ &= ~settled & ~stuck
        if not open_.any():
            break
    return theta[:, 0], theta[:, 1], now[4], met & np.isfinite(theta).all(1), np.stack([now[0], now[1], now[1], now[2]], 1).reshape(-1, 2, 2)


def condition(information: np.ndarray) -> np.ndarray:
    """Condition of the Jacobian from J'J, for each of several fits."""
    values = np.linalg.eigvalsh(information)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(values[:, 0] > 0, np.sqrt(values[:, -1] / values[:, 0]), np.inf)


def utility_cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, u_x, u_y, p_no_x, p_no_y (means), weight, rest: answers of equal utilities summed to one row."""
    ok = rows.dropna(subset=["u_x", "u_y", "p_no_x", "p_no_y"])
    w = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    aggs = [F.sum(w).alias("weight")]
    for c in ("p_no_x", "p_no_y"):
        aggs += [F.sum(w * F.col(c)).alias(f"_s_{c}"), F.sum(w * F.col(c) * F.col(c)).alias(f"_q_{c}")]
    out = ok.groupBy(*by, "u_x", "u_y").agg(*aggs)
    mean = {c: F.col(f"_s_{c}") / F.col("weight") for c in ("p_no_x", "p_no_y")}
    rest = sum((F.greatest(F.col(f"_q_{c}") - F.col("weight") * m * m, F.lit(0.0)) for c, m in mean.items()), F.lit(0.0))
    return out.select(*by, "u_x", "u_y", *(m.alias(c) for c, m in mean.items()), "weight", rest.alias("rest"))


def lambda_eta(rows: DataFrame, by: list[str], starts: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.0, 0.0), (5.0, 1.0)), least: float = 0.0) -> DataFrame:
    """by, lambda, eta, cost, n, converged, jac_cond, multistart_sd: two-parameter fits given utilities, a group in a task.

    ``rows``: by, u_x, u_y, p_no_x, p_no_y and optionally weight. Answers of equal utilities are summed first, so a group
    is bounded by the design. Groups of fewer than ``least`` answers are left out.
    """
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        w = part["weight"].to_numpy(float)
        if w.sum() < least:
            return pd.DataFrame(columns=[*by, "lambda", "eta", "cost", "n", "converged", "jac_cond", "multistart_sd"])
        fits = [two_parameter_fits(*(part[c].to_numpy(float) for c in ("u_x", "u_y", "p_no_x", "p_no_y")), w[None], s) for s in starts]
        lam, eta, cost, ok, info = min(fits, key=lambda f: f[2][0])
        sd = float(np.std([f[0][0] for f in fits]))
        return pd.DataFrame({c: [part[c].iloc[0]] for c in by} | {"lambda": lam, "eta": eta, "cost": cost + 0.5 * part["rest"].sum(), "n": [int(round(w.sum()))], "converged": ok, "jac_cond": condition(info), "multistart_sd": [sd]})

    return utility_cells(rows, by).groupBy(*by).applyInPandas(run, f"{keys}, lambda double, eta double, cost double, n long, converged boolean, jac_cond double, multistart_sd double")


def lambda_eta_bootstrap(rows: DataFrame, cluster: list[str], reps: int = 2_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: lambda, eta of all rows, their errors and percentile intervals over replicates that draw whole clusters, reps, failures, clusters.

    A replicate refits both parameters. Clusters are pairs of goods, so their table and that of the utilities within them
    are bounded by the design; draws are made by hash and joined to the clusters by their place.
    """
    from ..functions.codes import hash_draw
    from .ordered import places

    spark = rows.sparkSession
    summed = utility_cells(rows, cluster)
    placed = places(summed.select(*cluster).distinct(), cluster, "_ix").persist()
    many = placed.count()
    draws = spark.range(reps * many).select(F.floor(F.col("id") / many).cast("long").alias("rep"), F.pmod("id", F.lit(many)).alias("slot"))
    counts = draws.select("rep", hash_draw(many, seed, F.col("rep"), F.col("slot")).alias("_ix")).groupBy("rep", "_ix").agg(F.count("*").alias("_w"))
    table = summed.join(placed, cluster)
    drawn = counts.join(table, "_ix").withColumn("weight", F.col("weight") * F.col("_w")).select("rep", "u_x", "u_y", "p_no_x", "p_no_y", "weight")
    fits = lambda_eta(drawn, ["rep"], ((0.0, 0.0),))
    ok = F.col("converged")
    over = lambda c, f: f(F.when(ok, F.col(c)))
    aggs = [F.count_if(ok).alias("reps"), F.count_if(~ok).alias("failures")]
    for c in ("lambda", "eta"):
        aggs += [over(c, F.stddev_samp).alias(f"{c}_se"), F.percentile(F.when(ok, F.col(c)), F.lit(alpha / 2)).alias(f"{c}_low"), F.percentile(F.when(ok, F.col(c)), F.lit(1 - alpha / 2)).alias(f"{c}_high")]
    point = lambda_eta(rows.withColumn("_all", F.lit(1)), ["_all"]).select("lambda", "eta", "n", "jac_cond")
    return point.crossJoin(F.broadcast(fits.agg(*aggs))).withColumn("clusters", F.lit(many))  # one row each


def lambda_eta_without_each_good(rows: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """good, lambda, eta, n, converged of refits without the cases that touch the good; fewer than ``least`` cases give none.

    ``rows``: a, b, u_x, u_y, p_no_x, p_no_y. The goods are a bounded list; the rows are summed by pair and utility first.
    """
    summed = utility_cells(rows, [a, b])
    goods = sorted(r[0] for r in summed.select(F.explode(F.array(a, b)).alias("g")).distinct().collect())  # a row a good
    left = summed.withColumn("good", F.explode(F.array(*map(F.lit, goods)))).where((F.col("good") != F.col(a)) & (F.col("good") != F.col(b)))
    return lambda_eta(left.select("good", "u_x", "u_y", "p_no_x", "p_no_y", "weight"), ["good"], least=least).select("good", "lambda", "eta", "n", "converged")


def normal_equations(rows: DataFrame, x: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Sums of products of the regressors and the outcome: one row a group, combined before the exchange."""
    products = [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    return rows.groupBy(*(by or [])).agg(*products, *(F.sum(F.col(a) * F.col(y)).alias(f"xy_{i}") for i, a in enumerate(x)), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))


def _solve(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    xx = np.array([[row[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return np.linalg.pinv(xx), np.array([row[f"xy_{i}"] for i in range(k)], dtype=float)


def ols(rows: DataFrame, x: list[str], y: str, cluster: list[str]) -> Fit:
    """Least squares with one-way cluster-robust covariance and the usual finite-sample factor."""
    total = normal_equations(rows, x, y).first()
    k = len(x)
    bread, xy = _solve(total, k)
    beta = bread @ xy
    residual = F.col(y) - sum((F.col(c) * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0))
    scores = rows.withColumn("_e", residual).groupBy(*cluster).agg(*(F.sum(F.col(c) * F.col("_e")).alias(f"_{i}") for i, c in enumerate(x)), F.sum(F.col("_e") * F.col("_e")).alias("_sse"))
    outer = scores.agg(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)), F.count("*").alias("g"), F.sum("_sse").alias("sse")).first()
    meat = np.array([[outer[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    g, n = outer["g"], total["n"]
    factor = g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
    return Fit(list(x), beta, factor * bread @ meat @ bread, float(outer["sse"]), n, True, [])


def leave_one_good_out_ols(rows: DataFrame, x: list[str], y: str, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Estimates without each good, and their jackknife covariance; from the totals less the rows that touch the good."""
    sums = normal_equations(rows, x, y)
    total = sums.first()
    sides = rows.withColumn("_good", F.explode(F.array(F.col(a), F.col(b))))
    per = normal_equations(sides, x, y, ["_good"]).orderBy("_good").collect()  # one row of sums a good
    k, names = len(x), [c for c in sums.columns if c != "n"]
    out = []
    for row in per:
        inverse, xy = _solve({c: total[c] - row[c] for c in names}, k)
        out.append(inverse @ xy)
    estimates = np.array(out)
    centred = estimates - estimates.mean(axis=0)
    return estimates, (len(out) - 1) / len(out) * centred.T @ centred


def grouped_folds(rows: DataFrame, x: list[str], y: str, group: list[str], k: int) -> DataFrame:
    """fold, n, mse: each fold's error under the fit to the others; fold = place of the sorted group modulo k."""
    from .ordered import places

    folded = rows.join(places(rows.select(*group).distinct(), group, "_place").withColumn("fold", F.pmod("_place", F.lit(k)).cast("int")), group)
    sums = normal_equations(folded, x, y, ["fold"]).collect()  # k rows
    names = [c for c in sums[0].asDict() if c not in ("fold", "n")] if sums else []
    total = {c: sum(r[c] for r in sums) for c in names}
    out = []
    for r in sums:
        inverse, xy = _solve({c: total[c] - r[c] for c in names}, len(x))
        beta = inverse @ xy
        own = np.array([r[f"xy_{i}"] for i in range(len(x))])
        xx = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))])
        out.append((int(r["fold"]), int(r["n"]), float((r["yy"] - 2 * beta @ own + beta @ xx @ beta) / r["n"])))
    return rows.sparkSession.createDataFrame(out, "fold int, n long, mse double")


#: Rows of a design that recovery broadcasts.
DESIGN_ROWS = 100_000


def recovery(spark, cells_: list[tuple[float, float]], reps: int = 100, n: int = 1_000, boots: int = 200, seed: int = 0, spread: float = 0.4, binary: bool = False, design: DataFrame | None = None) -> DataFrame:
    """cell, lambda, eta, reps, failures, failure_rate, biases and their sds, coverage of 95 % intervals, jac_cond, lambda_se, weak_identification.

    Each replicate makes answers, fits both parameters, and fits them again to ``boots`` draws of its cases, all in its own
    task. Without a ``design`` it makes ``n`` cases too, and with ``binary`` the answers are draws, not probabilities. A
    ``design`` (u_x, u_y, weight: a row each pair of utilities, with its number of cases) is the parametric bootstrap of a given
    table: as many cases of each pair answer by chance, and cases of equal answers count as one row.
    """
    grid = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cells_)], "cell int, true_lambda double, true_eta double")
    runs = grid.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(max(1, len(cells_) * reps // 10), "cell", "rep")
    given = None
    if design is not None:
        rows = design.select("u_x", "u_y", F.col("weight").cast("long").alias("weight")).orderBy("u_x", "u_y").limit(DESIGN_ROWS + 1).toPandas()
        if len(rows) > DESIGN_ROWS:
            raise ValueError(f"a design of more than {DESIGN_ROWS} pairs of utilities")
        given = spark.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in rows))

    def answered(draw: np.random.Generator, lam: float, eta: float) -> tuple:
        """Utilities, answers and number of cases of each row."""
        chance = lambda a, b: 1 / (1 + np.exp(-((1 + lam) * a - b + eta)))
        if given is None:
            vx, vy = np.exp(draw.normal(0, spread, n)), np.exp(draw.normal(0, spread, n))
            p, q = chance(vx, vy), chance(vy, vx)
            if binary:
                p, q = draw.binomial(1, p).astype(float), draw.binomial(1, q).astype(float)
            return vx, vy, p, q, np.ones(n, dtype=np.int64)
        vx, vy, many = given.value
        p, q = chance(vx, vy), chance(vy, vx)
        kinds = draw.multinomial(many, np.stack([p * q, p * (1 - q), (1 - p) * q, (1 - p) * (1 - q)], axis=-1))
        at, kind = np.nonzero(kinds)
        return vx[at], vy[at], (kind < 2).astype(float), (kind % 2 == 0).astype(float), kinds[at, kind]

    def one(lam: float, eta: float, cell: int, rep: int) -> tuple:
        draw = np.random.default_rng([seed, cell, rep])
        vx, vy, p, q, many = answered(draw, lam, eta)
        got = two_parameter_fits(vx, vy, p, q, many[None].astype(float))
        weights = draw.multinomial(many.sum(), many / many.sum(), size=boots).astype(float)
        a, b, _, ok, _ = two_parameter_fits(vx, vy, p, q, weights, (float(got[0][0]), float(got[1][0])))
        if not (got[3][0] and ok.any()):
            return cell, rep, None, None, None, None, None, None
        inside = [bool(lo <= t <= hi) for t, (lo, hi) in ((lam, np.percentile(a[ok], [2.5, 97.5])), (eta, np.percentile(b[ok], [2.5, 97.5])))]
        return cell, rep, float(got[0][0] - lam), float(got[1][0] - eta), float(condition(got[4])[0]), float(np.std(a[ok], ddof=1)), *inside

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [one(r.true_lambda, r.true_eta, int(r.cell), int(r.rep)) for r in part.itertuples()]
            yield pd.DataFrame(rows, columns=["cell", "rep", "off_lambda", "off_eta", "cond", "se", "in_lambda", "in_eta"])

    done = runs.mapInPandas(run, "cell int, rep int, off_lambda double, off_eta double, cond double, se double, in_lambda boolean, in_eta boolean")
    sums = done.groupBy("cell").agg(
        F.count("*").alias("reps"),
        F.count_if(F.col("off_lambda").isNull()).alias("failures"),
        F.avg("off_lambda").alias("bias_lambda"),
        F.stddev_pop("off_lambda").alias("sd_lambda"),
        F.avg("off_eta").alias("bias_eta"),
        F.stddev_pop("off_eta").alias("sd_eta"),
        F.avg(F.col("in_lambda").cast("double")).alias("coverage_lambda"),
        F.avg(F.col("in_eta").cast("double")).alias("coverage_eta"),
        F.median("cond").alias("jac_cond"),
        F.median("se").alias("lambda_se"),
    )
    named = grid.select("cell", F.col("true_lambda").alias("lambda"), F.col("true_eta").alias("eta"))
    return named.join(sums, "cell").withColumn("failure_rate", F.col("failures") / F.col("reps")).withColumn("weak_identification", F.col("jac_cond") > 1e6)
