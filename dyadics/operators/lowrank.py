"""Statistics of low-rank matrices s * B A given as factors, a module in a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(r, dtype=float) for r in rows])


def spectrum(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """Singular values of scale * b @ a from two small QR factors; the product itself is never formed."""
    ra, rb = np.linalg.qr(a.T, mode="r"), np.linalg.qr(b, mode="r")
    return abs(scale) * np.linalg.svd(rb @ ra.T, compute_uv=False)


def inner(a1, b1, s1, a2, b2, s2) -> float:
    """Frobenius inner product of two products, through the small Gram matrices."""
    return float(s1 * s2 * np.sum((b2.T @ b1) * (a2 @ a1.T)))


def module_table(factors: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """keys, fro, spectral, singular (descending) of each row's ``A`` [r, in] and ``B`` [out, r]."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in factors.select(*keys).schema)

    def run(parts):
        for part in parts:
            values = [spectrum(_matrix(a), _matrix(b), scale) for a, b in zip(part["A"], part["B"], strict=True)]
            out = part[keys].copy()
            out["fro"], out["spectral"] = [float(np.sqrt((v * v).sum())) for v in values], [float(v[0]) if len(v) else 0.0 for v in values]
            out["singular"] = [v.tolist() for v in values]
            yield out

    return factors.select(*keys, "A", "B").mapInPandas(run, f"{types}, fro double, spectral double, singular array<double>")


def power_norms(factors: DataFrame, keys: list[str], scale: float = 1.0, rounds: int = 200, chunk: int = 4_096, seed: int = 3) -> DataFrame:
    """keys, fro, spectral_power of scale * B A without a factorisation: the sum of squares by chunks of rows, and subspace iteration."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in factors.select(*keys).schema)

    def norms(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        total = sum(float((np.square(scale * b[i : i + chunk] @ a)).sum()) for i in range(0, len(b), chunk))
        x = np.linalg.qr(np.random.default_rng(seed).normal(size=(a.shape[1], min(len(a) + 2, a.shape[1]))))[0]
        for _ in range(rounds):
            x = np.linalg.qr(a.T @ (b.T @ (b @ (a @ x))))[0]
        return total**0.5, float(abs(scale) * np.linalg.norm(b @ (a @ x), 2))

    def run(parts):
        for part in parts:
            out = part[keys].reset_index(drop=True)
            found = [norms(_matrix(a), _matrix(b)) for a, b in zip(part["A"], part["B"], strict=True)]
            out["fro"], out["spectral_power"] = [f for f, _ in found], [p for _, p in found]
            yield out

    return factors.select(*keys, "A", "B").mapInPandas(run, f"{types}, fro double, spectral_power double")


def module_key(name: Column, modules: tuple[str, ...]) -> Column:
    """Struct (layer, module) of a tensor's name with a low-rank factor of one of the modules; null for other names."""
    pattern = rf"layers\.(\d+)\..*?({'|'.join(modules)})\.lora_[AB]\."
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).cast("int").alias("layer"), F.regexp_extract(name, pattern, 2).alias("module")))


def config_faults(configs: DataFrame, expected: dict[str, str]) -> DataFrame:
    """file, name, found, expected of adapters' settings (file, settings: a map) that differ from what is expected."""
    wanted = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))
    each = configs.select("file", "settings", F.explode(wanted).alias("name", "expected"))
    found = F.try_element_at("settings", F.col("name"))
    return each.where(~found.eqNullSafe(F.col("expected"))).select("file", "name", found.alias("found"), "expected")


def compare(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cosine, fro_one, fro_two, difference of the modules that both tables have."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.select(*keys).schema)
    both = one.select(*keys, F.col("A").alias("A1"), F.col("B").alias("B1")).join(two.select(*keys, F.col("A").alias("A2"), F.col("B").alias("B2")), keys)

    def run(parts):
        for part in parts:
            rows = []
            for a1, b1, a2, b2 in zip(part["A1"], part["B1"], part["A2"], part["B2"], strict=True):
                m = [_matrix(x) for x in (a1, b1, a2, b2)]
                x, y, xy = inner(m[0], m[1], 1, m[0], m[1], 1), inner(m[2], m[3], 1, m[2], m[3], 1), inner(m[0], m[1], 1, m[2], m[3], 1)
                rows.append((xy / np.sqrt(x * y) if x > 0 and y > 0 else None, np.sqrt(x), np.sqrt(y), np.sqrt(max(x + y - 2 * xy, 0))))
            yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["cosine", "fro_one", "fro_two", "difference"])], axis=1)

    return both.mapInPandas(run, f"{types}, cosine double, fro_one double, fro_two double, difference double")


def cosine_null(spark, shape: tuple[int, int], rank: int, draws: int, seed: int) -> DataFrame:
    """draw, cosine of pairs of random products of a shape: what unrelated modules give."""

    def run(parts):
        for part in parts:
            out = []
            for i in part["id"]:
                d = np.random.default_rng([seed, int(i)])
                m = [d.normal(size=s) for s in ((rank, shape[1]), (shape[0], rank), (rank, shape[1]), (shape[0], rank))]
                x, y = inner(m[0], m[1], 1, m[0], m[1], 1), inner(m[2], m[3], 1, m[2], m[3], 1)
                out.append((int(i), inner(m[0], m[1], 1, m[2], m[3], 1) / np.sqrt(x * y)))
            yield pd.DataFrame(out, columns=["draw", "cosine"])

    return spark.range(draws).mapInPandas(run, "draw long, cosine double")


def permuted_cosines(factors: DataFrame, key: str, seed: int) -> DataFrame:
    """key, other, cosine, fro_one, fro_two, difference: each module with one that a derangement gives it, so with another's.

    Modules are put in the order of a hash and each meets the next, the last the first: none meets itself if there are two.
    What cosines come out is what the given modules have by chance, whatever the law of their numbers.
    """
    from ..functions.codes import hash_rank_key
    from .ordered import places

    ranked = places(factors.select(key, hash_rank_key(seed, F.col(key)).alias("_h")), ["_h", key], "_ix").drop("_h")
    many = F.lit(factors.count())
    own = factors.join(ranked, key)
    next_ = own.withColumn("_slot", F.pmod(F.col("_ix") - 1, many)).withColumnRenamed(key, "other")
    found = compare(own.withColumn("_slot", F.col("_ix")).select("_slot", "A", "B"), next_.select("_slot", "A", "B"), ["_slot"])
    named = ranked.withColumnRenamed("_ix", "_slot").join(next_.select("_slot", "other"), "_slot")
    return named.join(found, "_slot").drop("_slot")
