"""Rewards of answers, alone and in pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .choices import rational, rational_for_anchor

WEIGHTINGS = ("magnitude", "sign_only", "scale_matched")
SCALE_RULES = ("mean_abs", "rms", "median")
PAIR_WEIGHT, NEUTRAL_WEIGHT = 1.0, 1.0


def reward(answer: Column, perspective: Column, delta: Column, weighting: str = "magnitude", scale: float | None = None) -> Column:
    """Plus the weight for the rational answer, minus it for any other; 0 for delta 0."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"weighting is one of {WEIGHTINGS}")
    if weighting == "scale_matched" and not (scale and scale > 0):
        raise ValueError("scale_matched needs a positive scale")
    weight = {"magnitude": F.abs(delta), "sign_only": F.lit(1.0), "scale_matched": F.lit(float(scale or 0))}[weighting]
    return F.when(delta == 0, 0.0).when(answer == rational(perspective, delta), weight).otherwise(-weight)


def _parsed(answer: Column) -> Column:
    return F.coalesce(answer.isin("Yes", "No"), F.lit(False))


def pair_reward(x: Column, y: Column) -> Column:
    """1 if both perspectives pick the same good, else -1; an answer that is not parsed gives -1."""
    return F.when(_parsed(x) & _parsed(y) & (x != y), 1.0).otherwise(-1.0)


def neutral_reward(answer: Column, perspective: Column, preferred: Column) -> Column:
    """1 for the anchored good, -1 for any other answer, null without an anchor."""
    target = rational_for_anchor(perspective, preferred)
    return F.when(target.isNull(), None).when(_parsed(answer) & (answer == target), 1.0).otherwise(-1.0)


def gated_reward(x: Column, y: Column, preferred: Column, mode: str = "shaped") -> Column:
    """-1 for an inconsistent or unparsed pair; a consistent pair gets 1 for the anchored good (any good without an
    anchor), else 0 ('shaped') or -1 ('hard')."""
    if mode not in ("shaped", "hard"):
        raise ValueError("mode is 'shaped' or 'hard'")
    picked = F.when(x == "No", "X").otherwise("Y")
    correct = preferred.isNull() | (picked == preferred)
    wrong = 0.0 if mode == "shaped" else -1.0
    return F.when(_parsed(x) & _parsed(y) & (x != y), F.when(correct, 1.0).otherwise(wrong)).otherwise(-1.0)


def combined(*parts: tuple[float, Column]) -> Column:
    """Mean of the non-null values by their weights; 0 if all are null."""
    weight = reduce(lambda a, b: a + b, (F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in parts))
    total = reduce(lambda a, b: a + b, (F.coalesce(v * w, F.lit(0.0)) for w, v in parts))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def learning_rate(step: Column, peak: float, warmup: int, total: int) -> Column:
    """Linear warm-up then cosine to 0; the clock of step s reads s - 1."""
    at = step - 1
    progress = F.least(F.greatest((at - warmup) / F.lit(max(1, total - warmup)), F.lit(0.0)), F.lit(1.0))
    return F.when(at < warmup, F.lit(peak) * at / max(1, warmup)).otherwise(F.lit(peak) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)))
