"""Answers from probabilities, the rational answer, and divergences of two answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIES = ("yes", "no", "tie")


def choice(p_yes: Column, p_no: Column, tie: str) -> Column:
    """'Yes' or 'No' by the greater probability. ``tie`` says what equal ones give: 'yes', 'no' or 'tie' ('tie')."""
    if tie not in TIES:
        raise ValueError(f"tie is one of {TIES}")
    equal = {"yes": "Yes", "no": "No", "tie": "tie"}[tie]
    return F.when(p_yes > p_no, "Yes").when(p_yes < p_no, "No").when(p_yes == p_no, equal)


def rational(perspective: Column, delta: Column) -> Column:
    """The answer that picks the better good: X is better for delta > 0. '' for delta 0, null for a null delta."""
    x = F.when(delta > 0, "No").otherwise("Yes")
    y = F.when(delta > 0, "Yes").otherwise("No")
    return F.when(delta.isNull(), None).when(delta == 0, "").when(perspective == "X", x).otherwise(y)


def rational_for_anchor(perspective: Column, preferred: Column) -> Column:
    """The answer that picks the anchored good 'X' or 'Y'; null without an anchor."""
    return F.when(preferred.isin("X", "Y"), F.when(perspective == preferred, "No").otherwise("Yes"))


def chosen_good(perspective: Column, answer: Column) -> Column:
    """'X' or 'Y': the good held after the answer; null for other answers."""
    other = F.when(perspective == "X", "Y").otherwise("X")
    return F.when(answer == "No", perspective).when(answer == "Yes", other)


def pair_class(x: Column, y: Column) -> Column:
    """'consistent', 'keep_both', 'trade_both', or 'unparsed' if an answer is neither Yes nor No."""
    parsed = x.isin("Yes", "No") & y.isin("Yes", "No")
    return F.when(~F.coalesce(parsed, F.lit(False)), "unparsed").when(x != y, "consistent").when(x == "No", "keep_both").otherwise("trade_both")


def utility_score(chosen: Column, u_x: Column, u_y: Column) -> Column:
    """Utility of the chosen good relative to the better one; null unless both utilities are positive."""
    return F.when((u_x > 0) & (u_y > 0), F.when(chosen == "X", u_x).when(chosen == "Y", u_y) / F.greatest(u_x, u_y))


def valid_probability(p_yes: Column, p_no: Column) -> Column:
    """p_yes of the normalised pair; null for null, NaN, infinite or negative parts and for a sum of 0."""
    ok = F.lit(True)
    for p in (p_yes, p_no):
        ok = ok & p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf"))
    return F.when(ok & (p_yes + p_no > 0), p_yes / (p_yes + p_no))


def clipped(p: Column, eps: float = 1e-12) -> Column:
    """p of (p, 1 - p) clipped from below at ``eps`` and renormalised."""
    a, b = F.greatest(p, F.lit(eps)), F.greatest(1 - p, F.lit(eps))
    return a / (a + b)


def was_clipped(p: Column, eps: float = 1e-12) -> Column:
    """Whether clipping changes p or 1 - p."""
    return (p < eps) | (1 - p < eps)


def ln(x: Column) -> Column:
    """Natural logarithm with the values of floating point: minus infinity at 0 and NaN below, where Spark's is null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b with the values of floating point where b is 0: an infinity by the sign of a, NaN for 0 / 0."""
    over_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of Bernoulli p from q, in nats, in floating point: at 0 and 1 it is infinite or NaN unless both are clipped."""
    return p * ln(ratio(p, q)) + (1 - p) * ln(ratio(1 - p, 1 - q))


def js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of Bernoulli p and q, in nats."""
    m = (p + q) / 2
    return (kl(p, m) + kl(q, m)) / 2


def logit(p: Column, eps: float | None = 1e-6) -> Column:
    """log odds of p clipped to [eps, 1 - eps]; without ``eps`` they are infinite at 0 and 1."""
    c = p if eps is None else F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return ln(ratio(c, 1 - c))


def softmax(scores: Column) -> Column:
    """Probabilities from an array of log scores, shifted by the greatest."""
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def token_mass(tops: Column, words: tuple[str, ...]) -> Column:
    """Probability mass that an array of structs (token, logprob) gives to ``words``, case and white space aside."""
    mine = F.filter(tops, lambda t: F.lower(F.trim(t["token"])).isin(*words))
    return F.aggregate(mine, F.lit(0.0), lambda a, t: a + F.exp(t["logprob"]))
