"""Answers in free text: yes or no, numbers, tokens, identifiers in names and metrics in log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shape of a number in an answer.
NUMBER = r"-?\$?\d[\d,]*(?:\.\d+)?"
#: The answer forms by name, in the order in which they are tried; the last match of a form counts.
FORMS = (
    ("answer_is", rf"(?i)the\s+answer\s+is\s*({NUMBER})"),
    ("hash_marker", rf"####\s*({NUMBER})"),
    ("boxed", rf"\\boxed\s*\{{\s*({NUMBER})\s*\}}"),
    ("last_number", rf"({NUMBER})"),
)


def after_reasoning(text: Column) -> Column:
    """What follows the last ``</think>``, or all of the text."""
    return F.substring_index(F.coalesce(text, F.lit("")), "</think>", -1)


def yes_no(text: Column) -> Column:
    """'Yes', 'No' or '': by the letters of the first word after any reasoning."""
    first = F.coalesce(F.get(F.filter(F.split(after_reasoning(text), r"\s+"), lambda w: w != ""), F.lit(0)), F.lit(""))
    word = F.lower(F.regexp_replace(first, "[^a-zA-Z]", ""))
    return F.when(word.isin("yes", "y"), "Yes").when(word.isin("no", "n"), "No").otherwise("")


def letters(text: Column) -> Column:
    """The lower-case letters a to z of a text."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def option_token(text: Column) -> Column:
    """yes, no, keep or trade if the token starts so; a or b for the letter with or without brackets or a stop."""
    t = F.lower(F.trim(text))
    out = None
    for word in ("yes", "no", "keep", "trade"):
        out = F.when(t.startswith(word), word) if out is None else out.when(t.startswith(word), word)
    return out.when(t.isin("a", "(a)", "a."), "a").when(t.isin("b", "(b)", "b."), "b").otherwise(t)


def normalized_number(text: Column) -> Column:
    """The text without surrounding space, commas, dollar signs and final stops."""
    return F.regexp_replace(F.translate(F.trim(text), ",$", ""), r"\.+$", "")


def solution_answer(text: Column) -> Column:
    """The number on the line after the last ``####``; null without one."""
    line = F.get(F.split(F.trim(F.substring_index(text, "####", -1)), "\n"), F.lit(0))
    return F.when(text.contains("####"), normalized_number(line))


def predicted_answer(text: Column) -> Column:
    """Struct (answer, method): the last match of the first form that matches; (null, 'unparsed') if none does."""
    out = None
    for method, pattern in FORMS:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        hit = F.struct(normalized_number(F.element_at(found, -1)).alias("answer"), F.lit(method).alias("method"))
        out = F.when(F.size(found) > 0, hit) if out is None else out.when(F.size(found) > 0, hit)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("answer"), F.lit("unparsed").alias("method")))


def run_ids(name: Column) -> Column:
    """Struct (seed, step) of a model name: ``seedS-ckptN``, or ``ckptN`` of seed 0, or ``-stepN``; nulls if none fits."""

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(name, pattern, group).try_cast("int") if hasattr(Column, "try_cast") else F.regexp_extract(name, pattern, group).cast("int")

    both = r"seed(\d+)-ckpt(\d+)"
    return F.when(name.rlike(both), F.struct(number(both, 1).alias("seed"), number(both, 2).alias("step"))).when(
        name.rlike(r"ckpt(\d+)"), F.struct(F.lit(0).alias("seed"), number(r"ckpt(\d+)", 1).alias("step"))
    ).otherwise(F.struct(F.lit(None).cast("int").alias("seed"), number(r"-step(\d+)", 1).alias("step")))


def metric(line: Column, name: str) -> Column:
    """The number that a log line gives as ``'name': value``, quoted or not; null if it has none."""
    text = F.regexp_extract(line, rf"'{name}':\s*'?(-?[0-9.]+(?:[eE][-+]?[0-9]+)?|nan|inf|-inf)'?", 1)
    return F.when(text == "", None).otherwise(text).try_cast("double")


def percent_placeholder(template: Column, p: Column) -> Column:
    """A template whose placeholder X% or XX% stands for the probability in whole percent."""
    return F.regexp_replace(template, r"X{1,2}%", F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%")))
