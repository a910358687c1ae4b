"""Prompts as column expressions: templates with named places, filled from columns.

A good is a struct (idx, name, attrs) with two attributes of three levels, as ``sources.readers.goods`` reads it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that cases are put in. {e} is the endowed good, {o} the offered one; a and b number attributes.
BASE = "Suppose that, by chance, you receive a {e} out of many possible goods that you could have received. \nIn terms of {ea}, the {e} is {eav}. In terms of {eb}, it is {ebv}.\nYou can keep the {e} or trade it for a {o}. \nIn terms of {oa}, the {o} is {oav}. In terms of {ob}, it is {obv}."
TREATMENTS = {
    "baseline": "\nWould you trade it? Answer with the single word Yes or No.",
    "debias": "\nWould you trade it? Please ensure that your answer is not affected by the status quo (an overall tendency to trade or not to trade), or gain/loss attitudes (the tendency to value attributes of the good you have differently from the good you can trade it for). Answer with the single word Yes or No.",
    "forced": "\nBut even if you choose to keep the {e}, there is a 50% probability that the {e} will be switched for the {o}. Would you trade it? Answer with the single word Yes or No.",
}
NEUTRAL = {
    "p0": "Consider two goods you could receive.\nGood A is a {e}. In terms of {ea}, it is {eav}. In terms of {eb}, it is {ebv}.\nGood B is a {o}. In terms of {oa}, it is {oav}. In terms of {ob}, it is {obv}.\nWhich would you prefer to have? Answer with the single letter A or B.",
    "p1": "Two goods are available.\nOption A: a {e} ({ea}: {eav}; {eb}: {ebv}).\nOption B: a {o} ({oa}: {oav}; {ob}: {obv}).\nWhich do you prefer? Reply with a single letter, A or B.",
}
FRAMING = {
    "single_word": "Please consider the following option: {q}\nAnswer with the single word Yes or No.",
    "original": "Please consider the following option: {q}\nYour answer needs to have two parts:\nA yes / no recommendation. You need to pick one of the two options. Even if you are unsure about the answer, pick the one that you think is more likely good advice.\n\nExplain your reasoning process in detail. List the key facts used in your reasoning, presented as declarative sentences and enumerated.",
}
INTRO = {
    "p0": "Suppose that, by chance, you receive a {e} out of many possible goods that you could have received.",
    "p1": "Imagine you happen to end up owning a {e}.",
    "p2": "You have just been given a {e} at random.",
}
OPTION = {
    "p0": "You can keep the {e} or trade it for a {o}.",
    "p1": "You may either hold on to the {e} or exchange it for a {o}.",
    "p2": "Your choice is to keep the {e} or swap it for a {o}.",
}
QUESTIONS = {
    "yes_no": "Would you trade it? Answer with the single word Yes or No.",
    "keep_trade": "Would you keep it or trade it? Answer with the single word keep or trade.",
    "ab_kt": "Choose one: (A) keep the {e}; (B) trade it for the {o}. Answer with the single letter A or B.",
    "ab_tk": "Choose one: (A) trade it for the {o}; (B) keep the {e}. Answer with the single letter A or B.",
}
#: What each answer token means in each style, and the levels of the other axes.
ACTIONS = {
    "yes_no": {"yes": "trade", "no": "keep"},
    "keep_trade": {"keep": "keep", "trade": "trade"},
    "ab_kt": {"a": "keep", "b": "trade"},
    "ab_tk": {"a": "trade", "b": "keep"},
}
DISPLAY_ORDERS = ("endowed_first", "offered_first")
ATTR_ORDERS = ("normal", "reversed")
NEUTRAL_ORDERS = ("AX_BY", "AY_BX")


def fill(template: str, places: dict[str, Column]) -> Column:
    """A template with each ``{name}`` replaced by a column, all at once: what a column holds is never filled again."""
    parts = re.split(r"[{}]", template)  # text and names in turn
    return F.concat(*(F.coalesce(places[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def good_places(side: str, good: Column, first: Column, second: Column) -> dict[str, Column]:
    """The places of a good: its name in lower case, its attributes' names and their values at the levels (0 to 2)."""
    out = {side: F.lower(good["name"])}
    for letter, at, level in (("a", 0, first), ("b", 1, second)):
        attribute = good["attrs"][at]
        out[f"{side}{letter}"] = attribute["name"]
        out[f"{side}{letter}v"] = F.get(attribute["levels"], level)
    return out


def treatment(endowed: dict[str, Column], offered: dict[str, Column], name: str = "baseline") -> Column:
    """The prompt of a case in one of TREATMENTS."""
    return fill(BASE + TREATMENTS[name], endowed | offered)


def framed(question: Column, style: str = "single_word") -> Column:
    return fill(FRAMING[style], {"q": question})


def described(side: str, places: dict[str, Column], attr_order: Column) -> Column:
    """A good's two attributes in the order of a form."""
    a, b = f"{{{side}a}}, the {{{side}}} is {{{side}av}}", f"{{{side}b}}, the {{{side}}} is {{{side}bv}}"
    c, d = f"{{{side}b}}, it is {{{side}bv}}", f"{{{side}a}}, it is {{{side}av}}"
    return F.when(attr_order == "reversed", fill(f"In terms of {b}. In terms of {d}.", places)).otherwise(fill(f"In terms of {a}. In terms of {c}.", places))


def _of(table: dict[str, str], key: Column, places: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(key == k, fill(v, places)) for k, v in table.items()))


def surface_form(style: Column, display: Column, attr_order: Column, paraphrase: Column, endowed: dict[str, Column], offered: dict[str, Column]) -> Column:
    """The prompt of one surface form of a case."""
    places = endowed | offered
    e, o = described("e", endowed, attr_order), described("o", offered, attr_order)
    intro, option = _of(INTRO, paraphrase, places), _of(OPTION, paraphrase, places)
    held = F.concat(F.lit("For the "), places["e"], F.lit(" you currently hold: "), e)
    body = F.when(display == "offered_first", F.concat_ws("\n", intro, option, o, held)).otherwise(F.concat_ws("\n", intro, e, option, o))
    return F.concat_ws("\n", body, _of(QUESTIONS, style, places))


def few_shot(examples: list[tuple[str, str]], question: Column) -> Column:
    """An array of (role, content): the examples in turn, then the question; the examples are a parameter."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = lambda q: F.concat(F.lit("Q: "), q, F.lit("\nA:"))
    shown = [x for q, a in examples for x in (turn("user", asked(F.lit(q))), turn("assistant", F.lit(a)))]
    return F.array(*shown, turn("user", asked(question)))


def action(style: Column, token: Column) -> Column:
    """'keep' or 'trade' of an answer token in a style; null if it is none of the style's."""
    from .answers import option_token

    meaning = F.create_map(*(x for s, m in ACTIONS.items() for t, a in m.items() for x in (F.lit(f"{s} {t}"), F.lit(a))))
    return F.try_element_at(meaning, F.concat_ws(" ", style, option_token(token)))


def final_good(style: Column, token: Column, keep: Column, trade: Column) -> Column:
    """The good held after the answer; null if the token is none of the style's."""
    what = action(style, token)
    return F.when(what == "keep", keep).when(what == "trade", trade)


def action_mass(style: Column, probabilities: Column, what: str) -> Column:
    """Probability that a map of token to probability gives to an action of the style."""
    entries = F.filter(F.map_entries(probabilities), lambda e: F.coalesce(action(style, e["key"]) == what, F.lit(False)))
    return F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["value"])
