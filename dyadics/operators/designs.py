"""Designs of experiments: which cases there are, in which forms, and what a catalogue of goods allows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prompts as pr
from ..functions.codes import CODES, levels
from .sampling import numbered

#: Levels 0 to 2 of two attributes: the first dominates the second if neither is lower and one is higher.
_PROFILES = [(a, b) for a in range(3) for b in range(3)]


def goods_pairs(goods: DataFrame, codes: list[int], per_pair: int, idx: str = "idx") -> DataFrame:
    """x_num, y_num, pair, codes: each unordered pair of goods with its turn of ``per_pair`` codes of a rotating schedule.

    Partners come from the indices themselves (0 to n - 1), so the pairs need no join.
    """
    n = goods.agg(F.max(idx)).first()[0]
    if n is None:
        n = -1
    firsts = goods.where(F.col(idx) < n).select(F.col(idx).cast("int").alias("x_num"))
    pairs = firsts.select("x_num", F.explode(F.sequence(F.col("x_num") + 1, F.lit(int(n)))).alias("y_num"))
    x, y = F.col("x_num").cast("long"), F.col("y_num").cast("long")
    place = (x * (2 * n + 1 - x)) / 2 + y - x - 1  # pairs before in the order of x, then y
    schedule = F.array(*map(F.lit, codes))
    turn = lambda k: F.element_at(schedule, (F.pmod(F.col("pair") * per_pair + k, F.lit(len(codes))) + 1).cast("int"))
    return pairs.withColumn("pair", place.cast("long")).withColumn("codes", F.transform(F.sequence(F.lit(0), F.lit(per_pair - 1)), turn))


def _surface_axes() -> dict[str, list[str]]:
    return {"answer_style": list(pr.ACTIONS), "display_order": list(pr.DISPLAY_ORDERS), "attr_order": list(pr.ATTR_ORDERS), "paraphrase": list(pr.INTRO)}


def _with_sides(rows: DataFrame) -> DataFrame:
    own = F.col("perspective") == "X"
    return rows.withColumns({"keep_good": F.when(own, F.col("x_num")).otherwise(F.col("y_num")), "trade_good": F.when(own, F.col("y_num")).otherwise(F.col("x_num"))})


def surface_forms(cases: DataFrame, goods: DataFrame | None = None) -> DataFrame:
    """``cases`` (case_id, perspective, x_num, y_num, code) in 48 forms: the axes, keep_good, trade_good, form_id, and with goods the prompt."""
    axes = _surface_axes()
    out = cases
    for axis, values in axes.items():
        out = out.withColumn(axis, F.explode(F.array(*map(F.lit, values))))
    own = F.col("perspective") == "X"
    out = _with_sides(out).withColumn("form_id", F.concat_ws(":", F.col("case_id").cast("string"), "perspective", *axes))
    if goods is None:
        return out
    placed = _placed(out, goods, "keep_good", "trade_good", own)
    e, o = pr.good_places("e", F.col("_e"), F.col("_e1"), F.col("_e2")), pr.good_places("o", F.col("_o"), F.col("_o1"), F.col("_o2"))
    return placed.withColumn("prompt", pr.surface_form(*(F.col(a) for a in axes), e, o)).select(*out.columns, "prompt")


def surface_form_ids(cases: DataFrame) -> DataFrame:
    """``cases`` (case_id, perspective, x_num, y_num) with keep_good, trade_good and form_ids, the ids of the 48 forms in one array."""
    marks = [":".join(m) for m in product(*_surface_axes().values())]
    head = F.concat_ws(":", F.col("case_id").cast("string"), "perspective", F.lit(""))
    return _with_sides(cases).withColumn("_head", head).withColumn("form_ids", F.array(*(F.concat("_head", F.lit(m)) for m in marks))).drop("_head")


def surface_summary(cases: DataFrame) -> DataFrame:
    """keep_good, trade_good, forms, ids (distinct), first_id and last_id over the forms of both sides of ``cases`` (case_id, x_num, y_num).

    No form leaves its task: a case's id is in the ids of all its forms, so forms of different cases are distinct, and only the
    cases are exchanged, once, to find those that occur again.
    """
    own = cases.groupBy("case_id", "x_num", "y_num").agg(F.count("*").alias("n"))
    forms = surface_form_ids(own.withColumn("perspective", F.explode(F.array(F.lit("X"), F.lit("Y")))))
    ids = F.col("form_ids")
    each = forms.select("keep_good", "trade_good", (F.col("n") * F.size(ids)).alias("forms"), F.size(F.array_distinct(ids)).alias("ids"), F.array_min(ids).alias("first_id"), F.array_max(ids).alias("last_id"))
    return each.groupBy("keep_good", "trade_good").agg(F.sum("forms").alias("forms"), F.sum("ids").alias("ids"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def surface_prompt_digests(cases: DataFrame, goods: DataFrame) -> DataFrame:
    """case_id, perspective, forms, prompts (distinct), prompts_md5 (of the sorted digests) of all forms of both sides of ``cases``.

    A prompt depends on the goods, the code and the side, not on the case: the prompts of each such design are made once,
    however many cases have it, and a case takes its design's digest. An id on several rows has the forms of all of them.
    """
    design = ["x_num", "y_num", "code"]
    designs_ = cases.groupBy(*design).agg(F.first("case_id").alias("case_id"))
    sides = designs_.withColumn("perspective", F.explode(F.array(F.lit("X"), F.lit("Y"))))
    forms = surface_forms(sides, goods).select(*design, "perspective", F.md5("prompt").alias("m"))
    lists = forms.groupBy(*design, "perspective").agg(F.array_sort(F.collect_list("m")).alias("m"))  # 48 forms
    digest = [F.size("m").cast("long").alias("forms"), F.size(F.array_distinct("m")).cast("long").alias("prompts"), F.md5(F.concat_ws(",", "m")).alias("prompts_md5")]
    rows = cases.select("case_id", *design).withColumn("_rows", F.count("*").over(Window.partitionBy("case_id")))
    alone = rows.where("_rows = 1").join(lists.select(*design, "perspective", *digest), design)
    again = rows.where("_rows > 1").join(lists, design).groupBy("case_id", "perspective").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    return alone.select("case_id", "perspective", "forms", "prompts", "prompts_md5").unionByName(again.select("case_id", "perspective", *digest))


def neutral_forms(cases: DataFrame, goods: DataFrame | None = None) -> DataFrame:
    """``cases`` (case_id, x_num, y_num, code) in 4 forms without an owner: order, paraphrase, good_for_a, good_for_b, form_id, and the prompt."""
    out = cases.withColumn("order", F.explode(F.array(*map(F.lit, pr.NEUTRAL_ORDERS)))).withColumn("paraphrase", F.explode(F.array(*map(F.lit, pr.NEUTRAL))))
    first = F.col("order") == "AX_BY"
    out = out.withColumns({"good_for_a": F.when(first, F.col("x_num")).otherwise(F.col("y_num")), "good_for_b": F.when(first, F.col("y_num")).otherwise(F.col("x_num"))})
    out = out.withColumn("form_id", F.concat_ws(":", F.col("case_id").cast("string"), F.lit("neutral"), "order", "paraphrase"))
    if goods is None:
        return out
    placed = _placed(out, goods, "good_for_a", "good_for_b", first)
    places = pr.good_places("e", F.col("_e"), F.col("_e1"), F.col("_e2")) | pr.good_places("o", F.col("_o"), F.col("_o1"), F.col("_o2"))
    prompt = F.when(F.col("paraphrase") == "p0", pr.fill(pr.NEUTRAL["p0"], places)).otherwise(pr.fill(pr.NEUTRAL["p1"], places))
    return placed.withColumn("prompt", prompt).select(*out.columns, "prompt")


def _placed(rows: DataFrame, goods: DataFrame, first: str, second: str, x_first) -> DataFrame:
    """``rows`` with the structs of both goods and their levels: X has (i, j), Y has (k, l) of the code."""
    table = goods.select(F.col("idx"), F.struct("idx", "name", "attrs").alias("_good"))
    out = rows.withColumn("_l", levels(F.col("code")))
    for name, at, own in (("e", first, x_first), ("o", second, ~x_first)):
        for n in (0, 1):
            out = out.withColumn(f"_{name}{n + 1}", F.when(own, F.col("_l")[n]).otherwise(F.col("_l")[n + 2]))
        out = out.join(table.select(F.col("idx").alias(at), F.col("_good").alias(f"_{name}")), at)
    return out


def framing_cases(scenarios: DataFrame, grid: list[float], wanted: list[float] | None = None, most_scenarios: int | None = None, style: str = "single_word", tolerance: float = 1e-9) -> DataFrame:
    """Scenarios (scenario_id, domain, positive, negative) by probability and frame, with case_id, question and prompt.

    ``wanted`` picks probabilities of the grid, each within the tolerance, in its own order; one that is not there is an
    error. ``most_scenarios`` keeps the first by scenario_id.
    """
    from ..functions.answers import percent_placeholder

    picked = []
    for value in grid if wanted is None else wanted:
        at = next((n for n, g in enumerate(grid) if abs(g - value) <= tolerance), None)
        if at is None:
            raise ValueError(f"{value} is not among {grid}")
        picked.append((at + 1, grid[at]))
    if most_scenarios is not None:
        if most_scenarios <= 0:
            raise ValueError("most_scenarios is above 0")
        scenarios = scenarios.orderBy("scenario_id").limit(most_scenarios)
    options = F.array(*(F.struct(F.lit(n).alias("probability_index"), F.lit(float(p)).alias("underlying_probability")) for n, p in picked))
    rows = scenarios.withColumn("_p", F.explode(options)).withColumn("frame", F.explode(F.array(F.lit("positive"), F.lit("negative"))))
    rows = rows.select("scenario_id", "domain", "_p.*", "frame", F.when(F.col("frame") == "positive", F.col("positive")).otherwise(F.col("negative")).alias("_template"))
    shown = F.when(F.col("frame") == "positive", F.col("underlying_probability")).otherwise(1.0 - F.col("underlying_probability"))
    rows = rows.withColumn("displayed_probability", shown).withColumn("question", percent_placeholder(F.col("_template"), F.col("displayed_probability")))
    name = F.format_string("s%03d_p%02d_%s", F.col("scenario_id").cast("long"), "probability_index", "frame")
    return rows.select(name.alias("case_id"), "scenario_id", "probability_index", "domain", "frame", "underlying_probability", "displayed_probability", "question", pr.framed(F.col("question"), style).alias("prompt"))


def sharing_pairs(goods: DataFrame) -> DataFrame:
    """a, b (a before b) of goods with the same set of attribute names: an equality join on the sorted names, not all pairs."""
    named = goods.select("idx", F.array_sort(F.array_distinct(F.transform("attrs", lambda x: x["name"]))).alias("_names"))
    return named.select(F.col("idx").alias("a"), "_names").join(named.select(F.col("idx").alias("b"), "_names"), "_names").where("a < b").select("a", "b")


def dominance(i, j, k, l):  # noqa: E741
    """'x' or 'y' where one profile is at no attribute lower and not equal; null otherwise."""
    equal = (i == k) & (j == l)
    return F.when(equal, None).when((i >= k) & (j >= l), "x").when((k >= i) & (l >= j), "y")


def dominance_pairs(spark) -> DataFrame:
    """i, j, k, l of all ordered pairs of profiles of a good of which the first dominates."""
    rows = [(*a, *b) for a in _PROFILES for b in _PROFILES if a != b and a[0] >= b[0] and a[1] >= b[1]]
    return spark.createDataFrame(rows, "i int, j int, k int, l int")


def coverage(cases: DataFrame, goods: DataFrame) -> DataFrame:
    """One row: cases, pairs, cases with an improvable level, one-level-up variants, cases of goods that share attributes, dominated ones."""
    shared = sharing_pairs(goods).select(F.col("a").alias("x_num"), F.col("b").alias("y_num"), F.lit(True).alias("_shares"))
    rows = cases.withColumn("_l", levels(F.col("code"))).join(shared, ["x_num", "y_num"], "left")
    better = F.size(F.filter("_l", lambda v: v < 2))
    dominated = dominance(*(F.col("_l")[n] for n in range(4))).isNotNull()
    shares = F.coalesce("_shares", F.lit(False))
    pairs = rows.groupBy("x_num", "y_num").agg(F.count("*").alias("cases"), F.count_if(better > 0).alias("improvable"), F.sum(better).alias("variants"), F.count_if(shares).alias("sharing"), F.count_if(shares & dominated).alias("dominated"))
    return pairs.agg(F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"), F.count("*").alias("pairs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("improvable", "variants", "sharing", "dominated")))


def rotating_codes(start: int, count: int) -> list[int]:
    """Codes in turn from ``start``, modulo their number."""
    return [(start + n) % CODES for n in range(count)]


def numbered_cases(pairs: DataFrame) -> DataFrame:
    """case_id (from 1), x_num, y_num, code of pairs with codes, in the order of ``pair``."""
    sized = numbered(pairs.withColumn("_size", F.size("codes")), "pair", "_size")
    return sized.select("x_num", "y_num", F.posexplode("codes").alias("_pos", "code"), "first_id").select((F.col("first_id") + F.col("_pos")).alias("case_id"), "x_num", "y_num", "code")
