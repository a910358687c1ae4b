"""Filters that keep splits apart, and gates that must hold before a run: each gate is a table of what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parity(key: Column, even: bool) -> Column:
    """Even ids validate, odd ones are frozen."""
    return F.pmod(key, F.lit(2)) == (0 if even else 1)


def id_range(rows: DataFrame, key: str, first: int, last: int, nonzero: str | None = None) -> DataFrame:
    """Rows of ids in a closed range, and with ``nonzero`` those whose value there is neither 0 nor null."""
    out = rows.where(F.col(key).between(first, last))
    return out.where(F.col(nonzero) != 0) if nonzero else out


def up_to(rows: DataFrame, step: str, most: int) -> DataFrame:
    return rows.where(F.col(step) <= most)


def forbidden(name: Column, tokens: Sequence[str]) -> Column:
    """The first of the tokens, in their order, that a path or data set's name has in any case; null if it has none."""
    low = F.lower(name)
    return F.coalesce(*(F.when(low.contains(t.lower()), F.lit(t)) for t in tokens))


def delta_outcomes(cases: DataFrame, deltas: DataFrame, key: str, delta: str) -> DataFrame:
    """outcome ('kept', 'missing', 'zero'), n of the cases by their delta."""
    rows = cases.select(key).join(deltas.select(key, F.col(delta).alias("_d")), key, "left")
    outcome = F.when(F.col("_d").isNull(), "missing").when(F.col("_d") == 0, "zero").otherwise("kept")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def anchored(cases: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Cases that have a stable anchor, 'X' or 'Y'."""
    return cases.join(anchors.where(F.col("pref").isin("X", "Y")).select(key), key, "left_semi")


def common_values(one: DataFrame, two: DataFrame, columns: dict[str, str]) -> DataFrame:
    """column, value that both tables have, for pairs of columns that must be disjoint. An array counts by its items."""

    def values(rows: DataFrame, column: str) -> DataFrame:
        item = F.explode(column) if rows.schema[column].dataType.typeName() == "array" else F.col(column)
        return rows.select(item.cast("string").alias("value")).where("value IS NOT NULL").distinct()

    out = None
    for a, b in columns.items():
        both = values(one, a).join(values(two, b), "value", "left_semi").select(F.lit(a).alias("column"), "value")
        out = both if out is None else out.unionByName(both)
    return out


def catalogue_faults(goods: DataFrame, attributes: int = 2, levels: int = 3) -> DataFrame:
    """idx, rule: goods without so many attributes, or attributes without so many different levels."""
    rules = F.array_compact(
        F.array(
            F.when(F.size("attrs") != attributes, F.lit("number of attributes")),
            F.when(~F.forall("attrs", lambda a: F.size(a["levels"]) == levels), F.lit("number of levels")),
            F.when(~F.forall("attrs", lambda a: F.size(F.array_distinct(a["levels"])) == F.size(a["levels"])), F.lit("repeated level")),
        )
    )
    return goods.select("idx", F.explode(rules).alias("rule"))


def filled_union(*tables: DataFrame) -> DataFrame:
    """All rows by column name; a column that a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def record_faults(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """rule, n: another number of records, repeated ids, repeated questions (white space aside), targets that are no integers."""
    question = F.trim(F.regexp_replace("question", r"\s+", " "))
    again = lambda key, name: rows.groupBy(key.alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.lit(name).alias("rule"), F.sum("_n").alias("n"))
    whole = rows.agg(F.count("*").alias("_all"), F.count_if(~F.coalesce(F.col("target").rlike(r"^-?\d+$"), F.lit(False))).alias("_bad"))
    size = F.col("_all") == 0 if expected is None else F.col("_all") != expected
    counted = whole.select(F.lit("number of records").alias("rule"), F.when(size, F.col("_all")).alias("n")).unionByName(whole.select(F.lit("target is no integer").alias("rule"), F.when(F.col("_bad") > 0, F.col("_bad")).alias("n")))
    return counted.unionByName(again(F.col("id"), "repeated id")).unionByName(again(question, "repeated question")).where("n IS NOT NULL")


def anchor_faults(anchors: DataFrame, first: int, last: int) -> DataFrame:
    """rule, n: preferences other than X, Y or null, ids out of range, no stable anchor. ``anchors``: case_id, pref."""
    stable = F.count_if(F.col("pref").isin("X", "Y"))
    row = anchors.agg(F.count_if(F.col("pref").isNotNull() & ~F.col("pref").isin("X", "Y")).alias("invalid preference"), F.count_if(~F.col("case_id").between(first, last)).alias("id out of range"), F.when(stable == 0, 1).otherwise(0).cast("long").alias("no stable anchor"))
    return _unpivoted(row)


def startup_faults(rows: DataFrame, anchors: DataFrame, first: int, last: int) -> DataFrame:
    """rule, n: cases without exactly one X and one Y row, out of range, or without a stable anchor. ``rows``: case_id, perspective."""
    side = lambda s: F.count_if(F.col("perspective") == s)
    per = rows.groupBy("case_id").agg(side("X").alias("_x"), side("Y").alias("_y"), F.count("*").alias("_n"))
    stable = anchors.where(F.col("pref").isin("X", "Y")).select("case_id", F.lit(True).alias("_stable")).distinct()
    per = per.join(stable, "case_id", "left")
    whole = (F.col("_x") == 1) & (F.col("_y") == 1) & (F.col("_n") == 2)
    return _unpivoted(per.agg(F.count_if(~whole).alias("not one X and one Y"), F.count_if(~F.col("case_id").between(first, last)).alias("id out of range"), F.count_if(F.col("_stable").isNull()).alias("no stable anchor")))


def _unpivoted(row: DataFrame) -> DataFrame:
    counts = F.create_map(*(x for c in row.columns for x in (F.lit(c), F.col(f"`{c}`"))))
    return row.select(F.explode(counts).alias("rule", "n")).where("n > 0")


def setting_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name, found, expected of settings (name, value) that are not equal; a run may resume only if there are none."""
    a, b = found.select("name", F.col("value").alias("found")), expected.select("name", F.col("value").alias("expected"))
    return a.join(b, "name", "full").where(~F.col("found").eqNullSafe(F.col("expected")))


def unready(families: DataFrame, suite_hash: str | None) -> DataFrame:
    """problem: what keeps a frozen suite closed. ``families``: family, resolved, seed, sha256; a row for each selection."""
    spark = families.sparkSession
    no_hash = F.coalesce(F.col("sha256"), F.lit("")) == ""
    open_ones = families.where(~F.coalesce("resolved", F.lit(False))).select(F.format_string("%s: not resolved", "family").alias("problem")).distinct()
    hashes = families.where(F.coalesce("resolved", F.lit(False)) & no_hash).select(F.format_string("%s, %s: no hash of the selection", "family", "seed").alias("problem"))
    suite = spark.createDataFrame([] if suite_hash else [("no hash of the suite",)], "problem string")
    return suite.unionByName(open_ones).unionByName(hashes)


def unsupported_settings(wanted: DataFrame, supported: DataFrame, critical: Sequence[str]) -> DataFrame:
    """name, fatal of wanted settings (name) that are not supported (name); critical ones are fatal, others only dropped."""
    return wanted.select("name").distinct().join(supported.select("name"), "name", "left_anti").select("name", F.col("name").isin(list(critical)).alias("fatal"))


def off_reference(rows: DataFrame, expected: DataFrame, key: list[str], value: str, within: float = 0.02) -> DataFrame:
    """key, value, expected of values that are missing or further than ``within`` from the expected ones."""
    both = expected.select(*key, F.col(value).alias("expected")).join(rows.select(*key, value), key, "left")
    return both.where(F.col(value).isNull() | (F.abs(F.col(value) - F.col("expected")) > within)).select(*key, value, "expected")


def out_of_order(rows: DataFrame, cell: list[str], key: str, place: str) -> DataFrame:
    """cell, n of rows whose key does not rise with their place in the cell's file."""
    from pyspark.sql.window import Window

    before = F.lag(key).over(Window.partitionBy(*cell).orderBy(place))
    return rows.select(*cell, (F.col(key) <= before).alias("_back")).groupBy(*cell).agg(F.count_if("_back").alias("n")).where("n > 0")


def grid_roll_up(findings: DataFrame, cells: DataFrame, cell: list[str]) -> DataFrame:
    """One row: cells, verified, failed, complete, and the problems as 'cell: rule', sorted. ``cells`` lists those expected."""
    rules = findings.groupBy(*cell).agg(F.sort_array(F.collect_set("rule")).alias("_rules"))  # a few rules a cell
    per = cells.select(*cell).distinct().join(rules, cell, "left")
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in cell))
    bad = F.col("_rules").isNotNull()
    texts = F.flatten(F.collect_list(F.when(bad, F.transform("_rules", lambda r: F.concat(name, F.lit(": "), r)))))
    return per.agg(F.count("*").alias("cells"), F.count_if(~bad).alias("verified"), F.count_if(bad).alias("failed"), (F.count_if(bad) == 0).alias("complete"), F.array_join(F.sort_array(texts), "; ").alias("problems"))


def prediction_faults(one: DataFrame, two: DataFrame, key: str, target: str) -> DataFrame:
    """key, rule of two runs' predictions that cannot be paired: an id of one run alone, or targets that differ."""
    a, b = one.select(key, F.col(target).alias("_a"), F.lit(True).alias("_in_a")), two.select(key, F.col(target).alias("_b"), F.lit(True).alias("_in_b"))
    rule = F.when(F.col("_in_a").isNull(), "second run alone").when(F.col("_in_b").isNull(), "first run alone").when(~F.col("_a").eqNullSafe(F.col("_b")), "target")
    return a.join(b, key, "full").select(key, rule.alias("rule")).where("rule IS NOT NULL")


def used_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """value: all that any of the columns holds, once."""
    return rows.select(F.explode(F.array(*columns)).alias("value")).distinct()
