"""Queries against their SQL on tables with what the given ones lack at small scale."""

import duckdb
import pytest

from dyadics.plans.catalogue import ORACLES, QUERIES


def against_sql(spark, folder, name, **tables):
    """Rows that the query and its SQL do not share, and the number of rows, on tables written to ``folder``."""
    for table, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for table in tables:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    con.register("got", QUERIES[name](spark, str(folder)).toArrow())
    con.register("want", con.sql(ORACLES[name]).to_arrow_table())
    names = ", ".join(f'"{c}"' for c in con.sql("FROM want").columns)
    one, two = f"SELECT {names} FROM got", f"SELECT {names} FROM want"
    return con.sql(f"(({one} EXCEPT ALL {two}) UNION ALL ({two} EXCEPT ALL {one}))").fetchall(), con.sql("SELECT count(*) FROM got").fetchall()[0][0]


#: Answers of which some are certain: a value of 0 gives a probability of 0.
CERTAIN = "SELECT range AS event_id, CASE WHEN range IN ({}) THEN 0.0::DOUBLE ELSE 1.37::DOUBLE * (range * 37 % 101 + 1) END AS value FROM range(600)"


@pytest.mark.parametrize("name", ["framing_pairs", "framing_domain_rollup", "framing_reduction", "kl_js_divergence"])
def test_certain_answers_are_as_in_the_sql(spark, tmp_path, name):
    differ, rows = against_sql(spark, tmp_path, name, events=CERTAIN.format("0, 45, 200, 201"))
    assert not differ and rows


#: Answers of which some have no value: their frames are there without a probability.
UNVALUED = "SELECT event_id, CASE WHEN event_id NOT IN (3, 76, 77, 310) THEN value END AS value FROM ({})".format(CERTAIN.format("0, 45, 200, 201"))


@pytest.mark.parametrize("name", ["framing_pairs", "framing_domain_rollup", "framing_reduction"])
def test_frames_without_a_probability_are_as_in_the_sql(spark, tmp_path, name):
    differ, rows = against_sql(spark, tmp_path, name, events=UNVALUED)
    assert not differ and rows


#: Answers with ids on several rows, with ids below 0, and with values that give no probability, or a division by 0.
ODD_ANSWERS = {
    "repeated": "SELECT CASE WHEN event_id % 13 = 0 THEN event_id + 2 ELSE event_id END AS event_id, value FROM ({})",
    "negative ids": "SELECT event_id - 300 AS event_id, value FROM ({})",
    "negative values": "SELECT event_id, CASE WHEN event_id % 41 = 0 THEN -10.0 WHEN event_id % 43 = 0 THEN -80.0 ELSE value END AS value FROM ({})",
    "over zero": "SELECT event_id, CASE WHEN event_id % 41 = 0 THEN -50.0 ELSE value END AS value FROM ({})",
}


@pytest.mark.parametrize("odd", ODD_ANSWERS)
@pytest.mark.parametrize("name", ["framing_pairs", "framing_domain_rollup", "framing_reduction"])
def test_frames_of_odd_answers_are_as_in_the_sql(spark, tmp_path, name, odd):
    differ, rows = against_sql(spark, tmp_path, name, events=ODD_ANSWERS[odd].format(CERTAIN.format("1200")))
    assert not differ and rows


#: Orders of which some ids stand on several rows, with equal and with other customers.
ORDERS = "SELECT CASE WHEN range % 17 = 3 THEN range - 1 WHEN range % 19 = 4 THEN range - range % 5 ELSE range END AS o_orderkey, range * 7 % 61 AS o_custkey FROM range(120)"
PARTS = "SELECT range AS p_partkey, 'Brand#' || range % 7 AS p_brand FROM range(80)"


@pytest.mark.parametrize("name", ["surface_prompts", "surface_forms"])
def test_forms_of_cases_on_several_rows(spark, tmp_path, name):
    differ, rows = against_sql(spark, tmp_path, name, orders=ORDERS, part=PARTS)
    assert not differ and rows


def test_only_cases_are_exchanged_for_their_forms(spark):
    from pyspark.sql import functions as F

    from dyadics.operators import designs

    cases = spark.createDataFrame([(1, 3, 25, 4), (1, 3, 25, 4), (10, 3, 25, 7), (2, 4, 25, 80)], "case_id long, x_num int, y_num int, code int")
    got = designs.surface_summary(cases)
    forms = designs.surface_forms(cases.withColumn("perspective", F.explode(F.array(F.lit("X"), F.lit("Y")))))
    want = forms.groupBy("keep_good", "trade_good").agg(F.count("*").alias("forms"), F.count_distinct("form_id").alias("ids"), F.min("form_id").alias("first_id"), F.max("form_id").alias("last_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = designs.surface_summary(cases)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 2


def test_prompts_are_made_once_a_design(spark):
    from dyadics.operators import designs
    from dyadics.plans import surveys

    cases = spark.range(2_000).selectExpr("id AS case_id", "3 AS x_num", "25 AS y_num", "cast(id % 2 AS int) AS code")
    goods = surveys._goods(spark, "/root/testdata/sf0.001")
    got = designs.surface_prompt_digests(cases, goods).collect()
    assert len(got) == 4_000 and {r["forms"] for r in got} == {48} and len({r["prompts_md5"] for r in got}) == 4
