import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadics.functions import answers as an
from dyadics.functions import choices as ch
from dyadics.functions import codes, rewards
from dyadics.functions import tests as st


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_codes(spark):
    got = values(spark, [(0,), (16,), (80,), (81,), (-1,), (None,)], "c int", codes.levels(F.col("c")))
    assert got == [[0, 0, 0, 0], [1, 2, 1, 0], [2, 2, 2, 2], None, None, None]
    diff = values(spark, [(4, 2), (0, 0)], "a int, b int", codes.profile_difference(F.col("a"), F.col("b")))
    assert diff == [[0, -1, 0, 1, 0, 0, 0, 0], [0] * 8]


@pytest.mark.parametrize(("closed", "want"), [("left", [None, 0, 0, 1, 2, 2]), ("right", [None, None, 0, 0, 1, 2])])
def test_bin_closure(spark, closed, want):
    assert values(spark, [(-0.1,), (0.0,), (0.4,), (0.5,), (1.0,), (9.0,)], "v double", codes.bin_of(F.col("v"), [0, 0.5, 1, float("inf")], closed)) == want


def test_labels(spark):
    got = values(spark, [(0.0,), (-0.5,), (1.0,), (-2.0,), (0.49,)], "d double", codes.stratum(F.col("d")))
    assert got == ["-|<0.5", "-|0.5-1", "+|1-2", "-|>=2", "+|<0.5"]


@pytest.mark.parametrize(("tie", "want"), [("yes", "Yes"), ("no", "No"), ("tie", "tie")])
def test_ties(spark, tie, want):
    got = values(spark, [(0.5, 0.5), (0.6, 0.4), (0.4, 0.6), (None, 0.1)], "y double, n double", ch.choice(F.col("y"), F.col("n"), tie))
    assert got == [want, "Yes", "No", None]
    with pytest.raises(ValueError):
        ch.choice(F.col("y"), F.col("n"), "maybe")


def test_rational_and_chosen(spark):
    rows = [("X", 1.0), ("X", -1.0), ("Y", 1.0), ("Y", -1.0), ("X", 0.0), ("X", None)]
    assert values(spark, rows, "p string, d double", ch.rational(F.col("p"), F.col("d"))) == ["No", "Yes", "Yes", "No", "", None]
    rows = [("X", "No"), ("X", "Yes"), ("Y", "No"), ("Y", "Yes"), ("X", "")]
    assert values(spark, rows, "p string, a string", ch.chosen_good(F.col("p"), F.col("a"))) == ["X", "Y", "Y", "X", None]


def test_probabilities(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.2, 0.6), (-0.1, 1.0), (nan, 0.5), (inf, 1.0), (0.0, 0.0), (None, 0.5)]
    assert values(spark, rows, "y double, n double", ch.valid_probability(F.col("y"), F.col("n"))) == [pytest.approx(0.25), None, None, None, None, None]
    kl = values(spark, [(0.5, 0.25), (0.3, 0.3)], "p double, q double", ch.kl(F.col("p"), F.col("q")))
    assert kl == [pytest.approx(0.5 * math.log(2) + 0.5 * math.log(0.5 / 0.75)), pytest.approx(0)]
    js = values(spark, [(0.9, 0.1), (0.1, 0.9)], "p double, q double", ch.js(F.col("p"), F.col("q")))
    assert js[0] == pytest.approx(js[1]) and js[0] > 0


def test_softmax_and_token_mass(spark):
    assert values(spark, [([1000.0, 1000.0],)], "s array<double>", ch.softmax(F.col("s"))) == [[0.5, 0.5]]
    rows = [([(" Yes", math.log(0.3)), ("y", math.log(0.1)), ("No", math.log(0.5))],)]
    assert values(spark, rows, "t array<struct<token:string,logprob:double>>", ch.token_mass(F.col("t"), ("yes", "y"))) == [pytest.approx(0.4)]


def test_gated_ladder(spark):
    rows = [("No", "Yes", "X"), ("Yes", "No", "X"), ("No", "No", "X"), ("Yes", "Yes", "Y"), ("", "No", "X"), (None, "No", "X"), ("No", "Yes", None)]
    schema = "x string, y string, p string"
    args = F.col("x"), F.col("y"), F.col("p")
    assert values(spark, rows, schema, rewards.gated_reward(*args)) == [1, 0, -1, -1, -1, -1, 1]
    assert values(spark, rows, schema, rewards.gated_reward(*args, "hard")) == [1, -1, -1, -1, -1, -1, 1]
    assert values(spark, rows, schema, rewards.pair_reward(F.col("x"), F.col("y"))) == [1, 1, -1, -1, -1, -1, 1]


def test_rewards(spark):
    rows = [("No", 0.4), ("Yes", 0.4), ("", 0.4), ("No", 0.0)]
    reward = lambda *a: values(spark, rows, "a string, d double", rewards.reward(F.col("a"), F.lit("X"), F.col("d"), *a))
    assert reward() == [0.4, -0.4, -0.4, 0.0]
    assert reward("sign_only") == [1, -1, -1, 0]
    assert reward("scale_matched", 0.7) == [0.7, -0.7, -0.7, 0]
    for bad in (("other",), ("scale_matched",), ("scale_matched", -1.0)):
        with pytest.raises(ValueError):
            rewards.reward(F.col("a"), F.lit("X"), F.col("d"), *bad)
    both = values(spark, [(1.0, None), (1.0, -1.0), (None, None)], "a double, b double", rewards.combined((1.0, F.col("a")), (3.0, F.col("b"))))
    assert both == [1.0, -0.5, 0.0]


def test_learning_rate(spark):
    got = values(spark, [(1,), (11,), (56,), (101,), (500,)], "s int", rewards.learning_rate(F.col("s"), 1.0, 10, 100))
    assert got == pytest.approx([0.0, 1.0, 0.5, 0.0, 0.0])


def test_yes_no(spark):
    rows = [("Yes.",), ("no,",), ("y",), ("maybe",), ("",), ("<think>no</think> Yes",), ("<think>a</think>b</think> (N)",), (None,), ("  \n NO way",)]
    assert values(spark, rows, "t string", an.yes_no(F.col("t"))) == ["Yes", "No", "Yes", "", "", "Yes", "No", "", "No"]


def test_predicted_answers(spark):
    rows = [("#### 1,234",), ("The answer is $5.",), ("first 3 then 7.50",), ("none",), (r"\boxed{7}",), ("the answer is 2, no: The Answer is 3",), ("#### 4 and the answer is -9.",)]
    got = [tuple(x) for x in values(spark, rows, "t string", an.predicted_answer(F.col("t")))]
    assert got == [("1234", "hash_marker"), ("5", "answer_is"), ("7.50", "last_number"), (None, "unparsed"), ("7", "boxed"), ("3", "answer_is"), ("-9", "answer_is")]
    assert values(spark, [("a\n#### 1,000.\nb",), ("x",)], "t string", an.solution_answer(F.col("t"))) == ["1000", None]


def test_tokens_names_metrics(spark):
    rows = [("Yes!",), ("(A)",), ("b.",), ("Traded",), ("keep",), ("other",)]
    assert values(spark, rows, "t string", an.option_token(F.col("t"))) == ["yes", "a", "b", "trade", "keep", "other"]
    rows = [("Q-seed2-ckpt4000",), ("Q-ckpt80",), ("Q-step100-EXPLORATORY",), ("base",)]
    assert [tuple(x) for x in values(spark, rows, "t string", an.run_ids(F.col("t")))] == [(2, 4000), (0, 80), (None, 100), (None, None)]
    rows = [("{'loss': 1.5e-3, 'kl': 2}",), ("{'loss': nan}",), ("nothing",)]
    got = values(spark, rows, "t string", an.metric(F.col("t"), "loss"))
    assert got[0] == 0.0015 and math.isnan(got[1]) and got[2] is None


def test_statistics(spark):
    p = values(spark, [(35, 22), (0, 0), (10, 0)], "b int, c int", st.mcnemar_p("b", "c"))
    assert p == [0.11116111910399348, 1.0, 2 / 1024]
    chi = values(spark, [(5097.22,), (8.0,), (0.0,)], "x double", st.chi2_log10_survival(F.col("x"), 8))
    assert chi[0] == pytest.approx(-1097, abs=2) and chi[1] == pytest.approx(math.log10(0.43347), abs=1e-4) and chi[2] == pytest.approx(0)
    assert values(spark, [(0.1, 0.2), (-2.0, -1.0), (-1.0, 1.0)], "a double, b double", st.interval_verdict(F.col("a"), F.col("b"))) == ["clear_increase", "clear_decrease", "no_clear_change"]


def test_mcnemar_tail_of_many_pairs_is_that_of_whole_numbers():
    from fractions import Fraction
    from math import comb

    for n, k in [(1_001, 0), (1_001, 1), (1_001, 500), (4_000, 1_900), (5_003, 2_501), (6_000, 2_400)]:
        want = float(Fraction(sum(comb(n, i) for i in range(k + 1)), 2**n))
        assert st.half_tail(n, k) == pytest.approx(want, rel=1e-12, abs=1e-300)
    began = time.perf_counter()
    assert st.half_tail(100_000_000, 50_000_000) == pytest.approx(0.5 + 0.5 * (2 / (np.pi * 1e8)) ** 0.5, rel=1e-9)
    assert st.half_tail(100_000_000, 49_990_000) == pytest.approx(0.0227555, rel=1e-5)  # two standard deviations
    assert time.perf_counter() - began < 5
