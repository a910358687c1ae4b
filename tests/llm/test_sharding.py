import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from dyadics.llm.sharding import communication_matrix, dealt_counts, drawn, hypergeometric, matrix_of, shard_rows, uniform


def chi_square(seen: Counter, chance: dict, draws: int) -> float:
    """Standard deviations that Pearson's statistic lies above its mean."""
    assert set(seen) <= {k for k, p in chance.items() if p}
    cells = {k: p * draws for k, p in chance.items() if p * draws >= 5}
    value = sum((seen[k] - want) ** 2 / want for k, want in cells.items())
    return (value - len(cells)) / (2 * len(cells)) ** 0.5


@pytest.mark.parametrize("good, bad, n", [(5, 195, 200), (5, 195, 5), (1, 1, 1), (30, 70, 20), (3, 4000, 2000), (1000, 1000, 300)])
def test_draws_follow_the_hypergeometric_law(good, bad, n):
    draw, draws = np.random.default_rng(4), 20_000
    seen = Counter(hypergeometric(draw, good, bad, n) for _ in range(draws))
    chance = {x: math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n) for x in range(max(0, n - bad), min(n, good) + 1)}
    assert chi_square(seen, chance, draws) < 5


@pytest.mark.parametrize("scale", [10**6, 10**9])
def test_draws_of_any_size_have_the_laws_moments(scale):
    good, bad, n = 3 * scale, 117 * scale, 200
    draw = np.random.default_rng(5)
    got = np.array([hypergeometric(draw, good, bad, n) for _ in range(20_000)])
    mean, spread = n / 40, (n / 40 * 39 / 40) ** 0.5
    assert abs(got.mean() - mean) < 5 * spread / len(got) ** 0.5 and abs(got.std() - spread) < 0.1
    assert abs((got == 0).mean() - (39 / 40) ** n) < 0.004  # a rounded normal draw has three times as many
    n = good // 1000
    got = np.array([hypergeometric(draw, good, bad, n) for _ in range(200)], dtype=float)
    mean, spread = n / 40, (n / 40 * 39 / 40 * (good + bad - n) / (good + bad - 1)) ** 0.5
    assert abs(got.mean() - mean) < 5 * spread / len(got) ** 0.5 and 0.7 < got.std() / spread < 1.4


def test_matrices_follow_the_law_of_a_uniform_permutation():
    """All ways to lay five rows of two partitions into three shards, each permutation once."""
    sizes, shards = [3, 2], 3
    slots = [s for s in range(shards) for _ in range(5 // shards + (s < 5 % shards))]
    want = Counter()
    for order in itertools.permutations(range(5)):
        m = np.zeros((2, shards), int)
        for row, slot in enumerate(order):
            m[int(row >= 3), slots[slot]] += 1
        want[m.tobytes()] += 1 / 120
    draws = 10_000
    seen = Counter(communication_matrix(sizes, shards, i).astype(int).tobytes() for i in range(draws))
    assert chi_square(seen, want, draws) < 5


def test_counts_slots_and_sums(docs):
    rows = shard_rows(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and set(sizes) == set(range(40))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sizes[shard]))
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "rows")


def test_odd_rows_and_empty_table(odd, nothing):
    rows = shard_rows(odd, 5).collect()
    assert len(rows) == 12 and max(Counter(r["shard"] for r in rows).values()) == 3
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(16, 0)}
    assert shard_rows(nothing).count() == 0


def test_blocks_of_the_second_permutation(spark, monkeypatch):
    import dyadics.llm.sharding as s

    monkeypatch.setattr(s, "ROWS_A_BLOCK", 10)
    rows = shard_rows(spark.range(503).selectExpr("id as doc_id", "cast(id as string) as text"), 3).collect()
    for shard, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_matrix_margins_and_law():
    m = communication_matrix([7, 0, 100, 13], 40, 1)
    assert m.sum(axis=1).tolist() == [7, 0, 100, 13] and set(m.sum(axis=0)) == {3}
    big = communication_matrix([10**9, 5 * 10**8, 3], 7, 2)
    assert big.sum(axis=1).tolist() == [10**9, 5 * 10**8, 3] and np.ptp(big.sum(axis=0)) <= 1 and (big >= 0).all()


def test_each_row_is_as_likely_in_each_shard(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "'' as text")
    first = Counter(r["shard"] for r in shard_rows(rows, 4).collect() if r["doc_id"] < 400)
    assert all(60 < n < 145 for n in first.values())


@pytest.mark.parametrize("good, bad, n", [(5, 195, 200), (5, 195, 5), (1, 1, 1), (30, 70, 20), (3, 4000, 2000), (1000, 1000, 300), (0, 7, 3), (7, 0, 3), (0, 0, 0)])
def test_draws_of_columns_follow_the_law(spark, good, bad, n):
    draws = 20_000
    long = lambda x: F.lit(x).cast("long")
    rows = spark.range(draws).select(drawn(long(good), long(bad), long(n), uniform(F.lit(4), F.col("id"))).alias("x")).groupBy("x").count().collect()
    seen = Counter({r["x"]: r["count"] for r in rows})
    chance = {x: math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n) for x in range(max(0, n - bad), min(n, good) + 1)}
    assert sum(seen.values()) == draws and chi_square(seen, chance, draws) < 5


def test_draws_of_large_columns_have_the_laws_moments(spark):
    good, bad, n = 250_000_000, 9_750_000_000, 1_000_000
    rows = spark.range(400).select(drawn(F.lit(good), F.lit(bad), F.lit(n).cast("long"), uniform(F.lit(9), F.col("id"))).alias("x")).collect()
    got = np.array([r["x"] for r in rows], dtype=float)
    mean, spread = n / 40, (n / 40 * 39 / 40) ** 0.5
    assert abs(got.mean() - mean) < 5 * spread / len(got) ** 0.5 and 0.85 < got.std() / spread < 1.15


def test_matrices_in_tasks_follow_the_law_of_a_uniform_permutation(spark):
    sizes, shards, draws = [3, 2], 3, 10_000
    slots = [s for s in range(shards) for _ in range(5 // shards + (s < 5 % shards))]
    want = Counter()
    for order in itertools.permutations(range(5)):
        m = np.zeros((2, shards), int)
        for row, slot in enumerate(order):
            m[int(row >= 3), slots[slot]] += 1
        want[m.tobytes()] += 1 / 120
    parts = F.array(*(F.struct(F.lit(p).cast("long").alias("part"), F.lit(n).cast("long").alias("n")) for p, n in enumerate(sizes)))
    left = F.array(*(F.lit(slots.count(s)).cast("long") for s in range(shards)))
    rows = spark.range(draws).select(dealt_counts(parts, left, shards, F.col("id")).alias("m")).collect()
    seen = Counter(np.array([p["counts"] for p in r["m"]], dtype=int).tobytes() for r in rows)
    assert chi_square(seen, want, draws) < 5


def test_both_margins_hold_in_two_steps(spark):
    sizes = [7, 0, 1000, 3, 250, 1, 1, 64, 999, 12, 5]
    parts = spark.createDataFrame(list(enumerate(sizes)), "part long, n long")
    for seed in (1, 2):
        got = {r["part"]: r["counts"] for r in matrix_of(parts, 40, seed).collect()}
        m = np.array([got[p] for p in range(len(sizes))])
        assert m.sum(axis=1).tolist() == sizes and m.min() >= 0
        assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    assert matrix_of(parts.where("false"), 40, 1).count() == 0
