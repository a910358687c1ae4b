import pytest

#: doc_id, text: empty, null, ties, repeated rows, very long and odd texts, and columns whose names the operators use.
ODD = [
    (1, ""),
    (2, None),
    (3, "one"),
    (4, "a b c d"),
    (5, "the quick brown fox jumps over the lazy dog again and again"),
    (5, "the quick brown fox jumps over the lazy dog again and again"),
    (6, "the quick brown fox jumps over the lazy dog again and again"),
    (7, "\n\n \t\x0b\x0c\r "),
    (8, "x" * 5000),
    (9, " ".join(f"w{i % 700}" for i in range(30_000))),
    (10, "é日本 𝄞 ▁ <s> #*$%&|<> ÀÉ"),
    (None, "a row without an id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    names = ("key", "n", "word", "block", "kept", "score", "rate", "tokens", "copies", "shard", "group", "toxic_score", "digest", "lang", "source")
    return rows.select("*", *(F.lit("clash").alias(c) for c in names))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/labels.parquet")
