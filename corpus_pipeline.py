"""Five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on every row that the stage before it kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dyadics.llm import mixing, near_dedup, quality, sentencepiece_bpe, toxicity

#: The operator's own targets. The filters leave fewer poor and toxic tokens than these ask for, so what resembles them is
#: taken more often; the ridge keeps every clean document's rate above 1.
MIX_WEIGHTS, MIX_CLEAN_SCALE = mixing.WEIGHTS, mixing.CLEAN_SCALE


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The labels of their own table train the scores."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filter_toxic(docs, model)


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_quality(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    training = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX_WEIGHTS, MIX_CLEAN_SCALE, training)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the token ids of each document."""
    import public_tokenizers

    return sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", toxic_out),
    ("quality rules", poor_out),
    ("near dedup", one_of_each),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]
#: The toxicity scores and the near-duplicate groups are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written and read again as the next one's documents."""
    from dyadics.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
