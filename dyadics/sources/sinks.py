"""Writers. Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decimals(rows: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles as strings with fixed digits, other columns as they are."""
    return rows.select(*(F.format_string(f"%.{digits}f", F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in rows.dtypes))


def write_csv(rows: DataFrame, path: str, digits: int = 8, mode: str = "overwrite") -> None:
    decimals(rows, digits).write.mode(mode).csv(path, header=True)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def manifest(spark: SparkSession, path: str, tracked: DataFrame | None = None) -> DataFrame:
    """path, bytes, sha256 of the files below ``path``, and whether ``tracked`` (path: the ends of paths) lists them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if tracked is None:
        return out
    names = tracked.select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.col("path").alias("_tracked"))
    hits = out.withColumn("_name", F.element_at(F.split("path", "/"), -1)).join(names, "_name").where(F.col("path").endswith(F.col("_tracked"))).select("path").distinct()
    return out.join(hits.withColumn("tracked", F.lit(True)), "path", "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))


def canonical_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """``rows`` with each row's canonical JSON (keys ascending, nulls kept, no spaces) and its SHA-256."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.withColumn(name, text).withColumn(f"{name}_sha256", F.sha2(F.encode(name, "UTF-8"), 256))


def complete(spark: SparkSession, path: str, expected: int) -> bool:
    """Whether JSON rows at ``path`` were written in whole; a run resumes past them only then."""
    try:
        return spark.read.text(path).where("trim(value) != ''").count() == expected
    except Exception as missing:  # a path that does not exist yet
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


def markdown(rows: DataFrame, limit: int = 1_000) -> str:
    """The first rows as a Markdown table, for reports."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    return head + "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect())


def messages(rows: DataFrame, system: str, prompt: str, answer: str | None = None) -> DataFrame:
    """``rows`` with ``messages``: an array of (role, content) for training."""
    parts = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))]
    if answer:
        parts.append(F.struct(F.lit("assistant").alias("role"), F.col(answer).alias("content")))
    return rows.withColumn("messages", F.array(*parts))


def write_tensors(rows: DataFrame, path: str, mode: str = "overwrite", file_bytes: int | None = None) -> None:
    """Rows (name, dtype, shape, values) as tensor files of bounded size, all or none of them."""
    from .tensor_files import FILE_BYTES, registered

    registered(rows.sparkSession)
    rows.select("name", "dtype", "shape", "values").write.format("tensors").mode(mode).option("fileBytes", file_bytes or FILE_BYTES).save(path)
