from pyspark.sql import functions as F

from dyadics.streaming import jobs

SCHEMA = "case_id long, side string, p double, at timestamp"


def arrive(spark, folder, *batches):
    for rows in batches:
        spark.createDataFrame(rows, "case_id long, side string, p double, s long").select("case_id", "side", "p", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").json(folder)


def test_pairs_complete_and_state_is_bounded(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [(1, "X", 0.1, 10_000), (2, "X", 0.2, 10_001)], [(1, "Y", 0.3, 10_002), (3, "Y", 0.4, 10_003), (2, "Y", 0.9, 20_000)])
    pairs = jobs.completed_pairs(jobs.answer_stream(spark, folder, SCHEMA, 1), "case_id", "side", "p", "at", "60 seconds", "10 seconds")
    jobs.run_once(pairs, str(tmp_path / "check"), "done_pairs")
    assert [tuple(r) for r in spark.table("done_pairs").collect()] == [(1, 0.1, 0.3)]


def test_first_of_each_and_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [(1, "X", 0.1, 10_000), (1, "X", 0.1, 10_000)], [(1, "X", 0.1, 10_000), (2, "X", 0.5, 10_050)], [(9, "X", 0.0, 99_999)])
    stream = jobs.answer_stream(spark, folder, SCHEMA, 1)
    jobs.run_once(jobs.first_of_each(stream, ["case_id", "side"], "at", "1 hour"), str(tmp_path / "c1"), "firsts")
    assert sorted(r["case_id"] for r in spark.table("firsts").collect()) == [1, 2, 9]
    jobs.run_once(jobs.windowed_summary(stream, "at", "1 hour", "1 minute", "p"), str(tmp_path / "c2"), "hours")
    assert spark.table("hours").agg(F.sum("n")).first()[0] in (4, 5)


def test_upsert_is_idempotent(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    arrive(spark, folder, [(1, "X", 0.1, 1)], [(1, "X", 0.7, 5), (2, "X", 0.2, 2)])
    write = jobs.upsert(table, ["case_id"], "at")
    query = jobs.answer_stream(spark, folder, SCHEMA, 1).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    write(spark.read.schema(SCHEMA).json(folder).where("case_id = 2"), 99)
    write(spark.read.schema(SCHEMA).json(folder).where("case_id = 2"), 99)
    got = {r["case_id"]: r["p"] for r in jobs.latest(spark, table, ["case_id"], "at").collect()}
    assert got == {1: 0.7, 2: 0.2}
