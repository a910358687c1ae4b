import pytest
from pyspark.sql import functions as F

from dyadics.session import STATE_STORE
from dyadics.streaming import monitor
from dyadics.streaming.table import ManifestConflict, UpsertTable

LINES = "run string, place long, value string"


def rows(spark, *what):
    return spark.createDataFrame(list(what), "k int, n int, v string")


def state(table, version=None):
    return sorted((r["k"], r["n"], r["v"]) for r in table.latest(version).collect())


def test_batches_count_once_and_the_last_row_stays(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], "n")
    assert table.latest() is None and table.manifest()["batch"] == -1
    assert table.write(rows(spark, (1, 1, "a"), (1, 2, "b"), (2, 1, "c")), 0)
    assert table.write(rows(spark, (2, 5, "d"), (1, 2, "tie")), 1)
    assert not table.write(rows(spark, (9, 9, "replayed")), 0) and not table.write(rows(spark, (9, 9, "replayed")), 1)
    assert state(table) == [(1, 2, "tie"), (2, 5, "d")]


def test_compaction_switches_readers_at_once_and_drops_old_folders_later(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], "n")
    for b in range(3):
        table.write(rows(spark, (b, b, "x"), (7, b, f"v{b}")), b)
    want, before, old = state(table), table.latest(), {f["name"] for f in table.manifest()["folders"]}
    assert table.compact() and state(table) == want
    assert old <= table.folders()  # a reader that began before finishes
    assert sorted((r["k"], r["n"], r["v"]) for r in before.collect()) == want
    assert not table.compact()  # one folder needs none
    assert not table.write(rows(spark, (9, 9, "replayed")), 2)
    table.write(rows(spark, (7, 99, "new")), 3)
    assert table.compact() and not old & table.folders()
    assert state(table)[-1] == (7, 99, "new")
    assert sorted(table.versions()) == table.versions() == list(range(1, table.manifest()["version"] + 1))


def test_of_two_writers_one_begins_again(spark, tmp_path, monkeypatch):
    one, two = (UpsertTable(spark, str(tmp_path / "t"), ["k"], "n") for _ in range(2))
    one.write(rows(spark, (1, 1, "a")), 0)
    one.write(rows(spark, (2, 1, "b")), 1)
    commit = UpsertTable._commit
    first = []

    def late(self, manifest):
        if self is one and not first:  # a batch comes while a compaction is being written
            first.append(1)
            two.write(rows(spark, (3, 1, "c")), 2)
        commit(self, manifest)

    monkeypatch.setattr(UpsertTable, "_commit", late)
    assert one.compact() and first
    assert state(one) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")] and len(one.manifest()["folders"]) == 2
    with pytest.raises(ManifestConflict):
        commit(one, one.manifest())


def test_what_failed_writers_left_is_never_read(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path / "t"), ["k"], "n")
    table.write(rows(spark, (1, 1, "a")), 0)
    rows(spark, (1, 99, "lost")).write.parquet(str(tmp_path / "t" / "data" / "batch-1-dead"))
    assert state(table) == [(1, 1, "a")] and table.vacuum() == 1 and table.vacuum() == 0
    assert state(table) == [(1, 1, "a")]


def test_a_stream_resumes_where_it_was(spark, tmp_path):
    source, table = str(tmp_path / "in"), UpsertTable(spark, str(tmp_path / "t"), ["k"], "n")

    def run():
        stream = spark.readStream.schema("k int, n int, v string").option("maxFilesPerTrigger", 1).json(source)
        stream.writeStream.foreachBatch(lambda batch, number: table.write(batch, number) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    for part in ([(1, 1, "a")], [(1, 3, "b"), (2, 1, "c")]):
        rows(spark, *part).coalesce(1).write.mode("append").json(source)
    run()
    rows(spark, (2, 4, "d")).coalesce(1).write.mode("append").json(source)
    run()
    run()
    assert state(table) == [(1, 3, "b"), (2, 4, "d")] and table.manifest()["batch"] == 2


@pytest.fixture
def states(spark):
    old = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.set(STATE_STORE[0], old)


def watch(spark, tmp_path, batches, patience_ms, wait=0.0, name="status"):
    import time

    source = str(tmp_path / "lines")
    for part in batches:
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(source)
    query = monitor.monitored(stream, patience_ms).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    if wait:
        time.sleep(wait)
    monitor.until_read(query, sum(map(len, batches)), 120)
    return spark.table(name)


def test_a_monitor_follows_runs(spark, tmp_path, states):
    metric = lambda n: f"{{'loss': '0.5', 'reward': '{n / 10}', 'frac_reward_zero_std': '{n / 100}'}}"
    batches = [
        [("a", 1, " 10%|#  | 10/100 [00:50<07:30,  5.0s/it]"), *(("a", 10 + n, metric(n)) for n in (3, 1, 2))],
        [("a", 20, " 20%|## | 20/100 [01:00:40<06:40,  5.0s/it]"), ("a", 5, "5/100 [00:01<00:10"), *(("a", 10 + n, metric(n)) for n in (4, 5, 6, 7, 7))],
        [("b", 1, "no bar, no metric"), ("c", 3, "{'reward': '-1e-3'}"), ("c", 4, None)],
    ]
    last = watch(spark, tmp_path, batches, 600_000).groupBy("run").agg(F.max_by(F.struct("*"), F.struct("last_place", F.size("reward"))).alias("s")).select("s.*")
    got = {r["run"]: r for r in last.collect()}
    a = got["a"]
    assert (a["done"], a["total"], a["share"], a["last_place"], a["stalled"]) == (20, 100, 0.2, 20, False)
    assert a["seconds_left"] == pytest.approx(3640 / 20 * 80) and a["seconds_a_step"] == pytest.approx(182)
    assert a["reward"] == [0.3, 0.4, 0.5, 0.6, 0.7] and a["frac_reward_zero_std"] == [0.03, 0.04, 0.05, 0.06, 0.07]
    assert got["b"]["done"] is None and got["b"]["reward"] == [] and got["c"]["reward"] == [-0.001] and got["c"]["last_place"] == 4


def test_a_silent_run_is_told_of_once(spark, tmp_path, states):
    out = watch(spark, tmp_path, [[("a", 1, "1/10 [00:05<00:45")]], 1_000, wait=12, name="silent")
    got = out.collect()
    assert [r["stalled"] for r in got] == [False, True] and got[1]["done"] == 1
