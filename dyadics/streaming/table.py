"""A table of the last row of each key, fed by a stream in batches that may come again.

A batch is written to a folder of its own; it counts once a manifest that lists it is there. Manifests are numbered, and each is
created only if it does not exist yet, so of two writers one begins again from the other's. Readers take the greatest
manifest and read what it lists. Compaction writes the state as one folder, and a manifest that lists it alone switches
readers at once; what the manifest before it listed goes when the next compaction comes, so readers in between finish.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import keep_last

_FOLDER = "manifests"


class ManifestConflict(RuntimeError):
    """Another writer has created the manifest of that number."""


class UpsertTable:
    """``key`` names a row, and of rows of a key the one of the greatest ``order`` is kept; of equal orders the later batch's."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at(_FOLDER)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(_FOLDER))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, folders (name and batch, the latest last), batch (the last one taken in) and retired folders."""
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "folders": [], "batch": -1, "retired": []}
            version = known[-1]
        stream = self._fs.open(self._at(f"{_FOLDER}/{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """Creates a manifest under its number, whole or not at all: it is written aside and renamed to a name that is free."""
        to = self._at(f"{_FOLDER}/{manifest['version']:012d}.json")
        aside = self._at(f"{_FOLDER}/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        try:
            taken = self._fs.exists(to) or not self._fs.rename(aside, to)
        finally:
            self._fs.delete(aside, False)
        if taken:
            raise ManifestConflict(manifest["version"])

    def _committed(self, change, attempts: int = 10) -> dict:
        for _ in range(attempts):
            old = self.manifest()
            new = change(old)
            if new is None:
                return old
            try:
                self._commit(new | {"version": old["version"] + 1})
                return new
            except ManifestConflict:
                continue
        raise ManifestConflict(f"no manifest after {attempts} attempts")

    def write(self, batch: DataFrame, number: int) -> bool:
        """Takes in a batch (a ``foreachBatch`` function). One whose number has been taken in is left as it is: False."""
        if number <= self.manifest()["batch"]:
            return False
        folder = f"data/batch-{number}-{uuid.uuid4().hex}"
        keep_last(batch.withColumn("_order", batch[self.order]), self.key, "_order").drop("_order").write.parquet(f"{self.path}/{folder}")

        def change(old: dict) -> dict | None:
            if number <= old["batch"]:
                return None
            return old | {"folders": [*old["folders"], {"name": folder, "batch": number}], "batch": number}

        taken = any(f["name"] == folder for f in self._committed(change)["folders"])
        if not taken:
            self._fs.delete(self._at(folder), True)
        return taken

    def latest(self, version: int | None = None) -> DataFrame | None:
        """The last row of each key as of a manifest, the greatest by default; None before the first batch."""
        from pyspark.sql import functions as F

        rows = None
        for f in self.manifest(version)["folders"]:
            one = self.spark.read.parquet(f"{self.path}/{f['name']}").withColumn("_at", F.struct(F.col(self.order), F.lit(f["batch"]).alias("batch")))
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        return None if rows is None else keep_last(rows, self.key, "_at").drop("_at")

    def compact(self) -> bool:
        """Writes the state as one folder and switches to it; folders that the compaction before this one retired go."""
        before = self.manifest()
        if len(before["folders"]) < 2:
            return False
        folder = f"data/state-{uuid.uuid4().hex}"
        self.latest(before["version"]).write.parquet(f"{self.path}/{folder}")
        gone = {f["name"] for f in before["folders"]}
        dropped: list[str] = []

        def change(old: dict) -> dict | None:
            if not gone <= {f["name"] for f in old["folders"]}:
                return None  # another compaction was first
            dropped[:] = old["retired"]
            later = [f for f in old["folders"] if f["name"] not in gone]  # batches that came meanwhile
            return old | {"folders": [{"name": folder, "batch": before["batch"]}, *later], "retired": sorted(gone)}

        done = any(f["name"] == folder for f in self._committed(change)["folders"])
        for name in dropped if done else [folder]:
            self._fs.delete(self._at(name), True)
        return done

    def folders(self) -> set[str]:
        """Folders of data that are there, listed or not."""
        at = self._at("data")
        return {f"data/{f.getPath().getName()}" for f in self._fs.listStatus(at)} if self._fs.exists(at) else set()

    def vacuum(self) -> int:
        """Deletes folders that no manifest's last state lists or retires: what failed writers left. No writer may be at work."""
        last = self.manifest()
        lost = self.folders() - {f["name"] for f in last["folders"]} - set(last["retired"])
        for name in lost:
            self._fs.delete(self._at(name), True)
        return len(lost)
