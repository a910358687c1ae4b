"""One place for the session settings that the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: For streams with timers: their state store, set before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session(app: str = "dyadics", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` entries are added on top.

    On a cluster ``spark.checkpoint.dir`` has to name a folder that all executors share. A local master gets one of its
    own, which goes with the process.
    """
    settings = SETTINGS | conf
    if master and master.startswith("local") and "spark.checkpoint.dir" not in settings:
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="dyadics-")
        atexit.register(shutil.rmtree, settings["spark.checkpoint.dir"], True)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session without one gets a temporary folder; a cluster has to name one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="dyadics-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own
