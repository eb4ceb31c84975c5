"""Sessions with the settings that the engine's results rest on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "lorekeep", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS and further ones; on a cluster without master, whose own settings then hold."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which a cluster's machines share; only where it is unset on a local master, one of our own."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lorekeep-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session, ready for checkpoint()."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark


#: Folders of the shared one that only a query's run needs. Stores, archives, baselines and people are kept unless they are named.
PASSING = ("lorekeep", "stream", "live", "conversations", "recordings")


def cleared(spark: SparkSession, kinds: tuple[str, ...] = PASSING) -> int:
    """Removes what finished queries have left in the shared folder, once their results are written elsewhere; how many folders. No query may be running."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs, gone = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for status in fs.listStatus(top) if fs.exists(top) else []:
        name = status.getPath().getName()
        if name == "lorekeep" and name in kinds or re.fullmatch(rf"(?:{'|'.join(kinds)})-[0-9a-f]{{32}}", name):
            gone += fs.delete(status.getPath(), True)
    return gone
