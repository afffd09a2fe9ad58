"""Session settings and shared scratch space."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that can be changed on a running session.  The number of shuffle
# partitions depends on the input; ``sized`` sets it from what the files hold.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A value that does not fit fails the job; it must not become null.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Open windows of many sites do not fit the default in-memory state store.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the jobs rely on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "capacast", master: str | None = None, shuffle_partitions: int | None = None,
          **settings: str) -> SparkSession:
    """Create (or get) a session; ``master`` is only given for local runs."""
    # Without the call-site records of the debugger, plans are built twice as fast.
    builder = SparkSession.builder.appName(app).config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


PARTITION = 256 << 20


def sizing(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for a job over that much input.

    Shuffles start with one partition for 256 MB, with at least two per core;
    adaptive execution merges the small ones up to that size.  Streams, which are
    not adaptive, keep the number for the life of their state.  Scan tasks grow
    with the input, up to 1 GB, so that their number stays manageable.
    """
    partitions = max(2 * cores, math.ceil(input_bytes / PARTITION))
    per_task = min(1 << 30, max(128 << 20, input_bytes // 200_000))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(PARTITION, max(8 << 20, input_bytes // partitions))),
        "spark.sql.files.maxPartitionBytes": str(per_task),
    }


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files below the paths, from their listing alone, on any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def sized(spark: SparkSession, *paths: str) -> SparkSession:
    """Set the session's sizes from the files of a job's input."""
    for key, value in sizing(stored_bytes(spark, *paths), spark.sparkContext.defaultParallelism).items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one every executor can reach.

    That is ``spark.checkpoint.dir`` or, where it is not set, the warehouse.  The warehouse's default is a folder of the
    driver's machine, so a cluster needs one of the two.  All scratch tables of a run lie in one folder, so it can be
    expired as a whole.
    """
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not usable(root, master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors reach; {root} is the driver's own")
    return f"{root.rstrip('/')}/capacast-{spark.sparkContext.applicationId}"


def usable(warehouse: str, master: str) -> bool:
    """Whether tasks can write below the warehouse: it is not the default, or tasks run on the driver's machine."""
    own = os.path.abspath("spark-warehouse")
    return master.startswith("local") or warehouse.removeprefix("file:").rstrip("/").replace("//", "/") != own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever reused."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def discard_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this application; for the end of a job, when no DataFrame reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so several outputs derive from one computation, and the
    written rows survive the loss of executors.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
