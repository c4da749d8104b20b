"""Session settings shared by tests, benchmark and jobs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Rows of a small table that every task may hold; a larger one is moved to its rows by key.
HELD_ROWS = 300_000


def build_session(app: str = "tracemill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow on.

    On a cluster `master` and the partition count come from spark-submit; both arguments are for local runs.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in `spark.checkpoint.dir`. Only a local master, where driver and executors are one process,
    may go without: it gets a folder of its own. Raises ValueError on a cluster that names none."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or sc.getConf().get(CHECKPOINT_SETTING)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named and not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", sc.master):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share")
    target = named or tempfile.mkdtemp(prefix="tracemill-checkpoint-")
    sc.setCheckpointDir(target)
    return target


def materialize(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Writes a table that several later steps read into the shared folder and reads it back.

    Cuts the lineage: a lost executor costs its own tasks only, and no step computes the table again. `options` go to the Parquet writer.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(df: DataFrame, most: int = HELD_ROWS) -> DataFrame:
    """A stored table of few and short rows, for a join that leaves the other side where it is; with more than `most` rows, as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(df: DataFrame) -> None:
    """Removes a table that `materialize` wrote, when no later step reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = checkpoint_dir(spark)
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getParent().getName() == "tables" and folder.toString().split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
