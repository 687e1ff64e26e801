"""Tables written to the folder that driver and executors share: what loops and shared parts of a plan are built on."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see. On one machine without the setting, a folder of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or "/tmp/checkpoints").rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, a lost executor costs nothing already done."""
    return staged_at(df)[0]


def staged_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``staged`` with the folder, for a loop that has each step's table dropped once the next one is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the shuffles of this one write go as soon as it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(drop_staged, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``staged`` for tables that go at the end of the block; what comes of them is to be staged before."""
    made: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        out, path = staged_at(df)
        made.append((df.sparkSession, path))
        return out

    try:
        yield keep
    finally:
        for spark, path in made:
            drop_staged(spark, path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, which goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_staged, spark, path)
    return path


def drop_staged(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the cluster's own retention takes over
        pass
