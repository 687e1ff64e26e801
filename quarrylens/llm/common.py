"""What the operators share: staging, Arrow maps over texts, and joins that survive a hot key."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Shares into which a group is dealt before its partial results meet.
SALTS = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


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


def drop_staged(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the cluster's own retention takes over
        pass


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """Each Arrow batch through ``function``, which returns a batch or a dict of columns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_pydict({n: out[n] for n in names})
                yield out

    return df.mapInArrow(run, schema)


def salted(*by: Column | str, shares: int = SALTS) -> Column:
    """A share from 0, by a row's own columns."""
    return F.pmod(F.xxhash64(*by), F.lit(shares)).cast("int")


def with_group(df: DataFrame, keys: list[str], salt: Column, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """``df`` with each group's aggregates, no task ever holding a group.

    ``partial`` aggregates a group's share (key and salt), ``final`` those shares by key; the result goes back to the
    shares first (at most ``SALTS`` rows a key) and then, by key and salt, to the rows. Nulls in keys are equal.
    """
    rows = df.withColumn("_salt", salt)
    shares = rows.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    totals = shares.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])
    a, b = shares.select(*keys, "_salt").alias("a"), totals.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    back = a.join(b, on=same, how="inner").select(*[f"a.{k}" for k in keys], "a._salt", *[f"b.{n}" for n in final]).alias("s")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_salt"]]
    return rows.alias("r").join(back, on=same, how="inner").select(*[f"r.{c}" for c in df.columns], *[f"s.{n}" for n in final])
