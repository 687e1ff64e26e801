"""Work that is done once: results kept by content, runs that go on where they stopped, files parsed only when changed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "key string, value string, error string, at double"
FILE = "path string, modified timestamp, length bigint, sha256 string"


def stored(spark: SparkSession, store: str, schema: str = RESULT) -> DataFrame:
    """What a store holds; nothing before the first write."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(store) if there else spark.createDataFrame([], schema)


def results(spark: SparkSession, store: str) -> DataFrame:
    """The result of each key: a value if some try gave one, else its last error."""
    best = F.struct(F.col("error").isNull().alias("done"), "at", "value", "error")
    return stored(spark, store).groupBy("key").agg(F.max(best).alias("_r")).select("key", "_r.value", "_r.error")


def content_key(*columns: str) -> F.Column:
    """A digest of a row's own columns, each told apart from its neighbours and null from empty."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def resume(work: DataFrame, by: list[str], call: Callable[[dict], str], store: str, *, slices: int = 1) -> DataFrame:
    """``work`` with ``value`` and ``error`` of ``call`` on the columns ``by``, each content called once and never again.

    What the store has a value for is not called; what failed is kept with its error and tried again by the next run.
    Work is dealt to ``slices`` by content, each written when it is done: a run that is stopped has its slices behind it.
    """
    spark = work.sparkSession
    keyed = work.withColumn("_key", content_key(*by))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = row.pop("_key")
                try:
                    out.append((key, str(call(row)), None, time.time()))
                except Exception as e:  # noqa: BLE001  a failure is a result
                    out.append((key, None, f"{type(e).__name__}: {e}", time.time()))
            yield pd.DataFrame(out, columns=["key", "value", "error", "at"])

    for k in range(slices):
        own = keyed.where(F.pmod(F.xxhash64("_key"), F.lit(slices)) == k).select("_key", *by)
        done = stored(spark, store).where("error is null").select(F.col("key").alias("_key")).distinct()
        still = own.join(done, "_key", "left_anti").dropDuplicates(["_key"])
        still.mapInPandas(run, RESULT).write.mode("errorifexists").parquet(f"{store}/run-{uuid.uuid4().hex}")
    got = results(spark, store).withColumnRenamed("key", "_key")
    return keyed.join(got, "_key", "left").drop("_key")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def compared(spark: SparkSession, path: str, state: DataFrame) -> DataFrame:
    """Files against what is known of them: ``same`` (by time and length), ``touched`` (another time, the same content),
    ``changed``, ``new`` or ``gone``. Only files of another time or length are read, to digest them."""
    known = state.select("path", F.col("modified").alias("_m"), F.col("length").alias("_l"), F.col("sha256").alias("_s"))
    both = listing(spark, path).join(known, "path", "full")
    likely = both.where("modified is not null").where(~F.coalesce((F.col("modified") == F.col("_m")) & (F.col("length") == F.col("_l")), F.lit(False))).select("path")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).join(likely, "path", "left_semi").select("path", F.sha2("content", 256).alias("sha256"))
    out = both.join(content, "path", "left")
    kind = F.when(F.col("modified").isNull(), "gone").when(F.col("_m").isNull(), "new").when(F.col("sha256").isNull(), "same").when(F.col("sha256") == F.col("_s"), "touched").otherwise("changed")
    return out.select("path", "modified", "length", F.coalesce("sha256", "_s").alias("sha256"), kind.alias("kind"))


def hit_rates(seen: DataFrame) -> DataFrame:
    """Files by kind, and which share of those that are there needed no parsing."""
    n = seen.groupBy().agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("same", "touched", "changed", "new", "gone")])
    there = F.col("same") + F.col("touched") + F.col("changed") + F.col("new")
    return n.withColumn("hit_rate", F.when(there > 0, (F.col("same") + F.col("touched")) / there).otherwise(0.0))


def parse_changed(spark: SparkSession, path: str, store: str, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Parsed files (path, ...) and their hit rates. ``parse`` gets path and content of files that are new or changed alone.

    The state and what was parsed are written as the next version, and named only when both are whole; a run that is
    stopped leaves the version before.
    """
    from ..staging import staged

    versions = stored(spark, f"{store}/versions", "version bigint, folder string")
    last = versions.orderBy(F.col("version").desc()).first()
    state = spark.read.schema(FILE).parquet(f"{last['folder']}/state") if last else spark.createDataFrame([], FILE)
    seen = staged(compared(spark, path, state))
    fresh = seen.where(F.col("kind").isin("new", "changed")).select("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    made = parse(files.join(fresh, "path", "left_semi"))
    if last:
        kept = seen.where(F.col("kind").isin("same", "touched")).select("path")
        made = made.unionByName(spark.read.schema(made.schema).parquet(f"{last['folder']}/parsed").join(kept, "path", "left_semi"))
    folder = f"{store}/data-{uuid.uuid4().hex}"
    made.write.parquet(f"{folder}/parsed")
    seen.where("kind <> 'gone'").select("path", "modified", "length", "sha256").write.parquet(f"{folder}/state")
    version = (last["version"] if last else 0) + 1
    spark.createDataFrame([(version, folder)], "version bigint, folder string").coalesce(1).write.mode("errorifexists").parquet(f"{store}/versions/v{version}")
    return spark.read.schema(made.schema).parquet(f"{folder}/parsed"), hit_rates(seen)
