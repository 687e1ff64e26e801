"""The decision log as a stream: the latest decision of each finding, kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.workflow import latest

SCHEMA = "at timestamp, document string, fingerprint string, decision string, reason string, rule_id string, origin string"


def decision_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def latest_decisions(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """The latest decision of each finding, updated as entries arrive."""
    own = F.struct("decision", "reason", "rule_id", "origin")
    return stream.withWatermark("at", late).groupBy("document", "fingerprint").agg(F.max("at").alias("at"), F.max_by(own, "at").alias("d")).select("document", "fingerprint", "at", "d.*")


def decisions_per_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Accepted and disputed in windows of a day; windows close when the watermark passes them."""
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w")).agg(F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") == "disputed").alias("disputed")).select("w.start", "accepted", "disputed")


def keep_latest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch's entries merged into a Parquet table of the latest, written beside and then read instead of it."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{table}/{batch_id - 1}") if batch_id else batch.limit(0)
        latest(before.unionByName(batch), ["document", "fingerprint"], ["at"]).write.mode("overwrite").parquet(f"{table}/{batch_id}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
