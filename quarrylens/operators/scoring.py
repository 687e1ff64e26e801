"""Scores, status and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import is_confirmed, is_question

# Fixed values of the score.
WEIGHTS = {"CRITICAL": 40.0, "HIGH": 15.0, "MEDIUM": 5.0, "LOW": 1.0}
UNCONFIRMED, REPEAT, SCALE, RED, AMBER = 0.25, 0.2, 120.0, 40.0, 12.0


def risk(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Score and status of each key: a problem's repeats and unconfirmed findings weigh less, and sums saturate.

    Findings are counted by confirmation, then severity; questions are not counted. The occurrence number is the only
    window, over one problem of one key.
    """
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    kept = findings.where(~is_question()).withColumn("_confirmed", is_confirmed()).withColumn("_rank", T.severity_rank("severity")).withColumn("_problem", T.problem_key("rule_id", "domain", "issue"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_problem").orderBy((~F.col("_confirmed")).cast("int"), "_rank", "seq"))
    raw = F.coalesce(weight[F.col("severity")], F.lit(0.0)) * F.when(F.col("_confirmed"), 1.0).otherwise(UNCONFIRMED) * F.when(nth > 1, REPEAT).otherwise(1.0)
    sums = kept.withColumn("_raw", raw).groupBy(*keys).agg(
        F.sum("_raw").alias("raw"), F.count(F.lit(1)).alias("n_findings"),
        F.max(F.col("_confirmed") & (F.col("_rank") == 0)).alias("_critical"), F.max(F.col("_confirmed") & (F.col("_rank") <= 1)).alias("_high"), F.max(F.col("_rank") <= 1).alias("_any"),
    )
    scored = sums.withColumn("score", T.half_even(T.saturating(F.col("raw"), SCALE), 1))
    status = F.when(F.col("_critical"), "RED").when((F.col("score") >= RED) & F.col("_high"), "RED").when((F.col("score") >= AMBER) | F.col("_any"), "AMBER").otherwise("GREEN")
    return scored.select(*keys, "n_findings", "score", status.alias("status"))


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of a column's listed values, those that do not occur too."""
    dim = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return dim.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").fillna(0, ["n"])


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """A column for each severity, in one pass."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in T.SEVERITIES])


def coverage(sections: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Sections, findings and critical ones of every key that either has."""
    a = sections.select(*keys, F.lit(1).alias("s"), F.lit(0).alias("f"), F.lit(0).alias("c"))
    b = findings.select(*keys, F.lit(0).alias("s"), F.lit(1).alias("f"), (F.col("severity") == "CRITICAL").cast("int").alias("c"))
    return a.unionByName(b).groupBy(*keys).agg(F.sum("s").alias("sections"), F.sum("f").alias("findings"), F.sum("c").alias("critical"))


def summary_text(scored: DataFrame) -> DataFrame:
    return scored.withColumn("summary", F.format_string("Status %s with a risk score of %.1f from %d findings.", "status", "score", "n_findings"))


def matrix(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two columns, with totals by each and of all (where the other is null)."""
    return rows.cube(a, b).agg(F.count(F.lit(1)).alias("n"))


def counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone and of all rows, in one pass (the other columns are null)."""
    return rows.groupingSets([*[[F.col(c)] for c in columns], []], *columns).agg(F.count(F.lit(1)).alias("n"))


def domain_table(spark: SparkSession, domains: list[str]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in domains], "domain string")
