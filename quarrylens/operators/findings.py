"""The algebra of findings: identity, triage, deduplication, merging, order and comparison of runs.

A findings table has doc_id, seq (the order in which they were raised) and the columns of ``FINDING``. Sentinels are
empty strings and arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .similarity import greedy_groups, similar_pairs  # noqa: F401  part of this algebra

FINDING = {
    "doc_id": "bigint", "seq": "bigint", "section": "string", "domain": "string", "severity": "string", "issue": "string", "recommendation": "string",
    "standard_reference": "string", "kb_source": "string", "evidence_excerpt": "string", "control_mappings": "array<string>", "origin": "string", "rule_id": "string",
    "confidence": "double", "kind": "string", "verifier_status": "string", "evidence_grounded": "boolean", "also_in": "array<string>",
}
VAGUE = r"(?i)unspecified issue|remediation not specified|requires architect input|^\s*(?:n/?a|none|tbd|unknown)\s*$"


def as_findings(df: DataFrame) -> DataFrame:
    """All columns of ``FINDING``, those that are missing or null by their sentinels; severities normalised."""
    def column(name: str, kind: str) -> Column:
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit({"string": "", "boolean": False, "double": 0.0, "bigint": 0}[kind]).cast(kind)
        c = F.coalesce(F.col(name).cast(kind), empty) if name in df.columns else empty
        return (T.severity(c) if name == "severity" else F.when(c == "", "finding").otherwise(c) if name == "kind" else c).alias(name)

    return df.select(*[column(n, k) for n, k in FINDING.items()])


def union_sources(*sources: DataFrame) -> DataFrame:
    """Findings of several sources one after the other, renumbered in that order within each document."""
    parts = [as_findings(s).withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_source", "seq")) - 1).cast("bigint")).drop("_source")


def fingerprints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", T.fingerprint("domain", "section", "rule_id", "issue"))


def is_grounded() -> Column:
    return (F.col("standard_reference") != "") & (F.col("kb_source") != "")


def is_question() -> Column:
    label = F.trim(F.lower(F.col("section")))
    return (F.col("kind") == "question") | label.startswith("whole document") | label.startswith("document (completeness)") | (F.trim("issue") == "") | F.rlike(F.col("issue"), F.lit(VAGUE))


def is_confirmed() -> Column:
    return (F.col("origin") == "rules_engine") | (F.col("verifier_status") == "CONFIRMED")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "moderate").otherwise("low")


def triage(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """Marks what is grounded in its document (doc_id, document) and what is only a question.

    Findings without evidence are not grounded and do not carry their document along.
    """
    some = F.coalesce(F.col("evidence_excerpt") != "", F.lit(False))
    both = findings.where(some).join(texts.select("doc_id", "document"), "doc_id", "left")
    marked = both.withColumn("evidence_grounded", T.grounded("evidence_excerpt", F.coalesce("document", F.lit("")))).drop("document")
    marked = marked.unionByName(findings.where(~some).withColumn("evidence_grounded", F.lit(False)))
    return marked.withColumn("kind", F.when(is_question(), "question").otherwise(F.col("kind")))


def dedupe(findings: DataFrame) -> DataFrame:
    """The best of each fingerprint: grounded, then more severe, then from a rule, then the first raised."""
    best = Window.partitionBy("doc_id", "fingerprint").orderBy(is_grounded().desc(), T.severity_rank("severity"), (F.col("origin") == "rules_engine").desc(), "seq")
    return fingerprints(findings).withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def merge_duplicates(findings: DataFrame, threshold: float = 0.4) -> DataFrame:
    """One finding for the same problem in several sections of a document; rules' findings stay as they are."""
    tokens = F.when(F.col("rule_id") == "", T.issue_tokens("issue")).otherwise(F.array().cast("array<string>"))  # none: joins nothing
    grouped = greedy_groups(findings.withColumn("_t", tokens), ["doc_id", "domain"], ["seq"], "_t", threshold)
    best = F.struct((~is_confirmed()).cast("int"), T.severity_rank("severity"), (~F.col("evidence_grounded")).cast("int"), -F.length("evidence_excerpt"), "seq", "place")
    one = grouped.groupBy("doc_id", "domain", "head").agg(F.min_by(F.struct(*findings.columns), best).alias("_f"), F.collect_set("section").alias("_sections"))
    f = F.col("_f")
    others = F.array_sort(F.array_union(f["also_in"], F.array_remove("_sections", f["section"])))
    return one.select(*[(others if c == "also_in" else f[c]).alias(c) for c in findings.columns])


def ordered(findings: DataFrame) -> DataFrame:
    """A place for each finding of its document: severity, domain, section, issue."""
    by = Window.partitionBy("doc_id").orderBy(T.severity_rank("severity"), "domain", F.lower("section"), F.lower("issue"), "seq")
    return findings.withColumn("place", F.row_number().over(by))


def priority_actions(findings: DataFrame, limit: int = 3) -> DataFrame:
    """The first findings of distinct problems by severity, grounding and breadth; repeats fill what is left."""
    keyed = findings.withColumn("_problem", T.problem_key("rule_id", "domain", "issue"))
    by = [T.severity_rank("severity"), (~is_grounded()).cast("int"), -F.size("control_mappings"), F.col("seq")]
    again = F.row_number().over(Window.partitionBy("doc_id", "_problem").orderBy(*by)) > 1
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_again", *by))
    return keyed.withColumn("_again", again).withColumn("priority", place).where(F.col("priority") <= limit).drop("_problem", "_again")


def diff_runs(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``new``, ``resolved`` or ``persisting`` for every key of either run."""
    a, b = before.select(*keys).distinct().withColumn("_a", F.lit(True)), after.select(*keys).distinct().withColumn("_b", F.lit(True))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "resolved").otherwise("persisting").alias("state"))


def gate(findings: DataFrame, acknowledged: DataFrame, threshold: str = "HIGH") -> DataFrame:
    """Findings that block: as severe as the threshold and not acknowledged. Empty means pass."""
    worst = F.col("severity").isin(list(T.SEVERITIES[: T.SEVERITIES.index(threshold) + 1]))
    return fingerprints(findings).where(worst).join(acknowledged.select("fingerprint").distinct(), "fingerprint", "left_anti")


def adjudicate(findings: DataFrame, verdicts: DataFrame, texts: DataFrame) -> DataFrame:
    """A verifier's verdicts, kept honest: a refutation needs a quote that is in the document and states no absence."""
    both = findings.join(verdicts.select("doc_id", "seq", "verdict", "quote"), ["doc_id", "seq"], "left").join(texts.select("doc_id", "document"), "doc_id", "left")
    sound = T.quote_in_document("quote", F.coalesce("document", F.lit(""))) & ~T.asserts_absence("quote")
    status = F.when(F.col("verdict") == "CONFIRMED", "CONFIRMED").when((F.col("verdict") == "REFUTED") & sound, "REFUTED").otherwise("NEEDS_HUMAN")
    return both.withColumn("verifier_status", status).drop("verdict", "quote", "document")


def filtered(findings: DataFrame, least: str = "LOW", domains: list[str] | None = None, search: str = "") -> DataFrame:
    out = findings.where(T.severity_rank("severity") <= T.SEVERITIES.index(least))
    out = out.where(F.col("domain").isin(domains)) if domains else out
    return out.where(F.contains(F.lower(F.concat_ws(" ", "section", "issue", "recommendation")), F.lit(search.lower()))) if search else out
