"""Composed plans: what a review does with a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings, rules, scoring, sections
from ..staging import staged


def typed_sections(docs: DataFrame) -> DataFrame:
    """Sections with their domain and topics."""
    split = sections.split_sections(docs)
    return sections.classify(split, split.columns, "heading", "body")


def review(docs: DataFrame) -> DataFrame:
    """Deduplicated, merged and triaged findings of the rules and of completeness, for documents (doc_id, text)."""
    typed = staged(typed_sections(docs))  # read by section and by document
    gaps = sections.completeness_findings(sections.completeness(docs)).withColumn("origin", F.lit("rules_engine"))
    hits = rules.run_rules(typed).withColumn("seq", F.col("index").cast("bigint"))
    both = findings.union_sources(gaps, hits)
    texts = docs.select("doc_id", F.col("text").alias("document"))
    return findings.merge_duplicates(staged(findings.triage(staged(findings.dedupe(both)), texts)))


def statuses(found: DataFrame) -> DataFrame:
    """Score and status of every document that has findings."""
    return scoring.risk(found, ["doc_id"])
