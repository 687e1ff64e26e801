"""The composed review: shared parts are made once, and texts go only to findings that quote them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import findings
from quarrylens.plans import review


def test_words_are_counted_as_they_are_split(spark):
    texts = ["", " ", "a", " a  b\t\nc ", "\n\ta", "a \r\n b", "é ü x", "a\x0bb\x0cc", "\t \t", "a b c d", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(T.collapse("t")).collect()] == [r[0] for r in rows.select(F.regexp_replace(F.coalesce("t", F.lit("")), r"\s+", " ")).collect()]
    assert [r[0] for r in rows.select(T.word_count("t")).collect()] == [r[0] for r in rows.select(F.size(T.words("t"))).collect()]


def test_sections_are_typed_once(spark, monkeypatch):
    kept = []
    stage = review.staged
    monkeypatch.setattr(review, "staged", lambda df: kept.append(df.columns) or stage(df))
    docs = spark.createDataFrame([(1, "# Login\nThe admin console is reached with a shared password = hunter22 over plain http by everyone.\n"), (2, None)], "doc_id bigint, text string")
    found = review.review(docs).collect()
    assert {r["doc_id"] for r in found} == {1, 2} and "topic" in kept[0]


def test_texts_go_to_findings_with_evidence(spark):
    f = findings.as_findings(spark.createDataFrame([(1, 0, "one two three four five six"), (1, 1, ""), (2, 2, "one two three four five six"), (3, 3, "one two three four five six")], "doc_id bigint, seq bigint, evidence_excerpt string"))
    texts = spark.createDataFrame([(1, "Zero. One two, three four five SIX seven"), (2, "one two three")], "doc_id bigint, document string")
    assert {r["seq"]: r["evidence_grounded"] for r in findings.triage(f, texts).collect()} == {0: True, 1: False, 2: False, 3: False}
