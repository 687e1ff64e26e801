"""Operators on small tables of their own, against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import findings, rules, sections
from quarrylens.plans.topics import TOPICS

BODY = "the design describes how traffic enters leaves and is inspected here"


def split(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return [tuple(r)[1:] for r in sections.split_sections(docs).orderBy("index").collect()]


def test_headings_of_three_kinds(spark):
    text = f"# Title\n{BODY}\n\n2.1 Numbered Heading\n{BODY}\n\nUnderlined\n-----\n{BODY}"
    assert [(r[1], r[3]) for r in split(spark, text)] == [("Title", 1), ("2.1 Numbered Heading", 2), ("Underlined", 2)]


def test_stub_sections_go_and_text_without_headings_is_one(spark):
    assert [r[1] for r in split(spark, f"# Kept\n{BODY}\n# Stub\nfew words")] == ["Kept"]
    assert [(r[0], r[1]) for r in split(spark, BODY)] == [(0, sections.UNTITLED)]
    assert split(spark, None) == [] and split(spark, "  ") == []


def test_long_sections_are_cut_between_paragraphs(spark):
    paragraph = "word " * 400
    parts = split(spark, "# Long\n" + "\n\n".join([paragraph] * 4))
    assert [r[1] for r in parts] == ["Long (part 1)", "Long (part 2)"]
    assert len(split(spark, "# One\n" + "word " * 2_000)) == 1


def test_windows_cover_all_words(spark):
    words = [f"w{i}" for i in range(500)]
    row = spark.createDataFrame([(" ".join(words),)], "t string").select(sections.windows("t", 220, 40).alias("w")).first()
    assert [w.split()[0] for w in row["w"]] == ["w0", "w180", "w360"] and row["w"][-1].endswith("w499")


def test_topic_scores_count_keywords(spark):
    topic = TOPICS[0]
    word = topic.keywords[0]
    df = spark.createDataFrame([(1, f"about {word}", f"{word} " * 6), (2, None, None)], "doc_id bigint, h string, b string")
    found = {(r["doc_id"], r["topic"]): r["score"] for r in sections.score_topics(df, ["doc_id"], "h", "b").collect()}
    others = sum(min((f"{word} " * 6).count(k), 4) + 3 * (k in f"about {word}") for k in topic.keywords)
    assert found[1, topic.key] == others and all(d == 1 for d, _ in found)
    none = sections.classify(df, ["doc_id"], "h", "b").where("doc_id = 2").first()
    assert none["topic"] == "context_scope" and none["secondary_topics"] == []


def scan(spark, body):
    row = [(1, 0, "Heading", body, "context_scope", [])]
    typed = spark.createDataFrame(row, "doc_id bigint, index int, heading string, body string, topic string, secondary_topics array<string>")
    return {r["rule_id"] for r in rules.run_rules(typed).collect()}


def test_rules_hit_are_suppressed_and_guarded(spark):
    assert "NET-MGMT-001" in scan(spark, "Switches are polled over SNMP v2c.")
    assert "NET-MGMT-001" not in scan(spark, "SNMP v2c was replaced, SNMPv3 is used.")
    assert "NET-MGMT-001" in scan(spark, "SNMP v2c is used, SNMPv3 was considered.")
    assert scan(spark, "A quiet paragraph about flowers.") == set()


def test_greedy_groups_match_a_plain_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(i % 3, i, [rng.choice("abcdefg") for _ in range(rng.randint(0, 5))]) for i in range(90)]
    found = findings.greedy_groups(spark.createDataFrame(rows, "k bigint, seq bigint, t array<string>"), ["k"], ["seq"], "t", 0.4)
    got = {(r["k"], r["seq"]): r["head"] for r in found.collect()}
    for k in range(3):
        heads = []
        for place, (_, seq, t) in enumerate(r for r in rows if r[0] == k):
            own = set(t)
            head = next((h for h, o in heads if own and o and len(own & o) >= 0.4 * len(own | o)), None)
            if head is None:
                heads.append((place, own))
            assert got[k, seq] == (place if head is None else head)


def test_rule_findings_are_never_merged(spark):
    rows = [(1, 0, "A", "no encryption of backups", ""), (1, 1, "B", "backups have no encryption", ""), (1, 2, "C", "no encryption of backups", "R-1"), (1, 3, "D", "no encryption of backups", "R-1")]
    made = findings.as_findings(spark.createDataFrame(rows, "doc_id bigint, seq bigint, section string, issue string, rule_id string"))
    got = {r["seq"]: r["also_in"] for r in findings.merge_duplicates(made).collect()}
    assert got == {0: ["B"], 2: [], 3: []}


def test_runs_and_grounding(spark):
    row = spark.createDataFrame([("One two, three four five six seven.", "zero one two three four five six eight")], "q string, d string")
    r = row.select(T.runs("q").alias("runs"), T.grounded("q", "d").alias("yes"), T.grounded(F.lit("too short"), "d").alias("no"), T.runs(F.lit(None).cast("string")).alias("none")).first()
    assert r["runs"] == ["one two three four five six", "two three four five six seven"] and r["yes"] and not r["no"] and r["none"] == []
