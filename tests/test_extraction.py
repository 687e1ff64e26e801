"""Skills, extraction, reports and evaluation tables on small tables of their own, against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import text as T
from quarrylens.operators import dataflow, evaluation, extraction, findings, rules, scoring, skills
from quarrylens.sinks import writers

SECTION = "doc_id bigint, index int, heading string, body string"


def test_matches_have_places_and_surroundings(spark):
    rng = random.Random(6)
    texts = ["", "abab", *["".join(rng.choices("ab c\n", k=rng.randint(0, 300))) for _ in range(40)]]
    steps = (skills.Step("s", 1, "a+b", "x"), skills.Step("s", 2, "c", "y", "HIGH"))
    df = spark.createDataFrame([(i, 0, "h", t) for i, t in enumerate(texts)] + [(99, 0, "h", None)], SECTION)
    got = sorted((r["doc_id"], r["step"], r["match"], r["begin"], r["hit"], r["evidence"], r["finding_id"]) for r in skills.all_matches(df, steps).collect())
    want = [(i, s.step, k + 1, m.start() + 1, m[0], t[max(0, m.start() - 100) : m.end() + 100], f"s_0_step{s.step}_match{k + 1}") for i, t in enumerate(texts) for s in steps for k, m in enumerate(re.finditer(s.pattern, t))]
    assert got == sorted(want)
    kept = skills.dedupe_matches(skills.all_matches(df, steps)).count()
    assert kept == len({(i, s, e[:50]) for i, s, _, _, _, e, _ in want})


def test_unsafe_patterns_are_refused(spark):
    for bad in ("(a+)+", "(", ".*x.*y.*", "a" + "b?" * 16, "(a)" * 21, "a{10000}"):
        assert skills.pattern_problems(bad)
    assert not skills.pattern_problems(r"\bsnmp\s?v[12]c?\b")
    with pytest.raises(ValueError, match="unsafe"):
        skills.safe_steps([skills.Step("s", 1, "(a+)+", "x")])


def test_skills_are_counted_and_steps_meet_patterns(spark):
    df = spark.createDataFrame([("a", ["net"], ["x", "y"], [], ["n"]), ("b", ["net", "app"], ["y"], [], [])], "name string, domains array<string>, tags array<string>, platforms array<string>, frameworks array<string>")
    assert tuple(skills.index_stats(df).first()) == (2, 2, 2, 0, 1)
    assert [r["name"] for r in skills.with_value(df, "tags", "y").collect()] == ["a", "b"]
    steps = spark.createDataFrame([("a", 1, "Check the TLS version"), ("a", 2, "Nothing")], "skill string, step int, content string")
    names = spark.createDataFrame([("weak_tls",), ("snmp_v1",)], "name string")
    assert [tuple(r) for r in skills.step_patterns(steps, names).select("step", "name").collect()] == [(1, "weak_tls")]


def test_components_and_connections(spark):
    body = "The orders service writes rows to the orders database. A browser client talks to the edge gateway. Orders Service is small."
    df = spark.createDataFrame([(1, 0, "A", body), (2, 0, "A", None)], SECTION)
    known = extraction.components(df)
    assert {(r["id"], r["kind"], r["mentions"]) for r in known.collect()} == {("orders-service", "service", 2), ("orders-database", "database", 1), ("browser-client", "client", 1), ("edge-gateway", "gateway", 1)}
    flows = {(r["source"], r["target"]) for r in extraction.connections(df, known).collect()}
    assert flows == {("orders-service", "orders-database"), ("browser-client", "edge-gateway")}


def test_quotes_findings_and_sections(spark):
    sections = spark.createDataFrame([(1, 0, "One", "alpha beta"), (1, 1, "Two", "gamma  delta"), (1, 2, "Three", "gamma delta")], SECTION)
    quotes = spark.createDataFrame([(1, 1, "Gamma delta"), (1, 2, "nowhere"), (1, 3, "")], "doc_id bigint, quote_id bigint, quote string")
    assert {r["quote_id"]: (r["section"], r["held"]) for r in extraction.quote_sections(quotes, sections).collect()} == {1: ("Two", True), 2: ("One", False), 3: ("One", False)}
    found = spark.createDataFrame([(1, "two ", "LOW"), (1, "Two", "HIGH")], "doc_id bigint, section string, severity string")
    assert [(r["heading"], r["findings"], r["worst"]) for r in extraction.sections_with_findings(sections, found).orderBy("index").collect()] == [("One", 0, None), ("Two", 2, "HIGH"), ("Three", 0, None)]


def test_broken_json_gives_its_whole_objects(spark):
    text = '{"components": [{"id": "a", "note": "x } y"}, {"id": "b"}, {"id": "c", "no'
    row = spark.createDataFrame([(text, 'I call {"name": "search", "arguments": {"q": "x"}} and {"name": "other", "arguments": {}}')], "j string, p string")
    r = row.select(extraction.salvaged_objects("j", "components").alias("o"), extraction.salvaged_objects("j", "flows").alias("none"), extraction.tool_calls("p", ["search"]).alias("calls")).first()
    assert r["o"] == ['{"id": "a", "note": "x } y"}', '{"id": "b"}'] and r["none"] == []
    assert [tuple(c) for c in r["calls"]] == [("search", '{"q": "x"}')]


def test_similar_pairs_match_all_pairs(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]) for i in range(80)]
    sets = {}
    for i, w in rows:
        if w:
            sets.setdefault(frozenset(w), i)
    for t in (0.3, 0.5, 1.0):
        got = {tuple(r) for r in findings.similar_pairs(spark.createDataFrame(rows, "i bigint, w array<string>"), "i", "w", t).collect()}
        assert got == {(a, b) for x, a in sets.items() for y, b in sets.items() if a < b and len(x & y) >= t * len(x | y) - 1e-9}


def made(spark, rows):
    return findings.as_findings(spark.createDataFrame(rows, "doc_id bigint, seq bigint, section string, domain string, severity string, issue string, rule_id string, kind string, evidence_excerpt string"))


def test_reports_and_acknowledgements(spark):
    rows = [(1, 0, "S|1", "network", "HIGH", "bad\nthing", "R-1", "finding", "proof"), (1, 1, "S2", "security", "LOW", "less", "R-2", "finding", ""), (1, 2, "S2", "security", "LOW", "why", "R-3", "question", "")]
    f = findings.fingerprints(findings.ordered(made(spark, rows)))
    scored = spark.createDataFrame([(1, 2, 15.0, "AMBER"), (2, 0, 0.0, "GREEN")], "doc_id bigint, n_findings bigint, score double, status string")
    sections = spark.createDataFrame([(1, "network"), (1, "network"), (1, "security")], "doc_id bigint, domain string")
    out = {r["doc_id"]: r["report"] for r in writers.markdown_reports(f, scored, sections).collect()}
    for line in ("Status: **AMBER**, risk score 15.0, 2 findings", "| HIGH | 1 |", "| LOW | 1 |", "1. bad thing (S\\|1)", "### network", "| 1 | S\\|1 | proof |", "- why (S2)", "| network | 2 |"):
        assert line in out[1], line
    assert "**GREEN**" in out[2] and "| HIGH | 0 |" in out[2]
    acks = writers.acknowledgements(f, "known").collect()
    assert [r["severity"] for r in acks] == ["HIGH", "LOW", "LOW"] and {r["reason"] for r in acks} == {"known"}


def test_threats_merge_and_lists_are_ordered(spark):
    f = made(spark, [(1, 0, "A", "network", "HIGH", "x", "R-1", "finding", "")])
    t = made(spark, [(1, 0, "A", "network", "HIGH", "x", "R-1", "finding", ""), (1, 1, "B", "network", "CRITICAL", "y", "R-2", "finding", "")])
    both = extraction.merged_threats(f, t)
    assert sorted(r["rule_id"] for r in both.collect()) == ["R-1", "R-2"]
    assert scoring.risk(both, ["doc_id"]).first()["n_findings"] == 2
    order = rules.listed(spark.createDataFrame([(1, "R-2", "a", 0), (1, "R-1", "B", 1), (1, "R-1", "b", 0)], "doc_id bigint, rule_id string, section string, index int"))
    assert [(r["rule_id"], r["index"]) for r in order.orderBy("place").collect()] == [("R-1", 0), ("R-1", 1), ("R-2", 0)]
    m = dataflow.ranked_model_findings(spark.createDataFrame([("d", "SM-2", "LOW", "b"), ("d", "SM-1", "HIGH", "a")], "document string, rule_id string, severity string, issue string"))
    assert [(r["rule_id"], r["confidence"]) for r in m.orderBy("seq").collect()] == [("SM-1", 0.8), ("SM-2", 0.8)]
    layer = rules.first_layer(f.withColumn("domain", F.lit("network")), spark.createDataFrame([("network",)], "domain string"), ["network", "security"])
    assert {tuple(r) for r in layer.collect()} == {("network", 1, 1), ("security", 0, 0)}


def test_runs_of_the_evaluation(spark, tmp_path):
    s = spark.createDataFrame([("b", 2, "full", 0.5), ("a", 1, "full", 0.25), ("c", 3, "rules_only", 0.75)], "run string, written bigint, kind string, f1 double")
    assert [(r["run"], r["f1_change"]) for r in evaluation.compared_runs(s).orderBy("place").collect()] == [("a", None), ("b", 0.25), ("c", 0.25)]
    assert evaluation.latest_run(s).first()["run"] == "b"
    answers = spark.createDataFrame([("n", ["x"], []), ("n", [], ["t"]), ("s", ["x", "y"], ["t"])], "domain string, expected_findings array<string>, must_not_flag array<string>")
    assert {tuple(r) for r in evaluation.inventory(answers).collect()} == {(None, 3, 3, 2, 1), ("n", 2, 1, 1, 1), ("s", 1, 2, 1, 0)}
    sheet = spark.createDataFrame([("1", "yes"), ("2", " "), ("3", None)], "item string, human_label string")
    writers.review_sheet(sheet, str(tmp_path / "sheet"), "item")
    assert [tuple(r) for r in evaluation.labelled_sheet(spark, str(tmp_path / "sheet")).collect()] == [("1", "yes")]


def test_small_functions(spark):
    row = spark.createDataFrame([("one two three four five", "zero one two three four five", {"b": "2", "a": "1"}, ["x", "y"], "judge_model: qwen2.5:14b\nmodel: 'a/b'\nother: z")], "q string, d string, m map<string,string>, l array<string>, c string")
    r = row.select(T.quote_grounded("q", "d").alias("short"), T.quote_grounded(F.lit("one two three"), "d").alias("no"), T.mapped_text("m").alias("m"), T.joined_text("l").alias("l"), T.model_names("c").alias("c"), T.as_json("q").alias("j"), T.cache_name(F.lit("a")).alias("k")).first()
    assert r["short"] and not r["no"] and r["m"] == "a: 1; b: 2" and r["l"] == "x; y" and r["c"] == ["qwen2.5:14b", "a/b"] and r["j"] == '{"q":"one two three four five"}' and len(r["k"]) == 32
