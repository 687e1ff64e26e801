"""Names and quotes in texts, against looking for each in each."""

from __future__ import annotations

import random

from quarrylens.operators import dataflow, evaluation, locating


def test_names_are_found_as_by_looking_for_each(spark):
    rng = random.Random(4)
    alphabet = ["a", "b", "ab", "é", "X", " ", "db", "-1"]
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    names = [(rng.choice("pq"), i, word(rng.randint(0, 4))) for i in range(60)] + [("p", 100, "service-0001"), ("p", 101, "service-0002"), ("r", 102, "ab"), (None, 103, "ab")]
    texts = [(rng.choice("pq"), i, word(rng.randint(0, 15))) for i in range(40)] + [("p", 90, "uses Service-0001 and more"), ("q", 91, None)]
    got = locating.named_in(spark.createDataFrame(texts, "k string, t int, text string"), spark.createDataFrame(names, "k string, n int, name string"), ["k"], ["t"], "text", "name")
    want = {(k, t, n) for k, t, text in texts for j, n, name in names if j == k and (name or "").lower() in (text or "").lower()}
    rows = [(r["k"], r["t"], r["n"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(set(rows))


def test_names_of_any_length_in_texts_whose_ids_have_nulls(spark):
    rng = random.Random(9)
    long = ["https://example.com/a/very/long/way/to/" + "".join(rng.choice("ab") for _ in range(4)) + end for end in ("", " x", "/😀é") for _ in range(6)]
    names = [(i, name) for i, name in enumerate(sorted({*long, "abcdef", "abcdefg", "abcdefghij", "bcdefg", "?bcdefg", "😀abcd", "y" * 32, "y" * 33, "", "a", "😀"}))]
    piece = lambda: rng.choice([*[n for _, n in names], "abcde", "abcdefgh", "😀bcdefg", "Y" * 31, " ", "x" * 4_085])
    texts = [(i, rng.choice([None, "en"]), "".join(piece() for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(90, None, None), (None, "en", "abcdefg")]
    rows = spark.createDataFrame([("m", *t) for t in texts], "k string, t int, lang string, text string")
    got = [(r["t"], r["lang"], r["n"]) for r in locating.named_in(rows, spark.createDataFrame([("m", *n) for n in names], "k string, n int, name string"), ["k"], ["t", "lang"], "text", "name").collect()]
    assert set(got) == {(t, lang, n) for t, lang, text in texts for n, name in names if name in (text or "").lower()} and len(got) == len(set(got))


def test_what_looks_like_names_makes_no_rows(spark):
    rng = random.Random(3)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = spark.createDataFrame([("m", i, word("abc", 300)) for i in range(400)], "k string, t int, text string")
    names = spark.createDataFrame([("m", i, word("abc", 40)) for i in range(2_000)] + [("m", 2_000 + i, word("abc", 14)) for i in range(2_000)], "k string, n int, name string")
    store, before = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    written = lambda: store.executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = written()
        found = locating.named_in(texts, names, ["k"], ["t"], "text", "name").collect()
        assert written() - began < 10_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    held = {t["t"]: t["text"] for t in texts.collect()}
    assert {(r["t"], r["n"]) for r in found} == {(t, n["n"]) for n in names.collect() for t, text in held.items() if n["name"] in text}


def test_many_components_of_one_document(spark):
    names = [("d", f"c{i}", f"service-{i:05d}") for i in range(3_000)]
    sections = [("d", i, "H", f"service-{i:05d} calls SERVICE-{i + 1:05d}.") for i in range(40)]
    components = spark.createDataFrame(names, "document string, id string, name string")
    flows = spark.createDataFrame([("d", "f1", "c0", "c1")], "document string, id string, source string, target string")
    facts = dataflow.facts_for_sections(spark.createDataFrame(sections, "doc_id string, index int, heading string, body string"), components, flows)
    got = {(r["index"], r["fact"]) for r in facts.collect()}
    assert got == {(i, f"component service-{j:05d}") for i in range(40) for j in (i, i + 1)} | {(0, "flow f1"), (1, "flow f1")}
    found = spark.createDataFrame([("d", "service-00007 leaks", ""), ("d", "x", "SERVICE-00007"), ("d", "service-00007 again", ""), ("e", "service-00008", "")], "doc_id string, issue string, evidence_excerpt string")
    risk = {r["id"]: (r["n"], r["level"]) for r in dataflow.component_risk(components, found).collect()}
    assert risk["c7"] == (3, "critical") and risk["c8"] == (0, "low") and len(risk) == 3_000


def test_quotes_stand_where_their_words_follow_each_other(spark):
    rng = random.Random(6)
    words = "a b c the end".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    quotes = [(i, text(rng.randint(1, 5))) for i in range(25)] + [(50, "  a \n b "), (51, ""), (52, "missing a"), (53, None)]
    texts = [(i, text(rng.randint(0, 30))) for i in range(25)] + [(90, "a\tb  a b"), (91, None)]
    want = set()
    for q, s in quotes:
        w = (s or "").split()
        for d, t in texts:
            x = (t or "").split()
            want |= {(q, d, k) for k in range(len(x)) if w and x[k : k + len(w)] == w}
    got = locating.quote_places(spark.createDataFrame(quotes, "q int, quote string"), spark.createDataFrame(texts, "d int, text string"), "q", "d")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_what_is_wrong_with_answer_keys(spark):
    finding = "struct<id: string, title: string, evidence: array<string>, sections: array<string>, cross_section: boolean>"
    key = [("d", [("a", "t", ["one two three four five"], ["Intro"], False), ("a", "t", ["one two"], ["Other"], True), ("b", "t", ["not there at all today"], [], False), ("c", "t", ["one two three four five\nsix"], ["INTRO "], False)], [])]
    answers = spark.createDataFrame(key, f"doc_id string, expected_findings array<{finding}>, must_not_flag array<struct<id: string, title: string>>")
    texts = spark.createDataFrame([("d", "one two three four five\nsix")], "doc_id string, document string")
    headings = spark.createDataFrame([("d", "Intro")], "doc_id string, heading string")
    got = sorted((r["id"], r["problem"]) for r in evaluation.key_problems(answers, texts, headings).collect())
    assert got == [("a", "length"), ("a", "no such section"), ("a", "one quote across sections"), ("a", "repeated id"), ("b", "not verbatim"), ("c", "several lines")]
