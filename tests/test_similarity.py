"""Similarity joins and greedy groups against a plain pass, with every limit made small enough to be met."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import similarity

ROWS = "k bigint, kind string, seq bigint, t array<string>"


def plain_groups(rows, threshold, differ=False, least=1):
    heads, out = {}, {}
    places = {}
    for k, kind, seq, t in sorted(rows, key=lambda r: (r[0] or -1, r[2])):
        own, place = set(t), places.get(k, 0)
        places[k] = place + 1
        join = None
        if len(own) >= max(1, least):
            near = lambda o: len(own & o) >= threshold * len(own | o)
            join = next((h for h, o, d in heads.setdefault(k, []) if near(o) and (not differ or d != kind)), None)
            if join is None:
                heads[k].append((place, own, kind))
        out[k, seq] = (place, place if join is None else join)
    return out


def random_rows(seed, n, words, most):
    rng = random.Random(seed)
    base = [[rng.choice(words) for _ in range(rng.randint(0, most))] for _ in range(n // 3)]
    change = lambda t: [w if rng.random() > 0.2 else rng.choice(words) for w in t]
    return [(rng.choice((1, 1, 1, 2, 3)), rng.choice("FT"), i, change(rng.choice(base))) for i in range(n)]


@pytest.mark.parametrize(("hot", "first", "threshold"), [(1_000, 4_096, 0.4), (3, 16, 0.4), (2, 32, 0.15)])
def test_groups_match_a_plain_pass(spark, monkeypatch, hot, first, threshold):
    monkeypatch.setattr(similarity, "HOT", hot)
    monkeypatch.setattr(similarity, "FIRST", first)
    differ = "kind" if hot == 3 else None
    rows = random_rows(hot, 60, "abcdefghij", 7)
    found = similarity.greedy_groups(spark.createDataFrame(rows, ROWS), ["k"], ["seq"], "t", threshold, differ=differ, least=2)
    assert {(r["k"], r["seq"]): (r["place"], r["head"]) for r in found.collect()} == plain_groups(rows, threshold, bool(differ), 2)


@pytest.mark.parametrize(("hot", "threshold"), [(1, 0.15), (3, 0.3), (2, 0.6), (1_000, 0.5)])
def test_pairs_match_all_pairs_whatever_is_frequent(spark, monkeypatch, hot, threshold):
    monkeypatch.setattr(similarity, "HOT", hot)
    rng = random.Random(hot)
    rows = [(i, ["every", *([] if i % 3 else ["third"]), *(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(0, 9)))]) for i in range(50)] + [(90, []), (91, ["every"]), (92, ["every"])]
    least = {}
    for i, t in rows:
        if t:
            least.setdefault(frozenset(t), i)
    sets = sorted((i, s) for s, i in least.items())
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) >= threshold * len(x | y)}
    got = [tuple(r) for r in similarity.similar_pairs(spark.createDataFrame(rows, "i bigint, w array<string>"), "i", "w", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("measure", "sided"), [(similarity.JACCARD, False), (similarity.LARGER, True)])
def test_dense_blocks_are_compared_share_against_share(spark, monkeypatch, measure, sided):
    """Sets of few words meet nearly all: no meeting is written, and what is found is what all pairs give."""
    for name, value in {"FEW": 10, "MANY": 1, "LEAST_SHARE": 16, "PAIRS": 20}.items():
        monkeypatch.setattr(similarity, name, value)
    rng = random.Random(5)
    rows = [(i, sorted({rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 8))}), rng.choice(("x", "y", None)), 1 + i // 50 if sided else 0) for i in range(100)]
    sets = spark.createDataFrame([("k" if i % 50 else "small", *r) for i, r in enumerate(rows)], "_k string, _at bigint, _w array<string>, _d string, _side int")
    written = []
    met = similarity._met
    monkeypatch.setattr(similarity, "_met", lambda ranked, *a: written.append({r["_k"] for r in ranked.select("_k").distinct().collect()}) or met(ranked, *a))
    got = [(r["_k"], r["a"], r["b"]) for r in similarity.similar_edges(sets, 0.4, measure).collect()]
    near = lambda x, y: len({*x} & {*y}) / (len({*x} | {*y}) if measure == similarity.JACCARD else max(len(x), len(y))) >= 0.4
    own = lambda i: "k" if i % 50 else "small"
    want = {(own(a), a, b) for a, x, d, s in rows for b, y, e, t in rows if a < b and own(a) == own(b) and (not sided or (s, t) == (1, 2)) and (d is None or d != e) and near(x, y)}
    assert set(got) == want and len(got) == len(want)
    assert written == [{"small"}]


def test_a_chain_is_decided_link_by_link(spark):
    """Each row is near the one before it alone: every second one is a head."""
    rows = [(1, "F", i, [f"w{i}", f"w{i + 1}", "x"]) for i in range(12)]
    found = similarity.greedy_groups(spark.createDataFrame(rows, ROWS), ["k"], ["seq"], "t", 0.5)
    assert {r["seq"]: r["head"] for r in found.collect()} == {i: i - i % 2 for i in range(12)}


def test_places_of_a_block_come_from_many_tasks(spark):
    rows = [(i % 2, i // 2) for i in range(3_000)]
    random.Random(1).shuffle(rows)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = similarity.numbered(spark.createDataFrame(rows, "k bigint, seq bigint"), ["k"], ["seq"])
        assert all(r["place"] == r["seq"] for r in found.collect())
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_no_rows(spark):
    assert similarity.greedy_groups(spark.createDataFrame([], ROWS), ["k"], ["seq"], "t", 0.4).count() == 0
    only = similarity.greedy_groups(spark.createDataFrame([(1, "F", 1, [])], ROWS), ["k"], ["seq"], "t", 0.4).collect()
    assert [(r["place"], r["head"]) for r in only] == [(0, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_to_one_is_the_greedy_pass(spark, seed):
    from quarrylens.operators import evaluation

    rng = random.Random(seed)
    words = ["alpha", "bravo", "charlie", "delta", "echo1"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    made = lambda n: [(rng.randint(1, 2), rng.choice(("HIGH", "LOW")), i, text(), rng.choice(("s", "st", "str", ""))) for i in range(n)]
    found, wanted = made(40), made(30)
    f = spark.createDataFrame(found, "doc_id bigint, severity string, seq bigint, issue string, section string")
    e = spark.createDataFrame([(d, s, f"E{i:03d}", t, p) for d, s, i, t, p in wanted], "doc_id bigint, severity string, id string, title string, section string")
    used, want = set(), set()
    for d, s, i, t, p in wanted:
        for fd, fs, seq, ft, fp in found:
            a, b = set(ft.split()), set(t.split())
            if (fd, fs) == (d, s) and seq not in used and a and b and len(a & b) / max(len(a), len(b)) >= 0.3 and (p in fp or fp in p):
                used.add(seq)
                want.add((d, s, seq, f"E{i:03d}"))
                break
    got = [tuple(r) for r in evaluation.one_to_one(f, e).collect()]
    assert set(got) == want and len(got) == len(want)


def test_copies_of_findings_make_no_pairs(spark, monkeypatch):
    """A thousand equal findings and as many equal expected ones are two sets, and are paired in order."""
    from quarrylens.operators import evaluation

    met = []
    edges = evaluation.similar_edges
    monkeypatch.setattr(evaluation, "similar_edges", lambda sets, *a: met.append(sets.count()) or edges(sets, *a))
    one = spark.range(1_000).select(F.lit(1).alias("doc_id"), F.lit("HIGH").alias("severity"), "id", F.lit("alpha bravo").alias("t"), F.lit("s").alias("section"))
    f = one.selectExpr("doc_id", "severity", "id * 2 AS seq", "t AS issue", "section")
    e = one.selectExpr("doc_id", "severity", "id", "t AS title", "section").where("id < 900")
    assert {(r["seq"], r["expected"]) for r in evaluation.one_to_one(f, e).collect()} == {(2 * i, i) for i in range(900)}
    assert met == [2]
