from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import exact, quality

from .fixtures import frame, odd_texts, rows_of

SPACE = r"[\x20\x09-\x0D]"


def exact_by_force(rows):
    norm = lambda t: re.sub(SPACE, "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        less, _, _, keep = min(groups[norm(t)])
        kept = i == keep and -len(t or "") == less
        out.append((i, keep, len(groups[norm(t)]), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_groups_match_brute_force(spark, clashing):
    rows = odd_texts()
    assert rows_of(exact.exact_groups(frame(spark, rows, clashing))) == exact_by_force(rows)


@pytest.mark.parametrize("bits", [1, 6])
def test_chunks_that_share_a_hash_are_told_apart(spark, bits):
    rows = [*odd_texts(), *[(100 + i, f"text {i % 7} " * (300 + i % 3)) for i in range(30)]]
    assert rows_of(exact.exact_groups(frame(spark, rows), bits=bits)) == exact_by_force(rows)


def test_chunks_put_together_are_the_text(spark):
    rows = odd_texts()
    found = frame(spark, rows).select("text", exact.chunks(exact.normalised(F.col("text"))).alias("c")).collect()
    for r in found:
        assert "".join(r["c"]) == re.sub(SPACE, "", r["text"] or "")
        assert all(len(c) <= exact.MOST for c in r["c"])


def test_drop_copies_keeps_one_row_of_each_group(spark):
    rows = odd_texts()
    docs = frame(spark, rows, clashing=True)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    want = {(r[1], r[4]) for r in exact_by_force(rows)}
    got = [(r["doc_id"], hashlib.sha256(re.sub(SPACE, "", r["text"] or "").encode()).hexdigest()) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want


def test_exact_empty_table(spark):
    assert exact.exact_groups(frame(spark, [])).collect() == []
    assert exact.drop_copies(frame(spark, [])).collect() == []


def measures_by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


@pytest.mark.parametrize("clashing", [False, True])
def test_quality_matches_brute_force(spark, clashing):
    rows = [*odd_texts(), (30, "a b\na b\n\n \nc # <\na b")]
    got = rows_of(quality.score_quality(frame(spark, rows, clashing)))
    assert [r[:7] for r in got] == sorted([(i, *measures_by_force(t)) for i, t in rows], key=repr)
    assert not any(r[7] for r in got if r[6])


def test_verdicts_do_not_depend_on_the_order_of_rules(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for t in texts:
        m = quality.Measured(t)
        assert (quality.verdict(m, quality.RULES) is None) == (quality.verdict(m, quality.RULES[::-1]) is None)


def test_cascade_orders_by_rejection_per_cost(spark):
    cheap = quality.Rule("cheap", lambda m: True)
    never = quality.Rule("never", lambda m: False)
    docs = frame(spark, [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(200)])  # long enough to reach the cascade
    assert [r.name for r in quality.cascade(docs, (never, cheap))] == ["cheap", "never"]


def test_rules_are_judged_on_what_reaches_them(spark):
    """A rule that rejects much, but only what a better one has rejected already, comes after one that rejects the rest."""
    prose = " ".join(f"word{i % 37} and{i % 41} then{i % 43}" for i in range(60))
    docs = frame(spark, [(i, f"{prose} {'xy'[i % 10 == 0]}{i}") for i in range(200)] + [(i, "too short") for i in range(200, 400)])
    slow = lambda m: sum(range(3_000)) < 0
    rules = (quality.Rule("again", lambda m: slow(m) or " x" in m.text), quality.Rule("rest", lambda m: slow(m) or slow(m) or " y" in m.text), quality.Rule("most", lambda m: " x" in m.text))
    seconds, found = quality.rule_statistics(docs, rules)
    assert found == {(True, False, True): 180, (False, True, False): 20} and all(v > 0 for v in seconds.values())
    assert [r.name for r in quality.cascade(docs, rules)] == ["most", "rest", "again"]


def test_long_prose_keeps_its_share_of_different_words():
    import random

    rng = random.Random(3)
    m = quality.Measured(" ".join(f"w{int(rng.paretovariate(0.4)) % 60_000}" for _ in range(600_000)))
    few = next(r for r in quality.RULES if r.name == "few_words")
    assert 20 * len(set(m.words)) < 3 * len(m.words) and not few.rejects(m)


def test_verdicts_match_plain_rules(spark, small):
    """``kept`` of the query against the rules written out."""
    import re

    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = []
    for r in docs.collect():
        t, (n, chars, symbols, dup, _, failed) = r["text"] or "", measures_by_force(r["text"])
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        different = sum(len(set(words[i : i + 1000])) for i in range(0, n, 1000))
        bad = failed or symbols > 0.3 * n or t.count("!!") > 0.3 * n or not 2 * n <= chars <= 20 * n or dup > len(lines) / 2 or sum(c.isalpha() for c in t) < chars / 2 or different < 0.05 * n
        want.append((r["doc_id"], not bad))
    assert sorted((r["doc_id"], r["kept"]) for r in quality.score_quality(docs).collect()) == sorted(want)


def test_prose_passes_and_junk_goes(spark):
    prose = " ".join(f"word{i % 37} and{i % 41} then{i % 43}" for i in range(60))
    docs = frame(spark, [(1, prose), (2, "### $$$ " * 100), (3, None), (4, "")], clashing=True)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_quality_empty_table(spark):
    assert quality.score_quality(frame(spark, [])).collect() == []
    assert quality.keep_good(frame(spark, [])).collect() == []
