"""Many literals in one pass, and what a pattern needs, against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import multi
from quarrylens.functions import text as T
from quarrylens.operators import sections
from quarrylens.plans.topics import TOPICS, Topic


@pytest.mark.parametrize("words", [["a", "ab", "abc", "b", "bc"], ["is-is", "i", "s-"], ["a.b", "a|b", "(", "\\", "[x]", "é", "日本"], ["one two", "one", "two three"], []])
def test_every_literal_at_every_place(spark, words):
    rng = random.Random(3)
    parts = [*words, "a", "b", "is-", " ", "one ", "x", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    odd = [w for w in words if multi.overlaps_itself(w)]
    counts = [multi.counted(multi.begun(F.col("t"), words), F.col("t"), F.lit(w), odd) for w in words]
    got = df.select("i", F.array_sort(multi.begun(F.col("t"), words)).alias("all"), F.array(F.lit(-1), *counts).alias("n")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        assert r["all"] == sorted(w for k in range(len(t)) for w in words if t.startswith(w, k)), t
        assert r["n"][1:] == [t.count(w) for w in words], t


def test_topics_score_as_keyword_by_keyword(spark):
    rng = random.Random(5)
    topics = (*TOPICS, Topic("own", "Own", "network", ("is-is", "aa", "api", "api key"), ()))
    words = [k for t in topics for k in t.keywords] + ["aaa", "is-is-is", "The", "\n", "nothing"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))), " ".join(rng.choice(words).upper() for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(90, None, None)]
    want = set()
    for i, h, b in rows:
        h, b = (re.sub(r"\s+", " ", x or "").lower() for x in (h, b))
        for k, t in enumerate(topics):
            score = sum(3.0 * (w in h) + min(b.count(w), 4) for w in t.keywords)
            if score:
                want.add((i, k, t.key, t.domain, score))
    got = sections.score_topics(spark.createDataFrame(rows, "doc_id int, h string, b string"), ["doc_id"], "h", "b", topics)
    assert {tuple(r) for r in got.collect()} == want


def test_literals_that_a_pattern_needs():
    assert multi.needed(r"\bsnmp\s*v?[12]c?\b") == ("snmp",)
    assert multi.needed(r"(?:alpha|beta)\s+\w+") == ("alpha", "beta")
    assert multi.needed(r"(?:alpha|b?)x") is None and multi.needed(r"\w+") is None and multi.needed(r"(") is None
    assert multi.needed(r"(?:ab)*cde?") == ("cd",) and multi.needed(r"Ab[cd]+ef") == ("ab",)
    assert T.text is not None


def test_no_rule_matches_a_text_without_its_literals():
    from quarrylens.operators import rules
    from quarrylens.plans.rule_catalogue import RULES

    from test_rules import CASES, GUARDS

    texts = [t for c in CASES for t in c[1:]] + [t for t, _ in GUARDS]
    texts += [t.upper() for t in texts]
    patterns = [p for r in RULES for p in (*r.hard, *r.soft, *([rules.suppressor(r)] if r.suppressors else []))]
    hits = 0
    for p in patterns:
        literals = multi.needed(p)
        for t in texts:
            if re.search(p, t, re.IGNORECASE):
                hits += 1
                assert any(w in t.lower() for w in literals), (p, t)
    assert hits > len(CASES)


def test_a_pattern_is_not_tried_without_its_literal(spark):
    """The search for literals goes before, and takes for a letter whatever the pattern does."""
    texts = ["plain", "MONITORED by a SIEM", "ſiem", "SİEM", "Kerberos", "kerberos", "", "trıal"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    low = multi.folded(F.col("t"))
    for pattern in (r"\b(?:siem|kerberos)\b", r"monitor(?:ing|ed)?", r"trial", r"->|→"):
        hit = F.rlike("t", F.lit(f"(?iu){pattern}"))
        assert rows.where(hit).count() == rows.where(multi.asked(low, pattern, hit, F.lit(False))).count()
    stop = F.raise_error(F.lit("tried")).cast("boolean")
    assert rows.where("i = 0").where(multi.asked(low, r"\bsiem\b", stop, F.lit(False))).count() == 0
