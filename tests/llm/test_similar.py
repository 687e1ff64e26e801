from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import graphs, minhash

from .fixtures import frame, odd_texts, rows_of


def grams(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, min(len(w), 1))))


def similar_by_force(rows, threshold=0.8):
    """copy_of, n_copies, n_links and class_id of each row."""
    order = lambda i: (i is None, i or 0)
    sets = [grams(t) for _, t in rows]
    distinct = list(dict.fromkeys(sets))
    linked = {s: [o for o in distinct if o != s and s and o and len(s & o) >= threshold * len(s | o)] for s in distinct}
    ids = {s: min((i for (i, _), o in zip(rows, sets, strict=True) if o == s), key=order) for s in distinct}
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        reached, todo = {s}, [s]
        while todo:
            for o in linked[todo.pop()]:
                if o not in reached:
                    reached.add(o)
                    todo.append(o)
        out.append((i, ids[s], sum(o == s for o in sets), len(linked[s]), min((ids[o] for o in reached), key=order)))
    return sorted(out, key=repr)


def near_rows(seed, n):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghijklmnop") * 2 + str(rng.randint(0, 99)) for _ in range(rng.randint(4, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 30)}"
        rows.append((i * 7 % n, " ".join(w)))
    return rows


@pytest.mark.parametrize("clashing", [False, True])
def test_groups_match_brute_force(spark, clashing):
    rows = odd_texts()
    assert rows_of(minhash.similar_groups(frame(spark, rows, clashing))) == similar_by_force(rows)


@pytest.mark.parametrize("block", [minhash.BLOCK, 4])
def test_groups_of_near_copies_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows(block, 150)
    assert rows_of(minhash.similar_groups(frame(spark, rows))) == similar_by_force(rows)


def test_groups_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(minhash.similar_groups(docs)) == similar_by_force(rows)


def test_one_document_of_each_class_stays(spark):
    rows = odd_texts()
    docs = frame(spark, rows, clashing=True)
    kept = minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    classes = {r[4] for r in similar_by_force(rows) if r[4] is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert {i for i in got if i is not None} == classes and len(got) == len({(r[4], r[1]) for r in similar_by_force(rows) if r[1] == r[4]})


def test_the_shortest_prefix_meets_the_recall():
    depth = minhash.shortest_prefix()
    assert minhash.chance(0.8, depth, minhash.TREES) >= minhash.RECALL
    assert depth == 6 or minhash.chance(0.8, depth + 1, minhash.TREES) < minhash.RECALL


def levels(monkeypatch, spark, rows, threshold=0.8):
    """The result, and how many lengths of prefixes it took."""
    seen, plain = [], minhash.gathered
    monkeypatch.setattr(minhash, "gathered", lambda tries, longer: seen.append(longer) or plain(tries, longer))
    return rows_of(minhash.similar_groups(frame(spark, rows), threshold=threshold)), seen


def test_prefixes_are_shortened_only_while_links_are_missed(spark, monkeypatch):
    words = [f"w{k}" for k in range(3_000)]
    alike = [(i, " ".join([*words[:1_500], f"new{i}", *words[1_501:]])) for i in range(6)]
    found, seen = levels(monkeypatch, spark, alike)
    assert found == similar_by_force(alike) and seen == [6]
    apart = near_rows(3, 60)
    found, seen = levels(monkeypatch, spark, apart)
    assert found == similar_by_force(apart) and seen == list(minhash.LONGER)


def test_a_signature_holds_the_least_values_of_its_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 5, 300, 40_000)]
    bounds = np.cumsum([0, *map(len, sets)])
    heads, tails = minhash.signatures(np.concatenate(sets), bounds, 3, 2)
    factors = minhash.mix(np.arange(1, 3 * 8 + 1, dtype=np.uint64)) | np.uint64(1)
    for i, s in enumerate(sets):
        for t in range(3):
            values = [int(minhash.mix((s * factors[t * 8 + k]).min()[None])[0]) & 0xFF for k in range(8)]
            assert int(heads[i, t]) == t << 16 | values[0] << 8 | values[1]
            assert int(tails[i, t]) == int.from_bytes(bytes(values[2:]), "big")


def test_sets_too_small_for_a_partner_have_no_signature(spark):
    rows = [(10 * n + more, " ".join(f"{n}w{k}" for k in range(n + 4 + more))) for n in range(1, 8) for more in range(3)]
    assert rows_of(minhash.similar_groups(frame(spark, rows))) == similar_by_force(rows)


def test_stars_of_shared_leaders_have_the_same_components(spark):
    rng = random.Random(2)
    links = sorted({(rng.randint(50, 300), rng.randint(0, 49)) for _ in range(700)})
    edges = spark.createDataFrame(links, "a bigint, b bigint")
    few = graphs.nearest_stars(edges)
    assert rows_of(graphs.connected_components(few)) == rows_of(graphs.connected_components(edges))


def test_components_match_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = graphs.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert dict(map(tuple, found.collect())) == label


def test_similar_empty_tables(spark):
    assert minhash.similar_groups(frame(spark, [])).collect() == []
    assert minhash.drop_near_copies(frame(spark, [])).where(F.lit(True)).collect() == []


@pytest.mark.parametrize("bits", [minhash.MAP_BITS, 1 << 16])
def test_the_map_of_keys_loses_none(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "MAP_BITS", bits)
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("text"))
    wanted = rows.where("cast(text as int) % 40 = 0").select("key")
    passed = {r.key for r in minhash.likely_in(rows, wanted).collect()}
    assert {r.key for r in wanted.collect()} <= passed
    assert len(passed) < 1_500
