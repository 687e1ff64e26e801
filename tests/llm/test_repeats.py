from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quarrylens.llm import repeats, substrings, suffixes

from .fixtures import frame, odd_texts, rows_of


def bytes_by_force(rows, length):
    places = defaultdict(set)
    for d, (_, t) in enumerate(rows):
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            where = places[hash(data[k : k + length])]
            if len(where) < 2:
                where.add((d, k))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if len(places[hash(data[k : k + length])]) > 1:
                gone[k : k + length] = True
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def words_by_force(rows, window):
    order = lambda i: (i is None, i or 0)
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            at = tuple(w[k : k + window])
            first[at] = min(first.get(at, order(i)), order(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, n, alphabet, most):
    rng = random.Random(seed)
    parts = ["".join(rng.choices(alphabet, k=rng.randint(1, most))) for _ in range(8)]
    return [(rng.randint(0, n), "".join(rng.choice(parts) + "".join(rng.choices(alphabet, k=rng.randint(0, 3))) for _ in range(rng.randint(0, 6)))) for _ in range(n)]


@pytest.mark.parametrize("clashing", [False, True])
def test_repeated_bytes_match_brute_force(spark, clashing):
    rows = odd_texts()
    assert rows_of(suffixes.remove_repeats(frame(spark, rows, clashing))) == bytes_by_force(rows, 200)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_bytes_match_brute_force_on_random_texts(spark, seed):
    rows = random_rows(seed, 60, "abé ", 30)
    assert rows_of(suffixes.remove_repeats(frame(spark, rows), length=12, gram=4)) == bytes_by_force(rows, 12)


def test_hot_anchors_are_settled_across_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 64)
    rows = random_rows(9, 80, "ab", 30)
    assert rows_of(suffixes.remove_repeats(frame(spark, rows), length=12, gram=4)) == bytes_by_force(rows, 12)
    rows = [(i, " ".join(t)) for i, t in random_rows(9, 80, "ab", 30)]
    assert rows_of(substrings.remove_repeats(frame(spark, rows), window=9, gram=3)) == words_by_force(rows, 9)


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("parts", [1, 4])
def test_a_row_whose_only_copy_is_itself(spark, broadcast, parts):
    """Rows repeated as a whole are places like others, whichever way the texts are fetched."""
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=900))
    rows = [(71, text), (71, text), (72, text[::-1]), (3, None), *odd_texts(), (8, odd_texts()[7][1])]
    docs = frame(spark, rows).repartition(parts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
    try:
        got, words = rows_of(suffixes.remove_repeats(docs)), rows_of(substrings.remove_repeats(docs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == bytes_by_force(rows, 200) and words == words_by_force(rows, 50)
    assert [r[2] for r in got if r[0] == 71] == [900, 900]


def test_repeated_bytes_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(suffixes.remove_repeats(docs)) == bytes_by_force(rows, 200)


@pytest.mark.parametrize("clashing", [False, True])
def test_repeated_words_match_brute_force(spark, clashing):
    rows = odd_texts()
    assert rows_of(substrings.remove_repeats(frame(spark, rows, clashing))) == words_by_force(rows, 50)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_words_match_brute_force_on_random_texts(spark, seed):
    rows = [(i, " ".join(t)) for i, t in random_rows(seed, 60, "abc", 20)]
    assert rows_of(substrings.remove_repeats(frame(spark, rows), window=9, gram=3)) == words_by_force(rows, 9)


def test_repeated_words_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(substrings.remove_repeats(docs)) == words_by_force(rows, 50)


@pytest.mark.parametrize("data", [b"", b"a", b"banana", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"abcabcabcabdabcabcabcab" * 5])
def test_suffix_arrays_and_common_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    order = suffixes.suffix_array(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    if len(data) > 1:
        shared = suffixes.common_prefixes(text, order, np.array([0]), np.array([len(data)]))
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while n < len(data) - max(a, b) and data[a + n] == data[b + n]:
                n += 1
            assert shared[b] == n


def test_repeats_empty_tables(spark):
    assert suffixes.remove_repeats(frame(spark, [])).collect() == []
    assert substrings.remove_repeats(frame(spark, [])).collect() == []
