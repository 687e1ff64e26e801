from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylens.llm import bpe, packing
from quarrylens.llm.vocabularies import vocabulary

from .fixtures import frame, odd_texts, rows_of

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \t\n's<|endoftext|>é9"))))
def test_ids_and_texts_are_the_librarys(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_ids_and_texts_are_the_librarys, "t") else test_ids_and_texts_are_the_librarys.t
    test_ids_and_texts_are_the_librarys.t = library
    want = library.encode(text, add_special_tokens=False).ids
    codec = bpe.loaded(PATH)
    data = codec.encode(text)
    assert np.frombuffer(data, "<u4").tolist() == want
    assert codec.decode(data) == library.decode(want, skip_special_tokens=False)
    assert packing.encoder(PATH).encode(text) == data


@pytest.mark.parametrize("clashing", [False, True])
def test_round_trip_matches_the_library(spark, library, clashing):
    rows, want = odd_texts(), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(bpe.encode_decode(frame(spark, rows, clashing), PATH)) == sorted(want, key=repr)


def test_the_ids_themselves_come_with_keep_ids(spark):
    r = bpe.encode_decode(frame(spark, [(1, "some words")]), PATH, keep_ids=True).first()
    assert len(r["ids"]) == r["n_tokens"] and r["decoded"] == "some words"


def check_packing(rows, found, library, capacity):
    """Every document's ids in order, pieces cut only where they must be, sequences full without gaps or overlaps."""
    want = sorted(library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows)
    by_start = {}
    for r in found:
        by_start.setdefault((r["sequence_id"]), []).append(r)
    for held in by_start.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    pieces = sum(max(1, -(-len(ids) // capacity)) for ids in want)
    assert len(found) == pieces
    assert sum(r["length"] for r in found) == sum(map(len, want))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    expected = []
    for i, t in rows:
        ids, start = library.encode(t or "", add_special_tokens=False).ids + [0], 0
        for k, n in enumerate(packing.piece_lengths(len(ids), capacity)):
            expected.append((i, k, start, n, crc(ids[start : start + n])))
            start += n
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(("clashing", "capacity", "group"), [(False, 2048, packing.GROUP), (True, 64, 7)])
def test_packing_is_whole(spark, library, clashing, capacity, group):
    rows = odd_texts()
    found = packing.pack(frame(spark, rows, clashing), PATH, capacity=capacity, group=group).collect()
    check_packing(rows, found, library, capacity)


def test_packing_of_documents(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = packing.pack(docs, PATH).collect()
    check_packing(rows, found, library, 2048)
    least = -(-sum(r["length"] for r in found) // 2048)
    assert len({r["sequence_id"] for r in found}) <= 1.02 * least + 1


def test_best_two_fit_against_first_fit_decreasing():
    rng = random.Random(5)
    for _ in range(50):
        capacity = rng.choice((10, 50, 200))
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 120))])
        bins, offsets = packing.best_two_fit(lengths, capacity)
        room: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            k = next((k for k, r in enumerate(room) if r >= n), None)
            if k is None:
                room.append(capacity - n)
            else:
                room[k] -= n
        assert bins.max() + 1 <= len(room) + 1
        for b in range(bins.max() + 1):
            inside = np.flatnonzero(bins == b)
            inside = inside[np.argsort(offsets[inside])]
            assert (offsets[inside] == np.r_[0, np.cumsum(lengths[inside])[:-1]]).all()
            assert lengths[inside].sum() <= capacity


def test_a_smallest_document_gives_way_to_two_that_fit_tighter():
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert len({bins[0], bins[2], bins[3]}) == 1


def test_tokens_empty_tables(spark):
    assert bpe.encode_decode(frame(spark, []), PATH).collect() == []
    assert packing.pack(frame(spark, []), PATH).collect() == []
