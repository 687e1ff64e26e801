"""Repeated-phrase removal: recurring passages are compiled to sharded automata, which find every occurrence.

A window of words goes if the same words also start in a document with a smaller id (null ids come last). Windows
are judged on the input. A null text has no words.

Every document is cut into stretches around anchors (``windows``), and a stretch whose anchor stands in other documents
goes to its anchor's shard; the others hold nothing that recurs. A shard proposes passages by comparing hashes,
compiles them to Aho-Corasick automata over word numbers and streams all its stretches through these. What an automaton
finds, word for word, says where a passage stands and which is the first document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import salted, staged, with_group
from .windows import U, anchors, mix, prefix_hashes, span_hashes, word_bounds, word_hashes

WINDOW, GRAM = 50, 8
#: Words of the passages compiled into one automaton, about.
AUTOMATON_WORDS = 200_000


def _word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = repeats.text_buffers(texts)
    begin, end, bounds = word_bounds(data, offsets)
    return word_hashes(data, begin, end), bounds


def proposed(anchor: np.ndarray, marks: np.ndarray, unit: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Unit, first and last window of passages that several units seem to share.

    Windows with the same anchor and mark are a class. Windows that follow each other in the first unit of their
    classes make one passage where all units that have the one have the other.
    """
    order = np.lexsort((unit, marks, anchor))
    a, m, u = anchor[order], marks[order], unit[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (m[1:] != m[:-1])])
    several = np.diff(np.r_[new, len(order)]) > 1
    who = np.add.reduceat(mix(u.astype(U) + U(1)), new)[several]
    first = order[new[several]]
    at = np.argsort(first)
    first, who = first[at], who[at]
    apart = (first[1:] != first[:-1] + 1) | (unit[first[1:]] != unit[first[:-1]]) | (who[1:] != who[:-1])
    if not len(first):
        return
    begin = np.flatnonzero(np.r_[True, apart])
    for b, e in zip(begin.tolist(), (np.r_[begin[1:], len(first)] - 1).tolist(), strict=True):
        yield int(unit[first[b]]), int(j[first[b]]), int(j[first[e]])


def occurrences(numbers: list[tuple[int, ...]], passages: dict[int, list[tuple[int, ...]]], groups: np.ndarray) -> Iterator[tuple[int, int, int, tuple[int, ...]]]:
    """Unit, begin, end and passage of everything that automata find; ``groups`` are the units' anchors, equal ones together.

    Passages (by their unit) are compiled a few anchors at a time, so that an automaton stays small.
    """
    edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
    held, words, since = None, 0, 0
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for u in range(low, high):
            for passage in passages.get(u, ()):
                held = held or ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                held.add_word(passage, passage)
                words += len(passage)
        if held and (words > AUTOMATON_WORDS or high == len(groups)):
            held.make_automaton()
            for u in range(since, high):
                for last, passage in held.iter(numbers[u]):
                    yield u, last + 1 - len(passage), last + 1, passage
            held, words = None, 0
        since = since if held else high


def found_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Key of a document, and the begin and end (in words) of passages that a document with a smaller id has too."""
    units = staged(repeats.unit_rows(docs, lambda texts: anchors(*_word_symbols(texts), window, gram)))
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    units = repeats.shared_units(units, F.min(order) < F.max(order))
    distinct = repeats.with_parts(repeats.distinct_units(units)).withColumn("owner", F.col("first.id"))

    def cut(texts: pa.Array, places: list) -> pa.Array:
        data, offsets = repeats.text_buffers(texts)
        begin, end, bounds = word_bounds(data, offsets)
        doc, start, count = places
        low = begin[bounds[doc] + start]
        sizes = end[bounds[doc] + start + count + (window - 2)] - low
        ends = np.cumsum(sizes)
        at = np.repeat(low - np.r_[0, ends[:-1]], sizes) + np.arange(ends[-1] if len(ends) else 0)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data[at])])

    owner_kind = docs.schema["id"].dataType.simpleString()
    held = staged(repeats.fetched(docs, staged(distinct), cut, "binary", {"parts": "bigint", "owner": owner_kind}))
    total = held.agg(F.sum(F.length("symbols"))).first()[0] or 0

    def search(table: pa.Table) -> pa.RecordBatch:
        """Passages of each unit with the first document that has them; of a hot anchor's units all windows too, with their marks."""
        table = table.sort_by("anchor").combine_chunks()
        symbols, owners = table["symbols"].combine_chunks(), table["owner"].combine_chunks()
        offsets = np.frombuffer(symbols.buffers()[1], np.int32)[symbols.offset : symbols.offset + len(symbols) + 1].astype(np.int64)
        data = np.frombuffer(symbols.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        begin, end, bounds = word_bounds(data, offsets - offsets[0])
        count, of_unit = table["count"].to_numpy().astype(np.int64), table["anchor"].to_numpy()
        unit = np.repeat(np.arange(len(table)), count)
        j = np.arange(len(unit)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        at = bounds[unit] + j
        marks = span_hashes(prefix_hashes(word_hashes(data, begin, end)), at, at + window)

        known: dict[bytes, int] = {}
        numbers = [tuple([known.setdefault(w, len(known) + 1) for w in s.split()]) for s in symbols.to_pylist()]
        passages: dict[int, list[tuple[int, ...]]] = {}
        for u, b, e in proposed(of_unit[unit], marks, unit, j):
            passages.setdefault(u, []).append(numbers[u][b : e + window])
        several = table["n"].to_numpy() > 1
        for u in np.flatnonzero(several).tolist():  # a stretch that other places repeat as a whole
            passages.setdefault(u, []).append(numbers[u])

        rank = np.empty(len(table), np.int64)
        rank[pa.compute.sort_indices(owners, null_placement="at_end").to_numpy()] = np.arange(len(table))
        hits, first = [], {}
        for u, b, e, passage in occurrences(numbers, passages, of_unit):
            key = (int(of_unit[u]), passage)
            if key not in first or rank[u] < rank[first[key]]:
                first[key] = u
            hits.append((u, b, e, key))
        rows = [(u, b, e, first[key]) for u, b, e, key in hits if several[u] or first[key] != u]
        hot = np.flatnonzero(table["parts"].to_numpy()[unit] > 1)
        columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
        who, own = (np.r_[c, unit[hot]] for c in (columns[0], columns[3]))
        mark = pa.array(np.r_[np.zeros(len(rows), np.int64), marks[hot].view(np.int64)], mask=np.arange(len(who)) < len(rows))
        places = [pa.array(np.r_[c, j[hot] + more], pa.int32()) for c, more in ((columns[1], 0), (columns[2], window))]
        return pa.RecordBatch.from_arrays([table["anchor"].combine_chunks().take(pa.array(who)), table["content"].combine_chunks().take(pa.array(who)), *places, owners.take(pa.array(own)), mark], ["anchor", "content", "begin", "end", "owner", "mark"])

    local = staged(repeats.in_shards(held, total, search, f"anchor bigint, content bigint, begin int, end int, owner {owner_kind}, mark bigint"))
    # shards of one anchor settle windows that they have in common by anchor and mark, 128 bits
    near = F.struct(F.col("owner").isNull().alias("none"), F.col("owner").alias("id"))
    hot = with_group(local.where("mark is not null"), ["anchor", "mark"], salted("content", "begin"), {"_b": F.min(near)}, {"_best": F.min("_b")})
    hot = hot.where(F.col("_best") < near).withColumn("owner", F.col("_best.id"))
    names = ["anchor", "content", "begin", "end", "owner"]
    found = local.where("mark is null").select(*names).unionByName(hot.select(*names))
    # every place of a stretch, whatever the number of its copies: adaptive execution splits a stretch of very many
    at = units.select("anchor", "content", "id", "key", "start").join(found, ["anchor", "content"]).where(near < order)
    return at.select("key", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Every row with its number of words, of words removed, and the digest of those kept (joined by one space).

    Equal ids are not smaller than each other, so nothing goes between them; repeated rows repeat. A text of any length
    is taken whole; one of fewer words than a window keeps them all.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spans = found_passages(rows, window, gram).groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                edges = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    edges[s["begin"]] += 1
                    edges[s["end"]] -= 1
                kept = words if not spans else [w for w, n in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not n]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if keep_text else None))
            n, removed, digest, kept = zip(*out, strict=True) if out else ((),) * 4
            columns, names = [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], [id_col, "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else "")
    return rows.join(staged(spans), "key", "left").select("id", "text", "spans").mapInArrow(run, schema)
