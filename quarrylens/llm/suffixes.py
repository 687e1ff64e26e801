"""Suffix-array deduplication: byte strings of a fixed length that start in more than one place are removed.

Shards of stretches around shared anchors get a suffix array each, refined by the doubling of Larsson and Sadakane;
common prefixes follow by Kasai's scan; an anchor that fills several shards has their windows merged by binary
search. Strings are judged on the input and never cross documents. A null text is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import staged
from .windows import BLOCK, U, Anchors, anchors, mix, prefix_hashes, span_hashes

LENGTH, GRAM = 200, 32
#: Windows of hot anchors that one task merges, about.
MERGED = 1 << 20
#: Between stretches: a byte that UTF-8 never has.
BETWEEN = 0xFF


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Groups of equal prefixes are sorted by what follows, twice as deep each time."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    padded = np.zeros(n + 8, np.uint16)
    padded[:n] = data
    padded[:n] += 1  # a suffix's end comes before any byte
    key = np.zeros(n, U)
    for j in range(7):
        key = (key * U(257)) + padded[j : j + n]
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    ordered = key[order]
    leads = np.r_[True, ordered[1:] != ordered[:-1]]
    first = np.flatnonzero(leads)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    depth = 7
    single = leads & np.r_[leads[1:], True]
    slots = np.flatnonzero(~single)  # places in the array that are not settled, in order
    while len(slots):
        items = order[slots]
        group = rank[items]
        follow = rank[np.minimum(items + depth, n)] + 1
        sub = np.argsort(group * np.int64(n + 1) + follow)
        items, group, follow = items[sub], group[sub], follow[sub]
        order[slots] = items
        leads = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        first = np.flatnonzero(leads)
        rank[items] = np.repeat(slots[first], np.diff(np.r_[first, len(slots)]))
        slots = slots[~(leads & np.r_[leads[1:], True])]
        depth *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that suffixes share with the one before them in ``order`` (0 for the first), by Kasai's scan.

    Along a stretch the shared length falls by one at most from place to place, so each starts from the last; all
    stretches (where they begin, and how many places are asked for) are scanned abreast. Other places get 0.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.ndarray((n + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = np.zeros(n, np.int64)
    longest = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[longest], lengths[longest]
    held = np.zeros(len(begins), np.int64)
    for j in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -j, side="left"))  # stretches longer than j
        p = begins[:live] + j
        q = before[p]
        h = np.where(q >= 0, np.maximum(held[:live] - 1, 0), 0)
        open_ = np.flatnonzero(q >= 0)
        a, b = p[open_] + h[open_], q[open_] + h[open_]
        while len(open_):
            differ = words[a] ^ words[b]
            same = np.bitwise_count((differ & (~differ + U(1))) - U(1)).astype(np.int64) >> 3
            same = np.minimum(same, n - np.maximum(a, b))
            h[open_] += same
            more = same == 8
            open_, a, b = open_[more], a[more] + 8, b[more] + 8
        held[:live] = h
        out[p] = h
    return out


def repeated_windows(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """For a shard's units: their bytes' windows (unit, place in it), which are repeated, and which lead their class.

    Windows of a unit of which there are ``often`` more, and those that the suffix array finds twice, are repeated.
    """
    column = table["symbols"].combine_chunks()
    count = table["count"].to_numpy().astype(np.int64)
    sizes = count + (length - 1)
    begins = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    data = np.full(int(sizes.sum()) + len(sizes), BETWEEN, np.uint8)
    inside = np.ones(len(data), bool)
    inside[begins + sizes] = False
    data[inside] = text
    order = suffix_array(data)
    shared = common_prefixes(data, order, begins, count)
    rank = np.empty(len(data) + 1, np.int64)
    rank[order] = np.arange(len(order))
    unit = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(unit)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    at = begins[unit] + j
    follower = np.r_[order, -1][rank[at] + 1]
    with_next = np.where(follower >= 0, shared[np.maximum(follower, 0)], 0) >= length
    leads = shared[at] < length
    return data, at, unit, j, ~leads | with_next | table["often"].to_numpy()[unit], leads


def with_seconds(table: pa.Table) -> pa.Table:
    """Units once each, and ``often`` for those that are ``again`` or of which a second one came that is equal byte for byte."""
    names = list(zip(table["anchor"].to_pylist(), table["content"].to_pylist(), strict=True))
    symbols, first, kept = table["symbols"].to_pylist(), {}, []
    often = {u for u, again in enumerate(table["again"].to_pylist()) if again}
    for u, name in enumerate(names):
        other = first.setdefault(name, u)
        if other != u and symbols[other] == symbols[u]:
            often.add(other)
        else:
            kept.append(u)
    return table.take(pa.array(kept, pa.int64())).append_column("often", pa.array([u in often for u in kept], pa.bool_()))


def _find(texts: pa.Array, length: int, gram: int):
    """Anchors of the texts' bytes; hashes take eight bytes for each, so texts are taken a few at a time."""
    data, offsets = repeats.text_buffers(texts)
    table, found, first = mix(np.arange(1, 257, dtype=U)), [], 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 4 * BLOCK, side="right")) - 1)
        a = anchors(table[data[offsets[first] : offsets[end]]], offsets[first : end + 1] - offsets[first], length, gram)
        found.append((a.doc + first, a.anchor, a.content, a.start, a.count))
        first = end
    return Anchors(*(np.concatenate(c) for c in zip(*found, strict=True)))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Key of a document and the begin and end of its byte ranges that repeated strings cover."""
    units = staged(repeats.unit_rows(docs, lambda texts: _find(texts, length, gram)))
    units = repeats.shared_units(units, F.count(F.lit(1)) > 1)
    distinct = staged(repeats.with_parts(repeats.distinct_units(units)))

    def cut(texts: pa.Array, places: list) -> pa.Array:
        data, offsets = repeats.text_buffers(texts)
        doc, start, count = places
        sizes = count + (length - 1)
        ends = np.cumsum(sizes)
        at = np.repeat(offsets[doc] + start - np.r_[0, ends[:-1]], sizes) + np.arange(ends[-1] if len(ends) else 0)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data[at])])

    # of equal units two come, to be held against each other byte by byte; further ones follow those; where several are
    # at one place of one document, its row is repeated
    two = distinct.withColumn("again", (F.col("n") > 1) & (F.col("place") == F.col("last")))
    two = two.withColumn("place", F.explode(F.array_distinct(F.array("place", "last"))))
    held = staged(repeats.fetched(docs, two, cut, "binary", {"parts": "bigint", "again": "boolean"}))
    total = held.agg(F.sum(F.col("count") + length)).first()[0] or 0

    def compare(table: pa.Table) -> pa.RecordBatch:
        """Runs of repeated windows of each unit; of a hot anchor's, the first of every class of equal windows too."""
        table = with_seconds(table)
        data, at, unit, j, repeated, leads = repeated_windows(table, length)
        hot = table["parts"].to_numpy() > 1
        runs: list[list] = [[] for _ in range(len(table))]
        wins: list[list] = [[] for _ in range(len(table))]
        edge = np.r_[True, unit[1:] != unit[:-1]]
        begin = np.flatnonzero(repeated & (edge | ~np.r_[False, repeated[:-1]]))
        end = np.flatnonzero(repeated & (np.r_[edge[1:], True] | ~np.r_[repeated[1:], False]))
        for u, b, e in zip(unit[begin].tolist(), j[begin].tolist(), j[end].tolist(), strict=True):
            runs[u].append({"begin": b, "end": e + 1})
        if hot.any():
            chosen = np.flatnonzero(leads & hot[unit])
            sums = prefix_hashes(mix(np.arange(1, 257, dtype=U))[data])
            marks = span_hashes(sums, at[chosen], at[chosen] + length).view(np.int64)
            for u, place, m in zip(unit[chosen].tolist(), j[chosen].tolist(), marks.tolist(), strict=True):
                wins[u].append({"j": place, "mark": m})
        kinds = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("j", pa.int32()), ("mark", pa.int64())]))
        return pa.RecordBatch.from_arrays([table["anchor"].combine_chunks(), table["content"].combine_chunks(), pa.array(runs, kinds[0]), pa.array(wins, kinds[1])], ["anchor", "content", "runs", "leaders"])

    schema = "anchor bigint, content bigint, runs array<struct<begin:int,end:int>>, leaders array<struct<j:int,mark:bigint>>"
    local = staged(repeats.in_shards(held, total, compare, schema))
    runs = local.select("anchor", "content", F.explode("runs").alias("run")).select("anchor", "content", "run.begin", "run.end")
    found = runs.unionByName(merged_shards(local))
    at = units.select("anchor", "content", "key", "start").join(found, ["anchor", "content"])
    return at.select("key", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end") + (length - 1)).alias("end"))


def merged_shards(local: DataFrame) -> DataFrame:
    """Windows that shards of one anchor have in common: each shard's sorted run is looked up in all of them together.

    Windows are dealt by anchor and mark, 128 bits that stand for their bytes, to as many tasks as their number asks for.
    """
    total = local.agg(F.sum(F.size("leaders"))).first()[0] or 0
    leaders = local.select("anchor", "content", F.explode("leaders").alias("w")).select("anchor", "content", "w.j", "w.mark")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            marks = mix(table["anchor"].to_numpy().view(U)) ^ table["mark"].to_numpy().view(U)
            run = np.sort(marks)
            there = np.searchsorted(run, marks, side="right") - np.searchsorted(run, marks, side="left")
            both = table.filter(pa.array(there > 1))
            end = pa.array(both["j"].to_numpy() + 1, pa.int32())
            yield pa.RecordBatch.from_arrays([both["anchor"].combine_chunks(), both["content"].combine_chunks(), both["j"].combine_chunks(), end], ["anchor", "content", "begin", "end"])

    return leaders.repartition(int(max(1, -(-total // MERGED))), "anchor", "mark").mapInArrow(merge, "anchor bigint, content bigint, begin int, end int")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Every row with its bytes, bytes removed, maximal removed runs and the digest of what is kept.

    With ``keep_text`` also what is kept, where a cut character becomes U+FFFD. Repeated rows are places like others, so
    what they hold in common goes from all of them. Long texts are taken whole, in overlapping blocks.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, gram).groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = repeats.text_buffers(batch.column(1))
            out = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                edges = np.zeros(len(text) + 1, np.int64)
                for s in spans or ():
                    edges[s["begin"]] += 1
                    edges[s["end"]] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                begins, _ = repeats.runs_of(gone)
                kept = text[~gone].tobytes()
                out.append((len(text), int(gone.sum()), len(begins), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None))
            n, removed, runs, digest, kept = zip(*out, strict=True) if out else ((),) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{id_col} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if keep_text else "")
    return rows.join(staged(spans), "key", "left").select("id", "text", "spans").mapInArrow(run, schema)
