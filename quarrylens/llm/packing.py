"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORDS, Bpe
from .common import map_batches, staged

#: Pieces packed together: enough for tight bins (the waste is about a bin a group), few enough for one task.
GROUP = 16_384


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each length.

    A bin is filled greedily, largest fit first. Then its smallest document is given back if two unpacked ones fill
    the gap that it leaves more tightly; that repeats while it narrows the gap.
    """
    pool: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        pool.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(pool)
    there = np.zeros(capacity + 1, bool)
    there[sizes] = True
    several = np.zeros(capacity + 1, bool)
    several[[s for s in sizes if len(pool[s]) > 1]] = True
    index = np.arange(capacity + 1)

    def take(size: int) -> int:
        items = pool[size]
        i = items.pop()
        several[size] = len(items) > 1
        if not items:
            there[size] = False
            del pool[size]
            del sizes[bisect_left(sizes, size)]
        return i

    def give(size: int, i: int) -> None:
        if size not in pool:
            pool[size] = []
            insort(sizes, size)
        pool[size].append(i)
        there[size], several[size] = True, len(pool[size]) > 1

    def pair(gap: int) -> tuple[int, int]:
        """The two unpacked sizes that fill a gap best; zeros if there are none."""
        below = np.maximum.accumulate(np.where(there[: gap + 1], index[: gap + 1], 0))
        a = np.flatnonzero(there[: gap + 1])
        b = below[gap - a]
        alone = (b == a) & ~several[a]
        b = np.where(alone, below[np.maximum(a - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        if not len(total) or not total.max():
            return 0, 0
        k = int(total.argmax())
        return int(a[k]), int(b[k])

    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    while sizes:
        gap, held = capacity, []
        while sizes and (k := bisect_right(sizes, gap)):
            size = sizes[k - 1]
            held.append((size, take(size)))
            gap -= size
        while gap and sizes:
            size, i = held[-1]  # the smallest
            a, b = pair(gap + size)
            if a + b <= size:
                break
            held[-1:] = sorted([(a, take(a)), (b, take(b))], reverse=True)
            give(size, i)
            held.sort(reverse=True)
            gap += size - a - b
        at = 0
        for size, i in held:
            bins[i], offsets[i] = n, at
            at += size
        n += 1
    return bins, offsets


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Whole capacities, after a first piece that takes the rest."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


class TextEncoder:
    """Ids of texts as bytes, as the tokenizers library gives them; what stands between single spaces comes from a memo.

    A pre-token never runs over a single space between two other characters, so such a stretch has the same ids in
    any text. Stretches not seen lately are merged by tiktoken over the same vocabulary, where the file's ids follow
    its merge ranks (they do in byte-level files); otherwise by this package's own merging.
    """

    def __init__(self, path: str):
        self.codec = Bpe(path)
        if self.codec.ids_follow_ranks:
            ranks = {s: k for k, s in enumerate(self.codec.strings) if s and s.decode("utf-8", "replace") not in self.codec.special}
            encode = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.codec.encode_words = lambda text: array("I", encode(text)).tobytes()

    def encode(self, text: str) -> bytes:
        return self.codec.encode(text)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces only where they are longer than ``capacity``.

    A null text is empty and so is ``end_id`` alone. ``nth`` numbers the pieces of a batch, so that repeated rows,
    or rows whose ids are null, can be told apart.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        end, codec = np.array([end_id], "<u4").tobytes(), encoder(vocabulary)
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, start = codec.encode(text.as_py() or "") + end, 0
            for k, n in enumerate(piece_lengths(len(data) // 4, capacity)):
                rows.append((doc, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(rows)))
                start += n
        columns = zip(*rows, strict=True)
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [id_col, "piece", "start", "length", "ids_crc32", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint")


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Every document's pieces with their sequence and place in it.

    Pieces are dealt to groups of about ``group`` rows by a hash of all their columns, and each group is packed by
    itself, so that no task sees more. An empty table gives an empty result.
    """
    cut = staged(pieces(docs, vocabulary, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col))
    groups = max(1, -(-cut.count() // group))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_col, "piece", "start", "ids_crc32", "nth"], ignore_index=True)
        bins, offsets = best_two_fit(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(key[0] << 32) + bins, offset=offsets)[[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(*cut.columns), F.lit(groups)))
    schema = f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("_group").applyInPandas(run, schema)
