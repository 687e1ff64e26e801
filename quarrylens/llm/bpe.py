"""Byte-level BPE by a priority queue of merge ranks over a linked symbol list, and its inverse.

Null texts encode as empty. Texts of any length work: merging is n log n in the symbols of a word.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: The pre-tokenizer's pattern (a fixed value of byte-level BPE), with white space by its Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of words and their ids kept by each worker; two generations of them at most, in each of two memos.
REMEMBERED = 48 << 20
#: What an entry takes besides, about.
ENTRY = 160


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself if printable Latin-1, else the next from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in kept}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(kept)))
    return [shown[b] for b in range(256)]


class Remembered(dict):
    """A bounded memo: what was used lately stays, the generation before it is looked up once more, then dropped."""

    def __init__(self, make, size: int = REMEMBERED):
        self.make, self.size, self.old, self.held = make, size, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.held += len(key) + len(value) + ENTRY
        if self.held > self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value


class Bpe:
    """Encoder and decoder for a vocabulary file of the tokenizers library with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.byte_ids = [vocab[c] for c in alphabet]
        back = {c: b for b, c in enumerate(alphabet)}
        self.strings = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, k in vocab.items():
            self.strings[k] = bytes(back[c] for c in token)
        self.ids_follow_ranks = all(a < b for a, b in zip(self.merged, self.merged[1:], strict=False)) and max(self.byte_ids) < self.merged[0]
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            self.strings[t["id"]] = t["content"].encode()
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.wide = re.compile(r" \s|[^\S ] ")
        self.by_word = Remembered(self.encode_word)
        self.by_chunk = Remembered(lambda chunk: self.encode_words(" " + chunk))

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge by rank, leftmost first, until no neighbours have a rank."""
        n, ranks, merged = len(symbols), self.ranks, self.merged
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [r << 32 | i for i in range(n - 1) if (r := ranks.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j < 0 or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale: a neighbour has been merged since
            symbols[i], symbols[j] = merged[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h] << 32 | symbols[i])) is not None:
                heappush(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> bytes:
        symbols = [self.byte_ids[b] for b in word.encode()]
        return np.array(self.merge(symbols) if len(symbols) > 1 else symbols, "<u4").tobytes()

    def encode_words(self, text: str) -> bytes:
        return b"".join(map(self.by_word.__getitem__, self.words.findall(text)))

    def encode_plain(self, text: str) -> bytes:
        if self.wide.search(text):
            return self.encode_words(text)
        first, *chunks = text.split(" ")  # a single space always starts a word: what follows it stands alone
        return self.encode_words(first) + b"".join(map(self.by_chunk.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut_special and any(s in text for s in self.special):
            return b"".join(self.special.get(part) or self.encode_plain(part) for part in self.cut_special.split(text))
        return self.encode_plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One codec for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every text encoded and decoded again: counts and digests, with the ids and decoded text if ``keep_ids``.

    Rows: one per input row, repeated rows included; a null text has no ids; a null id stays null.
    """

    def run(batch: pa.RecordBatch) -> dict:
        codec = loaded(vocabulary)
        ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
        texts = [codec.decode(x) for x in ids]
        out = {
            id_col: batch.column(0),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
        }
        if keep_ids:
            out |= {"ids": [np.frombuffer(x, "<u4").astype("i8") for x in ids], "decoded": texts}
        return out

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(id_col, text_col), run, schema + (", ids array<bigint>, decoded string" if keep_ids else ""))
