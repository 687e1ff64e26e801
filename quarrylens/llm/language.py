"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece. A word's probability is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words. Probabilities are fitted by expectation
maximisation on a sample of labelled texts that is bounded for each language and leaves none out. Words are runs of
letters in lower case.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Runs of letters, and of what counts as word characters besides decimals: numerals such as a superscript two are no letters.
WORDS = re.compile(r"[^\W\d_]+")
LETTERS = re.compile(r"[^\W\d_" + "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()) + "]+")
START = "▁"
#: Labelled texts to learn from, about; those of a rare language, about (all where it has fewer); rounds of fitting.
SAMPLE_ROWS, LANGUAGE_ROWS, ROUNDS = 2_000, 200, 2
#: The probability of a character that no piece has, in any language, and pieces' added counts.
UNSEEN, ADDED = 1e-7, 0.05
#: Scores of words kept by a worker.
REMEMBERED = 400_000
#: Letters of the words that are held in one lattice.
LATTICE = 200_000


def pieces_of(model_file: str) -> list[str]:
    """The vocabulary's pieces of letters, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p.removeprefix(START) and LETTERS.fullmatch(p.removeprefix(START)))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. The long list of numerals is gone through only where a run has one."""
    words = WORDS.findall(text.lower())
    return words if all(map(str.isalpha, words)) else [x for w in words for x in ([w] if w.isalpha() else LETTERS.findall(w))]


def longest(index: dict[str, int]) -> int:
    return max(map(len, index), default=1)


def endings(index: dict[str, int]) -> dict[str, int]:
    """Every ending of a piece: the piece's number, or -1 if it is none itself. What is not here ends no piece."""
    return {p[i:]: -1 for p in index for i in range(1, len(p))} | index


class Lattice:
    """Words of one length: which piece, if any, ends at each place with each length (-1: none; -2: unseen character)."""

    def __init__(self, words: list[str], ends: dict[str, int], most: int):
        self.n = len(words[0]) + 1
        self.ids = np.full((len(words), self.n + 1, most + 1), -1, np.int32)
        cells, found, of_word, of_end = [], [], (self.n + 1) * (most + 1), most + 1
        for w, word in enumerate(words):
            marked = START + word
            for end in range(1, self.n + 1):
                cell = w * of_word + end * of_end
                for begin in range(end - 1, -1, -1):  # longer and longer, while a piece may still end like this
                    k = ends.get(marked[begin:end])
                    if k is None:
                        break
                    if k >= 0:
                        cells.append(cell + end - begin)
                        found.append(k)
        flat = self.ids.reshape(-1)
        flat[cells] = found
        unseen = self.ids[:, 1:, 1]
        unseen[unseen < 0] = -2
        #: The lengths, at each place, that any word has a piece of.
        self.lengths = [np.flatnonzero(there).tolist() for there in (self.ids != -1).any(axis=0)]

    def chances(self, table: np.ndarray, end: int, length: int) -> np.ndarray:
        """table: pieces by languages, with two last rows for unseen characters and for no piece."""
        return table[self.ids[:, end, length]]

    def total(self, table: np.ndarray, end: int, last: list[np.ndarray]) -> np.ndarray:
        """The sums over the pieces that end here, of which words with a piece of a length take part."""
        out = np.zeros_like(last[-1])
        for length in self.lengths[end]:
            ids = self.ids[:, end, length]
            rows = np.flatnonzero(ids != -1)
            if 2 * len(rows) > len(ids):
                out += last[-length] * table[ids]
            else:
                out[rows] += last[-length][rows] * table[ids[rows]]
        return out


def in_batches(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, as many as make a lattice of a bounded size (one at least)."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, rows in by_length.items():
        many = max(1, LATTICE // n)
        for at in range(0, len(rows), many):
            yield rows[at : at + many]


def word_scores(words: list[str], ends: dict[str, int], table: np.ndarray) -> np.ndarray:
    """The log probability of each word in each language, over all segmentations. ``ends`` are the pieces' ``endings``."""
    out, most = np.empty((len(words), table.shape[1])), longest(ends)
    for some in in_batches(words):
        lattice = Lattice([words[i] for i in some], ends, most)
        last = [np.ones((len(some), table.shape[1]))]  # forward sums of the last places, scaled together
        scale = np.zeros((len(some), 1))
        for end in range(1, lattice.n + 1):
            total = lattice.total(table, end, last)
            top = total.max(axis=1, keepdims=True)
            scale += np.log(top)
            last = [x / top for x in [*last[max(0, len(last) - most + 1) :], total]]
        out[some] = np.log(np.maximum(last[-1], 1e-300)) + scale
    return out


def with_unseen(chances: np.ndarray) -> np.ndarray:
    """Rows for unseen characters (-2) and for no piece (-1) after the pieces'."""
    return np.vstack([chances, np.full((1, chances.shape[1]), UNSEEN), np.zeros((1, chances.shape[1]))])


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of every piece in each, from word counts by language."""
    ends, languages = endings({p: i for i, p in enumerate(pieces)}), sorted(counts)
    table, most = np.zeros((len(pieces), len(languages))), longest(ends)
    for k, lang in enumerate(languages):
        words = list(counts[lang])
        lattices = [(Lattice([words[i] for i in some], ends, most), np.array([counts[lang][words[i]] for i in some], float)) for some in in_batches(words)]
        p = np.full(len(pieces), ADDED)
        for lattice, weight in lattices:  # at first every piece that occurs counts
            for end in range(1, lattice.n + 1):
                for length in lattice.lengths[end]:
                    ids = lattice.ids[:, end, length]
                    p += np.bincount(ids[ids >= 0], weight[ids >= 0], len(pieces))
        for _ in range(rounds):
            with np.errstate(divide="ignore"):
                logs = np.log(with_unseen((p / p.sum())[:, None]))  # long words' products have no place in a float
            p = np.full(len(pieces), ADDED)
            for lattice, weight in lattices:
                ahead = [np.zeros(len(weight))]
                for end in range(1, lattice.n + 1):
                    ahead.append(np.logaddexp.reduce([ahead[end - n] + lattice.chances(logs, end, n)[:, 0] for n in lattice.lengths[end]]))
                back = [np.full(len(weight), -np.inf) for _ in range(lattice.n)] + [np.zeros(len(weight))]
                for end in range(lattice.n, 0, -1):
                    for n in lattice.lengths[end]:
                        step = lattice.chances(logs, end, n)[:, 0] + back[end]
                        back[end - n] = np.logaddexp(back[end - n], step)
                        ids = lattice.ids[:, end, n]
                        there = ids >= 0
                        np.add.at(p, ids[there], (weight * np.exp(ahead[end - n] + step - ahead[-1]))[there])
        table[:, k] = p / p.sum()
    return languages, table


def held_out(id_col: str) -> Column:
    """The fifth of the rows that is never learned from; a null id is not in it (nor learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, pieces: list[str], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Fit on about ``sample_rows`` labelled rows that are not held out, chosen by a hash of their ids, and more of
    languages that would have less than about ``LANGUAGE_ROWS`` of them: all their rows, if there are fewer."""
    labelled = docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).agg(F.count(F.lit(1))).collect()}  # one row a language
    if not sizes:
        return fit({}, pieces)
    shares = {lang: min(1, max(sample_rows / sum(sizes.values()), LANGUAGE_ROWS / n)) for lang, n in sizes.items()}
    bars = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, math.ceil(share * (1 << 20)))])
    some = labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < bars[F.col(lang_col)]).select(text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in words_of(text))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in some.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n")).toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    return fit(counts, pieces)


class Scorer:
    """Scores of words, kept in one growing table by worker."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.ends, self.table = endings({p: i for i, p in enumerate(pieces)}), with_unseen(table)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, self.table.shape[1]))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of texts by language, and their numbers of words."""
        words = [words_of(t) if t else [] for t in texts]
        if len(self.rows) > REMEMBERED:
            self.forget()
        new = list({w for ws in words for w in ws}.difference(self.rows))
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.scores = np.vstack([self.scores, word_scores(new, self.ends, self.table)])
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, ws in enumerate(words):
            if ws:
                out[i] = self.scores[list(map(self.rows.__getitem__, ws))].sum(axis=0)
        return out, np.array([len(ws) for ws in words])


_SCORERS: dict[int, Scorer] = {}


def identify(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Predicted language and its posterior (equal priors) of every row. A text without a letter, or null, is ``und``
    with the score 0, and so is every text if there is nothing to learn from.
    """
    pieces = pieces_of(model_file)
    languages, table = learned(docs, pieces, id_col=id_col, text_col=text_col, lang_col=lang_col, sample_rows=sample_rows)
    model = docs.sparkSession.sparkContext.broadcast((pieces, languages, table))  # pieces times languages, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        pieces, languages, table = model.value
        if id(model.value) not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[id(model.value)] = Scorer(pieces, table)
        scorer = _SCORERS[id(model.value)]
        best, score = [], []
        for at in range(0, batch.num_rows, 500):
            texts = batch.column(1).slice(at, 500).to_pylist()
            if not languages:
                best += ["und"] * len(texts)
                score += [0.0] * len(texts)
                continue
            logs, n = scorer.texts(texts)
            chance = np.exp(logs - logs.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            best += [languages[k] if m else "und" for k, m in zip(chance.argmax(axis=1).tolist(), n.tolist(), strict=True)]
            score += np.where(n > 0, chance.max(axis=1), 0.0).tolist()
        return {id_col: batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())}

    rows = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    return map_batches(rows, run, f"{id_col} {kind}, held_out boolean, lang_pred string, score double")
