"""A quality classifier by compression: how many bytes a text takes with a dictionary of good and one of bad text.

Two zstandard dictionaries are built from labelled pieces of text. A text is compressed piece by piece with both; the
difference of the sizes, as a share of the text's bytes, is small where the good dictionary knows its strings better.
A logistic curve, fitted to labelled texts that the dictionaries measuring them had not seen, makes a score of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

#: Labelled documents of each label that are learned from, at most.
SAMPLE_ROWS = 3_000
#: Each share of them is measured with dictionaries of the others, to fit the curve; the dictionaries that stay are of all.
FOLDS = 3
#: Pieces of one document that build a dictionary, at most, spread over its whole text.
SAMPLE_PIECES = 16
#: Bytes of a piece, of the shortest that builds a dictionary, of a dictionary, and of the pieces of one label that train it.
PIECE, LEAST, DICTIONARY, TRAINED = 1024, 16, 64 << 10, 4 << 20
LEVEL = 3
#: Bytes that every text is taken to have besides its own, of the usual difference of good text: short ones tell little.
PRIOR = 64
#: From this score on a document is predicted good.
THRESHOLD = 0.3


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pieces(data: bytes) -> Iterator[bytes]:
    """Consecutive pieces; of an empty text one empty piece."""
    return (data[i : i + PIECE] for i in range(0, max(1, len(data)), PIECE))


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text, and the curve. Without dictionaries every score is the intercept's."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0
    usual: float = 0.0

    def score(self, difference: int, size: int) -> float:
        at = self.intercept + self.slope * (difference + PRIOR * self.usual) / (size + PRIOR)
        return 1 / (1 + math.exp(-at)) if at >= 0 else math.exp(at) / (1 + math.exp(at))


@dataclass
class Sizes:
    """Compressed sizes with the two dictionaries, prepared once a task."""

    model: Model
    both: list[zstandard.ZstdCompressor] = field(init=False)

    def __post_init__(self):
        self.both = []
        for data in (self.model.good, self.model.bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, text: str | None) -> tuple[int, int]:
        """By how many bytes the whole text is larger with the good dictionary than with the bad one, and its own bytes."""
        data = (text or "").encode()
        good, bad = self.both
        return sum(len(good.compress(p)) - len(bad.compress(p)) for p in pieces(data)), len(data)


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the likeliest logistic curve, with Platt's softened targets, by Newton's steps."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.abs(x).max(initial=0)) or 1.0
    z = np.c_[x / scale, np.ones(len(x))]
    w = np.array([0.0, math.log((n1 + 1) / (n0 + 1))])

    def loss(w: np.ndarray) -> float:
        return float((np.logaddexp(0, z @ w) - target * (z @ w)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        gradient = z.T @ (p - target)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), gradient)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """Text, label (``good``) and fold of at most ``sample_rows`` labelled documents of each label, none of them held out.

    Documents are drawn by a hash of their id; of several labels of one id the lower counts, and of several texts the least.
    """
    known = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    drawn = F.xxhash64("id")
    some = [staged(known.where(c).orderBy(drawn, "id").limit(sample_rows)) for c in (F.col("good") == 1, F.col("good") != 1)]
    chosen = some[0].unionByName(some[1])
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # 2 * sample_rows narrow rows at most
    found = found.groupBy("id").agg(F.min(F.struct("text", "good")).alias("row"))
    return staged(found.select("row.text", (F.col("row.good") == 1).cast("int").alias("good"), F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold")))


def learned(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample. Without pieces of both labels in all folds it knows only how often each came."""
    sample = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_rows=sample_rows)
    counts = dict(sample.groupBy("good").count().collect())
    unknown = Model(intercept=math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    if len(counts) < 2:
        return unknown

    def cut(batch: pa.RecordBatch) -> dict:
        good, fold, found = [], [], []
        for text, label, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            every = [p for p in pieces(text.encode()) if len(p) >= LEAST]
            some = every[:: max(1, -(-len(every) // SAMPLE_PIECES))]
            found, good, fold = found + some, good + [label] * len(some), fold + [part] * len(some)
        return {"good": pa.array(good, pa.int32()), "fold": pa.array(fold, pa.int32()), "piece": pa.array(found, pa.binary())}

    parts = map_batches(sample, cut, "good int, fold int, piece binary").distinct().orderBy(F.xxhash64("piece"), "piece", "fold")
    built = {label: [(f, bytes(p)) for f, p in parts.where(F.col("good") == label).select("fold", "piece").limit(TRAINED // PIECE).collect()] for label in (1, 0)}  # TRAINED bytes at most

    def trained(left_out: int | None) -> Model:
        return Model(*(dictionary([p for f, p in built[label] if f != left_out]) for label in (1, 0)))

    final, others = trained(None), [trained(f) for f in range(FOLDS)]
    if not all(m.good and m.bad for m in [final, *others]):
        return unknown

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [Sizes(m) for m in others]
        for batch in batches:
            rows = [sizes[fold].of(text) for text, _, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            d, n = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(n, pa.int64()), batch.column(1)], ["d", "n", "good"])

    rows = np.array(sample.mapInArrow(measure, "d bigint, n bigint, good int").collect(), np.float64).reshape(-1, 3)  # three numbers a document of the sample
    difference, size, good = rows[np.lexsort(rows.T)].T
    usual = float(np.median(difference[good == 1] / np.maximum(size[good == 1], 1)))
    slope, intercept = logistic((difference + PRIOR * usual) / (size + PRIOR), good)
    return Model(final.good, final.bad, slope, intercept, usual)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Score of every row's whole text, and whether it is held out (never learned from) and predicted good.

    A null text is empty and scores as a text without a difference to the usual good one; repeated rows score alike. A
    null id is not held out, and not learned from. If the labels that may be learned from are all alike, or none, every
    row gets how often the first came, (n1 + 1) / (n1 + n0 + 2).
    """
    model = learned(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_rows=sample_rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model) if model.good and model.bad else None
        for batch in batches:
            score = [model.score(*(sizes.of(t) if sizes else (0, 0))) for t in batch.column(2).to_pylist()]
            predicted = [int(s >= threshold) for s in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(predicted, pa.int32())], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(run, f"{id_col} {kind}, held_out boolean, score double, predicted int")
