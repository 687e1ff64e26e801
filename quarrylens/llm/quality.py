"""Quality rules as a short-circuit cascade, ordered by rejection per cost measured on a sample."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Rows on which costs and selectivities are estimated, about. They set the order of the rules, never a verdict.
SAMPLE_ROWS = 1_000
#: Words in a stretch whose different words are counted.
STRETCH = 1_000


class Measured:
    """A text's measures, each taken when first asked for. Words are runs of what is not ASCII white space."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # on exactly space, tab, LF, VT, FF and CR

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three words that the text has twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(windows) == len(set(windows)):
            return 0
        often = {k for k, n in Counter(windows).items() if n > 1}
        covered, upto = 0, 0
        for i, window in enumerate(windows):
            if window in often:
                covered += i + 3 - max(i, upto)
                upto = i + 3
        return covered

    @cached_property
    def n_different(self) -> int:
        """Different words of each stretch of ``STRETCH`` words, summed: a share that does not fall as texts grow."""
        return sum(len(set(self.words[i : i + STRETCH])) for i in range(0, len(self.words), STRETCH))

    @cached_property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < 50 or 100 * self.n_repeat_words > 50 * n


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


#: What ordinary prose never comes near: each limit is several times what clean texts show.
RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * len(m.words)),
    Rule("shouting", lambda m: 10 * m.text.count("!!") > 3 * len(m.words)),
    Rule("word_length", lambda m: not 2 * len(m.words) <= m.word_chars <= 20 * len(m.words)),
    Rule("duplicate_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("letters", lambda m: 2 * sum(map(str.isalpha, m.text)) < m.word_chars),
    Rule("few_words", lambda m: 20 * m.n_different < len(m.words)),
)


def rule_statistics(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], dict[tuple[bool, ...], int]]:
    """Seconds that each rule takes, and how many texts each combination of rejections befalls, on the sample.

    The sample is of rows, by a hash of all their columns, and only those that reach the cascade count. What the base
    rule has measured of them costs the rules nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds = dict.fromkeys((r.name for r in rules), 0.0)
        found: Counter = Counter()
        for batch in batches:
            reached = [m for m in map(Measured, batch.column(0).to_pylist()) if not m.base_failed]
            rejected = []
            for rule in rules:
                began = time.perf_counter()
                rejected.append([rule.rejects(m) for m in reached])
                seconds[rule.name] += time.perf_counter() - began
            found.update(zip(*rejected, strict=True))
        yield pa.RecordBatch.from_pydict({"seconds": [list(seconds.values())] * len(found), "rejected": list(map(list, found)), "n": list(found.values()), "first": [i == 0 for i in range(len(found))]}, pa.schema([("seconds", pa.list_(pa.float64())), ("rejected", pa.list_(pa.bool_())), ("n", pa.int64()), ("first", pa.bool_())]))

    share = min(1.0, sample_rows / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < int(share * (1 << 30))).select(text_col)
    parts = some.mapInArrow(run, "seconds array<double>, rejected array<boolean>, n bigint, first boolean")
    times = [F.sum(F.when(F.col("first"), F.col("seconds")[i]).otherwise(0.0)) for i in range(len(rules))]
    rows = parts.groupBy("rejected").agg(F.sum("n"), *times).collect()  # a row a combination of verdicts
    return {r.name: sum(row[2 + i] for row in rows) for i, r in enumerate(rules)}, {tuple(row[0]): row[1] for row in rows}


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejection per cost, best first, each judged on the texts that those before it let pass.

    Rules of equal worth, and all without a sample, stay as they are.
    """
    seconds, found = rule_statistics(docs, rules, text_col=text_col, sample_rows=sample_rows)
    left, order = list(range(len(rules))), []
    while left:
        worth = lambda i: sum(n for r, n in found.items() if r[i]) / max(seconds[rules[i].name], 1e-9)
        best = max(left, key=lambda i: (worth(i), -i))
        order.append(rules[best])
        left.remove(best)
        found = {r: n for r, n in found.items() if not r[best]}
    return tuple(order)


def verdict(m: Measured, ordered: tuple[Rule, ...]) -> str | None:
    """The first rule that rejects; the rest are not evaluated."""
    if m.base_failed:
        return "base"
    return next((r.name for r in ordered if r.rejects(m)), None)


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every row. A null text has no words and so fails the base rule; repeated rows repeat.

    Texts of any length are measured whole. The order of the rules changes no verdict, only what it costs.
    """
    ordered = cascade(docs, rules, text_col=text_col)

    def run(batch: pa.RecordBatch) -> dict:
        found = [Measured(t) for t in batch.column(1).to_pylist()]
        by = [verdict(m, ordered) for m in found]
        long = lambda f: pa.array([f(m) for m in found], pa.int64())
        return {
            id_col: batch.column(0),
            "n_words": long(lambda m: len(m.words)),
            "word_chars": long(lambda m: m.word_chars),
            "n_symbols": long(lambda m: m.n_symbols),
            "n_dup_lines": long(lambda m: m.n_dup_lines),
            "n_repeat_words": long(lambda m: m.n_repeat_words),
            "base_failed": pa.array([m.base_failed for m in found], pa.bool_()),
            "kept": pa.array([b is None for b in by], pa.bool_()),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, {longs}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their columns as they are. Null, empty and short texts fail; repeated rows all pass or fail."""
    ordered = cascade(docs, rules, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.filter(pa.array([verdict(Measured(t), ordered) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
