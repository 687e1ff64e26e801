"""What filters do to each other: joint failures of every set of filters, and by inversion what each order of them removes.

Only the joint-failure counts are aggregated over documents, as products of their 0/1 flags, one for each set of
filters. Survivors of a set are the signed sum over its subsets (Möbius inversion); failures of one filter alone are
the signed sum over the sets that hold it; the same counts are the Harsanyi dividends of the game "documents that a
coalition of filters removes", so Shapley values are their sums by the size of the set.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted, with_group

FILTERS = "ABCDE"
SPACES, SYMBOLS, CAPITALS = r"[\x20\x09-\x0D]+", "[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5


def text_flags(text: Column) -> dict[str, Column]:
    """Few words, few distinct words, many capitals, any of the symbols."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": F.rlike(text, F.lit(SYMBOLS)),
    }


def flagged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Documents by part, failures, good and toxic: one row for equal ones, with their number ``n``.

    Repeated rows are counted first; a text fails E by the least id of its copies, each of which meets it by a share of
    its group. Rows without an id have no label, and as copies come after all that have one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = [c.cast("int").alias(k) for k, c in text_flags(F.col("text")).items()]
    rows = read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *flags)
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    rows = with_group(rows, ["digest"], salted("id", "part"), {"_least": F.min("id")}, {"least": F.min("_least")})
    later = F.coalesce(F.col("id") > F.col("least"), F.col("least").isNotNull()).cast("int")
    rows = rows.select("id", "part", *"ABCD", later.alias("E"), "n")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(marks, "id", "left").select("part", *FILTERS, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")


def joint_failures(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, of all, good and toxic documents: how many fail all filters of a set, at the set's number.

    Bit i of a set's number is ``filters[i]``. Flags are 0 or 1; a part's rows are summed where they are, then by part.
    """
    def product(mask: int) -> Column:
        out = F.col("n")
        for i, name in enumerate(filters):
            out = out * F.col(name) if mask >> i & 1 else out
        return out

    sets = range(1 << len(filters))
    by_label = rows.groupBy("part", "good", "toxic").agg(*[F.sum(product(s)).alias(f"_{s}") for s in sets])
    kinds = {"all": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    sums = [F.array(*[F.sum(F.when(c, F.col(f"_{s}")).otherwise(0)) for s in sets]).alias(k) for k, c in kinds.items()]
    return by_label.groupBy("part").agg(*sums)


def _signed(x: Column, s: Column) -> Column:
    """Joint failures of a set, negative where the set is of an odd number of filters."""
    return F.when(F.bit_count(s) % 2 == 1, -x).otherwise(x)


def with_survivors(joint: DataFrame, kinds: list[str], filters: str = FILTERS) -> DataFrame:
    """In place of joint failures, documents that fail none of a set: signed sums over subsets, one filter at a time."""
    out = joint.withColumns({k: F.transform(k, _signed) for k in kinds})
    for bit in (1 << i for i in range(len(filters))):
        own = lambda k, bit=bit: F.transform(k, lambda x, s: x + F.when(s.bitwiseAND(bit) > 0, F.get(k, s - bit)).otherwise(0))
        out = out.withColumns({k: own(k) for k in kinds})
    return out


def dividends(joint: str, weights: list[int], filters: str = FILTERS) -> Column:
    """For every filter, the signed joint failures of the sets that hold it, each times the weight of the set's size."""
    weight = F.array(*map(F.lit, weights))

    def of(bit: int) -> Column:
        each = F.transform(joint, lambda x, s: F.when(s.bitwiseAND(bit) > 0, -_signed(x, s) * F.get(weight, F.bit_count(s))).otherwise(0))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda total, x: total + x)

    return F.array(*[of(1 << i) for i in range(len(filters))])


def interactions(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters step by step, for each part, from ``rows`` with a column of 0 or 1 for each filter.

    ``rows`` has part, good, toxic (0 or 1) and n. Counts are of documents; ``shapley`` is the sum over all orders.
    Without rows there are no parts.
    """
    orders, kinds = math.factorial(len(filters)), ["all", "good", "toxic"]
    sizes = range(1, len(filters) + 1)
    inverted = joint_failures(rows, filters).withColumns({
        "fails": F.array(*[F.col("all")[1 << i] for i in range(len(filters))]),
        "alone": dividends("all", [0, *[1] * len(filters)], filters),
        "shapley": dividends("all", [0, *[orders // k for k in sizes]], filters),
    })
    inverted = with_survivors(inverted, kinds, filters)
    every = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    steps = inverted.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    earlier, place = F.substring("filter_order", F.lit(1), F.col("step") - 1), F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    before = sum((F.when(F.contains(earlier, F.lit(name)), 1 << i).otherwise(0) for i, name in enumerate(filters)), F.lit(0))
    steps = steps.withColumn("_before", before).withColumn("_place", place).withColumn("_after", F.col("_before") + F.get(F.array(*[F.lit(1 << i) for i in range(len(filters))]), F.col("_place")))
    lost = lambda k: F.get(k, F.col("_before")) - F.get(k, F.col("_after"))
    return steps.select(
        "part", "filter_order", "step",
        F.get("all", F.col("_after")).alias("kept"),
        lost("all").alias("removed"),
        (F.get("fails", F.col("_place")) - lost("all")).alias("redundant"),
        F.get("alone", F.col("_place")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("_place")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five text filters over whole texts, by part, every order and step.

    A null text is empty, a null part the empty string, a document with several labels good or toxic if one says so.
    Repeated rows count each; they are copies of one document, so E does not fail for them. Rows without an id come
    after all others as copies, have no label, and of such alone none fails E. An empty table has no parts.
    """
    return interactions(flagged(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
