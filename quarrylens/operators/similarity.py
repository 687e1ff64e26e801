"""Similar token sets and greedy groups of them, as joins and aggregates over whole tables.

Sets meet on the tokens that they begin with when tokens are ordered from rare to frequent, and count how often they
meet: only pairs that can still share enough are compared. A token too frequent to join on is followed by the next one, so that sets meet on two, three and more tokens in common; only sets that these
alone make similar are joined on it. Greedy groups are the first maximal independent set in order, found in rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..staging import scratch, staged

#: Sets that meet on one key, at most, unless the key alone makes them similar: above, their pairs cost more than longer keys.
HOT = 4_096
#: A block of more sets than ``FEW`` that would meet more than ``MANY`` times a set is compared share against share.
FEW, MANY = 256, 64
#: Sets and tokens of a share at most (about), shares that such a block is dealt to if that leaves them ``LEAST_SHARE`` sets, pairs that wait in a task.
SHARE, SHARE_TOKENS, SHARES, LEAST_SHARE, PAIRS, MOST_TASKS = 65_536, 1 << 22, 16, 4_096, 1 << 20, 2_000
#: Places of a block that the first step of the greedy pass looks at; each further step looks twice as far.
FIRST = 32_768


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Rows with their place from 0 in a block, in order; rows of one block are sorted in as many tasks as they fill.

    Each task counts what it has of a block; a block's tasks (not its rows) are then summed in order.
    """
    block = F.struct(*keys) if keys else F.lit(0)
    # the last column keeps equal rows together and apart from others, so that a place does not depend on the dealing
    dealt = rows.withColumn("_b", block).withColumn("_tie", F.xxhash64(*rows.columns))
    by = ["_b", *order, "_tie"]
    at = staged(dealt.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_task", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    tasks = at.groupBy("_b", "_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_b").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    starts = tasks.select("_b", "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return at.join(starts, ["_b", "_task"]).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias(name))


def _least_shared(threshold: float, size: Column) -> Column:
    """Tokens that a set of this size shares at least with any set similar to it."""
    return F.ceil(threshold * size - 1e-9)


#: Shared tokens over those of both sets, or over those of the larger one.
JACCARD, LARGER = "jaccard", "larger"


def _needed(threshold: float, x: Column, y: Column, measure: str) -> Column:
    """Tokens that two sets of these sizes must share."""
    return F.ceil((threshold / (1 + threshold) * (x + y) if measure == JACCARD else threshold * F.greatest(x, y)) - 1e-9)


def similar_edges(sets: DataFrame, threshold: float, measure: str = JACCARD) -> DataFrame:
    """Pairs ``a`` < ``b`` of a block (``_k``) with a similarity of ``threshold`` or more.

    ``sets`` has ``_k``, ``_at`` (unique in its block), ``_w`` (distinct tokens, one or more), ``_d`` (null, or what the
    two must differ in) and ``_side`` (0, or 1 and 2 for pairs of an ``a`` of side 1 and a ``b`` of side 2 alone).
    """
    with scratch() as keep:
        each = sets.select("_k", "_at", F.size("_w").alias("_n"), "_d", "_side", F.explode("_w").alias("_token"))
        often = each.groupBy("_k", "_token").agg(F.count(F.lit(1)).alias("_df"))
        ranked = each.join(often, ["_k", "_token"]).groupBy("_k", "_at", "_n", "_d", "_side").agg(F.array_sort(F.collect_list(F.struct("_df", "_token"))).alias("_r"))
        first = F.slice("_r", F.lit(1), (F.col("_n") - _least_shared(threshold, F.col("_n")) + 1).cast("int"))
        ranked = keep(ranked.withColumn("_first", first).withColumn("_u", F.col("_n") - F.size(F.filter("_first", lambda x: x["_df"] <= HOT))))
        post = ranked.select("_k", "_at", "_n", "_u", "_d", "_side", F.posexplode("_first").alias("_i", "_x")).where("_x._df > 1")  # others have it too
        post = keep(post.select("_k", F.array("_x._token").alias("_key"), "_at", "_n", "_i", "_u", "_d", "_side", F.col("_x._df").alias("_m")))
        dense = keep(_dense(ranked, post))
        found = []
        if not dense.isEmpty():
            found.append(keep(_compared(sets.join(dense, "_k"), threshold, measure)))
            ranked, post = ranked.join(dense, "_k", "left_anti"), post.join(dense, "_k", "left_anti")
        pairs = keep(_met(ranked, post, threshold, measure, keep))
        words = sets.select("_k", "_at", "_w")
        both = pairs.join(words.select("_k", F.col("_at").alias("a"), F.col("_w").alias("_x")), ["_k", "a"]).join(words.select("_k", F.col("_at").alias("b"), F.col("_w").alias("_y")), ["_k", "b"])
        common = F.size(F.array_intersect("_x", "_y"))
        whole = F.size("_x") + F.size("_y") - common if measure == JACCARD else F.greatest(F.size("_x"), F.size("_y"))
        found.append(both.where(common >= threshold * whole if measure == JACCARD else common / whole >= threshold).select("_k", "a", "b"))
        return staged(reduce(DataFrame.unionByName, found))


def _met(ranked: DataFrame, post: DataFrame, threshold: float, measure: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs that meet on what they begin with, often enough to be compared."""
    found, shared = [_meeting_often(post.where(F.col("_m") <= HOT), threshold, measure)], 1
    crowded = post.where(F.col("_m") > HOT).drop("_u")
    while not crowded.isEmpty():
        found.append(_meeting_dealt(crowded.where(_least_shared(threshold, F.col("_n")) <= shared), threshold, shared, measure))
        last = (F.col("_n") + shared - F.greatest(_least_shared(threshold, F.col("_n")), F.lit(shared + 1))).cast("int")  # where one more shared token may stand at the latest
        later = F.filter(F.transform("_r", lambda t, i: F.struct(i.alias("_j"), t["_token"].alias("_t"), t["_df"].alias("_df"))), lambda x: (x["_df"] > 1) & (x["_j"] > F.col("_i")) & (x["_j"] <= last))
        longer = crowded.join(ranked.select("_k", "_at", "_r"), ["_k", "_at"]).withColumn("_x", F.explode(later))
        post = keep(longer.select("_k", F.concat("_key", F.array("_x._t")).alias("_key"), "_at", "_n", F.col("_x._j").alias("_i"), "_d", "_side"))
        shared += 1
        crowds = keep(post.groupBy("_k", "_key").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > HOT))
        if crowds.isEmpty():
            found.append(_meeting(post, threshold, shared, measure))
            break
        found.append(_meeting(post.join(crowds, ["_k", "_key"], "left_anti"), threshold, shared, measure))
        crowded = post.join(crowds, ["_k", "_key"])
    return reduce(DataFrame.unionByName, found).distinct()


def _dense(ranked: DataFrame, post: DataFrame) -> DataFrame:
    """Blocks whose sets would meet too often to write each meeting down, with the shares that they are dealt to (``_p``
    of sides 0 and 1, ``_q`` of sides 0 and 2)."""
    on = lambda side: F.count_if(F.col("_side") == side).cast("double")
    often = post.groupBy("_k", "_key").agg((on(0) * on(0) / 2 + on(1) * on(2)).alias("_met")).groupBy("_k").agg(F.sum("_met").alias("_met"))
    sizes = lambda other: F.greatest(F.count_if(F.col("_side") != other) / SHARE, F.sum(F.when(F.col("_side") != other, F.col("_n"))) / SHARE_TOKENS, F.least(F.lit(SHARES), F.count_if(F.col("_side") != other) / LEAST_SHARE))
    each = ranked.groupBy("_k").agg(F.count(F.lit(1)).alias("_sets"), F.ceil(sizes(2)).cast("int").alias("_p"), F.ceil(sizes(1)).cast("int").alias("_q"))
    return each.join(often, "_k").where((F.col("_sets") > FEW) & (F.col("_met") > MANY * F.col("_sets"))).select("_k", "_p", "_q")


def _compared(sets: DataFrame, threshold: float, measure: str) -> DataFrame:
    """Pairs of dense blocks: sets are dealt to shares, every two shares meet in one task as they are, and similar pairs
    alone leave it. What is shuffled grows with sets times shares, never with meetings."""
    share = lambda n: F.pmod(F.xxhash64("_at"), F.col(n)).cast("int")
    ends = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda p, q, left, right: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), left.alias("left"), right.alias("right"))
    yes, no = F.lit(True), F.lit(False)
    own = share("_p")
    among = F.transform(ends("_p"), lambda x: at(F.least(own, x), F.greatest(own, x), own <= x, own >= x))
    first, second = F.transform(ends("_q"), lambda x: at(own, x, yes, no)), F.transform(ends("_p"), lambda x: at(x, share("_q"), no, yes))
    dealt = sets.withColumn("_kind", F.col("_side") > 0).withColumn("_x", F.explode(F.when(F.col("_side") == 0, among).when(F.col("_side") == 1, first).otherwise(second)))
    groups = sets.groupBy("_k").agg(F.first("_p").alias("_p"), F.first("_q").alias("_q")).agg(F.sum(F.col("_p") * F.col("_q"))).first()[0]
    keys = ["_k", "_kind", "p", "q"]
    dealt = dealt.select("_k", "_kind", "_x.*", "_at", "_w", "_d").repartition(int(min(max(2 * groups, 16), MOST_TASKS)), *keys)  # by number: few bytes, but long work

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        names, block, columns = t["_at"].combine_chunks(), t["_k"].combine_chunks(), ["_k", "a", "b"]
        words = t["_w"].combine_chunks()
        n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        codes = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kind = t["_d"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        left, right = (np.flatnonzero(t[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        if not len(left) or not len(right):
            return
        begin = np.concatenate([[0], np.cumsum(n)])
        place = np.full(len(n), -1, np.int64)
        place[right] = np.arange(len(right))
        owner = np.repeat(place, n)
        held = owner >= 0
        order = np.argsort(codes[held], kind="stable")
        rows = owner[held][order]
        starts = np.searchsorted(codes[held][order], np.arange(codes.max() + 2))
        size, differs, among = n[right], kind[right], t["p"][0] == t["q"][0] and not t["_kind"][0].as_py()
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            x, y = pa.array(np.concatenate(a)), pa.array(np.concatenate(b))
            return pa.RecordBatch.from_arrays([block.take(x), names.take(x), names.take(y)], columns)

        for i in left.tolist():
            own = codes[begin[i] : begin[i + 1]]
            hits = np.concatenate([rows[s:e] for s, e in zip(starts[own].tolist(), starts[own + 1].tolist(), strict=True)])
            common = np.bincount(hits, minlength=len(right))
            near = np.flatnonzero(common >= max(1, math.ceil(threshold * n[i] - 1e-9)))
            whole = n[i] + size[near] - common[near] if measure == JACCARD else np.maximum(n[i], size[near])
            near = near[(common[near] >= threshold * whole if measure == JACCARD else common[near] / whole >= threshold) & ((kind[i] < 0) | (differs[near] != kind[i]))]
            near = right[near]
            near = near[near > i] if among else near
            if len(near):
                a.append(np.full(len(near), i))
                b.append(near)
                waiting += len(near)
            if waiting > PAIRS:
                yield out()
                a, b, waiting = [], [], 0
        if waiting:
            yield out()

    kind_of = lambda c: sets.schema[c].dataType
    schema = StructType([StructField("_k", kind_of("_k")), StructField("a", kind_of("_at")), StructField("b", kind_of("_at"))])
    return dealt.groupBy(*keys).applyInArrow(pairs, schema).select("_k", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _fits(threshold: float, shared: int | Column, measure: str) -> Column:
    """What pairs of postings satisfy if they share so many tokens up to the key's last one."""
    need = _needed(threshold, F.col("x._n"), F.col("y._n"), measure)
    left = F.least(F.col("x._n") - F.col("x._i"), F.col("y._n") - F.col("y._i")) - 1
    sides = ((F.col("x._side") == 0) & (F.col("y._side") == 0)) | ((F.col("x._side") == 1) & (F.col("y._side") == 2))
    near = (F.col("x._n") >= threshold * F.col("y._n") - 1e-9) & (F.col("y._n") >= threshold * F.col("x._n") - 1e-9)
    return (F.col("x._at") < F.col("y._at")) & sides & near & (left + shared >= need) & ~F.coalesce(F.col("x._d") == F.col("y._d"), F.lit(False))


def _meeting_often(post: DataFrame, threshold: float, measure: str) -> DataFrame:
    """Pairs that meet on as many tokens as they must, however many they share of those that they do not meet on.

    These are crowded, or stand past what one of the two begins with: ``_u`` counts both kinds for a set.
    """
    shared = F.least("x._i", "y._i") + 1  # at most
    on = (F.col("x._k") == F.col("y._k")) & (F.col("x._key") == F.col("y._key")) & _fits(threshold, shared, measure)
    need = _needed(threshold, F.col("x._n"), F.col("y._n"), measure) - F.greatest("x._u", "y._u")
    met = post.alias("x").join(post.alias("y"), on).select(F.col("x._k").alias("_k"), F.col("x._at").alias("a"), F.col("y._at").alias("b"), need.cast("int").alias("_need"))
    return met.groupBy("_k", "a", "b").agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need")).where("_n >= _need").select("_k", "a", "b")


def _meeting(post: DataFrame, threshold: float, shared: int, measure: str) -> DataFrame:
    on = (F.col("x._k") == F.col("y._k")) & (F.col("x._key") == F.col("y._key")) & _fits(threshold, shared, measure)
    return post.alias("x").join(post.alias("y"), on).select(F.col("x._k").alias("_k"), F.col("x._at").alias("a"), F.col("y._at").alias("b"))


def _meeting_dealt(post: DataFrame, threshold: float, shared: int, measure: str) -> DataFrame:
    """Pairs that a crowded key makes similar by itself: its sets are dealt to shares, and every two shares meet once."""
    shares = F.ceil(F.col("_m") / HOT).cast("int")
    post = post.withColumn("_own", F.pmod(F.xxhash64("_at"), shares).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), shares - 1)))
    on = (F.col("x._k") == F.col("y._k")) & (F.col("x._key") == F.col("y._key")) & (F.col("x._own") == F.col("y._other")) & (F.col("x._other") == F.col("y._own"))
    need = _needed(threshold, F.col("x._n"), F.col("y._n"), measure)
    return post.alias("x").join(post.alias("y"), on & _fits(threshold, shared, measure) & (need <= shared)).select(F.col("x._k").alias("_k"), F.col("x._at").alias("a"), F.col("y._at").alias("b"))


def not_first(edges: DataFrame) -> DataFrame:
    """What is left out (``_k``, ``_at``) by taking each row in order unless it has an edge to an earlier one that is taken.

    A round takes all rows without an earlier neighbour that is still undecided, and leaves out the neighbours of these.
    Rounds go on until no edge is left: as many as the longest chain of rows that wait for each other.
    """
    gone = [edges.select("_k", F.col("a").alias("_at")).where(F.lit(False))]
    with scratch() as keep:
        while not edges.isEmpty():
            waiting = edges.select("_k", F.col("b").alias("a")).distinct()
            out = staged(edges.join(waiting, ["_k", "a"], "left_anti").select("_k", F.col("b").alias("_at")).distinct())
            gone.append(out)
            edges = keep(edges.join(out.withColumnRenamed("_at", "b"), ["_k", "b"], "left_anti").join(out.withColumnRenamed("_at", "a"), ["_k", "a"], "left_anti").select("_k", "a", "b"))
    return reduce(DataFrame.unionByName, gone)


def first_heads(sets: DataFrame, threshold: float) -> DataFrame:
    """For each set its first similar head (``head``), or null for a head. A step decides the rows up to some place in every
    block, and what later rows its heads take; the next one looks twice as far at what is left, so most pairs never meet."""
    left, limit, found = staged(sets), FIRST, []
    top = left.agg(F.max("_at")).first()[0]
    while top is not None:
        chunk, rest = left.where(F.col("_at") < limit), left.where(F.col("_at") >= limit)
        edges = similar_edges(chunk.withColumn("_side", F.lit(0)), threshold)
        out = not_first(edges)
        heads = staged(chunk.join(out, ["_k", "_at"], "left_anti"))
        found.append(heads.select("_k", "_at", F.lit(None).cast("bigint").alias("head")))
        taken = edges.join(out.withColumnRenamed("_at", "b"), ["_k", "b"]).join(heads.select("_k", F.col("_at").alias("a")), ["_k", "a"])
        found.append(taken.groupBy("_k", F.col("b").alias("_at")).agg(F.min("a").alias("head")))
        if top < limit:
            break
        across = heads.withColumn("_side", F.lit(1)).unionByName(rest.withColumn("_side", F.lit(2)))
        taken = staged(similar_edges(across, threshold).groupBy("_k", F.col("b").alias("_at")).agg(F.min("a").alias("head")))
        found.append(taken)
        left, limit = staged(rest.join(taken, ["_k", "_at"], "left_anti")), 2 * limit
    return reduce(DataFrame.unionByName, found) if found else left.select("_k", "_at", F.lit(None).cast("bigint").alias("head"))


def greedy_groups(rows: DataFrame, keys: list[str], order: list[str], tokens: str, threshold: float, differ: str | None = None, least: int = 1) -> DataFrame:
    """Each row's group head, as if rows were gone through in order: a row joins the first head with a Jaccard similarity
    of ``threshold``, or becomes a head.

    ``keys`` block the comparison (a document's domain, say); with ``differ`` a row joins only heads that differ in that
    column. Rows with fewer than ``least`` tokens stay alone. Adds ``place`` (in the block, from 0) and ``head`` (the
    head's place). Equal sets are compared once.
    """
    at = staged(numbered(rows, keys, order))
    kind = F.col(differ).cast("string") if differ else F.lit(None).cast("string")
    own = at.select("place", (F.struct(*keys) if keys else F.lit(0)).alias("_k"), F.array_sort(F.array_distinct(tokens)).alias("_w"), kind.alias("_d")).where(F.size("_w") >= max(1, least))
    own = staged(own)
    sets = own.groupBy("_k", "_w", "_d").agg(F.min("place").alias("_at"))
    heads = staged(first_heads(sets, threshold))
    mine = sets.join(heads, ["_k", "_at"]).select("_k", "_w", "_d", "_at", "head")
    same = (F.col("o._k") == F.col("m._k")) & (F.col("o._w") == F.col("m._w")) & F.col("o._d").eqNullSafe(F.col("m._d"))
    alone = F.col("o.place") if differ else F.col("m._at")  # equal sets join each other, unless they must differ
    joined = own.alias("o").join(mine.alias("m"), same).select(F.col("o._k").alias("_k"), F.col("o.place").alias("_place"), F.coalesce("m.head", alone).alias("head"))
    both = at.withColumn("_k", F.struct(*keys) if keys else F.lit(0)).join(joined.withColumnRenamed("_place", "place"), ["_k", "place"], "left")
    return both.select(*rows.columns, "place", F.coalesce("head", "place").alias("head"))


def similar_pairs(rows: DataFrame, id_col: str, tokens: str, threshold: float) -> DataFrame:
    """Pairs ``a`` < ``b`` of token sets with a Jaccard similarity of ``threshold`` or more; the least id stands for a set.

    Rows without tokens have no pair.
    """
    sets = rows.select(F.col(id_col).alias("_at"), F.array_sort(F.array_distinct(tokens)).alias("_w")).where(F.size("_w") > 0).groupBy("_w").agg(F.min("_at").alias("_at"))
    sets = staged(sets.select(F.lit(0).alias("_k"), "_at", "_w", F.lit(None).cast("string").alias("_d"), F.lit(0).alias("_side")))
    return similar_edges(sets, threshold).select("a", "b")
