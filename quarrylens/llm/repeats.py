"""Repeated stretches of documents: the Spark side that substring and suffix-array deduplication share.

A unit is the stretch of symbols that a run of windows with one anchor covers (``windows.anchors``). Units are
narrow rows: anchor and content hash, document key, place. Those whose anchor stands in one place only are dropped;
equal units are merged; their symbols are then fetched once and compared in shards by anchor. An anchor with more
than ``HOT`` different units is dealt to several shards, which then settle what they hold in common by window hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, salted, staged, with_group
from .windows import Anchors

#: Units of one anchor that are compared in one shard.
HOT = 4_096
#: Symbols' bytes that a shard holds, about.
SHARD_BYTES = 4 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts laid end to end, and where each begins (and the end). A null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col, F.isnull(id_col))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and a key: rows with the same key are repeated rows, with the same result."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))


def unit_rows(docs: DataFrame, find: Callable[[pa.Array], Anchors]) -> DataFrame:
    """One row a unit of ``keyed`` documents."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a = find(batch.column(1))
        doc = pa.array(a.doc)
        columns = [pa.array(a.anchor), pa.array(a.content), batch.column(0).take(doc), batch.column(2).take(doc), pa.array(a.start, pa.int64()), pa.array(a.count, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "content", "id", "key", "start", "count"])

    return map_batches(docs, run, f"anchor bigint, content bigint, id {kind}, key bigint, start bigint, count int")


def shared_units(units: DataFrame, several: Column) -> DataFrame:
    """Units whose anchor satisfies ``several``, an aggregate over all that have it. ``units`` is staged."""
    anchors = staged(units.groupBy("anchor").agg(several.alias("_several")).where("_several").select("anchor"))
    return staged(units.join(anchors, "anchor"))


def distinct_units(units: DataFrame) -> DataFrame:
    """One row for each anchor and content: how often, the first document's id, and where the first and last of them stand."""
    first = F.struct(F.col("id").isNull().alias("none"), "id")
    place = F.struct("key", "start", "count")
    return staged(units.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"), F.min(place).alias("place"), F.max(place).alias("last")))


def fetched(docs: DataFrame, units: DataFrame, cut: Callable[[pa.Array, list], pa.Array], kind: str, more: dict[str, str]) -> DataFrame:
    """Units with their symbols and the columns ``more``: each document that holds some is read once, for all of them.

    ``cut`` gets texts and the units' documents, starts and counts, and returns the symbols of every unit in turn.
    """
    names = ["anchor", "content", "n", "start", "count", *more]
    columns = [F.col(n) for n in names[:3]] + [F.col("place.start").alias("start"), F.col("place.count").alias("count")] + [F.col(n) for n in more]
    wanted = units.groupBy(F.col("place.key").alias("key")).agg(F.collect_list(F.struct(*columns)).alias("units"))
    once = docs.select("key", "text").join(wanted, "key").select("key", "text", "units")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]  # repeated rows, all in this task
            if not rows:
                continue
            batch = batch.take(pa.array(rows))
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(2)
                flat = lists.flatten()
                sizes = lists.value_lengths().to_numpy()
                start, count = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "count"))
                symbols = cut(part.column(1), [np.repeat(np.arange(part.num_rows), sizes), start, count])
                yield pa.RecordBatch.from_arrays([flat.field(n) for n in names] + [symbols], [*names, "symbols"])

    schema = "anchor bigint, content bigint, n bigint, start bigint, count int" + "".join(f", {n} {k}" for n, k in more.items())
    return once.mapInArrow(run, f"{schema}, symbols {kind}")


def in_shards(units: DataFrame, total_bytes: int, compare: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``compare`` over every shard: all units of an anchor meet, those of a hot one dealt by content.

    ``units`` has ``parts``, the shards of its anchor.
    """
    shards = max(1, int(-(-total_bytes // SHARD_BYTES)))
    dealt = units.repartition(shards, "anchor", F.pmod("content", F.col("parts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield compare(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def with_parts(units: DataFrame) -> DataFrame:
    """Each distinct unit with its anchor's number of different units and the shards that they are dealt to."""
    out = with_group(units, ["anchor"], salted("content"), {"_k": F.count(F.lit(1))}, {"rivals": F.sum("_k")})
    return out.withColumn("parts", F.ceil(F.col("rivals") / F.lit(HOT)))


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values."""
    edges = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
