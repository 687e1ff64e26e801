"""Exact deduplication by content-defined chunk recipes, in DataFrame operations alone.

A text is cut where its own content says so; every distinct chunk moves once, to verify that its identifier stands
for it alone: chunks that share a hash are told apart by a number. What is compared are the short ordered lists of
identifiers. Long texts never meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted, staged, with_group

#: A chunk ends after one of these characters, once it has its least length, and at its greatest length anyway.
ENDS, LEAST, MOST = ".,;:!?|-", 256, 4096


def normalised(text: Column) -> Column:
    """Without ASCII white space; a null is empty."""
    out = F.coalesce(text, F.lit(""))
    for space in " \n\t\r\v\f":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def chunks(text: Column) -> Column:
    """The text's chunks in order: a function of the text alone, so equal texts have equal lists; of an empty text none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{LEAST},{MOST - 1}}}?[{ENDS}]|.{{1,{MOST}}}"), F.lit(0))


def identifier(chunk: Column, bits: int = 64) -> Column:
    """A chunk's hash, its lowest ``bits`` (fewer than 64 only where tests want chunks that share one)."""
    full = F.xxhash64(chunk)
    return full if bits == 64 else F.pmod(full, F.lit(1 << bits))


def clashing(texts: DataFrame, bits: int = 64) -> DataFrame | None:
    """None if every chunk has a hash of its own, else those that share one, numbered from 0 (``hash``, ``chunk``, ``number``).

    Every distinct chunk moves once, to be counted with its hash: what is not in this table has a hash that stands for
    it alone. Expected are about n * n / 2**65 rows for n distinct chunks; only for these do chunks move again.
    """
    distinct = texts.select(F.explode("_chunks").alias("chunk")).distinct().withColumn("hash", identifier(F.col("chunk"), bits))
    several = staged(distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    if several.isEmpty():
        return None
    number = F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1
    return staged(distinct.join(several, "hash").select("hash", "chunk", number.alias("number")))


def recipes(texts: DataFrame, bits: int = 64) -> DataFrame:
    """``texts`` with ``_recipe``, the ordered identifiers of its chunks: hash and number, which together stand for one chunk.

    Only texts with a chunk whose hash is shared take part in a join.
    """
    plain = lambda c: F.struct(identifier(c, bits).alias("hash"), F.lit(0).alias("number"))
    clash = clashing(texts, bits)
    if clash is None:
        return texts.withColumn("_recipe", F.transform("_chunks", plain)).drop("_chunks", "_row")
    parts = texts.select("_row", F.posexplode("_chunks").alias("at", "chunk")).withColumn("hash", identifier(F.col("chunk"), bits))
    numbered = parts.join(clash.where("number > 0"), ["hash", "chunk"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("at", "number"))).alias("_numbers"))
    number = lambda i: F.coalesce(F.col("_numbers")[i], F.lit(0))
    recipe = F.transform("_chunks", lambda c, i: F.struct(identifier(c, bits).alias("hash"), number(i).alias("number")))
    return texts.join(numbered, "_row", "left").withColumn("_recipe", recipe).drop("_chunks", "_numbers", "_row")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Each row with the row that stays of its group, the group's size and the digest of its normalised text.

    Of equal texts the one with the most code points stays, then the smallest id (null ids last); rows repeated with
    their id are all ``kept`` and count in the group's size. Null texts are empty texts and equal each other. Long
    texts are compared whole, by their recipes.
    """
    return _groups(docs, id_col, text_col, bits).select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def _groups(docs: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    texts = docs.select(F.col(id_col), F.xxhash64(text_col).alias("_key"), F.coalesce(F.length(text_col), F.lit(0)).alias("_chars"), normalised(F.col(text_col)).alias("_text"))
    texts = texts.select(id_col, "_key", "_chars", F.sha2(F.col("_text"), 256).alias("text_sha256"), chunks(F.col("_text")).alias("_chunks"))
    texts = staged(texts.withColumn("_row", F.monotonically_increasing_id()))  # cut once; its rows keep their numbers
    best = F.struct((-F.col("_chars")).alias("less"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    partial = {"_best": F.min(best), "_n": F.count(F.lit(1))}
    final = {"_best": F.min("_best"), "group_size": F.sum("_n")}
    out = with_group(staged(recipes(texts, bits)), ["_recipe"], salted(id_col, "_chars"), partial, final)
    keep = F.col("_best.id")
    kept = F.col(id_col).eqNullSafe(keep) & (F.col("_chars") == -F.col("_best.less"))
    return out.select(id_col, "_key", keep.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with its columns as they are; of rows repeated as a whole, one."""
    kept = _groups(docs, id_col, text_col).where("kept")
    stay = kept.groupBy(F.col(id_col).alias("id"), "text_sha256").agg(F.min("_key").alias("key"), F.count(F.lit(1)).alias("same")).drop("text_sha256")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("mark"))
    found = rows.join(stay, F.col("own").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("key")))
    return found.where("same = 1").select("row.*").union(found.where("same > 1").dropDuplicates(["own", "mark"]).select("row.*"))
