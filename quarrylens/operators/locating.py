"""Where names and quotes stand in texts, found by what is rare in them instead of by comparing every pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import staged

#: Characters that a text's places are first asked by; a shorter name is asked for as a whole.
BEGINNING = 6
#: Longest name that the places of texts tell by themselves; a longer one is known by so many of its characters.
WINDOW = 32
#: Characters of a text whose places are told at once.
PIECE = 4096


def runs(t: Column, least: int, most: int | None = None, of: str = ".") -> Column:
    """The different runs that begin at the places of ``t``: of ``most`` characters, or what is left if ``least`` are.

    A pattern is also tried within a character of two UTF-16 units, where no run begins.
    """
    return F.array_distinct(F.regexp_extract_all(t, F.lit(rf"(?s)(?=({of}{{{least},{most or least}}}))(?!\p{{Cs}})"), F.lit(1)))


def named_in(texts: DataFrame, names: DataFrame, block: list[str], text_id: list[str], text: str, name: str) -> DataFrame:
    """Rows of ``names`` with the ids of the texts of their block that contain the name, in whatever case.

    A place of a text meets the beginnings of names; one that begins a name is cut to the lengths that names with this
    beginning have, and what is cut meets the names. So a place costs as much whether one name begins so or thousands,
    and nothing that is no name meets a text. Names of more than ``WINDOW`` characters are met by the run of so many that
    the fewest names have, and looked for in the texts that have it. An empty name is in every text. ``text_id`` tells the
    texts of a block apart; it may have nulls.
    """
    columns = [c for c in names.columns if c not in block]
    own = names.select(*block, F.struct(*columns).alias("_name"), F.lower(T.text(name)).alias("_n"))
    lower = texts.select(*block, *text_id, F.lower(T.text(text)).alias("_t"))
    size = F.length("_n")
    asked = own.agg(F.coalesce(F.max(size), F.lit(0)), F.min(F.when(size >= BEGINNING, size)), F.collect_set(F.when(size < BEGINNING, size)), F.coalesce(F.max(F.rlike("_n", F.lit(r"\s"))), F.lit(False)))
    longest, least, short, spaced = asked.first()  # of the names' sizes, a few numbers
    key = F.col("_n")
    if longest > WINDOW:
        far = own.where(size > WINDOW).select(*block, "_n").distinct().select(*block, "_n", F.explode(runs(F.col("_n"), WINDOW)).alias("_k"))
        shared = far.groupBy(*block, "_k").agg(F.count(F.lit(1)).alias("_names"))
        known = far.join(shared, [*block, "_k"]).groupBy(*block, "_n").agg(F.min(F.struct("_names", "_k"))["_k"].alias("_k"))
        own, key = own.join(known, [*block, "_n"], "left"), F.coalesce("_k", "_n")
    keyed = staged(own.select(*block, "_name", "_n", key.alias("_k")).distinct().withColumn("_b", F.left("_k", F.lit(BEGINNING))))
    sizes = keyed.where("_k <> ''").groupBy(*block, "_b").agg(F.collect_set(F.length("_k")).alias("_sizes"))

    of, most = "." if spaced else r"\S", min(longest, WINDOW)
    each = [runs(F.col("_p"), n, of=of) for n in sorted(short) if n] + ([runs(F.col("_p"), min(least, WINDOW), most, of)] if least else [])
    piece = F.when(F.length("_t") <= PIECE, F.array("_t")).otherwise(F.regexp_extract_all("_t", F.lit(rf"(?s)(?=(.{{1,{PIECE + most}}})).{{1,{PIECE}}}"), F.lit(1)))
    places = lower.select(*block, *text_id, F.explode(piece).alias("_p")).select(*block, *text_id, F.explode(F.concat(*each) if each else F.array().cast("array<string>")).alias("_w"))
    begun = places.withColumn("_b", F.left("_w", F.lit(BEGINNING))).join(sizes, [*block, "_b"])
    cut = begun.select(*block, *text_id, F.explode(F.filter("_sizes", lambda n: n <= F.length("_w"))).alias("_s"), "_w").select(*block, *text_id, F.left("_w", F.col("_s")).alias("_k"))
    met = cut.join(keyed.select(*block, "_k").distinct(), [*block, "_k"], "left_semi").distinct().join(keyed, [*block, "_k"])
    found = met.where(F.length("_n") <= WINDOW).select(*block, *text_id, "_name")
    if longest > WINDOW:
        asks = met.where(F.length("_n") > WINDOW).groupBy(*block, *text_id).agg(F.collect_list(F.struct("_name", "_n")).alias("_all")).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*block, *text_id])], "_all")
        same = [F.col(f"_{i}").eqNullSafe(F.col(c)) for i, c in enumerate([*block, *text_id])]
        there = asks.join(lower, reduce(Column.__and__, same)).select(*block, *text_id, F.explode(F.filter("_all", lambda x: F.contains("_t", x["_n"]))).alias("_x"))
        found = found.unionByName(there.select(*block, *text_id, F.col("_x._name").alias("_name")))
    if 0 in short:
        found = found.unionByName(lower.select(*block, *text_id).join(keyed.where("_n = ''").select(*block, "_name"), block))
    return found.select(*block, *text_id, *[F.col(f"_name.{c}").alias(c) for c in columns])


def quote_places(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """Where quotes stand word for word: the text's id and the place (from 0) of the quote's first word.

    Words are what stands between white space. Texts give their words' places only for words that some quote has; a quote
    meets them on its word with the fewest places, and the words around are then those of the quote, one after the other.
    Blank quotes stand nowhere; a quote that stands several times has a row for each.
    """
    q = staged(quotes.select(F.col(quote_id).alias("_q"), T.words(quote).alias("_w")).where(F.size("_w") > 0).distinct())
    d = staged(texts.select(F.col(text_id).alias("_d"), T.words(text).alias("_x")))
    asked = q.select(F.explode("_w").alias("_word")).distinct()
    places = staged(d.select("_d", F.posexplode("_x").alias("_at", "_word")).join(asked, "_word", "left_semi"))
    often = places.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    each = q.select("_q", F.posexplode("_w").alias("_i", "_word")).join(often, "_word", "left")
    rare = each.groupBy("_q").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_i", "_word")).alias("_r")).where("_r.n > 0")
    begin = F.col("_at") - F.col("_r._i")
    near = rare.join(places, F.col("_r._word") == F.col("_word")).where(begin >= 0).select("_q", "_d", begin.alias("start"))
    full = near.join(q, "_q").join(d, "_d")
    same = F.slice("_x", F.col("start") + 1, F.size("_w")) == F.col("_w")
    return full.where(same).select(F.col("_q").alias(quote_id), F.col("_d").alias(text_id), "start").distinct()
