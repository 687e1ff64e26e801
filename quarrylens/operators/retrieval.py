"""Vector search over chunks, and matching of citations to what was retrieved."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as V

#: Queries of a block and items of a share, about; queries that are compared at once; what a product of matrices may be off.
QUERIES, ITEMS, AT_ONCE, MARGIN = 4_096, 8_192, 512, 1e-9
#: Runs of words of quotes that are broadcast at most, as 64-bit hashes.
BROADCAST_RUNS = 1_000_000


def compatible(chunks: DataFrame, model: str) -> DataFrame:
    """``chunks``, or an error at run time if one was embedded by another model."""
    wrong = F.raise_error(F.concat(F.lit(f"chunks are embedded by another model than {model}: "), F.col("embedding_model")))
    return chunks.withColumn("embedding_model", F.when(F.col("embedding_model") == model, F.col("embedding_model")).otherwise(wrong.cast("string")))


def nearest(queries: DataFrame, items: DataFrame, k: int = 4, least: float = 0.25, group: str | None = "domain") -> DataFrame:
    """The ``k`` most similar items of each query, by exact cosine: k of each group first, then k of all.

    ``queries`` has query_id and vector, ``items`` has item_id and vector (and the group). The stated queries meet all
    items, block against share, each two in one task that keeps its own k; windows then see k rows a share, query and
    group. Vectors of another length, or with an element that is null or not finite, meet the rest one by one.
    """
    one = items.select("item_id", F.col("vector").alias("_v"), F.col(group).alias("_g") if group else F.lit(0).alias("_g"))
    asked = queries.select("query_id", F.col("vector").alias("_v"))
    n, length = asked.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    fit = lambda df: df.withColumn("_fit", F.coalesce((F.size("_v") == (length or 0)) & F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False)))
    one, asked = fit(one), fit(asked)
    scored = [_block_nearest(asked.where("_fit"), one.where("_fit"), n, k, least)]
    odd_items, odd_queries = one.where("not _fit"), asked.where("not _fit")
    for x, y, there in ((odd_items, asked, not odd_items.isEmpty()), (one.where("_fit"), odd_queries, not odd_queries.isEmpty())):
        if there:
            scored.append(_scored(y, x, least))
    by, scored = [F.col("raw").desc(), F.col("item_id")], reduce(DataFrame.unionByName, scored)
    for part in (["query_id", "_g"], ["query_id"]):
        scored = scored.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(*by))).where(F.col("place") <= k)
    return scored.select("query_id", "item_id", *([F.col("_g").alias(group)] if group else []), T.half_even(F.col("raw"), 4).alias("similarity"), "place")


def _scored(asked: DataFrame, one: DataFrame, least: float) -> DataFrame:
    """Every query against every item."""
    pairs = one.select("item_id", "_v", "_g").crossJoin(asked.select("query_id", F.col("_v").alias("_q")))
    raw = F.greatest(F.lit(0.0), V.cosine(F.col("_v"), F.col("_q")))
    return pairs.select("query_id", "item_id", "_g", raw.alias("raw")).where(F.col("raw") >= least)


def _block_nearest(asked: DataFrame, one: DataFrame, n: int, k: int, least: float) -> DataFrame:
    """The k best of each query and group in each share of items. A product of matrices leaves what may be among them; the
    similarity of these is then the sequential sum of doubles that it is elsewhere, so that equal vectors tie."""
    blocks, shares = max(1, -(-n // QUERIES)), max(1, -(-one.count() // ITEMS))
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    ids, labels = asked.schema["query_id"].dataType, one.schema["_g"].dataType
    x = one.select(deal("item_id", shares).alias("_s"), every(blocks).alias("_b"), "item_id", F.lit(None).cast(ids).alias("query_id"), F.col("_v").cast("array<double>").alias("_v"), "_g")
    y = asked.select(every(shares).alias("_s"), deal("query_id", blocks).alias("_b"), F.lit(None).cast(one.schema["item_id"].dataType).alias("item_id"), "query_id", F.col("_v").cast("array<double>").alias("_v"), F.lit(None).cast(labels).alias("_g"))
    both = x.withColumn("_item", F.lit(True)).unionByName(y.withColumn("_item", F.lit(False)))

    def best(t: pa.Table) -> pa.Table:
        side = t["_item"].combine_chunks().to_numpy(zero_copy_only=False)
        v, q = (t.filter(pa.array(mask)).combine_chunks() for mask in (side, ~side))
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if len(v) and len(q):
            label = v["_g"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            v, label = v.take(pa.array(np.argsort(label, kind="stable"))).combine_chunks(), np.sort(label)
            ends = np.flatnonzero(np.diff(label, append=label[-1] + 1)) + 1
            a, b = (np.asarray(c["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(c), -1) for c in (v, q))
            squares = lambda m: reduce(lambda s, i: s + m[:, i] * m[:, i], range(m.shape[1]), np.zeros(len(m)))
            size, own = np.sqrt(squares(a)), np.sqrt(squares(b))
            rank = np.empty(len(v), np.int64)
            rank[pc.sort_indices(v["item_id"]).to_numpy()] = np.arange(len(v))
            unit, asking = a / np.maximum(size, 1e-300)[:, None], b / np.maximum(own, 1e-300)[:, None]
            for begin in range(0, len(q), AT_ONCE):
                some = np.arange(begin, min(begin + AT_ONCE, len(q)))
                near = asking[some] @ unit.T
                for first, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    part = near[:, first:end]
                    floor = np.partition(part, -k, axis=1)[:, -k] - MARGIN if end - first > k else np.full(len(some), -np.inf)
                    i, j = np.nonzero(part >= np.maximum(floor, least - MARGIN if least > 0 else -np.inf)[:, None])
                    i, j = some[i], first + j
                    dot = reduce(lambda s, d: s + a[j, d] * b[i, d], range(a.shape[1]), np.zeros(len(i)))  # noqa: B023
                    whole = size[j] * own[i]
                    raw = np.maximum(0.0, np.where(whole == 0, 0.0, dot / np.where(whole == 0, 1.0, whole)))
                    order = np.lexsort((rank[j], -raw, i))
                    i, j, raw = i[order], j[order], raw[order]
                    keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (raw >= least)
                    for column, value in zip(found, (i[keep], j[keep], raw[keep]), strict=True):
                        column.append(value)
        i, j, raw = (np.concatenate(c) for c in found)
        return pa.table({"query_id": q["query_id"].take(pa.array(i)), "item_id": v["item_id"].take(pa.array(j)), "_g": v["_g"].take(pa.array(j)), "raw": pa.array(raw)})

    schema = StructType([StructField("query_id", ids), one.schema["item_id"], StructField("_g", labels), StructField("raw", DoubleType())])
    return both.repartition(min(max(2 * blocks * shares, 8), 2_000), "_s", "_b").groupBy("_s", "_b").applyInArrow(best, schema)


def grounded_pairs(quotes: DataFrame, documents: DataFrame, quote_id: str, doc_id: str, n: int = 6) -> DataFrame:
    """Quotes (id, quote) and documents (id, text) that share a run of ``n`` words, each pair once.

    Documents' runs that no quote has go before anything is shuffled, if the quotes' runs are few enough to broadcast;
    else both sides meet by run, where adaptive execution splits a frequent one.
    """
    asked = quotes.select(quote_id, F.explode(F.array_distinct(T.runs("quote", n))).alias("_run")).select(quote_id, F.xxhash64("_run").alias("_mark"), "_run")
    few = asked.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    held = documents.select(doc_id, F.explode(T.runs("text", n)).alias("_run")).withColumn("_mark", F.xxhash64("_run"))
    marks = asked.select("_mark").distinct()
    held = held.join(F.broadcast(marks) if few else marks, "_mark", "left_semi").distinct()
    return held.join(asked, ["_mark", "_run"]).select(quote_id, doc_id).distinct()


def quoting(quotes: DataFrame, documents: DataFrame, quote_id: str, doc_id: str, n: int = 6) -> DataFrame:
    """Quotes (id, quote) of ``n`` words or more and the documents (id, text) that hold them whole, character by character."""
    near = grounded_pairs(quotes, documents, quote_id, doc_id, n)
    return near.join(quotes, quote_id).join(documents, doc_id).where(F.contains("text", F.col("quote"))).select(quote_id, doc_id)


def match_citations(cited: DataFrame, retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """The retrieved chunk that a citation means: 3 for its clause, up to 2 for words of the source's name; 1 at least."""
    clause = T.clause_label(F.regexp_extract(F.col("reference"), r"§?\s*(\d+(?:\.\d+)+)", 1))
    both = cited.withColumn("_clause", clause).withColumn("_w", T.long_tokens("reference", 2)).join(retrieved, keys)
    name = T.long_tokens(F.regexp_replace("source", r"\.\w+$", ""), 2)
    score = F.when((F.col("_clause") != "") & (F.col("_clause") == F.col("clause")), 3.0).otherwise(0.0) + 2.0 * T.ratio(F.size(F.array_intersect("_w", name)), F.size(name))
    best = F.max_by(F.struct("chunk_id", "source", "clause", "similarity"), F.struct(F.col("score"), F.col("similarity")))
    return both.withColumn("score", score).where("score >= 1").groupBy(*keys, "reference").agg(best.alias("chunk"), F.max("score").alias("match_score"))


def finding_confidence(similarity: Column, cited: Column) -> Column:
    """By how well a citation is borne out: 0.3 without one, 0.45 if it was not found, else by similarity."""
    return F.when(~cited, 0.3).when(similarity.isNull(), 0.45).otherwise(T.half_even(T.citation_confidence(similarity), 2))


def chunk_status(chunks: DataFrame, domains: list[str]) -> DataFrame:
    """Chunks of every domain, and a warning where there are none."""
    dim = chunks.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    n = chunks.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "domain", "left").fillna(0, ["n"]).withColumn("empty", F.col("n") == 0)


def top_sections(sections: DataFrame, question: str, k: int = 4, id_col: str = "doc_id") -> DataFrame:
    """The sections of each document that share most words with a question."""
    asked = F.array(*[F.lit(w) for w in sorted({w for w in question.lower().split() if len(w) > 2})]) if question.split() else F.array().cast("array<string>")
    n = F.size(F.array_intersect(T.alnum_words(F.concat_ws(" ", "heading", "body")), asked))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("overlap").desc(), "index"))
    return sections.withColumn("overlap", n).withColumn("place", place).where(F.col("place") <= k)


def rank_skills(skills: DataFrame, domain: str, tags: list[str], platforms: list[str], frameworks: list[str]) -> DataFrame:
    """Skills by weighted matches: domain 50 (25 for a general one), tag 5, platform 10, framework 15; positive ones."""
    hits = lambda c, v: F.size(F.array_intersect(F.col(c), F.array(*[F.lit(x) for x in v]))) if v else F.lit(0)
    score = F.when(F.array_contains("domains", domain), 50).when(F.array_contains("domains", "general"), 25).otherwise(0) + 5 * hits("tags", tags) + 10 * hits("platforms", platforms) + 15 * hits("frameworks", frameworks)
    return skills.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "name")
