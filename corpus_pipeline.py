"""A training corpus from raw documents: rules, exact copies, near copies, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import exact, minhash, packing, quality, secrets
from quarrylens.llm.common import documents, staged
from quarrylens.llm.vocabularies import vocabulary

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality.keep_good(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact.drop_copies(docs)),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: minhash.drop_near_copies(docs)),
    ("secret scans", lambda spark, docs, sf_dir: secrets.hide_secrets(docs, vocabulary("byte_bpe_50k.json"))),
    ("best-fit packing", lambda spark, docs, sf_dir: packing.pack(docs, vocabulary("byte_bpe_50k.json"))),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = staged(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
