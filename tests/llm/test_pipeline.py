from __future__ import annotations

from collections import Counter

import corpus_pipeline
from quarrylens.llm import quality, secrets
from quarrylens.llm.vocabularies import vocabulary

from .fixtures import frame, odd_texts
from .test_exact_quality import exact_by_force
from .test_similar import similar_by_force

WORDS = vocabulary("byte_bpe_50k.json")


def by_force(rows):
    """Ids left after quality rules, one of each exact group, and one of each near group."""
    good = [(i, t) for i, t in rows if quality.verdict(quality.Measured(t), quality.RULES) is None]
    exact = list(dict.fromkeys((i, t) for (i, t) in good if any(i == r[1] and r[0] == i and r[3] for r in exact_by_force(good))))
    return sorted({r[4] for r in similar_by_force(exact) if r[4] is not None})


def write(spark, rows, folder):
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_keep_columns_and_pack_what_is_left(spark, tmp_path):
    rows = [r for r in odd_texts() if r[0] is not None]
    sf_dir = write(spark, rows, tmp_path)
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        docs = after
    assert sorted(r["doc_id"] for r in docs.collect()) == by_force(rows)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted({r["doc_id"] for r in packed}) == by_force(rows)
    assert all(r["offset"] + r["length"] <= 2048 for r in packed)


def test_pipeline_over_documents(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    packed = corpus_pipeline.run(spark, small).collect()
    assert sorted({r["doc_id"] for r in packed}) == by_force(sorted(docs.items()))
    assert max(Counter((r["doc_id"], r["piece"]) for r in packed).values()) == 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, [], tmp_path)).collect() == []


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert secrets.HIDDEN and corpus_pipeline.ORACLE_SQL is None
