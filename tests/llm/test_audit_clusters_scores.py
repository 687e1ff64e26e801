"""Filter audit, centroid clustering and the compression classifier, against plain versions and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import audit, centroids, compression, queries

from .fixtures import CLASHING, frame, odd_texts, rows_of

LABELS = "doc_id bigint, quality int, toxic int, extra string"


def odd_labels(spark):
    rows = [(1, 1, 0, "a"), (2, 0, 1, "b"), (2, 1, None, "b"), (7, None, 1, None), (None, 1, 1, "c"), (13, 1, 1, ""), (14, 0, 0, ""), (99, 1, 1, ""), (12, 1, 0, "")]
    return spark.createDataFrame(rows, LABELS)


def plain_audit(docs, labels):
    """Every order applied left to right, document by document."""
    good = {i for i, q, t in labels if i is not None and q == 1}
    toxic = {i for i, q, t in labels if i is not None and t == 1}
    ids = {}
    for i, _, text in docs:
        ids.setdefault(text or "", []).append(i)
    found = []
    for i, part, text in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        known = [j for j in ids[text] if j is not None]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": bool(known) and (i is None or i > min(known))}
        found.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in found}:
        mine = [x[1:] for x in found if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in mine)
                out[part, order, step] = [len(left), len(gone), sum(x[0][f] for x in mine) - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return sorted((*k, *row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items())


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_order_of_filters_matches_applying_them(spark, broadcast):
    rows = odd_texts() + [(20, "Up AND Down " * 40), (21, "a|b " * 60), (20, "Up AND Down " * 40), (1, "same id, other text"), (22, " x " * 70)]
    docs = frame(spark, rows, clashing=True)
    labels = odd_labels(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
    try:
        got = rows_of(audit.audit_filters(docs, labels))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = plain_audit([tuple(r) for r in docs.select("doc_id", "source", "text").collect()], [tuple(r)[:3] for r in labels.collect()])
    assert sorted(got) == want and len(got) == 600 * len({r[0] for r in got})
    removed = {(r[1], r[2]): r[4] for r in got if r[0] == "src"}
    fails = {f: [r[4] + r[5] for r in got if r[0] == "src" and r[1][r[2] - 1] == f][0] for f in "ABCDE"}
    assert all(removed[order, 1] == fails[order[0]] for order, _ in removed)


def test_audit_of_nothing_and_of_rows_without_ids(spark):
    assert audit.audit_filters(frame(spark, []), odd_labels(spark)).count() == 0
    got = rows_of(audit.audit_filters(frame(spark, [(None, "x"), (None, "x")]), spark.createDataFrame([], LABELS)))
    assert {r[4] for r in got if r[1][r[2] - 1] == "E"} == {0} and len(got) == 600


def run_sql(small, name, table):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(table.columns)
    assert sorted(map(tuple, table.select(*columns).collect()), key=repr) == sorted(map(tuple, found.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op12_centroid_clustering"])
def test_queries_match_their_sql(spark, small, name):
    run_sql(small, name, queries.queries()[name](spark, small))


def plain_clusters(rows, clusters, rounds, size):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in named[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            at[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {k: sum(d for _, d, o in found if o == k) for _, _, k in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in found), key=repr)


def vectors(spark, rows):
    extra = [F.lit("x").alias(c) for c in (*CLASHING, "v", "x", "cluster", "upper", "lower")]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").select(*extra, "*")


@pytest.mark.parametrize(("clusters", "rounds"), [(7, 5), (40, 3), (1, 2), (500, 1)])
def test_clusters_match_a_plain_search(spark, clusters, rounds):
    rng = random.Random(clusters)
    size = 8
    grid = lambda: [rng.choice((-1, 0, 0, 1)) / 256 for _ in range(size)]  # noqa: E731  many ties
    rows = [(i, grid()) for i in range(150)] + [(i, [rng.gauss(0, 2) for _ in range(size)]) for i in range(150, 240)]
    rows += [(3, rows[3][1]), (3, grid()), (None, grid()), (None, None), (300, None), (301, [0.5] * 7), (302, [0.5] * 9), (303, [None, *[0.5] * 7]), (304, [math.nan, *[0.5] * 7]), (305, [math.inf, *[0.5] * 7]), (306, [])]
    rows += [(400 + i, [1000.5] * size) for i in range(30)]
    table = vectors(spark, [(i, v, 0) for i, v in rows])
    floats = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = centroids.cluster(table, size=size, clusters=clusters, rounds=rounds)
    assert rows_of(got) == plain_clusters(floats, clusters, rounds, size)


def test_no_vectors_and_too_large_ones(spark):
    empty = centroids.cluster(vectors(spark, [(1, None, 0), (2, [1.0], 0)]))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, [(1, [1e9] * 64, 0)]))


def test_the_ball_holds_what_a_full_search_finds():
    """Round after round with bounds carried on; near and equal centroids, and vectors at equal distances."""
    rng = np.random.default_rng(5)
    x = np.r_[rng.integers(-3, 4, (400, 6)), rng.integers(-2000, 2000, (400, 6))].astype(np.int64)
    at = np.r_[x[:10], x[:2], x[-10:]]
    now, n = centroids.Centroids(at), len(x)
    cluster, upper, lower = np.full(n, -1), np.zeros(n), np.zeros(n)
    for _ in range(6):
        cluster, upper, lower = centroids.search(x, now, cluster, upper, lower)
        full = ((x[:, None] - now.at[None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all()
        best = np.sqrt(full.min(axis=1))
        others = np.where(np.arange(len(now.at)) == cluster[:, None], np.inf, full).min(axis=1) ** 0.5
        assert (upper >= best).all() and (lower <= others).all()
        moved = now.at.copy()
        for k in np.unique(cluster):
            moved[k] = x[cluster == k].sum(axis=0) // (cluster == k).sum()
        now = centroids.Centroids(moved, now.at)


def test_scores_are_the_curve_of_plain_sizes(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    import zstandard

    model = compression.learned(docs, labels)
    assert model.good and model.bad and model.slope < 0
    both = [zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    want = []
    for r in docs.collect():
        data = r["text"].encode()
        parts = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in both)
        score = 1 / (1 + math.exp(-(model.intercept + model.slope * (good - bad + 64 * model.usual) / (len(data) + 64))))
        want.append((r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, round(score, 9), int(score >= 0.3)))
    got = [(r[0], r[1], round(r[2], 9), r[3]) for r in queries.op13_quality_classifier(spark, small).collect()]
    assert sorted(got) == sorted(want)


def test_held_out_labels_are_told(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r["doc_id"]], r["predicted"]) for r in queries.op13_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50 and sum(a == b for a, b in rows) >= 0.92 * len(rows)
    assert all(p for q, p in rows if q == 1)


def test_labels_of_held_out_rows_change_nothing(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    other = labels.withColumn("quality", F.when(compression.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    blank = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    assert rows_of(compression.classify(blank, other)) == rows_of(compression.classify(docs, labels))


@pytest.mark.parametrize("kinds", ["both", "one", "none"])
def test_scores_of_odd_texts(spark, kinds):
    rng = random.Random(1)
    rows = odd_texts() + [(100 + i, " ".join(rng.choice(("lorem", "ipsum", "dolor", "amet")) for _ in range(80)) if i % 2 else "@@ ## " * rng.randint(40, 90)) for i in range(60)]
    labels = [(i, i % 2, 0, "") for i in range(100, 160)] + [(None, 1, 0, ""), (8, None, 0, ""), (13, 1, 1, ""), (13, 0, 1, "")]
    labels = [r for r in labels if kinds == "both" or kinds == "one" and r[1] == 1]
    docs = frame(spark, rows, clashing=True)
    got = compression.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    if kinds == "both":
        assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] >= 100)
    else:
        assert len({r["score"] for r in got}) == 1
    assert compression.classify(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
