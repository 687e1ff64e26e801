"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHING = ("key", "id", "set", "_salt", "_key", "_group", "n", "spans", "units", "anchor", "held_out", "kept", "label", "class_id", "_same", "piece", "begin", "score")


def odd_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "ße", "né", "日") for b in ("ra", "sen", "tol", "vin", "x", "q9")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, long = prose(70), prose(6_000)
    near = prose(120).split()
    return [
        (1, prose(80) + " " + shared + " " + prose(30)),
        (2, shared + "\n" + prose(60)),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, shared),
        (7, shared + " "),
        (8, long),
        (9, long[:20_000] + " " + shared + " " + prose(100)),
        (10, " ".join(near)),
        (11, " ".join([*near[:60], "changed", *near[61:]])),
        (12, " ".join(near).replace(" ", "  ")),
        (None, shared + " " + prose(10)),
        (None, prose(55)),
        (13, "one two three " * 60),
        (14, "one two three " * 60),
        (14, "one two three " * 60),
        (15, "!!! ### $$$ " * 30),
        (16, "é \u0085 ￿ <|endoftext|> don't  stop\n\n\tnow 12345"),
        (17, "a" * 30_000),
        (18, "x"),
        (19, prose(64) + "\n" + prose(64)),
        (0, prose(51)),
    ]


def frame(spark: SparkSession, rows: list, clashing: bool = False) -> DataFrame:
    full = [(i, t, "aa" if i is None or i % 2 else None, "src" if i is None or i % 3 else None, None if t is None else len(t)) for i, t in rows]
    docs = spark.createDataFrame(full, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        docs = docs.select(*[F.lit(f"extra {c}").alias(c) for c in CLASHING], "*")
    return docs


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
