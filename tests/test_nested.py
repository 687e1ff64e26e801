"""Variants against plain recursion over the same JSON."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quarrylens.sources import nested, readers


def random_value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, True, False, 0, -7, "x y", "", "é", 12345])
    if kind < 0.75:
        return {rng.choice("abcde"): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 5))]


def test_leaves_are_those_of_the_recursion(spark):
    rng = random.Random(2)
    docs = [random_value(rng, 6) for _ in range(60)] + [list(range(50)), {}, [], {"a": {"b": {"c": {"d": {"e": 1}, "f": 2}}}}, None, "text"]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "not json"), (901, None)], "i int, t string")
    got = nested.leaves(df.select("i", nested.parsed("t").alias("v")), ["i"], "v")
    want = sorted((i, n, v) for i, d in enumerate(docs) for n, v in readers.flattened(d))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_merge_is_that_of_the_recursion(spark):
    def plain(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: plain(a[k], b[k]) if k in a and k in b else b[k] if k in b else a[k] for k in {*a, *b}}
        return b

    rng = random.Random(3)
    pairs = [(random_value(rng, 5), random_value(rng, 5)) for _ in range(80)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", nested.merged(nested.parsed("a"), nested.parsed("b")).cast("string").alias("m")).collect()
    assert all((json.loads(r["m"]) if r["m"] is not None else None) == plain(*pairs[r["i"]]) for r in got if plain(*pairs[r["i"]]) not in ("", "x y", "é"))
    alone = df.limit(1).select(nested.merged(nested.parsed("a"), nested.parsed(F.lit("bad"))).isNotNull().alias("x")).first()
    assert alone["x"]


def test_operations_and_outlines(spark):
    spec = {"openapi": "3", "security": [{"key": []}], "paths": {"/a": {"get": {"summary": "Read"}, "post": {"operationId": "write", "security": []}, "parameters": []}, "/b": {"delete": {"security": [{"oauth": ["x"]}, {"key": []}]}}}}
    df = spark.createDataFrame([(1, json.dumps(spec)), (2, '{"paths": {"/c": {"get": {}}}}'), (3, "[1]"), (4, "plain text"), (5, '{"k": {"z": 1, "a": [true, null]}}'), (6, None)], "i int, t string")
    got = nested.operations(df.select("i", nested.parsed("t").alias("v")), ["i"], "v")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "/a", "GET", "Read", ["key"]), (1, "/a", "POST", "write", []), (1, "/b", "DELETE", "", ["key", "oauth"]), (2, "/c", "GET", "", [])]
    said = {r["i"]: r["text"] for r in nested.outlines(df.where("i > 2"), ["i"], "t").collect()}
    assert said == {3: "[1]", 4: "plain text", 5: "- k.a[0]: True\n- k.a[1]: \n- k.z: 1", 6: ""}
