"""Vector search in blocks against every query with every item."""

from __future__ import annotations

import math
import random

from quarrylens.operators import retrieval


def test_nearest_in_blocks_is_every_pair(spark, monkeypatch):
    """Copies tie by id, odd vectors meet the rest one by one, and blocks and shares do not show."""
    for name, value in {"QUERIES": 3, "ITEMS": 7, "AT_ONCE": 2}.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(4)
    base = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(8)]
    items = [(i, rng.choice(base), rng.choice(("x", "y", None))) for i in range(60)] + [(60, [0.0] * 5, "x"), (61, [0.5, None, 0.5, 0.5, 0.5], "x"), (62, None, "x")]
    asked = [(i, v) for i, v, _ in items[:8]] + [(60, [0.0] * 5)]
    got = retrieval.nearest(spark.createDataFrame(asked, "query_id bigint, vector array<double>"), spark.createDataFrame(items, "item_id bigint, vector array<double>, domain string"), k=3).collect()
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), 0.0)
    want = set()
    for q, a in asked:
        best: dict = {}
        for i, b, d in items:
            size = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)) if b and None not in b else 0
            raw = max(0.0, dot(a, b) / size) if size else 0.0
            if raw >= 0.25:
                best.setdefault(d, []).append((-raw, i, d))
        first = sorted((x for xs in best.values() for x in sorted(xs, key=lambda x: x[:2])[:3]), key=lambda x: x[:2])[:3]
        want |= {(q, i, d, n + 1) for n, (_, i, d) in enumerate(first)}
    assert {(r["query_id"], r["item_id"], r["domain"], r["place"]) for r in got} == want and len(got) == len(want)
