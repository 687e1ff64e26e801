"""Logs folded in order: what is approved, what is reopened, what is refused."""

from __future__ import annotations

import random

from quarrylens.operators import folds

LOG = "document string, seq int, action string, writer string, base int"


def test_edits_reopen_and_stale_writers_are_refused(spark):
    log = [("a", 1, "edit", "x", 0), ("a", 2, "approve", " Ann ", 0), ("a", 3, "approve", "Bob", 0), ("a", 4, "edit", "x", 1), ("a", 5, "edit", "y", None), ("a", 6, "approve", None, 1), ("a", 7, "edit", "y", 1), ("a", 8, "erase", "y", None), ("b", 1, "approve", "", None), ("b", 2, "approve", "Cy", 1)]
    random.Random(1).shuffle(log)
    folded = folds.approvals(spark.createDataFrame(log, LOG))
    got = {(r["document"], r["seq"]): (r["version"], r["status"], r["edits"], r["refused"]) for r in folded.collect()}
    assert got == {
        ("a", 1): (0, "draft", 1, ""), ("a", 2): (1, "approved", 0, ""), ("a", 3): (1, "approved", 0, "conflict"), ("a", 4): (1, "draft", 1, ""), ("a", 5): (1, "draft", 2, ""),
        ("a", 6): (2, "approved", 0, ""), ("a", 7): (2, "approved", 0, "conflict"), ("a", 8): (2, "approved", 0, "unknown action"), ("b", 1): (1, "approved", 0, ""), ("b", 2): (2, "approved", 0, ""),
    }
    versions = {(r["document"], r["version"]): (r["seq"], r["approved_by"]) for r in folds.approved_versions(folded).collect()}
    assert versions == {("a", 1): (2, "Ann"), ("a", 2): (6, "reviewer"), ("b", 1): (1, "reviewer"), ("b", 2): (2, "Cy")}
    assert {r["document"]: (r["version"], r["status"]) for r in folds.current(folded, ["document"]).collect()} == {"a": (2, "approved"), "b": (2, "approved")}
    assert sorted((r["document"], r["seq"]) for r in folds.refusals(folded).collect()) == [("a", 3), ("a", 7), ("a", 8)]


def test_one_long_log_and_none(spark):
    rows = [("one", i, "approve" if i % 10 == 0 else "edit", "w", None) for i in range(25_000)]
    last = folds.current(folds.approvals(spark.createDataFrame(rows, LOG)), ["document"]).first()
    assert (last["version"], last["status"], last["edits"]) == (2_500, "draft", 9)
    assert folds.approvals(spark.createDataFrame([], LOG)).count() == 0


def test_sign_offs_of_uploads(spark):
    schema = "project_id string, stage string, sha256 string, seq int, action string, decision string, writer string"
    log = [
        ("p", "prelim", "s1", 1, "sign_off", "rejected", "Ann"), ("p", "prelim", "s1", 2, "register", None, None), ("p", "prelim", "s1", 3, "register", None, None), ("p", "prelim", "s1", 4, "sign_off", "approve", "Ann"),
        ("p", "prelim", "s1", 5, "sign_off", "recommendations_issued", " "), ("p", "prelim", "s1", 6, "sign_off", "recommendations_issued", " Ann "), ("p", "prelim", "s1", 7, "reopen", None, None),
        ("p", "final", "s1", 8, "register", None, None), ("p", "final", "s1", 9, "sign_off", "block", "Bob"), ("p", "draft", "s1", 10, "register", None, None), ("p", "final", "s1", 11, "sing", None, "Bob"),
    ]
    got = {r["seq"]: (r["status"], r["decision"], r["reviewer"], r["refused"]) for r in folds.sign_offs(spark.createDataFrame(log, schema)).collect()}
    assert got == {
        1: ("", "", "", "unknown version"), 2: ("in_review", "", "", ""), 3: ("in_review", "", "", ""), 4: ("in_review", "", "", "no decision of this stage"), 5: ("in_review", "", "", "no reviewer"),
        6: ("signed_off", "recommendations_issued", "Ann", ""), 7: ("in_review", "", "", ""), 8: ("in_review", "", "", ""), 9: ("signed_off", "block", "Bob", ""), 10: ("", "", "", "unknown stage"), 11: ("signed_off", "block", "Bob", "unknown action"),
    }


def test_components_carry_what_batches_before_found(spark):
    rng = random.Random(7)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick("a", "b"), pick(1, 2, 3), i, pick("Web App", "web-app", "DB", "Queue ", "", None), pick("other", "web", "store"), pick("unknown", "dmz", "core"), pick("unknown", "internal", "public", "partner"), pick([], ["pii"], ["card", "pii"], None), f"e{i}", f"s{i}", rng.random() > 0.2) for i in range(120)]
    schema = "document string, batch int, seq int, name string, kind string, zone string, exposure string, data array<string>, evidence string, section string, grounded boolean"
    want, known = {}, {}
    for d in "ab":
        table = {}
        for b in (1, 2, 3):
            known[d, b] = [c["name"] for c in table.values()]
            for _, _, _, name, kind, zone, exposure, data, evidence, section, grounded in sorted(r for r in rows if r[:2] == (d, b)):
                if not (name or "").strip() or not grounded:
                    continue
                c = table.setdefault("".join(x for x in name.lower() if x.isalnum()), {"number": len(table), "name": name.strip(), "zone": zone, "kind": kind, "exposure": exposure, "evidence": evidence, "section": section, "data": set()})
                c["zone"] = zone if c["zone"] == "unknown" else c["zone"]
                c["kind"] = kind if c["kind"] == "other" else c["kind"]
                if c["exposure"] in ("unknown", "internal") and exposure in ("public", "partner"):
                    c.update(exposure=exposure, evidence=evidence, section=section)
                c["data"] |= set(data or ())
        want |= {(d, c["number"]): (c["name"], c["zone"], c["kind"], c["exposure"], c["evidence"], c["section"], sorted(c["data"])) for c in table.values()}
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), schema).repartition(3)
    got = folds.components_in_order(shuffled).collect()
    assert {(r["document"], r["number"]): (r["name"], r["zone"], r["kind"], r["exposure"], r["evidence"], r["section"], r["data"]) for r in got} == want
    for r in folds.mentions_in_order(shuffled).collect():
        assert r["known"] == known[r["document"], r["batch"]] and (r["component"] is None) == bool(r["refused"])
