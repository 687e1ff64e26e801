"""Logs folded in order: approvals of a document's versions, and sign-offs of a project's uploads.

A log is append-only. Its events, sorted by key and order, stream through tasks that hold one key's state and never its
events; every event comes back with the state after it, or with why it was refused. What is current, which versions were
approved and what was refused are then plain queries over that table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .workflow import latest

# Stages and the decisions that each allows.
STAGE_DECISIONS = {"prelim": ("recommendations_issued", "rejected"), "final": ("approve", "approve_with_risks", "block")}

#: State before an event and the event, to the state after it and why the event is refused (empty if it is not).
Step = Callable[[dict, dict], tuple[dict, str]]


def fold(events: DataFrame, keys: list[str], order: list[str], start: dict, step: Step, state: str) -> DataFrame:
    """``events`` with the state after each (``state`` is its schema) and ``refused``.

    A refused event leaves the state as it is. Events that the order does not tell apart follow a hash of all their columns.
    """
    added = StructType.fromDDL(f"{state}, refused string")
    schema = StructType([*events.schema.fields, *added.fields])
    names, columns, target = added.fieldNames()[:-1], events.columns, [f.dataType for f in added.fields]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for t in target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        now: dict = dict(start)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for event in batch.select(columns).to_pylist():
                own = tuple(event[k] for k in keys)
                if own != at:
                    at, now = own, dict(start)
                after, refused = step(dict(now), event)
                now = now if refused else after
                for column, value in zip(out, [*(now[n] for n in names), refused], strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], schema.names)

    tie = F.xxhash64(*columns)
    dealt = events.withColumn("_tie", tie).repartition(*keys).sortWithinPartitions(*keys, *order, "_tie")
    return dealt.mapInArrow(run, schema)


def _approval(now: dict, event: dict) -> tuple[dict, str]:
    if event["base"] is not None and event["base"] != now["version"]:
        return now, "conflict"
    if event["action"] == "edit":
        return now | {"status": "draft", "edits": now["edits"] + 1}, ""
    if event["action"] == "approve":
        return {"version": now["version"] + 1, "status": "approved", "approved_by": (event["writer"] or "").strip() or "reviewer", "edits": 0}, ""
    return now, "unknown action"


def approvals(events: DataFrame) -> DataFrame:
    """A log of edits and approvals (document, seq, action, writer, base) with version, status, approver and edits since.

    An edit of what is approved makes it a draft again; an approval makes the next version of whatever is there. ``base``
    is the version that a writer saw, or null for one that does not ask: of two who saw the same one, the second to
    approve is refused as a conflict, as is an edit of a version that has gone.
    """
    start = {"version": 0, "status": "draft", "approved_by": "", "edits": 0}
    return fold(events, ["document"], ["seq"], start, _approval, "version int, status string, approved_by string, edits int")


def approved_versions(folded: DataFrame) -> DataFrame:
    """Each approved version, once and for good: when it was approved, and by whom."""
    return folded.where("refused = '' and action = 'approve'").select("document", "version", "seq", "approved_by")


def current(folded: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The state after the last event of each key, whether that was refused or not."""
    return latest(folded, keys, [order])


def refusals(folded: DataFrame) -> DataFrame:
    return folded.where("refused <> ''")


def _signoff(now: dict, event: dict) -> tuple[dict, str]:
    action, stage = event["action"], event["stage"]
    if stage not in STAGE_DECISIONS:
        return now, "unknown stage"
    if action == "register":
        return (now, "") if now["status"] else (now | {"status": "in_review"}, "")
    if action not in ("sign_off", "reopen"):
        return now, "unknown action"
    if not now["status"]:
        return now, "unknown version"
    if action == "reopen":
        return {"status": "in_review", "decision": "", "reviewer": "", "reopened": now["reopened"] + 1}, ""
    if event["asked"] not in STAGE_DECISIONS[stage]:
        return now, "no decision of this stage"
    if not (event["writer"] or "").strip():
        return now, "no reviewer"
    return now | {"status": "signed_off", "decision": event["asked"], "reviewer": event["writer"].strip()}, ""


def sign_offs(events: DataFrame) -> DataFrame:
    """A log of uploads of projects (project_id, stage, sha256, seq, action, decision, writer) with status and decision;
    what was asked for stays as ``asked``.

    Content that a stage has already is not registered anew; a sign-off needs a reviewer, a registered version and a
    decision of its stage; reopening withdraws it.
    """
    start = {"status": "", "decision": "", "reviewer": "", "reopened": 0}
    asked = events.withColumnRenamed("decision", "asked")
    return fold(asked, ["project_id", "stage", "sha256"], ["seq"], start, _signoff, "status string, decision string, reviewer string, reopened int")


#: Names that a batch is told, at most: those of the components that came first.
KNOWN = 60


def _mention(now: dict, event: dict) -> tuple[dict, str]:
    table, key = now["_table"], "".join(c for c in (event["name"] or "").lower() if c.isascii() and c.isalnum())
    if event["batch"] != now["_batch"]:  # what the batches before have found
        now = now | {"_batch": event["batch"], "known": [c["name"] for c in list(table.values())[:KNOWN]]}
    if not (event["name"] or "").strip() or not event["grounded"]:
        return now | {"component": None, "refused": "ungrounded" if (event["name"] or "").strip() else "no name"}, ""
    own = table.get(key)
    if own is None:
        own = {k: event[k] for k in ("zone", "kind", "exposure", "evidence", "section")} | {"name": event["name"].strip(), "number": len(table), "data": []}
        table[key] = own
    if own["zone"] == "unknown":
        own["zone"] = event["zone"]
    if own["exposure"] in ("unknown", "internal") and event["exposure"] in ("public", "partner"):
        own |= {k: event[k] for k in ("exposure", "evidence", "section")}
    if own["kind"] == "other":
        own["kind"] = event["kind"]
    own["data"] = sorted({*own["data"], *(event["data"] or ())})
    return now | {"component": dict(own), "refused": ""}, ""


def mentions_in_order(mentions: DataFrame) -> DataFrame:
    """Mentions of components (document, batch, seq, name, kind, zone, exposure, data, evidence, section, grounded), each
    with its component as it is after it, and with the names that its batch knows from the batches before (``known``).

    A component has the first name it was given and a number from 0 in order of first mention. Later mentions fill an
    unknown zone and another kind; exposure to the public or a partner overrides what is less, with its evidence, and is
    never taken back; data only grow. Mentions that are not grounded or have no name have no component.
    """
    start = {"component": None, "known": [], "why": "", "_batch": None, "_table": None}
    shape = "struct<number:int,name:string,zone:string,kind:string,exposure:string,evidence:string,section:string,data:array<string>>"

    def step(now: dict, event: dict) -> tuple[dict, str]:
        after, _ = _mention(now | {"_table": {} if now["_table"] is None else now["_table"]}, event)
        return after | {"why": after["refused"]}, ""

    out = fold(mentions, ["document"], ["batch", "seq"], start, step, f"component {shape}, known array<string>, why string")
    return out.drop("refused").withColumnRenamed("why", "refused")


def components_in_order(mentions: DataFrame) -> DataFrame:
    """The components of each document after its last mention."""
    seen = mentions_in_order(mentions).where("component is not null").select("document", "batch", "seq", "component.*")
    return latest(seen, ["document", "number"], ["batch", "seq"]).drop("batch", "seq")
