"""Decisions, the review queue, the register and versions: tables of keyed rows, changed by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .similarity import greedy_groups

# Fixed values.
DECISIONS = ("accepted", "disputed")
STATUSES = ("open", "accepted", "disputed", "mitigated")
KIND_DOMAIN = {"user": "security", "external": "security", "web": "application", "api": "application", "service": "application", "datastore": "cloud_data", "vector_db": "cloud_data", "queue": "application", "gateway": "network", "llm": "application", "agent": "application", "admin": "security"}
PRIORITY = {"CRITICAL": "Highest", "HIGH": "High", "MEDIUM": "Medium", "LOW": "Low"}


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate, so that a key with many rows is combined before it moves."""
    own = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*own), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in own])


def dispute_rates(decisions: DataFrame) -> DataFrame:
    """Accepted, disputed and their rate by rule and by origin, over each finding's latest decision (column ``at``)."""
    now = latest(decisions, ["document", "fingerprint"], ["at"])
    keys = F.array_compact(F.array(F.when(T.text("rule_id") != "", F.concat(F.lit("rule:"), "rule_id")), F.concat(F.lit("origin:"), T.text("origin"))))
    rows = now.select(F.explode(keys).alias("key"), "decision")
    out = rows.groupBy("key").agg(F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") == "disputed").alias("disputed"))
    return out.withColumn("dispute_rate", T.half_even(T.ratio(F.col("disputed"), F.col("accepted") + F.col("disputed")), 3))


def dispute_reasons(decisions: DataFrame) -> DataFrame:
    now = latest(decisions, ["document", "fingerprint"], ["at"]).where("decision = 'disputed'")
    return now.groupBy(F.coalesce(F.nullif(T.text("reason"), F.lit("")), F.lit("Other")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def queue_items(findings: DataFrame, decisions: DataFrame, threats: DataFrame, components: DataFrame, flows: DataFrame) -> DataFrame:
    """Findings and threats as items of one queue, with their status, before any merge.

    ``threats`` are those of the latest run of each document, with version and status.
    """
    now = latest(decisions, ["document", "fingerprint"], ["at"]).select(F.col("document").alias("doc_id"), "fingerprint", "decision")
    f = findings.withColumn("fingerprint", T.fingerprint("domain", "section", "rule_id", "issue")).join(now, ["doc_id", "fingerprint"], "left")
    a = f.select("doc_id", F.concat(F.lit("F:"), "fingerprint").alias("key"), F.lit("finding").alias("kind"), "severity", "domain", F.col("issue").alias("title"), F.col("section").alias("place"), F.when(F.col("origin") == "rules_engine", "rule").otherwise("model").alias("source"), F.coalesce("decision", F.lit("open")).alias("status"), "recommendation")
    ends = flows.select("document", F.col("id").alias("target_id"), F.col("target").alias("_c"))
    kinds = components.select("document", F.col("id").alias("_e"), F.col("kind").alias("_kind"))
    known = F.create_map(*[F.lit(x) for kv in KIND_DOMAIN.items() for x in kv])
    t = threats.join(ends, ["document", "target_id"], "left").withColumn("_e", F.coalesce("_c", "target_id")).join(kinds, ["document", "_e"], "left")
    domain = F.when(F.col("_kind").isNull(), "security").otherwise(F.coalesce(known[F.col("_kind")], F.lit("application")))
    b = t.select(F.col("document").alias("doc_id"), F.concat(F.lit("T:"), F.col("version").cast("string"), F.lit("/"), "threat_id").alias("key"), F.lit("threat").alias("kind"), F.col("risk").alias("severity"), domain.alias("domain"), F.concat("title", F.lit(" ["), "framework", F.lit(" · "), "category", F.lit("]")).alias("title"), F.col("target_label").alias("place"), F.when(F.col("source") == "rule", "threat-rule").otherwise("threat-model").alias("source"), F.coalesce("status", F.lit("open")).alias("status"), F.array_join("mitigations", "; ").alias("recommendation"))
    return a.unionByName(b)


def _confirmed() -> Column:
    return F.col("source").isin("rule", "threat-rule")


def merge_queue(items: DataFrame, threshold: float = 0.35) -> DataFrame:
    """One item for a finding and a threat about the same weakness; it takes the other's key and, if open, its status."""
    rows = items.withColumn("_c", (~_confirmed()).cast("int")).withColumn("_rank", T.severity_rank("severity")).withColumn("_t", T.long_tokens(F.concat_ws(" ", "title", "recommendation")))
    grouped = greedy_groups(rows, ["doc_id", "domain"], ["_c", "_rank", "key"], "_t", threshold, differ="kind", least=4)
    own = Window.partitionBy("doc_id", "domain", "head")
    keys = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("place", "key")).over(own)), lambda x: x["place"] != F.col("head")), lambda x: x["key"])
    decided = F.min_by("status", F.when(F.col("status") != "open", F.col("place"))).over(own)
    out = grouped.withColumn("merged", keys).withColumn("_s", decided).where("place = head")
    return out.withColumn("status", F.when(F.col("status") == "open", F.coalesce("_s", F.lit("open"))).otherwise(F.col("status"))).select(*items.columns, "merged")


def queue_order(items: DataFrame) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy((F.col("status") != "open").cast("int"), (~_confirmed()).cast("int"), T.severity_rank("severity"), "domain", "title", "key")
    return items.withColumn("place", F.row_number().over(by))


def apply_decision(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Log entries for every record behind the chosen items (doc_id, key, decision, reason, note)."""
    both = items.select("doc_id", "key", "merged").join(chosen, ["doc_id", "key"])
    each = both.select("doc_id", F.explode(F.concat(F.array("key"), "merged")).alias("key"), "decision", "reason", "note")
    return each.withColumn("ref", F.substring_index("key", ":", -1)).withColumn("kind", F.when(F.col("key").startswith("F:"), "finding").otherwise("threat"))


def register_candidates(items: DataFrame, threshold: float = 0.5, include: str = "accepted") -> DataFrame:
    """What goes on the register: accepted items (with ``confirmed`` also open ones from rules), one a problem."""
    wanted = (F.col("status") == "accepted") | (F.lit(include == "confirmed") & (F.col("status") == "open") & _confirmed())
    rows = items.where(wanted).withColumn("_rank", T.severity_rank("severity")).withColumn("_t", T.long_tokens(F.concat_ws(" ", "title", "recommendation")))
    grouped = greedy_groups(rows, ["doc_id", "domain"], ["_rank", "key"], "_t", threshold, least=4)
    return grouped.where("place = head").select(*items.columns)


def sync_register(register: DataFrame, fresh: DataFrame, owner: str = "doc_id") -> DataFrame:
    """The register (owner, number, source_ref, ...) with what it lacks, numbered on; numbers are never used again."""
    new = fresh.join(register.select(owner, "source_ref"), [owner, "source_ref"], "left_anti")
    last = register.groupBy(owner).agg(F.max("number").alias("_last"))
    n = F.row_number().over(Window.partitionBy(owner).orderBy(T.severity_rank("severity"), "domain", "source_ref"))
    numbered = new.join(last, owner, "left").withColumn("number", (F.coalesce("_last", F.lit(0)) + n).cast("bigint")).drop("_last")
    return register.unionByName(numbered, allowMissingColumns=True).withColumn("record", F.format_string("REC-%03d", "number"))


def register_versions(versions: DataFrame, uploads: DataFrame) -> DataFrame:
    """Versions and the uploads whose content is new to their project and stage, the first of each."""
    new = uploads.join(versions.select("project_id", "stage", "sha256"), ["project_id", "stage", "sha256"], "left_anti")
    first = F.row_number().over(Window.partitionBy("project_id", "stage", "sha256").orderBy("uploaded_at", "filename"))
    made = new.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("review_key", T.review_key("project_id", "stage", "sha256"))
    return versions.unionByName(made, allowMissingColumns=True)


def latest_signed(versions: DataFrame, stage: str = "prelim") -> DataFrame:
    return latest(versions.where((F.col("stage") == stage) & (F.col("signoff.decision").isNotNull())), ["project_id"], ["uploaded_at"])


def export_register(register: DataFrame, names: dict[str, str], values: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The register under a customer's column names and values; specific wording goes before the general."""
    def column(c: str) -> Column:
        base = F.coalesce(F.nullif(T.text(f"{c}_specific"), F.lit("")), F.col(c)) if f"{c}_specific" in register.columns else F.col(c)
        for old, new in ((values or {}).get(c) or {}).items():
            base = F.when(base == old, new).otherwise(base)
        return base

    return register.select(*[column(c).alias(n) for c, n in names.items()])


def issue_rows(threats: DataFrame) -> DataFrame:
    """Threats as rows for an issue tracker; those disputed or mitigated are left out."""
    priority = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    text = F.concat_ws("\n", "description", F.concat(F.lit("Boundary: "), "boundary"), F.concat(F.lit("Mitigations: "), F.array_join("mitigations", "; ")))
    return threats.where(~F.coalesce("status", F.lit("open")).isin("disputed", "mitigated")).select(F.col("title").alias("Summary"), priority[F.col("risk")].alias("Priority"), F.lit("Task").alias("Issue Type"), text.alias("Description"), F.col("category").alias("Labels"))


def audit_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "step").agg(F.count(F.lit(1)).alias("n"))


def scrubbed(c: Column, most: int = 600, items: int = 25) -> Column:
    """An event's detail for display: strings and arrays of strings cut."""
    return F.transform(F.slice(c, 1, items), lambda s: F.substring(s, 1, most))


def batches(rows: DataFrame, keys: list[str], order: str, size: int = 6) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def word_batches(sections: DataFrame, most: int = 700, id_col: str = "doc_id") -> DataFrame:
    """Sections of each document filled in order into batches of at most ``most`` words (a long one stands alone)."""
    rows = F.array_sort(F.collect_list(F.struct("index", T.word_count("body").alias("n"))))
    start = F.struct(F.array().cast("array<struct<index:int,batch:int>>").alias("done"), F.lit(0).alias("batch"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] + x["n"] > most) & (acc["n"] > 0)
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(F.concat(acc["done"], F.array(F.struct(x["index"].cast("int").alias("index"), batch.alias("batch")))).alias("done"), batch.alias("batch"), F.when(full, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"))

    return sections.groupBy(id_col).agg(rows.alias("r")).select(id_col, F.inline(F.aggregate("r", start, step, lambda acc: acc["done"])))
