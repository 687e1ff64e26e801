"""Data-flow graphs: boundaries, quality, rules on flows and stores, threats, and layout.

Components have document, id, name, kind, zone, public, data; flows have document, id, source, target, protocol, auth,
encrypted. Everything is a join of at most two hops, keyed by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import staged
from .locating import named_in
from .similarity import greedy_groups

# Fixed values of the model.
ZONES = ("internet", "partner", "dmz", "application", "data", "internal", "management", "unknown")
UNTRUSTED = ("internet", "partner")
WEAK_AUTH = ("api_key", "password", "shared_secret", "basic")
STORES, AI_KINDS = ("datastore", "vector_db"), ("llm", "agent", "vector_db")
RISK = (("high", "high", "CRITICAL"), ("high", "medium", "HIGH"), ("medium", "high", "HIGH"), ("medium", "medium", "MEDIUM"), ("high", "low", "LOW"), ("low", "high", "MEDIUM"))
STRIDE = (("S", "Spoofing"), ("T", "Tampering"), ("R", "Repudiation"), ("I", "Information disclosure"), ("D", "Denial of service"), ("E", "Elevation of privilege"))
STRIDE_BY_KIND = {"user": "SR", "external": "SR", "datastore": "TRID", "vector_db": "TRID"}
STRIDE_FLOW, STRIDE_PROCESS = "TID", "STRIDE"
LAYERS_BY_KIND = {"llm": ("foundation_model",), "agent": ("agent_framework", "agent_ecosystem"), "vector_db": ("data_operations",)}
STRIDE_WORDS = {"Spoofing": ("authenticat", "impersonat", "credential", "mfa"), "Tampering": ("integrity", "inject", "unsigned", "tamper"), "Repudiation": ("audit", "log"), "Information disclosure": ("encrypt", "cleartext", "expos", "leak", "public"), "Denial of service": ("rate limit", "throttl", "single point", "availability"), "Elevation of privilege": ("privilege", "wildcard", "admin", "authoris", "authoriz")}
STRIDE_BY_RULE = {"NET-MGMT-001": "Information disclosure", "NET-SEG-001": "Elevation of privilege", "APP-AUTH-001": "Spoofing", "APP-DATA-001": "Tampering", "CLD-STOR-001": "Information disclosure", "APP-RES-001": "Denial of service", "SEC-LOG-001": "Repudiation"}
ZONE_WORDS = (("internet", ("internet", "public", "external")), ("dmz", ("dmz", "perimeter", "edge")), ("management", ("management", "admin", "bastion")))
ZONE_BY_DOMAIN = {"network": "internal", "application": "application", "security": "internal", "cloud_data": "data", "general": "unknown"}
ROWS_IN_COLUMN, COLUMN_WIDTH, GAP = 7, 180, 40


def enum(c: Column | str, allowed: tuple[str, ...], default: str) -> Column:
    c = F.lower(F.trim(T.text(c)))
    return F.when(c.isin(list(allowed)), c).otherwise(default)


def with_ends(flows: DataFrame, components: DataFrame) -> DataFrame:
    """Flows with the zone, kind, name and exposure of both ends; an end that is not there is unknown."""
    def side(end: str) -> DataFrame:
        return components.select("document", F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("zone", "kind", "name", "public", "data")])

    both = flows.join(side("source"), ["document", "source"], "left").join(side("target"), ["document", "target"], "left")
    fill = {f"{e}_{c}": "unknown" for e in ("source", "target") for c in ("zone", "kind")}
    return both.fillna(fill).withColumns({f"{e}_name": F.coalesce(f"{e}_name", e) for e in ("source", "target")})


def crosses(a: str = "source_zone", b: str = "target_zone") -> Column:
    return (F.col(a) != F.col(b)) & (F.col(a) != "unknown") & (F.col(b) != "unknown")


def risky() -> Column:
    return (F.col("auth").isin("none", *WEAK_AUTH)) | (F.col("encrypted") == "no")


def dangling(flows: DataFrame, components: DataFrame) -> DataFrame:
    """Flow ends that no component has."""
    ends = flows.select("document", "id", F.explode(F.array("source", "target")).alias("end"))
    return ends.join(components.select("document", F.col("id").alias("end")), ["document", "end"], "left_anti")


def quality(flows: DataFrame, components: DataFrame) -> DataFrame:
    """Warnings about a graph: ends that are missing, components that no flow touches or whose zone is unknown."""
    lost = dangling(flows, components).select("document", F.concat(F.lit("missing end: "), "end").alias("warning"))
    touched = flows.select("document", F.explode(F.array("source", "target")).alias("id")).distinct()
    alone = components.join(touched, ["document", "id"], "left_anti").select("document", F.concat(F.lit("unconnected: "), "id").alias("warning"))
    vague = components.where("zone = 'unknown'").select("document", F.concat(F.lit("no zone: "), "id").alias("warning"))
    return lost.unionByName(alone).unionByName(vague).distinct()


def remove_component(flows: DataFrame, components: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the components of ``gone`` (document, id) and the flows that touch them."""
    ends = [gone.select("document", F.col("id").alias(e)) for e in ("source", "target")]
    return flows.join(ends[0], ["document", "source"], "left_anti").join(ends[1], ["document", "target"], "left_anti"), components.join(gone, ["document", "id"], "left_anti")


def neighbours(flows: DataFrame, element: str, most: int = 12) -> DataFrame:
    out = flows.where(F.col("source") == element).select("document", "id", F.col("target").alias("other"), F.lit("out").alias("way"))
    back = flows.where(F.col("target") == element).select("document", "id", F.col("source").alias("other"), F.lit("in").alias("way"))
    place = F.row_number().over(Window.partitionBy("document").orderBy("way", "id"))
    return out.unionByName(back).withColumn("place", place).where(F.col("place") <= most)


def dedupe_edges(flows: DataFrame, order: str = "seq") -> DataFrame:
    """The first flow between each pair of ends; loops go."""
    first = F.row_number().over(Window.partitionBy("document", "source", "target").orderBy(order))
    return flows.where("source <> target").withColumn("_n", first).where("_n = 1").drop("_n")


def model_findings(flows: DataFrame, components: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """The six rules on a system model, as findings (document, rule_id, severity, issue), each once."""
    f = with_ends(flows, components)
    away, label = F.col("source_zone").isin(list(UNTRUSTED)), F.concat("source_name", F.lit(" → "), "target_name")
    holds = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0

    def row(df: DataFrame, where: Column, rule: str, severity: Column | str, issue: Column) -> DataFrame:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return df.where(where).select("document", F.lit(rule).alias("rule_id"), severity.alias("severity"), issue.alias("issue"))

    parts = [
        row(f, away & (F.col("auth") == "none"), "SM-AUTH-001", "CRITICAL", F.concat(F.lit("Unauthenticated flow from an untrusted source: "), label)),
        row(f, crosses() & (F.col("encrypted") == "no"), "SM-ENC-001", "HIGH", F.concat(F.lit("Cleartext between zones: "), label)),
        row(f, crosses() & F.col("auth").isin(list(WEAK_AUTH)), "SM-AUTH-002", F.when(holds("target_data"), "HIGH").otherwise("MEDIUM"), F.concat(F.lit("Static credentials between zones: "), label)),
        row(f, away & (F.col("target_zone") == "management"), "SM-MGMT-001", "HIGH", F.concat(F.lit("Management reachable from outside: "), label)),
        row(components, F.col("kind").isin(list(STORES)) & F.col("public") & holds("data"), "SM-DATA-001", "CRITICAL", F.concat(F.lit("Public store of sensitive data: "), "name")),
    ]
    if controls is not None:
        weak = controls.where(F.col("status").isin("absent", "weakened")).join(components.select("document", F.col("id").alias("target"), "name", "public", "data"), ["document", "target"])
        parts.append(row(weak, F.col("public") | holds("data"), "SM-CTRL-001", "HIGH", F.concat(F.lit("Control "), "control", F.lit(" is "), "status", F.lit(" on "), "name")))
    return reduce(DataFrame.unionByName, parts).distinct()


def ranked_model_findings(found: DataFrame) -> DataFrame:
    """Findings of the model's rules as the rest of a review takes them: their origin, confidence and place in the document.

    They follow from what a model extracted, hence the confidence of 0.8; the order is severity, rule, issue.
    """
    place = F.row_number().over(Window.partitionBy("document").orderBy(T.severity_rank("severity"), "rule_id", "issue")) - 1
    return found.select(F.col("document").alias("doc_id"), place.cast("bigint").alias("seq"), "rule_id", "severity", "issue", F.lit("model_rules").alias("origin"), F.lit(0.8).alias("confidence"))


def add_components(components: DataFrame, new: DataFrame) -> DataFrame:
    """Components with new ones (document, name, kind, zone); a name that is there already adds nothing, ids stay apart."""
    fresh = new.withColumn("id", T.slug("name")).join(components.select("document", F.col("id")), ["document", "id"], "left_anti").dropDuplicates(["document", "id"])
    return components.unionByName(fresh, allowMissingColumns=True)


def risk_of(likelihood: Column | str, impact: Column | str) -> Column:
    lk, im = T.text(likelihood), T.text(impact)
    out = F.when((lk == "low") & (im == "low"), "LOW")
    for a, b, r in RISK:
        out = out.when((lk == a) & (im == b), r)
    return out.when((lk == "low") | (im == "low"), "LOW").otherwise("MEDIUM")


def rule_threats(flows: DataFrame, components: DataFrame) -> DataFrame:
    """Threats that follow from stated facts alone, on flows that cross a boundary and on public stores."""
    f = with_ends(flows, components).where(crosses())
    label, away = F.concat("source_name", F.lit(" → "), "target_name"), F.col("source_zone").isin(list(UNTRUSTED))

    def threat(df: DataFrame, where: Column, category: str, title: str, likelihood: Column, of: str, name: Column, boundary: Column) -> DataFrame:
        return df.where(where).select("document", F.lit("STRIDE").alias("framework"), F.lit(category).alias("category"), F.lit(of).alias("target_type"), F.col("id").alias("target_id"), name.alias("target_label"), F.lit(title).alias("title"), boundary.alias("boundary"), likelihood.alias("likelihood"), F.lit("high").alias("impact"), risk_of(likelihood, F.lit("high")).alias("risk"), F.lit("rule").alias("source"))

    edge = F.concat("source_zone", F.lit(" → "), "target_zone")
    high, medium = F.lit("high"), F.lit("medium")
    parts = [
        threat(f, F.col("auth") == "none", "Spoofing", "Unauthenticated access across a boundary", high, "flow", label, edge),
        threat(f, F.col("auth").isin(list(WEAK_AUTH)), "Spoofing", "Static credential across a boundary", medium, "flow", label, edge),
        threat(f, F.col("encrypted") == "no", "Information disclosure", "Cleartext across a boundary", F.when(away, "high").otherwise("medium"), "flow", label, edge),
        threat(f, (F.col("target_zone") == "management") & away, "Elevation of privilege", "Management interface reachable from outside", medium, "flow", label, edge),
        threat(components, F.col("kind").isin(list(STORES)) & F.col("public") & (F.size("data") > 0), "Information disclosure", "Public store of sensitive data", high, "component", F.col("name"), F.col("zone")),
    ]
    return reduce(DataFrame.unionByName, parts)


def threat_targets(flows: DataFrame, components: DataFrame, most: int | None = None) -> DataFrame:
    """Elements with the STRIDE categories and layers that apply: boundary flows, what they touch, and AI components."""
    f = with_ends(flows, components).where(crosses())
    by_kind = F.create_map(*[F.lit(x) for kv in STRIDE_BY_KIND.items() for x in kv])
    layers = F.create_map(*[x for k, v in LAYERS_BY_KIND.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    touched = f.select("document", F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_touched", F.lit(True))
    a = f.select("document", F.lit("flow").alias("type"), "id", F.concat("source_name", F.lit(" → "), "target_name").alias("label"), F.lit(STRIDE_FLOW).alias("letters"), F.array().cast("array<string>").alias("layers"), F.when(risky(), 0).otherwise(1).alias("_p"), F.lit(0).alias("_q"))
    c = components.join(touched, ["document", "id"], "left").where(F.col("_touched") | F.col("kind").isin(list(AI_KINDS)))
    first = F.col("public") | (F.size("data") > 0) | F.col("kind").isin(list(AI_KINDS))
    b = c.select("document", F.lit("component").alias("type"), "id", F.col("name").alias("label"), F.coalesce(by_kind[F.col("kind")], F.lit(STRIDE_PROCESS)).alias("letters"), F.coalesce(layers[F.col("kind")], F.array().cast("array<string>")).alias("layers"), F.when(first, 0).otherwise(2).alias("_p"), F.lit(1).alias("_q"))
    place = F.row_number().over(Window.partitionBy("document").orderBy("_p", "_q", "type", "id"))
    out = a.unionByName(b).withColumn("place", place).drop("_p", "_q")
    return out.where(F.col("place") <= most) if most else out


def target_categories(targets: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in STRIDE for x in kv])
    letters = targets.select("document", "type", "id", F.explode(F.split("letters", "")).alias("letter")).where("letter <> ''")
    return letters.select("document", "type", "id", names[F.col("letter")].alias("category"))


def consolidate(threats: DataFrame, threshold: float = 0.35) -> DataFrame:
    """One threat for near-identical ones on an element and category (a rule's suppresses all others), numbered by risk."""
    rows = threats.withColumn("_rule", (F.col("source") != "rule").cast("int")).withColumn("_rank", T.severity_rank("risk")).withColumn("_t", T.long_tokens(F.concat_ws(" ", "title", "description")))
    best = rows.withColumn("_any", F.min("_rule").over(Window.partitionBy("document", "target_id", "category")))
    first = F.row_number().over(Window.partitionBy("document", "target_id", "category").orderBy("_rule", "_rank", "title"))
    ruled = best.where("_any = 0").withColumn("_n", first).where("_n = 1").drop("_n")
    free = greedy_groups(best.where("_any = 1"), ["document", "target_id", "category"], ["_rank", "title"], "_t", threshold).where("place = head").drop("place", "head")
    n = F.row_number().over(Window.partitionBy("document").orderBy("_rank", "framework", "target_label", "category", "title"))
    return ruled.unionByName(free).withColumn("threat_id", F.format_string("T-%03d", n)).drop("_rule", "_rank", "_t", "_any")


def threats_to_findings(threats: DataFrame) -> DataFrame:
    """Findings from rules' threats and from accepted ones."""
    kept = threats.where((F.col("source") == "rule") | (F.col("status") == "accepted"))
    return kept.select(F.col("document").alias("doc_id"), F.concat(F.lit("Threat model: "), "target_label").alias("section"), F.lit("security").alias("domain"), F.col("risk").alias("severity"), F.col("title").alias("issue"), F.lit("threat_model").alias("origin"), F.concat(F.lit("THREAT-"), F.upper(F.regexp_replace("category", r"\W+", "-"))).alias("rule_id"))


def stride_categories(rule_id: Column | str, issue: Column | str) -> Column:
    """A rule's category where it has one, else all whose words the issue has, in order."""
    known = F.create_map(*[F.lit(x) for kv in STRIDE_BY_RULE.items() for x in kv])
    t = F.lower(T.text(issue))
    hits = F.array_compact(F.array(*[F.when(reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in ws]), F.lit(k)) for k, ws in STRIDE_WORDS.items()]))
    own = known[T.text(rule_id)]
    return F.when(own.isNotNull(), F.array(own)).otherwise(hits)


def trust_zone(heading: Column | str, domain: Column | str) -> Column:
    t, out = F.lower(T.text(heading)), None
    for zone, ws in ZONE_WORDS:
        hit = reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in ws])
        out = F.when(hit, zone) if out is None else out.when(hit, zone)
    default = F.create_map(*[F.lit(x) for kv in ZONE_BY_DOMAIN.items() for x in kv])
    return out.otherwise(F.coalesce(default[T.text(domain)], F.lit("unknown")))


def boundary_crossings(rows: DataFrame, keys: list[str], order: str, zone: str) -> DataFrame:
    """Neighbours in order whose zones differ."""
    nxt = F.lead(zone).over(Window.partitionBy(*keys).orderBy(order))
    return rows.select(*keys, F.col(order).alias("at"), F.col(zone).alias("from_zone"), nxt.alias("to_zone")).where("to_zone is not null and from_zone <> to_zone")


def blind_spots(spark: SparkSession, seen: DataFrame, domains: list[str]) -> DataFrame:
    """Domains and categories with nothing observed; both lists are bounded."""
    grid = spark.createDataFrame([(d, c) for d in domains for _, c in STRIDE], "domain string, category string")
    return grid.join(seen.select("domain", "category").distinct(), ["domain", "category"], "left_anti")


def majority_zone(rows: DataFrame, keys: list[str], zone: str, order: str) -> DataFrame:
    """The most frequent zone, of equals the one seen first."""
    n = rows.groupBy(*keys, zone).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(zone, F.struct("n", -F.col("first"))).alias(zone))


def layout(components: DataFrame) -> DataFrame:
    """Places on a canvas: zones side by side in their order, seven components a column."""
    own = Window.partitionBy("document", "zone").orderBy("id")
    at = components.withColumn("_i", F.row_number().over(own) - 1).withColumn("_z", T.zone_rank("zone", ZONES))
    zones = at.groupBy("document", "zone", "_z").agg(F.count(F.lit(1)).alias("_n"))
    width = (F.ceil(F.col("_n") / ROWS_IN_COLUMN) * COLUMN_WIDTH + GAP).cast("bigint")
    left = F.coalesce(F.sum(width).over(Window.partitionBy("document").orderBy("_z", "zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = zones.withColumn("zone_x", left).withColumn("zone_width", width - GAP)
    return at.join(placed.drop("_n", "_z"), ["document", "zone"]).select("document", "zone", "id", (F.col("zone_x") + F.floor(F.col("_i") / ROWS_IN_COLUMN) * COLUMN_WIDTH).cast("bigint").alias("x"), (F.col("_i") % ROWS_IN_COLUMN).alias("row"), "zone_x", "zone_width")


def zone_at(points: DataFrame, zones: DataFrame) -> DataFrame:
    """The zone whose interval holds each point's x, within its document."""
    return points.join(zones, (points["document"] == zones["document"]) & (points["x"] >= zones["zone_x"]) & (points["x"] < zones["zone_x"] + zones["zone_width"]), "left").select(points["*"], zones["zone"])


def canvas_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Elements (document, id, label, x, y) that were added, deleted, renamed or moved."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, (F.col("a.document") == F.col("b.document")) & (F.col("a.id") == F.col("b.id")), "full")
    change = F.when(F.col("a.id").isNull(), "added").when(F.col("b.id").isNull(), "deleted").when(F.col("a.label") != F.col("b.label"), "renamed").when((F.col("a.x") != F.col("b.x")) | (F.col("a.y") != F.col("b.y")), "moved")
    return both.select(F.coalesce("a.document", "b.document").alias("document"), F.coalesce("a.id", "b.id").alias("id"), change.alias("change")).where("change is not null")


def single_points(flows: DataFrame) -> DataFrame:
    """Elements with two links or more that all lead to one neighbour."""
    ends = flows.select("document", F.col("source").alias("id"), F.col("target").alias("other")).unionByName(flows.select("document", F.col("target").alias("id"), F.col("source").alias("other")))
    return ends.groupBy("document", "id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("other").alias("others")).where("links >= 2 and others = 1")


def unique_ids(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Slugs of names, told apart by -2, -3 and so on in order."""
    base = T.slug(name)
    n = F.row_number().over(Window.partitionBy("document", "_base").orderBy(order))
    return rows.withColumn("_base", base).withColumn("id", F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n.cast("string")))).drop("_base")


def upsert_components(mentions: DataFrame) -> DataFrame:
    """One component for all mentions of a name: the first stated zone and kind, exposure if any says so, all data."""
    stated = lambda c, none: F.min_by(F.nullif(F.col(c), F.lit(none)), F.when(F.col(c) != none, F.col("seq")))
    return mentions.groupBy("document", T.alnum_key("name").alias("key")).agg(
        F.min_by("name", "seq").alias("name"), F.coalesce(stated("zone", "unknown"), F.lit("unknown")).alias("zone"), F.coalesce(stated("kind", "other"), F.lit("other")).alias("kind"),
        F.max("public").alias("public"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("data")))).alias("data"),
    )


def facts_for_sections(sections: DataFrame, components: DataFrame, flows: DataFrame, most: int = 12) -> DataFrame:
    """For each section the components that it names (three letters or more) and the flows that touch them."""
    texts = sections.select("doc_id", "index", F.concat_ws(" ", "heading", "body").alias("_text"))
    names = components.where(F.length("name") >= 3).select(F.col("document").alias("doc_id"), F.col("id").alias("component"), "name")
    named = named_in(texts, names, ["doc_id"], ["index"], "_text", "name").select("doc_id", "index", "component", "name")
    ends = flows.select(F.col("document").alias("doc_id"), F.col("id").alias("flow"), F.explode(F.array("source", "target")).alias("component"))
    touching = named.join(ends, ["doc_id", "component"]).select("doc_id", "index", F.concat(F.lit("flow "), "flow").alias("fact"))
    facts = named.select("doc_id", "index", F.concat(F.lit("component "), "name").alias("fact")).unionByName(touching).distinct()
    place = F.row_number().over(Window.partitionBy("doc_id", "index").orderBy("fact"))
    return facts.withColumn("place", place).where(F.col("place") <= most)


def component_risk(components: DataFrame, findings: DataFrame) -> DataFrame:
    """How many findings name a component, as a level: critical from three on."""
    texts = findings.select(F.col("doc_id").alias("document"), F.monotonically_increasing_id().alias("_row"), F.concat_ws(" ", "issue", "evidence_excerpt").alias("_text"))
    hits = named_in(staged(texts), components.select("document", "id", "name"), ["document"], ["_row"], "_text", "name").groupBy("document", "id").agg(F.count(F.lit(1)).alias("n"))
    n = components.select("document", "id").distinct().join(hits, ["document", "id"], "left").fillna(0, ["n"])
    return n.withColumn("level", F.when(F.col("n") >= 3, "critical").when(F.col("n") == 2, "high").when(F.col("n") == 1, "medium").otherwise("low"))


def render_prose(flows: DataFrame, components: DataFrame) -> DataFrame:
    """A paragraph a document: its flows in order."""
    line = F.format_string("%s connects to %s.", "source_name", "target_name")
    return with_ends(flows, components).groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))), lambda x: x["t"]), " ").alias("prose"))
