"""All registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dataflow, evaluation, extraction, findings, folds, locating, resumable, retrieval, rules, scoring, sections, skills, workflow
from .plans import review, rule_catalogue
from .plans.topics import DOMAINS
from .sinks import writers
from .sinks.collection import Collection
from .sources import nested, readers
from .staging import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to findings to a status: split, classify, scan, deduplicate, score."""
    return review.statuses(review.review(table(spark, sf_dir, "documents").select("doc_id", "text")))


# Events as findings: a user is a document, a type's events are one problem, and values set the severity.
EVENT_SEVERITY = "CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 100 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' ELSE 'LOW' END"


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return findings.as_findings(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.concat(F.lit("section "), "event_type").alias("section"), F.lit("security").alias("domain"), F.expr(EVENT_SEVERITY).alias("severity"), F.concat(F.lit("issue of "), "event_type").alias("issue"), F.when(F.col("event_id") % 3 == 0, "rules_engine").otherwise("agent").alias("origin"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("rule_id"), F.when(F.col("event_id") % 5 == 0, "ref").otherwise("").alias("standard_reference"), F.lit("kb").alias("kb_source"), F.when(F.col("event_id") % 7 == 0, "CONFIRMED").otherwise("").alias("verifier_status")))


EVENT_SQL = f"""WITH f AS (SELECT user_id AS doc_id, event_id AS seq, 'section ' || event_type AS section, 'security' AS domain, {EVENT_SEVERITY} AS severity,
 'issue of ' || event_type AS issue, CASE WHEN event_id % 3 = 0 THEN 'rules_engine' ELSE 'agent' END AS origin, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS rule_id,
 event_id % 5 = 0 AS grounded, CASE WHEN event_id % 7 = 0 THEN 'CONFIRMED' ELSE '' END AS verifier_status FROM events),
g AS (SELECT *, origin = 'rules_engine' OR verifier_status = 'CONFIRMED' AS confirmed, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS rnk,
 CASE WHEN rule_id <> '' THEN rule_id ELSE domain || ':' || lower(issue)[:80] END AS problem FROM f)"""


@query()
def review_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "section", "rule_id", "severity", "kind", "evidence_excerpt", "evidence_grounded")


@query()
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query()
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.split_sections(table(spark, sf_dir, "documents").select("doc_id", "text"))


SECRET = [r"\bakia[0-9a-z]{16}\b", r"\b(?:password|passwd|pwd)\s*[=:]\s*[a-z0-9]{6,}", r"\btoken\s*=\s*.?[a-z0-9]{16,}"]


@query(f"""SELECT doc_id, p AS pattern FROM documents CROSS JOIN (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(SECRET))}) v(p, r) WHERE regexp_matches(text, r, 'i')""")
def rule_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule engine with three rules of its own, each document one section."""
    own = [rule_catalogue.Rule(str(i), "security", "HIGH", "A secret is written out.", soft=(p,)) for i, p in enumerate(SECRET)]
    one = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("index"), F.lit("").alias("heading"), F.col("text").alias("body"), F.lit("context_scope").alias("topic"), F.array().cast("array<string>").alias("secondary_topics"))
    return rules.run_rules(one, rules=own).select("doc_id", F.col("rule_id").cast("int").alias("pattern"))


@query(r"""WITH m AS (SELECT doc_id, text, regexp_extract(text, 'token = .[0-9a-f]+') AS hit FROM documents), a AS (SELECT doc_id, text, hit, strpos(text, hit) AS pos FROM m WHERE hit <> ''),
b AS (SELECT *, greatest(pos - 110, 1) AS s, least(pos + length(hit) - 1 + 110, length(text)) AS e FROM a)
SELECT doc_id, (CASE WHEN s > 1 THEN '...' ELSE '' END) || trim(regexp_replace(substr(text, s, e - s + 1), '\s+', ' ', 'g')) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) AS excerpt FROM b""")
def rule_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.match_excerpt("text", F.lit("token = .[0-9a-f]+")).alias("excerpt")).where("excerpt <> ''")


STEM_SQL = "CASE " + " ".join(f"WHEN length(w) > {len(s) + 2} AND ends_with(w, '{s}') THEN left(w, length(w) - {len(s)})" for s in T.SUFFIXES) + " ELSE w END"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH d AS (SELECT doc_id, text AS issue FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(issue), '[a-z0-9]+')) AS w FROM d),
s AS (SELECT doc_id, {STEM_SQL} AS c FROM w WHERE length(w) > 2 AND w NOT IN ({STOP_SQL})), t AS (SELECT DISTINCT doc_id, CASE WHEN length(c) > 4 AND ends_with(c, 'e') THEN left(c, length(c) - 1) ELSE c END AS t FROM s),
r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY t) AS n FROM t), k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY t) AS k FROM r WHERE n <= 12 GROUP BY doc_id)
SELECT d.doc_id, sha1(coalesce(k, ''))[:12] AS semantic_key, sha256('security|wholedocument|' || sha1(coalesce(k, ''))[:12])[:16] AS fingerprint FROM d LEFT JOIN k USING (doc_id)""")
def finding_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("issue"))
    return d.select("doc_id", T.semantic_key("issue").alias("semantic_key"), T.fingerprint(F.lit("Security "), F.lit("Whole document"), F.lit(""), "issue").alias("fingerprint"))


@query(EVENT_SQL + """ SELECT doc_id, seq, severity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section, problem ORDER BY grounded DESC, rnk, (origin = 'rules_engine') DESC, seq) AS n FROM g) WHERE n = 1""")
def dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.dedupe(event_findings(spark, sf_dir)).select("doc_id", "seq", "severity")


TOPIC_SQL_ROWS = ", ".join(f"({i}, '{t.key}', '{t.domain}', '{k}')" for i, t in enumerate(sections.TOPICS) for k in t.keywords)
TOPIC_SQL = f"""WITH d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') AS b FROM documents), s AS (SELECT doc_id, ord, topic, domain, CAST(sum(least(CAST((length(b) - length(replace(b, kw, ''))) / length(kw) AS INTEGER), 4)) AS DOUBLE) AS score
 FROM d CROSS JOIN (VALUES {TOPIC_SQL_ROWS}) v(ord, topic, domain, kw) GROUP BY ALL HAVING sum(least(CAST((length(b) - length(replace(b, kw, ''))) / length(kw) AS INTEGER), 4)) > 0)"""


@query(TOPIC_SQL + " SELECT doc_id, ord, topic, domain, score FROM s")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.score_topics(table(spark, sf_dir, "documents"), ["doc_id"], F.lit(""), F.col("text"))


@query(TOPIC_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS n, max(score) OVER (PARTITION BY doc_id) AS top FROM s)
SELECT d.doc_id, coalesce(max(CASE WHEN n = 1 THEN domain END), 'general') AS domain, coalesce(max(CASE WHEN n = 1 THEN topic END), 'context_scope') AS topic,
coalesce(string_agg(topic, ',' ORDER BY n) FILTER (n BETWEEN 2 AND 5 AND score >= top * 0.5), '') AS secondary, CAST(round(1000 * coalesce(round_even(max(top) / sum(score), 3), 0)) AS BIGINT) AS confidence_permille FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.classify(table(spark, sf_dir, "documents"), ["doc_id"], F.lit(""), F.col("text"))
    return found.select("doc_id", "domain", "topic", F.array_join("secondary_topics", ",").alias("secondary"), F.round(F.col("topic_confidence") * 1000).cast("bigint").alias("confidence_permille"))


@query(r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS INTEGER) AS total_words,
CAST(len(regexp_extract_all(lower(text), '\bminutes\b')) AS INTEGER) AS minutes FROM documents""")
def guardrail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.word_count("text").alias("total_words"), F.regexp_count(F.lower("text"), F.lit(r"\bminutes\b")).alias("minutes"))


@query()
def assess_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.assess_scope(table(spark, sf_dir, "documents"))


CRITERIA_SQL = ", ".join("('{}', '{}')".format(c.key, "|".join(f"(?:{p})" for p in c.patterns)) for c in sections.CRITERIA)


@query(f"SELECT doc_id, k AS missing FROM documents CROSS JOIN (VALUES {CRITERIA_SQL}) v(k, p) WHERE NOT regexp_matches(coalesce(text, ''), p, 'i')")
def completeness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.completeness(table(spark, sf_dir, "documents")).select("doc_id", F.explode("missing").alias("missing"))


WORDS_SQL = r"list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 220) / 180.0) AS BIGINT), 0) + 1)) AS i FROM d WHERE len(w) > 220)
SELECT doc_id, CAST(i AS INTEGER) AS n, md5(array_to_string(list_slice(w, i * 180 + 1, i * 180 + 220), ' ')) AS piece_md5 FROM s
UNION ALL SELECT doc_id, 0, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) FROM documents JOIN d USING (doc_id) WHERE len(w) BETWEEN 1 AND 220""")
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(sections.windows("text")).alias("n", "piece")).select("doc_id", "n", F.md5("piece").alias("piece_md5"))


@query("SELECT doc_id, sha1('general|' || source || '||' || doc_id || '|' || substr(text, 1, 80))[:20] AS chunk_id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.chunk_id(F.lit("general"), "source", F.lit(""), "doc_id", "text").alias("chunk_id"))


@query()
def chunk_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), F.lit("general").alias("domain"), "text")
    return sections.chunk_clauses(d).select("chunk_id", "source", "clause", "ordinal")


NORM_SQL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH b AS (SELECT item_id, string_split({NORM_SQL.format("text")}, ' ') AS w FROM benchmark), g AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 5), ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM b WHERE len(w) >= 6)),
d AS (SELECT doc_id, string_split({NORM_SQL.format("text")}, ' ') AS w FROM documents), h AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 5), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 6))
SELECT DISTINCT item_id, doc_id FROM g JOIN h USING (run)""")
def evidence_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage and every document that shares a run of six words with it."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return retrieval.grounded_pairs(quotes, table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS item_id, label AS domain, greatest(0.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))) AS raw FROM q CROSS JOIN embeddings),
t AS (SELECT * FROM s WHERE raw >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id, domain ORDER BY raw DESC, item_id) <= 4) SELECT query_id, item_id, domain, CAST(round(raw * 10000) AS BIGINT) AS similarity_e4, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, item_id) AS INTEGER) AS place FROM t QUALIFY place <= 4""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").alias("domain"))
    return retrieval.nearest(asked, items).select("query_id", "item_id", "domain", F.round(F.col("similarity") * 10000).cast("bigint").alias("similarity_e4"), "place")


@query(EVENT_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, problem ORDER BY (NOT confirmed), rnk, seq) AS nth FROM g), s AS (SELECT doc_id, count(*) AS n_findings,
 sum((CASE severity WHEN 'CRITICAL' THEN 40.0 WHEN 'HIGH' THEN 15.0 WHEN 'MEDIUM' THEN 5.0 ELSE 1.0 END) * (CASE WHEN confirmed THEN 1.0 ELSE 0.25 END) * (CASE WHEN nth > 1 THEN 0.2 ELSE 1.0 END))::DOUBLE AS raw,
 bool_or(confirmed AND rnk = 0) AS c, bool_or(confirmed AND rnk <= 1) AS h, bool_or(rnk <= 1) AS a FROM o GROUP BY doc_id), t AS (SELECT *, round(least(100.0, 100 * (1 - exp(-raw / 120))), 1) AS score FROM s)
SELECT doc_id, n_findings, CAST(round(score * 10) AS BIGINT) AS score_tenths, CASE WHEN c THEN 'RED' WHEN score >= 40 AND h THEN 'RED' WHEN score >= 12 OR a THEN 'AMBER' ELSE 'GREEN' END AS status FROM t""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.risk(event_findings(spark, sf_dir), ["doc_id"]).select("doc_id", "n_findings", F.round(F.col("score") * 10).cast("bigint").alias("score_tenths"), "status")


@query(EVENT_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, problem ORDER BY rnk, (NOT grounded), seq) > 1 AS again FROM g)
SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY again, rnk, (NOT grounded), seq) AS INTEGER) AS priority FROM k QUALIFY priority <= 3""")
def priority_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.priority_actions(event_findings(spark, sf_dir)).select("doc_id", "seq", "priority")


@query(EVENT_SQL + """ SELECT doc_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM f GROUP BY doc_id""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_counts(event_findings(spark, sf_dir), ["doc_id"])


@query("""SELECT s AS severity, count(e.event_id) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) v(s) LEFT JOIN (SELECT event_id, """ + EVENT_SEVERITY + """ AS severity FROM events) e ON e.severity = s GROUP BY s""")
def severity_counts_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.expr(EVENT_SEVERITY).alias("severity"))
    return scoring.zero_filled(e, "severity", [*T.SEVERITIES, "INFO"])  # no event has the last


@query("""SELECT k AS nation, CAST(sum(s) AS BIGINT) AS sections, CAST(sum(f) AS BIGINT) AS findings, CAST(sum(c) AS BIGINT) AS critical FROM (SELECT c_nationkey AS k, 1 AS s, 0 AS f, 0 AS c FROM customer UNION ALL
SELECT s_nationkey, 0, 1, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END FROM supplier) GROUP BY k""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") < 0, "CRITICAL").otherwise("LOW").alias("severity"))
    return scoring.coverage(c, s, ["nation"])


@query("""WITH m AS (SELECT median(epoch_us(ts)) AS m FROM events), a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'resolved' ELSE 'persisting' END AS state
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def diff_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return findings.diff_runs(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return workflow.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


DECISION_SQL = """WITH l AS (SELECT user_id AS document, event_type AS fingerprint, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL), d AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'disputed' ELSE 'accepted' END AS decision, 'rule:' || fingerprint AS a, 'origin:' || (event_id % 2) AS b FROM l)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("document"), F.col("event_type").alias("fingerprint"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("rule_id"), (F.col("event_id") % 2).cast("string").alias("origin"), F.when(F.col("event_id") % 3 == 0, "disputed").otherwise("accepted").alias("decision"), F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("reason"))


@query(DECISION_SQL + """ SELECT k AS key, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'disputed') AS disputed, CAST(round(1000 * round_even(count(*) FILTER (decision = 'disputed') / count(*), 3)) AS BIGINT) AS dispute_permille FROM (SELECT decision, a AS k FROM d UNION ALL SELECT decision, b FROM d) GROUP BY k""")
def dispute_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.dispute_rates(_decisions(spark, sf_dir)).withColumn("dispute_permille", F.round(F.col("dispute_rate") * 1000).cast("bigint")).drop("dispute_rate")


@query("""SELECT conv_id, turn AS at, role AS from_zone, nxt AS to_zone FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL AND role <> nxt""")
def boundary_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.boundary_crossings(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


@query("""SELECT o_orderkey, l_linenumber, c.n_regionkey AS from_region, s.n_regionkey AS to_region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey WHERE c.n_regionkey <> s.n_regionkey""")
def cross_zone_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flows from a customer's region to a supplier's: dimensions join, then the boundary filter."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    buyers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("from_region"))
    sellers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("to_region"))
    flows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = flows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    zones = both.withColumns({c: F.col(c).cast("string") for c in ("from_region", "to_region")})
    return zones.where(dataflow.crosses("from_region", "to_region")).select("o_orderkey", "l_linenumber", F.col("from_region").cast(nation.schema["n_regionkey"].dataType).alias("from_region"), F.col("to_region").cast(nation.schema["n_regionkey"].dataType).alias("to_region"))


@query("SELECT event_type, user_id % 7 AS bucket, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 7)")
def stride_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.matrix(table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 7).alias("bucket")), "event_type", "bucket")


STRIDE_SQL = ", ".join(f"('{c}')" for _, c in dataflow.STRIDE)


@query(f"""SELECT d AS domain, c AS category FROM (VALUES {", ".join(f"('{d}')" for d in DOMAINS)}) a(d) CROSS JOIN (VALUES {STRIDE_SQL}) b(c) WHERE NOT EXISTS (SELECT 1 FROM labels WHERE CASE doc_id % 4 WHEN 0 THEN 'network' WHEN 1 THEN 'application' ELSE 'security' END = d AND CASE WHEN toxic = 1 THEN 'Spoofing' ELSE 'Tampering' END = c)""")
def blind_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "labels").select(F.expr("CASE doc_id % 4 WHEN 0 THEN 'network' WHEN 1 THEN 'application' ELSE 'security' END").alias("domain"), F.when(F.col("toxic") == 1, "Spoofing").otherwise("Tampering").alias("category"))
    return dataflow.blind_spots(spark, seen, list(DOMAINS))


@query("""WITH e AS (SELECT doc_id, unnest(['doc:' || doc_id, 'src:' || source]) AS "end" FROM documents), c AS (SELECT 'doc:' || doc_id AS "end" FROM labels UNION SELECT 'src:' || source FROM documents JOIN labels USING (doc_id))
SELECT doc_id, "end" FROM e ANTI JOIN c USING ("end")""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flows from themselves to their sources, where only labelled ones are components."""
    named = [F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.concat(F.lit("src:"), "source")]
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("document"), F.col("doc_id").alias("id"), named[0].alias("source"), named[1].alias("target"))
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.lit("d").alias("document"), F.explode(F.array(*named)).alias("id")).distinct()
    return dataflow.dangling(d, known).select(F.col("id").alias("doc_id"), "end")


@query("""WITH i AS (SELECT s_nationkey, s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS ref, CASE WHEN s_acctbal < 0 THEN 0 ELSE 3 END AS rnk FROM supplier)
SELECT s_suppkey, s_nationkey, 'REC-' || lpad(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY rnk, ref) AS VARCHAR), 3, '0') AS record FROM i""")
def register_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers go on an empty register of their nation, those with debts first."""
    s = table(spark, sf_dir, "supplier")
    fresh = s.select("s_suppkey", F.col("s_nationkey").alias("doc_id"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("source_ref"), F.when(F.col("s_acctbal") < 0, "CRITICAL").otherwise("LOW").alias("severity"), F.lit("security").alias("domain"))
    empty = fresh.where(F.lit(False)).withColumn("number", F.lit(0).cast("bigint"))
    return workflow.sync_register(empty, fresh).select("s_suppkey", F.col("doc_id").alias("s_nationkey"), "record")


@query(EVENT_SQL + " SELECT doc_id, seq FROM g WHERE rnk <= 1 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.section = 'section error' AND h.section = g.section AND h.rule_id = g.rule_id)")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_findings(spark, sf_dir)
    known = findings.fingerprints(f.where("section = 'section error'"))
    return findings.gate(f, known).select("doc_id", "seq")


@query("""WITH n AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels)
SELECT tp, fp, fn, tn, CAST(round(1e6 * tp / (tp + fp)) AS BIGINT) AS precision_ppm, CAST(round(1e6 * tp / (tp + fn)) AS BIGINT) AS recall_ppm FROM n""")
def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("clean"))
    return evaluation.confusion(rows, "quality", "clean").select("tp", "fp", "fn", "tn", F.round(F.col("precision") * 1e6).cast("bigint").alias("precision_ppm"), F.round(F.col("recall") * 1e6).cast("bigint").alias("recall_ppm"))


@query("""WITH n AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same, sum(quality) AS q, sum(toxic) AS t FROM labels), p AS (SELECT n, same / n AS po, (q * t + (n - q) * (n - t)) / (n::DOUBLE * n) AS pe FROM n)
SELECT CAST(n AS BIGINT) AS n, CAST(round(1e6 * (po - pe) / (1 - pe)) AS BIGINT) AS kappa_ppm FROM p""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.kappa(table(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round(F.col("kappa") * 1e6).cast("bigint").alias("kappa_ppm"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</(?:div|p|li)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS label_md5 FROM pages""")
def clean_html_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_label("html")).alias("label_md5"))


@query("SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events WHERE props IS NOT NULL")
def props_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(readers.flat_properties(F.col("props"))).alias("x")).select("event_id", F.col("x.key").alias("name"), F.col("x.value").alias("value"))


@query(EVENT_SQL + """ SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rnk, domain, section, issue, seq) AS INTEGER) AS place FROM g""")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.ordered(event_findings(spark, sf_dir)).select("doc_id", "seq", "place")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 3))) AS w FROM conversations), r AS (SELECT min(id) AS id, w FROM t WHERE len(w) > 0 GROUP BY w)
SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) >= 0.15 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""")
def similar_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with similar words, one turn for each set of words."""
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.long_tokens("text").alias("w"))
    return findings.similar_pairs(t, "id", "w", 0.15)


STEPS = (skills.Step("secrets", 1, r"token = .[0-9a-f]+", "A token is written out.", "HIGH"), skills.Step("secrets", 2, r"\b[a-z]{2}\w*ing\b", "A word in -ing."))


@query(f"""WITH s(step, p) AS (VALUES {", ".join(f"({s.step}, '{s.pattern}')" for s in STEPS)}), h AS (SELECT doc_id, step, regexp_extract_all(lower(text), p) AS found FROM documents CROSS JOIN s)
SELECT doc_id, step, CAST(unnest(range(1, len(found) + 1)) AS INTEGER) AS "match", unnest(found) AS hit FROM h""")
def skill_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of two steps in every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("index"), F.lower("text").alias("body"))
    return skills.all_matches(d, STEPS).select("doc_id", "step", "match", "hit")


@query()
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for every user's events."""
    f = event_findings(spark, sf_dir)
    return writers.markdown_reports(findings.ordered(f), scoring.risk(f, ["doc_id"]), f.select("doc_id", "domain"))


@query()
def document_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents name as components, and how often."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("index"), F.col("text").alias("body"))
    return extraction.components(d)


MERGE_SQL = f"""WITH RECURSIVE w AS (SELECT conv_id AS doc_id, turn AS seq, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
s AS (SELECT doc_id, seq, {STEM_SQL} AS c FROM w WHERE length(w) > 2 AND w NOT IN ({STOP_SQL})), t AS (SELECT doc_id, seq, list(DISTINCT CASE WHEN length(c) > 4 AND ends_with(c, 'e') THEN left(c, length(c) - 1) ELSE c END) AS w FROM s GROUP BY ALL),
r AS (SELECT conv_id AS doc_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, coalesce(t.w, []) AS w FROM conversations c LEFT JOIN t ON t.doc_id = conv_id AND t.seq = turn),
g AS (SELECT doc_id, seq, place, place AS head, CASE WHEN len(w) > 0 THEN [{{'p': place, 'w': w}}] ELSE [] END AS heads FROM r WHERE place = 0
 UNION ALL SELECT doc_id, seq, place, CASE WHEN len(w) > 0 AND len(near) > 0 THEN near[1].p ELSE place END, CASE WHEN len(w) = 0 OR len(near) > 0 THEN heads ELSE list_append(heads, {{'p': place, 'w': w}}) END
 FROM (SELECT r.*, heads, list_filter(heads, lambda h: len(list_intersect(h.w, r.w)) >= 0.4::DOUBLE * (len(h.w) + len(r.w) - len(list_intersect(h.w, r.w)))) AS near FROM g JOIN r ON r.doc_id = g.doc_id AND r.place = g.place + 1))
SELECT doc_id, min(seq) AS seq, list_sort(list_filter(list(DISTINCT 'turn ' || seq), lambda x: x <> 'turn ' || min(seq))) AS also_in FROM g GROUP BY doc_id, head"""


@query(MERGE_SQL)
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    f = findings.as_findings(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("section"), F.lit("security").alias("domain"), F.lit("HIGH").alias("severity"), F.col("text").alias("issue"), F.lit("agent").alias("origin")))
    return findings.merge_duplicates(f).select("doc_id", "seq", "also_in")


@query(MERGE_SQL.replace("FROM conversations", "FROM turns").replace("FROM conversations c", "FROM turns c").replace("WITH RECURSIVE w AS", "WITH RECURSIVE turns AS (SELECT turn AS conv_id, conv_id AS turn, text FROM conversations), w AS"))
def merge_across_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns at one place of all conversations as the findings of one document: few blocks, each as large as the table."""
    c = table(spark, sf_dir, "conversations")
    f = findings.as_findings(c.select(F.col("turn").alias("doc_id"), F.col("conv_id").alias("seq"), F.concat(F.lit("turn "), F.col("conv_id").cast("string")).alias("section"), F.lit("security").alias("domain"), F.lit("HIGH").alias("severity"), F.col("text").alias("issue"), F.lit("agent").alias("origin")))
    return findings.merge_duplicates(f).select("doc_id", "seq", "also_in")


@query("SELECT role, conv_id % 5 AS bucket, count(*) AS n FROM conversations GROUP BY GROUPING SETS ((role), (conv_id % 5), ())")
def grouped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") % 5).alias("bucket"))
    return scoring.counted(c, ["role", "bucket"])


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS excerpt, substr(regexp_replace(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt("text").alias("excerpt"), T.slug(F.concat("source", F.lit(" / "), "lang")).alias("slug"), T.html_escape("text").alias("escaped"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS i FROM customer), z AS (SELECT c_nationkey, CAST(ceil(count(*) / 7.0) AS BIGINT) * 180 + 40 AS w FROM customer GROUP BY 1),
x AS (SELECT c_nationkey, w, coalesce(sum(w) OVER (ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS zx FROM z) SELECT c_custkey AS id, CAST(zx + (i // 7) * 180 AS BIGINT) AS x, CAST(i % 7 AS INTEGER) AS "row" FROM r JOIN x USING (c_nationkey)""")
def canvas_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers laid out by nation: the cumulative offset runs over one row a zone, not over the components."""
    c = table(spark, sf_dir, "customer").select(F.lit("d").alias("document"), F.col("c_custkey").alias("id"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("zone"))
    return dataflow.layout(c).select("id", "x", F.col("row").cast("int").alias("row"))


@query("""WITH e AS (SELECT 'c' || o_custkey AS id, 'p' || o_orderpriority AS other FROM orders UNION ALL SELECT 'p' || o_orderpriority, 'c' || o_custkey FROM orders)
SELECT id, count(*) AS links FROM e GROUP BY id HAVING count(*) >= 2 AND count(DISTINCT other) = 1""")
def single_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flows from customers to priorities."""
    o = table(spark, sf_dir, "orders")
    flows = o.select(F.lit("d").alias("document"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("p"), "o_orderpriority").alias("target"))
    return dataflow.single_points(flows).select("id", "links")


@query("SELECT user_id, arg_max(event_type, (n, -first)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def majority_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.majority_zone(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT o_orderkey, o_custkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 6 AS INTEGER) AS batch FROM orders")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey")


@query("SELECT DISTINCT item_id FROM benchmark JOIN (SELECT DISTINCT text FROM documents) d ON contains(d.text, benchmark.text)")
def quoted_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that some document quotes whole."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = retrieval.quoting(quotes, table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")
    return found.select("item_id").distinct()


# Orders as a graph: customers and priorities are components, orders flows from one to the other.
GRAPH_SQL = """WITH c AS (SELECT 'c' || c_custkey AS id, CASE c_nationkey % 4 WHEN 0 THEN 'internet' WHEN 1 THEN 'partner' WHEN 2 THEN 'dmz' ELSE 'unknown' END AS zone, false AS pub, false AS held FROM customer
UNION ALL SELECT DISTINCT 'p' || o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 'management' WHEN '2' THEN 'dmz' ELSE 'data' END, left(o_orderpriority, 1) IN ('1', '2'), left(o_orderpriority, 1) IN ('1', '3') FROM orders),
f AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(s.zone, 'unknown') AS a, t.zone AS b, t.held, 'c' || o_custkey || ' → ' || t.id AS label, ['none', 'basic', 'api_key', 'mtls'][o_orderkey % 4 + 1] AS auth, CASE WHEN o_orderkey % 3 = 0 THEN 'no' ELSE 'yes' END AS enc
 FROM orders LEFT JOIN c s ON s.id = 'c' || o_custkey JOIN c t ON t.id = 'p' || o_orderpriority),
x AS (SELECT * FROM f WHERE a <> b AND a <> 'unknown' AND b <> 'unknown')"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows and components."""
    o, priority = table(spark, sf_dir, "orders"), F.substring("o_orderpriority", 1, 1)
    ends = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("p"), "o_orderpriority")
    auth = F.element_at(F.array(*map(F.lit, ("none", "basic", "api_key", "mtls"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    flows = o.select(F.lit("d").alias("document"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), ends[0].alias("source"), ends[1].alias("target"), auth.alias("auth"), F.when(F.col("o_orderkey") % 3 == 0, "no").otherwise("yes").alias("encrypted"))
    none, held = F.array().cast("array<string>"), F.array(F.lit("pii"))
    buyers = table(spark, sf_dir, "customer").select(F.lit("d").alias("document"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("user").alias("kind"), F.expr("CASE c_nationkey % 4 WHEN 0 THEN 'internet' WHEN 1 THEN 'partner' WHEN 2 THEN 'dmz' ELSE 'unknown' END").alias("zone"), F.lit(False).alias("public"), none.alias("data"))
    stores = o.select(F.lit("d").alias("document"), ends[1].alias("id"), F.lit("datastore").alias("kind"), F.when(priority == "1", "management").when(priority == "2", "dmz").otherwise("data").alias("zone"), priority.isin("1", "2").alias("public"), F.when(priority.isin("1", "3"), held).otherwise(none).alias("data")).distinct()
    return flows, buyers.unionByName(stores).withColumn("name", F.col("id"))


@query(GRAPH_SQL + """ SELECT 'SM-AUTH-001' AS rule_id, 'CRITICAL' AS severity, 'Unauthenticated flow from an untrusted source: ' || label AS issue FROM f WHERE a IN ('internet', 'partner') AND auth = 'none'
UNION SELECT 'SM-ENC-001', 'HIGH', 'Cleartext between zones: ' || label FROM x WHERE enc = 'no' UNION SELECT 'SM-AUTH-002', CASE WHEN held THEN 'HIGH' ELSE 'MEDIUM' END, 'Static credentials between zones: ' || label FROM x WHERE auth IN ('basic', 'api_key')
UNION SELECT 'SM-MGMT-001', 'HIGH', 'Management reachable from outside: ' || label FROM f WHERE a IN ('internet', 'partner') AND b = 'management' UNION SELECT 'SM-DATA-001', 'CRITICAL', 'Public store of sensitive data: ' || id FROM c WHERE pub AND held""")
def model_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.model_findings(*_graph(spark, sf_dir)).select("rule_id", "severity", "issue")


@query(GRAPH_SQL + """ SELECT id AS target_id, 'Spoofing' AS category, CASE WHEN auth = 'none' THEN 'high' ELSE 'medium' END AS likelihood, CASE WHEN auth = 'none' THEN 'CRITICAL' ELSE 'HIGH' END AS risk FROM x WHERE auth <> 'mtls'
UNION ALL SELECT id, 'Information disclosure', CASE WHEN a IN ('internet', 'partner') THEN 'high' ELSE 'medium' END, CASE WHEN a IN ('internet', 'partner') THEN 'CRITICAL' ELSE 'HIGH' END FROM x WHERE enc = 'no'
UNION ALL SELECT id, 'Elevation of privilege', 'medium', 'HIGH' FROM x WHERE b = 'management' AND a IN ('internet', 'partner') UNION ALL SELECT id, 'Information disclosure', 'high', 'CRITICAL' FROM c WHERE pub AND held""")
def threats_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.rule_threats(*_graph(spark, sf_dir)).select("target_id", "category", "likelihood", "risk")


@query(GRAPH_SQL + """ SELECT 'missing end: c' || o_custkey AS warning FROM orders WHERE 'c' || o_custkey NOT IN (SELECT id FROM c) UNION SELECT 'unconnected: ' || id FROM c WHERE id NOT IN (SELECT 'c' || o_custkey FROM orders) AND id NOT IN (SELECT 'p' || o_orderpriority FROM orders)
UNION SELECT 'no zone: ' || id FROM c WHERE zone = 'unknown'""")
def graph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.quality(*_graph(spark, sf_dir)).select("warning")


@query("SELECT 'c' || o_custkey AS source, 'p' || o_orderpriority AS target, min(o_orderkey) AS seq FROM orders GROUP BY ALL")
def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataflow.dedupe_edges(_graph(spark, sf_dir)[0]).select("source", "target", "seq")


@query("""WITH l AS (SELECT arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type) SELECT 'r' || (event_id % 4) AS reason, count(*) AS n FROM l WHERE event_id % 3 = 0 GROUP BY 1""")
def dispute_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.dispute_reasons(_decisions(spark, sf_dir))


@query(f"""SELECT DISTINCT doc_id, k AS category FROM documents CROSS JOIN (VALUES {", ".join(f"('{k}', '{w}')" for k, ws in dataflow.STRIDE_WORDS.items() for w in ws)}) v(k, w) WHERE contains(lower(text), w)""")
def stride_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(dataflow.stride_categories(F.lit(""), "text")).alias("category"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE s[:57] || '...' END AS short, lang || '/' || source || '/' || sha256(t)[:12] AS review_key, sha256(lang || '|' || source) AS signature, trim(replace(replace(t, '|', '\|'), chr(10), ' ')) AS cell FROM d""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.shorten("text", 60).alias("short"), T.review_key("lang", "source", F.sha2(T.text("text").cast("binary"), 256)).alias("review_key"), T.signature("lang", "source").alias("signature"), T.markdown_cell("text").alias("cell"))


@query("""WITH b AS (SELECT o_orderkey, o_custkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g') AS s FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, s ORDER BY o_orderkey) AS n FROM b)
SELECT o_orderkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS id FROM n""")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), "o_orderkey", "o_orderpriority")
    return dataflow.unique_ids(o, "o_orderpriority", "o_orderkey").select("o_orderkey", "id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 5 = 1 THEN 'deleted' WHEN o_orderkey % 7 = 0 THEN 'renamed' ELSE 'moved' END AS change
FROM orders WHERE o_orderkey % 5 IN (0, 1) OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def canvas_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on a canvas before and after some came, went, were renamed or moved."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.lit("d").alias("document"), key.cast("string").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("x"), F.lit(0).alias("y"), key)
    after = o.where(key % 5 != 1).withColumn("label", F.when(key % 7 == 0, "other").otherwise(F.col("label"))).withColumn("x", F.when(key % 11 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return dataflow.canvas_changes(o.where(key % 5 != 0), after).select("id", "change")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS correct, count(*) FILTER (event_id % 3 = 1) AS trap, count(DISTINCT CASE WHEN event_id % 3 = 0 THEN user_id END) AS found, CAST(round(1e6 * count(*) FILTER (event_id % 3 = 0) / count(*)) AS BIGINT) AS precision_ppm
FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def rolled_up_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings that match an expected one (a user), a trap or nothing."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("matched"), F.expr("CASE event_id % 3 WHEN 0 THEN 'expected' WHEN 1 THEN 'trap' ELSE 'none' END").alias("status"))
    return evaluation.rollup_scores(e, ["event_type"]).select("event_type", "n", "correct", "trap", "found", F.round(F.col("precision") * 1e6).cast("bigint").alias("precision_ppm"))


PART_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: length(w) > 3))"


@query(f"""WITH RECURSIVE f AS (SELECT p_size AS doc, p_partkey AS seq, {PART_WORDS} AS a, lower(p_brand) AS s FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT p_size AS doc, p_partkey AS id, {PART_WORDS} AS b, lower(p_brand[:7]) AS t, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT e.doc, e.id, list(f.seq ORDER BY f.seq) AS seqs FROM e JOIN f USING (doc) WHERE len(list_intersect(a, b)) >= 0.3::DOUBLE * greatest(len(a), len(b)) AND len(a) > 0 AND (contains(s, t) OR contains(t, s)) GROUP BY ALL),
m AS (SELECT e.doc, e.n, e.id, coalesce(c.seqs, []) AS seqs FROM e LEFT JOIN c USING (doc, id)),
g AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS used FROM e
 UNION ALL SELECT doc, n, id, free[1], CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END FROM (SELECT m.doc, m.n, m.id, g.used, list_filter(m.seqs, lambda x: NOT list_contains(g.used, x)) AS free FROM g JOIN m ON m.doc = g.doc AND m.n = g.n + 1))
SELECT doc AS doc_id, seq, id AS expected FROM g WHERE seq IS NOT NULL""")
def matched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with odd keys as findings, those with even ones as expected, by size: names in common, and the brand named."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.lit("HIGH").alias("severity"), "p_partkey", "p_name", "p_brand")
    found = p.where("p_partkey % 2 = 1").select("doc_id", "severity", F.col("p_partkey").alias("seq"), F.col("p_name").alias("issue"), F.col("p_brand").alias("section"))
    wanted = p.where("p_partkey % 2 = 0").select("doc_id", "severity", F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.substring("p_brand", 1, 7).alias("section"))
    return evaluation.one_to_one(found, wanted).select("doc_id", "seq", "expected")


# Events as nested settings: an object of objects and lists around an event's own props, and one that overrides parts of it.
SETTINGS_SQL = """WITH e AS (SELECT event_id, '{"type":"' || event_type || '","user":{"id":' || user_id || ',"seen":[' || event_id % 3 || ',{"last":' || event_id % 5 || ',"none":{}}],"plan":{"tier":{"name":"t' || user_id % 4 || '"}}},"props":' || coalesce(props, 'null') || '}' AS base,
 CASE event_id % 4 WHEN 0 THEN '{"user":{"seen":[9],"plan":{"tier":{"name":"gold","since":' || event_id % 7 || '}}}}' WHEN 1 THEN '{"props":{"extra":{"deep":' || event_id % 11 || '}}}' WHEN 2 THEN '{"type":{"own":true},"user":7}' ELSE '{}' END AS over FROM events)"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.coalesce("props", F.lit("null")).alias("props"), *[(F.col("event_id") % k).cast("string").alias(f"m{k}") for k in (3, 5, 7, 11)], (F.col("user_id") % 4).alias("u4"))
    base = F.format_string('{"type":"%s","user":{"id":%d,"seen":[%s,{"last":%s,"none":{}}],"plan":{"tier":{"name":"t%d"}}},"props":%s}', "event_type", "user_id", "m3", "m5", "u4", "props")
    k = F.col("event_id") % 4
    over = F.when(k == 0, F.format_string('{"user":{"seen":[9],"plan":{"tier":{"name":"gold","since":%s}}}}', "m7")).when(k == 1, F.format_string('{"props":{"extra":{"deep":%s}}}', "m11")).when(k == 2, '{"type":{"own":true},"user":7}').otherwise("{}")
    return e.select("event_id", nested.parsed(base).alias("base"), nested.parsed(over).alias("over"))


@query(SETTINGS_SQL + """ SELECT event_id, substr(t.fullkey, 3) AS path, CASE WHEN t.type = 'NULL' THEN '' WHEN t.type = 'BOOLEAN' THEN upper(left(t.atom ->> '$', 1)) || substr(t.atom ->> '$', 2) ELSE t.atom ->> '$' END AS value
FROM e, json_tree(CAST(base AS JSON)) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.leaves(_settings(spark, sf_dir), ["event_id"], "base")


@query(SETTINGS_SQL + """ SELECT event_id, substr(t.fullkey, 3) AS path, CASE WHEN t.type = 'NULL' THEN '' WHEN t.type = 'BOOLEAN' THEN upper(left(t.atom ->> '$', 1)) || substr(t.atom ->> '$', 2) ELSE t.atom ->> '$' END AS value
FROM e, json_tree(json_merge_patch(CAST(base AS JSON), CAST(over AS JSON))) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _settings(spark, sf_dir).select("event_id", nested.merged(F.col("base"), F.col("over")).alias("v"))
    return nested.leaves(both, ["event_id"], "v")


# Orders as a log of their customers' documents: priorities are actions, and every third writer says what version it saw.
APPROVAL_SQL = """WITH RECURSIVE e AS (SELECT o_custkey AS document, o_orderkey AS seq, CASE left(o_orderpriority, 1) WHEN '1' THEN 'approve' WHEN '2' THEN 'approve' WHEN '5' THEN 'sign' ELSE 'edit' END AS action,
 CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE ' ' || o_orderstatus || ' ' END AS writer, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS base, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
g AS (SELECT DISTINCT document, CAST(0 AS BIGINT) AS seq, '' AS action, CAST(0 AS BIGINT) AS n, 0 AS version, 'draft' AS status, '' AS approved_by, 0 AS edits, '' AS refused FROM e
 UNION ALL SELECT document, seq, action, n, CASE WHEN r = '' AND action = 'approve' THEN version + 1 ELSE version END, CASE WHEN r <> '' THEN status WHEN action = 'approve' THEN 'approved' ELSE 'draft' END,
 CASE WHEN r = '' AND action = 'approve' THEN coalesce(nullif(trim(writer), ''), 'reviewer') ELSE approved_by END, CASE WHEN r <> '' THEN edits WHEN action = 'approve' THEN 0 ELSE edits + 1 END, r
 FROM (SELECT e.document, e.seq, e.action, e.writer, e.n, g.version, g.status, g.approved_by, g.edits, CASE WHEN e.base <> g.version THEN 'conflict' WHEN e.action = 'sign' THEN 'unknown action' ELSE '' END AS r FROM g JOIN e ON e.document = g.document AND e.n = g.n + 1))"""


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    action = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "approve").when(F.substring("o_orderpriority", 1, 1) == "5", "sign").otherwise("edit")
    writer = F.when(key % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))
    log = o.select(F.col("o_custkey").alias("document"), key.alias("seq"), action.alias("action"), writer.alias("writer"), F.when(key % 3 == 0, (key % 4).cast("int")).alias("base"))
    return folds.approvals(log)


@query(APPROVAL_SQL + " SELECT document, seq, version, status, approved_by, edits, refused FROM g WHERE n > 0")
def approval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approvals(spark, sf_dir).select("document", "seq", "version", "status", "approved_by", "edits", "refused")


@query(APPROVAL_SQL + " SELECT document, version, seq, approved_by FROM g WHERE action = 'approve' AND refused = ''")
def approved_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.approved_versions(_approvals(spark, sf_dir))


@query(APPROVAL_SQL + " SELECT document, arg_max(version, n) AS version, arg_max(status, n) AS status FROM g WHERE n > 0 GROUP BY document")
def current_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.current(_approvals(spark, sf_dir), ["document"]).select("document", "version", "status")


@query("""SELECT CAST(doc_id AS VARCHAR) AS chunk_id, lang AS domain, sha1(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS text_sha1 FROM documents WHERE lang <> 'fr' AND (doc_id % 2 = 1 OR doc_id % 3 = 0)""")
def chunk_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into a collection by language: odd ones, then every third with a mark, twice; then French is dropped."""
    d = table(spark, sf_dir, "documents")
    chunk = lambda rows, text: rows.select(F.col("doc_id").cast("string").alias("chunk_id"), text.alias("text"), F.col("source"), F.col("lang").alias("domain"), F.lit("").alias("clause"), F.lit("").alias("heading"), F.lit(0).alias("ordinal"), F.array(F.lit(0.0)).alias("embedding"))
    own = Collection(spark, scratch_folder(spark, "collection"), "letters-1")
    own.upsert(chunk(d.where("doc_id % 2 = 1"), F.col("text")))
    for _ in range(2):
        own.upsert(chunk(d.where("doc_id % 3 = 0"), F.concat("text", F.lit("!"))))
    own.drop("fr")
    return own.read().select("chunk_id", "domain", F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


def _digest(row: dict) -> str:
    if "&&&" in row["text"]:
        raise ValueError("symbols")
    return hashlib.sha256(row["text"].encode()).hexdigest()


@query("""SELECT doc_id, CASE WHEN NOT contains(text, '&&&') THEN sha256(text) END AS value, CASE WHEN contains(text, '&&&') THEN 'ValueError: symbols' END AS error FROM documents""")
def resumed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map over documents that was run over half of them before: what it has is kept, what failed is tried again."""
    d, store = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_folder(spark, "results")
    resumable.resume(d.where("doc_id % 2 = 0"), ["text"], _digest, store)
    return resumable.resume(d, ["text"], _digest, store, slices=2).select("doc_id", "value", "error")


SPLIT_SQL = r"list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""WITH q AS (SELECT item_id, {SPLIT_SQL} AS w FROM benchmark), d AS (SELECT doc_id, {SPLIT_SQL} AS x FROM documents), p AS (SELECT doc_id, x, unnest(range(len(x))) AS pos, unnest(x) AS word FROM d)
SELECT item_id, doc_id, CAST(pos AS INTEGER) AS start FROM q JOIN p ON p.word = q.w[1] WHERE x[pos + 1:pos + len(w)] = w""")
def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents quote a passage word for word."""
    return locating.quote_places(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", "text", "text")


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS name FROM benchmark)
SELECT n.name, d.lang, count(*) AS documents FROM n JOIN documents d ON contains(lower(d.text), n.name) GROUP BY ALL""")
def named_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long words of the benchmark as names of components, in all documents, whether they stand in a word or are one."""
    d = table(spark, sf_dir, "documents").withColumn("model", F.lit("m"))
    names = table(spark, sf_dir, "benchmark").select(F.lit("m").alias("model"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("name")).distinct()
    return locating.named_in(d.select("model", "doc_id", "lang", "text"), names, ["model"], ["doc_id", "lang"], "text", "name").groupBy("name", "lang").agg(F.count(F.lit(1)).alias("documents"))


@query("""WITH m AS (SELECT o_custkey AS document, o_orderkey AS seq, o_orderpriority AS name, CASE o_orderstatus WHEN 'O' THEN 'other' ELSE 'kind ' || o_orderstatus END AS kind, CASE WHEN o_orderkey % 3 > 0 THEN 'unknown' ELSE 'zone ' || o_orderkey % 4 END AS zone,
 ['unknown', 'internal', 'public', 'partner'][o_orderkey % 4 + 1] AS exposure, 'd' || o_orderkey % 6 AS data FROM orders WHERE o_orderkey % 10 > 0), f AS (SELECT document, name, min(seq) AS first, coalesce(arg_min(kind, seq) FILTER (kind <> 'other'), 'other') AS kind,
 coalesce(arg_min(zone, seq) FILTER (zone <> 'unknown'), 'unknown') AS zone, coalesce(arg_min(exposure, seq) FILTER (exposure IN ('public', 'partner')), arg_min(exposure, seq)) AS exposure, list_sort(list(DISTINCT data)) AS data FROM m GROUP BY ALL)
SELECT document, CAST(row_number() OVER (PARTITION BY document ORDER BY first) - 1 AS INTEGER) AS number, name, zone, kind, exposure, data FROM f""")
def components_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mentions of their priorities in the documents of customers, every tenth without a quote."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    exposure = F.element_at(F.array(*map(F.lit, ("unknown", "internal", "public", "partner"))), (key % 4 + 1).cast("int"))
    m = o.select(F.col("o_custkey").alias("document"), (key % 10 > 0).alias("grounded"), F.floor(key / 100).alias("batch"), key.alias("seq"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "O", "other").otherwise(F.concat(F.lit("kind "), "o_orderstatus")).alias("kind"), F.when(key % 3 > 0, "unknown").otherwise(F.concat(F.lit("zone "), (key % 4).cast("string"))).alias("zone"), exposure.alias("exposure"), F.array(F.concat(F.lit("d"), (key % 6).cast("string"))).alias("data"), F.lit("").alias("evidence"), F.lit("").alias("section"))
    return folds.components_in_order(m).select("document", "number", "name", "zone", "kind", "exposure", "data")
