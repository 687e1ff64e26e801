"""The rule scan: sections against patterns, with suppression and the guard against declined controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import multi as M
from ..functions import text as T
from ..plans.rule_catalogue import RULES, Rule
from ..plans.topics import DOMAINS

FLAGS = "(?iu)"
#: A control counts as declined if one of the first stands just before it, or one of the last after it behind an auxiliary.
REFUSING = ("no", "not", "never", "without", "lacks", "lacking", "lack", "absence", "missing", "none", "neither", "nor", "nothing")
AUXILIARY = ("is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "will", "would", "could", "remains", "remain", "stays")
DECLINED = ("not", "never", "no", "considered", "planned", "proposed", "evaluated", "deferred", "descoped", "rejected", "abandoned", "dropped", "postponed", "declined", "pending", "found", "unsuitable", "inflexible", "optional", "exempt", "unavailable", "scope", "roadmap", "future", "later", "phase")
#: Words that are looked at before a control, for an auxiliary after it, and from there on; where a clause ends.
BEFORE, SOON, AFTER = 2, 3, 7
CLAUSE_ENDS = r"(?i)[.,;:!?()\n]+|\b(?:but|while|whereas|although)\b"
MARK = "\u00a4"
ANY = r"[^\x{0}-\x{10FFFF}]"  # matches nothing


def _either(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns) or ANY


def suppressor(rule: Rule) -> str:
    """One pattern for all of a rule's suppressors."""
    return _either(rule.suppressors)


def stands(t: Column, pattern: str) -> Column:
    """Whether the text names, in some clause, a control (``pattern``) that it does not decline there."""
    said = lambda words, listed: F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))
    cut = lambda words, begin, n: F.slice(words, begin, n)

    def held(words: Column) -> Column:
        at = lambda i: (words[i] == MARK) & ~said(cut(words, F.greatest(i + 1 - BEFORE, F.lit(1)), F.least(F.lit(BEFORE), i)), REFUSING) & ~(said(cut(words, i + 2, F.lit(SOON)), AUXILIARY) & said(cut(words, i + 3, F.lit(AFTER)), DECLINED))
        return F.exists(F.sequence(F.lit(0), F.size(words) - 1), at)

    marked = F.regexp_replace(F.replace(t, F.lit(MARK), F.lit(" ")), F.lit(FLAGS + pattern), F.lit(f" {MARK} "))
    clauses = F.filter(F.split(marked, CLAUSE_ENDS), lambda c: F.contains(c, F.lit(MARK)))
    return F.exists(F.transform(clauses, lambda c: F.split(F.trim(F.lower(c)), r"\s+")), held)


def matches(t: Column, pattern: str, seen: Column) -> Column:
    """Whether a pattern matches, asked only of texts that have a literal that it needs; ``seen`` holds those of the text."""
    literals = M.needed(pattern)
    hit = F.rlike(t, F.lit(FLAGS + pattern))
    return hit if literals is None else F.arrays_overlap(seen, F.array(*map(F.lit, literals))) & hit


def literals_of(rules: Sequence[Rule]) -> list[str]:
    """All literals that some pattern of the rules needs."""
    patterns = [p for r in rules for p in (*r.hard, *r.soft, *([suppressor(r)] if r.suppressors else []))]
    return sorted({w for p in patterns for w in M.needed(p) or ()})


def suppressed(t: Column, rule: Rule, seen: Column) -> Column:
    """A guarded rule is suppressed only by a control that stands."""
    if not rule.suppressors:
        return F.lit(False)
    named = matches(t, suppressor(rule), seen)
    return F.when(named, stands(t, suppressor(rule))).otherwise(False) if rule.guard else named


def rule_frame(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The catalogue as a table: a bounded dimension whatever the corpus."""
    rows = [(r.id, r.domain, r.severity, r.issue, r.advice, [FLAGS + p for p in r.hard], [FLAGS + p for p in r.soft], FLAGS + suppressor(r), list(r.topics), r.scope, r.kind, r.soft_kind) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_domain string, severity string, issue string, recommendation string, hard array<string>, soft array<string>, suppressor string, rule_topics array<string>, scope string, kind string, soft_kind string")


def first_hit(t: Column, rule: Rule, order: int, seen: Column) -> Column:
    """What the first pattern that matches and counts says, else null: hard ones first and unsuppressed."""

    def says(pattern: str, hard: bool) -> Column:
        kind = "question" if rule.scope == "document" else rule.kind if hard or rule.kind != "finding" else rule.soft_kind
        return F.struct(F.lit(order).alias("ord"), F.lit(FLAGS + pattern).alias("pattern"), F.lit(hard).alias("hard"), F.lit(kind).alias("kind"))

    hit = F.lit(None).cast("struct<ord:int,pattern:string,hard:boolean,kind:string>")
    counts = ~suppressed(t, rule, seen)
    for p in reversed(rule.soft):
        hit = F.when(matches(t, p, seen) & counts, says(p, False)).otherwise(hit)
    for p in reversed(rule.hard):
        hit = F.when(matches(t, p, seen), says(p, True)).otherwise(hit)
    return hit


def _scan(rows: DataFrame, keys: list[str], t: Column, rules: Sequence[Rule], applies) -> DataFrame:
    """Patterns are literals, so that Java compiles each once a task; rows fan out only where a rule hits.

    One pass over a text says which literals it has; a pattern that needs another is not asked.
    """
    none = F.array().cast("array<struct<ord:int,pattern:string,hard:boolean,kind:string>>")
    hits = lambda both: F.array_compact(F.array(*[F.when(applies(r), first_hit(both["t"], r, k, both["seen"])) for k, r in enumerate(rules)])) if rules else none
    seen = lambda text: F.struct(text.alias("t"), F.array_distinct(M.begun(M.folded(text), literals_of(rules))).alias("seen"))
    out = rows.select(*keys, t.alias("_t"), F.inline(T.bind(T.bind(t, seen), hits)))
    spark = rows.sparkSession
    facts = spark.createDataFrame([(k, r.id, r.domain, r.severity, r.issue, r.advice) for k, r in enumerate(rules)], "ord int, rule_id string, domain string, severity string, issue string, recommendation string")
    found = out.join(F.broadcast(facts), "ord")  # a row a rule
    return found.select(*keys, "rule_id", "domain", "severity", "issue", "recommendation", T.match_excerpt("_t", F.col("pattern")).alias("evidence_excerpt"), "kind", F.lit("rules_engine").alias("origin"), F.lit(1.0).alias("confidence"))


def run_rules(sections: DataFrame, id_col: str = "doc_id", rules: Sequence[Rule] = RULES, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Findings of every rule that applies: section rules on each section, document rules on the whole text once.

    ``sections`` has index, heading, body, topic and secondary_topics. Order by rule, section and ``index`` to list.
    """
    own = [r for r in rules if r.domain in domains and r.scope == "section"]
    whole = [r for r in rules if r.domain in domains and r.scope == "document"]
    topics = F.concat(F.array("topic"), F.col("secondary_topics"))

    def applies(r: Rule) -> Column:
        return F.arrays_overlap(topics, F.array(*[F.lit(t) for t in r.topics])) if r.topics else F.lit(True)

    found = _scan(sections, [id_col, "index", "heading"], F.concat_ws("\n", "heading", "body"), own, applies).withColumnRenamed("heading", "section")
    if not whole:
        return found
    texts = document_texts(sections, id_col)
    doc = _scan(texts, [id_col], F.col("document"), whole, lambda r: F.lit(True))
    return found.unionByName(doc.select(id_col, F.lit(-1).alias("index"), F.lit("Whole document").alias("section"), *[c for c in doc.columns if c != id_col]))


def document_texts(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document's text, its sections in order."""
    ordered = F.array_sort(F.collect_list(F.struct("index", F.concat_ws("\n", "heading", "body").alias("t"))))
    return sections.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("document"))


def rules_by_domain(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    return rule_frame(spark, rules).groupBy(F.col("rule_domain").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def listed(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A place for each finding of its document: rule, section in lower case, then the order of sections."""
    by = Window.partitionBy(id_col).orderBy("rule_id", F.lower("section"), "index")
    return found.withColumn("place", F.row_number().over(by))


def first_layer(found: DataFrame, chunks: DataFrame, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Before any model is asked: findings of the rules, and chunks of knowledge there are, by domain."""
    dim = found.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    raised = found.groupBy("domain").agg(F.count(F.lit(1)).alias("findings"))
    known = chunks.groupBy("domain").agg(F.count(F.lit(1)).alias("chunks"))
    return dim.join(raised, "domain", "left").join(known, "domain", "left").fillna(0, ["findings", "chunks"])
