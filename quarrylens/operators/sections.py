"""Documents to typed sections: splitting, chunking, topics, scope and completeness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import multi as M
from ..functions import text as T
from ..plans.topics import CRITERIA, GENERAL, MARKERS, STRUCTURE, TOPICS

# What makes a section, and how long it may be.
LEAST_WORDS, MOST_WORDS = 8, 900
UNTITLED, PREAMBLE = "Design Document", "Document Preamble"


def _lines(doc: Column) -> Column:
    """Lines with the rules that make headings of them, folded in one pass over each document's array."""
    return F.split(T.text(doc), r"\r\n|\n|\r")


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a section: doc id, index, heading, body, level.

    A heading is a line with one to six ``#``, one underlined by ``=`` or ``-``, or a numbered one. Sections of
    fewer than eight words go; long ones are cut between paragraphs. A text without headings is one section.
    Texts are dealt by document once, before they are cut into lines; all windows and groups stay in that dealing.
    """
    docs = docs.select(id_col, text_col).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    lines = docs.select(id_col, F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    by_doc = Window.partitionBy(id_col).orderBy("pos")
    bare = F.trim(F.col("line"))
    nxt = F.coalesce(F.lead("line").over(by_doc), F.lit(""))
    atx = F.regexp_extract("line", r"^(#{1,6})\s+(.*\S)\s*$", 1)
    underlined = F.rlike(nxt, F.lit(r"^[=\-]{3,}\s*$")) & (bare != "") & (F.length(bare) < 100) & (atx == "") & ~F.rlike(F.col("line"), F.lit(r"^[=\-]{3,}\s*$"))
    numbered = F.rlike(bare, F.lit(r"^\d+(?:\.\d+)*\.?\s+[A-Z][^\n]{2,80}$")) & (F.length(bare) < 90)
    dots = F.length(F.regexp_replace(F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)", 1), "[0-9]", ""))
    kind = F.when(atx != "", "atx").when(underlined, "under").when(numbered, "number")
    marked = lines.select(
        id_col, "pos", "line", kind.alias("kind"),
        F.when(atx != "", F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.*\S)\s*$", 2))).when(kind.isNotNull(), bare).alias("heading"),
        F.when(atx != "", F.length(atx)).when(underlined, F.when(nxt.startswith("="), 1).otherwise(2)).when(numbered, F.least(dots + 1, F.lit(6))).alias("level"),
    )
    rule = (F.lag("kind").over(by_doc) == "under")
    run = marked.withColumn("_rule", F.coalesce(rule, F.lit(False))).withColumn("block", F.sum(F.when(F.col("kind").isNotNull() & ~F.col("_rule"), 1).otherwise(0)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isNull() & ~F.col("_rule"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    blocks = run.groupBy(id_col, "block").agg(F.max(F.when(~F.col("_rule"), F.col("heading"))).alias("heading"), F.max(F.when(~F.col("_rule"), F.col("level"))).alias("level"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    any_heading = F.max("block").over(Window.partitionBy(id_col)) > 0
    named = blocks.select(id_col, "block", F.coalesce("heading", F.when(any_heading, PREAMBLE).otherwise(UNTITLED)).alias("heading"), F.coalesce("level", F.lit(1)).alias("level"), "body")
    kept = named.where(T.word_count("body") >= LEAST_WORDS)
    parts = kept.select(id_col, "block", "level", F.posexplode(oversize_parts(F.col("heading"), F.col("body"))).alias("part", "p"))
    index = F.row_number().over(Window.partitionBy(id_col).orderBy("block", "part")) - 1
    found = parts.select(id_col, index.alias("index"), F.col("p.heading").alias("heading"), F.col("p.body").alias("body"), "level")
    whole = docs.where(F.trim(T.text(text_col)) != "").join(kept.select(id_col).distinct(), id_col, "left_anti")
    alone = whole.select(id_col, F.lit(0).alias("index"), F.lit(UNTITLED).alias("heading"), F.regexp_replace(T.text(text_col), r"^\s+|\s+$", "").alias("body"), F.lit(1).alias("level"))
    return found.unionByName(alone)


def oversize_parts(heading: Column, body: Column, most: int = MOST_WORDS) -> Column:
    """The section itself, or its paragraphs filled in order into parts of at most ``most`` words (one is never cut)."""
    paragraphs = F.filter(F.split(body, r"\n\s*\n"), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        n = T.word_count(p)
        full = (acc["n"] + n > most) & (acc["held"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["held"] == ""), p).otherwise(F.concat(acc["held"], F.lit("\n\n"), p)).alias("held"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    bodies = F.aggregate(paragraphs, start, step, lambda acc: F.concat(acc["done"], F.array(acc["held"])))

    def named(all_: Column) -> Column:
        name = lambda i: F.when(F.size(all_) > 1, F.concat(heading, F.lit(" (part "), (i + 1).cast("string"), F.lit(")"))).otherwise(heading)
        return F.transform(all_, lambda b, i: F.struct(name(i).alias("heading"), b.alias("body")))

    cut = T.bind(bodies, named)
    return F.when(T.word_count(body) <= most, F.array(F.struct(heading.alias("heading"), body.alias("body")))).otherwise(cut)


def windows(body: Column | str, size: int = 220, overlap: int = 40) -> Column:
    """Windows of words in steps of size less overlap, up to the one that reaches the end; a short text stays as it is."""
    t, step = F.regexp_replace(T.text(body), r"^\s+|\s+$", ""), max(size - overlap, 1)

    def cut(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - size) / step), F.lit(0)).cast("int")
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= size, F.array(t)).otherwise(many)

    return T.bind(T.words(body), cut)


def chunk_clauses(docs: DataFrame, size: int = 220, overlap: int = 40) -> DataFrame:
    """Knowledge documents (source, domain, text) to chunks that carry their clause: a heading or clause line opens one."""
    clause_line = r"^(?:§\s*|(?i:clause|section)\s+)?(\d+(?:\.\d+)+)\.?[\s:\-–]+(.+)$"
    lines = docs.select("source", "domain", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    by_source = Window.partitionBy("domain", "source").orderBy("pos")
    atx = F.rlike(F.col("line"), F.lit(r"^#{1,6}\s+\S"))
    candidate = F.when(atx, F.trim(F.regexp_replace("line", r"^#{1,6}\s+", ""))).otherwise(F.trim("line"))
    opens = atx | (F.rlike(candidate, F.lit(clause_line)) & (F.length(candidate) < 120))
    run = lines.select("source", "domain", "pos", "line", candidate.alias("candidate"), opens.alias("opens"))
    run = run.withColumn("block", F.sum(F.col("opens").cast("int")).over(by_source.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.max(F.when(F.col("opens"), F.col("candidate")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    blocks = run.groupBy("source", "domain", "block").agg(head.alias("head"), body.alias("body"))
    clause = T.clause_label(F.regexp_extract(F.coalesce("head", F.lit("")), clause_line, 1))
    title = F.when(clause != "", F.trim(F.regexp_extract("head", clause_line, 2))).otherwise(F.coalesce("head", F.lit("Preamble")))
    pieces = blocks.select("source", "domain", "block", clause.alias("clause"), title.alias("heading"), F.posexplode(windows("body", size, overlap)).alias("n", "piece"))
    ordinal = F.row_number().over(Window.partitionBy("domain", "source").orderBy("block", "n")) - 1
    found = pieces.withColumn("ordinal", ordinal)
    header = F.concat(F.lit("["), "source", F.when(F.col("clause") != "", F.concat(F.lit(" "), "clause")).otherwise(""), F.lit("] "), "heading")
    return found.select(T.chunk_id("domain", "source", "clause", "ordinal", "piece").alias("chunk_id"), F.concat_ws("\n", header, "piece").alias("text"), "source", "domain", "clause", "heading", "ordinal")


def topic_frame(spark: SparkSession, topics: Sequence = TOPICS) -> DataFrame:
    """One row a topic, in catalogue order."""
    rows = [(i, t.key, t.domain, list(t.keywords), list(t.query_terms), t.label) for i, t in enumerate(topics)]
    return spark.createDataFrame(rows, "ord int, topic string, domain string, keywords array<string>, query_terms array<string>, label string")


def topic_array(heading: Column | str, body: Column | str, topics: Sequence = TOPICS) -> Column:
    """Topics with a positive score: 3 for a keyword in the heading, 1 for each of its first four in the body."""

    words = sorted({k for t in topics for k in t.keywords})
    odd = [w for w in words if M.overlaps_itself(w)]

    def score(keyword: Column, both: Column) -> Column:
        return F.when(F.array_contains(both["h"], keyword), 3.0).otherwise(0.0) + F.when(F.array_contains(both["b"], keyword), F.least(M.counted(both["b"], both["t"], keyword, odd), F.lit(4))).otherwise(0)

    def scores(both: Column) -> Column:
        each = lambda t: F.aggregate(t["keywords"], F.lit(0.0), lambda total, k: total + score(k, both))
        every = F.transform(catalogue, lambda t: F.struct(t["ord"].alias("ord"), t["topic"].alias("topic"), t["domain"].alias("domain"), each(t).alias("score")))
        return F.when(F.size(both["h"]) + F.size(both["b"]) > 0, every).otherwise(F.array().cast("array<struct<ord:int,topic:string,domain:string,score:double>>"))

    catalogue = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t.key).alias("topic"), F.lit(t.domain).alias("domain"), F.array(*map(F.lit, t.keywords)).alias("keywords")) for i, t in enumerate(topics)])
    found = lambda t: F.struct(M.begun(T.normalise(heading), words).alias("h"), M.begun(t, words).alias("b"), t.alias("t"))
    return F.filter(T.bind(T.bind(T.normalise(body), found), scores), lambda s: s["score"] > 0)


def score_topics(sections: DataFrame, keys: Sequence[str], heading: Column | str, body: Column | str, topics: Sequence = TOPICS) -> DataFrame:
    """A row for each section and topic with a positive score. No join is needed, so a long document costs no shuffle."""
    return sections.select(*keys, F.inline(topic_array(heading, body, topics)))


def classify(sections: DataFrame, keys: Sequence[str], heading: Column | str, body: Column | str, topics: Sequence = TOPICS) -> DataFrame:
    """Domain, topic, its share of all scores, and up to four other topics with half the winner's score or more.

    A projection of each row: nothing is grouped or joined.
    """

    def judged(r: Column) -> Column:
        first = F.get(r, F.lit(0))
        total = F.aggregate(r, F.lit(0.0), lambda n, x: n - x["less"])
        others = F.transform(F.filter(F.slice(r, 2, 4), lambda x: -x["less"] >= -first["less"] * 0.5), lambda x: x["topic"])
        none = F.struct(F.lit(GENERAL).alias("domain"), F.lit("context_scope").alias("topic"), F.lit(0.0).alias("topic_confidence"), F.array().cast("array<string>").alias("secondary_topics"))
        some = F.struct(first["domain"].alias("domain"), first["topic"].alias("topic"), T.half_even(-first["less"] / total, 3).alias("topic_confidence"), others.alias("secondary_topics"))
        return F.when(F.size(r) == 0, none).otherwise(some)

    ranked = F.array_sort(F.transform(topic_array(heading, body, topics), lambda s: F.struct((-s["score"]).alias("less"), s["ord"].alias("ord"), s["topic"].alias("topic"), s["domain"].alias("domain"))))
    return sections.select(*keys, T.bind(ranked, judged).alias("_judged")).select(*keys, "_judged.*")


def retrieval_query(topic_label: Column, query_terms: Column, heading: Column | str, body: Column | str, most: int = 120) -> Column:
    sample = F.array_join(F.slice(T.words(body), 1, most), " ")
    return F.trim(F.concat_ws(" ", *[F.nullif(T.text(c), F.lit("")) for c in (F.trim(T.text(heading)), topic_label, F.array_join(query_terms, " "), sample)]))


def in_domains(sections: DataFrame, domains: Sequence[str], general: bool = False) -> DataFrame:
    return sections.where(F.col("domain").isin([*domains, *([GENERAL] if general else [])]))


def _with_folded(text_col: str) -> Column:
    """A text (``t``) with itself in folded case (``low``), made once for all patterns."""
    return T.bind(T.text(text_col), lambda t: F.struct(t.alias("t"), M.folded(t).alias("low")))


def assess_scope(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topics: Sequence = TOPICS) -> DataFrame:
    """Whether a whole document reads as a design: length, topic signal, and structure against other genres' phrases."""
    scores = score_topics(docs, [id_col], F.lit(""), F.col(text_col), topics).where(F.col("domain") != GENERAL)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "ord", "topic")))
    signal = scores.groupBy(id_col).agg(F.sum("score").alias("signal"), F.count(F.lit(1)).alias("n"), F.transform(F.slice(ranked, 1, 6), lambda x: x["topic"]).alias("matched_topics"))
    said = lambda both, p: M.asked(both["low"], p, F.regexp_count(both["t"], F.lit(f"(?im){p}")), F.lit(0))
    count = lambda both, ps: reduce(Column.__add__, [said(both, p) for p in ps])
    counts = lambda both: F.struct(count(both, MARKERS).alias("other_genre"), count(both, STRUCTURE).alias("structure"))
    base = docs.select(id_col, T.word_count(text_col).alias("total_words"), T.bind(_with_folded(text_col), counts).alias("_c")).select(id_col, "total_words", "_c.*")
    both = base.join(signal, id_col, "left").fillna(0, ["n"]).fillna(0.0, ["signal"])
    reason = F.when(F.col("total_words") < 25, "too_short").when((F.col("signal") < 8) | (F.col("n") < 3), "off_topic").when((F.col("other_genre") >= 3) & (F.col("other_genre") > F.col("structure")), "other_genre").otherwise("")
    return both.select(id_col, (reason == "").alias("in_scope"), reason.alias("reason"), "total_words", F.col("signal").alias("architecture_score"), F.col("n").cast("int").alias("distinct_topics"), F.coalesce("matched_topics", F.array().cast("array<string>")).alias("matched_topics"), "other_genre", "structure")


def completeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", criteria: Sequence = CRITERIA, domains: Sequence[str] = ()) -> DataFrame:
    """What a document addresses and what it leaves out, and whether it is long enough to review."""
    says = lambda both, p: M.asked(both["low"], p, F.rlike(both["t"], F.lit(f"(?iu){p}")), F.lit(False))
    shown = lambda both: F.array_compact(F.array(*[F.when(reduce(Column.__or__, [says(both, p) for p in c.patterns]), F.lit(c.key)) for c in criteria]))
    wanted = [F.lit(c.key) for c in criteria if not domains or c.domain in domains]
    present = T.bind(_with_folded(text_col), shown)
    missing = F.array_except(F.array(*wanted), present)
    out = docs.select(id_col, T.word_count(text_col).alias("word_count"), F.array_sort(present).alias("present"), F.array_sort(missing).alias("missing"))
    asked = F.size("present") + F.size("missing")
    return out.select("*", (F.col("word_count") >= 120).alias("reviewable"), T.ratio(F.size("present"), asked).alias("coverage"))


def completeness_findings(assessed: DataFrame, id_col: str = "doc_id", criteria: Sequence = CRITERIA) -> DataFrame:
    """One finding for each gap; one alone for a stub; another for no text at all."""
    known = F.create_map(*[F.lit(x) for c in criteria for x in (c.key, f"{c.domain}|{c.severity}|{c.issue}")])
    gap = F.when(F.col("word_count") == 0, F.array(F.lit("COMPLETE-000"))).when(~F.col("reviewable"), F.array(F.lit("COMPLETE-001"))).otherwise(F.transform("missing", lambda k: F.concat(F.lit("COMPLETE-"), F.upper(k))))
    rows = assessed.select(id_col, "word_count", F.posexplode(gap).alias("seq", "rule_id"))
    what = F.split(known[F.lower(F.regexp_replace("rule_id", "^COMPLETE-", ""))], r"\|")
    issue = F.when(F.col("rule_id") == "COMPLETE-000", "The document has no text.").when(F.col("rule_id") == "COMPLETE-001", F.concat(F.lit("The document has only "), F.col("word_count").cast("string"), F.lit(" words, too few to review."))).otherwise(what[2])
    return rows.select(id_col, "seq", F.lit("Document (completeness)").alias("section"), F.coalesce(F.when(F.col("rule_id").rlike("-00[01]$"), F.lit("security")), what[0]).alias("domain"), F.coalesce(F.when(F.col("rule_id").rlike("-00[01]$"), F.lit("MEDIUM")), what[1]).alias("severity"), issue.alias("issue"), "rule_id")


def count_by_domain(sections: DataFrame, *keys: str) -> DataFrame:
    return sections.groupBy(*keys, "domain").agg(F.count(F.lit(1)).alias("n"))
