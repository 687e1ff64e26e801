"""Skills: patterns of workflow steps over sections, every match with its place and surroundings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What a pattern may hold at most, and shapes that take exponential time (fixed limits of a pattern that users give).
QUANTIFIERS, GROUPS = 15, 20
DANGEROUS = (r"\([^()]*[+*][^()]*\)\s*[+*{]", r"\.\*.*\.\*.*\.\*", r"[+*]\s*[+*]", r"\{\d{4,}", r"\(\?R\)|\(\?\d+\)")


@dataclass(frozen=True)
class Step:
    skill: str
    step: int
    pattern: str
    issue: str
    severity: str = "MEDIUM"


def pattern_problems(pattern: str) -> list[str]:
    """Why a user's pattern is not let near texts; none if it is safe. Looked at when a plan is made, one pattern at a time."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "x", pattern)
    found = []
    try:
        re.compile(pattern)
    except re.error as e:
        found.append(f"does not compile: {e}")
    if len(re.findall(r"[*+?]|\{\d", bare)) > QUANTIFIERS:
        found.append(f"has more than {QUANTIFIERS} quantifiers")
    if bare.count("(") > GROUPS:
        found.append(f"has more than {GROUPS} groups")
    return found + [f"has a dangerous shape: {d}" for d in DANGEROUS if re.search(d, bare)]


def safe_steps(steps: Sequence[Step]) -> tuple[Step, ...]:
    """Steps whose patterns are safe; an error names the others."""
    bad = {s.pattern: p for s in steps if (p := pattern_problems(s.pattern))}
    if bad:
        raise ValueError(f"unsafe patterns: {bad}")
    return tuple(steps)


def match_places(t: Column, pattern: str) -> Column:
    """All matches of a pattern that matches no empty string: begin (from 1) and text, in order.

    What stands between matches, and the matches, add up to the text; so places are running sums of lengths.
    """

    def placed(x: Column) -> Column:
        between, found = x["between"], x["found"]
        ends = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<begin:int,hit:string>>").alias("out")), lambda a, m: step(a, m, between))
        return ends["out"]

    def step(a: Column, m: Column, between: Column) -> Column:
        begin = a["at"] + F.length(F.get(between, a["n"])) + 1
        return F.struct((begin - 1 + F.length(m)).alias("at"), (a["n"] + 1).alias("n"), F.concat(a["out"], F.array(F.struct(begin.alias("begin"), m.alias("hit")))).alias("out"))

    return T.bind(F.struct(F.split(t, pattern, -1).alias("between"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found")), placed)


def all_matches(sections: DataFrame, steps: Sequence[Step], id_col: str = "doc_id", text_col: str = "body", around: int = 100) -> DataFrame:
    """A row for every match of every step: its number, place, surroundings and an id that names all three."""
    def hits(s: Step) -> Column:
        about = [F.lit(s.skill).alias("skill"), F.lit(s.step).alias("step"), F.lit(s.issue).alias("issue"), F.lit(s.severity).alias("severity")]
        return F.transform(match_places(T.text(text_col), f"(?iu){s.pattern}"), lambda m, i: F.struct(*about, (i + 1).alias("match"), m["begin"].alias("begin"), m["hit"].alias("hit")))

    parts = [hits(s) for s in safe_steps(steps)]
    rows = sections.select(id_col, "index", F.col(text_col).alias("_t"), F.inline(F.concat(*parts)))
    begin = F.greatest(F.col("begin") - around, F.lit(1))
    evidence = F.substring(F.col("_t"), begin, F.col("begin") + F.length("hit") + around - begin)
    name = F.format_string("%s_%d_step%d_match%d", "skill", "index", "step", "match")
    return rows.select(id_col, "index", "skill", "step", "issue", "severity", "match", "begin", "hit", evidence.alias("evidence"), name.alias("finding_id"))


def dedupe_matches(found: DataFrame, keys: Sequence[str] = ("doc_id",), prefix: int = 50) -> DataFrame:
    """The first of the matches with the same skill, issue, severity and beginning of the evidence."""
    by = Window.partitionBy(*keys, "skill", "issue", "severity", F.substring("evidence", 1, prefix)).orderBy("index", "step", "match")
    return found.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def step_patterns(steps: DataFrame, patterns: DataFrame) -> DataFrame:
    """Steps (skill, step, content) with the patterns (name, a bounded catalogue) whose name has a word that the step has."""
    word = F.exists(F.split("name", "_"), lambda w: (w != "") & F.contains(F.lower("content"), F.lower(w)))
    return steps.join(F.broadcast(patterns), word).select(*[steps[c] for c in steps.columns], "name")


def index_stats(skills: DataFrame) -> DataFrame:
    """How many skills, and how many different domains, tags, platforms and frameworks they name."""
    kinds = ("domains", "tags", "platforms", "frameworks")
    named = lambda c: F.transform(c, lambda x: F.struct(F.lit(c).alias("kind"), x.alias("value")))
    each = skills.select(F.explode(F.concat(*map(named, kinds))).alias("x")).select("x.*").distinct()
    counts = each.groupBy().agg(*[F.count_if(F.col("kind") == c).alias(c) for c in kinds])
    return skills.agg(F.count_distinct("name").alias("skills")).crossJoin(F.broadcast(counts))  # one row each


def with_value(skills: DataFrame, kind: str, value: str) -> DataFrame:
    """Skills of a domain or with a tag, by name."""
    return skills.where(F.array_contains(kind, value)).orderBy("name")
