"""What a design's prose names: components and the connections between them, quotes and the sections that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of components, and the nouns that end their names.
KINDS = (
    ("database", r"(?:data\s?base|db|warehouse|data\s?store)"),
    ("gateway", r"(?:gateway|load\s?balancer|proxy|firewall)"),
    ("queue", r"(?:queue|broker|topic|event\s?bus)"),
    ("cache", r"(?:cache)"),
    ("storage", r"(?:bucket|storage|blob|file\s?share)"),
    ("service", r"(?:service|server|api|application|app|backend|worker)"),
    ("client", r"(?:client|browser|front\s?end|portal|device)"),
    ("external", r"(?:provider|partner|third\s?party|vendor)"),
)
#: What says that the name before it sends something to the name after it.
SENDS = r"(?:->|→|-->|\b(?:connects?|sends?|forwards?|routes?|writes?|publishes|calls?|talks?|replicates?)\b(?:\s+\w+){0,3}?\s+(?:to|with)\b|\b(?:reads?|pulls?)\b(?:\s+\w+){0,2}?\s+from\b|\bcalls?\b)"


def component_mentions(sections: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """Every mention of a component: its kind, its name (the noun with the word before it) and its place in the document."""
    before = r"(?!(?i:the|a|an|each|every|this|that|our|its|and|or|to|of)\b)[a-z][\w-]*"

    def named(n: int, kind: str, noun: str) -> Column:
        found = F.regexp_extract_all(F.col("_t"), F.lit(rf"(?iu)\b({before}[ \t]+{noun})s?\b"), F.lit(1))
        return F.transform(found, lambda m: F.struct(F.lit(n).alias("ord"), F.lit(kind).alias("kind"), m.alias("name")))

    kinds = [named(n, k, noun) for n, (k, noun) in enumerate(KINDS)]
    rows = sections.select(id_col, "index", T.text(text_col).alias("_t")).select(id_col, "index", "_t", F.inline(F.concat(*kinds)))
    return rows.select(id_col, "index", "ord", "kind", "name", F.instr("_t", F.col("name")).alias("at"))


def components(sections: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """One component for all mentions of a name in a document, with the kind of the first of them."""
    named = component_mentions(sections, id_col, text_col).withColumn("id", T.slug("name"))
    first = F.struct("index", "at", "ord")
    return named.groupBy(F.col(id_col).alias("document"), "id").agg(F.initcap(F.min_by("name", first)).alias("name"), F.min_by("kind", first).alias("kind"), F.count(F.lit(1)).alias("mentions"))


def connections(sections: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """Flows between the components that stand nearest before and after a word of sending, sentence by sentence.

    Sentences with two known components or more are the only ones looked into; both ends are chosen by place alone.
    """
    names = known.groupBy("document").agg(F.collect_list(F.struct("id", F.lower("name").alias("low"))).alias("_names"))
    split = F.split(T.text(text_col), r"(?<=[.!?])\s+|\n+")
    said = sections.select(F.col(id_col).alias("document"), "index", F.posexplode(split).alias("nth", "sentence")).where(F.rlike("sentence", F.lit(f"(?iu){SENDS}")))
    parts = F.split("sentence", f"(?iu){SENDS}", 2)
    both = said.join(names, "document").withColumns({"_l": F.lower(parts[0]), "_r": F.lower(F.get(parts, F.lit(1)))})

    def nearest(text: str, after: bool) -> Column:
        place = lambda x: F.instr(F.col(text), x["low"]) if after else F.instr(F.reverse(text), F.reverse(x["low"]))
        there = F.filter(F.transform("_names", lambda x: F.struct(place(x).alias("at"), (-F.length(x["low"])).alias("short"), x["id"].alias("id"))), lambda x: x["at"] > 0)
        return F.get(F.array_sort(there), F.lit(0))["id"]

    found = both.select("document", "index", "nth", nearest("_l", False).alias("source"), nearest("_r", True).alias("target"), "sentence")
    return found.where("source is not null and target is not null and source <> target")


def quote_sections(quotes: DataFrame, sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Quotes (id_col, quote_id, quote) with the first section of their document that holds them, else its first."""
    held = F.contains(T.normalise(F.concat_ws("\n", "heading", "body")), T.normalise("quote")) & (F.trim("quote") != "")
    at = F.struct((~held).cast("int"), "index")
    return quotes.join(sections.select(id_col, "index", "heading", "body"), id_col, "left").groupBy(id_col, "quote_id").agg(F.min_by("heading", at).alias("section"), F.coalesce(F.max(held), F.lit(False)).alias("held"))


def sections_with_findings(sections: DataFrame, findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every section with the number of findings under its heading and the worst severity of them."""
    by = findings.groupBy(id_col, T.normalise(F.trim("section")).alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.min(T.severity_rank("severity")).alias("_worst"))
    both = sections.withColumn("_h", T.normalise(F.trim("heading"))).join(by, [id_col, "_h"], "left")
    worst = F.get(F.array(*map(F.lit, T.SEVERITIES)), F.col("_worst"))
    return both.select(*[sections[c] for c in sections.columns], F.coalesce("n", F.lit(0)).alias("findings"), worst.alias("worst"))


def salvaged_objects(c: Column | str, key: str) -> Column:
    """The complete flat objects of a list in JSON that may break off, as text: those before the break are whole."""
    body = F.regexp_extract(T.text(c), rf'(?s)"{key}"\s*:\s*\[(.*)', 1)
    lead = F.regexp_extract(body, r'(?s)^((?:\s*,?\s*\{(?:[^{}"]|"(?:\\.|[^"\\])*")*\})*)', 1)
    return F.regexp_extract_all(lead, F.lit(r'(?s)\{(?:[^{}"]|"(?:\\.|[^"\\])*")*\}'), F.lit(0))


def tool_calls(c: Column | str, names: list[str]) -> Column:
    """Calls that prose holds as JSON objects (name, arguments): those of known tools, in order."""
    call = F.regexp_extract_all(T.text(c), F.lit(r'(?s)\{\s*"name"\s*:\s*"[^"]+"\s*,\s*"(?:arguments|parameters)"\s*:\s*\{[^{}]*\}\s*\}'), F.lit(0))
    made = F.transform(call, lambda s: F.struct(F.regexp_extract(s, r'"name"\s*:\s*"([^"]+)"', 1).alias("name"), F.regexp_extract(s, r'(?s)"(?:arguments|parameters)"\s*:\s*(\{[^{}]*\})', 1).alias("arguments")))
    return F.filter(made, lambda x: x["name"].isin(names))


def new_searches(queries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of the searches that say the same, letter case and white space aside."""
    n = F.row_number().over(Window.partitionBy(*keys, F.trim(T.normalise("query"))).orderBy(order))
    return queries.withColumn("_n", n).where("_n = 1").drop("_n")


def merged_threats(findings: DataFrame, threats: DataFrame) -> DataFrame:
    """Findings and those of the threats that no finding has raised for its rule and section, to be scored again."""
    new = threats.join(findings.select("doc_id", "rule_id", "section").distinct(), ["doc_id", "rule_id", "section"], "left_anti")
    return findings.unionByName(new, allowMissingColumns=True)
