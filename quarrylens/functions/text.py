"""String, hash and array functions, all as expressions that stay in the JVM.

Sentinels are empty strings, not nulls, as in the data model: a null argument counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and endings that identity keys leave out.
STOPWORDS = (
    "the a an is are was were be been to of in on at for with and or not no this that it its as by from has have there "
    "which but design document section should must may will"
).split()
SUFFIXES = ("ations", "ation", "ingly", "ing", "edly", "ies", "ied", "es", "ed", "ly", "s")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value taken once: a lambda's body takes anything else anew for every element."""
    return F.transform(F.array(value), f)[0]


def collapse(c: Column | str) -> Column:
    """White space collapsed: a single space, which most of it is, is no match and stays."""
    return F.regexp_replace(text(c), r"[\t\n\x0B\f\r]\s*| \s+", " ")


def normalise(c: Column | str) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(collapse(c))


def words_only(c: Column | str) -> Column:
    """Lower case without punctuation; letters of any script count as letters."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def fold_typography(c: Column | str) -> Column:
    """Curly quotes and dashes made plain, markdown marks dropped, lower case, white space collapsed."""
    plain = F.translate(text(c), "‘’“”–—‑", "''\"\"---")
    return F.trim(normalise(F.regexp_replace(plain, r"[*_`#>]", "")))


def words(c: Column | str) -> Column:
    """The words between white space; none of a blank text."""
    return F.filter(F.split(F.trim(collapse(c)), " "), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    spaces = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
    return bind(F.trim(collapse(c)), lambda t: F.when(t == "", 0).otherwise(spaces(t) + 1))


def excerpt(c: Column | str, limit: int = 400) -> Column:
    t = text(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def shorten(c: Column | str, limit: int) -> Column:
    t = F.trim(collapse(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def citation(source: Column | str, clause: Column | str) -> Column:
    return F.concat_ws(" ", text(source), F.nullif(text(clause), F.lit("")))


def clause_label(c: Column | str) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(text(c)), "^§+", ""))
    return F.when(bare == "", "").otherwise(F.concat(F.lit("§"), bare))


def stem(word: Column) -> Column:
    """The first ending that leaves three characters or more goes, and then a final e of a longer word."""
    cut = F.coalesce(*[F.when(word.endswith(s) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in SUFFIXES], word)
    return F.when(cut.endswith("e") & (F.length(cut) > 4), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def alnum_words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def issue_tokens(c: Column | str) -> Column:
    """Distinct stems of the words that carry meaning."""
    kept = F.filter(alnum_words(c), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))
    return F.array_distinct(F.transform(kept, stem))


def long_tokens(c: Column | str, longer_than: int = 3, without: Sequence[str] = ()) -> Column:
    keep = lambda w: (F.length(w) > longer_than) & (~w.isin(list(without)) if without else F.lit(True))
    return F.array_distinct(F.filter(alnum_words(c), keep))


def semantic_key(issue: Column | str) -> Column:
    """A digest of the issue's first twelve stems in order of the alphabet: free of word order and tense."""
    return F.substring(F.sha1(F.array_join(F.slice(F.array_sort(issue_tokens(issue)), 1, 12), " ").cast("binary")), 1, 12)


def alnum_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "")


def fingerprint(domain: Column | str, section: Column | str, rule_id: Column | str, issue: Column | str) -> Column:
    """A finding's identity: domain, section and rule, or the issue's key where there is no rule."""
    problem = F.when(text(rule_id) != "", text(rule_id)).otherwise(semantic_key(issue))
    basis = F.concat_ws("|", F.trim(F.lower(text(domain))), F.substring(alnum_key(section), 1, 60), problem)
    return F.substring(F.sha2(basis.cast("binary"), 256), 1, 16)


def problem_key(rule_id: Column | str, domain: Column | str, issue: Column | str) -> Column:
    return F.when(text(rule_id) != "", text(rule_id)).otherwise(F.concat(text(domain), F.lit(":"), F.substring(F.lower(text(issue)), 1, 80)))


def slug(c: Column | str, limit: int = 48) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(made == "", "item").otherwise(made)


def review_key(project: Column | str, stage: Column | str, sha256: Column | str) -> Column:
    return F.concat_ws("/", text(project), text(stage), F.substring(text(sha256), 1, 12))


def chunk_id(domain: Column | str, source: Column | str, clause: Column | str, ordinal: Column | str, piece: Column | str) -> Column:
    number = (F.col(ordinal) if isinstance(ordinal, str) else ordinal).cast("string")
    basis = F.concat_ws("|", text(domain), text(source), text(clause), number, F.substring(text(piece), 1, 80))
    return F.substring(F.sha1(basis.cast("binary")), 1, 20)


def signature(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[text(p) for p in parts]).cast("binary"), 256)


def markdown_cell(c: Column | str) -> Column:
    return F.trim(F.replace(F.replace(text(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def html_escape(c: Column | str) -> Column:
    out = text(c)
    for raw, made in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(made))
    return out


def html_label(c: Column | str) -> Column:
    """A diagram label's text: breaks and tags become spaces, the common entities characters."""
    out = F.regexp_replace(text(c), r"(?i)<br\s*/?>|</(?:div|p|li)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for raw, made in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(raw), F.lit(made))
    return F.trim(collapse(out))


def severity(c: Column | str) -> Column:
    """One of four severities. Aliases are fixed values; what is unknown is MEDIUM."""
    aliases = {"CRIT": "CRITICAL", "BLOCKER": "CRITICAL", "SEVERE": "CRITICAL", "P1": "CRITICAL", "IMPORTANT": "HIGH", "MAJOR": "HIGH", "P2": "HIGH", "MODERATE": "MEDIUM", "MED": "MEDIUM", "NORMAL": "MEDIUM", "P3": "MEDIUM", "MINOR": "LOW", "INFO": "LOW", "INFORMATIONAL": "LOW", "TRIVIAL": "LOW", "P4": "LOW"}
    up = F.trim(F.upper(text(c)))
    out = F.when(up.isin(list(SEVERITIES)), up)
    for alias, name in aliases.items():
        out = out.when(up == alias, name)
    return out.otherwise("MEDIUM")


def last_name(c: Column | str) -> Column:
    """What follows the last stop, in upper case: ``Severity.HIGH`` is HIGH."""
    return F.upper(F.trim(F.split_part(text(c), F.lit("."), F.lit(-1))))


def severity_rank(c: Column | str) -> Column:
    known = F.array(*[F.lit(s) for s in SEVERITIES])
    at = F.array_position(known, F.col(c) if isinstance(c, str) else c)
    return F.when(at > 0, at - 1).otherwise(9).cast("int")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared tokens over all tokens; 0 where either has none."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column | str, b: Column | str, by: str = "min") -> Column:
    """Shared tokens over the smaller (``min``) or larger (``max``) set."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = F.least(F.size(a), F.size(b)) if by == "min" else F.greatest(F.size(a), F.size(b))
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / size).otherwise(F.lit(0.0))


def runs(quote: Column | str, n: int = 6) -> Column:
    """All runs of ``n`` words of a quote (ellipses are gaps); none if it is shorter."""
    none = F.array().cast("array<string>")
    cut = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)
    return bind(words(words_only(F.regexp_replace(text(quote), r"\.\.\.|…", " "))), cut)


def grounded(quote: Column | str, document: Column | str, n: int = 6) -> Column:
    """Whether some run of ``n`` words of the quote stands in the document, which is looked into only if there is a run."""
    return bind(runs(quote, n), lambda asked: (F.size(asked) > 0) & bind(words_only(document), lambda doc: F.exists(asked, lambda r: F.contains(doc, r))))


def quote_in_document(quote: Column | str, document: Column | str, least: int = 4) -> Column:
    q = words_only(quote)
    return (F.size(words(q)) >= least) & F.contains(words_only(document), q)


def asserts_absence(quote: Column | str) -> Column:
    return F.rlike(F.lower(text(quote)), F.lit(r"\b(?:no|not|never|without|none|neither|nor|lacks?|lacking|absent|missing|cannot|isn't|aren't|doesn't|don't|won't)\b"))


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a string that is not empty."""
    return ((F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)).cast("int")


def match_excerpt(t: Column | str, pattern: Column, around: int = 110) -> Column:
    """The first match with its surroundings, white space collapsed and cut ends marked; empty if there is none."""
    t = text(t)
    at = F.regexp_instr(t, pattern)
    begin = F.greatest(at - around, F.lit(1))
    end = F.least(at + F.length(F.regexp_substr(t, pattern)) - 1 + around, F.length(t))
    cut = F.trim(collapse(F.substring(t, begin, end - begin + 1)))
    marked = F.concat(F.when(begin > 1, "...").otherwise(""), cut, F.when(end < F.length(t), "...").otherwise(""))
    return F.when(at > 0, marked).otherwise("")


def half_even(c: Column, digits: int) -> Column:
    """Rounded with halves to even, as IEEE rounding of decimal digits does."""
    return F.bround(c, digits)


def saturating(raw: Column, scale: float = 120.0) -> Column:
    return F.least(F.lit(100.0), 100.0 * (1 - F.exp(-raw / scale)))


def citation_confidence(similarity: Column) -> Column:
    return F.least(F.lit(0.95), 0.6 + 0.4 * similarity)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", 100.0 * x)


def model_family(c: Column | str) -> Column:
    return F.regexp_extract(F.lower(text(c)), r"^(?:.*/)?([a-z]+)", 1)


def message_text(parts: Column) -> Column:
    """The text of a message's parts, in order."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def loose_json(c: Column | str) -> Column:
    """A JSON value: the whole text, else what stands between its first and last brace; null if neither parses."""
    return F.coalesce(F.try_parse_json(text(c)), F.try_parse_json(F.nullif(F.regexp_extract(text(c), r"(?s)\{.*\}", 0), F.lit(""))))


def narrative_parts(c: Column | str, heading: str = "Assurance Opinion") -> Column:
    """Summary and opinion, which a heading divides."""
    parts = F.split(text(c), rf"(?m)^#+\s*{heading}\s*$", 2)
    return F.struct(F.trim(parts[0]).alias("summary"), F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1)))).otherwise("").alias("opinion"))


def zone_rank(zone: Column | str, order: Sequence[str] = ("internet", "partner", "dmz", "internal", "application", "data", "management", "unknown")) -> Column:
    """A zone's place from the outside in; what is not listed comes last."""
    at = F.array_position(F.array(*[F.lit(z) for z in order]), text(zone))
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def now_utc() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def quote_grounded(quote: Column | str, document: Column | str, least: int = 5, most: int = 6) -> Column:
    """As ``grounded``, for short quotes too: a quote of ``least`` words or more, whole if it is shorter than a run."""
    n = F.size(words(words_only(quote)))
    return F.when(n < least, F.lit(False)).when(n < most, F.contains(words_only(document), words_only(quote))).otherwise(grounded(quote, document, most))


def joined_text(c: Column | str) -> Column:
    """A list's values in one text, divided by semicolons."""
    return F.array_join(c, "; ")


def mapped_text(c: Column | str) -> Column:
    """A map's entries in one text: name, colon, value, divided by semicolons, in order of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def cache_name(path: Column | str) -> Column:
    return F.md5(text(path).cast("binary"))


def model_names(config: Column | str) -> Column:
    """The models that a configuration text names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text(config), F.lit(r"(?m)^\s*[\w-]*model\w*\s*:\s*[\"']?([\w./:-]+)"), F.lit(1)))


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
