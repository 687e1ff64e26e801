"""Documents and specifications to text, by file type. Files are read by Spark; each is parsed by itself in a task."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T

# Bounds of what is unpacked and listed.
INFLATED, FILES, DEPTH, ITEMS, SCHEMAS, FIELDS = 16 << 20, 200, 4, 40, 60, 15
METHODS = ("get", "put", "post", "delete", "patch", "head", "options")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_files(spark: SparkSession, path: str, pattern: str = "*.{md,markdown,txt}") -> DataFrame:
    """Path and text of plain files; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return _decoded(files, lambda b: b.decode("utf-8", "replace"))


def _decoded(files: DataFrame, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [parse(bytes(c)) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def docx_text(data: bytes) -> str:
    """Paragraphs as lines, heading styles as ``#`` marks, tables as headed rows of cells."""
    out, tables = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    words = lambda e: "".join(x.text or "" for x in e.iter(f"{W}t")).strip()
    for e in body if body is not None else ():
        if e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            name = (style.get(f"{W}val") or "").lower() if style is not None else ""
            level = 1 if name == "title" else int(m[1]) if (m := re.match(r"heading\s?(\d)", name)) else 0
            if line := words(e):
                out.append(f"{'#' * min(level, 6)} {line}" if level else line)
        elif e.tag == f"{W}tbl":
            tables += 1
            out.append(f"#### Table {tables}")
            out += ["| " + " | ".join(words(c) for c in row.iter(f"{W}tc")) + " |" for row in e.iter(f"{W}tr")]
    return "\n\n".join(out)


def openapi_text(spec: dict) -> str:
    """A specification as headed prose: servers, security, operations, schemas."""
    info = spec.get("info") or {}
    out = [f"# {info.get('title', 'API')}", str(info.get("description") or "")]
    servers = [str(s.get("url")) for s in spec.get("servers") or [] if isinstance(s, dict)]
    if servers:
        out.append("## Servers\n" + "\n".join(f"- {u}" + (" (plain HTTP)" if u.startswith("http://") else "") for u in servers))
    parts = spec.get("components") or {}
    schemes = parts.get("securitySchemes") or spec.get("securityDefinitions") or {}
    if schemes:
        out.append("## Security schemes\n" + "\n".join(f"- {k}: {v.get('type')} {v.get('scheme') or v.get('in') or ''}".rstrip() for k, v in schemes.items() if isinstance(v, dict)))
    own = spec.get("security")
    out.append("## Default security\n" + (", ".join(k for s in own for k in s) if own else "No security applies by default."))
    lines = []
    for path, methods in (spec.get("paths") or {}).items():
        for method, op in (methods or {}).items():
            if method.lower() in METHODS and isinstance(op, dict):
                security = op.get("security", own)
                note = "no authentication" if security == [] or security is None else ", ".join(k for s in security for k in s)
                lines.append(f"- {method.upper()} {path}: {op.get('summary') or op.get('operationId') or ''} ({note})")
    if lines:
        out.append("## Operations\n" + "\n".join(lines))
    schemas = parts.get("schemas") or spec.get("definitions") or {}
    if schemas:
        out.append("## Schemas\n" + "\n".join(f"- {k}: {', '.join(list((v or {}).get('properties') or {})[:FIELDS])}" for k, v in list(schemas.items())[:SCHEMAS]))
    return "\n\n".join(p for p in out if p)


def flattened(value: object, name: str = "", depth: int = 0) -> list[tuple[str, str]]:
    """Paths and values of a nested one; what lies too deep, or past the first items of a list, is left out."""
    if depth > DEPTH:
        return []
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flattened(v, f"{name}.{k}" if name else str(k), depth + 1)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value[:ITEMS]) for x in flattened(v, f"{name}[{i}]", depth + 1)]
    return [(name, "" if value is None else str(value))]


def structured_text(data: bytes) -> str:
    """JSON (or YAML, where a parser is installed) as prose; what does not parse to a mapping stays as it is."""
    raw = data.decode("utf-8", "replace")
    try:
        spec = json.loads(raw)
    except ValueError:
        try:
            import yaml

            spec = yaml.safe_load(raw)
        except Exception:  # noqa: BLE001  no parser, or not YAML
            return raw
    if not isinstance(spec, dict):
        return raw
    return openapi_text(spec) if "openapi" in spec or "swagger" in spec else "\n".join(f"- {k}: {v}" for k, v in flattened(spec))


PARSERS = {"md": lambda b: b.decode("utf-8", "replace"), "markdown": lambda b: b.decode("utf-8", "replace"), "txt": lambda b: b.decode("utf-8", "replace"), "docx": docx_text, "json": structured_text, "yaml": structured_text, "yml": structured_text}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Path, format and text of all files below a path; an unknown type is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unknown = sorted(set(b["format"]) - set(PARSERS))
            if unknown:
                raise ValueError(f"no reader for {unknown}")
            yield pd.DataFrame({"path": b["path"], "format": b["format"], "text": [PARSERS[k](bytes(c)) for k, c in zip(b["format"], b["content"], strict=True)]})

    return files.select("path", kind.alias("format"), "content").mapInPandas(run, "path string, format string, text string")


def pdf_headings(spans: DataFrame) -> DataFrame:
    """Text spans (doc_id, page, pos, text, size, bold) to lines with heading marks, by size against the median."""
    median = spans.groupBy("doc_id").agg(F.median("size").alias("median"))
    s, line = spans.join(median, "doc_id"), F.trim("text")
    numbered = F.rlike(line, F.lit(r"^\d+(?:\.\d+)*\.?\s+\S"))
    short = F.length(line) < 90
    heading = (F.col("size") >= 1.15 * F.col("median")) | (F.col("bold") & (F.col("size") >= F.col("median")) & short) | (numbered & short)
    mark = F.when(heading, F.when(F.col("size") >= 1.4 * F.col("median"), "# ").otherwise("## ")).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("page", "pos", F.concat(mark, line).alias("t"))))
    return s.where(line != "").groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))


def from_text(spark: SparkSession, text: str, name: str = "pasted-input") -> DataFrame:
    return spark.createDataFrame([(name, text)], "path string, text string")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; a torn line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def flat_properties(c: Column) -> Column:
    """A flat JSON object's entries as (name, value) rows' array, in order of their names."""
    entries = F.map_entries(F.from_json(T.text(c), t.MapType(t.StringType(), t.StringType())))
    return F.array_sort(entries)


def knowledge_files(spark: SparkSession, path: str, folders: dict[str, str]) -> DataFrame:
    """Knowledge texts with the domain of their folder; templates and hidden names are left out."""
    files = text_files(spark, path)
    domain = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv])[F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)]
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(~F.contains("path", F.lit("/_templates/")) & ~name.startswith("_")).select(name.alias("source"), domain.alias("domain"), "text").where("domain is not null")


def front_matter(files: DataFrame) -> DataFrame:
    """Name, description, domains and tags from a text's front matter (plain ``key: value`` lines and inline lists)."""
    head = F.regexp_extract("text", r"(?s)^---\s*\n(.*?)\n---", 1)
    value = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1))
    items = lambda k: F.filter(F.transform(F.split(F.regexp_replace(value(k), r"[\[\]\"']", ""), ","), F.trim), lambda x: x != "")
    return files.select("path", F.coalesce(F.nullif(value("name"), F.lit("")), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).alias("name"), value("description").alias("description"), *[items(k).alias(k) for k in ("domains", "tags", "platforms", "frameworks")])


def workflow_steps(files: DataFrame) -> DataFrame:
    """The numbered steps of a workflow text."""
    parts = F.split("text", r"(?m)^### Step \d+:?")
    return files.select("path", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("step", "t")).select("path", (F.col("step") + 1).alias("step"), F.trim(F.split("t", "\n")[0]).alias("title"), F.trim("t").alias("content"))
