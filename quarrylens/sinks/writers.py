"""Reports, tables and logs, written by Spark. An immutable version is a write that fails where one exists."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def report_lines(findings: DataFrame, scored: DataFrame) -> DataFrame:
    """A markdown report a document: its status, and a table of its findings in their order (column ``place``)."""
    cell = lambda c: T.markdown_cell(F.col(c).cast("string"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell("severity"), cell("domain"), cell("section"), cell("issue"), cell("recommendation")), F.lit(" |"))
    rows = findings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    head = F.format_string("# Review of %s\n\nStatus: **%s**, risk score %.1f, %d findings\n\n| Severity | Domain | Section | Issue | Recommendation |\n|-|-|-|-|-|\n", F.col("doc_id").cast("string"), "status", "score", "n_findings")
    return scored.join(rows, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("rows", F.lit(""))).alias("report"))


def markdown_reports(findings: DataFrame, scored: DataFrame, sections: DataFrame, top: int = 3) -> DataFrame:
    """A whole report a document: status, counts by severity, first actions, a table a domain, evidence, questions, coverage.

    ``findings`` has ``place`` and the columns of a finding, ``scored`` status, score and n_findings, ``sections``
    domain. Everything of a document is one row; a document without findings has a report too.
    """
    cell = lambda c: T.markdown_cell(F.col(c).cast("string"))
    bar = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    item = F.struct("place", F.col("severity").alias("s"), F.col("domain").alias("d"), (F.col("kind") == "question").alias("q"), bar(cell("severity"), cell("section"), cell("issue"), cell("recommendation")).alias("row"), bar(cell("place"), cell("section"), cell("evidence_excerpt")).alias("proof"), cell("evidence_excerpt").alias("e"), F.concat(cell("issue"), F.lit(" ("), cell("section"), F.lit(")")).alias("short"))
    items = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    covered = sections.groupBy("doc_id", "domain").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(bar("domain", F.col("n").cast("string")))).alias("covered"))
    joined = lambda a: F.array_join(F.coalesce(a, F.array().cast("array<string>")), "\n")
    pick = lambda keep, out: F.transform(F.filter("items", keep), out)
    count = lambda s: F.size(F.filter("items", lambda x: ~x["q"] & (x["s"] == s))).cast("string")
    counts = F.concat_ws("\n", *[bar(F.lit(s), count(s)) for s in T.SEVERITIES])
    domains = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: ~x["q"]), lambda x: x["d"])))
    tables = F.array_join(F.transform(domains, lambda d: F.concat(F.lit("### "), d, F.lit("\n\n| Severity | Section | Issue | Recommendation |\n|-|-|-|-|\n"), joined(F.transform(F.filter(F.col("items"), lambda x: ~x["q"] & (x["d"] == d)), lambda x: x["row"])))), "\n\n")
    actions = F.transform(F.slice(pick(lambda x: ~x["q"], lambda x: x["short"]), 1, top), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    head = F.format_string("# Review of %s\n\nStatus: **%s**, risk score %.1f, %d findings", F.col("doc_id").cast("string"), "status", "score", "n_findings")
    parts = [
        head, F.concat(F.lit("## Severity\n\n| Severity | Findings |\n|-|-|\n"), counts), F.concat(F.lit("## First actions\n\n"), joined(actions)), F.concat(F.lit("## Findings\n\n"), tables),
        F.concat(F.lit("## Evidence\n\n| Finding | Section | Text |\n|-|-|-|\n"), joined(pick(lambda x: x["e"] != "", lambda x: x["proof"]))),
        F.concat(F.lit("## Questions\n\n"), joined(pick(lambda x: x["q"], lambda x: F.concat(F.lit("- "), x["short"])))),
        F.concat(F.lit("## Coverage\n\n| Domain | Sections |\n|-|-|\n"), joined(F.col("covered"))),
    ]
    both = scored.join(items, "doc_id", "left").join(covered, "doc_id", "left")
    empty = F.array().cast(items.schema["items"].dataType)
    return both.withColumn("items", F.coalesce("items", empty)).select("doc_id", F.concat_ws("\n\n", *parts).alias("report"))


def acknowledgements(findings: DataFrame, reason: Column | str = "") -> DataFrame:
    """What a gate takes as acknowledged: fingerprints with their severity and issue, and why; the worst first."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return findings.select("fingerprint", "severity", "issue", why.alias("reason")).dropDuplicates(["fingerprint"]).orderBy(T.severity_rank("severity"), "fingerprint")


def review_sheet(df: DataFrame, path: str, first: str) -> None:
    """CSV that a spreadsheet opens as UTF-8: the name of the first column carries the byte order mark."""
    write_csv(df.withColumnRenamed(first, "\ufeff" + first), path)


def file_stem(c: Column | str, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(T.text(c), r"[^A-Za-z0-9._-]+", "_"), 1, most)


def csv_ready(df: DataFrame, joined: str = "|") -> DataFrame:
    """Arrays as joined strings, so that a table can go to CSV."""
    return df.select(*[F.array_join(c, joined).alias(c) if k.startswith("array<string") else F.col(c) for c, k in df.dtypes])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    csv_ready(df).write.mode(mode).option("header", True).option("multiLine", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def save_draft(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/draft")


def save_version(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("errorifexists").parquet(f"{path}/v{version}")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """The partitions that ``df`` has, replaced; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def xlsx_bytes(columns: list[str], rows: list[tuple]) -> bytes:
    """One sheet of strings, for a register that fits a sheet."""
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(columns), *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Register" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()
