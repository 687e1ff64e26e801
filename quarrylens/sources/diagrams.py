"""Diagrams to vertices and edges: draw.io pages, plain or deflated, and Visio packages."""

from __future__ import annotations

import base64
import html
import io
import re
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from .readers import FILES, INFLATED

SCHEMA = "path string, kind string, id string, label string, source string, target string"


def is_drawio(text: str) -> bool:
    return "<mxfile" in text[:4096] or "<mxGraphModel" in text[:4096]


def inflated(payload: str) -> str:
    """A deflated page's XML; one that unpacks to more than the bound is an error."""
    machine = zlib.decompressobj(-15)
    data = machine.decompress(base64.b64decode(payload), INFLATED)
    if machine.unconsumed_tail:
        raise ValueError("page too large")
    return urllib.parse.unquote(data.decode("utf-8", "replace"))


def label_text(raw: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", raw or "")).split())


def drawio_graph(text: str) -> list[tuple]:
    """(kind, id, label, source, target) of all pages; ids carry their page."""
    root, out = ElementTree.fromstring(text), []
    pages = root.findall("diagram") or [root]
    for n, page in enumerate(pages):
        model = page if page.tag == "mxGraphModel" else page.find("mxGraphModel")
        if model is None and (page.text or "").strip():
            model = ElementTree.fromstring(inflated(page.text.strip()))
        for e in model.iter() if model is not None else ():
            cell = e.find("mxCell") if e.tag in ("object", "UserObject") else e if e.tag == "mxCell" else None
            if cell is None:
                continue
            label = label_text(e.get("label") or e.get("value") or "")
            name = lambda k: f"{n}:{k}"
            if cell.get("edge") == "1" and cell.get("source") and cell.get("target"):
                out.append(("edge", name(e.get("id")), label, name(cell.get("source")), name(cell.get("target"))))
            elif cell.get("vertex") == "1" and label and e.get("id") is not None:
                out.append(("vertex", name(e.get("id")), label, "", ""))
    return out


def visio_graph(data: bytes) -> list[tuple]:
    """Shapes with a text are vertices; a shape whose two ends are connected is an edge."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n, page in enumerate(sorted(x for x in z.namelist() if re.fullmatch(r"visio/pages/page\d+\.xml", x))[:FILES]):
            if z.getinfo(page).file_size > INFLATED:
                raise ValueError("page too large")
            root = ElementTree.fromstring(z.read(page))
            tag = lambda e: e.tag.rpartition("}")[2]
            ends: dict[str, dict[str, str]] = {}
            for e in root.iter():
                if tag(e) == "Connect":
                    ends.setdefault(e.get("FromSheet"), {})[e.get("FromCell")] = e.get("ToSheet")
            for e in root.iter():
                if tag(e) == "Shape":
                    words = " ".join("".join(x.itertext()) for x in e if tag(x) == "Text").strip()
                    joined = ends.get(e.get("ID"), {})
                    if {"BeginX", "EndX"} <= set(joined):
                        out.append(("edge", f"{n}:{e.get('ID')}", words, f"{n}:{joined['BeginX']}", f"{n}:{joined['EndX']}"))
                    elif words:
                        out.append(("vertex", f"{n}:{e.get('ID')}", words, "", ""))
    return out


def diagram_rows(files: DataFrame) -> DataFrame:
    """Vertices and edges of all diagrams of a binary file table (path, content); other files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                data = bytes(content)
                if data[:2] == b"PK":
                    rows += [(path, *r) for r in visio_graph(data)]
                elif is_drawio(text := data.decode("utf-8", "replace")):
                    rows += [(path, *r) for r in drawio_graph(text)]
            yield pd.DataFrame(rows, columns=["path", "kind", "id", "label", "source", "target"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
