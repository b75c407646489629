"""Office documents as Markdown, one file per row, with limits against archives that inflate without end."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.files import extension

#: Most bytes of a file, of what it inflates to, and most times it may grow.
MOST_RAW, MOST_INFLATED, MOST_RATIO = 50 << 20, 512 << 20, 200
_CELL = re.compile(r"([A-Z]+)[0-9]+$")


def _parts(raw: bytes) -> zipfile.ZipFile:
    """The archive, if its members keep within the limits."""
    if len(raw) > MOST_RAW:
        raise ValueError("file too large")
    z = zipfile.ZipFile(io.BytesIO(raw))
    size = sum(i.file_size for i in z.infolist())
    if size > MOST_INFLATED or size > MOST_RATIO * max(len(raw), 1):
        raise ValueError("inflates too much")
    return z


def _tree(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = z.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("declarations are not read")
    return ElementTree.fromstring(raw)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element) -> str:
    return "".join("\t" if _local(x) == "tab" else (x.text or "") for x in e.iter() if _local(x) in ("t", "tab"))


def _table(rows: list[list[str]]) -> list[str]:
    width = max(map(len, rows), default=0)
    cells = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return [*lines[:1], "|" + "-|" * width, *lines[1:]] if width else []


def document_text(raw: bytes) -> str:
    """Paragraphs, headings by their style, then the tables."""
    body = _tree(_parts(raw), "word/document.xml")
    in_table = {id(p) for t in body.iter() if _local(t) == "tbl" for p in t.iter() if _local(p) == "p"}
    out = []
    for p in body.iter():
        if _local(p) == "p" and id(p) not in in_table and (t := _text(p).strip()):
            style = next((v for x in p.iter() if _local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            level = re.match(r"(?i)heading\s*([1-6])", style)
            out.append("#" * int(level[1]) + " " + t if level else t)
    for t in body.iter():
        if _local(t) == "tbl":
            out += _table([[_text(c).strip() for c in r if _local(c) == "tc"] for r in t.iter() if _local(r) == "tr"])
    return "\n\n".join(out)


def workbook_text(raw: bytes) -> str:
    """A table for each sheet under its name."""
    z = _parts(raw)
    names = z.namelist()
    shared = [_text(s) for s in _tree(z, "xl/sharedStrings.xml") if _local(s) == "si"] if "xl/sharedStrings.xml" in names else []
    titles = [s.attrib.get("name", "") for s in _tree(z, "xl/workbook.xml").iter() if _local(s) == "sheet"]
    sheets = sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for i, n in enumerate(sheets):
        rows = []
        for r in _tree(z, n).iter():
            if _local(r) != "row":
                continue
            row: list[str] = []
            for c in r:
                at = _CELL.match(c.attrib.get("r", ""))
                place = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(at[1]))) - 1 if at else len(row)
                value = "".join(x.text or "" for x in c.iter() if _local(x) in ("v", "t"))
                row += [""] * (min(place, 16_384) - len(row))
                row.append(shared[int(value)] if c.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            rows.append(row)
        out.append("\n".join([f"## {titles[i] if i < len(titles) else n}", "", *_table(rows)]))
    return "\n\n".join(out)


def office_text(files: DataFrame) -> DataFrame:
    """(path, text, error) of the .docx and .xlsx rows of (path, content); text is null where there is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    rows.append((path, (document_text if path.lower().endswith("docx") else workbook_text)(bytes(raw)), None))
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, RuntimeError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    own = files.where(extension(F.col("path")).isin("docx", "xlsx")).select("path", F.col("content").cast("binary").alias("content"))
    return own.mapInPandas(run, "path string, text string, error string")
