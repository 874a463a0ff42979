"""Members of archives and the text of Office files, with the standard library only."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import chunking, detect, markup

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"


def members(data: bytes, fmt: str) -> list[tuple[str, bytes]]:
    """(path, bytes) of the files in a zip or tar archive; a gz file has one member ``extracted``. An empty or broken
    archive has none."""
    try:
        if fmt == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        if fmt == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                return [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
        if fmt == "gz":
            return [("extracted", gzip.decompress(data))]
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError, ValueError):
        pass
    return []


def _heading(level: int, text: str) -> str:
    return f"{'#' * level} {text}" if level and text else text


def docx_text(data: bytes) -> str | None:
    """Paragraphs; headings get as many ``#`` as their level, a title one; table cells are parted by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def paragraph(p) -> str:
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        m = re.fullmatch(r"Heading ?(\d)", name)
        text = "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else (x.text or "") for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        return _heading(int(m.group(1)) if m else int(name == "Title"), text.strip())

    out = []
    for x in body if body is not None else []:
        if x.tag == f"{_W}p":
            out.append(paragraph(x))
        elif x.tag == f"{_W}tbl":
            out += ["\t".join(" ".join(map(paragraph, c.iter(f"{_W}p"))) for c in r.iter(f"{_W}tc")) for r in x.iter(f"{_W}tr")]
    return "\n".join(x for x in out if x).strip() or None


def odt_text(data: bytes) -> str | None:
    """Paragraphs and headings of an OpenDocument file; rows of a sheet are parted by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    out = []

    def walk(x) -> None:
        if x.tag == f"{_T}h":
            out.append(_heading(int(x.get(f"{_T}outline-level", "1")), "".join(x.itertext()).strip()))
        elif x.tag == f"{_T}p":
            out.append("".join(x.itertext()).strip())
        elif x.tag == f"{_TABLE}table-row":
            out.append("\t".join("".join(c.itertext()).strip() for c in x if c.tag == f"{_TABLE}table-cell").rstrip("\t"))
        else:
            for child in x:
                walk(child)

    walk(root)
    return "\n".join(x for x in out if x).strip() or None


def xlsx_text(data: bytes) -> str | None:
    """Rows with tabs between cells, blank ones left out; several sheets get a line with their name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = []
        for s in book.iter(f"{_S}sheet"):
            target = rels.get(s.get(f"{_R}id"), "").lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            rows = []
            for row in ElementTree.fromstring(z.read(target)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells.append(shared[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text)
                if any(x.strip() for x in cells):
                    rows.append("\t".join(cells))
            if rows:
                sheets.append((s.get("name", ""), rows))
    parts = [("--- Sheet: " + n + " ---\n" if len(sheets) > 1 else "") + "\n".join(r) for n, r in sheets]
    return "\n".join(parts).strip() or None


_READERS = {"docx": docx_text, "odt": odt_text, "ods": odt_text, "xlsx": xlsx_text}


def office_text(data: bytes, fmt: str) -> str | None:
    """The text of an Office file, null for a broken one and for formats without a reader (old sheets and PDF)."""
    reader = _READERS.get(fmt)
    try:
        return reader(data) if reader else None
    except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
        return None


def binary_text(files: DataFrame) -> DataFrame:
    """path and text of the binary documents of a table (path, content binary): HTML by expressions, Office files here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"path": p["path"], "text": [office_text(c, f) for c, f in zip(p["content"], p["format"])]})

    rows = files.withColumn("format", detect.document_format("path"))
    office = rows.where(F.col("format").isin(list(_READERS))).select("path", "format", "content").mapInPandas(run, "path string, text string")
    pages = rows.where(F.col("format") == "html").select("path", markup.html_text(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    return office.unionByName(pages).where(F.col("text").isNotNull())


def archive_members(files: DataFrame) -> DataFrame:
    """archive, path, content of the text documents in the archives of a table (path, content binary), with its repo,
    branch and commit where it has them; not recursive."""
    extra = [c for c in ("repo", "branch", "commit") if c in files.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for path, fmt, content, *rest in p[["path", "format", "content", *extra]].itertuples(index=False):
                got = members(content, fmt)
                if got:
                    yield pd.DataFrame({"archive": [path] * len(got), "path": [m for m, _ in got], "content": [c.decode("utf-8", "replace") for _, c in got]} | {c: [v] * len(got) for c, v in zip(extra, rest)})

    rows = files.withColumn("format", detect.document_format("path")).where(F.col("format").isin(detect.ARCHIVE_FORMATS))
    schema = ", ".join(f"{c} string" for c in ("archive", "path", "content", *extra))
    found = rows.select("path", "format", "content", *extra).mapInPandas(run, schema)
    return found.where(detect.format_tier(detect.document_format("path")) == "text")


def archive_chunks(files: DataFrame, limit: int = chunking.MAX_SIZE, overlap: int = chunking.OVERLAP, strip: bool = True) -> DataFrame:
    """Chunk rows of the text documents inside the archives of a table (repo, branch, commit, path, content binary), under
    their own paths. Office files and pages inside archives give none."""
    return chunking.document_chunks(archive_members(files), limit, overlap, strip)
