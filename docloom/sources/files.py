"""Original files as blocks: DOCX with the standard library alone, PDF if an optional library is installed.

Files are listed by the binaryFile source, so they are read by the executors;
one row is one file. A file that can't be read gives one row with its error
instead of failing the job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "path string, block_index int, type string, content string, page int, bbox array<double>, size double, bold boolean, style string, heading boolean, heading_level int, context string, error string"
SUFFIXES = ("pdf", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, suffix, size_bytes, modified) of all files below a folder, without their content."""
    name = F.element_at(F.split("path", "/"), -1)
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    )


def _row(**values: object) -> dict:
    base = {"type": "text", "content": "", "page": None, "bbox": None, "size": None, "bold": None, "style": None, "heading": None, "heading_level": None, "context": "", "error": None}
    return base | values


def _cells(rows: list[list[str]]) -> str:
    """Rows as a Markdown table; blank rows are left out, short ones filled up."""
    kept = [[c.replace("\n", " ").strip() for c in r] for r in rows]
    kept = [r for r in kept if any(r)]
    if not kept:
        return ""
    width = max(map(len, kept))
    full = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in kept]
    return "\n".join([full[0], "| " + " | ".join(["---"] * width) + " |", *full[1:]])


def _runs(node: ElementTree.Element) -> str:
    """The text of a paragraph: runs, tabs and line breaks in order."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in node.iter())


def docx_blocks(raw: bytes) -> list[dict]:
    """Paragraphs, pictures and tables of a DOCX file in body order, with style names."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                label = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = label.get(f"{_W}val") if label is not None else ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[dict] = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            text = _runs(node).strip()
            link = node.find(f"{_W}pPr/{_W}pStyle")
            if text:
                out.append(_row(content=text, style=styles.get(link.get(f"{_W}val"), "") if link is not None else styles.get("Normal", "")))
            if node.find(f".//{_W}drawing") is not None or node.find(f".//{_W}pict") is not None:
                out.append(_row(type="figure", context=text))
        elif node.tag == f"{_W}tbl":
            rows = [["\n".join(_runs(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            if table := _cells(rows):
                out.append(_row(type="table", content=table))
    return out


def pdf_blocks(raw: bytes) -> list[dict]:
    """Tables, text outside them and pictures of each page, by PyMuPDF."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional library PyMuPDF") from e
    out = []
    with fitz.open(stream=raw, filetype="pdf") as doc:
        for number, page in enumerate(doc, start=1):
            tables = page.find_tables().tables
            for t in tables:
                if text := _cells([[c or "" for c in r] for r in t.extract()]):
                    out.append(_row(type="table", content=text, page=number, bbox=[round(float(v), 2) for v in t.bbox]))
            for b in page.get_text("dict")["blocks"]:
                box = fitz.Rect(b["bbox"])
                if b["type"] == 1:
                    out.append(_row(type="figure", page=number, bbox=[round(float(v), 2) for v in box]))
                elif not any(box.intersects(fitz.Rect(t.bbox)) for t in tables):
                    spans = [s for line in b["lines"] for s in line["spans"]]
                    text = "\n".join("".join(s["text"] for s in line["spans"]) for line in b["lines"]).strip()
                    if text:
                        bold = any("bold" in s["font"].lower() or "black" in s["font"].lower() or s["flags"] & 16 for s in spans)
                        out.append(_row(content=text, page=number, bbox=[round(float(v), 2) for v in box], size=max(float(s["size"]) for s in spans), bold=bold))
    return out


def markdown_pages(raw: bytes) -> list[tuple[int, str]]:
    """(page, Markdown) of a PDF, by pymupdf4llm."""
    try:
        import fitz
        import pymupdf4llm
    except ImportError as e:
        raise RuntimeError("reading PDF as Markdown needs the optional library pymupdf4llm") from e
    with fitz.open(stream=raw, filetype="pdf") as doc:
        return [(int((x.get("metadata") or {}).get("page_number") or i), x.get("text") or "") for i, x in enumerate(pymupdf4llm.to_markdown(doc, page_chunks=True), start=1)]


def pages(spark: SparkSession, folder: str, reader: Callable[[bytes], list[tuple[int, str]]] = markdown_pages) -> DataFrame:
    """(path, page, text, error) of the PDF files below a folder, for docloom.operators.blocks.paged_blocks; an unreadable file gives one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").endswith(".pdf"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, n, t, None) for n, t in reader(raw)]
                except Exception as e:  # noqa: BLE001 - one unreadable file must not end the job
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """All blocks of the PDF and DOCX files below a folder (BLOCKS); other suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$"))
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    found = docx_blocks(raw) if path.lower().endswith(".docx") else pdf_blocks(raw)
                except Exception as e:  # noqa: BLE001 - one unreadable file must not end the job
                    found = [_row(error=f"{type(e).__name__}: {e}")]
                rows += [{"path": path, "block_index": i} | b for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=names).astype({"page": "Int32", "heading_level": "Int32", "block_index": "Int32", "size": "Float64"})

    return files.select("path", "content").mapInPandas(run, BLOCKS)
