"""Word documents to HTML and Markdown, with the standard library alone."""

from __future__ import annotations

import html
import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.dom import markdown
from corpuskit.functions.scalars import markdown_name

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def to_html(content: bytes) -> str:
    """Headings, paragraphs, lists, tables, bold and italic runs, wrapped as a page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")

    def on(run, name: str) -> bool:
        found = run.find(f"{W}rPr/{W}{name}")
        return found is not None and found.get(f"{W}val") not in ("0", "false")

    def runs(p) -> str:
        out = ""
        for run in p.iter(f"{W}r"):
            text = "".join("<br />" if x.tag == f"{W}br" else html.escape(x.text or "", quote=False) for x in run if x.tag in (f"{W}t", f"{W}br"))
            if text and on(run, "b"):
                text = f"<strong>{text}</strong>"
            if text and on(run, "i"):
                text = f"<em>{text}</em>"
            out += text
        return out

    parts, items = [], []

    def end_list() -> None:
        if items:
            parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            items.clear()

    for e in body if body is not None else ():
        if e.tag == f"{W}tbl":
            end_list()
            rows = ["".join(f"<td>{''.join(f'<p>{runs(p)}</p>' for p in c.iter(f'{W}p'))}</td>" for c in r.iter(f"{W}tc")) for r in e.iter(f"{W}tr")]
            parts.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
        elif e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            name = (style.get(f"{W}val") or "") if style is not None else ""
            text = runs(e)
            if e.find(f"{W}pPr/{W}numPr") is not None:
                items.append(text)
                continue
            end_list()
            level = name[7:] if name.lower().startswith("heading") else ""
            if text:
                parts.append(f"<h{level}>{text}</h{level}>" if level in set("123456") else f"<p>{text}</p>")
    end_list()
    return f"<html><body>{''.join(parts)}</body></html>"


def docx_html(content: Column) -> Column:
    @F.arrow_udf("string")
    def run(files: pa.Array) -> pa.Array:
        return pa.array([None if f is None else to_html(f) for f in files.to_pylist()], pa.string())

    return run(content)


def read_documents(spark: SparkSession, path: str, strip: tuple[str, ...] = ("img",)) -> DataFrame:
    """path, html, markdown and file name of every .docx under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    pages = files.select("path", docx_html(F.col("content")).alias("html"))
    return pages.select("path", "html", markdown(F.col("html"), strip).alias("markdown"), markdown_name(F.col("path")).alias("file_name"))
