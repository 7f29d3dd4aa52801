"""Reports of result tables: CSV and HTML, a word-processor document, and a zip of all."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Rows of a table shown on the page and in the document; CSV files hold all.
ROWS = 500


def write_csv(t: DataFrame, path: Path, head: int = ROWS) -> tuple[list[str], list[list[str]]]:
    """The whole table as CSV; its first ``head`` rows are returned for the page and the document."""
    first = []
    with path.open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(t.columns)
        for r in t.toLocalIterator():
            cells = ["" if v is None else str(v) for v in r]
            w.writerow(cells)
            if len(first) < head:
                first.append(cells)
    return t.columns, first


def to_html(title: str, found: dict) -> str:
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, (cols, rows) in found.items():
        cells = lambda xs, tag: "".join(f"<{tag}>{html.escape(x)}</{tag}>" for x in xs)
        parts.append(f"<h2>{html.escape(name)}</h2><table border='1'><tr>{cells(cols, 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows) + "</table>")
    return "\n".join(parts)


def to_document(title: str, found: dict) -> bytes:
    """The least a word processor opens: headings and tables."""
    para = lambda t: f"<w:p><w:r><w:t xml:space='preserve'>{escape(t)}</w:t></w:r></w:p>"
    row = lambda xs: "<w:tr>" + "".join(f"<w:tc>{para(x)}</w:tc>" for x in xs) + "</w:tr>"
    body = para(title) + "".join(para(n) + "<w:tbl>" + row(c) + "".join(map(row, rs)) + "</w:tbl>" for n, (c, rs) in found.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<?xml version='1.0'?><Types xmlns='http://schemas.openxmlformats.org/package/2006/content-types'><Default Extension='rels' ContentType='application/vnd.openxmlformats-package.relationships+xml'/><Override PartName='/word/document.xml' ContentType='application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml'/></Types>")
        z.writestr("_rels/.rels", "<?xml version='1.0'?><Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='r1' Type='http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument' Target='word/document.xml'/></Relationships>")
        z.writestr("word/document.xml", f"<?xml version='1.0'?><w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def write_report(tables: dict[str, DataFrame], folder: str, title: str = "Report", warnings: list[str] = (), archive: bool = False) -> Path:
    """A new folder with a CSV per table, report.html, report.docx, warnings.txt and manifest.json; optionally zipped."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=False)
    found = {name: write_csv(t, root / ("".join(ch if ch.isalnum() or ch in "-_" else "_" for ch in name) + ".csv")) for name, t in tables.items()}
    (root / "report.html").write_text(to_html(title, found), encoding="utf-8")
    (root / "report.docx").write_bytes(to_document(title, found))
    (root / "warnings.txt").write_text("\n".join(warnings), encoding="utf-8")
    sums = {}
    for p in sorted(root.iterdir()):
        with p.open("rb") as f:
            sums[p.name] = hashlib.file_digest(f, "sha256").hexdigest()
    (root / "manifest.json").write_text(json.dumps(sums, indent=1), encoding="utf-8")
    if archive:
        with zipfile.ZipFile(root.with_suffix(".zip"), "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.iterdir()):
                z.write(p, p.name)
    return root
