"""Workbooks without a spreadsheet library: the parts of the format that tables need, from zip and XML."""

from __future__ import annotations

import io
import json
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from typing import IO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import tags as T
from ..dataset import ROW, Dataset
from . import container as C

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CONTROL = ("META", "SCHEMA", "JOB")
#: Rows of a sheet that the format allows, with the header.
SHEET_ROWS = 1_048_576


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_sheets(raw: bytes) -> dict[str, list[list[str | None]]]:
    """Sheet -> rows of text.  A formula without a stored result is refused."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_NS}si")]
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = rels[sheet.get(_REL)].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        rows: list[list[str | None]] = []
        for row in root.iter(f"{_NS}row"):
            cells: list[str | None] = []
            for i, c in enumerate(row.findall(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.find(f"{_NS}v"), c.get("t")
                if c.find(f"{_NS}f") is not None and v is None:
                    raise ValueError(f"{sheet.get('name')}!{c.get('r')}: a formula without a stored result")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None:
                    text = v.text or ""
                    cells[at] = shared[int(text)] if kind == "s" else ("TRUE" if text == "1" else "FALSE") if kind == "b" else re.sub(r"^(-?\d+)\.0$", r"\1", text)
            number = int(row.get("r") or len(rows) + 1)
            rows += [[] for _ in range(number - 1 - len(rows))]
            rows.append(cells)
        out[sheet.get("name")] = rows
    return out


def read_workbook(spark: SparkSession, path: str, source: str = "sheet_name") -> Dataset:
    """Control sheets hold lines of TOML; data sheets are DATA, DATA_1 ... or all others, stacked by column name."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    sheets = read_sheets(raw)
    upper = {n.upper(): n for n in sheets}
    parts = {s: "\n".join((r[0] or "") if r else "" for r in sheets[upper[s]]) for s in CONTROL if s in upper}
    numbered = sorted((n for n in sheets if re.fullmatch(r"DATA(_\d+)?", n.upper())), key=lambda n: int((n.split("_") + ["0"])[1]))
    data = numbered or [n for n in sheets if n.upper() not in CONTROL]
    headers: list[str] = []
    for n in data:
        headers += [h for h in (sheets[n][0] if sheets[n] else []) if h and h not in headers]
    rows = []
    for n in data:
        head = sheets[n][0] if sheets[n] else []
        for r in sheets[n][1:]:
            if any(x not in (None, "") for x in r):
                got = dict(zip(head, r, strict=False))
                rows.append([*([n] if len(data) > 1 else []), *[got.get(h) or "" for h in headers]])
    all_headers = ([T.build_header(source, ["SHEET", "STR"])] if len(data) > 1 else []) + headers
    body = io.StringIO()
    import csv

    w = csv.writer(body, delimiter="\t", lineterminator="\n")
    w.writerow(all_headers)
    w.writerows(rows)
    text = "".join(f"<{s}>\n{b}\n</{s}>\n" for s, b in {**parts, "DATA": body.getvalue()}.items())
    return C.from_text(spark, text)


def write_workbook(ds: Dataset, path: str) -> None:
    """Control sheets and DATA, or one sheet per value of a SHEET column.  All cells are inline text, so '=' starts no formula.

    Rows go through a file per sheet, as its columns are known only at the end.  A table that a sheet cannot hold is refused.
    """
    sheet_col = next(iter(ds.find(any_of=["SHEET"])), None)
    sheets: dict[str, Iterable[list[str | None]]] = {}
    for s, body in (("SCHEMA", ds.schema), ("JOB", ds.job), ("META", ds.meta)):
        if body:
            sheets[s] = [[line] for line in C.toml_text(body).split("\n")]
    cols = [c for c in ds.columns if c != sheet_col]
    with tempfile.TemporaryDirectory() as held, ExitStack() as files:
        groups: dict[str, list] = {} if sheet_col else {"DATA": [files.enter_context(open(f"{held}/0", "w+", encoding="utf-8")), 0, set(range(len(cols)))]}
        for r in C.export_frame(ds).toLocalIterator():
            name = (r[sheet_col] or "DATA") if sheet_col else "DATA"
            if name not in groups:
                groups[name] = [files.enter_context(open(f"{held}/{len(groups)}", "w+", encoding="utf-8")), 0, set()]
            g, cells = groups[name], [r[c] for c in cols]
            g[1] += 1
            if g[1] >= SHEET_ROWS:
                raise ValueError(f"sheet {name} has more than {SHEET_ROWS - 1} rows: write the table in another format")
            if len(g[2]) < len(cols):
                g[2].update(i for i, x in enumerate(cells) if x != "")
            g[0].write(json.dumps(cells) + "\n")
        for name, (f, _, used) in groups.items():
            sheets[_sheet_name(name, sheets) if sheet_col else name] = _held_rows(f, [T.build_header(c, ds.tags.get(c, ())) for c in cols], sorted(used))
        with open(path, "wb") as out:
            write_parts(out, sheets)


def _held_rows(f: IO[str], head: list[str], used: list[int]) -> Iterator[list[str | None]]:
    f.seek(0)
    yield [head[i] for i in used]
    for line in f:
        cells = json.loads(line)
        yield [cells[i] for i in used]


def _sheet_name(name: str, taken) -> str:
    base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "DATA"
    pick, k = base, 1
    while pick in taken:
        k += 1
        pick = f"{base[: 30 - len(str(k))]}_{k}"
    return pick


def workbook_bytes(sheets: dict[str, list[list[str | None]]]) -> bytes:
    out = io.BytesIO()
    write_parts(out, sheets)
    return out.getvalue()


def write_parts(out: IO[bytes], sheets: dict[str, Iterable[list[str | None]]]) -> None:
    """The zip of a workbook, a row at a time."""

    def letters(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, m = divmod(i - 1, 26)
            s = chr(65 + m) + s
        return s

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                part.write(f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>'.encode())
                for k, r in enumerate(rows, 1):
                    part.write((f'<row r="{k}">' + "".join(f'<c r="{letters(j)}{k}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(r) if v not in (None, "")) + "</row>").encode())
                part.write(b"</sheetData></worksheet>")
