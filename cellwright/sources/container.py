"""Sectioned text files: controls in TOML beside a tab-separated table.

``<SCHEMA>``, ``<JOB>``, ``<META>`` and ``<DATA>`` occur at most once each, do not nest, and nothing stands outside them.  Controls are small
and read on the driver; the table is read by ranges of the same file on many tasks (see ``records``).  Text in memory passes the
driver, standard input a piece at a time; so do the formats that are one file when they are written.
"""

from __future__ import annotations

import csv
import io
import json
import re
import tempfile
import tomllib
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from itertools import islice
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import tags as T
from ..dataset import ROW, Dataset, ci
from ..functions import values as V
from . import records

SECTIONS = ("SCHEMA", "JOB", "META", "DATA")
_MARK = re.compile(r"<\s*(/?)\s*(SCHEMA|JOB|META|DATA)\s*>", re.I)
#: Rows of a container text; :func:`to_text` refuses more.
INLINE_ROWS = 20_000
#: Lines with section marks, and lines of controls, that a container may have.
MAX_MARKS, MAX_CONTROL_LINES = 64, 1_000_000
#: Rows of an Arrow batch on the way to a feather file.
BATCH_ROWS = 10_000


def split_sections(text: str, default: str | None = None) -> dict[str, str]:
    """Section -> body.  ``default`` names the section that a text without any marker is."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    marks = list(_MARK.finditer(text))
    if not marks:
        if default is None:
            raise ValueError("no sections")
        return {default: text}
    out: dict[str, str] = {}
    at = 0
    for open_, close in zip(marks[::2], [*marks[1::2], None][: (len(marks) + 1) // 2], strict=True):
        name = open_[2].upper()
        if close is None or open_[1] or not close[1] or close[2].upper() != name or name in out:
            raise ValueError(f"section {name} is repeated, nested or not closed")
        if text[at : open_.start()].strip():
            raise ValueError("text outside sections")
        body = text[open_.end() : close.start()]
        out[name] = body.strip("\n") if name == "DATA" else body.strip()
        at = close.end()
    if text[at:].strip():
        raise ValueError("text outside sections")
    return out


def deep_merge(base: dict, over: dict) -> dict:
    """Leaves of ``over`` win."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def parse_rows(body: str, header_rows: int = 1) -> tuple[list[str], list[list[str | None]]]:
    """Header names joined by ``__`` over the header rows, and rows padded or cut to their number."""
    rows = [r for r in csv.reader(io.StringIO(body), delimiter="\t", quotechar='"') if r]
    head = rows[:header_rows]
    width = max(map(len, head), default=0)
    names = ["__".join(h[i] for h in head if i < len(h) and h[i]) or f"column_{i + 1}" for i in range(width)]
    return names, [[*r[:width], *[None] * (width - len(r))] for r in rows[header_rows:]]


def _tagged(df: DataFrame, headers: list[str], meta: dict, schema: dict, job: dict) -> Dataset:
    parsed = [T.parse_header(h) for h in headers]
    names = T.unique_names([n for n, _ in parsed])
    declared = {k.split(".", 1)[1].lower(): v for k, v in schema.items() if k.lower().startswith("column.")} | {k.lower(): v for k, v in (ci(schema, "column", default={}) or {}).items()}
    tags = {}
    for name, (_, own) in zip(names, parsed, strict=True):
        spec = ci(ci(meta, "COLUMN", default={}), name, default={}) or {}
        # Schema first, then controls, then the header.
        tags[name] = T.distinct([*((declared.get(name.lower()) or {}).get("tags", [])), *(ci(ci(meta, "TAGS", default={}), name, default=[]) or []), *(ci(spec, "TAGS", default=[]) or []), *own])
    df = df.toDF(*names, *([ROW] if ROW in df.columns else []))
    return Dataset(df, tags, meta, schema, job)


def read_container(spark: SparkSession, path: str, sidecar: str | None = None) -> Dataset:
    """Controls by the driver, the table by ranges: no task and no driver holds more than a range of it."""
    found = records.split_file(spark, path, _MARK.pattern, lambda m: (not _MARK.match(m)[1]) if _MARK.match(m)[2].upper() == "DATA" else None, MAX_MARKS, MAX_CONTROL_LINES)
    if found.rest is None and path.lower().endswith((".meta", ".meta.txt")):
        raise ValueError("no DATA section")
    parts = split_sections(found.rest) if found.rest is not None else {"DATA": ""}
    if "DATA" not in parts:
        raise ValueError("no DATA section")
    controls = _controls(parts, read_text(spark, sidecar) if sidecar else None)
    headers, df = records.read_records(spark, path, "\t", _header_rows(controls), ROW, found.bounds, drop_cr=True)
    return _decoded(df, headers, controls)


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file, wherever Spark can read it."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    if raw is None:
        raise FileNotFoundError(path)
    return bytes(raw.content).decode("utf-8")


def _controls(parts: dict[str, str], sidecar: str | None) -> dict[str, dict]:
    side = split_sections(sidecar, "META") if sidecar else {}
    return {s: deep_merge(tomllib.loads(side.get(s, "")), tomllib.loads(parts.get(s, ""))) for s in ("META", "SCHEMA", "JOB")}


def _header_rows(controls: dict[str, dict]) -> int:
    return int(ci(ci(controls["META"], "DATA", default={}), "HEADERS", default=1))


def _decoded(df: DataFrame, headers: list[str], controls: dict[str, dict]) -> Dataset:
    cells = [V.decode_cell(F.col(f"c{i}")).alias(f"c{i}") for i in range(len(headers))]
    log = tuple(json.loads(e) for e in controls["JOB"].pop("LOG", []))
    return replace(_tagged(df.select(*cells, F.col(ROW).cast("bigint").alias(ROW)), headers, controls["META"], controls["SCHEMA"], controls["JOB"]), log=log)


def spool(spark: SparkSession, stream: BinaryIO) -> str:
    """Standard input as a file that all tasks can read, copied a piece at a time: in ``spark.checkpoint.dir``, or beside local tasks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cellwright-")
    jvm = spark.sparkContext._jvm
    path = f"{folder.rstrip('/')}/stdin-{uuid.uuid4().hex}.dat"
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        while piece := stream.read(1 << 20):
            out.write(bytearray(piece))
    finally:
        out.close()
    return path


def from_text(spark: SparkSession, text: str, sidecar: str | None = None, default: str | None = None) -> Dataset:
    """A container's text in memory."""
    parts = split_sections(text, default)
    if "DATA" not in parts:
        raise ValueError("no DATA section")
    controls = _controls(parts, sidecar)
    headers, rows = parse_rows(parts["DATA"], _header_rows(controls))
    fields = StructType([StructField(f"c{i}", StringType()) for i in range(len(headers))] + [StructField(ROW, StringType())])
    return _decoded(spark.createDataFrame([[*r, str(i)] for i, r in enumerate(rows)], fields), headers, controls)


def scan_table(spark: SparkSession, path: str, sep: str = "\t", decode: bool = True, meta: dict | None = None) -> Dataset:
    """Delimited files of any size, line breaks inside quotes included: strings, with the record's number in ``__row_id``."""
    headers, df = records.read_records(spark, path, sep, 1, ROW)
    cells = [(V.decode_cell(F.col(f"c{i}")) if decode else F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(f"c{i}") for i in range(len(headers))]
    return _tagged(df.select(*cells, ROW), headers, meta or {}, {}, {})


# Writing -------------------------------------------------------------------------


def toml_text(value: dict, prefix: str = "") -> str:
    """Enough TOML for controls: scalars, lists, nested tables."""

    def cell(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int | float):
            return repr(v)
        if isinstance(v, list | tuple):
            return "[" + ", ".join(cell(x) for x in v) + "]"
        if isinstance(v, dict):
            return "{" + ", ".join(f"{key(k)} = {cell(x)}" for k, x in v.items()) + "}"
        return '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'

    def key(k) -> str:
        return k if re.fullmatch(r"[A-Za-z0-9_-]+", str(k)) else '"' + str(k).replace("\\", "\\\\").replace('"', '\\"') + '"'

    lines = [f"{key(k)} = {cell(v)}" for k, v in value.items() if not isinstance(v, dict)]
    for k, v in value.items():
        if isinstance(v, dict):
            name = f"{prefix}{key(k)}"
            lines += ["", f"[{name}]", toml_text(v, name + ".")]
    return "\n".join(lines).strip("\n")


def export_frame(ds: Dataset, sexes: bool = True) -> DataFrame:
    """Every cell as its stored spelling, sexes in canonical words, row order kept out of the columns."""
    cols = []
    for c in ds.columns:
        cell = F.col(f"`{c}`").cast("string")
        if sexes and "SEX" in ds.effective(c):
            cell = F.coalesce(V.sex(cell), cell)
        cols.append(V.encode_cell(cell).alias(c))
    df = ds.df.orderBy(ROW) if ROW in ds.df.columns else ds.df
    return df.select(*cols)


def _sections(ds: Dataset) -> dict[str, str]:
    """The log travels with the job, an entry a line."""
    job = {**ds.job, "LOG": [json.dumps(e, sort_keys=True, ensure_ascii=False) for e in ds.log]} if ds.log else ds.job
    return {"SCHEMA": toml_text(ds.schema), "JOB": toml_text(job), "META": toml_text(ds.meta)}


def _guard(text: str, where: str) -> str:
    """Nothing that would read back as a section mark may be written inside one."""
    if _MARK.search(text):
        raise ValueError(f"{where} holds section markers and would not read back")
    return text


def _pieces(ds: Dataset, controls: bool = True, data: bool = True) -> Iterator[str]:
    """The file's text, a row at a time."""
    for name, body in _sections(ds).items() if controls else ():
        if body:
            yield f"<{name}>\n{_guard(body, name)}\n</{name}>\n"
    if data:
        line = io.StringIO()
        w = csv.writer(line, delimiter="\t", quotechar='"', lineterminator="\n")

        def spelled(cells: list) -> str:
            line.seek(0), line.truncate()
            w.writerow(cells)
            return _guard(line.getvalue(), "the content")

        yield "<DATA>\n" + spelled([T.build_header(c, ds.tags.get(c, ())) for c in ds.columns])
        for r in export_frame(ds).toLocalIterator():
            yield spelled(list(r))
        yield "</DATA>\n"


def to_text(ds: Dataset, max_rows: int = INLINE_ROWS) -> str:
    """Container text in memory, of at most ``max_rows`` rows; :func:`write_container` streams any number to a file."""
    out = []
    for piece in _pieces(ds):
        out.append(piece)
        if len(out) > max_rows + 5:
            raise ValueError(f"more than {max_rows} rows: use write_container or write_table")
    return "".join(out)


def write_container(ds: Dataset, path: str) -> None:
    """One file; rows pass the driver one partition at a time.  A file that can't be read back is not left behind."""
    _write(path, _pieces(ds))


def write_controls(ds: Dataset, path: str) -> None:
    """The controls alone, with the tags that are in force."""
    spec = {c: dict(v) for c, v in (ci(ds.meta, "COLUMN", default={}) or {}).items()}
    for c in ds.columns:
        if ds.tags.get(c):
            spec.setdefault(c, {})["TAGS"] = list(ds.tags[c])
    meta = {**{k: v for k, v in ds.meta.items() if k.upper() != "COLUMN"}, **({"COLUMN": spec} if spec else {})}
    _write(path, _pieces(Dataset(ds.df, {}, meta, ds.schema, ds.job), data=False))


def write_data(ds: Dataset, path: str) -> None:
    """The rows alone, under plain names: to be read with the controls as sidecar."""
    _write(path, _pieces(Dataset(ds.df), controls=False))


def _write(path: str, pieces: Iterator[str]) -> None:
    part = Path(path + ".part")
    try:
        with part.open("w", encoding="utf-8") as f:
            f.writelines(pieces)
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)


def import_rows(template: Dataset, table: Dataset) -> Dataset:
    """A table's rows under a template's names, tags and controls.

    Columns are matched by name, or by place if no name fits; every template column must be there and no other, and a column's own tags may not go beyond the template's.
    """
    want, have = template.columns, table.columns
    names = {c.lower(): c for c in have}
    if len(want) != len(have) or not (by_name := all(c.lower() in names for c in want)) and any(c.lower() in names for c in want):
        raise ValueError(f"columns {have} don't fit the template's {want}")
    source = {c: names[c.lower()] if by_name else have[i] for i, c in enumerate(want)}
    if wrong := [c for c, s in source.items() if not set(table.tags.get(s, ())) <= set(template.tags.get(c, ()))]:
        raise ValueError(f"tags of {wrong} go beyond the template's")
    hidden = [ROW] if ROW in table.df.columns else []
    return template.with_df(table.df.select(*[F.col(f"`{s}`").alias(c) for c, s in source.items()], *hidden))


#: Formats of one's own: name -> writer of (dataset, path); see :func:`register_exporter`.
EXPORTERS: dict[str, Callable[[Dataset, str], None]] = {}


def register_exporter(name: str, writer: Callable[[Dataset, str], None], suffixes: Iterable[str] = ()) -> None:
    """``writer`` serves the format's name and its file suffixes."""
    for key in (name, *suffixes):
        EXPORTERS[key.lower().lstrip(".")] = writer


def write_table(ds: Dataset, path: str, fmt: str | None = None) -> None:
    """csv, tsv, jsonl, parquet, orc: distributed writers over the export frame; feather, sql and xlsx are one file, streamed by the driver."""
    fmt = (fmt or Path(path).suffix.lstrip(".")).lower()
    if fmt in EXPORTERS:
        EXPORTERS[fmt](ds, path)
        return
    df = export_frame(ds)
    if fmt in ("csv", "tsv"):
        df.write.mode("overwrite").option("header", True).option("sep", "," if fmt == "csv" else "\t").option("quote", '"').option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif fmt in ("jsonl", "json"):
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt in ("parquet", "orc"):
        getattr(df.write.mode("overwrite"), fmt)(path)
    elif fmt == "feather":
        import pyarrow as pa

        schema = pa.schema([(c, pa.string()) for c in df.columns])
        rows = df.toLocalIterator()
        with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            while some := list(islice(rows, BATCH_ROWS)):
                w.write_batch(pa.record_batch([pa.array([r[i] for r in some], pa.string()) for i in range(len(df.columns))], schema=schema))
    elif fmt == "sql":
        with Path(path).open("w", encoding="utf-8") as f:
            f.writelines(line + "\n" for line in sql_lines(ds))
    elif fmt == "xlsx":
        from .workbook import write_workbook

        write_workbook(ds, path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def sql_lines(ds: Dataset, table: str = "data") -> Iterator[str]:
    """CREATE TABLE and INSERT statements, a row at a time."""
    q = lambda n: '"' + n.replace('"', '""') + '"'
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    yield f"CREATE TABLE {q(table)} ({', '.join(q(c) + ' TEXT' for c in ds.columns)});"
    for r in export_frame(ds).toLocalIterator():
        yield f"INSERT INTO {q(table)} VALUES ({', '.join(map(lit, r))});"
    yield f"CREATE TABLE {q(table + '_columns')} (name TEXT, tags TEXT);"
    for c in ds.columns:
        yield f"INSERT INTO {q(table + '_columns')} VALUES ({lit(c)}, {lit('::'.join(ds.tags.get(c, ())))});"


def sql_script(ds: Dataset, table: str = "data") -> str:
    return "\n".join(sql_lines(ds, table)) + "\n"


def write_bundle(ds: Dataset, folder: str) -> None:
    """A folder for R: data, column tags, controls, a loader and a manifest."""
    import hashlib

    root = Path(folder)
    root.mkdir(parents=True, exist_ok=False)
    n = 0
    with (root / "data.tsv").open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter="\t", lineterminator="\n")
        w.writerow(ds.columns)
        for n, r in enumerate(export_frame(ds).toLocalIterator(), 1):  # noqa: B007
            w.writerow(list(r))
    (root / "columns.csv").write_text("name,tags\n" + "".join(f'"{c}","{"::".join(ds.tags.get(c, ()))}"\n' for c in ds.columns), encoding="utf-8")
    for name in ("meta", "schema", "job"):
        (root / f"{name}.toml").write_text(toml_text(getattr(ds, name)) + "\n", encoding="utf-8")
    (root / "loader.R").write_text('load_bundle <- function(dir) read.delim(file.path(dir, "data.tsv"), colClasses = "character", na.strings = "")\n', encoding="utf-8")
    files = {}
    for p in sorted(root.iterdir()):
        with p.open("rb") as f:
            files[p.name] = hashlib.file_digest(f, "sha256").hexdigest()
    (root / "manifest.json").write_text(json.dumps({"rows": n, "files": files}, indent=1), encoding="utf-8")
