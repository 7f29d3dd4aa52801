"""Delimited records of any size, line breaks inside quotes included, read on many tasks.

Spark deals a file's lines out by byte ranges.  Whether a range begins inside a quoted cell depends on all ranges before it:

1. Each range is walked once for both cases: where it ends, how many records begin in it, whether a cell that was open closes.
   A range is a row of a few numbers; the driver chains them in file order, which also numbers all records.
2. With its beginning known, each range is cut into records by itself.  Records that lie in several ranges come as fragments, at most two a
   range, and are put together by the range that they begin in.

A container's section marks are found by a scan of the lines that hold any, and bound the lines that both walks see.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Most byte ranges of a read (a row of some hundred bytes each on the driver); lines fetched at first, and at most, for a header.
MAX_RANGES, HEAD_LINES, MAX_HEAD_LINES = 1 << 20, 64, 1 << 16
#: Records of a batch on the way back.
BATCH_ROWS = 4096


class Key(NamedTuple):
    file: str
    start: int


@dataclass(frozen=True)
class Bounds:
    """Lines of a range that count: first, end, and columns at which the first and last of them are cut."""

    first: int = 0
    end: int | None = None
    skip: int = 0
    stop: int | None = None


@dataclass(frozen=True)
class Start:
    """How a range begins: inside a cell or not, number of its first record within the file, file's first row number, range that owns an open record."""

    inside: bool
    index: int
    offset: int
    owner: int
    number: int


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, line``: lines as bytes, in order within each byte range; only scans may stand between this and a walk."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[Key, pa.Array]]:
    """Neighbouring lines of one range."""
    ends = sorted({*pc.run_end_encode(batch.column("file")).run_ends.to_pylist(), *pc.run_end_encode(batch.column("start")).run_ends.to_pylist()})
    at = 0
    for end in ends:
        yield Key(batch.column("file")[at].as_py(), batch.column("start")[at].as_py()), batch.column("line").slice(at, end - at)
        at = end


def _counted(lines: pa.Array, key: Key, at: int, bounds: dict[Key, Bounds] | None) -> list[bytes]:
    """Lines from number ``at`` of a range on: all without a byte order mark, or those within bounds."""
    part = lines.to_pylist()
    if bounds is not None:
        return _bounded(part, at, bounds.get(key, Bounds(0, 0)))
    if at == key.start == 0 and part:
        part[0] = part[0].removeprefix(b"\xef\xbb\xbf")
    return part


def _bounded(lines: list[bytes], at: int, bounds: Bounds) -> list[bytes]:
    """``lines`` from number ``at`` on, within bounds."""
    end = len(lines) if bounds.end is None else max(0, min(len(lines), bounds.end - at))
    begin = max(0, min(end, bounds.first - at))
    out = lines[begin:end]
    if out and bounds.stop is not None and at + end == bounds.end:
        out[-1] = out[-1][: bounds.stop]
    if out and at + begin == bounds.first:
        out[0] = out[0][bounds.skip :]
    return out


class Walker:
    """Follows quotes over lines.  A quote opens a cell only where the cell begins, and closes it unless doubled."""

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        self._open = re.compile(b'(?:^|' + s + b')"')
        self._close = re.compile(b'[^"]*(?:""[^"]*)*"(?!")')
        self._next = re.compile(s)

    def after(self, line: bytes, inside: bool) -> bool:
        """Whether the line ends inside a quoted cell."""
        if b'"' not in line:
            return inside
        at = 0
        while True:
            if inside:
                close = self._close.match(line, at)
                if close is None:
                    return True
                found = self._next.search(line, close.end())
                if found is None:
                    return False
                at, inside = found.start(), False
            # ``at`` is the line's begin or a separator: the next cell that begins with a quote.
            opened = self._open.search(line, at)
            if opened is None:
                return False
            at, inside = opened.end(), True


def blank(line: bytes) -> bool:
    return not line or line == b"\r"


_WALKED = "file string, start bigint, lines bigint, out_inside boolean, out_records bigint, in_inside boolean, in_records bigint, in_closes boolean"


def _walk(sep: str, bounds: dict[Key, Bounds] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each range does to either beginning."""
        walker, key, found = Walker(sep), None, []

        def close() -> None:
            found.append((key.file, key.start, seen, states[0], records[0], states[1], records[1], closes))

        for batch in batches:
            for own, lines in _runs(batch):
                if own != key:
                    if key is not None:
                        close()
                    key, seen, states, records, closes = own, 0, [False, True], [0, 0], False
                for line in _counted(lines, key, seen, bounds):
                    for k in (0, 1):
                        records[k] += not states[k] and not blank(line)
                        states[k] = walker.after(line, states[k])
                    closes |= not states[1]
                seen += len(lines)
        if key is not None:
            close()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [[]] * 8, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()), strict=True)], names=[f.split()[0] for f in _WALKED.split(", ")])

    return run


def _collected(df: DataFrame, most: int, what: str) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def starts_of(ranges: list, header_rows: int) -> dict[Key, Start]:
    """The beginning of every range, chained in the order of files and bytes.  A cell that never closes is refused."""
    out: dict[Key, Start] = {}
    offset, file = 0, None
    for number, r in enumerate(sorted(ranges, key=lambda r: (r["file"], r["start"]))):
        if r["file"] != file:
            if file is not None:
                offset += max(0, index - header_rows)
            if file is not None and inside:
                raise ValueError(f"a quoted cell of {file} is never closed")
            file, inside, index, owner = r["file"], False, 0, number
        if not inside:
            owner = number
        out[Key(r["file"], r["start"])] = Start(inside, index, offset, owner, number)
        side = "in" if inside else "out"
        if inside and r["in_closes"]:
            owner = number
        inside, index = r[f"{side}_inside"], index + r[f"{side}_records"]
    if file is not None and inside:
        raise ValueError(f"a quoted cell of {file} is never closed")
    return out


def _cells(records: list[bytes], sep: str, width: int | None) -> list[list[str | None]]:
    """Cells of whole records, padded or cut to ``width`` if one is given.  A carriage return outside quotes belongs to its cell."""
    csv.field_size_limit(2**31 - 1)
    texts = [r.decode("utf-8", "replace").removesuffix("\r") for r in records]
    mark = "\x00" if any("\r" in t for t in texts) else None
    while mark and any(mark in t for t in texts):
        mark = chr(ord(mark) + 1) if mark not in "\x08\x1f" else ""
    rows = csv.reader((t.replace("\r", mark) for t in texts) if mark else texts, delimiter=sep, quotechar='"')
    out = []
    for r in rows:
        if mark:
            r = [c.replace(mark, "\r") for c in r]
        out.append(r if width is None else [*r[:width], *[None] * (width - len(r))])
    return out


def _cut(sep: str, width: int, header_rows: int, starts: Callable[[], dict[Key, Start]], bounds: dict[Key, Bounds] | None, names: list[str], drop_cr: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, and fragments of those that lie in several ranges."""
        walker, known, key = Walker(sep), starts(), None
        rows: list[tuple[int, bytes]] = []
        parts: list[tuple[int, int, int | None, bytes]] = []

        def emit() -> pa.RecordBatch:
            cells = _cells([r for _, r in rows], sep, width)
            columns = list(zip(*cells, strict=True)) if cells else [()] * width
            none = [None] * len(parts)
            out = [pa.array([*[n for n, _ in rows], *[n for _, _, n, _ in parts]], pa.int64()), *[pa.array([*c, *none], pa.string()) for c in columns]]
            some = [None] * len(rows)
            out += [pa.array([*some, *[p[k] for p in parts]], t) for k, t in ((0, pa.int32()), (1, pa.int32()))] + [pa.array([*some, *[p[3] for p in parts]], pa.binary())]
            rows.clear(), parts.clear()
            return pa.record_batch(out, names=names)

        def end_range() -> None:
            if pending:
                parts.append((owner, start.number, number, b"\n".join(pending)))

        for batch in batches:
            for own, lines in _runs(batch):
                if own != key:
                    if key is not None:
                        end_range()
                    key, start, seen, pending, number = own, known[own], 0, [], None
                    inside, index, owner = start.inside, start.index, start.owner
                part = _counted(lines, key, seen, bounds)
                seen += len(lines)
                for line in part:
                    if drop_cr:
                        line = line.removesuffix(b"\r")
                    if not inside:
                        if blank(line):
                            continue
                        number = start.offset + index - header_rows if index >= header_rows else -1
                        index += 1
                    inside = walker.after(line, inside)
                    if inside or pending or (number is None):
                        pending.append(line)
                        if inside:
                            continue
                        if number is None:  # the record began in a range before
                            parts.append((owner, start.number, None, b"\n".join(pending)))
                        elif number >= 0:
                            rows.append((number, b"\n".join(pending)))
                        pending, owner = [], start.number
                    elif number >= 0:
                        rows.append((number, line))
                if len(rows) >= BATCH_ROWS:
                    yield emit()
        if key is not None:
            end_range()
        yield emit()

    return run


def _whole(sep: str, width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _cells(batch.column("text").to_pylist(), sep, width)
            yield pa.record_batch([batch.column("row"), *[pa.array(c, pa.string()) for c in (zip(*cells, strict=True) if cells else [()] * width)]], names=names)

    return run


def first_records(spark: SparkSession, keys: list[Key], sep: str, n: int, bounds: dict[Key, Bounds] | None = None) -> list[list[str]]:
    """The first ``n`` records of a file whose ranges are ``keys``, from as few of its first lines as hold them."""
    walker, inside, held, records, seen = Walker(sep), False, [], [], 0
    for key in keys if n else ():
        lines, most, at = text_lines(spark, key.file).where(F.col("start") == key.start).select("line"), HEAD_LINES, 0
        begin = bounds[key].first if bounds is not None and key in bounds else 0
        while True:
            fetched = [bytes(r[0]) for r in lines.take(begin + most)]
            for line in _counted(pa.array(fetched, pa.binary()), key, 0, bounds)[at:]:
                at += 1
                if not inside and blank(line):
                    continue
                held.append(line)
                inside = walker.after(line, inside)
                if not inside:
                    records.append(b"\n".join(held))
                    held = []
                    if len(records) == n:
                        return [[c for c in r if c is not None] for r in _cells(records, sep, None)]
            seen += most
            if len(fetched) < begin + most:
                break
            if seen > MAX_HEAD_LINES:
                raise ValueError(f"the header of {key.file} is longer than {MAX_HEAD_LINES} lines")
            most *= 2
    return [[c for c in r if c is not None] for r in _cells(records, sep, None)]


def header_names(head: list[list[str]]) -> list[str]:
    """Names joined by ``__`` over the header rows."""
    width = max(map(len, head), default=0)
    return ["__".join(h[i] for h in head if i < len(h) and h[i]) or f"column_{i + 1}" for i in range(width)]


def read_records(spark: SparkSession, path: str, sep: str = ",", header_rows: int = 1, row: str = "__row_id", bounds: dict[Key, Bounds] | None = None, drop_cr: bool = False) -> tuple[list[str], DataFrame]:
    """Header names, and string columns ``c0, c1, ...`` with the record's number in ``row``.

    Each file begins with the header; numbers run over files by path.  Rows are padded with nulls or cut to the header's width, blank lines
    between records are left out, a line break inside quotes stays in its cell, and a cell that a file never closes is an error.
    """
    lines = text_lines(spark, path)
    ranges = _collected(lines.mapInArrow(_walk(sep, bounds), _WALKED), MAX_RANGES, f"byte ranges in {path}: raise spark.sql.files.maxPartitionBytes")
    starts = starts_of(ranges, header_rows)
    file = min((r["file"] for r in ranges if r["out_records"]), default=None)
    names = header_names(first_records(spark, [k for k in sorted(starts) if k.file == file and (bounds is None or k in bounds)], sep, header_rows, bounds))
    width = len(names)
    cells = [StructField(f"c{i}", StringType()) for i in range(width)]
    schema = StructType([StructField(row, LongType()), *cells, StructField("_owner", IntegerType()), StructField("_part", IntegerType()), StructField("_text", StructType.fromDDL("x binary")["x"].dataType)])
    shared = spark.sparkContext.broadcast(starts)
    every = lines.mapInArrow(_cut(sep, width, header_rows, lambda: shared.value, bounds, schema.names, drop_cr), schema)
    plain = every.where(F.col("_owner").isNull()).select(row, *[c.name for c in cells])
    if not any(s.inside for s in starts.values()):
        return names, plain
    listed = F.array_sort(F.collect_list(F.struct("_part", F.col(row).isNull().alias("later"), row, F.col("_text").alias("text"))))
    glued = every.where(F.col("_owner").isNotNull()).groupBy("_owner").agg(listed.alias("all"))
    # Array functions join strings only: bytes travel as hexadecimal digits, a line break is 0a.
    text = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["text"])), "0A"))
    number = F.array_max(F.transform("all", lambda x: x[row]))
    joined = glued.select(number.alias(row), text.alias("text")).where(F.col(row) >= 0)
    parsed = joined.withColumnRenamed(row, "row").mapInArrow(_whole(sep, width, [row, *[c.name for c in cells]]), StructType([schema[row], *cells]))
    return names, plain.unionByName(parsed)


# Sections ------------------------------------------------------------------------

_MARKED = "file string, start bigint, lines bigint, at bigint, text binary"


def _marks(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per range with its lines, and a row per line that holds a mark."""
        mark, key, found = re.compile(pattern.encode(), re.I), None, []
        for batch in batches:
            for own, lines in _runs(batch):
                if own != key:
                    if key is not None:
                        found.append((*key, seen, None, None))
                    key, seen = own, 0
                for k, line in enumerate(lines.to_pylist()):
                    if b"<" in line and mark.search(line):
                        found.append((*key, None, seen + k, line))
                seen += len(lines)
        if key is not None:
            found.append((*key, seen, None, None))
        cols = list(zip(*found, strict=True)) if found else [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[f.split()[0] for f in _MARKED.split(", ")])

    return run


def _kept(bounds: dict[Key, list[Bounds]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines outside the table, with their numbers."""
        key, seen = None, 0
        for batch in batches:
            for own, lines in _runs(batch):
                if own != key:
                    key, seen = own, 0
                part = lines.to_pylist()
                for b in bounds.get(key, ()):
                    found = [(*key, seen + k, line) for k, line in enumerate(part) if b.first <= seen + k and (b.end is None or seen + k < b.end)]
                    if found:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "start", "at", "text"])
                seen += len(part)

    return run


class Sections(NamedTuple):
    """A file's text without its table (None: it has no marks), and the lines of the table by range (empty: it has none)."""

    rest: str | None
    bounds: dict[Key, Bounds] | None


def split_file(spark: SparkSession, path: str, pattern: str, opens: Callable[[str], bool | None], most_marks: int, most_lines: int) -> Sections:
    """Cut one file at the marks of its table without reading the table.

    ``opens`` says of a mark whether it begins the table (True), ends it (False) or is another's (None).  The text that is left has the two marks, and
    nothing between them.  At most ``most_marks`` lines with marks and ``most_lines`` lines outside the table are taken; more is an error.
    """
    lines = text_lines(spark, path)
    found = lines.mapInArrow(_marks(pattern), _MARKED)
    ranges = sorted(_collected(found.where("at is null").select("file", "start", "lines"), MAX_RANGES, f"byte ranges in {path}"), key=lambda r: (r["file"], r["start"]))
    marked = sorted(_collected(found.where("at is not null").select("file", "start", "at", "text"), most_marks, f"lines with section marks in {path}"), key=lambda r: (r["file"], r["start"], r["at"]))
    if len(files := {r["file"] for r in ranges}) > 1:
        raise ValueError(f"{path} has {len(files)} files, a container is one")
    if not marked:
        return Sections(None, None)
    begin = end = None
    for r in marked:
        for m in re.finditer(pattern.encode(), bytes(r["text"]), re.I):
            kind = opens(m[0].decode())
            if kind is True and begin is None:
                begin = (r["start"], r["at"], m.end())
            elif kind is False and begin is not None and end is None:
                end = (r["start"], r["at"], m.start())
            elif begin is not None and (end is None or kind is not None):
                raise ValueError(f"the table of {path} is repeated, nested or not closed")
    if begin is not None and end is None:
        raise ValueError(f"the table of {path} is repeated, nested or not closed")
    bounds: dict[Key, Bounds] = {}
    outside: dict[Key, list[Bounds]] = {}
    for r in ranges:
        key, n = Key(r["file"], r["start"]), r["lines"]
        if begin is None or end is None or begin[0] > key.start or end[0] < key.start:
            outside[key] = [Bounds()]
            continue
        own = Bounds(0, n)
        before, behind = [], []
        if begin[0] == key.start:
            own, before = replace(own, first=begin[1], skip=begin[2]), [Bounds(0, begin[1] + 1)]
        if end[0] == key.start:
            own = replace(own, end=end[1] + 1, stop=end[2])
            behind = [Bounds(max(end[1], begin[1] + 1) if begin[0] == key.start else end[1], None)]
        bounds[key], outside[key] = own, [*before, *behind]
    taken = _collected(lines.mapInArrow(_kept(outside), "file string, start bigint, at bigint, text binary"), most_lines, f"lines outside the table in {path}")
    pieces = []
    for r in sorted(taken, key=lambda r: (r["start"], r["at"])):
        line, place = bytes(r["text"]), (r["start"], r["at"])
        if begin is not None and end is not None:
            if place == begin[:2] == end[:2]:
                line = line[: begin[2]] + line[end[2] :]
            elif place == begin[:2]:
                line = line[: begin[2]]
            elif place == end[:2]:
                line = line[end[2] :]
        pieces.append(line)
    return Sections(b"\n".join(pieces).decode("utf-8"), bounds if begin is not None and end is not None else {})
