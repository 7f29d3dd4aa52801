"""Delimited files and containers read by byte ranges, against a plain reader, at ranges down to a few bytes."""

import csv
import io
import random

import pytest

from cellwright.dataset import Dataset
from cellwright.sources import container as C
from cellwright.sources import records, tables


@pytest.fixture
def ranges(spark):
    """Sets the size of a byte range."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df, row="__row_id"):
    got = sorted(map(tuple, df.select(row, *[c for c in df.columns if c != row]).collect()))
    assert [r[0] for r in got] == list(range(len(got)))
    return [r[1:] for r in got]


HOSTILE = ["a", 'b"', "\n", '"', "\r\n", "é", "", ",", " x y ", "\t", '""', "\n\n", "<b>", "\r", "\x00"]


@pytest.mark.parametrize("seed", range(4))
def test_records_are_a_plain_readers(spark, tmp_path, ranges, seed):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(HOSTILE) for _ in range(rng.randint(0, 6)))
    sep, path = rng.choice(",\t;"), str(tmp_path / "t.csv")
    rows = [['h"1', "h\n2", "h3"]] + [[cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))] for _ in range(60)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("﻿" * (seed % 2))
        for r in rows:
            csv.writer(f, delimiter=sep, lineterminator=("\n", "\r\n")[seed % 2]).writerow(r)
            f.write("\n" * (rng.random() < 0.1))
    with open(path, newline="", encoding="utf-8-sig") as f:
        plain = [r for r in csv.reader(f, delimiter=sep) if r]
    for size in (200, 1 << 20):
        ranges(size)
        names, df = records.read_records(spark, path, sep)
        assert names == plain[0] and rows_of(df) == [tuple([*r[:3], *[None] * (3 - len(r))]) for r in plain[1:]]
    assert df.rdd.getNumPartitions() >= 1


def test_one_cell_over_many_ranges_and_stray_quotes(spark, tmp_path, ranges):
    path = tmp_path / "t.csv"
    long = "\n".join(f'line {k} "quoted", more' for k in range(400))
    stray = [['5" pipe', "x"], ["a", 'say "hi" now'], ["it's 6'2\"", '""']]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["k", "v"], ["1", long], ["2", "end"]])
    path.write_text(out.getvalue() + "".join(",".join(r) + "\n" for r in stray) + 'last,"no line end"', encoding="utf-8")
    with path.open(newline="") as f:
        want = [tuple(r) for r in csv.reader(f)][1:]
    for size in (700, 1 << 20):
        ranges(size)
        assert rows_of(tables.read_any(spark, str(path)).df) == want


def test_a_cell_that_never_closes_is_refused(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(ValueError, match="never closed"):
        tables.read_any(spark, str(tmp_path / "t.csv"))


def test_several_files_number_on_and_empty_files_are_none(spark, tmp_path, ranges):
    for k in range(3):
        (tmp_path / f"p{k}.csv").write_text("a,b\n" + "".join(f'{k},"x\n{i}"\n' for i in range(20)))
    (tmp_path / "p3.csv").write_text("a,b\n")
    ranges(100)
    assert rows_of(C.scan_table(spark, str(tmp_path), ",").df) == [(str(k), f"x\n{i}") for k in range(3) for i in range(20)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert tables.read_any(spark, str(tmp_path / "none" / "e.csv")).columns == []
    (tmp_path / "h.csv").write_text("a,b")
    only = tables.read_any(spark, str(tmp_path / "h.csv"))
    assert only.columns == ["a", "b"] and only.df.count() == 0


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_own_exports_read_back(spark, tmp_path, ranges, fmt):
    rng = random.Random(9)
    rows = [(str(k), *["".join(rng.choice(HOSTILE[:-1]) for _ in range(rng.randint(0, 5))) for _ in range(2)]) for k in range(100)] + [("100", "  ", None), ("101", "<<NULL>>", "\\<<EMPTY>>")]
    ds = Dataset(spark.createDataFrame(rows, "id string, x string, y string"))
    C.write_table(ds, str(tmp_path / f"t.{fmt}"))
    ranges(2000)
    back = tables.read_any(spark, str(tmp_path / f"t.{fmt}"))
    got = sorted((tuple(r) for r in back.df.select("id", "x", "y").collect()), key=lambda r: int(r[0]))
    if fmt == "tsv":
        assert got == rows
    else:  # csv holds the stored spelling
        assert got == [tuple(r) for r in C.export_frame(ds).orderBy(C.F.expr("cast(id as int)")).collect()]


def test_containers_by_ranges(spark, tmp_path, ranges):
    rng = random.Random(4)
    rows = [(str(k), "".join(rng.choice(["a", "\n", '"', "\t", " ", "é", "<"]) for _ in range(rng.randint(0, 8)))) for k in range(150)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, note string, __row_id long")
    ds = Dataset(df, {"id": ("ID",), "note": ("STR",)}, {"A": {"B": "x\ny", "T": "three\n\nlines"}}, {}, {"N": 1})
    path = str(tmp_path / "c.dat")
    C.write_container(ds, path)
    text = open(path, encoding="utf-8", newline="").read()
    at = text.index("<DATA>")
    moved = tmp_path / "moved.dat"  # controls behind the table, marks within lines, carriage returns
    moved.write_text("﻿<data>" + text[at + len("<DATA>\n") :].rstrip("\n").replace("</DATA>", "< / DATA >") + text[:at].replace("\n", "\r\n") + "\n\n", encoding="utf-8", newline="")
    plain = C.from_text(spark, text)
    for size in (900, 1 << 20):
        ranges(size)
        for p in (path, str(moved)):
            back = C.read_container(spark, p)
            assert (back.meta, back.job, back.tags, back.columns) == (plain.meta, plain.job, plain.tags, plain.columns)
            assert rows_of(back.df) == rows_of(plain.df) == rows


def test_header_rows_of_a_container_by_ranges(spark, tmp_path, ranges):
    path = tmp_path / "h.dat"
    path.write_text('<META>\n[DATA]\nHEADERS = 2\n</META>\n<DATA>\na\t"b\nc"\nx\ty\n1\t2\n\n3\n</DATA>\n')
    for size in (8, 1 << 20):
        ranges(size)
        back = C.read_container(spark, str(path))
        assert len(back.columns) == 2 and rows_of(back.df) == [("1", "2"), ("3", None)]
    one = tmp_path / "one.dat"
    one.write_text("<META>A = 1</META><DATA>a\tb</DATA>")
    assert C.read_container(spark, str(one)).columns == ["a", "b"]
    bare = tmp_path / "bare.dat"
    bare.write_text("a\tb\n1\t2\n")
    assert rows_of(C.read_container(spark, str(bare)).df) == [("1", "2")]


@pytest.mark.parametrize("text", ["<DATA>\na\n<META>\n</META>\n</DATA>", "<DATA>\na\n", "<DATA>\na\n</DATA>\n<DATA>\nb\n</DATA>", "x\n<DATA>\na\n</DATA>", "<DATA>\na\n</DATA>\nx", "<META>\n</META>", "a\n</DATA>\n", "<META>\n<META>\n</META>\n<DATA>\na\n</DATA>"])
def test_broken_containers_are_refused_by_ranges(spark, tmp_path, ranges, text):
    path = tmp_path / "b.dat"
    path.write_text(text)
    for size in (7, 1 << 20):
        ranges(size)
        with pytest.raises(ValueError):
            C.read_container(spark, str(path))
