"""Containers, workbooks, exporters, chains, streams."""

import pytest
from pyspark.sql import functions as F

from cellwright.dataset import ROW, Dataset
from cellwright.operators import checks, comparators, multi
from cellwright.plans import runner
from cellwright.sources import container as C
from cellwright.sources import tables
from cellwright.sources.workbook import read_sheets, workbook_bytes, write_workbook
from cellwright.streaming import streams

TEXT = """<META>
[TAGS]
item = ["ITEM"]
[ACTIONS.only]
TYPE = "ROW.INCLUDE"
COLUMN = "value"
OP = "gt"
VALUE = 1
[ACTION_PIPELINES]
main = ["only"]
[WORKS]
DEFAULT = ["VALIDATE", "only", "DESCRIBE", "EDA"]
[PIPELINES]
p = ["action only", "sample --n 1"]
</META>
<DATA>
[[ID]]id\titem\t[[RESULT::NUM::NULLABLE]]value\t[[SEX]]sex
a\tGLU\t1\tM
b\tGLU\t2.5\t여
c\tALT\t<<NULL>>\tX
d\tALT\t"5"\t<<WS:2>>
</DATA>
"""


def test_container_round_trip(spark):
    ds = C.from_text(spark, TEXT)
    assert ds.columns == ["id", "item", "value", "sex"] and ds.tags["value"] == ("RESULT", "NUM", "NULLABLE") and ds.tags["item"] == ("ITEM",)
    again = C.from_text(spark, C.to_text(ds))
    assert tuple(again.df.orderBy(ROW).collect()[1])[:4] == ("b", "GLU", "2.5", "female")
    assert again.meta == ds.meta


@pytest.mark.parametrize("bad", ["<DATA>\na\n</DATA>\n<DATA>\nb\n</DATA>", "<META>\n<DATA>\n</META>\n</DATA>", "x\n<DATA>\na\n</DATA>", "<DATA>\na", "</DATA>", "plain"])
def test_broken_containers(bad):
    with pytest.raises(ValueError):
        C.split_sections(bad)


def test_refuses_markers_in_cells(spark):
    ds = Dataset(spark.createDataFrame([("</DATA>",)], "a string"))
    with pytest.raises(ValueError):
        C.to_text(ds)


def test_workbook(spark, tmp_path):
    ds = C.from_text(spark, TEXT)
    write_workbook(ds, str(tmp_path / "x.xlsx"))
    back = tables.read_any(spark, str(tmp_path / "x.xlsx"))
    assert back.columns == ds.columns and back.df.count() == 4 and back.tags == ds.tags
    sheets = read_sheets(workbook_bytes({"DATA": [["a"], ["=5"]], "Ä&<": [["b"], ["1"]]}))
    assert sheets["DATA"] == [["a"], ["=5"]] and sheets["Ä&<"] == [["b"], ["1"]]
    (tmp_path / "m.xlsx").write_bytes(workbook_bytes({"s1": [["a"], ["1"]], "s2": [["a", "b"], ["2", "3"]]}))
    many = tables.read_any(spark, str(tmp_path / "m.xlsx"))
    assert [tuple(r) for r in many.df.select("sheet_name", "a", "b").orderBy("a").collect()] == [("s1", "1", None), ("s2", "2", "3")]


@pytest.mark.parametrize("fmt", ["csv", "tsv", "jsonl", "parquet", "orc"])
def test_exports(spark, tmp_path, fmt):
    ds = C.from_text(spark, TEXT)
    C.write_table(ds, str(tmp_path / f"x.{fmt}"))
    assert tables.read_any(spark, str(tmp_path / f"x.{fmt}")).df.count() == 4


def test_scripts_and_bundle(spark, tmp_path):
    ds = C.from_text(spark, TEXT)
    import duckdb

    con = duckdb.connect()
    con.execute(C.sql_script(ds))
    assert con.execute("select count(*) from data").fetchall() == [(4,)]
    C.write_table(ds, str(tmp_path / "x.feather"))
    C.write_bundle(ds, str(tmp_path / "bundle"))
    with pytest.raises(FileExistsError):
        C.write_bundle(ds, str(tmp_path / "bundle"))


def test_exports_hold_every_row(spark, tmp_path):
    import json

    import pyarrow.feather as feather

    from cellwright.sources import reports

    n = 20_345
    ds = Dataset(spark.range(n).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") == n - 1, "last").alias("b")))
    for fmt in ("feather", "sql", "xlsx"):
        C.write_table(ds, str(tmp_path / f"x.{fmt}"))
    assert sorted(map(int, feather.read_table(tmp_path / "x.feather").column("a").to_pylist())) == list(range(n))
    assert (tmp_path / "x.sql").read_text().count('INSERT INTO "data" VALUES') == n
    data = read_sheets((tmp_path / "x.xlsx").read_bytes())["DATA"]
    assert len(data) == n + 1 and data[0] == ["a", "b"] and [r for r in data if len(r) > 1][1] == [str(n - 1), "last"]
    C.write_bundle(ds, str(tmp_path / "b"))
    assert len((tmp_path / "b" / "data.tsv").read_text().splitlines()) == n + 1 and json.loads((tmp_path / "b" / "manifest.json").read_text())["rows"] == n
    root = reports.write_report({"t": ds.df}, str(tmp_path / "r"))
    assert len((root / "t.csv").read_text().splitlines()) == n + 1 and (root / "report.html").read_text().count("<tr>") == reports.ROWS + 1


def test_workbook_sheets_and_limit(spark, tmp_path, monkeypatch):
    from cellwright.sources import workbook

    df = spark.createDataFrame([("1", "s1", None), ("2", "s2", "x"), ("3", "s1", None)], "a string, sheet string, b string")
    ds = Dataset(df.coalesce(1), {"sheet": ("SHEET",)})
    write_workbook(ds, str(tmp_path / "x.xlsx"))
    assert read_sheets((tmp_path / "x.xlsx").read_bytes()) == {"s1": [["a"], ["1"], ["3"]], "s2": [["a", "b"], ["2", "x"]]}
    monkeypatch.setattr(workbook, "SHEET_ROWS", 2)
    with pytest.raises(ValueError):
        write_workbook(ds, str(tmp_path / "y.xlsx"))


def test_inference(spark):
    df = spark.createDataFrame([(f"0{i}", str(i), f"<{i}" if i == 3 else str(i), f"2024-01-{i + 10}", "ab"[i % 2], f"t{i}") for i in range(20)], "patient_id string, n string, c string, d string, k string, s string")
    assert tables.infer(df) == {"patient_id": ("ID", "STR"), "n": ("NUM",), "c": ("<NUM>",), "d": ("DATE",), "k": ("CATEGORY",), "s": ("STR",)}


def test_chains_and_log(spark):
    ds = C.from_text(spark, TEXT)
    out, steps = runner.run_work(ds)
    assert out.df.count() == 2 and [s.name for s in steps] == ["VALIDATE", "only", "DESCRIBE", "EDA"]
    assert steps[0].tables["issues"].collect()[0].tag == "WS"
    assert all(t.count() >= 0 for s in steps for t in s.tables.values())
    assert runner.verify_log(out) and len(out.log) == 4
    broken = out.log[0] | {"status": "BAD"}
    assert not runner.verify_log(Dataset(out.df, log=(broken, *out.log[1:])))
    assert runner.run_actions(ds, "main")[0].df.count() == 2
    assert runner.run_commands(ds, "p")[0].df.count() == 1
    runner.register_plugin("HALF", lambda d, o: d.with_df(d.df.where("value is not null")))
    assert runner.run_step(ds, "half", {}).dataset.df.count() == 4
    w = runner.Workflow({"INPUT": 2}).add("a", "INPUT", lambda x: x + 1).add("b", "a", lambda x: x * 2)
    assert w.results["b"] == 6
    assert runner.reproducible(lambda: ds.df.drop(ROW))


def test_harmonise_leaves_nameless_items_alone(spark):
    df = spark.createDataFrame([("A", "<5"), ("A", "<3"), ("A", "4"), ("A", "9"), (None, "<100"), ("B", "7")], "item string, v string")
    out = {(r.item, r.v) for r in comparators.harmonize(df, "item", "v").collect()}
    assert out == {("A", "<5"), ("A", "9"), (None, "<100"), ("B", "7")}


def test_validation_cascade(spark):
    ds = Dataset(spark.createDataFrame([(None, "1"), ("", "x"), ("ok", None)], "a string, b string"), {"a": ("REQUIRED",), "b": ("NUM",)})
    assert sorted((r.column, r.tag) for r in checks.issues(ds).collect()) == [("a", "REQUIRED"), ("a", "REQUIRED"), ("b", "NUM")]
    assert checks.drop_invalid(ds).df.count() == 1


def test_merge_conflicts(spark):
    a = Dataset(spark.createDataFrame([("1",)], "x string"), {"x": ("RESULT", "NUM")})
    b = Dataset(spark.createDataFrame([("<2",)], "y string"), {"y": ("RESULT", "<NUM>")})
    with pytest.raises(ValueError):
        multi.merge({"a": a, "b": b})
    assert sorted(tuple(r) for r in multi.merge({"a": a, "b": b}, numbers="promote").df.collect()) == [("a", "1"), ("b", "<2")]
    split = multi.merge({"a": a, "b": b}, numbers="split").df
    assert sorted((r.source, r["x__cmp"], r["x__num"]) for r in split.collect()) == [("a", "EQ", 1.0), ("b", "LT", 2.0)]


def test_images(spark):
    ds = Dataset(spark.createDataFrame([(tables.data_url(b"abc"),), (None,)], "img string"))
    got = tables.extract_images(ds, "img")
    assert [bytes(r.img_bytes) if r.img_bytes else None for r in got.collect()] == [b"abc", None]
    assert tables.embed_images(Dataset(got), "img").collect()[0].img == tables.data_url(b"abc")


def test_window_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{src}/events.parquet").schema
    stream = streams.events_stream(spark, src, schema, glob="events.parquet")
    streams.run_once(streams.windowed(stream, ["event_type"], "value"), "closed", str(tmp_path / "c"))
    got = {(r.start, r.event_type): r.n for r in spark.table("closed").collect()}
    batch = spark.read.parquet(f"{src}/events.parquet").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp").alias("start"), "event_type", "n")
    want = {(r.start, r.event_type): r.n for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_stateful_rules_do_not_change_earlier_decisions(spark, tmp_path):
    rows = [("g", i, i, m, z) for i, (a, b) in enumerate([(0.1, 0.0), (2.2, 0.0), (2.3, 0.1), (0.0, 3.2)]) for m, z in (("L1", a), ("L2", b))]
    schema = "grp string, run long, order long, material string, z double"
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        import shutil

        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{k}.parquet")
        stream = spark.readStream.schema(spark.createDataFrame(rows, schema).schema).parquet(str(tmp_path / "in"))
        out = []
        streams.run_once(streams.stateful_multirule(stream, "grp"), lambda b, i: out.extend(b.collect()), str(tmp_path / "ck"))
    assert {(r.run, r.material): r.violation for r in out} == {(2, "L1"): "2_2s", (2, "L2"): "NONE", (3, "L1"): "NONE", (3, "L2"): "1_3s"}


def test_sync_sets_changes_aside(spark, tmp_path):
    write = streams.sync_writer(str(tmp_path / "t"), str(tmp_path / "q"), ["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    write(spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string"), 1)
    write(spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string"), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert [(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "q")).collect()] == [(2, "c")]


def test_sync_sets_repeated_keys_aside(spark, tmp_path):
    write = streams.sync_writer(str(tmp_path / "t"), str(tmp_path / "q"), ["k"])
    write(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c"), (None, "x"), (None, "y"), (4, None)], "k int, v string"), 0)
    write(spark.createDataFrame([(1, "a"), (1, "d"), (3, "e")], "k int, v string"), 1)
    found = lambda name: sorted(((r.k, r.v) for r in spark.read.parquet(str(tmp_path / name)).collect()), key=str)
    assert found("t") == [(1, "a"), (3, "e"), (4, None)]
    assert found("q") == [(1, "d"), (2, "b"), (2, "c"), (None, "x"), (None, "y")]
