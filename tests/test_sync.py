"""Snapshots, annotations and a project that follows its source; streams of control runs against batches."""

import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwright.dataset import ROW
from cellwright.operators import multi, multirule
from cellwright.streaming import streams
from cellwright.streaming.sync import Project


def test_diff_matches_null_keys_and_sets_repeated_keys_apart(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (None, "n", 2.0), (2, "r", 3.0), (2, "s", 4.0), (3, "gone", 5.0), (4, "near", 1.0)], "k int, v string, z double")
    b = spark.createDataFrame([(1, "y", 1.0), (None, "n", 2.5), (2, "r", 3.0), (4, "near", 1.0 + 1e-14), (5, "new", 6.0)], "k int, v string, z double")
    got = {r.k: (r.change, r.columns) for r in multi.snapshot_diff(a, b, ["k"]).collect()}
    assert got == {1: ("modified", "v"), None: ("modified", "z"), 2: ("repeated", None), 3: ("removed", None), 5: ("added", None)}
    assert multi.snapshot_diff(a, a, ["k"]).count() == 1 and multi.snapshot_diff(a.limit(0), a.limit(0), ["k"]).count() == 0


def test_positions(spark):
    a = spark.createDataFrame([(10 * i, f"v{i}") for i in range(400)], "o long, v string")
    b = spark.createDataFrame([(10 * i + 3, f"v{i}" if i != 77 else "w") for i in range(402)], "o long, v string")
    got = {r.position: (r.change, r.columns) for r in multi.positional_diff(a, b, "o").collect()}
    assert got == {78: ("modified", "v"), 401: ("added", None), 402: ("added", None)}
    assert {r.change for r in multi.positional_diff(b, a, "o").collect()} == {"modified", "removed"}


def test_annotation(spark):
    old = spark.createDataFrame([(1, 1.0, 3, "then"), (None, 2.0, 4, "then"), (2, 5.0, 1, "a"), (2, 6.0, 2, "b")], "k int, v double, sync_seq long, synced_at string")
    new = spark.createDataFrame([(1, 1.0 + 1e-15), (None, 2.1), (2, 5.0), (9, None)], "k int, v double")
    got = {r.k: (r.status, r.sync_seq, r.synced_at) for r in multi.annotate_results(old, new, ["k"], None, 7, "now").collect()}
    assert got == {1: ("SAME", 3, "then"), None: ("CHANGED", 4, "then"), 2: ("SAME", 1, "a"), 9: ("NEW", 7, "now")}
    assert {r.status for r in multi.annotate_results(None, new, ["k"]).collect()} == {"NEW"}


def test_project_blocks_accepts_and_annotates(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "k string, v double")
    work = lambda df: df.groupBy("k").agg(F.sum("v").alias("total"))
    p = Project(spark, str(tmp_path / "p"), ["k"], work, ["k"])
    first = p.sync(table([("a", 1.0), ("b", 2.0)]), now="t1")
    assert first.counts == {"added": 2} and not first.blocked and {r.status for r in first.result.collect()} == {"NEW"}
    assert p.sync(table([("a", 1.0), ("b", 2.0)]), now="t2").counts == {} and len(p.records()) == 1
    stopped = p.sync(table([("a", 9.0), ("c", 3.0)]), now="t3")
    assert stopped.blocked and stopped.counts == {"added": 1, "modified": 1, "removed": 1} and p.snapshot().count() == 2
    assert p.sync(table([("a", 9.0), ("a", 8.0)]), accept=True).blocked == "keys repeat"
    assert p.sync(table([(None, 9.0)]), accept=True).blocked == "keys are missing"
    done = p.sync(table([("a", 9.0), ("c", 3.0)]), accept=True, now="t4")
    assert {r.k: (r.total, r.status, r.sync_seq, r.synced_at) for r in done.result.collect()} == {"a": (9.0, "CHANGED", 1, "t1"), "c": (3.0, "NEW", 2, "t4")}
    p.sync(table([("a", 9.0), ("c", 3.0), ("d", 0.0)]), now="t5")
    assert {r.k: r.status for r in p.result().collect()} == {"a": "SAME", "c": "SAME", "d": "NEW"} and [r["sequence"] for r in p.records()] == [1, 2, 3] and p.verify() == []
    state = tmp_path / "p" / "state.json"
    state.write_text(state.read_text().replace('"t4"', '"t0"'))
    (tmp_path / "p" / ".state.json.crc").unlink(missing_ok=True)
    assert p.verify() == [2]


def test_a_sync_reads_its_source_once_and_only_buckets_that_moved(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def growing(batches):  # each read adds to what the source holds
        reads.add(1)
        for b in batches:
            yield b

    rows = [(f"k{i}", float(i), None if i % 7 else "x") for i in range(200)]
    source = lambda rows: spark.createDataFrame(rows, "k string, v double, n string").coalesce(1).mapInArrow(growing, "k string, v double, n string")
    p = Project(spark, str(tmp_path / "p"), ["k"], buckets=8)
    assert p.sync(source(rows)).counts == {"added": 200} and reads.value == 1
    changed = [(k, v + (k == "k7"), n) for k, v, n in rows]
    report = p.sync(source(changed), dry_run=True)
    plan = report.changes._jdf.queryExecution().executedPlan().toString()
    assert reads.value == 2 and report.counts == {"modified": 1} and [(r.k, r.columns) for r in report.changes.collect()] == [("k7", "v")]
    bucket = spark.createDataFrame([("k7",)], "k string").select(F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).first().b
    assert plan.count(f"__bucket") >= 2 and plan.count(f"= {bucket})") + plan.count(f"IN ({bucket})") >= 2
    assert p.sync(source(changed[:-1] + [("new", 1.0, None)]), accept=True).counts == {"added": 1, "modified": 1, "removed": 1}
    assert p.snapshot().columns == ["k", "v", "n"] and p.snapshot().count() == 200 and p.verify() == []
    wider = spark.createDataFrame([(k, v, n) for k, v, n in rows], "k string, v double, n string").withColumn("v", F.col("v").cast("string"))
    assert p.sync(wider).blocked and len(list((tmp_path / "p" / "data").iterdir())) == 3


def test_project_without_keys_is_append_only(spark, tmp_path):
    table = lambda vs: spark.createDataFrame([(i, v) for i, v in enumerate(vs)], f"{ROW} long, v string")
    p = Project(spark, str(tmp_path / "p"))
    p.sync(table("ab"))
    assert p.sync(table("abc")).counts == {"added": 1} and p.sync(table("axc")).blocked and p.sync(table("axc"), dry_run=True, accept=True).counts == {"modified": 1}


def test_a_writer_reads_what_is_there(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "batch=0").mkdir()
    (tmp_path / "t" / "batch=0" / "x.parquet").write_text("not a table")
    with pytest.raises(Exception):
        streams.sync_writer(str(tmp_path / "t"), str(tmp_path / "q"), ["k"])(spark.createDataFrame([(1, "a")], "k int, v string"), 1)


def test_stream_of_500_runs_equals_one_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    runs = pd.DataFrame([("g", r, r, m, float(z)) for r in range(500) for m, z in zip("ab", rng.normal(0.4, 1.15, 2).round(2))], columns=["grp", "run", "order", "material", "z"])
    runs.loc[37, "z"] = np.nan
    want = multirule.judge(runs.drop(columns="grp"))
    schema = "grp string, run long, order long, material string, z double"
    (tmp_path / "in").mkdir()
    out = []
    for k, (lo, hi) in enumerate([(0, 60), (60, 130), (130, 131), (131, 300), (300, 500)]):
        part = runs[(runs.run >= lo) & (runs.run < hi)]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{k}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.run_once(streams.stateful_multirule(stream, "grp"), lambda b, i: out.extend(b.collect()), str(tmp_path / "ck"))
    got = {(r.run, r.material): tuple(r[c] for c in multirule.ADDED) for r in out}
    assert len(out) == 1000 and got == {(r.run, r.material): tuple(getattr(r, c) for c in multirule.ADDED) for r in want.itertuples()}
    assert len({r[0] for r in got.values()}) > 4
    late = spark.createDataFrame([("g", 12, 12, "a", 9.0)], schema)
    late.coalesce(1).write.parquet(str(tmp_path / "late"))
    for f in (tmp_path / "late").glob("*.parquet"):
        shutil.copy(f, tmp_path / "in" / "late.parquet")
    out.clear()
    streams.run_once(streams.stateful_multirule(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "grp"), lambda b, i: out.extend(b.collect()), str(tmp_path / "ck"))
    assert [r.decision for r in out] == ["OUT_OF_ORDER"]
