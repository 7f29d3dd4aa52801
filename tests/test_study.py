"""Integration, study statistics, command line, and the whole catalogue against SQL."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellwright import catalog, cli
from cellwright.dataset import Dataset
from cellwright.functions import units
from cellwright.operators import integration, study

from .test_io_and_plans import TEXT

SRC = "/root/testdata/sf0.001"


def test_units(spark):
    assert units.unit_factor("g/dL", "mg/L") == 10000 and units.unit_factor("mEq/L", "Eq/L") == units.unit_factor("mmol/L", "mol/L")
    with pytest.raises(ValueError):
        units.unit_factor("g/L", "mol/L")
    with pytest.raises(ValueError):
        units.unit_factor("MG/L", "g/L")
    df = spark.createDataFrame([("<1.2",), ("0.1",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(units.convert("c", "mg/dL", "mg/L")).collect()] == ["<12", "1", None, None]


def test_integration_round_trip(spark):
    a = Dataset(spark.createDataFrame([("k1", "1.2"), ("k2", "<0.1"), ("k3", None), ("k4", "bad")], "k string, v string"))
    out = integration.integrate({"a": a}, [integration.Target("res", "mg/L", {"a": {"column": "v", "unit": "mg/dL"}}), integration.Target("other", "U/L")], ["k"])
    got = {r.k: (r.res, r.res_kind, r.res_status) for r in out.collect()}
    assert got == {"k1": (12.0, "EXACT", "CONVERTED"), "k2": (None, "LEFT", "CONVERTED"), "k3": (None, "MISSING", "CONVERTED"), "k4": (None, "MISSING", "PARSE_ERROR")}
    back = integration.restore(out, "a", ["k", "v"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, a.df.collect()), key=str)
    assert integration.differences(out, out).count() == 0
    with pytest.raises(Exception, match="changed"):
        integration.restore(out.withColumn("source_row", F.replace("source_row", F.lit("1.2"), F.lit("9.9"))), "a", ["k", "v"]).collect()
    assert integration.drop_absent_columns(spark.createDataFrame([(1, None)], "a int, b int")).columns == ["a"]


def test_normality_statistics():
    x = np.random.default_rng(0).standard_normal(200)
    assert study.lilliefors(x)[1] > 0.05 > study.lilliefors(np.exp(x))[1]
    from cellwright.functions.special import box_cox_lambda, shapiro_wilk

    assert shapiro_wilk(x)[1] > 0.05 > shapiro_wilk(np.exp(x))[1]
    assert abs(box_cox_lambda(np.exp(x))) < 0.2


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "x.txt.data"
    f.write_text(TEXT, encoding="utf-8")
    for args in (["columns"], ["validate"], ["describe"], ["infer"], ["works"], ["hash"]):
        assert cli.main([args[0], str(f), *args[1:]]) == 0
    assert cli.main(["run", str(f), "--out", str(tmp_path / "o.csv")]) == 0
    assert cli.main(["pipeline", str(f), "main"]) == 0 and cli.main(["commands", str(f), "p"]) == 0 and cli.main(["action", str(f), "only"]) == 0
    assert "GLU" in capsys.readouterr().out and spark.read.csv(str(tmp_path / "o.csv"), header=True).count() == 2


def test_every_command(spark, tmp_path, capsys, monkeypatch):
    import io
    import json

    from cellwright.sources import container as C

    f, t = str(tmp_path / "x.dat"), lambda n: str(tmp_path / n)
    (tmp_path / "x.dat").write_text(TEXT, encoding="utf-8")
    run = lambda *a: cli.main([str(x) for x in a])

    def said(*a):
        capsys.readouterr()
        assert run(*a) == 0, a
        return capsys.readouterr().out

    assert json.loads(said("tags", f)) and "CHEMISTRY_ANALYSIS" in said("plugins") and "patient" in said("presets") and "SORT" in said("actions", f)
    assert run("check", f) in (0, 1) and run("review", f) == 0 and run("check-excel", f) == 0 and run("logs", f) == 0 and run("verify", f) == 0
    columns = C.read_container(spark, f).columns
    for name in ("tags-to-meta", "tags-to-header", "fix", "normalize-datetimes", "normalize-categories", "apply-preset", "split-comparator"):
        assert run(name, f, "--out", t(f"{name}.dat")) == 0
        assert set(columns) <= set(C.read_container(spark, t(f"{name}.dat")).columns)
    assert C.read_container(spark, t("tags-to-meta.dat")).tags == C.read_container(spark, f).tags
    assert "UNSTAMPED" in said("check-integrity", f) and run("stamp", f, t("s.dat")) == 0 and "OK" in said("check-integrity", t("s.dat"))
    text = (tmp_path / "s.dat").read_text()
    (tmp_path / "s2.dat").write_text(text.replace("GLU", "GLX"))
    assert run("check-integrity", t("s2.dat")) == 1
    assert run("sample", f, "--n", "2", "--out", t("n.csv")) == 0 and spark.read.csv(t("n.csv"), header=True).count() == 2
    assert run("merge", f, f, "--out", t("m.dat")) == 0
    assert run("split-file", f, t("half")) == 0 and run("attach-meta", t("half.data.txt"), t("half.meta.txt"), t("whole.dat")) == 0
    assert C.read_container(spark, t("whole.dat")).tags == C.read_container(spark, f).tags
    assert run("export", f, t("e.xlsx")) == 0 and run("import-xlsx", f, t("e.xlsx"), t("i.dat")) == 0 and C.read_container(spark, t("i.dat")).df.count() == 4
    (tmp_path / "raw.csv").write_text("pid,sex,value\n1,M,5\n2,F,<3\n", encoding="utf-8")
    assert run("init", t("raw.csv"), t("start.dat"), "--review", t("why")) == 0 and C.read_container(spark, t("start.dat")).tags["value"] == ("<NUM>",)
    assert run("sync", t("raw.csv"), t("project"), "--key", "pid") == 0
    (tmp_path / "raw.csv").write_text("pid,sex,value\n1,M,6\n2,F,<3\n", encoding="utf-8")
    assert run("sync", t("raw.csv"), t("project"), "--key", "pid") == 1 and run("sync", t("raw.csv"), t("project"), "--key", "pid", "--accept") == 0
    assert run("run-plugin", f, "DESCRIBE") == 0 and run("run", f, "--out", t("done.dat"), "--report", t("rep")) == 0
    assert len(json.loads(said("logs", t("done.dat")))) > 0 and run("verify", t("done.dat")) == 0 and run("clear-log", t("done.dat"), t("clear.dat")) == 0 and said("logs", t("clear.dat")).strip() == "[]"
    monkeypatch.setattr("sys.stdin", io.StringIO(TEXT))
    assert "column" in said("describe", "-")
    (tmp_path / "p.toml").write_text(f'KEYS = ["pid"]\n[SOURCES]\na = "{t("raw.csv")}"\n[TARGETS.v]\nUNIT = "mg/L"\n[TARGETS.v.SOURCES.a]\nCOLUMN = "value"\nUNIT = "mg/dL"\n')
    assert run("integrate", t("p.toml"), t("int.csv")) == 0 and {r.v for r in spark.read.csv(t("int.csv"), header=True).collect()} == {"60.0", None}
    C.register_exporter("count", lambda ds, path: (tmp_path / "c.count").write_text(str(ds.df.count())), [".count"])
    assert run("export", f, t("c.count")) == 0 and (tmp_path / "c.count").read_text() == "4"
    cli.register_command("rows", lambda a, ds: {"rows": ds.df.count()})
    assert json.loads(said("rows", f)) == {"rows": 4}
    assert len(cli.COMMANDS) > 45


def test_containers_stream_and_refuse(spark, tmp_path):
    from cellwright.sources import container as C

    n = 25_000
    ds = Dataset(spark.range(n).select(F.col("id").cast("string").alias("a")), {"a": ("ID",)})
    C.write_container(ds, str(tmp_path / "big.dat"))
    assert C.read_container(spark, str(tmp_path / "big.dat")).df.count() == n
    with pytest.raises(ValueError):
        C.to_text(ds)
    with pytest.raises(ValueError):
        C.write_container(Dataset(spark.createDataFrame([("x </DATA> y",)], "a string")), str(tmp_path / "bad.dat"))
    assert not list(tmp_path.glob("bad*"))
    template = Dataset(spark.createDataFrame([("1", "2")], "A string, b string"), {"A": ("ID",)})
    assert C.import_rows(template, Dataset(spark.createDataFrame([("x", "y")], "B string, a string"))).df.first() == ("y", "x")
    assert C.import_rows(template, Dataset(spark.createDataFrame([("x", "y")], "q string, r string"))).df.first() == ("x", "y")
    for wrong in (spark.createDataFrame([("x",)], "a string"), spark.createDataFrame([("x", "y")], "a string, z string")):
        with pytest.raises(ValueError):
            C.import_rows(template, Dataset(wrong))
    with pytest.raises(ValueError):
        C.import_rows(template, Dataset(spark.createDataFrame([("x", "y")], "a string, b string"), {"b": ("NAME",)}))



def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_catalogue_equals_sql(spark, name):
    import duckdb

    df = catalog.queries()[name](spark, SRC)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*[F.col(f"`{c}`") for c in cols]).collect())
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert len(rows) > 0 or name == "ri_latent_exclusion"
        return
    con = duckdb.connect()
    for f in os.listdir(SRC):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SRC}/{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall()) == rows


def test_presets_and_reports(spark, tmp_path):
    from cellwright.operators import starting
    from cellwright.sources import reports

    ds = Dataset(spark.createDataFrame([("p", "GLU", "1", "M")], "patient string, test string, result string, sex string"))
    assert starting.bind_roles(ds) == {"patient": "patient", "test": "test", "result": "result", "sex": "sex"}
    out = starting.apply_preset(ds)
    assert "RESULT" in out.tags["result"] and out.meta["WORKS"]["DEFAULT"][-1] == "EDA"
    moved = starting.place_tags(out)
    assert moved.meta["COLUMN"]["sex"]["TAGS"] == ["SEX"] and moved.tags == {}
    root = reports.write_report({"a/b": ds.df}, str(tmp_path / "r"), archive=True)
    assert {p.name for p in root.iterdir()} == {"a_b.csv", "report.html", "report.docx", "warnings.txt", "manifest.json"} and root.with_suffix(".zip").exists()
    qc = spark.createDataFrame([("g", r, r, m, float(v)) for r in range(6) for m, v in (("L1", r), ("L2", 10 - r))], "grp string, run int, order int, material string, v double")
    got = starting.qc_workflow(qc, ["grp"], "run", "order", "v")
    assert got["review"].count() == 6 and got["precision"].count() == 2


def test_compositions(spark):
    from cellwright.plans import runner

    rows = [(f"p{i % 7}", f"T{i % 2}", str(i % 13 + 1) if i % 9 else "<1", "MF"[i % 2], str(i % 80), f"2024-01-{i % 28 + 1:02d} 0{i % 9}:00:00", f"2024-01-{i % 28 + 1:02d} 0{i % 9}:{i % 50 + 5:02d}:00", 1.0 + i % 3, i % 2, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "patient string, test string, v string, sex string, age string, got string, out string, w double, h int, u int")
    tags = {"patient": ("PATIENT_ID",), "test": ("ITEM",), "v": ("RESULT", "<NUM>"), "sex": ("SEX",), "age": ("AGE",), "got": ("LAB_RECEIVED_AT",), "out": ("FINAL_REPORTED_AT",)}
    meta = {"COLUMN": {c: {"ID": c.upper()} for c in df.columns}}
    ds = Dataset(df, tags, meta)
    chem = runner.run_step(ds, "CHEMISTRY_ANALYSIS", {})
    assert {"ITEM_COUNTS", "TAT_BY_TEST", "AGE_SEX_RESULT", "DELTA_CHECK"} <= set(chem.tables) and "instrument" in chem.message
    assert chem.tables["TAT_BY_TEST"].count() == 2
    tat = runner.run_step(ds, "LAB_TAT_ANALYSIS", {"BY": ["test"]})
    assert tat.tables["stages"].count() == 0 or tat.tables["summary"].count() >= 0
    ri = runner.run_step(ds, "REFERENCE_INTERVAL", {"POLICY": "VALUE"})
    assert ri.tables["v:intervals"].where("level = 'ITEM_SEX'").count() > 0
    ep = runner.run_step(ds, "RI_EP28", {"INCLUDE": [{"COLUMN_ID": "AGE", "MIN": 18}], "PARTITION": ["sex"], "METHOD": ["NONPARAMETRIC", "PARAMETRIC", "ROBUST"], "OUTLIERS": "TUKEY"})
    assert ep.tables["v:limits"].count() == 6 and {r.reason for r in ep.tables["audit"].collect()} == {"INCLUDED", "NOT_INCLUDED"}
    plan = {"GROUPS": {"old": [{"COLUMN_ID": "AGE", "MIN_EXCLUSIVE": 60}]}, "ANALYSES": [{"TYPE": "SUMMARY"}, {"TYPE": "HISTOGRAM", "LOW": 1, "HIGH": 13, "BINS": 4}, {"TYPE": "SURVEY_MEAN", "WEIGHT_ID": "W", "STRATUM_ID": "H", "PSU_ID": "U"}]}
    done = runner.run_step(ds, "ANALYZE", plan)
    assert {r.group for r in done.tables["1_SUMMARY:v"].collect()} == {"ALL", "old"}
    assert done.tables["3_SURVEY_MEAN:v:old"].first().n > 0


def test_method_comparison(spark):
    from cellwright.operators import intervals, statistics

    rows = [(f"s{i}", m, "g", float(i) if m == "A" else 1.1 * i + 2 + (i % 3 - 1) * 0.01) for i in range(1, 41) for m in "AB"] + [("s99", "A", "g", 5.0)]
    df = spark.createDataFrame(rows, "sample string, method string, item string, v double")
    got = statistics.method_comparison(df, ["sample"], ["item"], "method", F.col("v"), "A", "B", [10.0, 0.0])
    assert got["pairs"].count() == 40
    d, b = got["deming"].first(), got["bias"].first()
    assert d.slope == pytest.approx(1.1, abs=0.01) and d.intercept == pytest.approx(2, abs=0.05)
    x = np.asarray([0.1 * i + 2 + (i % 3 - 1) * 0.01 for i in range(1, 41)])
    half = 2.022691 * x.std(ddof=1) / np.sqrt(40)
    assert (b.bias, b.low, b.high) == pytest.approx((x.mean(), x.mean() - half, x.mean() + half), abs=1e-5)
    at = {r.at: (r.bias, r.bias_pct) for r in got["passing_bablok_predicted"].collect()}
    assert at[10.0][0] == pytest.approx(3.0, abs=0.05) and at[0.0][1] is None
    t = intervals.tail_confidence(intervals.tails(df, ["item"], F.col("v"), 2, 40)).first()
    assert t.below_ci.low < t.below_share < t.below_ci.high


def test_wilcoxon_of_every_pair_with_ties(spark):
    import math

    values = {"a": [1, 2, 2, 3, 3, 3, 5], "b": [2, 3, 4, 4, 5, 5, 6, 6], "c": [3, 3, 9, 9, 9, 7], "d": [3, 3]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [(None, 1.0), ("a", None)], "g string, x double")
    got = {(r.group_a, r.group_b): r for r in study.wilcoxon_pairs(df, F.col("g"), F.col("x")).collect()}
    assert set(got) == {(a, b) for a in values for b in values if a < b}
    for (a, b), r in got.items():
        x, y = values[a], values[b]
        u, n, pool = sum((i > j) + (i == j) / 2 for i in x for j in y), len(x) + len(y), x + y
        ties = sum(pool.count(v) ** 3 - pool.count(v) for v in set(pool))
        d, sd = u - len(x) * len(y) / 2, math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
        z = math.copysign(max(abs(d) - 0.5, 0) / sd, d)
        assert (r.n_a, r.n_b) == (len(x), len(y)) and r.rank_sum == u + len(x) * (len(x) + 1) / 2
        assert r.z == pytest.approx(z, abs=1e-6) and r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-7)
    with pytest.raises(Exception, match="wilcoxon_pairs"):
        study.wilcoxon_partition(df, F.col("g"), F.col("x")).collect()


def test_interval_study_trims_once(spark):
    """After 1000 is gone, 30 lies beyond 3 SD of the others, but stays."""
    from cellwright.plans import runner

    values = [10.0 + i % 5 for i in range(60)] + [30.0, 1000.0]
    ds = Dataset(spark.createDataFrame([(v,) for v in values], "x double"), {"x": ("RESULT", "NUM")})
    row = runner.run_step(ds, "RI_EP28", {"TRIM": 3, "METHOD": "PARAMETRIC"}).tables["x:limits"].first()
    assert (row.n, row.trimmed) == (61, 1)
    assert runner.run_step(ds, "RI_EP28", {"TRIM": 3}).tables["x:limits"].first().n == 62  # ranks need no trimming


def test_interval_study_with_exclusion(spark):
    """Two analytes of 200 people, some with wild values in another test: they leave, and the tables say so."""
    from cellwright.plans import runner

    rng = np.random.default_rng(7)
    a, b, c = rng.normal(100, 5, 200), rng.normal(50, 3, 200), rng.normal(7, 1, 200)
    b[:4], c[:4], a[:4] = 500, 900, 60
    rows = [(i, float(x), float(y), float(z), "m" if i % 2 else "f") for i, (x, y, z) in enumerate(zip(a, b, c))]
    ds = Dataset(spark.createDataFrame(rows, "pid int, a double, b double, c double, sex string"), {"pid": ("ID",), "a": ("RESULT", "NUM"), "b": ("RESULT", "NUM"), "c": ("RESULT", "NUM")})
    out = runner.run_step(ds, "RI_EP28", {"RESULT": ["a"], "SUBJECT": "pid", "LAVE": {"REFERENCE": ["a", "b", "c"], "MAX_ABNORMAL": 1}, "CONFIRMED": True, "METHOD": ["NONPARAMETRIC", "ROBUST"], "BOOTSTRAP_N": 60, "DECIMALS": 2, "CI_WIDTH": 0.5})
    limits = {r.method: r for r in out.tables["a:limits"].collect()}
    gone = {r.subject for r in out.tables["lave:members"].where("target = 'a' and not included").collect()}
    assert limits["NONPARAMETRIC"].n == 200 - len(gone) and limits["NONPARAMETRIC"].status == "candidate_requires_verification" and limits["ROBUST"].low_from is not None
    assert set(range(4)) <= gone and len(gone) < 8 and out.tables["a:sensitivity"].first().low_shift > 0
    assert runner.run_step(ds, "RI_EP28", {"RESULT": ["a"], "SUBJECT": "pid"}).tables["a:limits"].first().status == "exploratory_only"
    with pytest.raises(ValueError, match="SUBJECT"):
        runner.run_step(ds, "RI_EP28", {"RESULT": ["a"], "LAVE": {"MAX_ABNORMAL": 0}})
    by = runner.run_step(ds, "RI_EP28", {"RESULT": ["a"], "PARTITION": ["sex"], "METHOD": ["LOG_PARAMETRIC"]}).tables
    assert by["a:bias"].first().br_low is not None and by["a:sdr"].first().sdr >= 0 and by["a:limits"].count() == 2
    bad = Dataset(spark.createDataFrame([(-1.0,), (2.0,), (3.0,), (4.0,)], "x double"), {"x": ("RESULT", "NUM")})
    row = runner.run_step(bad, "RI_EP28", {"METHOD": "LOG_PARAMETRIC"}).tables["x:limits"].first()
    assert row.low is None and "positive" in row.note and row.status == "insufficient_n"


def test_plans_are_checked_before_they_run(spark):
    from cellwright.plans import runner
    from cellwright.plans.analyses import plan_problems

    rng = np.random.default_rng(3)
    rows = [(float(v), float(x), i % 2, float(i % 3 + 1), i % 4, i % 9) for i, (v, x) in enumerate(rng.normal(5, 1, (120, 2)))]
    ds = Dataset(spark.createDataFrame(rows, "v double, x double, g int, w double, h int, i int"), {"v": ("RESULT", "NUM")}, {"COLUMN": {c: {"ID": c.upper()} for c in "vxgwhi"}})
    wrong = {"GROUPS": {"A": [{"COLUMN_ID": "NONE", "MIN": 1}, {"COLUMN_ID": "G"}]}, "MORE": 1, "ANALYSES": [
        {"TYPE": "GUESS"}, {"TYPE": "HISTOGRAM", "LOW": 1}, {"TYPE": "ROC", "LABEL_ID": "Q"}, {"TYPE": "SUMMARY", "NAME": "s", "BINS": 4}, {"TYPE": "SUMMARY", "NAME": "s"},
        {"TYPE": "SURVEY_CONTRAST", "WEIGHT_ID": "W", "STRATUM_ID": "H", "PSU_ID": "I", "GROUP_A": "A", "GROUP_B": "B"}, {"TYPE": "MODEL", "COVARIATE_IDS": ["X"], "COVARIANCE": "SURVEY", "CLUSTER_ID": "G"}, {"TYPE": "MODEL", "COVARIATE_IDS": ["X"], "COVARIANCE": "OTHER"},
    ]}
    found = "; ".join(plan_problems(ds, wrong))
    for text in ("MORE", "'NONE'", "a test needs", "'GUESS'", "lacks HIGH", "'Q'", "unknown option BINS", "the name repeats", "unknown group 'B'", "lacks PSU_ID", "CLUSTER_ID has no meaning", "COVARIANCE must be"):
        assert text in found, text
    with pytest.raises(ValueError):
        runner.run_step(ds, "ANALYZE", wrong)
    good = {"GROUPS": {"ONE": [{"COLUMN_ID": "G", "IN_NUMBERS": [1]}], "ZERO": [{"COLUMN_ID": "G", "MAX": 0}]}, "ANALYSES": [
        {"TYPE": "MODEL", "NAME": "m", "COVARIATE_IDS": ["X"], "COVARIANCE": k, **more} for k, more in (("HC3", {}),)] + [
        {"TYPE": "MODEL", "NAME": "ms", "COVARIATE_IDS": ["X"], "COVARIANCE": "SURVEY", "WEIGHT_ID": "W", "STRATUM_ID": "H", "PSU_ID": "I", "GROUP": "ONE"}, {"TYPE": "MODEL", "NAME": "mc", "COVARIATE_IDS": ["X"], "COVARIANCE": "CLUSTER", "CLUSTER_ID": "I"},
        {"TYPE": "SURVEY_CONTRAST", "NAME": "c", "WEIGHT_ID": "W", "STRATUM_ID": "H", "PSU_ID": "I", "GROUP_A": "ONE", "GROUP_B": "ZERO"}, {"TYPE": "GROUP_TEST", "NAME": "t", "BY_ID": "G"}, {"TYPE": "CORRELATION", "NAME": "r", "WITH_IDS": ["X", "W"]}, {"TYPE": "INTERVALS", "NAME": "i"},
    ]}
    tables = runner.run_step(ds, "ANALYZE", good).tables
    assert set(tables) == {"m:v", "ms:v", "mc:v", "c:v", "t:v", "r:v", "i:v"} and all(t.count() for t in tables.values())
    assert tables["ms:v"].first().n == 60 and tables["r:v"].count() == 3
