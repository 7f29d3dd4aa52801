"""Analyses as steps of a work, on small tables whose answers are known."""

import pytest
from pyspark.sql import functions as F

from cellwright.dataset import Dataset
from cellwright.plans import runner


def lab(spark, meta=None):
    rows = [
        ("p1", "GLU", "5.0", "A", "2024-01-01 08:00:00", "4", "6"), ("p1", "GLU", "9.0", "A", "2024-01-02 08:00:00", "4", "6"), ("p1", "GLU", "<4", "B", "2024-01-03 08:00:00", "4", "6"),
        ("p2", "GLU", "bad", "A", "2024-01-01 08:00:00", "4", "6"), ("p2", "K", "30", "HOLD", "2024-01-01 08:00:00", None, None), ("p2", "K", ">5", "A", "2024-02-01 08:00:00", None, "6"),
    ]
    tags = {"pid": ("PATIENT_ID",), "test": ("ITEM",), "value": ("RESULT", "<NUM>"), "machine": ("INSTRUMENT",), "at": ("REPORT_DATE", "DATETIME"), "low": ("REF_LOW",), "high": ("REF_HIGH",)}
    return Dataset(spark.createDataFrame(rows, "pid string, test string, value string, machine string, at string, low string, high string"), tags, meta or {})


def test_flags_and_rates(spark):
    out = runner.run_step(lab(spark), "ABNORMAL_FLAG", {})
    got = {(r.pid, r.value): (r.value_flag, r.value_reason) for r in out.dataset.df.collect()}
    assert got == {("p1", "5.0"): ("N", ""), ("p1", "9.0"): ("H", ""), ("p1", "<4"): ("L", ""), ("p2", "bad"): ("NE", "NO_NUMBER"), ("p2", "30"): ("NE", "NO_INTERVAL"), ("p2", ">5"): ("IND", "BOUNDED_RESULT")}
    rate = {r.test: (r.total, r.evaluated, r.h, r.l, r.ne, r.ind) for r in runner.run_step(lab(spark), "ABNORMAL_FLAG", {"MODE": "RATE"}).tables["value:rate"].collect()}
    assert rate == {"GLU": (4, 3, 1, 1, 1, 0), "K": (2, 0, 0, 0, 1, 1)}
    declared = lab(spark, {"COLUMN": {"value": {"REFERENCE_INTERVAL": {"LOW": 1, "HIGH": 8, "VALID_TO": "2024-01-15"}}}})
    flags = {(r.pid, r.value): (r.value_flag, r.value_reason) for r in runner.run_step(declared, "ABNORMAL_FLAG", {}).dataset.df.collect()}
    assert flags["p1", "9.0"] == ("H", "") and flags["p2", "30"] == ("H", "") and flags["p2", ">5"] == ("NE", "OUTSIDE_VALIDITY")
    wide = Dataset(spark.createDataFrame([("7",)], "K string"), {"K": ("RESULT", "NUM")}, {"COLUMN": {"K": {"PIVOT_CONTEXT": {"REF_LOW": "3", "REF_HIGH": "5"}}}})
    assert runner.run_step(wide, "ABNORMAL_FLAG", {}).dataset.df.first().K_flag == "H"


def test_autoverification(spark):
    out = runner.run_step(lab(spark), "AUTOVERIFICATION", {"CRITICAL_HIGH": 20, "DELTA_PERCENT": 50, "HOLD_INSTRUMENTS": ["hold"]})
    got = {(r.pid, r.value): (r.value_decision, r.value_reasons) for r in out.dataset.df.collect()}
    assert got["p1", "5.0"] == ("PASS", "") and got["p1", "9.0"] == ("REVIEW", "REF_HIGH;DELTA_PERCENT")
    assert got["p2", "30"][0] == "HOLD" and "CRITICAL_HIGH" in got["p2", "30"][1] and "INSTRUMENT_HOLD" in got["p2", "30"][1]
    assert got["p2", "bad"][0] == "REVIEW" and "RESULT_PARSE" in got["p2", "bad"][1] and "CENSORED_RESULT" in got["p1", "<4"][1]
    twice = lab(spark)
    with pytest.raises(Exception, match="two results"):
        runner.run_step(twice.with_df(twice.df.union(twice.df)), "AUTOVERIFICATION", {"DELTA_ABS": 1}).dataset.df.collect()


def test_trends_and_dates(spark):
    t = runner.run_step(lab(spark), "RESULT_TREND", {"PERIOD": "M"}).tables["value:trend"].orderBy("item", "period").collect()
    assert [(r.item, r.n, r.mean) for r in t] == [("GLU", 2, 7.0), ("K", 1, 30.0)]
    ds = Dataset(spark.createDataFrame([("2024/01/31", "u"), ("45000", "Liter"), ("soon", None)], "d string, u string"), {"d": ("DATE",)}, {"COLUMN": {"u": {"VALUES": {"L": ["u", "liter"]}}}})
    assert [r.d for r in runner.run_step(ds, "NORMALIZE_DATETIMES", {}).dataset.df.collect()] == ["2024-01-31", "2023-03-15", "soon"]
    assert [r.u for r in runner.run_step(ds, "NORMALIZE_CATEGORIES", {}).dataset.df.collect()] == ["L", "L", None]


def control(spark, extra=()):
    rows = [("GLU", m, f"r{k:02d}", f"2024-03-{k:02d} 07:00:00", v) for k, (a, b) in enumerate([(100, 50), (105, 51), (105, 49), (98, 50), (99, 58), (101, None)], 1) for m, v in (("L1", a), ("L2", b))]
    df = spark.createDataFrame([*rows, *extra], "test string, level string, run string, at string, value int")
    return Dataset(df, {"test": ("ITEM",), "level": ("QC_LEVEL",), "run": ("RUN_ID",), "at": ("RESULT_TIME", "DATETIME"), "value": ("RESULT", "NUM")})


BASE = {"BASELINES": {"L1": {"MEAN": 100, "SD": 2}, "L2": {"MEAN": 50, "SD": 2}}}


def test_control_charts(spark):
    out = runner.run_step(control(spark), "WESTGARD_QC", BASE).tables
    runs = {r.run: (r.decision, r.rules, r.points) for r in out["runs"].collect()}
    assert runs["r02"] == ("WARNING", "", 2) and runs["r03"] == ("REJECT", "2_2s", 2) and runs["r05"] == ("REJECT", "1_3s", 2) and runs["r06"][0] == "NOT_EVALUATED" and out["rejected"].count() == 2
    off = runner.run_step(control(spark), "WESTGARD_QC", {**BASE, "BY_RESULT": {"GLU": {"RULE_SETTINGS": {"2_2s": {"ACTION": "OFF"}}}}}).tables
    assert {r.run for r in off["rejected"].collect()} == {"r05"}
    modes = runner.run_step(control(spark), "QC_ANALYSIS", {"MODE": ["PRECISION", "SIGMA", "LEVEY_JENNINGS", "WESTGARD"], "TEA": 10, **BASE}).tables
    assert modes["SIGMA"].first().sigma > 0 and modes["LEVEY_JENNINGS"].count() == 11
    assert {r.run for r in modes["WESTGARD"].where("violation like '%2_2s%'").collect()} == {"r03"} and modes["WESTGARD"].select("series").distinct().count() == 2
    flow = runner.run_step(control(spark), "QC_WORKFLOW", BASE).tables
    assert flow["invalid"].first().n == 1 and flow["daily"].count() == 6 and flow["review"].count() == 4 and flow["precision"].count() == 2
    with pytest.raises(Exception, match="without test, material or run"):
        runner.run_step(control(spark, [("GLU", None, "r09", "2024-03-09 07:00:00", 5)]), "QC_ANALYSIS", {"MODE": "PRECISION"}).tables["PRECISION"].collect()
    with pytest.raises(ValueError):
        runner.run_step(control(spark), "QC_ANALYSIS", {"MODE": "GUESS"})
    with pytest.raises(ValueError, match="MATERIAL"):
        runner.run_step(Dataset(control(spark).df, {"test": ("ITEM",)}), "QC_ANALYSIS", {})


def test_comparisons(spark):
    rows = [(i, m, float(i + (0 if m == "a" else 1)), "g1" if i % 2 else "g2", int(i > 6)) for i in range(1, 13) for m in ("a", "b")]
    ds = Dataset(spark.createDataFrame(rows, "sid int, method string, v double, grp string, sick int"), {"v": ("RESULT", "NUM"), "method": ("METHOD",), "grp": ("GROUP",), "sick": ("LABEL",)})
    got = runner.run_step(ds, "METHOD_COMPARISON", {"A": "a", "B": "b", "KEYS": ["sid"], "POINTS": [10]}).tables
    assert got["v:deming"].first().slope == 1.0 and got["v:passing_bablok"].first().intercept == 1.0 and got["v:bias"].first().bias == 1.0 and got["v:deming_predicted"].first().bias == 1.0
    tests = {r.statistic: r.value for r in runner.run_step(ds, "GROUP_TEST", {}).tables["tests"].collect()}
    assert set(tests) >= {"welch_t", "u", "cohen_d"}
    roc = runner.run_step(ds, "ROC_ANALYSIS", {}).tables
    assert roc["v:auc"].first().auc > 0.95 and roc["v:best"].first().youden > 0.8
    two = ds.with_df(ds.df.withColumn("w", -F.col("v")), w=("RESULT", "NUM"))
    assert runner.run_step(two, "CORRELATION", {"METHOD": "spearman"}).tables["correlation"].first().r == -1.0


def test_survey_censor_evaluate(spark):
    rows = [(float(i % 5 + 1), i % 2, i % 3, float(i), "f" if i % 4 else "m", "1" if i % 6 == 0 else "0") for i in range(60)]
    ds = Dataset(spark.createDataFrame(rows, "w double, h int, psu int, v double, sex string, flag string"), {"v": ("RESULT", "NUM")})
    means = {r.domain: r for r in runner.run_step(ds, "SURVEY_DESCRIBE", {"WEIGHT": "w", "STRATUM": "h", "PSU": "psu", "BY": "sex"}).tables["means"].collect()}
    assert set(means) == {"f", "m"} and means["f"].low < means["f"].mean < means["f"].high and means["f"].df == 4
    out = runner.run_step(ds, "CENSOR", {"COLUMNS": {"v": {"FLAG": "flag", "LIMIT": 3.5}}}).dataset
    assert out.tags["v_cens"] == ("RESULT", "<NUM>") and {r.v_cens for r in out.df.where("flag = '1'").collect()} == {"<3.5"}
    base = Dataset(spark.createDataFrame([(1, "x", " "), (2, "y", None)], "k int, a string, b string"), {"a": ("REQUIRED",)})
    new = base.with_df(base.df.withColumn("a", F.when(F.col("k") == 2, "z").otherwise(F.col("a"))))
    tables = runner.run_step(new, "EVALUATE", {"BASELINE": base, "KEY": "k"}).tables
    q = tables["quality"].first()
    assert (q.rows, q.value, q.absent, q.ws, q.issues) == (2, 4, 1, 1, 1) and [(r.column, r.unequal) for r in tables["improvements"].collect()] == [("a", 1)]


def test_plugins_are_steps_of_a_work(spark):
    ds = lab(spark, {"WORKS": {"DEFAULT": ["ABNORMAL_FLAG", "RESULT_TREND"]}, "RESULT_TREND": {"PERIOD": "Y"}})
    out, steps = runner.run_work(ds)
    assert "value_flag" in out.columns and [s.name for s in steps] == ["ABNORMAL_FLAG", "RESULT_TREND"] and runner.verify_log(out)
    assert {"WESTGARD_QC", "METHOD_COMPARISON", "CENSOR"} <= set(runner.steps())
