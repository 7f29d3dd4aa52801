"""Verbs on tiny inline tables."""

import pytest

from cellwright.dataset import ROW, Dataset
from cellwright.operators.actions import join_datasets, run_action, unmatched


def make(spark, rows, schema, tags=None, meta=None):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} bigint, {schema}")
    return Dataset(df, tags or {}, meta or {})


def rows(ds, *cols):
    df = ds.df.orderBy(ROW) if ROW in ds.df.columns else ds.df
    return [tuple(r) for r in df.select(*cols).collect()]


def test_filters(spark):
    ds = make(spark, [("50", "30"), ("150", "45"), ("200", "70"), ("10", "55"), (None, "x")], "result string, age string")
    assert rows(run_action(ds, {"TYPE": "row_include", "COLUMN": "result", "OP": "gt", "VALUE": 100}), "result") == [("150",), ("200",)]
    assert rows(run_action(ds, {"TYPE": "ROW.INCLUDE", "COLUMN": "age", "OP": "between", "VALUE": [60, 40]}), "age") == [("45",), ("55",)]
    # ne holds for absent cells
    assert len(rows(run_action(ds, {"TYPE": "ROW.INCLUDE", "COLUMN": "result", "OP": "ne", "VALUE": "50"}), "result")) == 4
    assert rows(run_action(ds, {"TYPE": "ROW.EXCLUDE", "COLUMN": "age", "OP": "regex", "VALUE": r"^\d+$"}), "age") == [("x",)]


def test_derive_and_division(spark):
    ds = make(spark, [("40", "20"), ("30", "60"), ("1", "0"), ("0", "0"), ("x", "1")], "ast string, alt string")
    out = rows(run_action(ds, {"TYPE": "DERIVE", "NAME": "r", "EXPR": "{ast} / {alt}"}), "r")
    assert out == [(2.0,), (0.5,), (float("inf"),), (None,), (None,)]
    with pytest.raises(ValueError):
        run_action(ds, {"TYPE": "DERIVE", "NAME": "r", "EXPR": "__import__('os')"})


def test_dedup(spark):
    ds = make(spark, [("p1", "a", "1"), ("p1", "a", "1"), ("p1", "a", "2"), ("p2", "a", "1")], "pid string, test string, value string")
    assert len(rows(run_action(ds, {"TYPE": "DEDUP"}), "pid")) == 3
    keyed = run_action(ds, {"TYPE": "DEDUP", "COLUMNS": ["pid", "test"], "KEEP": "last"})
    assert rows(keyed, "pid", "value") == [("p1", "2"), ("p2", "1")]
    assert rows(run_action(ds, {"TYPE": "DEDUP", "COLUMNS": ["pid", "test"], "KEEP": "none"}), "pid") == [("p2",)]


def test_split_concat_template(spark):
    ds = make(spark, [("M/45",), ("F",), (None,)], "sex_age string", {"sex_age": ("SEX", "AGE")})
    out = run_action(ds, {"TYPE": "SPLIT", "COLUMN": "sex_age", "INTO": ["sex", "age"], "SEP": "/"})
    assert rows(out, "sex", "age") == [("M", "45"), ("F", None), (None, None)]
    joined = run_action(out, {"TYPE": "CONCAT", "COLUMNS": ["sex", "age"], "OUTPUT": "x", "SEP": "-", "SKIP_EMPTY": True})
    assert rows(joined, "x") == [("M-45",), ("F",), ("",)]
    assert rows(run_action(out, {"TYPE": "ADD_COLUMN", "NAME": "x", "TEMPLATE": "{sex}:{age}"}), "x") == [("M:45",), ("F:",), (":",)]


def test_impute_bin_round_recode(spark):
    ds = make(spark, [("1",), (None,), ("3",), ("8",)], "v string")
    assert rows(run_action(ds, {"TYPE": "IMPUTE", "COLUMNS": ["v"], "METHOD": "median"}), "v") == [("1",), ("3.0",), ("3",), ("8",)]
    assert rows(run_action(ds, {"TYPE": "IMPUTE", "COLUMNS": ["v"], "METHOD": "ffill"}), "v") == [("1",), ("1",), ("3",), ("8",)]
    assert rows(run_action(ds, {"TYPE": "BIN", "COLUMN": "v", "BINS": [1, 3, 10], "LABELS": ["a", "b"]}), "v_bin") == [("a",), (None,), ("a",), ("b",)]
    half = make(spark, [("0.25",), ("0.35",), ("n",)], "v string")
    assert rows(run_action(half, {"TYPE": "ROUND", "COLUMNS": ["v"], "DECIMALS": 1}), "v") in ([("0.2",), ("0.4",), ("n",)], [("0.2",), ("0.3",), ("n",)])
    assert rows(run_action(half, {"TYPE": "RECODE", "COLUMN": "v", "MAP": {"n": "none"}}), "v")[-1] == ("none",)


def test_units(spark):
    ds = make(spark, [("5.5 mmol/L", "GLU"), ("<2", "GLU"), ("abc", "GLU"), ("90 mg/dL", "GLU"), ("1 xx", "GLU")], "v string, t string")
    out = run_action(ds, {"TYPE": "UNIT.CONVERT", "COLUMN": "v", "TEST_COLUMN": "t", "TARGET_UNIT": "mg/dL"})
    assert rows(out, "v_converted", "conversion_status") == [("99.1001", "CONVERTED"), ("<2", "UNIT_MISSING"), ("abc", "PARSE_ERROR"), ("90", "SAME_UNIT"), ("1 xx", "CONVERSION_MISSING")]


def test_pivots(spark):
    ds = make(spark, [("s1", "1", None), ("s2", "3", "4")], "id string, ast string, alt string")
    long = run_action(ds, {"TYPE": "PIVOT_LONGER", "COLS": ["ast", "alt"], "ID_COLS": ["id"]})
    assert sorted(map(tuple, long.df.select("id", "variable", "value").collect()), key=str) == [("s1", "alt", None), ("s1", "ast", "1"), ("s2", "alt", "4"), ("s2", "ast", "3")]
    wide = run_action(long, {"TYPE": "PIVOT_WIDER", "ID_COLS": ["id"], "NAMES_FROM": "variable", "VALUES_FROM": "value"})
    assert sorted(map(tuple, wide.df.select("id", "alt", "ast").collect())) == [("s1", None, "1"), ("s2", "4", "3")]


def test_join_contract(spark):
    left = make(spark, [("c",), ("a",), ("b",)], "key string")
    right = make(spark, [("b", "2"), ("a", "1")], "key string, value string")
    out = join_datasets(left, right, ["key"], ["key"])
    assert rows(out, "key", "value") == [("c", None), ("a", "1"), ("b", "2")]
    l, r = unmatched(left, right, ["key"], ["key"])
    assert (l.count(), r.count()) == (1, 0)
    with pytest.raises(ValueError):
        join_datasets(left, make(spark, [("b", "2"), ("b", "1")], "key string, value string"), ["key"], ["key"], validate="m:1")
    with pytest.raises(ValueError):
        join_datasets(left, make(spark, [("z", "2")], "key string, value string"), ["key"], ["key"], require_right=True)
    with pytest.raises(ValueError):
        join_datasets(make(spark, [(None,)], "key string"), right, ["key"], ["key"], refuse_missing=True)
    both = join_datasets(make(spark, [(None, "l")], "key string, value string"), make(spark, [(None, "r")], "key string, value string"), ["key"], ["key"])
    assert rows(both, "value", "value_right") == [("l", "r")]


def test_empty_tables(spark):
    ds = make(spark, [], "a string, b string")
    for c in ({"TYPE": "DEDUP"}, {"TYPE": "SORT", "BY": ["a"]}, {"TYPE": "IMPUTE", "COLUMNS": ["a"], "METHOD": "mean"}, {"TYPE": "OUTLIER_FILTER", "COLUMN": "a"}):
        assert run_action(ds, c).df.count() == 0
