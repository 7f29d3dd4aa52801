"""Catalogue of operator queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dataset import ROW, Dataset
from .functions import values as V
from .functions.derive import compile_formula
from .operators import checks, comparators, intervals, laboratory, multi, statistics, summaries
from .operators.actions import join_datasets, run_action, unmatched

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Shared bindings ---------------------------------------------------------------

#: Quantities as results with comparators.
BOUNDED = "CASE WHEN l_quantity < 5 THEN '<5' WHEN l_quantity > 45 THEN '>45' ELSE CAST(CAST(l_quantity AS INT) AS {text}) END"
SEX = "CASE o_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN '여' ELSE 'x' END"


def events(spark, sf_dir) -> Dataset:
    """Row order is the event number."""
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn(ROW, F.col("event_id"))
    return Dataset(df, {"event_id": ("ID",), "user_id": ("ID(patient)",), "event_type": ("ITEM", "BY"), "value": ("RESULT", "NUM"), "ts": ("DATETIME",)})


def orders(spark, sf_dir) -> Dataset:
    df = table(spark, sf_dir, "orders").withColumn(ROW, F.col("o_orderkey"))
    return Dataset(df, {"o_orderkey": ("ID",), "o_totalprice": ("RESULT", "NUM"), "o_orderdate": ("DATETIME",)})


def bounded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.expr(BOUNDED.format(text="STRING")).alias("res"))


_BOUNDED = f"(SELECT l_orderkey, l_returnflag, {BOUNDED.format(text='VARCHAR')} AS res FROM lineitem)"
_CMP = "(SELECT *, regexp_extract(res, '^(<=|>=|<|>|=)?', 1) AS sign, TRY_CAST(regexp_extract(res, '([0-9.]+)$', 1) AS DOUBLE) AS num FROM " + _BOUNDED + ")"


def _act(ds: Dataset, **config) -> DataFrame:
    return run_action(ds, {k.upper(): v for k, v in config.items()}).df.drop(ROW)


def _stats(x: str, ps=((25, "p25"), (50, "p50"), (75, "p75"), (2.5, "p2_5"), (97.5, "p97_5")), sd=None) -> str:
    s = f"round(stddev_samp({x}), 6)" if sd is None else f"round(coalesce(stddev_samp({x}), {sd}), 6)"
    return f"count({x}) AS n, round(avg({x}), 6) AS mean, {s} AS sd, min({x}) AS min, " + ", ".join(f"round(quantile_cont({x}, {p / 100}), 6) AS {a}" for p, a in ps) + f", max({x}) AS max"


# Rows and columns ------------------------------------------------------------------


@query("SELECT event_id, event_type, value FROM events WHERE value > 100 AND lower(event_type) = 'click'")
def act_row_include(spark, sf_dir):
    return _act(events(spark, sf_dir), type="ROW.INCLUDE", conditions=[{"COLUMN": "value", "OP": "gt", "VALUE": 100}, {"COLUMN": "event_type", "OP": "eq", "VALUE": "CLICK"}]).select("event_id", "event_type", "value")


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type IN ('click', 'view'))")
def act_row_exclude(spark, sf_dir):
    return _act(events(spark, sf_dir), type="ROW.EXCLUDE", column="event_type", op="in", value=["click", "view"]).select("event_id", "event_type")


@query("SELECT event_id, value FROM events WHERE value < 10 OR event_type <> 'click'")
def act_row_or(spark, sf_dir):
    return _act(events(spark, sf_dir), type="ROW.INCLUDE", logic="OR", conditions=[{"COLUMN": "tag:NUM", "OP": "lt", "VALUE": 10}, {"COLUMN": "event_type", "OP": "ne", "VALUE": "click"}]).select("event_id", "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def act_between(spark, sf_dir):
    return _act(orders(spark, sf_dir), type="ROW.INCLUDE", column="o_totalprice", op="between", value=[50000, 1000]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def act_date_compare(spark, sf_dir):
    return _act(orders(spark, sf_dir).with_df(table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))), type="ROW.INCLUDE", column="o_orderdate", op="ge", value="1996-01-01").select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_type), 'large|omo$')")
def act_regex(spark, sf_dir):
    return _act(Dataset(table(spark, sf_dir, "part")), type="ROW.INCLUDE", column="p_type", op="regex", value="LARGE|omo$").select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND starts_with(lower(p_type), 's') OR ends_with(lower(p_brand), '3')")
def act_text_tests(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "part"))
    from .functions.conditions import condition as c

    return ds.df.where((c("contains", F.col("p_name"), "A") & c("startswith", F.col("p_type"), "S")) | c("endswith", F.col("p_brand"), "3")).select("p_partkey")


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0")
def act_not_empty(spark, sf_dir):
    ds = events(spark, sf_dir)
    return _act(ds.with_df(ds.df.withColumn("note", F.when(F.col("event_id") % 7 != 0, "x").when(F.col("event_id") % 2 == 0, ""))), type="ROW.INCLUDE", column="note", op="not_empty").select("event_id")


@query("SELECT event_id, event_type FROM events")
def act_column_include(spark, sf_dir):
    return _act(events(spark, sf_dir), type="COLUMN.INCLUDE", columns=["event_id"], tags=["ITEM"])


@query("SELECT event_id, event_type, value FROM events")
def act_column_exclude(spark, sf_dir):
    return _act(events(spark, sf_dir), type="COLUMN.EXCLUDE", columns=["tag:ID(patient)", "ts"])


@query("SELECT event_id, 'U' || CAST(user_id AS VARCHAR) || '/' || event_type AS code, event_type AS copy, 'lab' AS site FROM events")
def act_add_template(spark, sf_dir):
    ds = run_action(events(spark, sf_dir), {"TYPE": "ADD_COLUMN", "NAME": "code", "TEMPLATE": "U{user_id}/{tag:ITEM}"})
    ds = run_action(ds, {"TYPE": "ADD_COLUMN", "NAME": "copy", "FROM": "event_type"})
    return _act(ds, type="ADD_COLUMN", name="site", value="lab").select("event_id", "code", "copy", "site")


@query("SELECT p_partkey, trim(split_part(p_type, ' ', 1)) AS a, CASE WHEN contains(p_type, ' ') THEN trim(substr(p_type, strpos(p_type, ' ') + 1)) END AS b FROM part")
def act_split(spark, sf_dir):
    return _act(Dataset(table(spark, sf_dir, "part")), type="SPLIT", column="p_type", into=["a", "b"], sep=" ").select("p_partkey", "a", "b")


@query("SELECT c_custkey, concat_ws('-', c_name, c_mktsegment) AS full_name FROM customer")
def act_concat(spark, sf_dir):
    return _act(Dataset(table(spark, sf_dir, "customer")), type="CONCAT", columns=["c_name", "c_mktsegment"], output="full_name", sep="-").select("c_custkey", "full_name")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, floor(l_quantity / 7) AS packs, l_quantity - floor(l_quantity / 7) * 7 AS rest, round(ln(l_extendedprice) + sqrt(abs(-l_quantity)) + greatest(l_tax, l_discount), 6) AS mix FROM lineitem")
def act_derive(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "lineitem"))
    f = lambda e: compile_formula(e, ds.col)
    return ds.df.select("l_orderkey", "l_linenumber", F.round(f("{l_extendedprice} * (1 - {l_discount})"), 4).alias("net"), f("{l_quantity} // 7").alias("packs"), f("{l_quantity} % 7").alias("rest"), F.round(f("log({l_extendedprice}) + sqrt(abs(-{l_quantity})) + max({l_tax}, {l_discount})"), 6).alias("mix"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 6) END AS ratio FROM lineitem WHERE NOT (l_tax = 0 AND l_discount <> 0)")
def act_derive_divide(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "lineitem"))
    return ds.df.where("NOT (l_tax = 0 AND l_discount <> 0)").select("l_orderkey", "l_linenumber", F.round(compile_formula("{l_discount} / {l_tax}", ds.col), 6).alias("ratio"))


@query("SELECT o_orderkey, printf('%.1f', round_even(o_totalprice, 1)) AS o_totalprice FROM orders")
def act_round(spark, sf_dir):
    return _act(orders(spark, sf_dir), type="ROUND", columns=["o_totalprice"], decimals=1).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, CASE WHEN value < 0 THEN NULL WHEN value <= 10 THEN 'low' WHEN value <= 100 THEN 'mid' WHEN value <= 100000 THEN 'high' END AS band FROM events")
def act_bin_edges(spark, sf_dir):
    return _act(events(spark, sf_dir), type="BIN", column="value", bins=[0, 10, 100, 100000], labels=["low", "mid", "high"], name="band").select("event_id", "band")


@query("SELECT event_id, CAST(CAST(greatest(ceil((value - (SELECT min(value) FROM events)) / 25) - 1, 0) AS BIGINT) AS VARCHAR) AS band FROM events")
def act_bin_width(spark, sf_dir):
    return _act(events(spark, sf_dir), type="BIN", column="value", width=25, name="band").select("event_id", "band")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE 'other' END AS state FROM orders")
def act_recode(spark, sf_dir):
    return _act(orders(spark, sf_dir), type="RECODE", column="o_orderstatus", map={"O": "open", "F": "final"}, default="other", name="state").select("o_orderkey", "state")


@query("SELECT p_partkey, CAST(p_size * 18 AS VARCHAR) AS mgdl, CASE WHEN p_size % 3 = 0 THEN 'UNIT_MISSING' WHEN p_size % 3 = 1 THEN 'CONVERTED' ELSE 'SAME_UNIT' END AS status, CASE WHEN p_size % 3 = 1 THEN CAST(p_size * 18 AS VARCHAR) WHEN p_size % 3 = 2 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS out FROM part")
def act_unit_convert(spark, sf_dir):
    raw = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit(""), F.lit(" mmol/L"), F.lit(" mg/dL")), (F.col("p_size") % 3 + 1).cast("int")))
    ds = Dataset(table(spark, sf_dir, "part").withColumn("raw", raw).withColumn("test", F.lit("x")))
    out = _act(ds, type="UNIT.CONVERT", source="raw", test_column="test", target_unit="mg/dL", conversions=[{"TEST": "X", "FROM": "mmol/L", "TO": "mg/dL", "FACTOR": 18.0}], output_value="out", output_status="status")
    return out.select("p_partkey", (F.col("p_size") * 18).cast("string").alias("mgdl"), "status", "out")


@query("SELECT o_orderkey, date_part('year', TIMESTAMP '2000-06-15') - date_part('year', o_orderdate) - CASE WHEN (date_part('month', TIMESTAMP '2000-06-15'), date_part('day', TIMESTAMP '2000-06-15')) < (date_part('month', o_orderdate), date_part('day', o_orderdate)) THEN 1 ELSE 0 END AS age FROM orders")
def act_date_age(spark, sf_dir):
    return _act(orders(spark, sf_dir), type="DATE_DERIVE", kind="age", name="age", **{"from": "o_orderdate"}, as_of="2000-06-15").select("o_orderkey", "age")


@query("SELECT l_orderkey, l_linenumber, round_even((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 8.64e10, 2) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def act_date_diff(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _act(Dataset(j), type="DATE_DERIVE", kind="diff_days", name="days", start="o_orderdate", end="l_shipdate").select("l_orderkey", "l_linenumber", "days")


@query("SELECT event_id, year(ts) AS year, quarter(ts) AS quarter, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, (dayofweek(ts) + 6) % 7 AS weekday, strftime(ts, '%Y-%m-%d') AS date FROM events")
def act_date_part(spark, sf_dir):
    ds = events(spark, sf_dir)
    for p in ("year", "quarter", "month", "day", "hour", "minute", "weekday", "date"):
        ds = run_action(ds, {"TYPE": "DATE_DERIVE", "KIND": "part", "PART": p, "FROM": "ts", "NAME": p})
    return ds.df.select("event_id", "year", "quarter", "month", "day", "hour", "minute", "weekday", "date")


def _holes(spark, sf_dir) -> Dataset:
    ds = events(spark, sf_dir)
    return ds.with_df(ds.df.withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value"))).withColumn("site", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")))))


_HOLES = "(SELECT event_id, event_type, user_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN 's' || CAST(user_id % 3 AS VARCHAR) END AS site FROM events)"


@query(f"SELECT event_id, round(coalesce(value, median(value) OVER (PARTITION BY event_type)), 6) AS value FROM {_HOLES}")
def act_impute_median_by(spark, sf_dir):
    return _act(_holes(spark, sf_dir), type="IMPUTE", method="median", columns=["value"], by=["event_type"]).select("event_id", F.round("value", 6).alias("value"))


@query(f"SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM {_HOLES}")
def act_impute_mean(spark, sf_dir):
    return _act(_holes(spark, sf_dir), type="IMPUTE", method="mean", columns=["value"]).select("event_id", F.round("value", 6).alias("value"))


@query(f"SELECT event_id, coalesce(site, (SELECT site FROM {_HOLES} WHERE site IS NOT NULL GROUP BY site ORDER BY count(*) DESC, site LIMIT 1)) AS site FROM {_HOLES}")
def act_impute_mode(spark, sf_dir):
    return _act(_holes(spark, sf_dir), type="IMPUTE", method="mode", columns=["site"]).select("event_id", "site")


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id) AS value FROM {_HOLES}")
def act_impute_ffill(spark, sf_dir):
    return _act(_holes(spark, sf_dir), type="IMPUTE", method="ffill", columns=["value"], by=["event_type"]).select("event_id", "value")


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id DESC) AS value FROM {_HOLES}")
def act_impute_bfill(spark, sf_dir):
    return _act(_holes(spark, sf_dir), type="IMPUTE", method="bfill", columns=["value"], by=["event_type"]).select("event_id", "value")


@query(f"SELECT event_id, coalesce(site, 'none') AS site FROM {_HOLES}")
def act_impute_constant(spark, sf_dir):
    return _act(_holes(spark, sf_dir), type="IMPUTE", method="constant", columns=["site"], value="none").select("event_id", "site")


@query("SELECT event_id FROM events JOIN (SELECT event_type AS t, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) ON t = event_type WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def act_outlier_iqr(spark, sf_dir):
    return _act(events(spark, sf_dir), type="OUTLIER_FILTER", column="value", by=["event_type"]).select("event_id")


@query("SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE value BETWEEN m - 2 * s AND m + 2 * s")
def act_outlier_sd(spark, sf_dir):
    return _act(events(spark, sf_dir), type="OUTLIER_FILTER", column="value", method="sd", factor=2).select("event_id")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def act_dedup_first(spark, sf_dir):
    return _act(events(spark, sf_dir), type="DEDUP", columns=["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def act_dedup_last(spark, sf_dir):
    return _act(events(spark, sf_dir), type="DEDUP", columns=["user_id", "event_type"], keep="last").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS n FROM events) WHERE n = 1")
def act_dedup_none(spark, sf_dir):
    ds = events(spark, sf_dir)
    return _act(ds.with_df(ds.df.withColumn("day", F.to_date("ts"))), type="DEDUP", columns=["user_id", "event_type", "day"], keep="none").select("event_id", "user_id", "event_type")


@query("SELECT * FROM (SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL)")
def act_dedup_rows(spark, sf_dir):
    return _act(Dataset(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")), type="DEDUP")


@query("SELECT event_id, value FROM (SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 100)")
def act_sort_top(spark, sf_dir):
    ds = events(spark, sf_dir)
    return run_action(ds, {"TYPE": "SORT", "BY": ["value"], "ASCENDING": False}).df.limit(100).select("event_id", "value")


@query("SELECT event_id, value, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place FROM events")
def act_sort(spark, sf_dir):
    out = run_action(events(spark, sf_dir), {"TYPE": "SORT", "BY": ["value"], "ASCENDING": False}).df.withColumn("_at", F.monotonically_increasing_id())
    return out.select("event_id", "value", F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("place"))


@query("SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))")
def act_pivot_longer(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"))
    return _act(ds, type="PIVOT_LONGER", cols=["l_quantity", "l_discount", "l_tax"], names_to="measure", values_to="value")


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY user_id")
def act_pivot_wider_mean(spark, sf_dir):
    out = _act(events(spark, sf_dir), type="PIVOT_WIDER", id_cols=["user_id"], names_from="event_type", values_from="value", agg="mean", names=["click", "view"])
    return out.select("user_id", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@query("SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'click') AS click, arg_min(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def act_pivot_wider_first(spark, sf_dir):
    return _act(events(spark, sf_dir), type="PIVOT_WIDER", id_cols=["user_id"], names_from="event_type", values_from="value", agg="first", names=["click", "view"])


# Joins -------------------------------------------------------------------------------


def _customers(spark, sf_dir) -> Dataset:
    """All customers; every fourth has a key that no order has."""
    moved = F.when(F.col("c_custkey") % 4 == 0, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    return Dataset(table(spark, sf_dir, "customer").select(moved.alias("c_custkey"), "c_name", "c_nationkey"), {"c_name": ("NAME",)})


_CUSTOMERS = "(SELECT CASE WHEN c_custkey % 4 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS c_custkey, c_name, c_nationkey FROM customer)"


def _join(how):
    def f(spark, sf_dir):
        return join_datasets(orders(spark, sf_dir), _customers(spark, sf_dir), ["o_custkey"], ["c_custkey"], how, ["c_name"]).df.select("o_orderkey", "o_custkey", "c_name")

    f.__name__ = f"join_{how}"
    return f


for _how, _sql in (("left", "LEFT"), ("inner", "INNER"), ("right", "RIGHT"), ("outer", "FULL")):
    query(f"SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_name FROM orders {_sql} JOIN {_CUSTOMERS} ON o_custkey = c_custkey")(_join(_how))


def _moved_customers(spark, sf_dir) -> Dataset:
    """All customers; a fourth of the keys are mapped to keys that no order has."""
    key = F.when(F.col("c_custkey") % 4 == 0, -F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    return Dataset(table(spark, sf_dir, "customer").select(key.alias("c_custkey"), "c_name", "c_nationkey"), {"c_name": ("NAME",)})


_MOVED_CUSTOMERS = "(SELECT CASE WHEN c_custkey % 4 = 0 THEN -c_custkey - 1 ELSE c_custkey END AS c_custkey, c_name FROM customer)"


def _whole_join(how):
    def f(spark, sf_dir):
        return join_datasets(orders(spark, sf_dir), _moved_customers(spark, sf_dir), ["o_custkey"], ["c_custkey"], how, ["c_name"]).df.select("o_orderkey", "o_custkey", "c_name")

    f.__name__ = f"join_whole_{how}"
    return f


for _how, _sql in (("left", "LEFT"), ("inner", "INNER"), ("right", "RIGHT"), ("outer", "FULL")):
    query(f"SELECT o_orderkey, coalesce(o_custkey, c_custkey) AS o_custkey, c_name FROM orders {_sql} JOIN {_MOVED_CUSTOMERS} ON o_custkey = c_custkey")(_whole_join(_how))


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {_MOVED_CUSTOMERS})")
def join_whole_unmatched_left(spark, sf_dir):
    return unmatched(orders(spark, sf_dir), _moved_customers(spark, sf_dir), ["o_custkey"], ["c_custkey"])[0].select("o_orderkey")


@query(f"SELECT c_custkey FROM {_MOVED_CUSTOMERS} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_whole_unmatched_right(spark, sf_dir):
    return unmatched(orders(spark, sf_dir), _moved_customers(spark, sf_dir), ["o_custkey"], ["c_custkey"])[1].select("c_custkey")


@query("SELECT a.event_id, b.n FROM events a JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def join_composite(spark, sf_dir):
    ds = events(spark, sf_dir)
    other = Dataset(ds.df.groupBy("user_id", "event_type").agg(F.count("*").alias("n")))
    return join_datasets(ds, other, ["user_id", "event_type"], ["user_id", "event_type"], validate="m:1").df.select("event_id", "n")


@query("SELECT a.event_id, b.label FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS k FROM events) a LEFT JOIN (SELECT * FROM (VALUES (1, 'one'), (NULL, 'none')) v(k, label)) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_key(spark, sf_dir):
    ds = events(spark, sf_dir)
    left = ds.with_df(ds.df.withColumn("k", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3)))
    right = Dataset(spark.sql("SELECT * FROM VALUES (1L, 'one'), (NULL, 'none') AS v(k, label)"))
    return join_datasets(left, right, ["k"], ["k"]).df.select("event_id", "label")


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {_CUSTOMERS})")
def join_unmatched_left(spark, sf_dir):
    return unmatched(orders(spark, sf_dir), _customers(spark, sf_dir), ["o_custkey"], ["c_custkey"])[0].select("o_orderkey")


@query(f"SELECT c_custkey FROM {_CUSTOMERS} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_unmatched_right(spark, sf_dir):
    return unmatched(orders(spark, sf_dir), _customers(spark, sf_dir), ["o_custkey"], ["c_custkey"])[1].select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("""SELECT event_id, count(b.lot) AS matches, min(b.lot) AS lot FROM events LEFT JOIN (SELECT event_type AS t, m, 'lot' || CAST(m AS VARCHAR) AS lot, date_trunc('day', lo) + INTERVAL (30 * m) DAY AS a, date_trunc('day', lo) + INTERVAL (30 * m + 30) DAY AS b FROM (SELECT DISTINCT event_type FROM events), (SELECT min(ts) AS lo FROM events), range(0, 2) r(m)) b ON t = event_type AND ts >= a AND ts < b GROUP BY event_id""")
def qc_baseline_range_join(spark, sf_dir):
    e = events(spark, sf_dir).df.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first = e.agg(F.date_trunc("day", F.min("ts")).alias("lo"))
    base = e.select("event_type").distinct().crossJoin(F.broadcast(first)).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    base = base.select("event_type", F.concat(F.lit("lot"), F.col("m").cast("string")).alias("lot"), (F.col("lo") + F.make_dt_interval(F.col("m") * 30)).alias("valid_from"), (F.col("lo") + F.make_dt_interval(F.col("m") * 30 + 30)).alias("valid_to"))
    return laboratory.match_baselines(e, base, ["event_type"], "ts").select("event_id", "matches", "lot")


# Several datasets ----------------------------------------------------------------------


@query("SELECT 'a' AS source, c_custkey AS c_custkey, c_name AS who, c_acctbal AS bal FROM customer UNION ALL SELECT 'b', s_suppkey, s_name, s_acctbal FROM supplier")
def merge_union(spark, sf_dir):
    a = Dataset(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("who"), F.col("c_acctbal").alias("bal")), {"c_custkey": ("ID",), "who": ("NAME",), "bal": ("RESULT", "NUM")})
    b = Dataset(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), {"s_suppkey": ("ID",), "s_name": ("NAME", "STR"), "s_acctbal": ("RESULT", "NUM")})
    return multi.merge({"a": a, "b": b}).df


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'removed' WHEN o_orderkey % 10 = 1 THEN 'added' ELSE 'modified' END AS change, CASE WHEN o_orderkey % 10 = 2 THEN 'o_totalprice' END AS columns FROM orders WHERE o_orderkey % 10 IN (0, 1, 2)")
def snapshot_diff_keyed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return multi.snapshot_diff(o.where("o_orderkey % 10 <> 1"), new, ["o_orderkey"])


@query("SELECT CASE WHEN change = 'added' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, change, CASE WHEN change = 'modified' THEN 'o_totalprice' END AS columns FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 10 = 0 THEN ['removed', 'added'] ELSE ['modified'] END) AS change FROM orders WHERE o_orderkey % 10 IN (0, 2))")
def snapshot_diff_whole(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    new = o.select(F.when(k % 10 == 0, -k - 1).otherwise(k).alias("o_orderkey"), F.when(k % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus")
    return multi.snapshot_diff(o, new, ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 = 1 THEN 'NEW' WHEN o_orderkey % 10 = 2 THEN 'CHANGED' ELSE 'SAME' END AS status FROM orders")
def result_annotation_whole(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    old = o.select(F.when(k % 10 == 1, -k - 1).otherwise(k).alias("o_orderkey"), F.when(k % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return multi.annotate_results(old, o, ["o_orderkey"], "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 = 1 THEN 'NEW' WHEN o_orderkey % 10 = 2 THEN 'CHANGED' ELSE 'SAME' END AS status FROM orders")
def result_annotation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    old = o.where("o_orderkey % 10 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return multi.annotate_results(old, o, ["o_orderkey"], "o_totalprice")


@query("SELECT c_custkey, 'P' || upper(substr(sha256('pepper|' || trim(c_name)), 1, 12)) AS c_name FROM customer")
def anonymize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", multi.pseudonym(F.col("c_name"), "pepper", "P").alias("c_name"))




# Results with comparators -------------------------------------------------------------------


@query(f"SELECT l_orderkey, res, CASE sign WHEN '' THEN 'EQ' WHEN '<' THEN 'LT' WHEN '>' THEN 'GT' END AS res__cmp, num AS res__num FROM {_CMP}")
def split_comparator(spark, sf_dir):
    return comparators.split_comparator(bounded(spark, sf_dir), "res").select("l_orderkey", "res", "res__cmp", "res__num")


@query(f"SELECT l_returnflag, sum(num) AS with_bounds, sum(CASE WHEN sign = '' THEN num END) AS exact FROM {_CMP} GROUP BY l_returnflag")
def comparator_value(spark, sf_dir):
    return bounded(spark, sf_dir).groupBy("l_returnflag").agg(F.sum(V.comparator_value("res", "VALUE")).alias("with_bounds"), F.sum(V.comparator_value("res", "DELETE")).alias("exact"))


@query(f"SELECT l_orderkey, res FROM {_CMP} WHERE sign = ''")
def comparator_delete(spark, sf_dir):
    return comparators.fix_comparator(bounded(spark, sf_dir), "res").select("l_orderkey", "res")


@query(f"SELECT l_returnflag AS item, CASE sign WHEN '<' THEN 'LT' ELSE 'GT' END AS code, num AS threshold, res AS raw, count(*) AS n FROM {_CMP} WHERE sign <> '' GROUP BY ALL")
def comparator_profile(spark, sf_dir):
    return comparators.profile(bounded(spark, sf_dir), "l_returnflag", "res")


@query(f"SELECT policy, count(*) AS filled, count(*) FILTER (sign = '') AS strict, count(*) FILTER (sign = '') AS exact, count(*) FILTER (sign <> '') AS bounded, 0 AS invalid, count(*) FILTER (sign = '' OR policy = 'VALUE') AS used FROM {_CMP}, (SELECT unnest(['DELETE', 'KEEP', 'HARMONIZE', 'VALUE']) AS policy) GROUP BY policy")
def comparator_policy_impact(spark, sf_dir):
    out = comparators.policy_impact(bounded(spark, sf_dir), "res")
    return out.withColumn("invalid", F.col("invalid").cast("int"))


@query(f"SELECT item, family, CAST(unified AS DOUBLE) AS unified, bounded, CAST((SELECT count(*) FROM {_CMP} WHERE l_returnflag = item AND sign = '' AND CASE family WHEN 'LT' THEN num < unified ELSE num > unified END) AS BIGINT) AS convertible FROM (SELECT l_returnflag AS item, CASE sign WHEN '<' THEN 'LT' ELSE 'GT' END AS family, CASE sign WHEN '<' THEN max(num) ELSE min(num) END AS unified, count(*) AS bounded FROM {_CMP} WHERE sign <> '' GROUP BY l_returnflag, sign)")
def harmonize_preview(spark, sf_dir):
    return comparators.harmonize_preview(bounded(spark, sf_dir), "l_returnflag", "res")


@query("SELECT l_returnflag, CASE WHEN q < 10 THEN '<10' WHEN q > 40 THEN '>40' ELSE CAST(q AS VARCHAR) END AS res, count(*) AS n FROM (SELECT l_returnflag, CAST(l_quantity AS INT) AS q FROM lineitem) GROUP BY ALL")
def harmonize_apply(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    raw = F.when(q < 5, "<5").when((q < 10) & (q % 2 == 0), "<10").when(q > 45, ">45").when((q > 40) & (q % 2 == 0), ">40").otherwise(q.cast("string"))
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", raw.alias("res"))
    return comparators.harmonize(df, "l_returnflag", "res").groupBy("l_returnflag", "res").agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n, round(sum(mid), 6) AS midpoint_sum FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'LEFT' WHEN 2 THEN 'RIGHT' ELSE 'INTERVAL' END AS kind, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 3 THEN CAST(p_size + 1 AS DOUBLE) END AS mid FROM part) GROUP BY kind")
def interval_censoring(spark, sf_dir):
    k, s = F.col("p_size") % 4, F.col("p_size")
    df = table(spark, sf_dir, "part").select(F.when(k == 0, s).cast("string").alias("r"), F.when(k.isin(2, 3), s).cast("string").alias("lo"), F.when(k == 1, s).when(k == 3, s + 2).cast("string").alias("hi"))
    return df.groupBy(comparators.censor_kind("r", "lo", "hi").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(comparators.censor_value("r", "lo", "hi", "MIDPOINT")), 6).alias("midpoint_sum"))


# Descriptions ----------------------------------------------------------------------------


@query("SELECT 'value' AS \"column\", " + _stats("value", ((1, "p1"), (2.5, "p2_5"), (5, "p5"), (10, "p10"), (25, "p25"), (50, "p50"), (75, "p75"), (90, "p90"), (95, "p95"), (97.5, "p97_5"), (99, "p99"))) + ", count(DISTINCT value) AS \"distinct\" FROM events")
def describe(spark, sf_dir):
    return summaries.describe(events(spark, sf_dir).df, ["value"]).drop("absent", "null", "empty", "ws", "value")


@query("SELECT event_type AS value, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_known, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_rows, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY event_type")
def category_distribution(spark, sf_dir):
    return summaries.category_distribution(events(spark, sf_dir).df, "event_type")


@query("SELECT 'o_totalprice' AS \"column\", CAST(50 AS DOUBLE) AS percentile, round(median(o_totalprice), 6) AS value, count(*) AS n FROM orders UNION ALL SELECT 'o_custkey', 50, round(median(CAST(o_custkey AS DOUBLE)), 6), count(*) FROM orders UNION ALL SELECT 'o_totalprice', 97.5, round(quantile_cont(o_totalprice, 0.975), 6), count(*) FROM orders UNION ALL SELECT 'o_custkey', 97.5, round(quantile_cont(CAST(o_custkey AS DOUBLE), 0.975), 6), count(*) FROM orders")
def percentiles(spark, sf_dir):
    return summaries.percentile_table(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]).where("percentile in (50, 97.5)")


@query("SELECT CASE WHEN value <= p25 THEN '<=p25' WHEN value <= p50 THEN 'p25-p50' WHEN value <= p75 THEN 'p50-p75' ELSE '>p75' END AS band, count(*) AS n FROM events, (SELECT quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM events) GROUP BY 1")
def percentile_bands(spark, sf_dir):
    return summaries.percentile_bands(events(spark, sf_dir).df, "value", [25, 50, 75])


_S3 = ((2.5, "p2_5"), (50, "p50"), (97.5, "p97_5"))


@query("SELECT l_linestatus AS item, \"by\", level, " + _stats("x", _S3) + " FROM (SELECT l_linestatus, 'all' AS \"by\", 'all' AS level, l_extendedprice AS x FROM lineitem UNION ALL SELECT l_linestatus, 'flag', l_returnflag, l_extendedprice FROM lineitem) GROUP BY ALL")
def result_by(spark, sf_dir):
    return summaries.result_by(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), {"flag": F.col("l_returnflag")}, F.col("l_linestatus"))


@query("SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS level, " + _stats("l_quantity", ((50, "p50"),)) + " FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, sf_dir):
    return summaries.grouping_sets(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity"))


@query("SELECT 'note' AS \"column\", count(*) FILTER (event_id % 5 = 0) AS absent, count(*) FILTER (event_id % 5 = 1) AS \"null\", count(*) FILTER (event_id % 5 = 2) AS empty, count(*) FILTER (event_id % 5 = 3) AS ws, count(*) FILTER (event_id % 5 = 4) AS value FROM events")
def state_counts(spark, sf_dir):
    stored = F.element_at(F.array(F.lit(""), F.lit("<<NULL>>"), F.lit("<<EMPTY>>"), F.lit("<<WS:3>>"), F.lit("x")), (F.col("event_id") % 5 + 1).cast("int"))
    return summaries.state_counts(events(spark, sf_dir).df.select(V.decode_cell(stored).alias("note")), ["note"])


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<<NULL>>' WHEN 2 THEN '<<EMPTY>>' WHEN 3 THEN '<<WS:3>>' ELSE '\\<<NULL>>' END AS stored FROM events")
def cell_round_trip(spark, sf_dir):
    stored = F.element_at(F.array(F.lit(""), F.lit("<<NULL>>"), F.lit("<<EMPTY>>"), F.lit("<<WS:3>>"), F.lit("\\<<NULL>>")), (F.col("event_id") % 5 + 1).cast("int"))
    return events(spark, sf_dir).df.select("event_id", V.encode_cell(V.decode_cell(stored)).alias("stored"))


_AGE = "o_custkey % 90"


@query(f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN a < 1 THEN '<1' WHEN a >= 70 THEN '70+' ELSE CAST(greatest(a // 10 * 10, 1) AS VARCHAR) || '-' || CAST(a // 10 * 10 + 9 AS VARCHAR) END AS band FROM (SELECT {_AGE} AS a FROM orders)) GROUP BY band")
def age_bands(spark, sf_dir):
    return orders(spark, sf_dir).df.groupBy(V.age_band(F.expr(_AGE)).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN CAST(o_custkey % 90 AS DOUBLE) WHEN 1 THEN (o_custkey % 90) / 12.0 ELSE (o_custkey % 90) / 365.25 END AS years FROM orders")
def age_parse(spark, sf_dir):
    raw = F.concat((F.col("o_custkey") % 90).cast("string"), F.element_at(F.array(F.lit(" years"), F.lit("개월"), F.lit("d")), (F.col("o_custkey") % 3 + 1).cast("int")))
    return orders(spark, sf_dir).df.select("o_orderkey", V.age_years(raw).alias("years"))


@query(f"SELECT raw, CASE raw WHEN 'M' THEN 'male' WHEN '여' THEN 'female' ELSE 'other' END AS canonical, true AS recognised, true AS will_change, count(*) AS n, count(*) AS canonical_n FROM (SELECT {SEX} AS raw FROM orders) GROUP BY raw")
def sex_normalize(spark, sf_dir):
    df = orders(spark, sf_dir).df.select(F.expr(SEX).alias("sex"))
    return checks.value_profile(df, "sex", V.sex("sex"))


@query("SELECT o_orderkey, CASE o_custkey % 2 WHEN 0 THEN 'female' ELSE 'male' END AS sex FROM orders")
def sex_by_code(spark, sf_dir):
    return orders(spark, sf_dir).df.select("o_orderkey", V.sex((F.col("o_custkey") % 2).cast("double"), {"0": "female", "1": "male"}).alias("sex"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def datetime_normalize(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return orders(spark, sf_dir).df.select("o_orderkey", V.iso(V.temporal(raw)).alias("day"))


@query("SELECT 'a' AS \"column\", tag, count(*) AS n FROM (SELECT CASE WHEN p_size % 5 = 0 THEN 'REQUIRED' WHEN p_size % 5 = 1 THEN 'NUM' WHEN p_size > 40 THEN 'MAX' END AS tag FROM part) WHERE tag IS NOT NULL GROUP BY tag")
def validate_issues(spark, sf_dir):
    cell = F.when(F.col("p_size") % 5 == 1, "n/a").when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string"))
    ds = Dataset(table(spark, sf_dir, "part").select(cell.alias("a")), {"a": ("REQUIRED", "NUM")}, {"COLUMN": {"a": {"LIMITS": {"MAX": 40}}}})
    return checks.issues(ds).groupBy("column", "tag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size % 5 > 1 AND p_size <= 40")
def validate_delete(spark, sf_dir):
    cell = F.when(F.col("p_size") % 5 == 1, "n/a").when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string"))
    ds = Dataset(table(spark, sf_dir, "part").select("p_partkey", cell.alias("a")), {"a": ("REQUIRED", "NUM")}, {"COLUMN": {"a": {"MAX": 40}}})
    return checks.drop_invalid(ds).df.select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return checks.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'c' AS \"column\", kind, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'leading_zero' WHEN p_partkey % 3 = 1 THEN 'precision' END AS kind FROM part) WHERE kind IS NOT NULL GROUP BY kind")
def excel_damage(spark, sf_dir):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("0"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.lpad(F.col("p_partkey").cast("string"), 17, "9")).otherwise("ok")
    return checks.excel_damage(table(spark, sf_dir, "part").select(cell.alias("c")), ["c"])


# Laboratory ----------------------------------------------------------------------------------


def _ev(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).df


@query("SELECT event_type AS item, count(*) AS n FROM events GROUP BY 1")
def item_counts(spark, sf_dir):
    return laboratory.item_counts(_ev(spark, sf_dir), F.col("event_type"))


@query("SELECT event_type AS item, " + _stats("value", sd=0) + " FROM events GROUP BY 1")
def result_summary(spark, sf_dir):
    return laboratory.result_summary(_ev(spark, sf_dir), F.col("event_type"), F.col("value"))


@query("""WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, CAST(least(12, greatest(4, floor(sqrt(count(*))))) AS INT) AS k FROM events GROUP BY 1),
b AS (SELECT event_type, CAST(least(greatest(ceil((value - lo) / (hi - lo) * k), 1), k) AS INT) AS bin FROM events JOIN s USING (event_type))
SELECT s.event_type, r.bin, round(lo + (hi - lo) * (r.bin - 1) / k, 6) AS low, round(lo + (hi - lo) * r.bin / k, 6) AS high, count(b.bin) AS count FROM s, (SELECT CAST(unnest(range(1, 13)) AS INT) AS bin) r LEFT JOIN b ON b.event_type = s.event_type AND b.bin = r.bin WHERE r.bin <= k GROUP BY ALL""")
def result_histogram(spark, sf_dir):
    return summaries.histogram(_ev(spark, sf_dir), ["event_type"], F.col("value"))


@query("SELECT item, instrument, n, round(mean, 6) AS mean, round(median, 6) AS median, round(m, 6) AS item_median, round(median - m, 6) AS bias, round(100 * (median - m) / m, 6) AS bias_pct FROM (SELECT event_type AS item, user_id % 5 AS instrument, count(value) AS n, avg(value) AS mean, median(value) AS median FROM events GROUP BY 1, 2) JOIN (SELECT event_type AS item, median(value) AS m FROM events GROUP BY 1) USING (item)")
def instrument_bias(spark, sf_dir):
    return laboratory.instrument_bias(_ev(spark, sf_dir), F.col("event_type"), F.col("user_id") % 5, F.col("value"))


_TAT = "SELECT {by}, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95, round(min(x), 6) AS min, round(max(x), 6) AS max FROM (SELECT *, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 6e7 AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE x >= 0 GROUP BY ALL"


def _tat(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query(_TAT.format(by="l_returnflag AS item"))
def tat_by_test(spark, sf_dir):
    return laboratory.turnaround(_tat(spark, sf_dir), {"item": F.col("l_returnflag")}, F.col("o_orderdate"), F.col("l_shipdate"))


@query(_TAT.format(by="l_returnflag AS item, l_suppkey % 5 AS instrument"))
def tat_by_instrument(spark, sf_dir):
    return laboratory.turnaround(_tat(spark, sf_dir), {"item": F.col("l_returnflag"), "instrument": F.col("l_suppkey") % 5}, F.col("o_orderdate"), F.col("l_shipdate"))


@query("SELECT CAST(ts AS DATE) AS date, event_type AS item, count(*) AS n FROM events GROUP BY ALL")
def daily_workload(spark, sf_dir):
    return laboratory.workload(_ev(spark, sf_dir), F.col("ts"), F.col("event_type"))


@query("SELECT hour(ts) AS hour, event_type AS item, count(*) AS n FROM events GROUP BY ALL")
def hourly_workload(spark, sf_dir):
    return laboratory.workload(_ev(spark, sf_dir), F.col("ts"), F.col("event_type"), "hour")


@query(f"SELECT o_orderstatus AS item, sex, CASE WHEN a < 1 THEN '<1' WHEN a >= 70 THEN '70+' ELSE CAST(greatest(a // 10 * 10, 1) AS VARCHAR) || '-' || CAST(a // 10 * 10 + 9 AS VARCHAR) END AS age_band, " + _stats("o_totalprice", ((50, "p50"),), sd=0) + f" FROM (SELECT *, {_AGE} AS a, CASE o_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS sex FROM orders) GROUP BY 1, 2, 3")
def age_sex_result(spark, sf_dir):
    return laboratory.age_sex_summary(orders(spark, sf_dir).df, F.col("o_orderstatus"), V.sex(F.expr(SEX)), F.expr(_AGE), F.col("o_totalprice"))


@query("SELECT event_type AS item, round(a - 1.5 * (b - a), 6) AS low, round(b + 1.5 * (b - a), 6) AS high, count(*) AS n, count(*) FILTER (value < a - 1.5 * (b - a)) AS below, count(*) FILTER (value > b + 1.5 * (b - a)) AS above FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) USING (event_type) GROUP BY event_type, a, b")
def outliers_iqr(spark, sf_dir):
    return laboratory.tukey_outliers(_ev(spark, sf_dir), F.col("event_type"), F.col("value"))


_LAG = "SELECT event_id, value, lag(value) OVER w AS previous, ts, lag(ts) OVER w AS pts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"


@query(f"SELECT event_id, value, previous, round(value - previous, 6) AS change, round(abs(value - previous), 6) AS abs_change, CASE WHEN previous <> 0 THEN round(100 * abs(value - previous) / abs(previous), 6) END AS pct_change, round((epoch_us(ts) - epoch_us(pts)) / 3.6e9, 6) AS hours FROM ({_LAG}) WHERE previous IS NOT NULL")
def delta_check(spark, sf_dir):
    return laboratory.delta(_ev(spark, sf_dir), F.col("user_id"), F.col("event_type"), F.col("ts"), F.col("value"), ["event_id"]).drop("patient", "item", "at")


_FLAG = "CASE WHEN sign = '<' AND num <= 10 THEN 'L' WHEN sign = '>' AND num >= 40 THEN 'H' WHEN sign <> '' THEN 'IND' WHEN num < 10 THEN 'L' WHEN num > 40 THEN 'H' ELSE 'N' END"


def _flags(spark, sf_dir):
    return laboratory.flag_results(bounded(spark, sf_dir), F.col("res"), F.lit(10.0), F.lit(40.0), keep_parsed=True)


@query(f"SELECT l_orderkey, res, {_FLAG} AS flag FROM {_CMP}")
def abnormal_flag(spark, sf_dir):
    return _flags(spark, sf_dir).select("l_orderkey", "res", "flag")


@query(f"SELECT item, total, total AS evaluated, 0 AS ne, 0 AS ind, h, l, round(100.0 * h / total, 6) AS h_pct, round(100.0 * l / total, 6) AS l_pct, round(100.0 * (h + l) / total, 6) AS abnormal_pct FROM (SELECT l_returnflag AS item, count(*) AS total, count(*) FILTER ({_FLAG} = 'H') AS h, count(*) FILTER ({_FLAG} = 'L') AS l FROM {_CMP} GROUP BY 1)")
def abnormal_rate(spark, sf_dir):
    out = laboratory.abnormal_rate(_flags(spark, sf_dir), {"item": F.col("l_returnflag")}, F.col("flag"))
    return out.withColumns({"ne": F.col("ne").cast("int"), "ind": F.col("ind").cast("int")})


@query(f"SELECT decision, reasons, count(*) AS n FROM (SELECT CASE WHEN num < 2 AND sign = '' OR num > 44 AND sign = '' THEN 'HOLD' WHEN sign <> '' OR num < 10 OR num > 40 THEN 'REVIEW' ELSE 'PASS' END AS decision, concat_ws(';', CASE WHEN sign <> '' THEN 'CENSORED_RESULT' END, CASE WHEN sign <> '' THEN 'RESULT_PARSE' END, CASE WHEN sign = '' AND num < 2 THEN 'CRITICAL_LOW' END, CASE WHEN sign = '' AND num > 44 THEN 'CRITICAL_HIGH' END, CASE WHEN {_FLAG} = 'L' THEN 'REF_LOW' END, CASE WHEN {_FLAG} = 'H' THEN 'REF_HIGH' END) AS reasons FROM {_CMP}) GROUP BY ALL")
def autoverification(spark, sf_dir):
    none = F.lit(None).cast("double")
    exact = F.when(F.col("_sign").isin("", "="), F.col("_number"))
    d, why = laboratory.autoverify(exact, F.col("_sign"), F.col("flag"), none, none, 2.0, 44.0)
    return _flags(spark, sf_dir).select(d.alias("decision"), why.alias("reasons")).groupBy("decision", "reasons").agg(F.count("*").alias("n"))


def _stage_rows(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    pts = {"ORDER_PLACED_AT": t, "SPECIMEN_COLLECTED_AT": F.when(F.col("event_id") % 9 != 0, t + F.make_dt_interval(mins=(F.col("event_id") % 30).cast("int") - 2)), "FINAL_REPORTED_AT": t + F.make_dt_interval(mins=(F.col("event_id") % 120).cast("int"))}
    return laboratory.stage_rows(_ev(spark, sf_dir), pts, ["event_id", "event_type"], {"order_to_final": 100})


_STAGES = """(SELECT event_id, event_type, stage, CASE WHEN stage <> 'order_to_final' AND event_id % 9 = 0 THEN NULL ELSE CAST(CASE stage WHEN 'order_to_collection' THEN event_id % 30 - 2 WHEN 'order_to_final' THEN event_id % 120 ELSE event_id % 120 - (event_id % 30 - 2) END AS DOUBLE) END AS minutes FROM events, (SELECT unnest(['order_to_collection', 'order_to_final', 'collection_to_final']) AS stage))"""


@query(f"SELECT event_id, event_type, stage, minutes, CASE WHEN minutes IS NULL THEN CASE stage WHEN 'order_to_collection' THEN 'missing_end' ELSE 'missing_start' END WHEN minutes < 0 THEN 'negative' ELSE 'ok' END AS status, coalesce(stage = 'order_to_final' AND minutes > 100, false) AS breach FROM {_STAGES}")
def lab_tat_stages(spark, sf_dir):
    return _stage_rows(spark, sf_dir)


@query(f"SELECT event_type, stage, count(*) AS rows, count(v) AS valid, count(*) FILTER (minutes IS NULL) AS missing, count(*) FILTER (minutes < 0) AS negative, count(*) FILTER (stage = 'order_to_final' AND minutes > 100) AS breaches, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, min(v) AS min, max(v) AS max FROM (SELECT *, CASE WHEN minutes >= 0 THEN minutes END AS v FROM {_STAGES}) GROUP BY ALL")
def lab_tat_summary(spark, sf_dir):
    return laboratory.stage_summary(_stage_rows(spark, sf_dir), ["event_type"])


@query("SELECT item, period, n, round(mean, 6) AS mean, round(median, 6) AS median, round(avg(mean) OVER (PARTITION BY item ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_mean FROM (SELECT event_type AS item, date_trunc('day', ts) AS period, count(*) AS n, avg(value) AS mean, median(value) AS median FROM events GROUP BY 1, 2)")
def trend(spark, sf_dir):
    return laboratory.trend(_ev(spark, sf_dir), F.col("event_type"), F.col("ts"), F.col("value")).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("SELECT event_type, lot, n, round(m, 6) AS mean, round(s, 6) AS sd, round(100 * s / m, 6) AS cv_pct, round((25 - 1) / (100 * s / m), 6) AS sigma FROM (SELECT event_type, user_id % 2 AS lot, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1, 2)")
def qc_precision(spark, sf_dir):
    return laboratory.qc_precision(_ev(spark, sf_dir).withColumn("lot", F.col("user_id") % 2), ["event_type", "lot"], F.col("value"), 25.0, -1.0)


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS point, value, round(avg(value) OVER p, 6) AS mean, round(stddev_samp(value) OVER p, 6) AS sd, round((value - avg(value) OVER p) / stddev_samp(value) OVER p, 6) AS z FROM events WINDOW p AS (PARTITION BY event_type)")
def levey_jennings(spark, sf_dir):
    return laboratory.levey_jennings(_ev(spark, sf_dir), ["event_type"], ["event_id"], F.col("value"))


def _qc_points(spark, sf_dir):
    """Two materials a run; z from the value's own group."""
    e = _ev(spark, sf_dir).withColumns({"run": F.floor(F.col("event_id") / 2), "material": F.concat(F.lit("L"), (F.col("event_id") % 2).cast("string")), "grp": F.pmod(F.floor(F.col("event_id") / 2), F.lit(10))})
    s = e.groupBy("grp").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return e.join(F.broadcast(s), "grp").select("event_id", "grp", "run", F.col("run").alias("order"), "material", F.round((F.col("value") - F.col("m")) / F.col("s"), 4).alias("z"))


_QC = "(SELECT event_id, grp, run, material, round((value - avg(value) OVER (PARTITION BY grp)) / stddev_samp(value) OVER (PARTITION BY grp), 4) AS z FROM (SELECT *, event_id // 2 AS run, 'L' || CAST(event_id % 2 AS VARCHAR) AS material, event_id // 2 % 10 AS grp FROM events))"
_WG = f"(SELECT *, CASE WHEN v = '' THEN 'NONE' ELSE v END AS violation FROM (SELECT *, concat_ws(', ', CASE WHEN abs(z) > 3 THEN '1_3s' END, CASE WHEN max(z) OVER r > 2 AND min(z) OVER r < -2 AND abs(z) > 2 THEN 'R_4s' END, CASE WHEN z > 2 AND (count(*) FILTER (z > 2) OVER r >= 2 OR lag(z) OVER a > 2) OR z < -2 AND (count(*) FILTER (z < -2) OVER r >= 2 OR lag(z) OVER a < -2) THEN '2_2s' END) AS v FROM {_QC} WINDOW r AS (PARTITION BY grp, run), a AS (PARTITION BY grp, material ORDER BY run)))"


@query(f"SELECT event_id, violation FROM {_WG}")
def westgard_basic(spark, sf_dir):
    return laboratory.westgard_basic(_qc_points(spark, sf_dir), ["grp"], "run", "order").select("event_id", "violation")


@query(f"SELECT grp, run, observations, flagged, 0 AS not_evaluated, coalesce(rules, '') AS rules, round(max_abs_z, 6) AS max_abs_z, flagged > 0 AS review FROM (SELECT grp, run, count(*) AS observations, count(*) FILTER (violation <> 'NONE') AS flagged, max(abs(z)) AS max_abs_z FROM {_WG} GROUP BY 1, 2) LEFT JOIN (SELECT grp, run, string_agg(x, ', ' ORDER BY x) AS rules FROM (SELECT DISTINCT grp, run, unnest(string_split(violation, ', ')) AS x FROM {_WG} WHERE violation <> 'NONE') GROUP BY 1, 2) USING (grp, run)")
def qc_run_review(spark, sf_dir):
    judged = laboratory.westgard_basic(_qc_points(spark, sf_dir), ["grp"], "run", "order")
    return laboratory.run_review(judged, ["grp"], "run").withColumn("not_evaluated", F.col("not_evaluated").cast("int"))


@query()
def westgard_multirule(spark, sf_dir):
    from .operators.multirule import multirule

    return multirule(_qc_points(spark, sf_dir), "grp").select("event_id", "violation", "warning", "decision", "run_decision")


# Statistics -----------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@query("SELECT l_returnflag, n, round(b, 6) AS slope, round(my - b * mx, 6) AS intercept, round(sxy / sqrt(sxx * syy), 6) AS r, round(sxy / sxx, 6) AS ols_slope FROM (SELECT *, (syy - sxx + sqrt((syy - sxx) ** 2 + 4 * sxy * sxy)) / (2 * sxy) AS b FROM (SELECT l_returnflag, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1))")
def deming(spark, sf_dir):
    return statistics.deming(_pairs(spark, sf_dir), ["l_returnflag"])


@query("SELECT l_returnflag, count(*) AS n, round(avg(d), 6) AS bias, round(stddev_samp(d), 6) AS sd, round(avg(d) - 1.96 * stddev_samp(d), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d), 6) AS high FROM (SELECT l_returnflag, l_extendedprice / 1000 - l_quantity AS d FROM lineitem) GROUP BY 1")
def bland_altman(spark, sf_dir):
    return statistics.bland_altman(_pairs(spark, sf_dir), ["l_returnflag"])


@query("""WITH p AS (SELECT n_regionkey AS g, n_nationkey AS i, CAST(n_nationkey AS DOUBLE) AS x, CAST((n_nationkey * 7) % 25 AS DOUBLE) AS y FROM nation),
s AS (SELECT a.g, (b.y - a.y) / (b.x - a.x) AS s FROM p a JOIN p b ON a.g = b.g AND a.i < b.i WHERE (b.y - a.y) / (b.x - a.x) <> -1),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, count(*) FILTER (s < -1) OVER (PARTITION BY g) AS k FROM s),
m AS (SELECT g, avg(s) AS slope FROM k WHERE i IN (least(n - 1, (n - 1) // 2 + k), least(n - 1, n // 2 + k)) GROUP BY g)
SELECT g, count(*) AS n, round(any_value(slope), 6) AS slope, round(median(y - slope * x), 6) AS intercept FROM p JOIN m USING (g) GROUP BY g""")
def passing_bablok(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").cast("double").alias("x"), (F.col("n_nationkey") * 7 % 25).cast("double").alias("y"))
    return statistics.passing_bablok(pairs, ["g"])


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', count(*), round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', count(*), round(corr(l_extendedprice, l_tax), 6) FROM lineitem")
def corr_pearson(spark, sf_dir):
    return statistics.correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(x, y), 6) AS r FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)")
def corr_spearman(spark, sf_dir):
    return statistics.correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman")


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


_LABELLED = "(SELECT CAST(n_chars AS DOUBLE) AS t, quality AS p FROM labels JOIN documents USING (doc_id))"


@query(f"SELECT t AS threshold, round(tp / pn, 6) AS sensitivity, round(1 - fp / nn, 6) AS specificity, round(tp / pn - fp / nn, 6) AS youden FROM (SELECT t, sum(sum(p)) OVER (ORDER BY t DESC) AS tp, sum(sum(1 - p)) OVER (ORDER BY t DESC) AS fp, CAST(sum(sum(p)) OVER () AS DOUBLE) AS pn, CAST(sum(sum(1 - p)) OVER () AS DOUBLE) AS nn FROM {_LABELLED} GROUP BY t)")
def roc_curve(spark, sf_dir):
    return statistics.roc_curve(_labelled(spark, sf_dir), F.col("n_chars"), F.col("quality") == 1)


@query(f"SELECT CAST(sum(p) AS BIGINT) AS pos, CAST(sum(1 - p) AS BIGINT) AS neg, round((sum(CASE WHEN p = 1 THEN r END) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(1 - p)), 6) AS auc FROM (SELECT p, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS r FROM {_LABELLED})")
def roc_auc(spark, sf_dir):
    return statistics.roc_auc(_labelled(spark, sf_dir), F.col("n_chars"), F.col("quality") == 1)


@query(f"SELECT CAST(p AS VARCHAR) AS g, count(*) AS n, round(sum(r), 6) AS rank_sum, round(sum(r) - count(*) * (count(*) + 1) / 2.0, 6) AS u FROM (SELECT p, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS r FROM {_LABELLED}) GROUP BY p")
def mwu_u(spark, sf_dir):
    return statistics.rank_sums(_labelled(spark, sf_dir), F.col("quality"), F.col("n_chars"))


_SURVEY = """p AS (SELECT o_orderstatus AS h, o_custkey % 20 AS i, sum(1 + o_custkey % 4) AS w, sum((1 + o_custkey % 4) * o_totalprice) AS wy, count(*) AS n FROM orders GROUP BY 1, 2),
t AS (SELECT sum(w) AS ww, sum(wy) AS wwy, sum(n) AS n, count(*) AS psus, count(DISTINCT h) AS strata FROM p),
z AS (SELECT h, (wy - w * wwy / ww) / ww AS z FROM p, t),
v AS (SELECT sum(k * k / (k - 1) * v) AS var FROM (SELECT h, CAST(count(*) AS DOUBLE) AS k, var_pop(z) AS v FROM z GROUP BY h))"""


@query(f"WITH {_SURVEY} SELECT CAST(n AS BIGINT) AS n, round(wwy / ww, 6) AS mean, round(sqrt(var), 8) AS se, psus - strata AS df FROM t, v")
def survey_mean(spark, sf_dir):
    return statistics.survey_mean(orders(spark, sf_dir).df, F.col("o_totalprice"), 1 + F.col("o_custkey") % 4, F.col("o_orderstatus"), F.col("o_custkey") % 20)


@query("""WITH x AS (SELECT o_orderstatus AS h, o_custkey % 20 AS i, o_totalprice AS y, CASE WHEN o_custkey % 2 = 0 THEN 1 + o_custkey % 4 ELSE 0 END AS a, CASE WHEN o_custkey % 2 = 1 THEN 1 + o_custkey % 4 ELSE 0 END AS b FROM orders),
p AS (SELECT h, i, sum(a) AS a, sum(b) AS b, sum(a * y) AS ay, sum(b * y) AS by_ FROM x GROUP BY 1, 2),
t AS (SELECT sum(a) AS ta, sum(b) AS tb, sum(ay) / sum(a) AS ma, sum(by_) / sum(b) AS mb FROM p),
z AS (SELECT h, (ay - a * ma) / ta - (by_ - b * mb) / tb AS z FROM p, t)
SELECT round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS difference, round(sqrt((SELECT sum(k * k / (k - 1) * v) FROM (SELECT CAST(count(*) AS DOUBLE) AS k, var_pop(z) AS v FROM z GROUP BY h))), 8) AS se FROM t""")
def survey_contrast(spark, sf_dir):
    return statistics.survey_contrast(orders(spark, sf_dir).df, F.col("o_totalprice"), 1 + F.col("o_custkey") % 4, F.col("o_orderstatus"), F.col("o_custkey") % 20, F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 2 == 1)


@query(f"SELECT count(*) AS n, CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS missing, round(sum((1 + user_id % 3) * coalesce(value, 0)) / sum(1 + user_id % 3), 6) AS low, round(sum((1 + user_id % 3) * coalesce(value, 500)) / sum(1 + user_id % 3), 6) AS high FROM {_HOLES}")
def missingness_bounds(spark, sf_dir):
    return statistics.missingness_bounds(_holes(spark, sf_dir).df, F.col("value"), 1 + F.col("user_id") % 3, 0, 500)


# Reference intervals ------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.025), 6) AS nonparametric_low, round(quantile_cont(value, 0.975), 6) AS nonparametric_high, round(median(value), 6) AS median, round(avg(value) - 1.959963984540054 * stddev_samp(value), 6) AS parametric_low, round(avg(value) + 1.959963984540054 * stddev_samp(value), 6) AS parametric_high, CASE WHEN min(value) > 0 THEN round(exp(avg(ln(value)) FILTER (value > 0) - 1.959963984540054 * stddev_samp(ln(value)) FILTER (value > 0)), 6) END AS log_low, CASE WHEN min(value) > 0 THEN round(exp(avg(ln(value)) FILTER (value > 0) + 1.959963984540054 * stddev_samp(ln(value)) FILTER (value > 0)), 6) END AS log_high FROM (SELECT event_type, value + 1 AS value FROM events) GROUP BY event_type")
def ri_limits(spark, sf_dir):
    return intervals.limits(_ev(spark, sf_dir), ["event_type"], F.col("value") + 1)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT event_type, n, p, least(greatest(p * (n + 1), 1), n) AS h FROM (SELECT DISTINCT event_type, n FROM r), (SELECT unnest([0.025::DOUBLE, 0.975::DOUBLE]) AS p)),
v AS (SELECT q.event_type, q.n, p, a.value + (h - floor(h)) * (coalesce(b.value, a.value) - a.value) AS v FROM q JOIN r a ON a.event_type = q.event_type AND a.i = CAST(floor(h) AS BIGINT) LEFT JOIN r b ON b.event_type = q.event_type AND b.i = CAST(floor(h) AS BIGINT) + 1)
SELECT event_type, n, round(min(v), 6) AS low, round(max(v), 6) AS high FROM v GROUP BY 1, 2""")
def ri_type6(spark, sf_dir):
    return intervals.type6_limits(_ev(spark, sf_dir), ["event_type"], F.col("value"))


@query("SELECT event_type, n, round(med, 6) AS median, round(mad, 6) AS mad, round(med - 1.96 * 1.4826 * mad, 6) AS low, round(med + 1.96 * 1.4826 * mad, 6) AS high FROM (SELECT event_type, med, count(*) AS n, median(abs(value - med)) AS mad FROM events JOIN (SELECT event_type, median(value) AS med FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2)")
def ri_robust_mad(spark, sf_dir):
    return intervals.robust_mad(_ev(spark, sf_dir), ["event_type"], F.col("value"))


_HB = "(SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS g, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1, 2)"


@query(f"SELECT a.event_type, a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, round(abs(a.m - b.m) / sqrt(a.s ** 2 / a.n + b.s ** 2 / b.n), 6) AS z, round(3 * sqrt((a.n + b.n) / 2.0 / 120), 6) AS z_limit, round(greatest(a.s, b.s) / least(a.s, b.s), 6) AS sd_ratio, abs(a.m - b.m) / sqrt(a.s ** 2 / a.n + b.s ** 2 / b.n) > 3 * sqrt((a.n + b.n) / 2.0 / 120) OR greatest(a.s, b.s) / least(a.s, b.s) > 1.5 AS \"partition\" FROM {_HB} a JOIN {_HB} b ON a.event_type = b.event_type AND a.g < b.g")
def ri_harris_boyd(spark, sf_dir):
    return intervals.harris_boyd(_ev(spark, sf_dir), ["event_type"], F.col("user_id") % 3, F.col("value"))


@query("SELECT *, round(below / n, 6) AS below_share, round(above / n, 6) AS above_share, below / n BETWEEN 0.009 AND 0.041 AND above / n BETWEEN 0.009 AND 0.041 AS acceptable FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value < 2) AS below, count(*) FILTER (value > 300) AS above FROM events GROUP BY 1)")
def ep28_tails(spark, sf_dir):
    return intervals.tails(_ev(spark, sf_dir), ["event_type"], F.col("value"), 2, 300)


@query("""WITH g AS (SELECT user_id % 7 AS g, CAST(count(*) AS DOUBLE) AS n, sum(value) AS s, sum(value * value) AS ss FROM events GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(ss - s * s / n) AS w, sum(s * s / n) AS b, sum(n * n) AS n2 FROM g)
SELECT k, CAST(n AS BIGINT) AS n, round(sqrt(greatest(((b - s * s / n) / (k - 1) - w / (n - k)) / ((n - n2 / n) / (k - 1)), 0)) / sqrt(w / (n - k)), 6) AS sdr FROM t""")
def sdr(spark, sf_dir):
    return intervals.standard_deviation_ratio(_ev(spark, sf_dir), F.col("user_id") % 7, F.col("value"))


@query()
def ri_intervals(spark, sf_dir):
    return intervals.reference_intervals(_ev(spark, sf_dir), ["event_type"], F.col("value"), outliers="TUKEY")


@query()
def ri_bootstrap(spark, sf_dir):
    return intervals.reference_intervals(_ev(spark, sf_dir), ["event_type"], F.col("value"), method="NONPARAMETRIC", repetitions=200)



# Windows over time ----------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    return _ev(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (15 * k) MINUTE AS start FROM events, range(0, 4) r(k)) GROUP BY start")
def sliding_window(spark, sf_dir):
    return _ev(spark, sf_dir).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_window(spark, sf_dir):
    return _ev(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# Study and integration operators ---------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, source, CASE WHEN source = 'b' AND p_size > 30 THEN NULL ELSE CASE source WHEN 'a' THEN CAST(p_size AS DOUBLE) ELSE p_size * 10.0 END END AS res, CASE WHEN source = 'b' AND p_size > 30 THEN 'LEFT' ELSE 'EXACT' END AS res_kind, CASE source WHEN 'a' THEN 'SAME_UNIT' ELSE 'CONVERTED' END AS res_status FROM part, (SELECT unnest(['a', 'b']) AS source)")
def integrate_sources(spark, sf_dir):
    from .operators.integration import Target, integrate

    p = table(spark, sf_dir, "part")
    a = Dataset(p.select("p_partkey", F.col("p_size").cast("string").alias("v")))
    b = Dataset(p.select("p_partkey", F.when(F.col("p_size") > 30, F.concat(F.lit("<"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")).alias("w")))
    out = integrate({"a": a, "b": b}, [Target("res", "mg/L", {"a": {"column": "v", "unit": "mg/L"}, "b": {"column": "w", "unit": "mg/dL"}})], ["p_partkey"])
    return out.select("p_partkey", "source", F.round("res", 6).alias("res"), "res_kind", "res_status")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '<' ELSE '' END || CAST(p_size AS VARCHAR) || '00' AS out FROM part")
def unit_exact(spark, sf_dir):
    from .functions.units import convert

    cell = F.concat(F.when(F.col("p_size") % 4 == 0, "<").otherwise(""), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(convert(cell, "g/dL", "g/L"), F.lit("0")).alias("out"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'cancelled' WHEN o_orderkey % 4 = 1 THEN 'final' ELSE 'open' END AS word FROM orders")
def category_normalize(spark, sf_dir):
    from .operators.integration import normalise_words

    raw = F.element_at(F.array(F.lit("2"), F.lit(" FINAL "), F.lit("2"), F.lit("pending")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    df = orders(spark, sf_dir).df.select("o_orderkey", raw.alias("word"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise("y").alias("src"))
    return normalise_words(df, "word", {"final": ["done"], "open": ["pending"]}, {"x": {"2": "cancelled"}, "y": {"2": "open"}}, "src").select("o_orderkey", "word")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'STATUS_NOT_ACCEPTED' WHEN o_totalprice > 200000 THEN 'ABOVE' END AS reason FROM orders) GROUP BY reason")
def result_status(spark, sf_dir):
    from .operators.integration import result_status as status

    _, why = status(F.col("o_orderstatus"), ["f", "o"], [(F.col("o_totalprice") > 200000, "ABOVE"), (~F.col("o_orderstatus").isin("F", "O"), "STATUS_NOT_ACCEPTED")])
    return orders(spark, sf_dir).df.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT concat_ws(';', CASE WHEN o_orderstatus <> 'F' THEN 'METHOD_MISMATCH' END, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' OR o_orderdate >= TIMESTAMP '1997-01-01' THEN 'OUTSIDE_VALIDITY' END) AS why, count(*) AS n FROM orders GROUP BY 1")
def measurement_context(spark, sf_dir):
    from .operators.integration import measurement_context as context

    return orders(spark, sf_dir).df.groupBy(context({"method": (F.col("o_orderstatus"), "F")}, F.col("o_orderdate"), "1995-01-01", "1997-01-01").alias("why")).agg(F.count("*").alias("n"))


@query("SELECT g AS \"group\", count(*) AS rows, count(x) AS n, 0 AS missing, count(*) FILTER (sign <> '') AS censored, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, min(x) AS min, max(x) AS max, round(100 * stddev_samp(x) / abs(avg(x)), 6) AS cv_pct, round(exp(avg(ln(x))), 6) AS geo_mean, round(exp(stddev_samp(ln(x))), 6) AS geo_sd FROM (SELECT *, CASE WHEN sign = '' THEN num END AS x FROM " + _CMP + ", (SELECT unnest(['all', 'R']) AS g) WHERE g = 'all' OR l_returnflag = 'R') GROUP BY g")
def sample_summary(spark, sf_dir):
    from .operators.study import sample_summary as summary

    out = summary(bounded(spark, sf_dir), {"all": F.lit(True), "R": F.col("l_returnflag") == "R"}, "res")
    return out.withColumn("missing", F.col("missing").cast("int"))


@query("SELECT CAST(b.bin AS INT) AS bin, count(value) AS n FROM (SELECT unnest(range(0, 10)) AS bin) b LEFT JOIN (SELECT value, least(floor(value / 50), 9) AS bin FROM events WHERE value BETWEEN 0 AND 500) e ON e.bin = b.bin GROUP BY 1")
def planned_histogram(spark, sf_dir):
    from .operators.study import fixed_histogram

    return fixed_histogram(_ev(spark, sf_dir), F.col("value"), 0, 500, 10)


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value < 1 OR value > 400) AS outside, round(count(*) FILTER (value < 1 OR value > 400) / count(*), 6) AS share, CASE WHEN count(*) FILTER (value < 1 OR value > 400) / count(*) <= 0.1 THEN 'ACCEPT' ELSE 'REVIEW' END AS verdict FROM events GROUP BY event_type")
def ri_verification(spark, sf_dir):
    from .operators.study import share_outside

    e = _ev(spark, sf_dir)
    return share_outside(e, e.select("event_type").distinct().select("event_type", F.lit(1.0).alias("low"), F.lit(400.0).alias("high")), ["event_type"], F.col("value"))


_CENTRAL = "(SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS g, quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.975) AS b FROM events GROUP BY 1, 2)"


@query(f"SELECT x.event_type, x.g AS group_a, y.g AS group_b, round(greatest(least(x.b, y.b) - greatest(x.a, y.a), 0) / (greatest(x.b, y.b) - least(x.a, y.a)), 6) AS overlap FROM {_CENTRAL} x JOIN {_CENTRAL} y ON x.event_type = y.event_type AND x.g < y.g")
def ri_overlap(spark, sf_dir):
    from .operators.study import interval_overlap

    return interval_overlap(_ev(spark, sf_dir), ["event_type"], F.col("user_id") % 3, F.col("value"))


@query("SELECT group_a, group_b, n_a, n_b, round(w, 6) AS rank_sum, round((w - n_a * (n_a + n_b + 1) / 2.0) / sqrt(n_a::DOUBLE * n_b * (n_a + n_b + 1) / 12), 6) AS z FROM (SELECT '0' AS group_a, '1' AS group_b, count(*) FILTER (g = 0) AS n_a, count(*) FILTER (g = 1) AS n_b, sum(r) FILTER (g = 0) AS w FROM (SELECT user_id % 2 AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events))")
def wilcoxon_partition(spark, sf_dir):
    from .operators.study import wilcoxon_partition as wilcoxon

    return wilcoxon(_ev(spark, sf_dir), F.col("user_id") % 2, F.col("value"))


@query("WITH e AS (SELECT CAST(user_id % 4 AS VARCHAR) AS g, round(value) AS x FROM events), n AS (SELECT DISTINCT g FROM e), p AS (SELECT a.g AS group_a, b.g AS group_b FROM n a JOIN n b ON a.g < b.g), r AS (SELECT group_a, group_b, g, rank() OVER (PARTITION BY group_a, group_b ORDER BY x) + (count(*) OVER (PARTITION BY group_a, group_b, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY group_a, group_b, x) AS t FROM p JOIN e ON g = group_a OR g = group_b), s AS (SELECT group_a, group_b, count(*) FILTER (g = group_a)::DOUBLE AS na, count(*) FILTER (g = group_b)::DOUBLE AS nb, sum(r) FILTER (g = group_a)::DOUBLE AS w, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY ALL) SELECT group_a, group_b, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(w, 6) AS rank_sum, round(sign(w - na * (na + nb + 1) / 2) * greatest(abs(w - na * (na + nb + 1) / 2) - 0.5, 0) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 6) AS z FROM s")
def wilcoxon_pairs(spark, sf_dir):
    from .operators.study import wilcoxon_pairs as wilcoxon

    return wilcoxon(_ev(spark, sf_dir), F.col("user_id") % 4, F.round("value")).drop("p")  # DuckDB has no normal distribution


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'NO_VALUE' WHEN event_id % 5 = 0 THEN 'NO_SITE' ELSE 'INCLUDED' END AS reason FROM events) GROUP BY reason")
def input_audit(spark, sf_dir):
    from .operators.study import input_audit as audit

    return audit(_holes(spark, sf_dir).df, [("NO_VALUE", F.col("value").isNull()), ("NO_SITE", F.col("site").isNull())])


@query("SELECT event_type, site, count(*) AS n, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM (SELECT event_type, user_id % 3 AS site, value FROM events) GROUP BY ROLLUP (event_type, site)")
def ri_partition_sets(spark, sf_dir):
    from .operators.study import partition_sets

    return partition_sets(_ev(spark, sf_dir).withColumn("site", F.col("user_id") % 3), ["event_type", "site"], F.col("value"))


@query("SELECT event_type, count(value) AS n FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_samp(value) OVER (PARTITION BY event_type) AS s FROM events) WHERE abs(value - m) <= 2 * s GROUP BY event_type")
def gaussian_trim(spark, sf_dir):
    from .operators.study import gaussian_trim as trim

    return trim(_ev(spark, sf_dir), ["event_type"], F.col("value"), 2.0, 1).groupBy("event_type").agg(F.count("value").alias("n"))


@query("SELECT 'o_totalprice' AS \"column\", count(*) AS compared, count(*) FILTER (o_orderkey % 7 <> 0) AS equal, count(*) FILTER (o_orderkey % 7 = 0) AS unequal FROM orders")
def evaluate_outputs(spark, sf_dir):
    from .operators.integration import compare_outputs

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return compare_outputs(o, o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), "o_orderkey")


@query()
def ri_normality(spark, sf_dir):
    from .operators.study import normality

    return normality(_ev(spark, sf_dir), ["event_type"], F.col("value"))



@query()
def least_squares(spark, sf_dir):
    fit = statistics.least_squares(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], "l_suppkey")
    return spark.createDataFrame(fit.round(6))


@query()
def group_test(spark, sf_dir):
    got = statistics.group_test(_labelled(spark, sf_dir), F.col("quality"), F.col("n_chars"))
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in got.items()], "statistic string, value double")


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS w, CASE WHEN c_custkey % 6 = 0 THEN '<5.0' WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS v_cens FROM customer")
def survey_prepare(spark, sf_dir):
    from .operators.starting import prepare_survey

    c = table(spark, sf_dir, "customer")
    m = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(2.0).alias("w"), F.col("c_nationkey").alias("v"), F.when(F.col("c_custkey") % 6 == 0, "1").otherwise("0").alias("f"))
    return prepare_survey(c.select("c_custkey"), m, "c_custkey", "w", {"v": ("f", "1", 5.0)}).select("c_custkey", "w", "v_cens")


@query("SELECT source, 'sex' AS \"column\", 'SEX_CODE' AS issue, 'q' AS value, count(*) AS n FROM (SELECT o_orderstatus AS source FROM orders WHERE o_custkey % 3 = 1) GROUP BY source")
def init_review(spark, sf_dir):
    from .operators.starting import review

    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_custkey") % 3 == 1, "q").otherwise("M").alias("sex"))
    return review(Dataset(df, {"sex": ("SEX",)}), "o_orderstatus")


@query("SELECT o_orderkey, CASE o_custkey % 2 WHEN 0 THEN 'female' ELSE 'male' END AS sex, CAST(o_custkey % 90 AS VARCHAR) AS age FROM orders")
def init_options(spark, sf_dir):
    from .operators.starting import apply_options

    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2).cast("string").alias("sex"), F.concat((F.col("o_custkey") % 90).cast("string"), F.lit(" yr")).alias("age"))
    return apply_options(Dataset(df, {"sex": ("SEX",), "age": ("AGE",)}), {"SEX_CODES": {"0": "female", "1": "male"}, "AGE": "integer"}).df.select("o_orderkey", "sex", "age")


_LEVELS = """x AS (SELECT o_orderstatus AS item, CASE o_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS sex, CASE WHEN a < 1 THEN '<1' WHEN a >= 70 THEN '70+' ELSE CAST(greatest(a // 10 * 10, 1) AS VARCHAR) || '-' || CAST(a // 10 * 10 + 9 AS VARCHAR) END AS age_band, o_totalprice AS x FROM (SELECT *, o_custkey % 90 AS a FROM orders)),
g AS (SELECT item, 'ITEM' AS level, 'ALL' AS sex, 'ALL' AS age_band, x FROM x UNION ALL SELECT item, 'ITEM_SEX', sex, 'ALL', x FROM x UNION ALL SELECT item, 'ITEM_AGE', 'ALL', age_band, x FROM x UNION ALL SELECT item, 'ITEM_SEX_AGE', sex, age_band, x FROM x),
q AS (SELECT item, level, sex, age_band, count(*) AS n, quantile_cont(x, 0.025) AS lo, median(x) AS med, quantile_cont(x, 0.975) AS hi FROM g GROUP BY ALL),
m AS (SELECT item, level, sex, age_band, median(abs(x - med)) AS mad FROM g JOIN q USING (item, level, sex, age_band) GROUP BY ALL)"""


@query(f"WITH {_LEVELS} SELECT item, level, sex, age_band, n, CASE WHEN n < 40 THEN 'none' WHEN n < 120 THEN 'robust' ELSE 'nonparametric' END AS method, round(med, 6) AS median, CASE WHEN n < 40 THEN NULL WHEN n < 120 THEN round(med - 1.96 * 1.4826 * mad, 6) ELSE round(lo, 6) END AS low, CASE WHEN n < 40 THEN NULL WHEN n < 120 THEN round(med + 1.96 * 1.4826 * mad, 6) ELSE round(hi, 6) END AS high FROM q JOIN m USING (item, level, sex, age_band)")
def ri_levels(spark, sf_dir):
    from .plans.analyses import reference_levels

    return reference_levels(orders(spark, sf_dir).df, F.col("o_orderstatus"), V.sex(F.expr(SEX)), F.expr(_AGE), F.col("o_totalprice"))


from . import catalog_models, catalog_orders, catalog_studies  # noqa: E402, F401  (they register their queries)
