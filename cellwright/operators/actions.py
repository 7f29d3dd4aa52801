"""The declarative verbs.  Each takes a dataset and a config and returns a lazy dataset."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tags as T
from ..dataset import ROW, Dataset, as_list, ci
from ..functions import values as V
from ..functions.conditions import combine, condition
from ..functions.derive import compile_formula
from .statistics import carry

ACTIONS: dict[str, Callable[[Dataset, dict], Dataset]] = {}
#: Other names of actions.
ALIASES = {"ROW_INCLUDE": "ROW.INCLUDE", "ROW.EXTRACT": "ROW.INCLUDE", "ROW_EXCLUDE": "ROW.EXCLUDE", "COLUMN_INCLUDE": "COLUMN.INCLUDE", "COLUMN_EXCLUDE": "COLUMN.EXCLUDE", "COLUMN_SPLIT": "COLUMN.SPLIT", "SPLIT": "COLUMN.SPLIT", "COLUMN_CONCAT": "COLUMN.CONCAT", "CONCAT": "COLUMN.CONCAT", "UNIT_CONVERT": "UNIT.CONVERT", "UNIT.CONVERSION": "UNIT.CONVERT", "RESULT_NORMALIZE": "UNIT.CONVERT"}


def action(name: str):
    def register(f):
        ACTIONS[name] = f
        return f

    return register


def action_type(name: Any) -> str:
    key = re.sub(r"[- ]", "_", str(name or "").strip().upper())
    return ALIASES.get(key, key)


def run_action(ds: Dataset, config: dict) -> Dataset:
    kind = action_type(ci(config, "TYPE"))
    if kind not in ACTIONS:
        raise ValueError(f"unknown action {kind!r}")
    return ACTIONS[kind](ds, config)


def _flag(v: Any, default: bool = False) -> bool:
    return default if v is None else v if isinstance(v, bool) else str(v).strip().lower() in ("1", "true", "yes", "y", "on")


def _names(ds: Dataset, config: dict, *keys: str) -> list[str]:
    return ds.resolve_all(*as_list(ci(config, *keys, default=[]))) if as_list(ci(config, *keys, default=[])) else []


def row_order() -> Column:
    return F.col(ROW)


def row_mask(ds: Dataset, config: dict) -> Column:
    def one(c: dict) -> Column:
        column = ci(c, "COLUMN") or f"tag:{ci(c, 'TAG')}"
        value = ci(c, "VALUE")
        many = ci(c, "VALUES")
        if many is None and isinstance(value, list):
            value, many = None, value
        return condition(str(ci(c, "OP", default="eq")), ds.col(column), value, many, _flag(ci(c, "CASE_SENSITIVE")))

    tests = ci(config, "CONDITIONS")
    return combine([one(c) for c in tests] if tests else [one(config)], str(ci(config, "LOGIC", "HOW", default="AND")))


@action("ROW.INCLUDE")
def row_include(ds: Dataset, config: dict) -> Dataset:
    return ds.with_df(ds.df.where(row_mask(ds, config)))


@action("ROW.EXCLUDE")
def row_exclude(ds: Dataset, config: dict) -> Dataset:
    return ds.with_df(ds.df.where(~row_mask(ds, config)))


def _chosen(ds: Dataset, config: dict) -> list[str]:
    names = ds.resolve_all(*as_list(ci(config, "COLUMNS", "COLUMN", default=[]))) if ci(config, "COLUMNS", "COLUMN") else []
    by_tag = ds.find(any_of=as_list(ci(config, "TAGS", "TAG"))) if ci(config, "TAGS", "TAG") else []
    return [c for c in ds.columns if c in names or c in by_tag]


def _projected(ds: Dataset, keep: list[str]) -> Dataset:
    hidden = [ROW] if ROW in ds.df.columns else []
    return ds.with_df(ds.df.select(*[F.col(f"`{c}`") for c in keep + hidden]))


@action("COLUMN.INCLUDE")
def column_include(ds: Dataset, config: dict) -> Dataset:
    return _projected(ds, _chosen(ds, config))


@action("COLUMN.EXCLUDE")
def column_exclude(ds: Dataset, config: dict) -> Dataset:
    out = set(_chosen(ds, config))
    return _projected(ds, [c for c in ds.columns if c not in out])


@action("TAG_COLUMNS")
def tag_columns(ds: Dataset, config: dict) -> Dataset:
    specs = ci(config, "COLUMN_TAGS") or {ci(s, "NAME", "COLUMN"): ci(s, "TAGS", default=[]) for s in as_list(ci(config, "COLUMNS", default=[])) if isinstance(s, dict)}
    more = {ds.resolve(str(k)): T.distinct([*ds.tags.get(ds.resolve(str(k)), ()), *as_list(v)]) for k, v in specs.items()}
    return ds.with_df(ds.df, **more)


def _tags(config: dict, *default: str) -> tuple[str, ...]:
    return T.distinct(as_list(ci(config, "TAGS", default=[]))) or default


@action("ADD_COLUMN")
def add_column(ds: Dataset, config: dict) -> Dataset:
    name = str(ci(config, "NAME", "COLUMN"))
    if ci(config, "FROM") is not None:
        new = ds.col(str(ci(config, "FROM")))
    elif ci(config, "TEMPLATE") is not None:
        new = template(ds, str(ci(config, "TEMPLATE")))
    else:
        new = F.lit(str(ci(config, "VALUE", default="")))
    return ds.with_df(ds.df.withColumn(name, new), **{name: _tags(config)})


def template(ds: Dataset, pattern: str) -> Column:
    """``{column}`` and ``{tag:X}`` are replaced by the cell's text, absent cells by ''."""
    parts = [V.text(ds.col(p[1:-1])) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{[^{}]+\})", pattern) if p]
    return F.concat(*parts) if parts else F.lit("")


@action("DERIVE")
def derive(ds: Dataset, config: dict) -> Dataset:
    name, digits = str(ci(config, "NAME", "COLUMN")), ci(config, "ROUND")
    new = compile_formula(str(ci(config, "EXPR", "EXPRESSION")), ds.col, None if digits is None else int(digits))
    return ds.with_df(ds.df.withColumn(name, new), **{name: _tags(config, "NUM")})


@action("DATE_DERIVE")
def date_derive(ds: Dataset, config: dict) -> Dataset:
    name, kind = str(ci(config, "NAME", "COLUMN")), str(ci(config, "KIND", "OP")).lower()
    as_time = lambda s: _instant(ds, s)
    if kind == "age":
        at = ci(config, "AS_OF")
        try:
            when = as_time(str(at))
        except KeyError:
            when = V.temporal(F.lit(str(at)))
        new, default = V.completed_years(as_time(ci(config, "FROM", "BIRTH")), when).cast("bigint"), "AGE"
    elif kind.startswith("diff"):
        unit = kind.split("_")[1] if "_" in kind else str(ci(config, "UNIT", default="minutes")).lower()
        new, default = V.time_difference(as_time(ci(config, "START", "FROM")), as_time(ci(config, "END", "TO")), unit, int(ci(config, "ROUND", default=2))), "NUM"
    else:
        new, default = V.date_part(as_time(ci(config, "FROM")), str(ci(config, "PART", default="year")).lower()), "NUM"
    return ds.with_df(ds.df.withColumn(name, new), **{name: _tags(config, default)})


def _instant(ds: Dataset, selector: Any) -> Column:
    name = ds.resolve(str(selector))
    kind = dict(ds.df.dtypes)[name]
    return F.col(f"`{name}`") if kind.startswith(("timestamp", "date")) else V.temporal(F.col(f"`{name}`"))


@action("IMPUTE")
def impute(ds: Dataset, config: dict) -> Dataset:
    """Only blank cells change; means and medians are over the group's strict numbers."""
    method, df = str(ci(config, "METHOD", default="median")).lower(), ds.df
    by = _names(ds, config, "BY", "GROUP_BY")
    for name in _chosen(ds, config):
        c = F.col(f"`{name}`")
        kind = dict(df.dtypes)[name]
        blank = c.isNull() if kind != "string" else (V.strip(V.text(c)) == "") | c.isNull()
        seen = F.when(~blank, c)
        if method in ("ffill", "bfill"):
            df = carry(df, seen, ROW, "__fill", by, method == "bfill")
            fill = F.col("__fill")
        elif method == "constant":
            fill = F.lit(ci(config, "VALUE", default="")).cast(kind)
        else:
            x = V.strict_number(c) if kind == "string" else c.cast("double")
            how = {"mean": F.avg(x), "median": F.percentile(x, 0.5), "mode": F.mode(seen, True)}[method]
            # One row per group, joined back: a hot group is pre-aggregated and no window sorts it.
            stats = df.groupBy(*[F.col(f"`{b}`") for b in by]).agg(how.alias("__fill"))
            df = _join_stats(df, stats, by)
            fill = F.col("__fill").cast(kind)
        if by:
            fill = F.when(V.all_of([F.col(f"`{b}`").isNotNull() for b in by]), fill)
        df = df.withColumn(name, F.when(blank, fill).otherwise(c)).drop("__fill")
    return ds.with_df(df)


def _join_stats(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Group statistics back to rows; without groups there is one row of them."""
    if not by:
        return df.crossJoin(F.broadcast(stats))  # one row
    keys = [f"__k{i}" for i in range(len(by))]
    right = stats.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], *[c for c in stats.columns if c not in by])
    return df.join(right, V.all_of([df[f"`{b}`"].eqNullSafe(right[k]) for b, k in zip(by, keys, strict=True)]), "left").drop(*keys)


@action("OUTLIER_FILTER")
def outlier_filter(ds: Dataset, config: dict) -> Dataset:
    """Drop rows outside Tukey or SD fences; rows without a number stay."""
    name = ds.resolve(str(ci(config, "COLUMN") or f"tag:{ci(config, 'TAG')}"))
    method = str(ci(config, "METHOD", default="iqr")).lower()
    k = float(ci(config, "FACTOR", default=1.5 if method == "iqr" else 3.0))
    by = _names(ds, config, "BY", "GROUP_BY")
    c = F.col(f"`{name}`")
    x = V.strict_number(c) if dict(ds.df.dtypes)[name] == "string" else c.cast("double")
    groups = ds.df.groupBy(*[F.col(f"`{b}`") for b in by])
    if method == "iqr":
        s = groups.agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("__q")).select("*", (F.col("__q")[0] - k * (F.col("__q")[1] - F.col("__q")[0])).alias("__lo"), (F.col("__q")[1] + k * (F.col("__q")[1] - F.col("__q")[0])).alias("__hi")).drop("__q")
    else:
        s = groups.agg((F.avg(x) - k * F.stddev_samp(x)).alias("__lo"), (F.avg(x) + k * F.stddev_samp(x)).alias("__hi"))
    held = _join_stats(ds.df, s, by)
    return ds.with_df(held.where(F.coalesce(x.between(F.col("__lo"), F.col("__hi")), F.lit(True))).drop("__lo", "__hi"))


@action("RECODE")
def recode(ds: Dataset, config: dict) -> Dataset:
    name = ds.resolve(str(ci(config, "COLUMN", "SOURCE")))
    c, default = F.col(f"`{name}`"), ci(config, "DEFAULT")
    new = None
    for k, v in ci(config, "MAP", "MAPPING").items():
        hit = V.text(c) == str(k)
        new = F.when(hit, str(v)) if new is None else new.when(hit, str(v))
    out = str(ci(config, "NAME", default="") or name)
    return ds.with_df(ds.df.withColumn(out, new.otherwise(c if default is None else F.lit(str(default)))), **{out: _tags(config, *ds.tags.get(name, ()))})


@action("ROUND")
def round_columns(ds: Dataset, config: dict) -> Dataset:
    """Fixed-decimal text; cells without a number stay."""
    n, df = int(ci(config, "DECIMALS", "ROUND", default=0)), ds.df
    for name in _chosen(ds, config):
        c = F.col(f"`{name}`").cast("string")
        df = df.withColumn(name, F.coalesce(F.format_string(f"%.{n}f", V.round_half_even(V.strict_number(c), n)), c))
    return ds.with_df(df)


@action("BIN")
def bin_column(ds: Dataset, config: dict) -> Dataset:
    name = ds.resolve(str(ci(config, "COLUMN", "SOURCE")))
    c = F.col(f"`{name}`")
    x = V.strict_number(c) if dict(ds.df.dtypes)[name] == "string" else c.cast("double")
    right, edges, width, labels = _flag(ci(config, "RIGHT"), True), ci(config, "BINS", "EDGES"), ci(config, "WIDTH"), ci(config, "LABELS")
    out, df = str(ci(config, "NAME", default="") or f"{name}_bin"), ds.df
    if edges is not None:
        code = None
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            inside = ((x > lo) | ((x == lo) & F.lit(i == 0))) & (x <= hi) if right else (x >= lo) & ((x < hi) | ((x == hi) & F.lit(i == len(edges) - 2)))
            tag = F.lit(str(labels[i] if labels else i))
            code = F.when(inside, tag) if code is None else code.when(inside, tag)
    else:
        w = float(width)
        df = df.crossJoin(F.broadcast(df.agg(F.min(x).alias("__lo"))))  # one row
        at = (x - F.col("__lo")) / w
        code = F.greatest(F.ceil(at) - 1 if right else F.floor(at), F.lit(0)).cast("bigint").cast("string")
    return ds.with_df(df.withColumn(out, code).drop("__lo"), **{out: _tags(config, "CATEGORY")})


#: Analyte, from, to, factor.
FACTORS = [("GLU", "mmol/l", "mg/dl", 18.0182), ("GLUCOSE", "mmol/l", "mg/dl", 18.0182), ("CREA", "umol/l", "mg/dl", 1 / 88.4), ("CREATININE", "umol/l", "mg/dl", 1 / 88.4)]
_UNIT_VALUE = r"^\s*(<=|>=|<|>|=)?\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))\s*(.*?)\s*$"


def six_digits(x: Column) -> Column:
    """Six significant digits in plain notation, trailing zeros removed."""
    exponent = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), 5 - exponent)
    rounded = F.when(x == 0, 0.0).otherwise(F.rint(x * scale) / scale)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.12f", rounded), r"0+$", ""), r"\.$", "")


@action("UNIT.CONVERT")
def unit_convert(ds: Dataset, config: dict) -> Dataset:
    name = ds.resolve(str(ci(config, "SOURCE", "COLUMN", "VALUE_COLUMN")))
    t = V.text(F.col(f"`{name}`"))
    part = lambda g: F.regexp_extract(t, _UNIT_VALUE, g)
    unit_col, test_col = ci(config, "UNIT_COLUMN"), ci(config, "TEST_COLUMN")
    unit = F.when(part(3) != "", part(3)).otherwise(V.strip(V.text(ds.col(unit_col))) if unit_col else F.lit(""))
    test = F.upper(V.strip(V.text(ds.col(test_col)))) if test_col else F.lit("")
    target = F.lit(str(ci(config, "TARGET_UNIT", default="")))
    for k, v in (ci(config, "TARGET_UNIT_BY_TEST", default={}) or {}).items():
        target = F.when(test == str(k).upper(), str(v)).otherwise(target)
    table = [*((str(ci(c, "TEST", default="*")).upper(), str(ci(c, "FROM")).lower(), str(ci(c, "TO")).lower(), float(ci(c, "FACTOR"))) for c in as_list(ci(config, "CONVERSIONS", "CONVERSION_FACTORS", default=[]))), *FACTORS]
    factor = None
    for wild in (False, True):
        for a, f, to, x in table:
            if (a == "*") == wild:
                hit = (F.lit(True) if wild else test == a) & (F.lower(unit) == f) & (F.lower(target) == to)
                factor = F.when(hit, x) if factor is None else factor.when(hit, x)
    number = part(2).try_cast("double")
    status = F.when(number.isNull(), "PARSE_ERROR").when(unit == "", "UNIT_MISSING").when(target == "", "TARGET_UNIT_MISSING").when(F.lower(unit) == F.lower(target), "SAME_UNIT").when(factor.isNull(), "CONVERSION_MISSING").otherwise("CONVERTED")
    digits = ci(config, "DECIMALS")
    spelled = six_digits(number * factor) if digits is None else F.format_string(f"%.{int(digits)}f", V.round_half_even(number * factor, int(digits)))
    value = F.when(status == "CONVERTED", F.concat(part(1), spelled)).when(status == "SAME_UNIT", F.concat(part(1), part(2))).otherwise(t)
    out = {str(ci(config, "OUTPUT_VALUE", "VALUE_OUTPUT", default=f"{name}_converted")): value, str(ci(config, "OUTPUT_STATUS", default="conversion_status")): status}
    if ci(config, "OUTPUT_UNIT", "UNIT_OUTPUT"):
        out[str(ci(config, "OUTPUT_UNIT", "UNIT_OUTPUT"))] = F.when(status.isin("CONVERTED", "SAME_UNIT"), target).otherwise(unit)
    return ds.with_df(ds.df.withColumns(out))


@action("COLUMN.SPLIT")
def column_split(ds: Dataset, config: dict) -> Dataset:
    name = ds.resolve(str(ci(config, "COLUMN", "SOURCE")))
    into, sep = [str(x) for x in as_list(ci(config, "INTO", "COLUMNS"))], str(ci(config, "SEP", "DELIMITER"))
    pieces = F.split(F.col(f"`{name}`"), sep if _flag(ci(config, "REGEX")) else re.escape(sep), len(into))
    cells = [F.get(pieces, F.lit(i)) for i in range(len(into))]
    if _flag(ci(config, "TRIM"), True):
        cells = [V.strip(c) for c in cells]
    keep = [] if _flag(ci(config, "DROP_SOURCE")) else [name]
    order = [x for c in ds.df.columns for x in ((keep + into) if c == name else [c])]
    df = ds.df.withColumns(dict(zip(into, cells, strict=True))).select(*[F.col(f"`{c}`") for c in dict.fromkeys(order)])
    return ds.with_df(df, **{i: _tags(config) for i in into})


@action("COLUMN.CONCAT")
def column_concat(ds: Dataset, config: dict) -> Dataset:
    names, out = _names(ds, config, "COLUMNS"), str(ci(config, "OUTPUT", "NAME"))
    cells = [V.text(F.col(f"`{c}`")) for c in names]
    if _flag(ci(config, "SKIP_EMPTY")):
        cells = [F.nullif(c, F.lit("")) for c in cells]
    return ds.with_df(ds.df.withColumn(out, F.concat_ws(str(ci(config, "SEP", "DELIMITER", default="")), *cells)), **{out: _tags(config)})


@action("DEDUP")
def dedup(ds: Dataset, config: dict) -> Dataset:
    """First, last or no row of each set of equal keys, in row order.

    Whole-row ``first`` is a plain distinct aggregate; keyed ones keep the row with the smallest or
    largest row number by a map-side combined aggregate, so that a hot key costs one row per task.
    """
    keys = _names(ds, config, "COLUMNS", "SUBSET", "KEYS", "BY") or ds.columns
    keep = str(ci(config, "KEEP", default="first")).lower() or "first"
    rest = [c for c in ds.df.columns if c not in keys]
    pack = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(1)
    order = F.col(ROW) if ROW in ds.df.columns else F.lit(0)
    g = ds.df.groupBy(*[F.col(f"`{c}`") for c in keys])
    best = g.agg((F.min_by if keep != "last" else F.max_by)(pack, order).alias("__r"), F.count("*").alias("__n"))
    if keep in ("none", "false"):
        best = best.where("__n = 1")
    return ds.with_df(best.select(*[F.col(f"`{c}`") if c in keys else F.col("__r")[c].alias(c) for c in ds.df.columns]))


@action("SORT")
def sort(ds: Dataset, config: dict) -> Dataset:
    """Nulls last in both directions; the row number, where there is one, makes the sort stable."""
    by, up = _names(ds, config, "BY", "COLUMNS"), ci(config, "ASCENDING", default=True)
    ups = up if isinstance(up, list) else [up] * len(by)
    keys = []
    for name, asc in zip(by, ups, strict=True):
        c = V.strict_number(F.col(f"`{name}`")) if _flag(ci(config, "NUMERIC")) else F.col(f"`{name}`")
        keys.append(c.asc_nulls_last() if _flag(asc, True) else c.desc_nulls_last())
    return ds.with_df(ds.df.orderBy(*keys, *([F.col(ROW)] if ROW in ds.df.columns else [])))


@action("PIVOT_LONGER")
def pivot_longer(ds: Dataset, config: dict) -> Dataset:
    cols = _names(ds, config, "COLS", "VALUE_VARS", "COLUMNS")
    ids = _names(ds, config, "ID_COLS", "ID_VARS", "KEYS") or [c for c in ds.columns if c not in cols]
    to, values = str(ci(config, "NAMES_TO", "VAR_NAME", default="variable")), str(ci(config, "VALUES_TO", "VALUE_NAME", default="value"))
    hidden = [ROW] if ROW in ds.df.columns else []
    out = ds.df.unpivot([F.col(f"`{c}`") for c in ids + hidden], [F.col(f"`{c}`") for c in cols], to, values)
    return ds.with_df(out, **{to: T.distinct(as_list(ci(config, "NAMES_TAGS", "VAR_TAGS", default=["CATEGORY"]))), values: T.distinct(as_list(ci(config, "VALUES_TAGS", "VALUE_TAGS", default=[])))})


@action("PIVOT_WIDER")
def pivot_wider(ds: Dataset, config: dict) -> Dataset:
    """Rows with null ids are dropped.  ``NAMES`` may list the new columns, which saves a pass over the data."""
    ids = _names(ds, config, "ID_COLS", "INDEX", "KEY")
    name, value = ds.resolve(str(ci(config, "NAMES_FROM", "COLUMNS", "BY"))), ds.resolve(str(ci(config, "VALUES_FROM", "VALUES", "VALUE")))
    how = str(ci(config, "AGG", default="first")).lower() or "first"
    v = F.col(f"`{value}`")
    x = V.strict_number(v) if dict(ds.df.dtypes)[value] == "string" else v
    order = F.when(v.isNotNull(), F.col(ROW) if ROW in ds.df.columns else F.lit(0))
    agg = {"first": F.min_by(v, order), "last": F.max_by(v, order), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "sum": F.sum(x)}[how]
    kept = ds.df.where(V.all_of([F.col(f"`{i}`").isNotNull() for i in ids]) & F.col(f"`{name}`").isNotNull())
    listed = as_list(ci(config, "NAMES")) or None
    out = ds.with_df(kept.groupBy(*[F.col(f"`{i}`") for i in ids]).pivot(name, listed).agg(agg))
    return with_pivot_context(ds, out, name, ids) if _flag(ci(config, "CONTEXT")) else out


#: Tags whose value a wide column keeps if all its rows agree on it.
CONTEXT_TAGS = ("UNIT", "REF_LOW", "REF_HIGH")


def pivot_context(ds: Dataset, name: str) -> DataFrame:
    """name, tag, value for each value of the column ``name`` and each context column with one text in all its filled rows."""
    found = {t: c for t in CONTEXT_TAGS for c in ds.find(any_of=[t])[:1]}
    if not found:
        return ds.df.select(F.col(f"`{name}`").cast("string").alias("name"), F.lit("").alias("tag"), F.lit("").alias("value")).limit(0)
    cell = lambda c: F.nullif(V.text(F.col(f"`{c}`")), F.lit(""))
    ends = ds.df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").cast("string").alias("name")).agg(*[F.struct(F.min(cell(c)).alias("a"), F.max(cell(c)).alias("b")).alias(t) for t, c in found.items()])
    rows = F.array_compact(F.array(*[F.when(F.col(t)["a"] == F.col(t)["b"], F.struct(F.lit(t).alias("tag"), F.col(t)["a"].alias("value"))) for t in found]))
    return ends.select("name", F.explode(rows).alias("x")).select("name", "x.*")


def with_pivot_context(ds: Dataset, wide: Dataset, name: str, ids: list[str]) -> Dataset:
    """The context of each new column under PIVOT_CONTEXT of its controls: at most three values a column reach the driver."""
    spec = {c: dict(v) for c, v in (ci(wide.meta, "COLUMN", default={}) or {}).items()}
    for r in pivot_context(ds, name).collect():
        if r.name in wide.columns and r.name not in ids:
            spec.setdefault(r.name, {}).setdefault("PIVOT_CONTEXT", {})[r.tag] = r.value
    return replace(wide, meta={**{k: v for k, v in wide.meta.items() if k.upper() != "COLUMN"}, "COLUMN": spec})


@action("JOIN")
def join(ds: Dataset, config: dict, right: Dataset | None = None) -> Dataset:
    """Equi-join in which null keys match each other.  ``RIGHT`` is a dataset, or one given by the caller."""
    other = right or ci(config, "RIGHT", "WITH")
    if not isinstance(other, Dataset):
        from ..sources.tables import read_any

        other = read_any(ds.df.sparkSession, str(other))
    return join_datasets(
        ds, other, [str(x) for x in as_list(ci(config, "LEFT_ON") or ci(config, "ON", "KEY"))], [str(x) for x in as_list(ci(config, "RIGHT_ON") or ci(config, "ON", "KEY"))], str(ci(config, "HOW", default="left")).lower(), as_list(ci(config, "SELECT", default=[])), str(ci(config, "SUFFIX", default="_right")), ci(config, "VALIDATE"), str(ci(config, "MISSING_KEYS", default="ALLOW")).upper() == "ERROR", _flag(ci(config, "REQUIRE_RIGHT_MATCH"))
    )


def join_datasets(ds: Dataset, other: Dataset, left_on: list[str], right_on: list[str], how: str = "left", select: list[str] = (), suffix: str = "_right", validate: str | None = None, refuse_missing: bool = False, require_right: bool = False) -> Dataset:
    if how not in ("left", "right", "inner", "outer"):
        raise ValueError(f"unknown join {how}")
    lk, rk = [ds.resolve(k) for k in left_on], [other.resolve(k) for k in right_on]
    wanted = other.resolve_all(*select) if select else other.columns
    carried = [c for c in wanted if c not in rk]
    named = {c: c + suffix if c in ds.columns else c for c in carried}
    keys = [f"__rk{i}" for i in range(len(rk))]
    r = other.df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rk, keys, strict=True)], *[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    if refuse_missing:
        for frame, names in ((ds.df, lk), (r, keys)):
            if not frame.where(V.any_of([V.text(F.col(f"`{k}`")) == "" for k in names])).isEmpty():
                raise ValueError("join keys are missing")
    if validate:
        left_one, right_one = {"1:1": (1, 1), "one_to_one": (1, 1), "1:m": (1, 0), "one_to_many": (1, 0), "m:1": (0, 1), "many_to_one": (0, 1), "m:m": (0, 0), "many_to_many": (0, 0)}[str(validate).lower()]
        for must, frame, names in ((left_one, ds.df, lk), (right_one, r, keys)):
            if must and not frame.groupBy(*[F.col(f"`{k}`") for k in names]).count().where("count > 1").isEmpty():
                raise ValueError(f"join is not {validate}")
    on = V.all_of([ds.df[f"`{a}`"].eqNullSafe(r[b]) for a, b in zip(lk, keys, strict=True)])
    if require_right and not r.join(ds.df, on, "left_anti").isEmpty():
        raise ValueError("right rows without a match")
    j = ds.df.join(r, on, {"outer": "full_outer"}.get(how, how))
    if how in ("right", "outer"):
        both = dict(zip(lk, keys, strict=True))
        j = j.select(*[F.coalesce(ds.df[f"`{c}`"], r[both[c]]).alias(c) if c in both else ds.df[f"`{c}`"] for c in ds.df.columns], *[r[f"`{n}`"] for n in named.values()])
    else:
        j = j.drop(*keys)
    return ds.with_df(j, **{n: other.tags.get(c, ()) for c, n in named.items()})


def unmatched(ds: Dataset, other: Dataset, left_on: list[str], right_on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of each side whose key the other side lacks."""
    on = V.all_of([ds.df[f"`{ds.resolve(a)}`"].eqNullSafe(other.df[f"`{other.resolve(b)}`"]) for a, b in zip(left_on, right_on, strict=True)])
    return ds.df.join(other.df, on, "left_anti"), other.df.join(ds.df, on, "left_anti")
