"""Starting points: roles and presets, reviews of a new table, options applied once, survey preparation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tags as T
from ..dataset import Dataset, as_list, ci
from ..functions import values as V

#: Clinical roles, the tags that mark them, and words in names that suggest them.
ROLES = {
    "patient": (["PATIENT_ID", "ID(patient)"], r"patient|mrn|환자"),
    "sample": (["SAMPLE_ID", "SPECIMEN_ID"], r"sample|specimen|검체"),
    "test": (["ITEM", "TESTNAME"], r"test|item|analyte|검사"),
    "result": (["RESULT"], r"result|value|결과"),
    "unit": (["UNIT"], r"unit|단위"),
    "sex": (["SEX"], r"sex|gender|성별"),
    "age": (["AGE"], r"^age|나이|연령"),
    "instrument": (["INSTRUMENT"], r"instrument|analyzer|장비"),
    "collected": (["SPECIMEN_COLLECTED_AT", "COLLECTION_AT"], r"collect|채혈"),
    "received": (["LAB_RECEIVED_AT", "RECEIVED_AT"], r"receiv|접수"),
    "reported": (["FINAL_REPORTED_AT", "RESULT_TIME", "REPORT_DATE"], r"report|resulted|보고"),
}


def bind_roles(ds: Dataset, given: dict[str, str] | None = None) -> dict[str, str]:
    """Role -> column: by what is given, by tag, else by a name that one role alone suggests."""
    out = {r: ds.resolve(c) for r, c in (given or {}).items()}
    for role, (tags, words) in ROLES.items():
        if role in out:
            continue
        hits = ds.find(any_of=tags) or [c for c in ds.columns if re.search(words, c.lower()) and c not in out.values()]
        if len(hits) == 1:
            out[role] = hits[0]
    return out


def apply_preset(ds: Dataset, given: dict[str, str] | None = None) -> Dataset:
    """Tags of the bound roles, and a work list that fits them."""
    roles = bind_roles(ds, given)
    tags = {c: T.distinct([*ds.tags.get(c, ()), ROLES[r][0][0]]) for r, c in roles.items()}
    works = {"DEFAULT": ["VALIDATE", "DESCRIBE", *(["EDA"] if {"test", "result"} <= set(roles) else [])]}
    out = ds.with_df(ds.df, **tags)
    return type(ds)(out.df, out.tags, {**ds.meta, "WORKS": {**(ci(ds.meta, "WORKS", default={}) or {}), **works}, "ROLES": roles}, ds.schema, ds.job, ds.log)


def place_tags(ds: Dataset, mode: str = "meta") -> Dataset:
    """Tags in the controls under COLUMN, or in the headers alone."""
    spec = {c: dict(v) for c, v in (ci(ds.meta, "COLUMN", default={}) or {}).items()}
    for c in ds.columns:
        spec.setdefault(c, {}).pop("TAGS", None)
        if mode == "meta" and ds.tags.get(c):
            spec[c]["TAGS"] = list(ds.tags[c])
    meta = {**{k: v for k, v in ds.meta.items() if k.upper() != "COLUMN"}, "COLUMN": {c: v for c, v in spec.items() if v}}
    return type(ds)(ds.df, ds.tags if mode == "header" else {}, meta, ds.schema, ds.job, ds.log)


def review(ds: Dataset, source: str | None = None) -> DataFrame:
    """What a person should decide before analysis: column, issue, value, rows, by source where there is one."""
    src = F.col(f"`{source}`").cast("string") if source else F.lit("")
    found = []
    for c in ds.columns:
        cell, have = F.col(f"`{c}`").cast("string"), ds.effective(c)
        full = V.state(cell) == "VALUE"
        tests: list[tuple[Column, str]] = [(V.state(cell).isin("WS", "EMPTY"), "BLANK")]
        if "SEX" in have:
            tests.append((full & V.sex(cell).isNull(), "SEX_CODE"))
        if "AGE" in have:
            tests.append((full & (V.age_unit(cell) != "a"), "AGE_UNIT"))
            tests.append((full & V.age_years(cell).isNull(), "AGE"))
        if "NUM" in have:
            tests.append((full & V.comparator_sign(cell).isin("<", "<=", ">", ">=", "="), "COMPARATOR"))
        issue = None
        for bad, name in tests[::-1]:
            issue = F.when(bad, name) if issue is None else issue.when(bad, name)
        found.append(F.when(issue.isNotNull(), F.struct(F.lit(c).alias("column"), issue.alias("issue"), cell.alias("value"))))
    rows = ds.df.select(src.alias("source"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("source", "i.*")
    return rows.groupBy("source", "column", "issue", "value").agg(F.count("*").alias("n"))


def apply_options(ds: Dataset, options: dict) -> Dataset:
    """SEX: canonical words; AGE: years, whole years or bands; UNIT: scale and offset.  Raw columns stay as ``<name>_raw``."""
    df = ds.df
    for c in ds.columns:
        cell, have = F.col(f"`{c}`").cast("string"), ds.effective(c)
        new = None
        if "SEX" in have and ci(options, "SEX", default=True):
            new = F.coalesce(V.sex(cell, ci(options, "SEX_CODES")), cell)
        elif "AGE" in have and ci(options, "AGE"):
            years, how = V.age_years(cell), str(ci(options, "AGE")).lower()
            new = V.age_band(years, int(ci(options, "AGE_WIDTH", default=10))) if how == "bands" else F.floor(years).cast("string") if how == "integer" else F.round(years, 6).cast("string")
        elif spec := ci(ci(options, "UNIT", default={}), c):
            new = (V.comparator_number(cell) * float(ci(spec, "SCALE", default=1)) + float(ci(spec, "OFFSET", default=0))).cast("string")
            new = F.concat(V.comparator_sign(cell), new)
        if new is not None:
            df = df.withColumn(f"{c}_raw", cell).withColumn(c, new)
    return ds.with_df(df)


def censor(released: Column, flag: Column, below: str, limit: Column) -> Column:
    """``<limit`` where the flag says below detection, else the released text."""
    return F.when(V.text(flag) == below, F.concat(F.lit("<"), limit.cast("string"))).otherwise(released.cast("string"))


def prepare_survey(people: DataFrame, measured: DataFrame, key: str, weight: str, flags: dict[str, tuple[str, str, float]]) -> DataFrame:
    """People left-joined to a measured subsample: weight 0 for those not in it, censored values as ``<limit``.

    ``flags``: column -> (flag column, code below detection, limit).  Keys that repeat on either side are refused.
    """
    for side in (people, measured):
        if not side.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} repeats")
    j = people.join(measured, key, "left").withColumn(weight, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    return j.withColumns({f"{c}_cens": censor(F.col(c), F.col(f), code, F.lit(limit)) for c, (f, code, limit) in flags.items()})


def qc_workflow(df: DataFrame, by: list[str], run: str, order: str, value: str) -> dict[str, DataFrame]:
    """Precision, charts, rules and run review of control measurements, all lazy over one parsed base."""
    from . import laboratory as L

    v = F.col(value)
    chart = L.levey_jennings(df, [*by, "material"], [order], v, [run])
    judged = L.westgard_basic(chart, by, run, order)
    return {"precision": L.qc_precision(df, [*by, "material"], v), "chart": chart, "rules": judged, "review": L.run_review(judged, by, run), "invalid": df.where(v.isNull()).groupBy(*as_list(by)).agg(F.count("*").alias("n"))}


def fix(ds: Dataset, comparators: str | None = None, options: dict | None = None) -> Dataset:
    """Canonical sexes and ages in place; in plain number columns, rows with a comparator go (DELETE) or keep the bound (VALUE)."""
    from .comparators import fix_comparator

    out = apply_options(ds, {"SEX": True, "AGE": "years", **(options or {})})
    df = out.df.drop(*[f"{c}_raw" for c in ds.columns if f"{c}_raw" not in ds.columns])
    for c in ds.find(any_of=["NUM"]) if comparators else []:
        df = fix_comparator(df, c, comparators)
    return ds.with_df(df)


def normalise_dates(ds: Dataset, formats: list[str] | None = None) -> Dataset:
    """DATE and DATETIME columns as ISO text; what no format reads stays as it is.  Spreadsheet day numbers are read as well."""
    df = ds.df
    for c in ds.find(any_of=["DATE", "DATETIME"]):
        cell = F.col(f"`{c}`")
        df = df.withColumn(c, F.coalesce(V.iso(V.temporal(cell, formats, excel_serial=True)), cell.cast("string")))
    return ds.with_df(df)


def normalise_categories(ds: Dataset) -> Dataset:
    """Synonyms of each column's controls (VALUES as a table of words) to canonical words; BY_SOURCE codes only inside their source."""
    from .integration import normalise_words

    df = ds.df
    for c in ds.columns:
        spec = ci(ci(ds.meta, "COLUMN", default={}), c, default={}) or {}
        words, codes = ci(spec, "VALUES"), ci(spec, "BY_SOURCE")
        if isinstance(words, dict) or codes:
            table = {str(k): [str(x) for x in as_list(v)] for k, v in words.items()} if isinstance(words, dict) else {}
            df = normalise_words(df, c, table, codes, ds.resolve(str(ci(spec, "SOURCE"))) if codes else None)
    return ds.with_df(df)
