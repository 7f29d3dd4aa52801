"""Validation: a cascade per column in which a cell's first failing check wins, reported as rows of issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import ROW, Dataset, ci
from ..functions import values as V

#: Spellings of limits.
LOW_KEYS, HIGH_KEYS = ("MIN", "MIN_VALUE", "LOWER_LIMIT", "LOWER_BOUND"), ("MAX", "MAX_VALUE", "UPPER_LIMIT", "UPPER_BOUND")


@dataclass(frozen=True)
class Rule:
    tag: str
    fails: Column
    message: str


def column_rules(ds: Dataset, name: str) -> list[Rule]:
    c, have = F.col(f"`{name}`").cast("string"), ds.effective(name)
    spec = ci(ci(ds.meta, "COLUMN", default={}), name, default={}) or {}
    s = V.state(c)
    full = s == "VALUE"
    out = []
    if "REQUIRED" in have:
        out.append(Rule("REQUIRED", s != "VALUE", "a value is required"))
    for tag, st in (("NULLABLE", "NULL"), ("EMPTY_OK", "EMPTY"), ("WS_OK", "WS")):
        if tag not in have:
            out.append(Rule(st, s == st, f"{st} is not allowed"))
    if "NUM" in have:
        out.append(Rule("NUM", full & V.strict_number(c).isNull(), "not a number"))
    if "<NUM>" in have:
        out.append(Rule("<NUM>", full & V.comparator_sign(c).isNull(), "not a number with comparator"))
    if "AGE" in have:
        out.append(Rule("AGE", full & V.age_years(c).isNull(), "not an age"))
    if "SEX" in have:
        out.append(Rule("SEX", full & V.sex(c).isNull(), "unknown sex"))
    for tag, formats in (("DATE", None), ("DATETIME", None), ("TIME", V.TIME_FORMATS)):
        if tag in have:
            out.append(Rule(tag, full & V.temporal(c, formats).isNull(), f"not a {tag.lower()}"))
    limits = {**spec, **(ci(spec, "LIMITS", default={}) or {})}
    x = V.age_years(c) if "AGE" in have else V.comparator_number(c)
    for keys, sign in ((LOW_KEYS, "below"), (HIGH_KEYS, "above")):
        bound = ci(limits, *keys)
        if bound is not None:
            bad = x < float(bound) if sign == "below" else x > float(bound)
            out.append(Rule(keys[0], full & F.coalesce(bad, F.lit(False)), f"{sign} {bound}"))
    levels = ci(spec, "LEVELS")
    if levels and "ORDINAL" in have:
        out.append(Rule("ORDINAL", full & ~V.strip(c).isin([str(w).strip() for w in levels]), "not a level"))
    words = ci(spec, "VALUES")
    if words and str(ci(spec, "STRICT", default=True)).lower() != "false":
        out.append(Rule("CATEGORY", full & ~F.lower(V.strip(c)).isin([str(w).strip().lower() for w in words]), "not in the vocabulary"))
    return out


def measurement_conflicts(ds: Dataset) -> list[tuple[str, str]]:
    """(column, message) of contradictions between tags and controls."""
    out, specimens = [], {}
    for c in ds.columns:
        have, spec = ds.effective(c), ci(ci(ds.meta, "COLUMN", default={}), c, default={}) or {}
        if {"NOMINAL", "ORDINAL"} <= set(have):
            out.append((c, "both nominal and ordinal"))
        if ci(spec, "LEVELS") and "ORDINAL" not in have:
            out.append((c, "levels without an order"))
        if "ORDINAL" in have and not ci(spec, "LEVELS"):
            out.append((c, "an order without levels"))
        if analyte := ci(spec, "ANALYTE"):
            specimens.setdefault((str(analyte), ci(spec, "UNIT")), set()).add(str(ci(spec, "SPECIMEN", default="")))
            if "" in specimens[(str(analyte), ci(spec, "UNIT"))] and len(specimens[(str(analyte), ci(spec, "UNIT"))]) > 1:
                out.append((c, f"{analyte} with and without a specimen"))
    return out


def issue_column(ds: Dataset, name: str) -> Column:
    """Struct (column, tag, value, message) of the first failing rule, or null."""
    out = None
    for r in column_rules(ds, name):
        made = F.struct(F.lit(name).alias("column"), F.lit(r.tag).alias("tag"), F.col(f"`{name}`").cast("string").alias("value"), F.lit(r.message).alias("message"))
        out = F.when(r.fails, made) if out is None else out.when(r.fails, made)
    return out if out is not None else F.lit(None).cast("struct<column:string,tag:string,value:string,message:string>")


def issues(ds: Dataset) -> DataFrame:
    """Row number (if rows are numbered) and issue, one row each, in one pass over the data."""
    found = F.array_compact(F.array(*[issue_column(ds, c) for c in ds.columns]))
    keep = [ROW] if ROW in ds.df.columns else []
    return ds.df.select(*keep, F.explode(found).alias("i")).select(*keep, "i.*")


def drop_invalid(ds: Dataset) -> Dataset:
    return ds.with_df(ds.df.where(F.size(F.array_compact(F.array(*[issue_column(ds, c) for c in ds.columns]))) == 0))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("n")).where("n > 1")


def value_profile(df: DataFrame, column: str, canonical: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """raw, canonical, recognised, will_change, n and rows of the same canonical value."""
    c = F.col(f"`{column}`").cast("string")
    counts = df.groupBy(c.alias("raw")).agg(F.count("*").alias("n")).where("raw is not null")
    shaped = counts.withColumn(column, F.col("raw")).select("raw", canonical.alias("canonical"), "n", *[v.alias(k) for k, v in (extra or {}).items()])
    sums = shaped.groupBy("canonical").agg(F.sum("n").alias("canonical_n"))
    j = shaped.alias("a").join(sums.alias("b"), F.col("a.canonical").eqNullSafe(F.col("b.canonical")))
    return j.select("raw", F.col("a.canonical").alias("canonical"), F.col("a.canonical").isNotNull().alias("recognised"), F.coalesce(F.col("a.canonical") != F.col("raw"), F.lit(False)).alias("will_change"), "n", "canonical_n", *(extra or {}))


def excel_damage(df: DataFrame, columns: list[str]) -> DataFrame:
    """What a spreadsheet's general format would do to text cells: counts by column and kind."""
    def kind(c: Column) -> Column:
        t = V.strip(V.text(c))
        return F.when(t.rlike(r"^0[0-9]+$"), "leading_zero").when(t.rlike(r"^[+-]?[0-9]{16,}$"), "precision").when(t.rlike(r"^[0-9]{1,4}[-/][0-9]{1,2}([-/][0-9]{1,4})?$"), "date").when(t.rlike(r"^[0-9]+[eE][0-9]+$"), "exponent")

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), kind(F.col(f"`{c}`")).alias("kind")) for c in columns])).alias("x")).select("x.*")
    return long.where("kind is not null").groupBy("column", "kind").agg(F.count("*").alias("n"))
