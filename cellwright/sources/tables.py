"""Any table to a tagged dataset, and type inference by whole-column aggregates."""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions import values as V
from . import container as C

#: Words in names that suggest a tag.
NAME_RULES = [("HOSPITAL_ID", r"hospital|site_?id|facility"), ("ID", r"(^|_)id$|^id(_|$)|mrn|patient"), ("NAME", r"name$|이름|성명"), ("SEX", r"^(sex|gender)|성별"), ("AGE", r"^age|나이|연령"), ("ITEM", r"^(test|item|analyte)|검사"), ("DATE", r"date|day$|일자")]


def read_any(spark: SparkSession, path: str) -> Dataset:
    """csv (blanks become ''), tsv, parquet, orc, jsonl, workbook or sectioned text, by suffix."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return C.scan_table(spark, path, ",", decode=False)
    if low.endswith((".tsv", ".txt")):
        return C.scan_table(spark, path)
    if low.endswith((".parquet", ".orc")):
        return Dataset(getattr(spark.read, low.rsplit(".", 1)[1])(path))
    if low.endswith((".json", ".jsonl")):
        return Dataset(spark.read.json(path))
    if low.endswith((".xlsx", ".xlsm")):
        from .workbook import read_workbook

        return read_workbook(spark, path)
    return C.read_container(spark, path)


def infer(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[str, ...]]:
    """Tags of text columns from names and values, in one pass over all rows.

    <NUM> if some cell has a comparator and the rest are numbers; NUM; STR if numbers have leading zeros; DATE or
    DATETIME if at least 95 % read as one; CATEGORY if at most 12 values repeat; else STR.
    """
    columns = columns or df.columns
    parts = []
    for i, c in enumerate(columns):
        t = F.nullif(V.strip(V.text(F.col(f"`{c}`"))), F.lit(""))
        ts = V.temporal(t)
        n = lambda x: F.sum(F.coalesce(x, F.lit(False)).cast("bigint"))
        parts.append(F.struct(F.count(t).alias("n"), n(V.strict_number(t).isNotNull()).alias("num"), n(V.comparator_sign(t).isNotNull()).alias("cmp"), n(t.rlike(r"^0[0-9]+$")).alias("zero"), n(ts.isNotNull() & ~t.rlike(r"^[0-9]+$")).alias("ts"), n(ts.isNotNull() & (F.date_trunc("day", ts) != ts)).alias("time"), F.approx_count_distinct(t).alias("d")).alias(f"c{i}"))
    row = df.agg(*parts).first()
    out = {}
    for i, c in enumerate(columns):
        s, named = row[f"c{i}"], next((tag for tag, p in NAME_RULES if re.search(p, c.lower())), None)
        if s.n and s.cmp == s.n and s.num < s.n:
            kind = "<NUM>"
        elif s.n and s.num == s.n:
            kind = "STR" if s.zero else "NUM"
        elif s.n and s.ts >= 0.95 * s.n:
            kind = "DATETIME" if s.time else "DATE"
        elif s.n and s.d <= 12 and s.d < s.n:
            kind = "CATEGORY"
        else:
            kind = "STR"
        out[c] = tuple(dict.fromkeys([*([named] if named else []), kind]))
    return out


def extract_images(ds: Dataset, column: str) -> DataFrame:
    """Data URLs decoded to (kind, bytes) beside the other columns; writing files is the sink's work."""
    c = F.col(f"`{column}`")
    return ds.df.withColumn(f"{column}_kind", F.regexp_extract(c, r"^data:image/([a-z+]+);base64,", 1)).withColumn(f"{column}_bytes", F.expr(f"try_to_binary(regexp_replace(`{column}`, '^data:[^,]*,', ''), 'base64')"))


def embed_images(ds: Dataset, column: str, kind: str = "png") -> DataFrame:
    """Binary cells back to data URLs."""
    return ds.df.withColumn(column, F.concat(F.lit(f"data:image/{kind};base64,"), F.regexp_replace(F.base64(F.col(f"`{column}_bytes`")), r"\s", "")))


def data_url(raw: bytes, kind: str = "png") -> str:
    return f"data:image/{kind};base64,{base64.b64encode(raw).decode()}"
