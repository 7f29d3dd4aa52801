"""Column names of the operators' own that no input column has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with a number behind it if ``taken`` has the name already, in any case."""
    seen, out = {t.lower() for t in taken}, []
    for name in wanted:
        found, k = name, 0
        while found.lower() in seen:
            k += 1
            found = f"{name}{k}"
        seen.add(found.lower())
        out.append(found)
    return out


def column(name: str) -> Column:
    """A column by its whole name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with plain names by position, for functions over Arrow batches, which take no names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
