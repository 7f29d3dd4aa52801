"""A lazy frame with tagged columns and controls."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tags as T

ROW = "__row_id"


def ci(config: dict | None, *keys: str, default: Any = None) -> Any:
    """First of ``keys`` in a config whose keys may be in any case."""
    low = {str(k).lower(): v for k, v in (config or {}).items()}
    for k in keys:
        if k.lower() in low:
            return low[k.lower()]
    return default


def as_list(v: Any) -> list:
    return [] if v is None or v == "" else list(v) if isinstance(v, list | tuple) else [v]


@dataclass(frozen=True)
class Dataset:
    """``df`` may carry a row number in ``__row_id``; order-sensitive operators need it."""

    df: DataFrame
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    schema: dict = field(default_factory=dict)
    job: dict = field(default_factory=dict)
    log: tuple = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def effective(self, name: str) -> tuple[str, ...]:
        return T.lineage(self.tags.get(name, ()), ci(self.meta, "TAG_DEFINITIONS", default={}))

    def with_df(self, df: DataFrame, **tags: Any) -> Dataset:
        kept = {k: v for k, v in {**self.tags, **tags}.items() if k in df.columns}
        return replace(self, df=df, tags=kept)

    def find(self, required: list[str] = (), any_of: list[str] = (), exclude: list[str] = ()) -> list[str]:
        need, some, no = map(T.distinct, (required, any_of, exclude))
        out = []
        for c in self.columns:
            have = self.effective(c)
            if all(t in have for t in need) and (not some or any(t in have for t in some)) and not any(t in have for t in no):
                out.append(c)
        return out

    def column_id(self, name: str) -> str | None:
        return ci(ci(ci(self.meta, "COLUMN", default={}), name, default={}), "ID")

    def resolve(self, selector: str) -> str:
        """Exact name, ``id:X``, ``tag:X`` (one match), else a name in any case."""
        found = self.resolve_all(selector)
        if len(found) != 1:
            raise KeyError(f"{selector!r} matches {len(found)} columns")
        return found[0]

    def resolve_all(self, *selectors: str) -> list[str]:
        out: list[str] = []
        for s in selectors:
            s = str(s)
            if s in self.columns:
                hits = [s]
            elif s.lower().startswith("id:"):
                hits = [c for c in self.columns if self.column_id(c) == s[3:]]
            elif s.lower().startswith("tag:"):
                hits = self.find(required=[s[4:]])
            else:
                hits = [c for c in self.columns if c.lower() == s.lower()]
            if not hits:
                raise KeyError(f"no column for {s!r}")
            out += hits
        return list(dict.fromkeys(out))

    def col(self, selector: str) -> Column:
        return F.col(f"`{self.resolve(selector)}`")

    def column_frame(self) -> DataFrame:
        rows = [(i, c, T.build_header(c, self.tags.get(c, ())), "::".join(self.tags.get(c, ()))) for i, c in enumerate(self.columns)]
        return self.df.sparkSession.createDataFrame(rows, "index int, name string, header string, tags string")


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """Add ``__row_id`` in the order of a declared unique key.

    Range partitions are sorted each for itself; their numbers rise with the key and leave gaps, so
    that no single task sees all rows.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    return parts.withColumn(ROW, F.col("_m")).drop("_p", "_m")
