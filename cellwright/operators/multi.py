"""Operators on several datasets, samples, snapshots and identities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tags as T
from ..dataset import ROW, Dataset
from ..functions import values as V
from .statistics import running_sums

#: Tags that say nothing about a column's role.
ROLELESS = {"BY", "STR", "NUM", "<NUM>", "TXT", "CAT", "CMP", "NULLABLE", "EMPTY_OK", "WS_OK", "REQUIRED"}


def role(ds: Dataset, column: str) -> str:
    """Identity of a column across datasets: its ID, its unique semantic tags, else its name."""
    if cid := ds.column_id(column):
        return f"id::{cid}"
    mine = tuple(sorted(set(ds.tags.get(column, ())) - ROLELESS))
    twins = [c for c in ds.columns if tuple(sorted(set(ds.tags.get(c, ())) - ROLELESS)) == mine]
    return "tags::" + "::".join(mine) if mine and len(twins) == 1 else f"name::{column}"


def merge(datasets: dict[str, Dataset], source: str = "source", numbers: str = "strict") -> Dataset:
    """Stack rows; columns are aligned by role, missing ones are absent.

    Where a role is a plain number in one source and a number with comparator in another, ``strict`` refuses,
    ``promote`` keeps comparators, ``split`` makes code and number columns.
    """
    names: dict[str, str] = {}
    kinds: dict[str, set[str]] = {}
    for ds in datasets.values():
        for c in ds.columns:
            r = role(ds, c)
            names.setdefault(r, c if c not in names.values() else f"{c}_{len(names)}")
            kinds.setdefault(r, set()).update({"NUM", "<NUM>"} & set(ds.tags.get(c, ())))
    mixed = {r for r, k in kinds.items() if len(k) == 2}
    if mixed and numbers == "strict":
        raise ValueError(f"numbers with and without comparators: {sorted(names[r] for r in mixed)}")
    out, tags = None, {}
    for label, ds in datasets.items():
        cols = []
        for c in ds.columns:
            r = role(ds, c)
            cell = F.col(f"`{c}`").cast("string") if r in mixed else F.col(f"`{c}`")
            if r in mixed and numbers == "split":
                cols += [V.comparator_code(cell).alias(names[r] + "__cmp"), V.comparator_number(cell).alias(names[r] + "__num")]
            else:
                cols.append(cell.alias(names[r]))
            tags[names[r]] = T.distinct([*tags.get(names[r], ()), *ds.tags.get(c, ())])
        part = ds.df.select(F.lit(label).alias(source), *cols)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return Dataset(out, {k: v for k, v in tags.items() if k in out.columns} | {source: ("BY", "STR")})


def _draw(seed: int, key: Column) -> Column:
    """MD5 of seed and key: the order in which rows are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def sample(df: DataFrame, key: Column, n: int | None = None, fraction: float | None = None, by: list[str] = (), seed: int = 0, replace: bool = False) -> DataFrame:
    """Deterministic sample by the hash of a key: the same rows on every run and every layout.

    A fraction is a filter.  A number of rows per group keeps each task's smallest hashes first.  With ``replace`` a row may come more than once: by
    fraction, a row's number of copies is Poisson distributed; by number, ``n`` draws of places among the rows of its group in hash order.
    """
    h = _draw(seed, key)
    share = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2.0**32
    if fraction is not None and not replace:
        return df.where(share < fraction)
    if fraction is not None:
        steps, term, total = [], math.exp(-fraction), 0.0
        for k in range(1, 200):
            total += term
            steps.append(total)
            term *= fraction / k
        return df.withColumn("_copies", F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= share))).where("_copies > 0").withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    groups = [F.col(f"`{b}`") for b in by]
    if replace:
        return _redraw(df, h, groups, n, seed)
    if not by:
        return df.orderBy(h, key).limit(n)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(h, key))).where(F.col("_rn") <= n).drop("_rn")


def _redraw(df: DataFrame, h: Column, groups: list[Column], n: int, seed: int) -> DataFrame:
    """Places are counted in 4,096 slices of the hash, so that a group is never numbered in one task."""
    g = F.to_json(F.struct(*[c.alias(f"g{i}") for i, c in enumerate(groups)])) if groups else F.lit("")
    x = df.withColumn("_g", g).withColumn("_h", h).withColumn("_s", F.substring("_h", 1, 3))
    slices = x.groupBy("_g", "_s").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows a group
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    sizes = slices.groupBy("_g").agg(F.sum("_n").alias("_all"))
    draws = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_place", F.pmod(F.xxhash64(F.lit(seed), "_g", "_draw"), F.col("_all")))
    hits = draws.join(slices.select("_g", "_s", "_n", "_before"), "_g").where("_place >= _before and _place < _before + _n").select("_g", "_s", (F.col("_place") - F.col("_before") + 1).alias("_rn"))
    wanted = hits.groupBy("_g", "_s", "_rn").agg(F.count("*").alias("_copies"))
    placed = x.withColumn("_rn", F.row_number().over(Window.partitionBy("_g", "_s").orderBy("_h")))
    return placed.join(wanted, ["_g", "_s", "_rn"]).withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns])


def pseudonym(c: Column, salt: str = "", prefix: str = "", length: int = 12) -> Column:
    """Prefix and the first hexadecimal digits of a salted SHA-256; blank cells stay."""
    t = V.strip(c.cast("string"))
    return F.when(F.coalesce(t, F.lit("")) == "", c.cast("string")).otherwise(F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat(F.lit(salt + "|"), t).cast("binary"), 256), 1, length))))


def anonymize(ds: Dataset, columns: dict[str, str] | None = None, salt: str = "") -> tuple[Dataset, dict[str, DataFrame]]:
    """Identifiers become pseudonyms, names go; mappings are returned for a separate store."""
    columns = columns or {c: "hash" for c in ds.find(any_of=["ID", "HOSPITAL_ID"])} | {c: "drop" for c in ds.find(any_of=["NAME"])}
    df, maps = ds.df, {}
    for c, how in columns.items():
        if how == "drop":
            df = df.drop(c)
        else:
            maps[c] = ds.df.select(F.col(f"`{c}`").alias("value")).distinct().withColumn("pseudonym", pseudonym(F.col("value"), salt))
            df = df.withColumn(c, pseudonym(F.col(f"`{c}`"), salt))
    return ds.with_df(df), maps


#: Fixed value: numbers this close, relative to the larger, are equal.
TOLERANCE = 1e-12


def same_cell(a: Column, b: Column, kind: str) -> Column:
    """Equal, both null, or numbers within the tolerance."""
    if kind not in ("double", "float"):
        return a.eqNullSafe(b)
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (added, removed, modified, repeated) and the names of modified columns; equal rows are left out.

    Null keys are keys.  A key on several rows of one side says nothing of which row became which: it is ``repeated``, once, and multiplies
    nothing.  Sides are reduced to a row a key before the full outer join, on the same partitioning.
    """
    rest, kinds = [c for c in old.columns if c not in keys], dict(old.dtypes)
    q = lambda c: F.col(f"`{c}`")
    side = lambda d, s: d.groupBy(*[q(k) for k in keys]).agg(F.first(F.struct(*[q(c) for c in rest])).alias(s), F.count("*").alias(f"{s}_rows"))
    a, b = side(old, "o"), side(new, "n")
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    j = a.alias("a").join(b.alias("b"), on, "full_outer")
    moved = F.array_compact(F.array(*[F.when(~same_cell(F.col(f"o.`{c}`"), F.col(f"n.`{c}`"), kinds[c]), c) for c in rest]))
    twice = F.greatest(F.coalesce("o_rows", F.lit(0)), F.coalesce("n_rows", F.lit(0))) > 1
    change = F.when(twice, "repeated").when(F.col("o_rows").isNull(), "added").when(F.col("n_rows").isNull(), "removed").when(F.size(moved) > 0, "modified")
    key = lambda k: F.when(F.col("n_rows").isNull(), F.col(f"a.`{k}`")).otherwise(F.col(f"b.`{k}`")).alias(k)
    listed = F.when(~twice & F.col("o_rows").isNotNull() & F.col("n_rows").isNotNull(), F.array_join(moved, ","))
    return j.select(*[key(k) for k in keys], change.alias("change"), listed.alias("columns")).where("change is not null")


def positional_diff(old: DataFrame, new: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """position, change and the names of modified columns of an append-only table: rows are matched by their place in a numeric order without ties."""
    columns = columns or [c for c in old.columns if c != order]
    placed = [running_sums(d.withColumn("_one", F.lit(1)), order, {"_one": "position"}).select("position", *[F.col(f"`{c}`") for c in columns]) for d in (old, new)]
    return snapshot_diff(*placed, ["position"])


def annotate_results(old: DataFrame | None, new: DataFrame, keys: list[str], value: str | list[str] | None = None, sequence: int | None = None, at: str | None = None) -> DataFrame:
    """New results with ``status`` NEW, CHANGED or SAME against the earlier snapshot.

    Null keys match.  With a sequence number, ``sync_seq`` and ``synced_at`` say when a row first appeared, taken over from ``old`` where it has them.  A key
    that repeats in ``old`` is matched once, with its smallest row.
    """
    values = [value] if isinstance(value, str) else value or [c for c in new.columns if c not in keys]
    q = lambda c: F.col(f"`{c}`")
    kinds = dict(new.dtypes)
    if old is None:
        j = new.withColumn("status", F.lit("NEW")).withColumn("_was", F.lit(None).cast("struct<x:int>"))
        tracked = False
    else:
        tracked = sequence is not None and {"sync_seq", "synced_at"} <= set(old.columns)
        held = [*values, *(["sync_seq", "synced_at"] if tracked else [])]
        prior = old.groupBy(*[q(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*[q(c) for c in held])).alias("_was"))
        j = new.join(prior, [q(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
        same = F.lit(True)
        for c in values:
            same = same & same_cell(q(c), F.col(f"_was.`{c}`"), kinds[c])
        j = j.withColumn("status", F.when(F.col("_was").isNull(), "NEW").when(same, "SAME").otherwise("CHANGED"))
    track = []
    if sequence is not None:
        first = lambda c, now: F.coalesce(F.col(f"_was.{c}"), now) if tracked else now
        track = [first("sync_seq", F.lit(sequence).cast("bigint")).alias("sync_seq"), first("synced_at", F.lit(at)).alias("synced_at")]
    return j.select(*[q(c) for c in new.columns], *track, "status")


def content_hash(df: DataFrame, ordered_by: str | None = None) -> DataFrame:
    """One row: count and a digest (a sum of 60 bits of each row's MD5) that does not depend on row order; with an order key it enters each row.

    Cells enter a row's digest by digests of their own, so that no cell's text can pass for a border between two.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns if c != ROW]
    key = [F.col(f"`{ordered_by}`").cast("string")] if ordered_by else []
    each = [F.md5(c.cast("binary")) for c in [*cells, *key]]
    h = F.conv(F.substring(F.md5(F.concat_ws("", *each).cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def chain_hash(df: DataFrame) -> Column:
    """SHA-256 of the digests of a row's cells in column order, states kept apart."""
    return F.sha2(F.concat_ws("", *[F.sha2(F.concat(V.state(F.col(f"`{c}`").cast("string")), F.lit(":"), V.text(F.col(f"`{c}`"))).cast("binary"), 256) for c in df.columns if c != ROW]).cast("binary"), 256)
