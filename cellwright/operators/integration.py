"""Integration of sources into one wide table: unit conversion, detection limits, states, and the row they came from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions import units as U
from ..functions import values as V


@dataclass(frozen=True)
class Target:
    """A column of the result: unit, and where each source has it."""

    name: str
    unit: str
    #: source -> {column, unit, factor (bridge between properties), lower (LLOD), upper (ULOQ), ref_low, ref_high}
    sources: dict[str, dict] = field(default_factory=dict)


def integrate(sources: dict[str, Dataset], targets: list[Target], keys: list[str]) -> DataFrame:
    """One row per source row: source, keys, for each target value, unit, kind, bounds, status, and the source row as JSON with its digest.

    kind is EXACT, LEFT, RIGHT or MISSING; status says CONVERTED, SAME_UNIT, BRIDGED, NOT_IN_SOURCE or PARSE_ERROR.
    """
    out = None
    for label, ds in sources.items():
        raw = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in ds.columns]), {"ignoreNullFields": "false"})
        cols: list[Column] = []
        for t in targets:
            cols += target_columns(t, t.sources.get(label))
        part = ds.df.select(F.lit(label).alias("source"), *[F.col(f"`{ds.resolve(k)}`").cast("string").alias(k) for k in keys], *cols, raw.alias("source_row"), F.sha2(raw.cast("binary"), 256).alias("source_sha256"))
        out = part if out is None else out.unionByName(part)
    return out


def target_columns(t: Target, spec: dict | None) -> list[Column]:
    none = F.lit(None)
    if not spec:
        return [none.cast("double").alias(t.name), F.lit(t.unit).alias(f"{t.name}_unit"), F.lit("MISSING").alias(f"{t.name}_kind"), none.cast("double").alias(f"{t.name}_lower"), none.cast("double").alias(f"{t.name}_upper"), F.lit("NOT_IN_SOURCE").alias(f"{t.name}_status")]
    cell, unit = F.col(f"`{spec['column']}`").cast("string"), spec.get("unit", t.unit)
    bridge = spec.get("factor")
    factor = float(bridge) if bridge is not None else float(U.unit_factor(unit, t.unit))
    sign, number = V.comparator_sign(cell), V.comparator_number(cell) * factor
    lod, loq = spec.get("lower"), spec.get("upper")
    left = sign.isin("<", "<=") | (F.lit(lod is not None) & (number < (lod if lod is not None else 0.0)))
    right = sign.isin(">", ">=") | (F.lit(loq is not None) & (number > (loq if loq is not None else 0.0)))
    kind = F.when(number.isNull(), "MISSING").when(left, "LEFT").when(right, "RIGHT").otherwise("EXACT")
    blank = V.strip(V.text(cell)) == ""
    status = F.when(number.isNull() & ~blank, "PARSE_ERROR").otherwise("BRIDGED" if bridge is not None else "SAME_UNIT" if unit == t.unit else "CONVERTED")
    return [F.when(kind == "EXACT", number).alias(t.name), F.lit(t.unit).alias(f"{t.name}_unit"), kind.alias(f"{t.name}_kind"), F.when(kind.isin("EXACT", "RIGHT"), number).alias(f"{t.name}_lower"), F.when(kind.isin("EXACT", "LEFT"), number).alias(f"{t.name}_upper"), status.alias(f"{t.name}_status")]


def restore(integrated: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """The original rows of a source; a row whose digest does not fit its JSON raises when it is read."""
    rows = integrated.where(F.col("source") == source)
    ok = F.sha2(F.col("source_row").cast("binary"), 256) == F.col("source_sha256")
    checked = F.when(ok, F.col("source_row")).otherwise(F.raise_error(F.lit("a source row was changed")).cast("string"))
    schema = ", ".join(f"`{c}` string" for c in columns)
    return rows.select(F.from_json(checked, schema).alias("r")).select("r.*")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two integrations has."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


# Result status and measurement context -----------------------------------------------


def result_status(status: Column | None, accepted: list[str], exclude: list[tuple[Column, str]] = ()) -> tuple[Column, Column]:
    """(accepted, reason): the last matching exclusion gives the reason."""
    reason = F.lit(None).cast("string")
    if status is not None:
        reason = F.when(~F.upper(V.strip(V.text(status))).isin([a.upper() for a in accepted]), "STATUS_NOT_ACCEPTED")
    for test, why in exclude:
        reason = F.when(F.coalesce(test, F.lit(False)), why).otherwise(reason)
    return reason.isNull(), reason


def measurement_context(bindings: dict[str, tuple[Column, str]], at: Column | None = None, valid_from: str | None = None, valid_to: str | None = None) -> Column:
    """Reason codes, ';'-joined: METHOD_MISMATCH and the like, OUTSIDE_VALIDITY; '' if all fits."""
    out = [F.when(V.text(c) != want, f"{name.upper()}_MISMATCH") for name, (c, want) in bindings.items()]
    if at is not None:
        early = at < F.lit(valid_from).cast("timestamp") if valid_from else F.lit(False)
        late = at >= F.lit(valid_to).cast("timestamp") if valid_to else F.lit(False)
        out.append(F.when(F.coalesce(early | late, F.lit(True)), "OUTSIDE_VALIDITY"))
    return F.array_join(F.array_compact(F.array(*out)), ";")


# Vocabularies ----------------------------------------------------------------------------


def normalise_words(df: DataFrame, column: str, words: dict[str, list[str]], by_source: dict[str, dict[str, str]] | None = None, source: str | None = None, out: str | None = None) -> DataFrame:
    """Synonyms to canonical words; codes are read only inside their own source; what is unknown stays."""
    c = F.col(f"`{column}`").cast("string")
    key = F.lower(V.strip(c))
    new = None
    for src, codes in (by_source or {}).items():
        for code, word in codes.items():
            hit = (F.col(f"`{source}`") == src) & (key == str(code).lower())
            new = F.when(hit, word) if new is None else new.when(hit, word)
    for word, names in words.items():
        hit = key.isin([n.lower() for n in [word, *names]])
        new = F.when(hit, word) if new is None else new.when(hit, word)
    return df.withColumn(out or column, new.otherwise(c) if new is not None else c)


def unresolved_words(df: DataFrame, column: str, words: list[str], source: str | None = None) -> DataFrame:
    """What a normalised column still holds beside its vocabulary, by source."""
    by = [F.col(f"`{source}`").alias("source")] if source else []
    return df.where(~F.col(f"`{column}`").isin(words)).groupBy(*by, F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))


def drop_absent_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without columns that are absent in every row: one aggregate decides."""
    columns = columns or df.columns
    row = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return df.drop(*[c for i, c in enumerate(columns) if not row[f"c{i}"]])


def compare_outputs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per column: cells compared, equal and unequal, by key."""
    cols = [c for c in a.columns if c != key and c in b.columns]
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")))
    one = j.agg(F.count("*").alias("n"), *[F.sum(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).cast("bigint")).alias(f"e{i}") for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("compared"), F.coalesce(F.col(f"e{i}"), F.lit(0)).alias("equal"), (F.col("n") - F.coalesce(F.col(f"e{i}"), F.lit(0))).alias("unequal")) for i, c in enumerate(cols)])).alias("r")).select("r.*")
