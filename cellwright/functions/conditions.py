"""Row conditions: declarative tests compiled to one null-free boolean column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import all_of, any_of, strict_number, temporal, text


def condition(op: str, column: Column, value: Any = None, values: list | None = None, case_sensitive: bool = False) -> Column:
    """One test.  Absent cells count as '', so that ``ne`` and ``not_in`` hold for them."""
    op = op.lower()
    raw = list(values) if values is not None else ([] if value is None else [value])
    fold = (lambda x: x) if case_sensitive else F.lower
    t = fold(text(column))
    lits = [fold(F.lit(str(v))) for v in raw]
    first = lits[0] if lits else F.lit("")
    if op in ("eq", "=="):
        return t == first
    if op in ("ne", "!="):
        return t != first
    if op == "in":
        return t.isin(lits)
    if op == "not_in":
        return ~t.isin(lits)
    if op == "contains":
        return F.contains(t, first)
    if op in ("startswith", "endswith"):
        return getattr(F, op)(t, first)
    if op == "regex":
        return text(column).rlike(("" if case_sensitive else "(?i)") + str(raw[0]))
    if op == "is_empty":
        return text(column) == ""
    if op == "not_empty":
        return text(column) != ""
    if op in ("gt", "ge", "lt", "le", "between"):
        return F.coalesce(_ordered(op, column, raw), F.lit(False))
    raise ValueError(f"unknown condition {op}")


def _ordered(op: str, column: Column, raw: list) -> Column:
    """Numbers compare as numbers; bounds that are no numbers as instants."""
    try:
        bounds = [F.lit(float(v)) for v in raw]
        x = strict_number(column)
    except (TypeError, ValueError):
        bounds = [temporal(F.lit(str(v))) for v in raw]
        x = temporal(column)
    if op == "between":
        return x.between(F.least(*bounds), F.greatest(*bounds))
    return {"gt": x > bounds[0], "ge": x >= bounds[0], "lt": x < bounds[0], "le": x <= bounds[0]}[op]


def combine(tests: list[Column], logic: str = "AND") -> Column:
    return all_of(tests) if logic.upper() == "AND" else any_of(tests)


def eligibility(tests: list[dict], columns: dict[str, Column]) -> tuple[Column, Column]:
    """(holds, missing) of an all-of predicate by column identity.

    Tests have COLUMN_ID and any of MIN, MAX, MIN_EXCLUSIVE, MAX_EXCLUSIVE, IN_NUMBERS, IN_TEXT.
    """
    holds, missing = [], []
    for test in tests:
        c = columns[test["COLUMN_ID"]]
        if "IN_TEXT" in test:
            missing.append(text(c) == "")
            holds.append(text(c).isin(list(test["IN_TEXT"])))
            continue
        x = strict_number(c)
        missing.append(x.isNull())
        parts = [F.coalesce(p, F.lit(False)) for p in (
            *([x >= float(test["MIN"])] if "MIN" in test else []), *([x <= float(test["MAX"])] if "MAX" in test else []),
            *([x > float(test["MIN_EXCLUSIVE"])] if "MIN_EXCLUSIVE" in test else []), *([x < float(test["MAX_EXCLUSIVE"])] if "MAX_EXCLUSIVE" in test else []),
            *([x.isin([float(v) for v in test["IN_NUMBERS"]])] if "IN_NUMBERS" in test else []),
        )]
        holds.append(all_of(parts))
    return all_of(holds), any_of(missing)
