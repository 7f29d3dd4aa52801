"""Units of concentration, converted exactly within one property."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import comparator_number, comparator_sign

#: Property -> code -> size in the property's base unit.
UNITS = {
    "mass_concentration": {"g/L": "1", "g/dL": "10", "mg/L": "0.001", "mg/dL": "0.01", "ug/L": "0.000001", "ug/dL": "0.00001", "ug/mL": "0.001", "ng/mL": "0.000001", "pg/mL": "0.000000001"},
    "substance_concentration": {"mol/L": "1", "mmol/L": "0.001", "umol/L": "0.000001", "nmol/L": "0.000000001", "pmol/L": "0.000000000001"},
    "catalytic_activity_concentration": {"kat/L": "60000000", "ukat/L": "60", "U/L": "1"},
    "equivalent_concentration": {"Eq/L": "1", "mEq/L": "0.001"},
    "reported_percent": {"%": "1"},
    "substance_ratio": {"mmol/mol": "1"},
}


def unit_property(unit: str) -> str:
    for prop, codes in UNITS.items():
        if unit in codes:
            return prop
    raise ValueError(f"unsupported unit {unit!r}")


def unit_factor(source: str, target: str) -> Decimal:
    """What a number in ``source`` is multiplied by; different properties need a bridge of their own."""
    prop = unit_property(source)
    if prop != unit_property(target):
        raise ValueError(f"{source} and {target} measure different properties")
    with localcontext() as c:
        c.prec = 80
        return Decimal(UNITS[prop][source]) / Decimal(UNITS[prop][target])


def convert(cell: str | Column, source: str, target: str, offset: str = "0") -> Column:
    """Text of a number with its comparator in another unit, in DECIMAL(38, 18) where the factor terminates, else in double."""
    factor = unit_factor(source, target)
    sign = comparator_sign(cell)
    digits = factor.normalize().as_tuple()
    if len(digits.digits) <= 18 and -18 <= digits.exponent <= 8:
        n = F.regexp_replace(cell if isinstance(cell, Column) else F.col(f"`{cell}`"), r"^\s*(<=|>=|<|>|=)?\s*|\s+$", "").try_cast("decimal(20,9)")
        x = (n * F.lit(Decimal(factor)).cast("decimal(17,12)") + F.lit(Decimal(offset)).cast("decimal(17,9)")).cast("string")
    else:
        x = (comparator_number(cell) * float(factor) + float(offset)).cast("string")
    plain = F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(sign.isNotNull(), F.concat(sign, plain))
