"""Cell values as column expressions: states, numbers, comparators, ages, sexes, dates.

Cells are strings.  SQL NULL is an absent cell, ``NULL_MARK`` one that says null, '' an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARK = ""
STATES = ("ABSENT", "NULL", "EMPTY", "WS", "VALUE")
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
COMPARATORS = {"<": "LT", "<=": "LE", ">": "GT", ">=": "GE", "=": "EQ"}


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def state(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.isNull(), "ABSENT").when(c == NULL_MARK, "NULL").when(c == "", "EMPTY").when(strip(c) == "", "WS").otherwise("VALUE")


def decode_cell(c: str | Column) -> Column:
    """Stored spelling to cell; one escape sign is taken from literals that look reserved."""
    c = col(c)
    blanks = F.regexp_extract(c, r"^<<WS:([0-9]+)>>$", 1)
    return (
        F.when(c.isNull() | (c == "") | (c == "<<ABSENT>>"), F.lit(None).cast("string"))
        .when(c == "<<NULL>>", F.lit(NULL_MARK))
        .when(c == "<<EMPTY>>", F.lit(""))
        .when(blanks != "", F.repeat(F.lit(" "), blanks.try_cast("int")))
        .when(c.rlike(r"^\\+<<(ABSENT|NULL|EMPTY|WS:[0-9]+)>>$"), F.substring(c, 2, 2**31 - 1))
        .otherwise(c)
    )


def encode_cell(c: str | Column) -> Column:
    """Inverse of :func:`decode_cell`; runs of plain blanks become a count."""
    c = col(c)
    return (
        F.when(c.isNull(), F.lit(""))
        .when(c == NULL_MARK, "<<NULL>>")
        .when(c == "", "<<EMPTY>>")
        .when(c.rlike("^ +$"), F.concat(F.lit("<<WS:"), F.length(c).cast("string"), F.lit(">>")))
        .when(c.rlike(r"^\\*<<(ABSENT|NULL|EMPTY|WS:[0-9]+)>>$"), F.concat(F.lit("\\"), c))
        .otherwise(c)
    )


def text(c: str | Column) -> Column:
    """Text of a cell for comparisons; absent is ''."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strict_number(c: str | Column) -> Column:
    """Double where the whole cell is a finite number, else NULL (never NaN)."""
    t = strip(col(c).cast("string"))
    v = t.try_cast("double")
    return F.when(t.rlike(f"^{NUMBER}$") & (F.abs(v) < float("inf")), v)


_BOUNDED = rf"^(<=|>=|<|>|=)?\s*({NUMBER})$"


def comparator_sign(c: str | Column) -> Column:
    """One of <, <=, >, >=, = or '' for a plain number; NULL where the cell is neither."""
    t = strip(col(c).cast("string"))
    return F.when(t.rlike(_BOUNDED), F.regexp_extract(t, _BOUNDED, 1))


def code_of(sign: Column) -> Column:
    out = F.when(sign == "", "EQ")
    for k, v in COMPARATORS.items():
        out = out.when(sign == k, v)
    return out


def comparator_code(c: str | Column) -> Column:
    return code_of(comparator_sign(c))


def comparator_number(c: str | Column) -> Column:
    return F.nullif(F.regexp_extract(strip(col(c).cast("string")), _BOUNDED, 2), F.lit("")).try_cast("double")


def with_parsed(df: DataFrame, c: str | Column, sign: str = "_sign", number: str = "_number") -> DataFrame:
    """``df`` with sign and number of a result in columns of their own, so that what reads them many times parses once."""
    return df.withColumns({sign: comparator_sign(c), number: comparator_number(c)})


def comparator_value(c: str | Column, policy: str = "DELETE") -> Column:
    """Number under a policy: VALUE keeps bounds of bounded results, the others drop them."""
    if policy not in ("DELETE", "KEEP", "HARMONIZE", "VALUE"):
        raise ValueError(f"unknown comparator policy {policy}")
    sign, number = comparator_sign(c), comparator_number(c)
    return number if policy == "VALUE" else F.when(sign.isin("", "="), number)


def round_half_even(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def divide(a: Column, b: Column) -> Column:
    """IEEE division, but undefined 0/0 is NULL."""
    return F.when(b != 0, a / b).when((b == 0) & (a != 0), F.signum(a) * F.lit(float("inf")))


# Ages -------------------------------------------------------------------------

#: Years in a unit, and spellings of units.
AGE_YEARS = {"a": 1.0, "mo": 1 / 12, "d": 1 / 365.25}
AGE_UNITS = {"a": ["", "a", "ann", "y", "yr", "yrs", "year", "years", "세", "년"], "mo": ["mo", "mon", "mons", "month", "months", "m", "개월", "월"], "d": ["d", "day", "days", "일"]}
_AGE = r"^\s*\+?([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([A-Za-z가-힣]*)\s*$"


def age_unit(c: str | Column) -> Column:
    unit = F.lower(F.regexp_extract(col(c).cast("string"), _AGE, 2))
    out = None
    for code, names in AGE_UNITS.items():
        out = F.when(unit.isin(names), code) if out is None else out.when(unit.isin(names), code)
    return F.when(col(c).cast("string").rlike(_AGE), out)


def age_years(c: str | Column) -> Column:
    number = F.regexp_extract(col(c).cast("string"), _AGE, 1).try_cast("double")
    unit = age_unit(c)
    return F.when(unit == "a", number).when(unit == "mo", number / 12.0).when(unit == "d", number / 365.25)


def age_band(years: Column, width: int = 10, open_upper: int = 70) -> Column:
    """``<1``, ``1-9``, ``10-19`` ... ``70+``."""
    if width <= 0:
        raise ValueError("band width must be positive")
    low = (F.floor(years / width) * width).cast("int")
    top = F.least(low + width - 1, F.lit(open_upper - 1))
    return F.when(years < 0, F.lit(None)).when(years < 1, "<1").when(years >= open_upper, f"{open_upper}+").otherwise(F.concat(F.greatest(low, F.lit(1)).cast("string"), F.lit("-"), top.cast("string")))


def age_text(c: str | Column) -> Column:
    """``45`` for years, ``3mo``, ``10d``; other cells stay."""
    unit = age_unit(c)
    number = F.regexp_replace(F.regexp_extract(col(c).cast("string"), _AGE, 1), r"(\.[0-9]*?)0+$|\.$", "$1")
    number = F.regexp_replace(number, r"\.$", "")
    return F.when(unit == "a", number).when(unit.isNotNull(), F.concat(number, unit)).otherwise(col(c))


# Sex ---------------------------------------------------------------------------

#: Fixed values.
SEX_WORDS = {
    "male": ["M", "MALE", "MAN", "BOY", "남", "남자", "남성", "남아"],
    "female": ["F", "FEMALE", "WOMAN", "GIRL", "여", "여자", "여성", "여아"],
    "other": ["O", "OTHER", "X", "NB", "NONBINARY", "NON-BINARY", "NON_BINARY", "기타", "그외"],
    "unknown": ["U", "UNK", "UNKNOWN", "NA", "N/A", "미상", "모름", "불명"],
}


def sex(c: str | Column, codes: dict[str, str] | None = None) -> Column:
    """Canonical sex or NULL; ``codes`` declares what numbers such as 0 and 1 mean."""
    key = F.regexp_replace(F.upper(strip(col(c).cast("string"))), r"^([0-9]+)\.0+$", "$1")
    out = None
    for name, words in [*SEX_WORDS.items(), *((v, [k]) for k, v in (codes or {}).items())]:
        out = F.when(key.isin(words), name) if out is None else out.when(key.isin(words), name)
    return out


# Dates -------------------------------------------------------------------------

#: Patterns tried in order; what none of them reads is reported, never guessed.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "dd.MM.yyyy"]
TIME_FORMATS = ["HH:mm:ss", "HH:mm", "hh:mm:ss a", "hh:mm a", "HHmmss"]


def temporal(c: str | Column, formats: list[str] | None = None, excel_serial: bool = False) -> Column:
    """TIMESTAMP_NTZ-like instant of a text cell, or NULL."""
    t = strip(col(c).cast("string"))
    tried = [F.try_to_timestamp(t, F.lit(f)) for f in formats or DATE_FORMATS]
    if excel_serial:
        n = strict_number(t)
        day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")).cast("timestamp")
        tried.append(F.when(n.between(20000, 80000), F.timestamp_seconds(F.unix_timestamp(day) + F.round((n - F.floor(n)) * 86400))))
    return F.coalesce(*tried)


def iso(ts: Column) -> Column:
    """Date where the time is midnight, else date and time."""
    return F.when(F.date_trunc("day", ts) == ts, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def completed_years(birth: Column, at: Column) -> Column:
    before = (F.month(at) < F.month(birth)) | ((F.month(at) == F.month(birth)) & (F.dayofmonth(at) < F.dayofmonth(birth)))
    return F.year(at) - F.year(birth) - before.cast("int")


SECONDS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


def time_difference(start: Column, end: Column, unit: str = "minutes", digits: int = 2) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return round_half_even(micros / (SECONDS[unit] * 1e6), digits)


def date_part(c: Column, part: str) -> Column:
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "weekday": F.weekday, "quarter": F.quarter}
    return F.date_format(c, "yyyy-MM-dd") if part == "date" else parts[part](c).cast("bigint")


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
