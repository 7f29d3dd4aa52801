"""Results with bounds such as ``<5``: profiles, policy impact, harmonisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def split_comparator(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({f"{column}__cmp": V.comparator_code(column), f"{column}__num": V.comparator_number(column)})


def profile(df: DataFrame, item: str, value: str) -> DataFrame:
    """Bounded values by item, code and threshold."""
    x = df.select(F.col(f"`{item}`").alias("item"), V.comparator_code(value).alias("code"), V.comparator_number(value).alias("threshold"), V.strip(V.text(value)).alias("raw"))
    return x.where("code in ('LT', 'LE', 'GT', 'GE')").groupBy("item", "code", "threshold", "raw").agg(F.count("*").alias("n"))


def policy_impact(df: DataFrame, value: str) -> DataFrame:
    """How many results each policy uses."""
    p = V.with_parsed(df.select(F.col(f"`{value}`").alias("v")), "v")
    code, t = V.code_of(F.col("_sign")), V.strip(V.text("v"))
    n = lambda c: F.sum(c.cast("bigint"))
    bounded = code.isin("LT", "LE", "GT", "GE")
    got = p.agg(n(t != "").alias("filled"), n(V.strict_number("v").isNotNull()).alias("strict"), n(F.coalesce(code == "EQ", F.lit(False))).alias("exact"), n(F.coalesce(bounded, F.lit(False))).alias("bounded"), n((t != "") & code.isNull()).alias("invalid"))
    policies = F.array(*[F.struct(F.lit(p).alias("policy"), (F.col("exact") + (F.col("bounded") if p == "VALUE" else F.lit(0))).alias("used")) for p in ("DELETE", "KEEP", "HARMONIZE", "VALUE")])
    return got.select(F.explode(policies).alias("p"), "*").select("p.policy", "filled", "strict", "exact", "bounded", "invalid", "p.used")


def _low() -> Column:
    return F.col("_sign").isin("<", "<=")


def _high() -> Column:
    return F.col("_sign").isin(">", ">=")


def thresholds(df: DataFrame, item: str, value: str) -> DataFrame:
    """Per item: the largest lower detection bound and the smallest upper one."""
    p = V.with_parsed(df.select(F.col(f"`{item}`").alias("item"), F.col(f"`{value}`").alias("v")), "v")
    low, high = F.when(_low(), F.col("_number")), F.when(_high(), F.col("_number"))
    return p.groupBy("item").agg(F.max(low).alias("lower"), F.min(high).alias("upper"), F.count_distinct(low).alias("lower_bounds"), F.count_distinct(high).alias("upper_bounds"))


def harmonize_preview(df: DataFrame, item: str, value: str) -> DataFrame:
    """item, family, sorted thresholds, the unified one, and the exact results it would swallow."""
    x = V.with_parsed(df.select(F.col(f"`{item}`").alias("item"), F.col(f"`{value}`").alias("v")), "v")
    x = x.select("item", F.when(_low(), "LT").when(_high(), "GT").when(F.col("_sign").isin("", "="), "EQ").alias("family"), F.col("_number").alias("num"))
    t = x.where("family in ('LT', 'GT')").groupBy("item", "family").agg(F.array_join(F.array_sort(F.collect_set("num")), ",").alias("thresholds"), F.max("num").alias("hi"), F.min("num").alias("lo"), F.count("*").alias("bounded"))
    t = t.withColumn("unified", F.when(F.col("family") == "LT", F.col("hi")).otherwise(F.col("lo")))
    exact = x.where("family = 'EQ'").drop("family").join(t.select("item", "family", "unified"), "item").groupBy("item", "family").agg(F.sum((F.when(F.col("family") == "LT", F.col("num") < F.col("unified")).otherwise(F.col("num") > F.col("unified"))).cast("bigint")).alias("convertible"))
    return t.join(exact, ["item", "family"], "left").select("item", "family", "unified", "bounded", F.coalesce("convertible", F.lit(0)).cast("bigint").alias("convertible"))


def harmonize(df: DataFrame, item: str, value: str) -> DataFrame:
    """Bounded results, and exact ones beyond a bound, become one ``<max`` or ``>min`` per item.

    An item without a name is an item of its own and never rewrites others.
    """
    t = thresholds(df, item, value).select(F.col("item").alias("_item"), "lower", "upper")
    j = V.with_parsed(df, F.col(f"`{value}`")).join(t, df[f"`{item}`"].eqNullSafe(F.col("_item")), "left")
    exact = F.col("_sign").isin("", "=")
    spell = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    bound = F.when((_low() | (exact & (F.col("_number") < F.col("lower")))) & F.col("lower").isNotNull(), F.concat(F.lit("<"), spell(F.col("lower"))))
    bound = bound.when((_high() | (exact & (F.col("_number") > F.col("upper")))) & F.col("upper").isNotNull(), F.concat(F.lit(">"), spell(F.col("upper"))))
    return j.withColumn(value, bound.otherwise(F.col(f"`{value}`"))).select(*[F.col(f"`{c}`") for c in df.columns])


def fix_comparator(df: DataFrame, column: str, how: str = "DELETE") -> DataFrame:
    """A number column that holds comparators: drop these rows, or keep the bound as value."""
    bounded = F.coalesce(V.comparator_code(column).isin("LT", "LE", "GT", "GE"), F.lit(False))
    if how == "DELETE":
        return df.where(~bounded)
    return df.withColumn(column, F.when(bounded, F.regexp_replace(V.strip(V.text(column)), r"^(<=|>=|<|>)\s*", "")).otherwise(F.col(f"`{column}`")))


def censor_kind(released: str, lower: str, upper: str):
    """EXACT, LEFT, RIGHT, INTERVAL or INVALID from a released number and its bounds."""
    r, lo, hi = (V.strict_number(c) for c in (released, lower, upper))
    return F.when(r.isNotNull() & lo.isNull() & hi.isNull(), "EXACT").when(lo.isNull() & hi.isNotNull(), "LEFT").when(lo.isNotNull() & hi.isNull(), "RIGHT").when(lo < hi, "INTERVAL").when(lo == hi, "EXACT").otherwise("INVALID")


def censor_value(released: str, lower: str, upper: str, policy: str = "RELEASED"):
    r, lo, hi = (V.strict_number(c) for c in (released, lower, upper))
    kind = censor_kind(released, lower, upper)
    exact = F.coalesce(r, lo)
    return {"RELEASED": r, "DELETE": F.when(kind == "EXACT", exact), "VALUE": F.coalesce(F.when(kind == "EXACT", exact), F.when(kind == "LEFT", hi), F.when(kind == "RIGHT", lo)), "MIDPOINT": F.coalesce(F.when(kind == "EXACT", exact), F.when(kind == "INTERVAL", (lo + hi) / 2))}[policy]
