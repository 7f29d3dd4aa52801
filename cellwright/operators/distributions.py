"""Distribution tests on running counts: distances between empirical distributions, to the fitted normal, and between groups."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as S
from .intervals import harris_boyd
from .ordering import MAX_GROUPS, bounded_groups, exact_quantiles, meet, pair_counts, running  # noqa: F401
from .study import rank_sum_test

#: Fewest values of a group that allow a recommendation.
MIN_PARTITION = 20


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by a published polynomial (error below 7.5e-8), all in one expression."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def kolmogorov(s: Column) -> Column:
    """Chance of a larger scaled distance, by its series; 1 below 0.2, where it differs from 1 by less than 1e-12."""
    terms = [(-1) ** (k - 1) * F.exp(-2.0 * k * k * s * s) for k in range(1, 21)]
    return F.when(s < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * sum(terms[1:], terms[0]))))


def lilliefors(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Distance of each group to the normal with its mean and SD, and the p of Dallal and Wilkinson; null below five values or without spread."""
    x = df.select(*by, value.cast("double").alias("x")).where("x is not null").groupBy(*by, "x").agg(F.count("*").alias("k"))
    n = F.sum("k")
    mean = F.sum(F.col("x") * F.col("k")) / n
    moments = x.groupBy(*by).agg(n.alias("n"), mean.alias("m"))
    spread = meet(x, moments, by).groupBy(*by).agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum(F.col("k") * F.pow(F.col("x") - F.col("m"), 2.0)).alias("ss"))
    spread = spread.withColumn("sd", F.when((F.col("n") > 4) & (F.col("ss") > 0), F.sqrt(F.col("ss") / (F.col("n") - 1))))
    at = meet(running(x, by, "x", {"k": "upto"}), spread, by).withColumn("f", normal_cdf((F.col("x") - F.col("m")) / F.col("sd")))
    away = F.greatest(F.col("upto") / F.col("n") - F.col("f"), F.col("f") - (F.col("upto") - F.col("k")) / F.col("n"))
    g = at.groupBy(*by).agg(F.first("n").alias("n"), F.max(away).alias("d"))
    k = F.when(F.col("n") <= 100, F.col("d")).otherwise(F.col("d") * F.pow(F.col("n") / 100, F.lit(0.49)))
    m = F.least(F.col("n"), F.lit(100)).cast("double")
    p = F.exp(-7.01256 * k * k * (m + 2.78019) + 2.99587 * k * F.sqrt(m + 2.78019) - 0.122119 + 0.974598 / F.sqrt(m) + 1.67997 / m)
    return g.select(*by, "n", F.round("d", 6).alias("d"), F.round(F.when(F.col("d").isNotNull(), F.least(F.lit(1.0), p)), 6).alias("p"))


def ks_pairs(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """Every pair of at most MAX_GROUPS groups: largest distance of their distributions, and its p."""
    return _ks(pair_counts(df, group, value))


def _ks(pairs: DataFrame) -> DataFrame:
    root = F.sqrt(F.col("n_a").cast("double") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return pairs.select("group_a", "group_b", "n_a", "n_b", F.round("d", 6).alias("d"), F.round(kolmogorov((root + 0.12 + 0.11 / root) * F.col("d")), 6).alias("p"))


def group_difference(df: DataFrame, group: Column, value: Column, alpha: float = 0.05) -> DataFrame:
    """Every pair of groups: Welch, rank and distribution tests, Harris-Boyd's z, the share of the narrower interval that both have, and what to do.

    ``recommendation``: collect_more_data below MIN_PARTITION values; partition_recommended, or a review if the intervals share three
    quarters; review_low_overlap if means agree but intervals share less than a quarter; else combine_ok.
    """
    bounded_groups(df, group)
    x = df.select(group.cast("string").alias("g"), value.cast("double").alias("x")).where("x is not null and g is not null")
    by = ["group_a", "group_b"]
    m = meet(x.groupBy("g").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")), exact_quantiles(x, ["g"], F.col("x"), [0.025, 0.975]), ["g"])
    # At most MAX_GROUPS groups and their pairs: read once.
    once = lambda t: df.sparkSession.createDataFrame([tuple(r) for r in t.collect()], t.schema)
    m, counted = once(m), once(pair_counts(df, group, value))
    a, b = m.alias("a"), m.alias("b")
    va, vb = F.col("a.v") / F.col("a.n"), F.col("b.v") / F.col("b.n")
    ok = (va + vb > 0) & (F.col("a.n") > 1) & (F.col("b.n") > 1)
    t = F.when(ok, (F.col("a.m") - F.col("b.m")) / F.sqrt(va + vb))
    dof = F.when(ok, (va + vb) ** 2 / (va**2 / (F.col("a.n") - 1) + vb**2 / (F.col("b.n") - 1)))
    low, high = F.greatest(F.col("a.q")[0], F.col("b.q")[0]), F.least(F.col("a.q")[1], F.col("b.q")[1])
    narrow = F.least(F.col("a.q")[1] - F.col("a.q")[0], F.col("b.q")[1] - F.col("b.q")[0])

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:  # a row a pair
        return pd.Series([None if pd.isna(s) else 2 * (1 - S.t_cdf(abs(s), d)) for s, d in zip(t, dof, strict=True)])

    pairs = a.join(b, F.col("a.g") < F.col("b.g")).select(F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), t.alias("_t"), dof.alias("_dof"), F.when(narrow > 0, F.greatest(high - low, F.lit(0.0)) / narrow).alias("_overlap"))
    out = pairs.select(*by, F.round(two_sided("_t", "_dof"), 6).alias("welch_p"), F.round("_overlap", 6).alias("overlap"))
    out = meet(out, rank_sum_test(counted).select(*by, F.round("p", 6).alias("mann_whitney_p")), by)
    out = meet(out, _ks(counted).select(*by, "n_a", "n_b", F.col("p").alias("ks_p")), by)
    out = meet(out, harris_boyd(df, [], group, value).select(*by, "z", "z_limit"), by)
    least = F.least("welch_p", "mann_whitney_p", "ks_p")
    split = F.coalesce(F.col("z") > F.col("z_limit"), F.lit(False))
    advice = (
        F.when(F.least("n_a", "n_b") < MIN_PARTITION, "collect_more_data").when(split & (F.col("overlap") >= 0.75), "review_partition_high_overlap").when(split, "partition_recommended")
        .when(F.col("overlap") < 0.25, "review_low_overlap").otherwise("combine_ok")
    )
    decision = F.when(least.isNull(), "not_tested").when(least < alpha, "different_distribution").otherwise("no_significant_difference")
    return out.select(*by, "n_a", "n_b", "welch_p", "mann_whitney_p", "ks_p", "z", "z_limit", "overlap", decision.alias("distribution"), advice.alias("recommendation"))
