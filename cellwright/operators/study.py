"""Study statistics beside reference intervals: sample summaries, overlap, normality, trimming, audits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as S
from ..functions.special import lilliefors_fit as lilliefors
from ..functions import values as V
from .ordering import bounded_groups, pair_counts  # noqa: F401
from .statistics import average_rank, running_sums  # noqa: F401
from .summaries import quantile, quantiles


def sample_summary(df: DataFrame, groups: dict[str, Column], value: str, policy: str = "DELETE", lower: str | None = None, upper: str | None = None, accuracy: int | None = None) -> DataFrame:
    """Overlapping groups (boolean columns): n, missing, censored, mean, SD, quantiles, CV%, geometric mean and SD.

    Each row goes to the groups it is in; a row in none goes nowhere.
    """
    c = F.col(f"`{value}`").cast("string")
    x = V.comparator_value(c, policy)
    member = F.array_compact(F.array(*[F.when(F.coalesce(g, F.lit(False)), k) for k, g in groups.items()]))
    long = df.select(x.alias("x"), (V.strip(V.text(c)) == "").alias("blank"), F.coalesce(V.comparator_sign(c).isin("<", "<=", ">", ">="), F.lit(False)).alias("cens"), F.explode(member).alias("group"))
    ln = F.when(F.col("x") > 0, F.log("x"))
    r = lambda e, a: F.round(e, 6).alias(a)
    g = long.groupBy("group").agg(F.count("*").alias("rows"), F.count("x").alias("n"), F.sum(F.col("blank").cast("bigint")).alias("missing"), F.sum(F.col("cens").cast("bigint")).alias("censored"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), quantiles(F.col("x"), [0.25, 0.5, 0.75], accuracy).alias("q"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg(ln).alias("lm"), F.stddev_samp(ln).alias("ls"), F.min(F.when(F.col("x").isNotNull(), (F.col("x") > 0).cast("int"))).alias("pos"))
    return g.select("group", "rows", "n", "missing", "censored", r(F.col("m"), "mean"), r(F.col("s"), "sd"), r(F.col("q")[0], "q1"), r(F.col("q")[1], "median"), r(F.col("q")[2], "q3"), "min", "max", r(F.when(F.col("m") != 0, 100 * F.col("s") / F.abs("m")), "cv_pct"), r(F.when(F.col("pos") == 1, F.exp("lm")), "geo_mean"), r(F.when(F.col("pos") == 1, F.exp("ls")), "geo_sd"))


def fixed_histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    """Equal bins on a linear or log10 scale; the last bin is closed; values outside are not counted."""
    t = (lambda e: F.log10(e)) if log else (lambda e: e)
    a, b = (math.log10(low), math.log10(high)) if log else (low, high)
    x = df.select(value.cast("double").alias("x")).where((F.col("x") >= low) & (F.col("x") <= high))
    at = F.least(F.floor((t(F.col("x")) - a) / (b - a) * bins), F.lit(bins - 1)).cast("int")
    counts = x.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def gaussian_trim(df: DataFrame, by: list[str], value: Column, k: float = 3.0, rounds: int = 3) -> DataFrame:
    """Drop values beyond k SD of their group's mean, and repeat with what is left."""
    x = df.withColumn("_x", value.cast("double"))
    for _ in range(rounds):
        s = x.groupBy(*by).agg(F.avg("_x").alias("_m"), F.stddev_samp("_x").alias("_s"))
        j = x.join(s, by) if by else x.crossJoin(F.broadcast(s))  # one row
        x = j.where(F.col("_x").isNull() | F.col("_s").isNull() | (F.abs(F.col("_x") - F.col("_m")) <= k * F.col("_s"))).drop("_m", "_s")
    return x.drop("_x")


def share_outside(df: DataFrame, limits: DataFrame, by: list[str], value: Column, allowed: float = 0.10) -> DataFrame:
    """Verification of stated limits (by, low, high): n, outside, share, verdict."""
    x = df.select(*by, value.cast("double").alias("x")).where("x is not null").join(limits.select(*by, "low", "high"), by)
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).cast("bigint")).alias("outside"))
    share = F.col("outside") / F.col("n")
    return g.select(*by, "n", "outside", F.round(share, 6).alias("share"), F.when(share <= allowed, "ACCEPT").otherwise("REVIEW").alias("verdict"))


def interval_overlap(df: DataFrame, by: list[str], group: Column, value: Column, accuracy: int | None = None) -> DataFrame:
    """Share of the joint range that the central 95 % of two groups have in common."""
    q = df.select(*by, group.cast("string").alias("g"), value.cast("double").alias("x")).where("x is not null and g is not null").groupBy(*by, "g").agg(quantiles(F.col("x"), [0.025, 0.975], accuracy).alias("q"))
    a, b = q.alias("a"), q.alias("b")
    on = F.col("a.g") < F.col("b.g")
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    common = F.greatest(F.least(F.col("a.q")[1], F.col("b.q")[1]) - F.greatest(F.col("a.q")[0], F.col("b.q")[0]), F.lit(0.0))
    joint = F.greatest(F.col("a.q")[1], F.col("b.q")[1]) - F.least(F.col("a.q")[0], F.col("b.q")[0])
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in by], F.col("a.g").alias("group_a"), F.col("b.g").alias("group_b"), F.round(F.when(joint > 0, common / joint), 6).alias("overlap"))


def shape(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Skewness, bias-corrected skewness and excess kurtosis."""
    x = value.cast("double")
    n = F.count(x)
    return df.groupBy(*by).agg(n.alias("n"), F.round(F.skewness(x), 6).alias("skewness"), F.round(F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)), 6).alias("skewness_corrected"), F.round(F.kurtosis(x), 6).alias("kurtosis"))


def dagostino(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """D'Agostino and Pearson's K2 from skewness and kurtosis, with its p; null below 20 values or without spread.  Moments alone, in one aggregate."""
    x = value.cast("double")
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.skewness(x).alias("_g1"), (F.kurtosis(x) + 3).alias("_b2"))
    n, g1, b2 = F.col("n").cast("double"), F.col("_g1"), F.col("_b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    apart = (b2 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + F.sqrt(1 + 4 / (skew * skew)))
    inner = (1 - 2 / a) / (1 + apart * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.cbrt(F.abs(inner))) / F.sqrt(2 / (9 * a))
    k2 = F.when((F.col("n") >= 20) & g1.isNotNull() & ~F.isnan(g1), z1 * z1 + z2 * z2)
    return g.select(*by, "n", F.round(k2, 6).alias("k2"), F.round(F.exp(-k2 / 2), 8).alias("p"))


def normality(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Shapiro-Wilk and Lilliefors on each partition of a study (12 to 5,000 values)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(dtype=float)
        w, p = S.shapiro_wilk(x) if 12 <= len(x) <= 5000 and np.ptp(x) > 0 else (None, None)
        d, q = lilliefors(x) if len(x) > 4 and np.ptp(x) > 0 else (None, None)
        return pd.DataFrame([[*pdf[by].iloc[0], len(x), w, p, d, q]], columns=[*by, "n", "shapiro_w", "shapiro_p", "lilliefors_d", "lilliefors_p"])

    x = df.select(*by, value.cast("double").alias("x")).where("x is not null")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.select(*by).schema)
    return x.groupBy(*by).applyInPandas(one, f"{fields}, n bigint, shapiro_w double, shapiro_p double, lilliefors_d double, lilliefors_p double")


def wilcoxon_partition(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """Two groups: rank sum and z without corrections.  More groups are refused; :func:`wilcoxon_pairs` takes any number, with p."""
    x = df.select(group.cast("string").alias("g"), value.cast("double").alias("x")).where("x is not null and g is not null")
    s = average_rank(x, "x", "rank").groupBy("g").agg(F.count("*").alias("n"), F.sum("rank").alias("w"))
    two = s.agg(F.count("*").alias("groups"), F.min_by("g", "g").alias("group_a"), F.max_by("g", "g").alias("group_b"), F.min_by("n", "g").alias("n_a"), F.max_by("n", "g").alias("n_b"), F.min_by("w", "g").alias("w"))
    n = F.col("n_a") + F.col("n_b")
    z = (F.col("w") - F.col("n_a") * (n + 1) / 2) / F.sqrt(F.col("n_a").cast("double") * F.col("n_b") * (n + 1) / 12)
    w = F.when(F.col("groups") > 2, F.raise_error(F.lit("more than two groups: use wilcoxon_pairs")).cast("double")).otherwise(F.col("w"))
    return two.select("group_a", "group_b", "n_a", "n_b", F.round(w, 6).alias("rank_sum"), F.round(z, 6).alias("z"))


def wilcoxon_pairs(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """Every pair of groups: rank sum of the first, z with tie and continuity correction, two-sided p.

    Ranks are taken within the pair, from counts of distinct values: a pair sees one row per value and group.
    z is the distance from the mean rank sum less 1/2, never beyond 0; without variance z is 0 and p 1.  More than 64 groups are refused.
    """
    return rank_sum_test(pair_counts(df, group, value))


def rank_sum_test(g: DataFrame) -> DataFrame:
    """The test from n_a, n_b, w and ties of each pair (see ``ordering.pair_counts``)."""
    by = ["group_a", "group_b"]
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = a + b
    off = F.col("w") - a * (n + 1) / 2
    var = a * b / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.when(var > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / F.sqrt(var)).otherwise(F.lit(0.0))

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)))

    return g.select(*by, "n_a", "n_b", F.round("w", 6).alias("rank_sum"), z.alias("_z")).select(*by, "n_a", "n_b", "rank_sum", F.round("_z", 6).alias("z"), F.round(p("_z"), 8).alias("p"))


def input_audit(df: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """First reason for which a row is left out, or INCLUDED, with counts."""
    reason = None
    for name, bad in tests:
        hit = F.coalesce(bad, F.lit(False))
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return df.groupBy((reason.otherwise("INCLUDED") if reason is not None else F.lit("INCLUDED")).alias("reason")).agg(F.count("*").alias("n"))


def partition_sets(df: DataFrame, keys: list[str], value: Column, accuracy: int | None = None) -> DataFrame:
    """All levels of partitioning at once: none, each key, all keys."""
    x = df.select(*keys, value.cast("double").alias("x")).where("x is not null")
    return x.rollup(*keys).agg(F.count("*").alias("n"), F.round(quantile(F.col("x"), 0.025, accuracy), 6).alias("low"), F.round(quantile(F.col("x"), 0.975, accuracy), 6).alias("high"))
