"""Descriptive operators: one aggregation pass each, groups pre-aggregated before the shuffle where the function allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .ordering import exact_quantiles, meet
from .statistics import rank_by_count

#: An accuracy: exact, by rounds (see ``ordering.exact_quantiles``).
ROUNDS = 0
#: Fixed values.
PERCENTILES = [0, 1, 2.5, 5, 10, 25, 50, 75, 90, 95, 97.5, 99, 100]


def quantile(x: Column, p: float, accuracy: int | None = None) -> Column:
    """Exact by default, from counts of distinct values in memory; with an accuracy, a mergeable sketch of bounded
    size for groups with too many distinct values to hold (accuracy 10,000: rank error below 0.01 %).  The tables of percentiles,
    bands and results take ``accuracy=ROUNDS`` as well: exact for groups of any size, in a few rounds of counts by range."""
    return F.percentile(x, p) if accuracy is None else F.percentile_approx(x, p, accuracy).cast("double")


def quantiles(x: Column, ps: list[float], accuracy: int | None = None) -> Column:
    """An array of quantiles, exact or from one sketch."""
    return F.percentile(x, F.array(*[F.lit(p) for p in ps])) if accuracy is None else F.percentile_approx(x, list(ps), accuracy).cast("array<double>")


def label(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "_")


def number_stats(x: Column, percentiles: list[float] = (25, 50, 75, 2.5, 97.5), digits: int = 6, sd_of_one: float | None = None, accuracy: int | None = None) -> list[Column]:
    sd = F.stddev_samp(x) if sd_of_one is None else F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(sd_of_one)))
    rounded = lambda c, a: F.round(c, digits).alias(a)
    # One aggregate for all quantiles: each by itself would hold the group's distinct values again.
    q = quantiles(x, [p / 100 for p in percentiles], accuracy) if percentiles else None
    return [F.count(x).alias("n"), rounded(F.avg(x), "mean"), rounded(sd, "sd"), F.min(x).alias("min"), *[rounded(q[i], label(p)) for i, p in enumerate(percentiles)], F.max(x).alias("max")]


def state_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, and the number of cells in each of the five states."""
    one = df.agg(*[F.sum((V.state(F.col(f"`{c}`").cast("string")) == s).cast("bigint")).alias(f"{i}_{s}") for i, c in enumerate(columns) for s in V.STATES])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.coalesce(F.col(f"{i}_{s}"), F.lit(0)).alias(s.lower()) for s in V.STATES]) for i, c in enumerate(columns)])).alias("r")
    return one.select(rows).select("r.*")


def describe(df: DataFrame, numeric: list[str], categorical: list[str] = (), digits: int = 6, accuracy: int | None = None) -> DataFrame:
    """One row per column, all in one pass; quantiles of numbers, distinct counts of the others."""
    parts, rows = [], []
    for i, c in enumerate([*numeric, *categorical]):
        col = F.col(f"`{c}`")
        x = col.cast("double") if dict(df.dtypes)[c] != "string" else V.strict_number(col)
        is_num = i < len(numeric)
        stats = [*number_stats(x, PERCENTILES[1:-1], digits, accuracy=accuracy)] if is_num else [F.count(F.nullif(V.strip(col.cast("string")), F.lit(""))).alias("n")]
        stats.append(F.count_distinct(F.nullif(V.strip(col.cast("string")), F.lit(""))).alias("distinct"))
        stats += [F.sum((V.state(col.cast("string")) == s).cast("bigint")).alias(s.lower()) for s in V.STATES]
        parts.append(F.struct(*stats).alias(f"c{i}"))
        names = ["n", "mean", "sd", "min", *[label(p) for p in PERCENTILES[1:-1]], "max", "distinct", *[s.lower() for s in V.STATES]]
        have = set(names) if is_num else {"n", "distinct", *[s.lower() for s in V.STATES]}
        whole = {"n", "distinct", *[s.lower() for s in V.STATES]}
        rows.append(F.struct(F.lit(c).alias("column"), *[(F.col(f"c{i}")[n] if n in have else F.lit(None)).cast("bigint" if n in whole else "double").alias(n) for n in names]))
    return df.agg(*parts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def category_distribution(df: DataFrame, column: str) -> DataFrame:
    """value, count, % of non-missing and of all rows, rank by falling count then value."""
    c = F.nullif(V.text(F.col(f"`{column}`")), F.lit(""))
    counts = df.groupBy(c.alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("count"))).alias("known"))  # one row
    ranked = rank_by_count(counts.where("value is not null"), "value", "count", "rank")
    share = lambda n: F.round(100 * F.col("count") / F.col(n), 6)
    return ranked.crossJoin(F.broadcast(total)).select("value", "count", share("known").alias("pct_known"), share("rows").alias("pct_rows"), "rank")


def percentile_table(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Long form: column, percentile, value, n."""
    ps = [p / 100 for p in PERCENTILES]
    if accuracy == ROUNDS:
        each = [exact_quantiles(df, [], F.col(f"`{c}`"), ps).select(F.struct("q", "n").alias(f"c{i}")) for i, c in enumerate(columns)]
        wide = reduce(DataFrame.crossJoin, each)  # a row each
    else:
        wide = df.agg(*[F.struct(quantiles(F.col(f"`{c}`").cast("double"), ps, accuracy).alias("q"), F.count(f"`{c}`").alias("n")).alias(f"c{i}") for i, c in enumerate(columns)])

    def long(i: int, c: str) -> Column:
        pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in PERCENTILES]).alias("p"), F.col(f"c{i}")["q"].alias("v"))
        return F.transform(pairs, lambda z: F.struct(F.lit(c).alias("column"), z["p"].alias("percentile"), F.round(z["v"], 6).alias("value"), F.col(f"c{i}")["n"].alias("n")))

    return wide.select(F.explode(F.flatten(F.array(*[long(i, c) for i, c in enumerate(columns)]))).alias("r")).select("r.*")


def percentile_bands(df: DataFrame, column: str, percentiles: list[float] = PERCENTILES[1:-1], accuracy: int | None = None) -> DataFrame:
    """Counts in (low, high] between neighbouring percentiles; the first band has no lower bound."""
    x = F.col(f"`{column}`").cast("double")
    ps = [p / 100 for p in percentiles]
    cuts = exact_quantiles(df, [], x, ps).select("q") if accuracy == ROUNDS else df.agg(quantiles(x, ps, accuracy).alias("q"))
    held = df.select(x.alias("x")).where("x is not null").crossJoin(F.broadcast(cuts))
    band = F.coalesce(F.array_min(F.filter(F.transform("q", lambda v, i: F.when(F.col("x") <= v, i)), lambda i: i.isNotNull())), F.lit(len(percentiles)))
    names = F.array(*[F.lit(s) for s in [f"<=p{percentiles[0]:g}", *[f"p{a:g}-p{b:g}" for a, b in zip(percentiles, percentiles[1:], strict=False)], f">p{percentiles[-1]:g}"]])
    return held.groupBy(band.alias("i")).agg(F.count("*").alias("n")).select(F.element_at(names, (F.col("i") + 1).cast("int")).alias("band"), "n")


def result_by(df: DataFrame, value: Column, by: dict[str, Column], item: Column, percentiles=(2.5, 50, 97.5), accuracy: int | None = None) -> DataFrame:
    """Summary for each item by each level of each column, and over all levels."""
    base = df.select(value.cast("double").alias("x"), item.alias("item"), F.explode(F.array(F.struct(F.lit("all").alias("by"), F.lit("all").alias("level")), *[F.struct(F.lit(k).alias("by"), c.cast("string").alias("level")) for k, c in by.items()])).alias("g"))
    if accuracy != ROUNDS:
        return base.groupBy("item", "g.by", "g.level").agg(*number_stats(F.col("x"), percentiles, accuracy=accuracy))
    keys = ["item", "by", "level"]
    base = base.select("x", "item", "g.*")
    plain = base.groupBy(*keys).agg(*number_stats(F.col("x"), ()))
    met = meet(plain, exact_quantiles(base, keys, F.col("x"), [p / 100 for p in percentiles]).drop("n"), keys, "left")
    return met.select(*keys, "n", "mean", "sd", "min", *[F.round(F.col("q")[i], 6).alias(label(p)) for i, p in enumerate(percentiles)], "max")


def histogram(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Equal-width right-closed bins by group, k = min(12, max(4, floor(sqrt n))), with empty bins."""
    x = df.select(*group, value.cast("double").alias("x")).where("x is not null")
    span = x.groupBy(*group).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    span = span.withColumn("k", F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.sqrt("n")))).cast("int")).withColumn("flat", F.col("lo") == F.col("hi"))
    pad = F.when(F.col("lo") != 0, F.abs("lo") * 0.001).otherwise(0.001)
    span = span.withColumn("hi", F.when(F.col("flat"), F.col("hi") + pad).otherwise(F.col("hi"))).withColumn("lo", F.when(F.col("flat"), F.col("lo") - pad).otherwise(F.col("lo")))
    at = F.least(F.greatest(F.ceil((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k")), F.lit(1)), F.col("k")).cast("int")
    counts = x.join(span, group).groupBy(*group, at.alias("bin")).agg(F.count("*").alias("count"))
    every = span.select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("bin"))
    edge = lambda i: F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.col("k"), 6)
    return every.join(counts, [*group, "bin"], "left").select(*group, "bin", edge(F.col("bin") - 1).alias("low"), edge(F.col("bin")).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def grouping_sets(df: DataFrame, keys: list[str], value: Column, accuracy: int | None = None) -> DataFrame:
    return df.cube(*keys).agg(F.grouping_id().cast("bigint").alias("level"), *number_stats(value, (50,), accuracy=accuracy))
