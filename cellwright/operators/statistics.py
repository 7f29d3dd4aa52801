"""Statistical operators.  Sums and ranks stay in SQL; numpy is called per group only for what is iterative."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as S
from ..functions import values as V
from .ordering import kendall, passing_bablok, select_slope


def pair_methods(df: DataFrame, keys: list[str], method: str, value: Column, a: str, b: str) -> DataFrame:
    """Complete pairs (keys, x, y) of two methods; repeated results of a key are averaged."""
    v = value.cast("double")
    g = df.where(F.col(method).isin(a, b)).groupBy(*keys).agg(F.avg(F.when(F.col(method) == a, v)).alias("x"), F.avg(F.when(F.col(method) == b, v)).alias("y"))
    return g.where("x is not null and y is not null")


def deming(pairs: DataFrame, by: list[str], ratio: float = 1.0) -> DataFrame:
    """Slope and intercept with error variances in a given ratio, the correlation, and the ordinary slope."""
    s = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"), F.covar_samp("x", "y").alias("sxy"))
    d = F.col("syy") - ratio * F.col("sxx")
    slope = F.when(F.col("sxy") != 0, (d + F.sqrt(d * d + 4 * ratio * F.col("sxy") * F.col("sxy"))) / (2 * F.col("sxy")))
    s = s.withColumn("b", slope)
    r = lambda c, a: F.round(c, 6).alias(a)
    return s.select(*by, "n", r(F.col("b"), "slope"), r(F.col("my") - F.col("b") * F.col("mx"), "intercept"), r(F.when(F.col("sxx") * F.col("syy") > 0, F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))), "r"), r(F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")), "ols_slope"))


def bland_altman(pairs: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("y") - F.col("x")
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return g.select(*by, "n", F.round("m", 6).alias("bias"), F.round("s", 6).alias("sd"), F.round(F.col("m") - 1.96 * F.col("s"), 6).alias("low"), F.round(F.col("m") + 1.96 * F.col("s"), 6).alias("high"))


def t_quantile_column(p: float, df: Column) -> Column:
    """Student quantile for a column of degrees of freedom: Arrow batches over small result tables."""

    @F.pandas_udf("double")
    def q(s: pd.Series) -> pd.Series:
        known = {v: S.t_quantile(p, float(v)) for v in s.dropna().unique() if v > 0}
        return s.map(known).astype("float64")

    return q(df.cast("double"))


def mean_bias(pairs: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Mean difference with its t interval, absolute and in percent of the first method's mean."""
    d = F.col("y") - F.col("x")
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.avg("x").alias("mx"))
    half = t_quantile_column((1 + confidence) / 2, F.col("n") - 1) * F.col("s") / F.sqrt("n")
    r = lambda c, a: F.round(c, 6).alias(a)
    return g.withColumn("h", half).select(*by, "n", r(F.col("m"), "bias"), r(F.when(F.col("mx") != 0, 100 * F.col("m") / F.col("mx")), "bias_pct"), r(F.col("m") - F.col("h"), "low"), r(F.col("m") + F.col("h"), "high"))


def predicted_bias(fit: DataFrame, points: list[float]) -> DataFrame:
    """What a fitted line (slope, intercept) says of the difference at given concentrations."""
    at = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("at")
    b = F.col("intercept") + (F.col("slope") - 1) * F.col("at")
    return fit.select("*", at).withColumn("bias", F.round(b, 6)).withColumn("bias_pct", F.round(F.when(F.col("at") != 0, 100 * b / F.col("at")), 6))


class Tables(Mapping):
    """Tables by name, each built when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def method_comparison(df: DataFrame, keys: list[str], by: list[str], method: str, value: Column, a: str, b: str, points: list[float] = (), ratio: float = 1.0) -> Mapping[str, DataFrame]:
    """All tables of a comparison of two methods over one paired base; the search for slope medians runs only if its lines are read."""
    pairs = pair_methods(df, list(dict.fromkeys([*by, *keys])), method, value, a, b)
    lines = {"deming": lambda: deming(pairs, by, ratio), "passing_bablok": lambda: passing_bablok(pairs, by)}
    out = {"pairs": lambda: pairs, **lines, "bland_altman": lambda: bland_altman(pairs, by), "bias": lambda: mean_bias(pairs, by)}
    tables = Tables(out | {f"{k}_predicted": (lambda k=k: predicted_bias(tables[k], list(points))) for k in lines if points})
    return tables


def passing_bablok_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Shifted median of the slopes, and the median intercept, of points in memory."""
    slope = select_slope(x, y)
    return slope, float(np.median(y - slope * x))


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """One row per pair.  Spearman is Pearson on average ranks of the rows in which both are known; Kendall is tau-b from counts of falling pairs.

    Where no column has a missing value all pairs share the ranks: each column is ranked once.
    """
    x = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    both = lambda i, j: F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown method {method}")
    if method == "kendall":
        return reduce(DataFrame.unionByName, [kendall(x, [], f"v{i}", f"v{j}").select(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), "n", F.col("tau").alias("r")) for i, j in pairs])
    if method == "spearman":
        if not x.where(" or ".join(f"v{i} is null" for i in range(len(columns)))).isEmpty():
            parts = []
            for i, j in pairs:
                p = average_rank(average_rank(x.where(both(i, j)).select(f"v{i}", f"v{j}"), f"v{i}", "x"), f"v{j}", "y")
                parts.append(p.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("r")).select(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), "n", "r"))
            return reduce(DataFrame.unionByName, parts)
        for i in range(len(columns)):
            x = average_rank(x, f"v{i}", f"r{i}")
        x = x.select(*[F.col(f"r{i}").alias(f"v{i}") for i in range(len(columns))])
    known = {(i, j): both(i, j) for i, j in pairs}
    one = x.agg(*[F.struct(F.count(F.when(k, 1)).alias("n"), F.round(F.corr(F.when(k, F.col(f"v{i}")), F.when(k, F.col(f"v{j}"))), 6).alias("r")).alias(f"p{i}_{j}") for (i, j), k in known.items()])
    rows = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"p{i}_{j}.n").alias("n"), F.col(f"p{i}_{j}.r").alias("r")) for i, j in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by: list[str] = (), descending: bool = False, buckets: int = 128) -> DataFrame:
    """Running totals ``sums`` (column -> name) in the order of a numeric column with distinct values in each group.

    Without groups a plain window would sort all rows in one task.  Here approximate quantiles cut the order into buckets;
    each bucket adds its own running total to the total of the buckets before it (a table of at most ``buckets`` rows).
    """
    step = F.col(order).desc() if descending else F.col(order).asc()
    if by:
        w = Window.partitionBy(*by).orderBy(step)
        return df.withColumns({n: F.sum(c).over(w) for c, n in sums.items()})
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000).alias("_cuts"))
    at = F.coalesce(F.size(F.filter("_cuts", lambda v: v < F.col(order))), F.lit(0))
    cut = df.crossJoin(F.broadcast(cuts)).withColumn("_b", -at if descending else at).drop("_cuts")  # one row
    every = cut.groupBy("_b").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select("_b", *[F.coalesce(F.sum(f"_s{i}").over(ahead), F.lit(0)).alias(f"_a{i}") for i in range(len(sums))])
    w = Window.partitionBy("_b").orderBy(step)
    out = cut.join(F.broadcast(before), "_b").withColumns({n: F.col(f"_a{i}") + F.sum(c).over(w) for i, (c, n) in enumerate(sums.items())})
    return out.drop("_b", *[f"_a{i}" for i in range(len(sums))])


def rank_by_count(df: DataFrame, value: str, count: str, name: str, buckets: int = 128) -> DataFrame:
    """Place of each text by falling count, then by the text, without sorting all rows in one task.

    Texts are cut into buckets by their first bytes as a number, which keeps their order; places run within (count, bucket), after
    all rows of larger counts and earlier buckets.
    """
    head = F.conv(F.rpad(F.hex(F.substring(F.col(value).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("bigint")
    x = df.withColumn("_head", head)
    cuts = x.agg(F.percentile_approx("_head", [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"))
    x = x.crossJoin(F.broadcast(cuts)).withColumn("_b", F.coalesce(F.size(F.filter("_cuts", lambda v: v < F.col("_head"))), F.lit(0))).drop("_cuts", "_head")  # one row
    x = x.withColumn("_k", (F.col("_b") - F.col(count) * buckets).cast("double"))
    ahead = running_sums(x.groupBy("_k").agg(F.count("*").alias("_n")), "_k", {"_n": "_upto"})
    place = F.row_number().over(Window.partitionBy("_k").orderBy(value)) + F.col("_upto") - F.col("_n")
    return x.join(ahead, "_k").withColumn(name, place.cast("bigint")).drop("_k", "_b", "_n", "_upto")


def carry(df: DataFrame, seen: Column, order: str, name: str, by: list[str] = (), backward: bool = False, buckets: int = 128) -> DataFrame:
    """The last known value of ``seen`` (null where unknown) up to each row in the order of a numeric column, or the next one.

    Without groups the order is cut into buckets by approximate quantiles: each bucket carries its own values, and starts with what
    the buckets before it end with (a table of at most ``buckets`` rows).
    """
    step = F.col(order).desc() if backward else F.col(order).asc()
    if by:
        w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(seen, ignorenulls=True).over(w))
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / buckets for i in range(1, buckets)], 1000).alias("_cuts"))
    at = F.coalesce(F.size(F.filter("_cuts", lambda v: v < F.col(order))), F.lit(0))
    cut = df.withColumn("_seen", seen).crossJoin(F.broadcast(cuts)).withColumn("_b", -at if backward else at).drop("_cuts")  # one row
    key = F.when(F.col("_seen").isNotNull(), -F.col(order) if backward else F.col(order))
    ends = cut.groupBy("_b").agg(F.max_by("_seen", key).alias("_end"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    starts = ends.select("_b", F.last("_end", ignorenulls=True).over(ahead).alias("_start"))
    w = Window.partitionBy("_b").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(starts), "_b").withColumn(name, F.coalesce(F.last("_seen", ignorenulls=True).over(w), F.col("_start")))
    return out.drop("_b", "_seen", "_start")


def average_rank(df: DataFrame, column: str, name: str, by: list[str] = ()) -> DataFrame:
    """Ranks over distinct values, so that only one row per value is sorted, joined back to the rows."""
    d = running_sums(df.groupBy(*by, column).agg(F.count("*").alias("_n")), column, {"_n": "_upto"}, by)
    return df.join(d.select(*by, column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), [*by, column])


def roc_curve(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """One row per distinct score: sensitivity and specificity of score >= threshold, and Youden's index."""
    g = df.select(score.cast("double").alias("t"), positive.cast("int").alias("p")).where("t is not null and p is not null").groupBy("t").agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("neg"))
    total = F.broadcast(g.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")))  # one row
    c = running_sums(g, "t", {"pos": "tp", "neg": "fp"}, descending=True).crossJoin(total)
    sens, spec = F.col("tp") / F.col("all_pos"), 1 - F.col("fp") / F.col("all_neg")
    return c.select(F.col("t").alias("threshold"), F.round(sens, 6).alias("sensitivity"), F.round(spec, 6).alias("specificity"), F.round(sens + spec - 1, 6).alias("youden"))


def roc_auc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Area under the curve from average ranks."""
    r = average_rank(df.select(score.cast("double").alias("t"), positive.cast("int").alias("p")).where("t is not null and p is not null"), "t", "rank")
    g = r.agg(F.sum(F.when(F.col("p") == 1, F.col("rank"))).alias("s"), F.sum("p").cast("bigint").alias("pos"), F.sum(1 - F.col("p")).cast("bigint").alias("neg"))
    return g.select("pos", "neg", F.round((F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg")), 6).alias("auc"))


def rank_sums(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """n, rank sum and U of each group against the rest."""
    x = df.select(group.cast("string").alias("g"), value.cast("double").alias("x")).where("x is not null and g is not null")
    s = average_rank(x, "x", "rank").groupBy("g").agg(F.count("*").alias("n"), F.sum("rank").alias("rank_sum"))
    return s.select("g", "n", F.round("rank_sum", 6).alias("rank_sum"), F.round(F.col("rank_sum") - F.col("n") * (F.col("n") + 1) / 2, 6).alias("u"))


def group_test(df: DataFrame, group: Column, value: Column) -> dict[str, float]:
    """Two groups: Welch, Mann-Whitney, Cohen's d, rank-biserial; more: Kruskal-Wallis.

    Moments, rank sums and tie counts come from aggregates; only one row per group reaches the driver.
    """
    x = df.select(group.cast("string").alias("g"), value.cast("double").alias("x")).where("x is not null and g is not null")
    m = x.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v")).join(rank_sums(df, group, value).select("g", "rank_sum", "u"), "g").orderBy("g").collect()
    ties = x.groupBy("x").agg(F.count("*").alias("t")).agg(F.sum(F.pow(F.col("t").cast("double"), 3.0) - F.col("t")).alias("t3")).first().t3 or 0.0
    n = sum(r.n for r in m)
    if len(m) == 2:
        a, b = m
        va, vb = a.v / a.n, b.v / b.n
        t, dof = (a.m - b.m) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
        var = a.n * b.n / 12 * (n + 1 - ties / (n * (n - 1)))
        z = (abs(a.u - a.n * b.n / 2) - 0.5) / math.sqrt(var)
        sp = math.sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (n - 2))
        return {"welch_t": t, "welch_df": dof, "welch_p": 2 * (1 - S.t_cdf(abs(t), dof)), "u": a.u, "mann_whitney_p": min(1.0, 2 * (1 - S.normal_cdf(max(z, 0)))), "cohen_d": (a.m - b.m) / sp, "rank_biserial": 2 * a.u / (a.n * b.n) - 1}
    h = (12 / (n * (n + 1)) * sum(r.rank_sum**2 / r.n for r in m) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return {"kruskal_h": h, "p": S.chi2_sf(h, len(m) - 1)}


def survey_mean(df: DataFrame, value: Column, weight: Column, stratum: Column, psu: Column, domain: Column | None = None) -> DataFrame:
    """Design-based mean of a domain with its linearised standard error (with-replacement PSUs within strata)."""
    inside = F.coalesce(domain, F.lit(False)) if domain is not None else F.lit(True)
    use = F.when(inside & value.isNotNull(), weight.cast("double")).otherwise(0.0)
    x = df.select(F.coalesce(value.cast("double"), F.lit(0.0)).alias("y"), use.alias("w"), stratum.alias("h"), psu.alias("i"))
    p = x.groupBy("h", "i").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum((F.col("w") > 0).cast("bigint")).alias("n"))
    total = p.agg(F.sum("w").alias("all_w"), F.sum("wy").alias("all_wy"), F.sum("n").alias("all_n"), F.count(F.when(F.col("n") > 0, 1)).alias("psus"), F.count_distinct(F.when(F.col("n") > 0, F.col("h"))).alias("strata"))
    mean = F.col("all_wy") / F.col("all_w")
    z = p.crossJoin(F.broadcast(total)).withColumn("z", (F.col("wy") - F.col("w") * mean) / F.col("all_w"))  # one row
    v = z.groupBy("h").agg(F.count("*").alias("k"), F.var_pop("z").alias("v")).agg(F.sum(F.when(F.col("k") > 1, F.col("k") * F.col("k") / (F.col("k") - 1) * F.col("v"))).alias("var"))
    return total.crossJoin(F.broadcast(v)).select(F.col("all_n").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt("var"), 8).alias("se"), (F.col("psus") - F.col("strata")).alias("df"))


def survey_contrast(df: DataFrame, value: Column, weight: Column, stratum: Column, psu: Column, a: Column, b: Column) -> DataFrame:
    """Difference of two domains' means with the covariance of shared PSUs."""
    part = lambda d: F.when(F.coalesce(d, F.lit(False)) & value.isNotNull(), weight.cast("double")).otherwise(0.0)
    x = df.select(F.coalesce(value.cast("double"), F.lit(0.0)).alias("y"), part(a).alias("wa"), part(b).alias("wb"), stratum.alias("h"), psu.alias("i"))
    p = x.groupBy("h", "i").agg(*[F.sum(c).alias(c) for c in ("wa", "wb")], *[F.sum(F.col(c) * F.col("y")).alias(c + "y") for c in ("wa", "wb")])
    t = p.agg(*[F.sum(c).alias("T" + c) for c in ("wa", "wb", "way", "wby")])
    m = lambda k: F.col(f"T{k}y") / F.col(f"T{k}")
    z = lambda k: (F.col(k + "y") - F.col(k) * m(k)) / F.col("T" + k)
    s = p.crossJoin(F.broadcast(t)).withColumn("z", z("wa") - z("wb"))
    v = s.groupBy("h").agg(F.count("*").alias("k"), F.var_pop("z").alias("v")).agg(F.sum(F.when(F.col("k") > 1, F.col("k") * F.col("k") / (F.col("k") - 1) * F.col("v"))).alias("var"))
    return t.crossJoin(F.broadcast(v)).select(F.round(m("wa"), 6).alias("mean_a"), F.round(m("wb"), 6).alias("mean_b"), F.round(m("wa") - m("wb"), 6).alias("difference"), F.round(F.sqrt("var"), 8).alias("se"))


def missingness_bounds(df: DataFrame, value: Column, weight: Column, lower: float, upper: float) -> DataFrame:
    w, v = weight.cast("double"), value.cast("double")
    mean = lambda fill: F.round(F.sum(w * F.coalesce(v, F.lit(fill))) / F.sum(w), 6)
    return df.agg(F.count("*").alias("n"), F.sum(v.isNull().cast("bigint")).alias("missing"), mean(float(lower)).alias("low"), mean(float(upper)).alias("high"))


def least_squares(df: DataFrame, y: str, xs: list[str], cluster: str | None = None) -> pd.DataFrame:
    """OLS with an intercept; HC3 or cluster-robust errors.  Cross products are aggregates of fixed size."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(cols)
    base = df.select(F.col(y).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(cols)], *([F.col(cluster).alias("g")] if cluster else [])).where(" and ".join(["y is not null", *[f"x{i} is not null" for i in range(k)]]))
    one = base.agg(F.count("*").alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(k)]).first()
    xx = np.asarray([[one[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inv = np.linalg.inv(xx)
    beta = inv @ np.asarray([one[f"t{i}"] for i in range(k)])
    fit = sum((F.col(f"x{i}") * float(beta[i]) for i in range(1, k)), F.lit(float(beta[0])))
    e = F.col("y") - fit
    if cluster:
        u = base.groupBy("g").agg(*[F.sum(e * F.col(f"x{i}")).alias(f"u{i}") for i in range(k)])
        m = u.agg(F.count("*").alias("g"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        scale, dof = m.g / (m.g - 1) * (one.n - 1) / (one.n - k), m.g - 1
    else:
        h = sum((float(inv[i, j]) * F.col(f"x{i}") * F.col(f"x{j}") for i in range(k) for j in range(k)), F.lit(0.0))
        w = e / (1 - h)
        m = base.agg(*[F.sum(w * w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        scale, dof = 1.0, one.n - k
    meat = np.asarray([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    se = np.sqrt(np.diag(inv @ meat @ inv) * scale)
    q = S.t_quantile(0.975, dof)
    return pd.DataFrame({"term": ["intercept", *xs], "estimate": beta, "se": se, "low": beta - q * se, "high": beta + q * se, "p": [2 * (1 - S.t_cdf(abs(b / s), dof)) for b, s in zip(beta, se, strict=True)], "n": one.n})


def survey_regression(df: DataFrame, y: str, xs: list[str], weight: str, stratum: str, psu: str, domain: Column | None = None) -> pd.DataFrame:
    """Weighted least squares with linearised errors: with-replacement PSUs within strata, degrees of freedom PSUs - strata.

    Rows outside the domain, or with anything missing, weigh nothing but keep their PSU in the design.  Cross products and one
    score per PSU are aggregated; only sums of fixed size reach the driver.
    """
    k = len(xs) + 1
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    whole = V.all_of([F.col(c).isNotNull() for c in (y, *xs, weight)]) & (F.coalesce(domain, F.lit(False)) if domain is not None else F.lit(True))
    base = df.select(F.when(whole, F.col(weight).cast("double")).otherwise(0.0).alias("w"), F.when(whole, F.col(y).cast("double")).otherwise(0.0).alias("y"), *[F.when(whole, c).otherwise(0.0).alias(f"x{i}") for i, c in enumerate(cols)], F.col(stratum).alias("h"), F.col(psu).alias("i"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = base.agg(F.sum((F.col("w") > 0).cast("bigint")).alias("n"), *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs], *[F.sum(F.col("w") * F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(k)]).first()
    square = lambda row, name: np.asarray([[row[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    inv = np.linalg.inv(square(s, "s"))
    beta = inv @ np.asarray([s[f"t{i}"] for i in range(k)], dtype=float)
    e = F.col("y") - reduce(lambda a, b: a + b, [F.col(f"x{i}") * float(b) for i, b in enumerate(beta)])
    scores = base.groupBy("h", "i").agg(*[F.sum(F.col("w") * e * F.col(f"x{i}")).alias(f"u{i}") for i in range(k)], F.sum((F.col("w") > 0).cast("bigint")).alias("n"))
    strata = scores.groupBy("h").agg(F.count("*").alias("m"), F.sum((F.col("n") > 0).cast("int")).alias("used"), *[(F.covar_pop(f"u{i}", f"u{j}") * F.count("*")).alias(f"c{i}_{j}") for i, j in pairs])
    scale = F.when(F.col("m") > 1, F.col("m") / (F.col("m") - 1)).otherwise(0.0)
    m = strata.agg(F.sum("used").alias("psus"), F.sum((F.col("used") > 0).cast("int")).alias("strata"), *[F.sum(scale * F.col(f"c{i}_{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    dof = m.psus - m.strata
    se = np.sqrt(np.diag(inv @ square(m, "m") @ inv))
    q = S.t_quantile(0.975, dof) if dof > 0 else math.nan
    p = [2 * (1 - S.t_cdf(abs(b / v), dof)) if dof > 0 and v > 0 else math.nan for b, v in zip(beta, se, strict=True)]
    return pd.DataFrame({"term": ["intercept", *xs], "estimate": beta, "se": se, "low": beta - q * se, "high": beta + q * se, "p": p, "df": dof, "n": s.n})
