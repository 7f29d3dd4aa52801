"""Order statistics of groups of any size: exact quantiles, inversions, Kendall's tau, slope medians.

A group is never sorted or held in one task.  Approximate quantiles cut its values into at most 2 x CUTS + 1 ranges (a cut is a range of its
own, so that a value that many rows share is no task's burden); counts by range say where an exact answer lies, and only
rows of such ranges are looked at again.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cuts of a group, accuracy of their search, rows of a group or a range that one task may hold.
CUTS, ACCURACY, TASK_ROWS = 255, 5000, 50_000
#: Most groups whose pairs are formed, most groups or ranges that are cut at once (their cuts pass through the driver).
MAX_GROUPS, MAX_RANGES = 64, 1024
#: Points whose slopes are formed, groups beyond TASK_ROWS that are searched together, points whose slopes are tried first, width at which a search ends.
SMALL_PAIRS, MAX_SEARCHED, SAMPLE, WIDTH = 1000, 4096, 128, 1e-11


def _fields(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (df.select(*by).schema if by else ()))


def meet(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by``, null keys included; one row of ``right`` beside all of ``left`` if there is no key."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    names = {c: f"_k{i}" for i, c in enumerate(by)}
    other = right.withColumnsRenamed(names)
    same = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in names.items()])
    return left.join(other, same, how).drop(*names.values())


def _cuts(x: str, n: Column, rows: int) -> Column:
    """Cuts of a group with more than ``rows`` rows, so many rows apart if CUTS allows; none of a smaller one."""
    every = F.greatest(F.lit(1), F.floor(F.lit(CUTS + 1) * rows / n)).cast("int")
    found = F.array_distinct(F.filter(F.percentile_approx(x, [(i + 1) / (CUTS + 1) for i in range(CUTS)], ACCURACY), lambda _, i: (i + 1) % every == 0))
    return F.when(n > rows, found).otherwise(F.array().cast("array<double>"))


def below(cuts: str, x: Column) -> Column:
    """How many of at most 1,023 rising cuts lie below a value, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(10))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(F.col(cuts), at + step - 1) < x, step).otherwise(F.lit(0)))


def _range(cuts: str, x: Column) -> Column:
    """Number of a value's range; odd numbers are single values."""
    return F.transform(F.array(below(cuts, x)), lambda i: 2 * i + F.coalesce((F.get(F.col(cuts), i) == x).cast("int"), F.lit(0)))[0]


def deal(df: DataFrame, cuts: str, x: str, name: str) -> DataFrame:
    """``df`` with the number ``name`` of each row's range among at most 1,023 cuts, as ``_range`` has it; a step a column, which Spark compiles."""
    at = df.withColumn("_at", F.lit(0))
    for step in (1 << i for i in reversed(range(10))):
        at = at.withColumn("_at", F.col("_at") + F.when(F.get(F.col(cuts), F.col("_at") + (step - 1)) < F.col(x), step).otherwise(0))
    return at.withColumn(name, 2 * F.col("_at") + F.coalesce((F.get(F.col(cuts), F.col("_at")) == F.col(x)).cast("int"), F.lit(0))).drop("_at")


def _most(n: int, rows: int) -> int:
    """Rows of ``n`` that a range may have: ``rows``, or more where else more than MAX_RANGES groups would be cut."""
    return max(rows, -(-n // MAX_RANGES))


def _small(spark, rows: list, by: DataFrame, extra: str) -> DataFrame:
    """Rows of the driver beside each task's own; keys as in ``by``."""
    return F.broadcast(spark.createDataFrame(rows, (_fields(by, by.columns) + extra).removesuffix(", ")))


def bounded_groups(df: DataFrame, group: Column) -> list[str]:
    """Names of the groups, at most MAX_GROUPS: pairs of more are refused."""
    found = df.select(group.cast("string").alias("g")).where("g is not null").distinct().limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: their pairs are not formed")
    return sorted(r.g for r in found)


# Quantiles -----------------------------------------------------------------------


def exact_quantiles(df: DataFrame, by: list[str], value: Column, ps: list[float], rows: int = TASK_ROWS) -> DataFrame:
    """``by``, n and ``q`` (an array, interpolated between neighbours as ``percentile`` does), for groups of any size.

    Rounds narrow to the ranges that hold a wanted rank, for all groups at once, until a range has one value or at most ``rows``
    rows, or a MAX_RANGES-th of all rows where that is more.  Each round divides the rows in play by the number of ranges; the source is read a few times a round.
    """
    x = df.select(*by, value.cast("double").alias("_x")).where("_x is not null")
    totals = x.groupBy(*by).agg(F.count("*").alias("_n"))
    at = F.transform(F.array(*[F.lit(float(p)) for p in ps]), lambda p: p * (F.col("_n") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda k: F.array(F.floor(k), F.ceil(k)))))
    values = values_at(x, by, totals.select(*by, F.explode(ranks).alias("_rank")), rows).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    pick = lambda k: F.element_at("_at", F.floor(k)) + (F.element_at("_at", F.ceil(k)) - F.element_at("_at", F.floor(k))) * (k - F.floor(k))
    return meet(totals, values, by).select(*by, F.col("_n").alias("n"), F.transform(at, pick).alias("q"))


def values_at(x: DataFrame, by: list[str], ranks: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``by``, ``_rank``, ``_v``: the values ``_x`` of each group at the ranks (from 0) of ``ranks(by, _rank)``.

    Cuts are taken once and held: every later read deals rows alike, without a shuffle of the rows of large groups.
    """
    if not by:
        return values_at(x.withColumn("_all", F.lit(0)), ["_all"], ranks.withColumn("_all", F.lit(0)), rows).drop("_all")
    spark, n = x.sparkSession, x.count()
    most = _most(n, rows)
    keys, data, found = list(by), x, []
    wanted = ranks.withColumn("_left", F.col("_rank"))
    large = x.groupBy(*by).agg(F.count("*").alias("_c")).where(F.col("_c") > most).collect()  # at most MAX_RANGES
    held = [tuple(r)[:-1] for r in large]
    few = _small(spark, held, x.select(*by), "")
    # Without small groups nothing is left to be listed, and the rows need not be read for it.
    listed = [(keys, meet(x, few, keys, "left_anti"), meet(wanted, few, keys, "left_anti"))] if sum(r["_c"] for r in large) < n or not n else []
    while held:
        few = _small(spark, held, data.select(*keys), "")
        data, wanted = meet(data, few, keys, "left_semi"), meet(wanted, few, keys, "left_semi")
        cuts = data.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_x", [(i + 1) / (CUTS + 1) for i in range(CUTS)], 4 * (CUTS + 1))).alias("_cuts")).collect()
        b = f"_b{len(keys)}"
        dealt = deal(meet(data, _small(spark, [tuple(r) for r in cuts], data.select(*keys), "_cuts array<double>"), keys), "_cuts", "_x", b).drop("_cuts")
        counts = dealt.groupBy(*keys, b).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        upto: dict[tuple, int] = {}
        ranges = []
        for *key, i, c, lo, hi in sorted(counts.collect(), key=lambda r: r[b]):  # at most 2 x CUTS + 1 for each key
            before = upto.get(tuple(key), 0)
            upto[tuple(key)] = before + c
            ranges.append((*key, i, before, c, lo == hi or lo != lo, lo))
        table = _small(spark, ranges, data.select(*keys), f"{b} int, _before bigint, _c bigint, _one boolean, _lo double")
        hits = meet(wanted, table, keys).where("_left >= _before and _left < _before + _c").withColumn("_left", F.col("_left") - F.col("_before"))
        found.append(hits.where("_one").select(*by, "_rank", F.col("_lo").alias("_v")))
        keys = [*keys, b]
        rest = hits.where("not _one")
        asked = [(tuple(r)[:-1], r["_c"]) for r in rest.select(*keys, "_c").distinct().collect()]
        data, wanted = dealt, rest.select(*keys, "_rank", "_left")
        held = [k for k, c in asked if c > most]
        if last := [k for k, c in asked if c <= most]:
            few = _small(spark, last, data.select(*keys), "")
            listed.append((keys, meet(data, few, keys, "left_semi"), meet(wanted, few, keys, "left_semi")))
    for at, part, want in listed:
        each = part.groupBy(*at).agg(F.array_sort(F.collect_list("_x")).alias("_sorted"))  # at most ``most`` values each
        found.append(meet(want, each, at).select(*by, "_rank", F.element_at("_sorted", (F.col("_left") + 1).cast("int")).alias("_v")))
    return reduce(DataFrame.unionByName, found)


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, str], rows: int = TASK_ROWS) -> DataFrame:
    """Running totals ``sums`` (column -> name) in the order of a number with distinct values in each group, for groups of any size.

    Cuts are taken once and held.
    """
    spark, most = df.sparkSession, _most(df.count(), rows)
    cuts = df.groupBy(*by).agg(F.count("*").alias("_n"), _cuts(order, F.count("*"), most).alias("_cuts")).where(F.col("_n") > most).select(*by, "_cuts").collect()
    if not cuts:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)  # at most ``most`` rows
        return df.withColumns({n: F.sum(c).over(w) for c, n in sums.items()})
    table = _small(spark, [tuple(r) for r in cuts], df.select(*by), "_cuts array<double>")
    cut = deal(meet(df, table, by, "left"), "_cuts", order, "_b").drop("_cuts")
    large = cut if not by else meet(cut, table, by, "left_semi")
    every = large.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])  # at most MAX_RANGES x (2 x CUTS + 1) rows
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select(*by, "_b", *[F.sum(f"_s{i}").over(w).alias(f"_a{i}") for i in range(len(sums))])
    own = Window.partitionBy(*by, "_b").orderBy(order)
    out = meet(cut, F.broadcast(before), [*by, "_b"], "left").withColumns({n: F.coalesce(F.col(f"_a{i}"), F.lit(0)) + F.sum(c).over(own) for i, (c, n) in enumerate(sums.items())})
    return out.drop("_b", *[f"_a{i}" for i in range(len(sums))])


def pair_counts(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """Every pair of at most MAX_GROUPS groups: n_a, n_b, the largest distance ``d`` of their distributions, the rank sum ``w`` of the first and ``ties`` (sum of t^3 - t).

    Counts of distinct values are dealt by ranges of the value, once for all pairs; a range begins with the counts before it, which the driver adds up
    (2 x CUTS + 1 ranges of MAX_GROUPS numbers at most).
    """
    names = bounded_groups(df, group)
    x = df.select(group.cast("string").alias("g"), value.cast("double").alias("x")).where("x is not null and g is not null")
    found = x.agg(F.percentile_approx("x", [(i + 1) / (CUTS + 1) for i in range(CUTS)], 4 * (CUTS + 1)).alias("c")).first().c or []
    table = F.broadcast(df.sparkSession.createDataFrame([(sorted(set(found)),)], "_cuts array<double>"))
    dealt = deal(x.crossJoin(table), "_cuts", "x", "_b").drop("_cuts")
    place = {g: i for i, g in enumerate(names)}
    sums: dict[int, np.ndarray] = {}
    for r in dealt.groupBy("_b", "g").agg(F.count("*").alias("k")).collect():
        sums.setdefault(r["_b"], np.zeros(len(names), np.int64))[place[r["g"]]] = r["k"]
    total, before = np.zeros(len(names), np.int64), {}
    for b in sorted(sums):
        before[b], total = total, total + sums[b]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if total[i] and total[j]]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values, at = np.unique(pdf["x"].to_numpy(), return_inverse=True)
        k = np.zeros((len(names), len(values)), np.int64)
        k[pdf["g"].map(place).to_numpy(), at] = pdf["k"].to_numpy()
        upto = k.cumsum(axis=1) + before[int(pdf["_b"].iloc[0])][:, None]
        rows = []
        for i, j in pairs:
            t = (k[i] + k[j]).astype(float)
            d = np.abs(upto[i] / total[i] - upto[j] / total[j]).max()
            rows.append((names[i], names[j], int(total[i]), int(total[j]), float(d), float((k[i] * (upto[i] + upto[j] - (t - 1) / 2)).sum()), float((t * t * t - t).sum())))
        return pd.DataFrame(rows, columns=["group_a", "group_b", "n_a", "n_b", "d", "w", "ties"])

    counts = dealt.groupBy("_b", "g", "x").agg(F.count("*").alias("k"))
    each = counts.groupBy("_b").applyInPandas(one, "group_a string, group_b string, n_a bigint, n_b bigint, d double, w double, ties double")
    return each.groupBy("group_a", "group_b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max("d").alias("d"), F.sum("w").alias("w"), F.sum("ties").alias("ties"))


# Inversions ------------------------------------------------------------------------


def weighted_inversions(z: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[i] w[j] over i < j with z[i] > z[j], bit by bit of the ranks: n log n, no pair is formed."""
    rank = np.unique(z, return_inverse=True)[1].astype(np.int64)
    total, order = 0, np.arange(len(rank))
    for b in reversed(range(int(rank.max(initial=0)).bit_length())):
        r, v = rank[order], w[order]
        high = (r >> b) & 1
        # ``order`` keeps places within runs of equal higher bits: larger values ahead of each smaller one in its run.
        ahead = np.cumsum(v * high)
        head = np.concatenate([[True], (r[1:] >> (b + 1)) != (r[:-1] >> (b + 1))])
        start = np.flatnonzero(head)
        base = np.repeat((ahead - v * high)[start], np.diff(np.append(start, len(r))))
        total += int(((ahead - base) * v)[high == 0].sum())
        order = order[np.argsort(r >> b, kind="stable")]
    return total


def pairs_falling(x: np.ndarray, z: np.ndarray, w: np.ndarray | None = None) -> int:
    """Pairs with x[i] < x[j] and z[i] > z[j]."""
    by = np.lexsort((z, x))  # equal x rise in z, so that they count nothing
    return weighted_inversions(z[by], (np.ones(len(x), np.int64) if w is None else w)[by])


def falling_pairs(df: DataFrame, by: list[str], x: str, z: str, w: str, task_rows: int | None = None) -> DataFrame:
    """``by`` and ``falling``: weighted pairs of rows with a smaller x and a larger z, for groups of any size.

    Ranges of x and of z make a grid.  Pairs in other rows and columns follow from the grid's counts, pairs in one range of x are
    counted there, and pairs in one range of z but other ranges of x there; single values hold no such pair.
    """
    most = TASK_ROWS if task_rows is None else task_rows
    rows = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(z).cast("double").alias("_z"), F.col(w).cast("bigint").alias("_w"))
    n = F.count("*")
    cuts = rows.groupBy(*by).agg(_cuts("_x", n, most).alias("_cx"), _cuts("_z", n, most).alias("_cz"))
    cell = meet(rows, cuts, by).select(*by, "_x", "_z", "_w", _range("_cx", F.col("_x")).alias("_bx"), _range("_cz", F.col("_z")).alias("_bz"), (F.size("_cx") > 0).alias("_large"))
    fields = _fields(df, by)
    head = lambda pdf: list(pdf[by].iloc[0]) if by else []

    def within(first: str):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[*head(pdf), pairs_falling(pdf[first].to_numpy(), pdf["_z"].to_numpy(), pdf["_w"].to_numpy())]], columns=[*by, "falling"])

        return one

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((2 * CUTS + 1, 2 * CUTS + 1), dtype=np.int64)
        np.add.at(grid, (pdf["_bx"].to_numpy(), pdf["_bz"].to_numpy()), pdf["_c"].to_numpy())
        beyond = np.zeros_like(grid)  # larger x, smaller z
        beyond[:-1, 1:] = grid[::-1].cumsum(axis=0)[::-1][1:].cumsum(axis=1)[:, :-1]
        return pd.DataFrame([[*head(pdf), sum(int(v) for v in (grid * beyond).sum(axis=1))]], columns=[*by, "falling"])

    schema = f"{fields}falling bigint"
    rows_of = cell.where(F.col("_bx") % 2 == 0).groupBy(*by, "_bx").applyInPandas(within("_x"), schema)
    columns_of = cell.where((F.col("_bz") % 2 == 0) & F.col("_large")).groupBy(*by, "_bz").applyInPandas(within("_bx"), schema)
    grids = cell.where("_large").groupBy(*by, "_bx", "_bz").agg(F.sum("_w").alias("_c")).groupBy(*by).applyInPandas(across, schema)
    return rows_of.unionByName(columns_of).unionByName(grids).groupBy(*by).agg(F.sum("falling").cast("bigint").alias("falling"))


def kendall(df: DataFrame, by: list[str], a: str, b: str, task_rows: int | None = None) -> DataFrame:
    """Tau-b of each group from counts of falling pairs and ties; null where one side has a single value."""
    known = df.select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where("_a is not null and _b is not null")
    rows = known.groupBy(*by, "_a", "_b").agg(F.count("*").alias("_w"))
    pairs = lambda c: F.sum(F.col(c).cast("decimal(38,0)") * (F.col(c) - 1) / 2).cast("double")
    tied = lambda keys, name: rows.groupBy(*by, *keys).agg(F.sum("_w").alias("_t")).groupBy(*by).agg(pairs("_t").alias(name))
    out = rows.groupBy(*by).agg(F.sum("_w").cast("bigint").alias("n"))
    for keys, name in ((["_a"], "_ta"), (["_b"], "_tb"), (["_a", "_b"], "_tab")):
        out = meet(out, tied(keys, name), by)
    out = meet(out, falling_pairs(rows, by, "_a", "_b", "_w", task_rows), by, "left")
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    excess = every - F.col("_ta") - F.col("_tb") + F.col("_tab") - 2 * F.coalesce("falling", F.lit(0))
    spread = F.sqrt((every - F.col("_ta")) * (every - F.col("_tb")))
    return out.select(*by, "n", F.round(F.when(spread > 0, excess / spread), 6).alias("tau"))


# Slopes -----------------------------------------------------------------------------


def _slope(u: float) -> float:
    """Slopes on a finite scale, -1 to 1."""
    return u / (1 - abs(u))


def slope_ranks(below: int, equal: int, pairs: int) -> list[int]:
    """Ranks among all slopes of those whose mean is the shifted median; slopes of -1 are left out, and without room for the shift it is not made."""
    m = pairs - equal
    at = [(m - 1) // 2 + below, m // 2 + below]
    if at[-1] >= m:
        at = [(m - 1) // 2, m // 2]
    return [k if k < below else k + equal for k in sorted(set(at))] if m > 0 else []


def some_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes between at most SAMPLE of the points, on the finite scale: places where many slopes may be equal."""
    step = -(-len(x) // SAMPLE) or 1
    x, y = x[::step], y[::step]
    i, j = np.triu_indices(len(x), 1)
    use = x[i] != x[j]
    s = (y[j] - y[i])[use] / (x[j] - x[i])[use]
    return np.sort(s / (1 + np.abs(s)))


class Search:
    """Narrowing to the slope of one rank by counts of smaller slopes.

    Asks at both sides of the place that the counts point to, closer after each hit; in the middle; and at both sides of the slope
    that is most frequent in a sample, which settles ranks within ties at once.
    """

    def __init__(self, rank: int, pairs: int, seen: np.ndarray):
        self.rank, self.lo, self.hi, self.below_lo, self.below_hi, self.seen, self.near = rank, -1.0, 1.0, 0, pairs, seen, 0.03
        at = seen[min(len(seen) - 1, rank * len(seen) // max(pairs, 1))] if len(seen) else 0.0
        self.aim = (at - 0.01, at + 0.01)
        self.next = self._asked(at - 0.01, at - 0.001, at + 0.001, at + 0.01)

    def _asked(self, *at: float) -> list[float]:
        return sorted({float(u) for u in at if self.lo < u < self.hi})

    def take(self, counts: list[int]) -> None:
        for u, c in zip(self.next, counts, strict=True):
            if c <= self.rank and u > self.lo:
                self.lo, self.below_lo = u, c
            if c > self.rank and u < self.hi:
                self.hi, self.below_hi = u, c
        hit = self.aim[0] <= self.lo and self.hi <= self.aim[1]
        self.near = max(1e-4, self.near / 10) if hit else min(0.03, self.near * 10)
        wide = self.hi - self.lo
        at = self.lo + wide * (self.rank + 0.5 - self.below_lo) / (self.below_hi - self.below_lo)
        self.aim = (at - self.near * wide, at + self.near * wide)
        inside = self.seen[np.searchsorted(self.seen, self.lo, "right") : np.searchsorted(self.seen, self.hi)]
        tied = []
        if len(inside):
            values, times = np.unique(inside, return_counts=True)
            v = float(values[times.argmax()])
            tied = [v - WIDTH / 4 * (1 - abs(v)), v + WIDTH / 4 * (1 - abs(v))]
        self.next = self._asked(*self.aim, self.lo + wide / 2, *tied)

    @property
    def done(self) -> bool:
        return not self.next or self.hi - self.lo <= WIDTH * (1 - max(abs(self.lo), abs(self.hi)))

    @property
    def value(self) -> float:
        return _slope(self.lo + (self.hi - self.lo) / 2)


def select_slope(x: np.ndarray, y: np.ndarray) -> float:
    """Shifted median of all slopes between points of different x; n log n in the points, whose slopes are never formed beyond SMALL_PAIRS points."""
    if len(x) <= SMALL_PAIRS:
        i, j = np.triu_indices(len(x), 1)
        use = x[i] != x[j]
        s = np.sort((y[j] - y[i])[use] / (x[j] - x[i])[use])
        at = slope_ranks(int((s < -1).sum()), int((s == -1).sum()), len(s))
        return float(np.mean(s[at])) if at else math.nan
    count = lambda s: pairs_falling(x, y - s * x)
    ties = np.unique(x, return_counts=True)[1]
    pairs = len(x) * (len(x) - 1) // 2 - int((ties * (ties - 1) // 2).sum())
    below = count(-1.0)
    equal = pairs - below - pairs_falling(x, -(y + x))
    seen, found = some_slopes(x, y), []
    for rank in slope_ranks(below, equal, pairs):
        search = Search(rank, pairs, seen)
        while not search.done:
            search.take([count(_slope(u)) for u in search.next])
        found.append(search.value)
    return float(np.mean(found)) if found else math.nan


def passing_bablok(pairs: DataFrame, by: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Shifted median of all slopes between points of different x, and the median intercept; by group, n, slope, intercept.

    Groups of up to ``task_rows`` points are a task's; larger ones are searched by counts of falling pairs over all tasks, all groups
    at once, four slopes a round.
    """
    points = pairs.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    sizes = points.groupBy(*by).agg(F.count("*").alias("_n"))
    fields = _fields(points, by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        slope = select_slope(x, y)
        return pd.DataFrame([[*(pdf[by].iloc[0] if by else []), len(pdf), round(slope, 6), round(float(np.median(y - slope * x)), 6)]], columns=[*by, "n", "slope", "intercept"])

    small = meet(points, sizes.where(F.col("_n") <= task_rows).select(*by, "_n"), by).groupBy(*by).applyInPandas(one, f"{fields}n bigint, slope double, intercept double")
    large = sizes.where(F.col("_n") > task_rows)
    rows = large.limit(MAX_SEARCHED + 1).collect()
    if not rows:
        return small
    if len(rows) > MAX_SEARCHED:
        raise ValueError(f"more than {MAX_SEARCHED} groups of more than {task_rows} points: raise task_rows")
    return small.unionByName(_searched(points, by, rows, task_rows))


def _searched(points: DataFrame, by: list[str], groups: list, task_rows: int) -> DataFrame:
    """Slopes and intercepts of large groups."""
    spark = points.sparkSession
    schema = points.select(*by).schema if by else None
    key = lambda r: tuple(r[c] for c in by)
    rows = points.groupBy(*by, "x", "y").agg(F.count("*").alias("_w"))

    def counts(wanted: dict[tuple, list[tuple[float, int]]]) -> dict[tuple, dict[tuple[float, int], int]]:
        """Falling pairs of (sign * (y - slope * x)), for each group and each slope asked for."""
        asked = [(*k, s, sign) for k, each in wanted.items() for s, sign in each]
        table = spark.createDataFrame(asked, f"{_fields(points, by)}_s double, _sign int")  # at most four a group and rank
        z = F.col("_sign") * (F.col("y") - F.col("_s") * F.col("x"))
        every = (meet(rows, F.broadcast(table), by) if by else rows.crossJoin(F.broadcast(table))).withColumn("_z", z)
        out: dict = {k: dict.fromkeys(each, 0) for k, each in wanted.items()}
        for r in falling_pairs(every, [*by, "_s", "_sign"], "x", "_z", "_w", task_rows).collect():  # a row for each of them
            out[key(r)][r["_s"], r["_sign"]] = r["falling"]
        return out

    ties = {key(r): int(r["t"]) for r in meet(rows.groupBy(*by, "x").agg(F.sum("_w").alias("_t")), spark.createDataFrame([key(r) for r in groups], schema), by, "left_semi").groupBy(*by).agg(F.sum(F.col("_t").cast("decimal(38,0)") * (F.col("_t") - 1) / 2).alias("t")).collect()} if by else {(): int(rows.groupBy("x").agg(F.sum("_w").alias("_t")).agg(F.sum(F.col("_t").cast("decimal(38,0)") * (F.col("_t") - 1) / 2).alias("t")).first().t)}
    first = counts({key(r): [(-1.0, 1), (-1.0, -1)] for r in groups})
    # About SAMPLE different points of each group, by hash.
    few = meet(rows, spark.createDataFrame([(*key(r), r["_n"]) for r in groups], f"{_fields(points, by)}_n bigint"), by).where(F.pmod(F.xxhash64("x", "y"), F.greatest(F.lit(1), F.floor(F.col("_n") / SAMPLE))) == 0)
    sampled: dict[tuple, list[tuple[float, float]]] = {}
    for r in few.select(*by, "x", "y").collect():
        sampled.setdefault(key(r), []).append((r["x"], r["y"]))
    searches: dict[tuple, list[Search]] = {}
    for r in groups:
        k = key(r)
        pairs = r["_n"] * (r["_n"] - 1) // 2 - ties[k]
        below, above = first[k][-1.0, 1], first[k][-1.0, -1]
        seen = some_slopes(*np.array(sorted(sampled[k])).T) if k in sampled else np.zeros(0)
        searches[k] = [Search(rank, pairs, seen) for rank in slope_ranks(below, pairs - below - above, pairs)]
    while any(not s.done for each in searches.values() for s in each):
        wanted = {k: sorted({(_slope(u), 1) for s in each if not s.done for u in s.next}) for k, each in searches.items()}
        got = counts({k: w for k, w in wanted.items() if w})
        for k, each in searches.items():
            for s in each:
                if not s.done:
                    s.take([got[k][_slope(u), 1] for u in s.next])
    slopes = [(*key(r), r["_n"], float(np.mean([s.value for s in searches[key(r)]])) if searches[key(r)] else math.nan) for r in groups]
    table = spark.createDataFrame(slopes, f"{_fields(points, by)}n bigint, _slope double")
    rest = meet(points, table, by).withColumn("_d", F.col("y") - F.col("_slope") * F.col("x"))
    middle = exact_quantiles(rest, by, F.col("_d"), [0.5], task_rows).select(*by, F.round(F.col("q")[0], 6).alias("intercept"))
    return meet(table, middle, by).select(*by, "n", F.round("_slope", 6).alias("slope"), "intercept")
