"""Estimators of intervals and their judgements: published values, brute force, and degenerate samples."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwright.dataset import Dataset
from cellwright.functions import special as S
from cellwright.operators import actions, checks, intervals as I, multi, statistics

#: The published calcium sample (mg/dL) of the guideline's appendix on the robust method.
CALCIUM = [8.9, 9.2, 9.4, 9.4, 9.5, 9.5, 9.5, 9.6, 9.6, 9.6, 9.6, 9.7, 9.7, 9.7, 9.7, 9.7, 9.8, 9.9, 9.9, 10.2]


def test_robust_limits():
    assert tuple(round(v, 2) for v in I.robust_limits(CALCIUM)) == (9.05, 10.20)
    shifted = I.robust_limits(3 * np.asarray(CALCIUM) - 7)
    assert shifted == pytest.approx([3 * v - 7 for v in I.robust_limits(CALCIUM)])
    with pytest.raises(ValueError, match="settle"):
        I.robust_limits(CALCIUM, steps=2)
    for flat in ([1.0] * 9, [1.0] * 8 + [2.0]):
        with pytest.raises(ValueError):
            I.robust_limits(flat)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=8, max_size=40).filter(lambda v: np.ptp(v) > 0))
def test_robust_location_solves_its_equation(values):
    x = np.asarray(values, dtype=float)
    unit = np.median(np.abs(x - np.median(x))) / 0.6745
    if unit == 0:
        return
    try:
        at = sum(I.robust_limits(x)) / 2
    except ValueError:
        return
    w = np.where(np.abs(x - at) < 3.7 * unit, (1 - ((x - at) / (3.7 * unit)) ** 2) ** 2, 0)
    assert at == pytest.approx((w @ x) / w.sum(), abs=1e-6 * unit)


def test_dixon_is_not_reed():
    five = np.asarray([1, 1.1, 1.2, 1.3, 1.5])
    assert I.dixon_ratio(five) == (pytest.approx(0.4), 1.5)
    assert not I.outlier_mask(five, "DIXON").any() and I.outlier_mask(five, "REED").tolist() == [False] * 4 + [True]
    assert I.outlier_mask(np.asarray([9, 1, 1.1, 1.2, 1.3]), "DIXON_Q").tolist() == [True] + [False] * 4
    assert I.outlier_mask(np.asarray([0.0, 5, 5.1, 5.2, 5.3]), "DIXON").tolist() == [True] + [False] * 4
    # r11 for nine values: (second gap left out at the far end).
    nine = np.asarray([1, 5, 5.2, 5.3, 5.5, 5.6, 5.8, 6, 9])
    assert I.dixon_ratio(nine)[0] == pytest.approx((5 - 1) / (6 - 1))
    for n in (2, 31):
        with pytest.raises(ValueError):
            I.outlier_mask(np.arange(float(n)), "DIXON")
    assert all(len(v) == 28 and all(a > 0 for a in v) for v in I.DIXON.values()) and all(a > b > c for a, b, c in zip(*(I.DIXON[k] for k in (0.01, 0.05, 0.10))))


def test_reed_blocks_and_passes():
    x = np.asarray([0.0, 10, 10.5, 11, 11.4, 11.9, 12.3, 30, 31])
    assert not I.outlier_mask(x, "REED").any() and I.outlier_mask(x, "REED", block=2)[-2:].all()
    once, twice = (I.outlier_mask(np.asarray([1.0, 2, 3, 4, 5, 12, 100]), "REED", passes=k).sum() for k in (1, 2))
    assert (once, twice) == (1, 2)
    third = np.asarray([0.0, 2.0, 2.5, 3.0, 6.0])
    assert I.outlier_mask(third, "REED")[-1]  # the third itself counts


def test_fences():
    x = np.asarray([1.0] * 8 + [50.0])
    assert not I.outlier_mask(x, "TUKEY").any() and not I.outlier_mask(np.ones(5), "COOK").any() and not I.outlier_mask(x, "NONE").any()
    with pytest.raises(ValueError):
        I.outlier_mask(np.asarray([-1.0, 1, 2, 3, 4]), "HORN")
    y = np.exp(np.random.default_rng(0).normal(0, 1, 80))
    best = min(np.linspace(-2, 2, 41), key=lambda k: S.box_cox_loss(y, k))
    z = S.box_cox(y, best)
    a, b = np.quantile(z, [0.25, 0.75])
    assert (I.outlier_mask(y, "HORN") == ((z <= a - 1.5 * (b - a)) | (z >= b + 1.5 * (b - a)))).all()


@pytest.mark.parametrize("seed", range(4))
def test_shifted_scale_is_the_likeliest(seed):
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(1, 0.5, 120)) + 4 if seed % 2 else rng.gamma(2, 3, 120)
    origin, lam, unit = S.shifted_box_cox(x)
    loss = lambda o, k: S.box_cox_loss((x - o) / unit, k)
    grid = min(loss(x.min() - unit * math.exp(g), k) for g in np.linspace(math.log(0.01), math.log(10), 40) for k in np.linspace(-5, 5, 81))
    assert loss(origin, lam) <= grid + 1e-6 and origin < x.min()
    moved = S.shifted_box_cox(10 * x + 3)
    assert moved[0] == pytest.approx(10 * origin + 3, rel=1e-2, abs=0.5)
    low, high = I.estimate(x, "BOXCOX_SHIFTED_PARAMETRIC")
    assert low < np.median(x) < high


def test_bootstrap_kinds():
    x = np.random.default_rng(1).normal(10, 2, 60)
    assert I.r_boot_quantile(np.arange(1.0, 100.0), 0.25) == 25.0 and I.r_boot_quantile([1.0, 2.0], 0.01) == 1.0 and I.r_boot_quantile([1.0, 2.0], 0.99) == 2.0
    between = I.r_boot_quantile([0.0, 1.0, 2.0], 0.6)
    z = [S.normal_quantile(p) for p in (0.5, 0.6, 0.75)]
    assert between == pytest.approx(1 + (z[1] - z[0]) / (z[2] - z[0]))
    a = I.bootstrap(x, "PARAMETRIC", 200)
    b = I.bootstrap(x, "PARAMETRIC", 200, kind="BASIC")
    lo, hi = I.estimate(x, "PARAMETRIC")
    assert b == pytest.approx((2 * lo - a[1], 2 * lo - a[0], 2 * hi - a[3], 2 * hi - a[2]))
    assert I.bootstrap(x[::-1], "PARAMETRIC", 50) == I.bootstrap(x, "PARAMETRIC", 50)
    with pytest.raises(ValueError):
        I.bootstrap(np.asarray([1.0] * 30 + [2.0]), "ROBUST", 60)


def by_hand(panel, allowed, rounds, expansion=0.05):
    """Synchronous exclusion with type-6 limits: subjects x items."""
    members = np.isfinite(panel).all(axis=1)[:, None] & np.ones(panel.shape, dtype=bool)
    whole, converged = members[:, 0].copy(), False
    for _ in range(rounds + 1):
        ends = [np.quantile(panel[members[:, j], j], [0.025, 0.975], method="weibull") for j in range(panel.shape[1])]
        flags = np.column_stack([(panel[:, j] < a - expansion * (b - a)) | (panel[:, j] > b + expansion * (b - a)) for j, (a, b) in enumerate(ends)])
        new = whole[:, None] & (flags.sum(axis=1)[:, None] - flags <= allowed)
        if (new == members).all():
            converged = True
            break
        members = new
    return new, flags, converged


@pytest.mark.parametrize(("allowed", "rounds"), [(0, 6), (1, 6), (0, 1)])
def test_latent_exclusion_is_brute_force(spark, allowed, rounds):
    rng = np.random.default_rng(5)
    panel = rng.normal(100, 10, (240, 4))
    panel[:20] += rng.normal(0, 60, (20, 4))
    panel[30, 2] = np.nan
    rows = [(s, f"i{j}", float(v)) for s, r in enumerate(panel) for j, v in enumerate(r) if np.isfinite(v)] + [(999, None, 1.0), (None, "i1", 1.0)]
    df = spark.createDataFrame(rows, "s int, i string, v double").repartition(3)
    members, history, converged = I.latent_exclusion(df, F.col("i"), F.col("s"), F.col("v"), allowed=allowed, rounds=rounds)
    want, flags, settled = by_hand(panel, allowed, rounds)
    got = {(r.subject, r.target): r for r in members.collect()}
    assert converged == settled and len(got) == 240 * 4
    for s, j in itertools.product(range(240), range(4)):
        r = got[s, f"i{j}"]
        assert r.included == want[s, j] and r.complete == np.isfinite(panel[s]).all()
        if r.complete:
            assert r.abnormal_others == flags[s].sum() - flags[s, j]
    assert got[30, "i0"].reason == "PANEL_MISSING" and 0 < sum(r.reason == "EXCLUDED" for r in got.values()) < 480
    assert {r.round for r in history.collect()} == set(range(len({r.round for r in history.collect()})))
    with pytest.raises(ValueError):
        I.latent_exclusion(df, F.col("i"), F.col("s"), F.col("v"), missing="ERROR")
    with pytest.raises(ValueError):
        I.latent_exclusion(df.union(df), F.col("i"), F.col("s"), F.col("v"))
    outside = I.latent_exclusion(df, F.col("i"), F.col("s"), F.col("v"), targets=["other"], items=["i0", "i1", "i3"], allowed=1)[0]
    assert outside.where("target = 'other'").count() == 240


def test_judgements(spark):
    df = spark.createDataFrame([(200, -1.0, 5.0, 0.0), (30, 1.0, 1.0, 0.0), (10, 1.0, 5.0, 0.0), (200, None, 5.0, 0.0)], "n int, low double, high double, least double")
    yes, c = F.lit(True), F.col
    status = I.interval_status(c("n"), c("low"), c("high"), order_resolved=yes, confirmed=yes, subjects_known=yes, censored=F.lit(0), adequacy=F.lit("adequate"), fits=yes, least=c("least"))
    assert [r[0] for r in df.select(status).collect()] == ["distribution_review", "degenerate_distribution", "insufficient_n", "not_evaluable"]
    unsure = I.interval_status(F.lit(500), F.lit(1.0), F.lit(2.0), order_resolved=yes, confirmed=F.lit(None).cast("boolean"), subjects_known=yes, censored=F.lit(0), adequacy=F.lit("adequate"), fits=yes, least=F.lit(1.0))
    assert df.select(unsure).first()[0] == "exploratory_only"
    ratio = I.bias_ratio((F.lit(1.0), F.lit(9.0)), (F.lit(2.0), F.lit(9.0)), (F.lit(1.0), F.lit(8.84)), 0.4)
    r = df.select(ratio.alias("r")).first().r
    assert (r.delta_low, r.br_low, r.reaches_low, r.br_high) == (1.0, 0.5, False, 0.0)
    clamped = I.adjust_limits(df, c("least"), ["low", "high"], 1).collect()
    assert [(x.low, x.clamped) for x in clamped] == [(0.0, True), (1.0, False), (1.0, False), (0.0, False)]


def test_wide_columns_keep_their_context(spark):
    rows = [(1, "GLU", "5", "mg", "3"), (1, "K", "4", "mmol", None), (2, "GLU", "6", "mg", "4"), (2, None, "9", "x", "y")]
    ds = Dataset(spark.createDataFrame(rows, "p int, t string, v string, u string, lo string"), {"u": ("UNIT",), "lo": ("REF_LOW",)})
    out = actions.run_action(ds, {"TYPE": "PIVOT_WIDER", "ID_COLS": ["p"], "NAMES_FROM": "t", "VALUES_FROM": "v", "CONTEXT": True})
    assert {k: v["PIVOT_CONTEXT"] for k, v in out.meta["COLUMN"].items()} == {"GLU": {"UNIT": "mg"}, "K": {"UNIT": "mmol"}}
    assert sorted((r.p, r.GLU, r.K) for r in out.df.collect()) == [(1, "5", "4"), (2, "6", None)]


def test_measurement_conflicts(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    ds = Dataset(df, {"a": ("NOMINAL", "ORDINAL"), "b": ("ORDINAL",)}, {"COLUMN": {"a": {"LEVELS": ["1"]}, "c": {"LEVELS": ["1"]}}})
    assert {(c, m) for c, m in checks.measurement_conflicts(ds)} == {("a", "both nominal and ordinal"), ("b", "an order without levels"), ("c", "levels without an order")}


def test_draws_with_replacement(spark):
    df = spark.range(300).withColumn("g", F.col("id") % 3)
    got = multi.sample(df, F.col("id"), n=1000, by=["g"], seed=1, replace=True)
    per = {r.g: (r.n, r.d) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()}
    assert all(n == 1000 and d > 95 for n, d in per.values()) and got.columns == df.columns
    assert sorted(got.collect()) == sorted(multi.sample(df.repartition(5), F.col("id"), n=1000, by=["g"], seed=1, replace=True).collect())
    poisson = multi.sample(df, F.col("id"), fraction=2.0, seed=4, replace=True)
    assert 450 < poisson.count() < 750 and poisson.groupBy("id").count().agg(F.max("count")).first()[0] > 3
    assert multi.sample(df.limit(0), F.col("id"), n=5, replace=True).count() == 0


@pytest.mark.parametrize("backward", [False, True])
def test_carry_without_groups(spark, backward):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.9 else float(i) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "o long, v double").repartition(4)
    got = [r.f for r in statistics.carry(df, F.col("v"), "o", "f", backward=backward).orderBy("o").collect()]
    want, last = [], None
    for v in (values[::-1] if backward else values):
        last = v if v is not None else last
        want.append(last)
    assert got == (want[::-1] if backward else want)
    assert statistics.carry(df.where("false"), F.col("v"), "o", "f").count() == 0 and statistics.carry(df.where("v is null"), F.col("v"), "o", "f").where("f is not null").count() == 0


def test_ranks_of_texts(spark):
    rows = [(t, n) for n, t in enumerate(["", "a", "ab", "abcdefgh", "abcdefgi", "é", "z", "\U0001f600", "abcdef"] * 3)]
    counts = [(t + str(n % 2), n % 4) for t, n in rows]
    counts = list(dict(counts).items())
    got = {r.t: r.rank for r in statistics.rank_by_count(spark.createDataFrame(counts, "t string, c long"), "t", "c", "rank").collect()}
    assert got == {t: k for k, (t, _) in enumerate(sorted(counts, key=lambda r: (-r[1], r[0].encode())), 1)}
