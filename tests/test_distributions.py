"""Distribution tests, intervals from ranks and segmented charts against one-task versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwright.functions import special as S
from cellwright.operators import distributions, intervals, multirule, ordering, study


@pytest.fixture
def tight(monkeypatch):
    monkeypatch.setattr(ordering, "CUTS", 15)


def values(seed=0):
    rng = np.random.default_rng(seed)
    out = [("a", float(v)) for v in np.round(rng.normal(10, 2, 300), 1)] + [("b", float(v)) for v in np.round(rng.gamma(4, 3, 150), 1)]
    return out + [("few", float(v)) for v in range(4)] + [("flat", 3.0)] * 60 + [("c", 5.0)] * 70 + [("c", float(v)) for v in range(30)] + [(None, 1.0), ("a", None)]


def test_lilliefors_on_running_counts(spark, tight):
    df = spark.createDataFrame(values(), "g string, x double")
    got = {r.g: r for r in distributions.lilliefors(df, ["g"], F.col("x")).collect()}
    for g in ("a", "b", "c"):
        x = np.array([v for h, v in values() if h == g and v is not None])
        assert (got[g].n, got[g].d, got[g].p) == (len(x), *[pytest.approx(v, abs=2e-6) for v in study.lilliefors(x)])
    assert got["few"].d is None and got["flat"].p is None


def test_running_totals_by_ranges(spark, tight):
    rng = np.random.default_rng(1)
    rows = [(g, float(v), int(k)) for g in ("a", None) for v, k in zip(rng.permutation(120), rng.integers(1, 9, 120), strict=True)]
    df = spark.createDataFrame(rows, "g string, x double, k long")
    for by in (["g"], []):
        source = df if by else df.where("g = 'a'")
        got = {(r.g, r.x): r.upto for r in ordering.running(source, by, "x", {"k": "upto"}, rows=10).collect()}
        for g, x, _ in rows:
            if by or g == "a":
                assert got[g, x] == sum(k for h, v, k in rows if h == g and v <= x)


def test_distances_of_all_pairs(spark, tight):
    df = spark.createDataFrame(values(), "g string, x double")
    got = {(r.group_a, r.group_b): r for r in distributions.ks_pairs(df, F.col("g"), F.col("x")).collect()}
    each = {g: np.array([v for h, v in values() if h == g and v is not None]) for g in ("a", "b", "c", "few", "flat")}
    assert set(got) == set(itertools.combinations(sorted(each), 2))
    for (a, b), r in got.items():
        d, p = S.ks_two_sample(each[a], each[b])
        assert (r.n_a, r.n_b, r.d, r.p) == (len(each[a]), len(each[b]), pytest.approx(d, abs=1e-6), pytest.approx(p, abs=1e-6))
    advice = {(r.group_a, r.group_b): r for r in distributions.group_difference(df, F.col("g"), F.col("x")).collect()}
    for (a, b), r in advice.items():
        apart = r.z is not None and r.z > r.z_limit
        want = "collect_more_data" if min(r.n_a, r.n_b) < 20 else ("review_partition_high_overlap" if (r.overlap or 0) >= 0.75 else "partition_recommended") if apart else "review_low_overlap" if r.overlap is not None and r.overlap < 0.25 else "combine_ok"
        assert r.recommendation == want, (a, b)
    assert {"collect_more_data", "combine_ok"} < {r.recommendation for r in advice.values()}
    assert advice["a", "b"].distribution == "different_distribution" and 0 <= advice["a", "b"].welch_p < 0.05 and advice["a", "flat"].overlap is None
    same = spark.createDataFrame([(g, float(v)) for g in "xy" for v in range(50)], "g string, x double")
    only = distributions.group_difference(same, F.col("g"), F.col("x")).first()
    assert (only.ks_p, only.welch_p, only.overlap, only.distribution, only.recommendation) == (1.0, pytest.approx(1.0), 1.0, "no_significant_difference", "combine_ok")


def test_pairs_of_many_groups_are_refused(spark):
    many = spark.range(200).select(F.col("id").cast("string").alias("g"), F.col("id").cast("double").alias("x"))
    for pairs in (distributions.ks_pairs, study.wilcoxon_pairs, distributions.group_difference, lambda d, g, x: intervals.harris_boyd(d, [], g, x)):
        with pytest.raises(ValueError, match="64 groups"):
            pairs(many, F.col("g"), F.col("x"))


def test_ranks_that_attain_no_confidence_give_no_limit():
    x = np.arange(1.0, 119.0)
    assert intervals.confidence_limits(x[:118], how="RANK")[0] is None and intervals.confidence_limits(x[:118], how="RANK")[3] is None
    assert intervals.confidence_limits(np.arange(1.0, 120.0), how="RANK") == (1.0, 7.0, 113.0, 119.0)
    assert intervals.rank_confidence(120) == (1, 7, 114, 120) and intervals.rank_confidence(40)[0] == 0 and intervals.rank_confidence(3) == (0, 2, 2, 4)
    for n in (119, 240, 1000):
        lo, hi, _, _ = intervals.rank_confidence(n)
        sure = sum(math.comb(n, k) * 0.025**k * 0.975 ** (n - k) for k in range(lo, hi))
        assert intervals.rank_attained(n) == pytest.approx(sure, abs=1e-9) and sure >= 0.9
    assert intervals.rank_confidence(10**9)[0] == pytest.approx(25_000_000 - 1.645 * math.sqrt(10**9 * 0.025 * 0.975), abs=50)


@pytest.mark.parametrize("how", ["RANK", "NONE"])
def test_large_partitions_come_from_their_ranks(spark, tight, how):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in np.round(rng.lognormal(3, 1, 700), 2)] + [(None, float(v)) for v in rng.normal(0, 1, 300)] + [("small", float(v)) for v in range(50)] + [("hot", 7.0)] * 400
    df = spark.createDataFrame(rows, "g string, x double")
    names = ["n", "low", "high", "low_from", "low_to", "high_from", "high_to", "least"]
    large, plain = ({r.g: [r[c] for c in names] for r in intervals.reference_intervals(df, ["g"], F.col("x"), how=how, task_rows=n).collect()} for n in (100, 10_000))
    assert set(large) == {"a", None, "small", "hot"}
    for g, row in plain.items():
        assert large[g] == [pytest.approx(v, abs=1e-9) if v is not None else None for v in row], g


@pytest.mark.parametrize("kind,quantile", [("PERCENTILE", "TYPE7"), ("BASIC", "R_BOOT")])
def test_resampled_ranks_are_resamples(spark, kind, quantile):
    x = np.random.default_rng(6).lognormal(2, 0.5, 2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = intervals.ranked_intervals(df, [], F.col("x"), "BOOTSTRAP", repetitions=2000, kind=kind, quantile=quantile).first()
    want = intervals.bootstrap(x, repetitions=2000, kind=kind, quantile=quantile)
    ends = (got.low_from, got.low_to, got.high_from, got.high_to)
    for a, b, wide in zip(ends, want, (want[1] - want[0],) * 2 + (want[3] - want[2],) * 2, strict=True):
        assert abs(a - b) < 0.15 * wide
    assert (got.low, got.high) == pytest.approx(intervals.estimate(x))


@pytest.mark.parametrize("after", ["RESTART", "SKIP", "CONTINUE"])
def test_segments_of_a_long_chart_judge_as_one(spark, after):
    rng = np.random.default_rng(7)
    rows = []
    for g, runs in (("long", 160), (None, 90), ("short", 8)):
        for r in range(runs):
            for m in "ab"[: rng.integers(1, 3)]:
                z = float(np.round(rng.normal(0.5, 1.3), 2))
                rows.append((g, f"r{r}", float(r // 2), m, math.nan if rng.random() < 0.05 else z))
    df = spark.createDataFrame(rows, "g string, run string, order double, material string, z double")
    got = {(r.g, r.run, r.material): tuple(r[c] for c in multirule.ADDED) for r in multirule.multirule(df, "g", after_reject=after, segment_points=25).collect()}
    want = {}
    for g in ("long", None, "short"):
        points = pd.DataFrame([r[1:] for r in rows if r[0] == g], columns=["run", "order", "material", "z"])
        want |= {(g, r.run, r.material): tuple(getattr(r, c) for c in multirule.ADDED) for r in multirule.judge(points, after_reject=after).itertuples()}
    assert got == want and len({v[0] for v in want.values()}) > 4
