"""Order statistics of groups that no task holds, against brute force, with ties, vertical pairs, null groups and hot values."""

import itertools
import math

import numpy as np
import pytest

from cellwright.operators import ordering


def falling(x, z, w):
    return sum(w[i] * w[j] for i, j in itertools.permutations(range(len(x)), 2) if x[i] < x[j] and z[i] > z[j])


@pytest.mark.parametrize("n,values", [(0, 3), (1, 3), (40, 4), (60, 1000), (60, 1)])
def test_falling_pairs_in_one_task(n, values):
    rng = np.random.default_rng(n)
    x, z, w = (rng.integers(0, values, n).astype(float) for _ in range(3))
    w = w.astype(np.int64) + 1
    assert ordering.pairs_falling(x, z, w) == falling(x, z, w)


def groups(seed=0):
    """A large group with ties, a hot value and vertical pairs, a group of one value, a null group, a small one; quarters, so that sums are exact."""
    rng = np.random.default_rng(seed)
    out = []
    for name, n in (("a", 250), (None, 100), ("small", 7), ("one", 1)):
        x = np.where(rng.random(n) < 0.35, 5.0, np.round(4 * rng.normal(5, 3, n)) / 4)
        y = np.where(rng.random(n) < 0.3, 4.0, np.round(4 * (1.3 * x + rng.normal(0, 1, n))) / 4)
        out += [(name, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    return out + [("same", 2.0, float(k)) for k in range(120)]


@pytest.fixture
def tight(monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 60)
    monkeypatch.setattr(ordering, "CUTS", 15)
    monkeypatch.setattr(ordering, "SMALL_PAIRS", 10)


def tau_plainly(x, y):
    a, b = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    spread = math.sqrt((a * a).sum() * (b * b).sum())
    return round((a * b).sum() / spread, 6) if spread else None


def test_kendall_is_brute_force(spark, tight):
    rows = groups()
    df = spark.createDataFrame([*rows, ("a", None, 1.0)], "g string, x double, y double")
    got = {r.g: (r.n, r.tau) for r in ordering.kendall(df, ["g"], "x", "y").collect()}
    for g in {r[0] for r in rows}:
        x, y = np.array([r[1:] for r in rows if r[0] == g]).T
        assert got[g] == (len(x), tau_plainly(x, y)), g
    x, y = np.array([r[1:] for r in rows]).T
    assert [tuple(r) for r in ordering.kendall(df, [], "x", "y").collect()] == [(len(x), tau_plainly(x, y))]


def line_plainly(x, y):
    i, j = np.triu_indices(len(x), 1)
    use = x[i] != x[j]
    s = np.sort((y[j] - y[i])[use] / (x[j] - x[i])[use])
    s = s[s != -1]
    k, m = int((s < -1).sum()), len(s)
    if not m:
        return None
    lo, hi = ((m - 1) // 2 + k, m // 2 + k) if m // 2 + k < m else ((m - 1) // 2, m // 2)
    slope = (s[lo] + s[hi]) / 2
    return slope, float(np.median(y - slope * x))


@pytest.mark.parametrize("task_rows", [5, 10_000])
def test_slope_medians_are_brute_force(spark, tight, task_rows):
    rows = [r for r in groups(1) if r[0] in ("a", "small", "one", "same")] + [("down", float(k), float(-k + k % 3)) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in ordering.passing_bablok(df, ["g"], task_rows).collect()}
    for g in {r[0] for r in rows}:
        want = line_plainly(*np.array([r[1:] for r in rows if r[0] == g]).T)
        assert (got[g].slope, got[g].intercept) == pytest.approx(want, abs=2e-6) if want else got[g].slope is None or math.isnan(got[g].slope), g


def test_slopes_of_many_points_are_never_formed():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(100, 20, 100_000), 2)
    y = np.round(0.9 * x + 3 + rng.normal(0, 2, 100_000), 2)
    assert ordering.select_slope(x, y) == pytest.approx(0.9 * 1.006, abs=0.02)
    few = slice(0, 900)
    assert ordering.select_slope(x[few], y[few]) == pytest.approx(line_plainly(x[few], y[few])[0], abs=1e-9)
    monkey = ordering.SMALL_PAIRS
    try:
        ordering.SMALL_PAIRS = 0
        assert ordering.select_slope(x[few], y[few]) == pytest.approx(line_plainly(x[few], y[few])[0], abs=1e-9)
    finally:
        ordering.SMALL_PAIRS = monkey


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("rows", [5, 1000])
def test_quantiles_by_rounds_are_exact(spark, monkeypatch, by, rows):
    monkeypatch.setattr(ordering, "CUTS", 7)
    data = groups(2) + [("hot", 1.5, 0.0)] * 300 + [("empty", None, 0.0), ("a", None, 0.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    ps = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = {(r.g if by else None): (r.n, r.q) for r in ordering.exact_quantiles(df, by, ordering.F.col("x"), ps, rows).collect()}
    for g in {r[0] for r in data if r[1] is not None} if by else {None}:
        x = [r[1] for r in data if r[1] is not None and (not by or r[0] == g)]
        assert got[g][0] == len(x) and got[g][1] == pytest.approx(np.quantile(x, ps).tolist(), abs=1e-12), g
    assert "empty" not in got


def test_nothing_has_no_order(spark):
    none = spark.createDataFrame([], "g string, x double, y double")
    assert ordering.kendall(none, ["g"], "x", "y").count() == ordering.passing_bablok(none, ["g"]).count() == ordering.exact_quantiles(none, ["g"], ordering.F.col("x"), [0.5]).count() == 0
