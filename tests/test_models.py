"""Linear models with levels against dense algebra."""

import numpy as np
import pytest

from cellwright.operators import models, statistics

LEVELS = {"c": (["a", "b", "z"], "b"), "d": (["0", "1"], "0")}
SCHEMA = "y double, x double, c string, d int, g string, w double, h string, keep boolean"


def rows(n=240):
    rng = np.random.default_rng(3)
    out = []
    for k in range(n):
        c, d, x = "abz"[rng.integers(3)], int(rng.integers(2)), float(np.round(rng.normal(5, 2), 2))
        y = 3 + 0.5 * x + {"a": 1.0, "b": 0.0, "z": -2.0}[c] + 0.7 * d + float(rng.normal(0, 1 + d))
        out.append([y, x, c, d, f"g{rng.integers(12)}", float(rng.integers(0, 4)), f"h{k % 3}", bool(rng.integers(5))])
    out[3][0], out[4][1], out[5][2], out[6][3] = None, None, None, None
    return [tuple(r) for r in out]


def dense(data):
    ok = [r for r in data if None not in r[:4]]
    x = np.array([[1.0, r[1], r[2] == "a", r[2] == "z", r[3] == 1] for r in ok], dtype=float)
    return ok, x, np.array([r[0] for r in ok])


def check(got, beta, se, n, df):
    assert got["term"].tolist() == ["intercept", "x", "c=a", "c=z", "d=1"] and (got["n"] == n).all() and (got["df"] == df).all()
    np.testing.assert_allclose(got["estimate"], beta, rtol=1e-8)
    np.testing.assert_allclose(got["se"], se, rtol=1e-7)


def test_hc3_and_clusters_are_dense_algebra(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    ok, x, y = dense(data)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    lever = np.einsum("ij,jk,ik->i", x, inv, x)
    meat = x.T @ (x * ((e / (1 - lever)) ** 2)[:, None])
    check(models.linear_model(df, "y", ["x"], LEVELS), beta, np.sqrt(np.diag(inv @ meat @ inv)), len(ok), len(ok) - 5)
    clusters = sorted({r[4] for r in ok})
    u = np.array([sum((x[i] * e[i] for i, r in enumerate(ok) if r[4] == g), np.zeros(5)) for g in clusters])
    scale = len(clusters) / (len(clusters) - 1) * (len(ok) - 1) / (len(ok) - 5)
    check(models.linear_model(df, "y", ["x"], LEVELS, "CLUSTER", cluster="g"), beta, np.sqrt(np.diag(inv @ (u.T @ u * scale) @ inv)), len(ok), len(clusters) - 1)


def test_survey_errors_are_linearised(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    design = [r for r in data if r[5] > 0]
    ok, x, y = dense([r for r in design if r[7]])
    w = np.array([r[5] for r in ok])
    inv = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = inv @ x.T @ (w * y)
    score = x * (w * (y - x @ beta))[:, None]
    meat = np.zeros((5, 5))
    used = {(r[6], r[4]) for r in ok}
    for h in {r[6] for r in design}:
        units = sorted({r[4] for r in design if r[6] == h})
        u = np.array([sum((score[i] for i, r in enumerate(ok) if (r[6], r[4]) == (h, g)), np.zeros(5)) for g in units])
        u -= u.mean(axis=0)
        meat += len(units) / (len(units) - 1) * u.T @ u
    got = models.linear_model(df, "y", ["x"], LEVELS, "SURVEY", weight="w", stratum="h", psu="g", domain=models.F.col("keep"))
    check(got, beta, np.sqrt(np.diag(inv @ meat @ inv)), len(ok), len(used) - len({h for h, _ in used}))


def test_numbers_alone_agree_with_the_plain_fit(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = models.linear_model(df, "y", ["x", "d"]), statistics.least_squares(df, "y", ["x", "d"])
    np.testing.assert_allclose(a[["estimate", "se", "low", "high"]], b[["estimate", "se", "low", "high"]], rtol=1e-6)


def test_bad_designs_are_refused(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("twice", models.F.col("x") * 2 + 1).withColumn("nil", models.F.lit(0.0))
    for numeric, categorical, why in ((["x", "twice"], None, "follows"), (["nil"], None, "nowhere"), (["x"], {"c": (["a", "b"], "a")}, "not listed"), (["x"], {"c": (["a", "b"], "q")}, "reference"), (["x"], {"c": (["a", "b", "z", "none"], "a")}, "nowhere")):
        with pytest.raises(ValueError, match=why):
            models.linear_model(df, "y", numeric, categorical)
    with pytest.raises(ValueError, match="complete rows"):
        models.linear_model(df.limit(0), "y", ["x"])
    with pytest.raises(ValueError, match="covariance"):
        models.linear_model(df, "y", ["x"], covariance="HC9")


def test_planned_models_have_levels(spark):
    from cellwright.dataset import Dataset
    from cellwright.plans import runner

    df = spark.createDataFrame(rows(), SCHEMA)
    ds = Dataset(df, {"y": ("RESULT", "NUM")}, {"COLUMN": {c: {"ID": c.upper()} for c in ("y", "x", "c", "g", "w", "h")}})
    level = {"COLUMN_ID": "C", "LEVELS": ["a", "b", "z"], "REFERENCE": "b"}
    made = [{"TYPE": "MODEL", "NAME": n, "COVARIATE_IDS": xs, "CATEGORICAL": [level], "COVARIANCE": how, **more} for n, xs, how, more in (("m", ["X"], "HC3", {}), ("mc", [], "CLUSTER", {"CLUSTER_ID": "G"}), ("ms", ["X"], "SURVEY", {"WEIGHT_ID": "W", "STRATUM_ID": "H", "PSU_ID": "G"}))]
    tables = runner.run_step(ds, "ANALYZE", {"ANALYSES": made}).tables
    assert {k: [r.term for r in t.collect()] for k, t in tables.items()} == {"m:y": ["intercept", "x", "c=a", "c=z"], "mc:y": ["intercept", "c=a", "c=z"], "ms:y": ["intercept", "x", "c=a", "c=z"]}
    want = models.linear_model(df, "y", ["x"], {"c": (["a", "b", "z"], "b")})
    np.testing.assert_allclose([r.se for r in tables["m:y"].collect()], want["se"], rtol=1e-6)
