"""Linear models with numeric and categorical covariates; HC3, cluster and survey errors.

A row is the list of its non-zero terms: the intercept, its numbers, and for each categorical covariate its level unless that is the reference.
Cross products are summed by pair of terms from those lists, never over columns of zeros and ones; only sums by term or
pair, of a number of terms that is checked, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as S

#: Most terms of a model, and the smallest share of a term's own square that the other terms may leave of it.
MAX_TERMS, TOLERANCE = 512, 1e-10
COVARIANCES = ("HC3", "CLUSTER", "SURVEY")


def _pairs(entries: Column) -> Column:
    """Pairs (i <= j) of a list of terms, with the product of their values."""
    each = F.transform(entries, lambda a: F.transform(F.filter(entries, lambda b: b["i"] >= a["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["v"]).alias("v"))))
    return F.explode(F.flatten(each))


def _square(rows: list, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _by_pair(df: DataFrame, entries: Column, weight: Column, k: int) -> np.ndarray:
    """Sums of products of terms over rows, combined on the map side."""
    return _square(df.select(weight.alias("w"), _pairs(entries).alias("p")).groupBy("p.i", "p.j").agg(F.sum(F.col("w") * F.col("p.v")).alias("v")).collect(), k)


def _rank_checked(xx: np.ndarray, terms: list[str]) -> np.ndarray:
    """The inverse, term by term of a scaled elimination; a term that the ones before it explain is an error."""
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    if (scale == 0).any():
        raise ValueError(f"term {terms[int(np.argmin(scale))]!r} is nowhere but 0")
    r = xx / np.outer(scale, scale)
    left = r.copy()
    for i in range(len(terms)):
        if left[i, i] < TOLERANCE:
            raise ValueError(f"term {terms[i]!r} follows from those before it")
        left[i + 1 :] -= np.outer(left[i + 1 :, i] / left[i, i], left[i])
    return np.linalg.inv(r) / np.outer(scale, scale)


def linear_model(
    df: DataFrame, y: str, numeric: Sequence[str] = (), categorical: Mapping[str, tuple[Sequence[str], str]] | None = None, covariance: str = "HC3", cluster: str | None = None,
    weight: str | None = None, stratum: str | None = None, psu: str | None = None, domain: Column | None = None,
) -> pd.DataFrame:
    """Term, estimate, se, low, high, p, n, df of least squares on complete rows of a domain.

    ``categorical`` maps a column to its levels and the reference among them; a level that is not listed is an error, a missing one leaves its row
    out.  HC3 needs more rows than terms; CLUSTER at least two clusters (small-sample correction); SURVEY takes weights, strata and PSUs:
    rows of positive weight keep their PSU in the design, also outside the domain.
    """
    if covariance not in COVARIANCES:
        raise ValueError(f"unknown covariance {covariance}")
    categorical = {c: ([str(v) for v in levels], str(reference)) for c, (levels, reference) in (categorical or {}).items()}
    terms, at = ["intercept", *numeric], {}
    for c, (levels, reference) in categorical.items():
        if reference not in levels or len(set(levels)) < len(levels):
            raise ValueError(f"levels of {c!r} repeat or lack the reference")
        for v in levels:
            if v != reference:
                at[c, v] = len(terms)
                terms.append(f"{c}={v}")
    k = len(terms)
    if k > MAX_TERMS:
        raise ValueError(f"{k} terms, at most {MAX_TERMS}")
    q = lambda c: F.col(f"`{c}`")
    entry = lambda i, v: F.struct(F.lit(i).alias("i"), v.alias("v"))
    parts = [F.array(entry(0, F.lit(1.0)), *[entry(i + 1, q(c).cast("double")) for i, c in enumerate(numeric)])]
    known, odd = F.lit(True), F.lit(False)
    for c in numeric:
        x = q(c).cast("double")
        known = known & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    for c, (levels, reference) in categorical.items():
        text = q(c).cast("string")
        known, odd = known & text.isNotNull(), odd | F.coalesce(~text.isin(levels), F.lit(False))
        where = F.lit(-1)
        for v in levels:
            if v != reference:
                where = F.when(text == v, at[c, v]).otherwise(where)
        parts.append(F.filter(F.array(F.struct(where.alias("i"), F.lit(1.0).alias("v"))), lambda e: e["i"] >= 0))
    yy = q(y).cast("double")
    use = known & yy.isNotNull() & ~F.isnan(yy) & (F.coalesce(domain, F.lit(False)) if domain is not None else F.lit(True))
    w = q(weight).cast("double") if covariance == "SURVEY" else F.lit(1.0)
    groups = {"CLUSTER": [(cluster, "g")], "SURVEY": [(stratum, "h"), (psu, "g")]}.get(covariance, [])
    base = df.select(F.concat(*parts).alias("x"), yy.alias("y"), F.coalesce(use, F.lit(False)).alias("use"), F.coalesce(odd, F.lit(False)).alias("odd"), w.alias("w"), *[q(c).alias(n) for c, n in groups]).where("w > 0")
    active = base.where("use")
    seen = base.agg(F.sum(F.col("use").cast("bigint")).alias("n"), F.sum(F.col("odd").cast("bigint")).alias("odd")).first()
    if seen.odd:
        raise ValueError("a categorical covariate has levels that are not listed")
    n = seen.n or 0
    if n <= k:
        raise ValueError(f"{n} complete rows for {k} terms")
    inverse = _rank_checked(_by_pair(active, F.col("x"), F.col("w"), k), terms)
    xy = np.zeros(k)
    for r in active.select("w", "y", F.explode("x").alias("e")).groupBy("e.i").agg(F.sum(F.col("w") * F.col("y") * F.col("e.v")).alias("v")).collect():
        xy[r["i"]] = r["v"]
    beta = inverse @ xy
    fitted = df.sparkSession.createDataFrame([([float(b) for b in beta], [float(v) for v in inverse.ravel()])], "b array<double>, m array<double>")  # one row of at most MAX_TERMS squared
    held = active.crossJoin(F.broadcast(fitted))
    product = lambda e: F.element_at("b", e["i"] + 1) * e["v"]
    e = F.col("y") - F.aggregate("x", F.lit(0.0), lambda s, a: s + product(a))
    if covariance == "HC3":
        cell = lambda a, b: F.element_at("m", a["i"] * k + b["i"] + 1) * a["v"] * b["v"]
        lever = F.aggregate("x", F.lit(0.0), lambda s, a: s + F.aggregate("x", F.lit(0.0), lambda t, b: t + cell(a, b)))
        meat, dof = _by_pair(held.select("x", F.pow(e / (1 - lever), 2.0).alias("q")), F.col("x"), F.col("q"), k), n - k
    else:
        keys = [name for _, name in groups]
        scores = held.select(*keys, (F.col("w") * e).alias("u"), F.explode("x").alias("a")).groupBy(*keys, "a.i").agg(F.sum(F.col("u") * F.col("a.v")).alias("v"))
        lists = scores.groupBy(*keys).agg(F.collect_list(F.struct("i", "v")).alias("u"))  # at most a value a term
        if covariance == "CLUSTER":
            units = lists.count()
            if units < 2:
                raise ValueError("cluster errors need two clusters")
            meat, dof = _by_pair(lists, F.col("u"), F.lit(1.0), k) * (units / (units - 1) * (n - 1) / (n - k)), units - 1
        else:
            design = base.groupBy("h", "g").agg(F.max(F.col("use").cast("int")).alias("used")).groupBy("h").agg(F.count("*").alias("psus"), F.sum("used").alias("used"))
            total = design.agg(F.sum("used").alias("psus"), F.sum((F.col("used") > 0).cast("int")).alias("strata")).first()
            dof = total.psus - total.strata
            factor = F.when(F.col("psus") > 1, F.col("psus") / (F.col("psus") - 1)).otherwise(0.0)
            keyed = design.select(F.col("h").alias("s"), "psus")
            same = F.col("h").eqNullSafe(F.col("s"))
            sums = scores.groupBy("h", "i").agg(F.sum("v").alias("v")).groupBy("h").agg(F.collect_list(F.struct("i", "v")).alias("u"))
            meat = _by_pair(lists.join(keyed, same), F.col("u"), factor, k) - _by_pair(sums.join(keyed, same), F.col("u"), factor / F.col("psus"), k)
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    t = S.t_quantile(0.975, dof) if dof > 0 else math.nan
    p = [2 * (1 - S.t_cdf(abs(b / s), dof)) if dof > 0 and s > 0 else math.nan for b, s in zip(beta, se, strict=True)]
    return pd.DataFrame({"term": terms, "estimate": beta, "se": se, "low": beta - t * se, "high": beta + t * se, "p": p, "n": n, "df": int(dof)})
