"""Compositions: chemistry modes, turnaround analysis, interval studies, and declared analysis plans.

All results are lazy tables by name; roles are bound by tag or given in the options.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset, as_list, ci
from ..functions import values as V
from ..functions.conditions import eligibility
from ..operators import intervals, laboratory, models, statistics, study, summaries
from ..operators.ordering import bounded_groups
from ..operators.starting import bind_roles
from .runner import Output, step


def result_columns(ds: Dataset, options: dict) -> list[str]:
    """By identity, by tag, by name, else every RESULT column."""
    if ids := as_list(ci(options, "RESULT_IDS")):
        return ds.resolve_all(*[f"id:{i}" for i in ids])
    if tags := as_list(ci(options, "RESULT_TAGS")):
        return ds.find(any_of=tags)
    return ds.resolve_all(*as_list(ci(options, "RESULT"))) if ci(options, "RESULT") else ds.find(any_of=["RESULT"])


def numbers(ds: Dataset, column: str, options: dict) -> Column:
    c = F.col(f"`{column}`")
    return V.comparator_value(c, str(ci(options, "POLICY", default="DELETE")).upper()) if dict(ds.df.dtypes)[column] == "string" else c.cast("double")


def instant(ds: Dataset, column: str) -> Column:
    c = F.col(f"`{column}`")
    return c if dict(ds.df.dtypes)[column].startswith(("timestamp", "date")) else V.temporal(c)


#: Mode -> roles it needs, and what it computes of (frame, bound columns, value).
MODES: dict[str, tuple[list[str], Callable]] = {
    "ITEM_COUNTS": (["test"], lambda df, r, x: laboratory.item_counts(df, r["test"])),
    "RESULT_SUMMARY": (["test"], lambda df, r, x: laboratory.result_summary(df, r["test"], x)),
    "RESULT_HISTOGRAM": (["test"], lambda df, r, x: summaries.histogram(df.withColumn("item", r["test"]), ["item"], x)),
    "INSTRUMENT_BIAS": (["test", "instrument"], lambda df, r, x: laboratory.instrument_bias(df, r["test"], r["instrument"], x)),
    "TAT_BY_TEST": (["test", "received", "reported"], lambda df, r, x: laboratory.turnaround(df, {"item": r["test"]}, r["received"], r["reported"])),
    "TAT_BY_INSTRUMENT": (["test", "instrument", "received", "reported"], lambda df, r, x: laboratory.turnaround(df, {"item": r["test"], "instrument": r["instrument"]}, r["received"], r["reported"])),
    "DAILY_WORKLOAD": (["test", "received"], lambda df, r, x: laboratory.workload(df, r["received"], r["test"])),
    "HOURLY_WORKLOAD": (["test", "received"], lambda df, r, x: laboratory.workload(df, r["received"], r["test"], "hour")),
    "AGE_SEX_RESULT": (["test", "sex", "age"], lambda df, r, x: laboratory.age_sex_summary(df, r["test"], r["sex"], r["age"], x)),
    "OUTLIERS_IQR": (["test"], lambda df, r, x: laboratory.tukey_outliers(df, r["test"], x)),
    "DELTA_CHECK": (["patient", "test", "reported"], lambda df, r, x: laboratory.delta(df, r["patient"], r["test"], r["reported"], x)),
}


def roles_of(ds: Dataset, options: dict) -> dict[str, Column]:
    out = {}
    for role, c in bind_roles(ds, ci(options, "ROLES")).items():
        cell = F.col(f"`{c}`")
        out[role] = instant(ds, c) if role in ("collected", "received", "reported") else F.coalesce(V.sex(cell.cast("string")), cell.cast("string")) if role == "sex" else V.age_years(cell) if role == "age" and dict(ds.df.dtypes)[c] == "string" else cell
    return out


@step("CHEMISTRY_ANALYSIS")
def chemistry(ds: Dataset, options: dict) -> Output:
    """One mode, or all that the bound roles allow; several results are stacked under their column's name."""
    roles = roles_of(ds, options)
    modes = [str(m).upper() for m in as_list(ci(options, "MODE"))] or list(MODES)
    tables, missing = {}, []
    for mode in modes:
        if mode == "MISSING_QUALITY":
            tables[mode] = summaries.state_counts(ds.df, ds.columns)
            continue
        need, f = MODES[mode]
        if lack := [n for n in need if n not in roles]:
            missing.append(f"{mode} needs {', '.join(lack)}")
            continue
        out = None
        for c in result_columns(ds, options) or [None]:
            t = f(ds.df, roles, numbers(ds, c, options) if c else F.lit(None).cast("double"))
            t = t.withColumn("result_column", F.lit(c or ""))
            out = t if out is None else out.unionByName(t)
        tables[mode] = out
    return Output("CHEMISTRY_ANALYSIS", ds, tables, "OK" if tables else "EMPTY", "; ".join(missing))


@step("LAB_TAT_ANALYSIS")
def lab_tat(ds: Dataset, options: dict) -> Output:
    points = {}
    for tag in dict.fromkeys(t for _, a, b in laboratory.STAGES for t in (a, b)):
        hits = ds.find(any_of=[tag, *([laboratory.POINT_ALIASES[tag]] if tag in laboratory.POINT_ALIASES else [])])
        if hits:
            points[tag] = instant(ds, hits[0]).cast("timestamp")
    keep = ds.find(any_of=["ID", "ITEM", "TESTNAME"])
    rows = laboratory.stage_rows(ds.df, points, keep, ci(options, "TARGETS"))
    by = ds.resolve_all(*as_list(ci(options, "BY"))) if ci(options, "BY") else []
    rows_by = laboratory.stage_rows(ds.df, points, list(dict.fromkeys([*keep, *by])), ci(options, "TARGETS")) if by else rows
    summary = laboratory.stage_summary(rows_by, by)
    return Output("LAB_TAT_ANALYSIS", ds, {"stages": rows, "summary": summary, "invalid": rows.where("status <> 'ok'"), "bottlenecks": laboratory.bottlenecks(summary)})


def reference_levels(df: DataFrame, item: Column, sex: Column, age: Column, value: Column, low: float = 0.025, high: float = 0.975, accuracy: int | None = None) -> DataFrame:
    """Intervals at four levels: item; with sex; with age band; with both.  Rows are exploded to levels, then aggregated once.

    Fewer than 40 values give no interval, fewer than 120 the median +- 1.96 scaled MAD, else quantiles.
    """
    x = df.select(item.alias("item"), sex.alias("sex"), V.age_band(age).alias("age_band"), value.cast("double").alias("x")).where("x is not null")
    lv = lambda name, s, a: F.struct(F.lit(name).alias("level"), (F.col("sex") if s else F.lit("ALL")).alias("sex"), (F.col("age_band") if a else F.lit("ALL")).alias("age_band"))
    long = x.select("item", "x", F.explode(F.array(lv("ITEM", 0, 0), lv("ITEM_SEX", 1, 0), lv("ITEM_AGE", 0, 1), lv("ITEM_SEX_AGE", 1, 1))).alias("g")).select("item", "g.*", "x").where("sex is not null and age_band is not null")
    keys = ["item", "level", "sex", "age_band"]
    q = long.groupBy(*keys).agg(F.count("*").alias("n"), summaries.quantiles(F.col("x"), [low, 0.5, high], accuracy).alias("q"))
    mad = long.join(q.select(*keys, F.col("q")[1].alias("med")), keys).groupBy(*keys).agg(summaries.quantile(F.abs(F.col("x") - F.col("med")), 0.5, accuracy).alias("mad"))
    grade = intervals.reliability(F.col("n"))
    half = 1.96 * 1.4826 * F.col("mad")
    pick = lambda i, s: F.round(F.when(grade == "robust", F.col("q")[1] + s * half).when(grade == "nonparametric", F.col("q")[i]), 6)
    return q.join(mad, keys).select(*keys, "n", grade.alias("method"), F.round(F.col("q")[1], 6).alias("median"), pick(0, -1).alias("low"), pick(2, 1).alias("high"))


@step("REFERENCE_INTERVAL")
def reference_interval(ds: Dataset, options: dict) -> Output:
    r = roles_of(ds, options)
    item, sex, age = r.get("test", F.lit("ALL")), r.get("sex", F.lit("ALL")), r.get("age", F.lit(None).cast("double"))
    tables = {}
    for c in result_columns(ds, options):
        x = numbers(ds, c, options)
        tables[f"{c}:intervals"] = reference_levels(ds.df, item, sex, age, x)
        tables[f"{c}:sex"] = intervals.harris_boyd(ds.df.withColumn("item", item), ["item"], sex, x)
        tables[f"{c}:overlap"] = study.interval_overlap(ds.df.withColumn("item", item), ["item"], sex, x)
    return Output("REFERENCE_INTERVAL", ds, tables)


@step("RI_EP28")
def interval_study(ds: Dataset, options: dict) -> Output:
    """A study of intervals: cohort, latent exclusion, then each method by partition, with its status, and what else was found.

    INCLUDE (tests of the cohort), PARTITION, METHOD (the first is the primary one), OUTLIERS, TRIM (once, on the fitted scale), CI_METHOD, BOOTSTRAP_N, BOOTSTRAP_TYPE,
    BOOTSTRAP_QUANTILE, CI_LEVEL, COVERAGE, MIN_N, VERIFY_LOW and VERIFY_HIGH, CONFIRMED (the population is one of reference individuals), SUBJECT (selector), DECIMALS, and
    LAVE with REFERENCE (selectors), MAX_ABNORMAL, EXPANSION, ITERATIONS, METHOD and MISSING_POLICY.
    """
    df, audit_tests = ds.df, []
    if tests := as_list(ci(options, "INCLUDE")):
        holds, _ = eligibility(tests, {t["COLUMN_ID"]: ds.col(f"id:{t['COLUMN_ID']}") for t in tests})
        audit_tests = [("NOT_INCLUDED", ~holds)]
    tables = {"audit": study.input_audit(df, audit_tests)}
    if audit_tests:
        df = df.where(holds)
    by = ds.resolve_all(*as_list(ci(options, "PARTITION"))) if ci(options, "PARTITION") else []
    df = df.withColumn("_all", F.lit("ALL"))
    by = by or ["_all"]
    subject = ds.resolve(str(ci(options, "SUBJECT"))) if ci(options, "SUBJECT") else None
    results, members, notes = result_columns(ds, options), None, []
    if spec := ci(options, "LAVE"):
        members, tables["lave:history"], settled = _exclusion(ds, df, results, subject, spec, options)
        tables["lave:members"] = members
        notes += [] if settled else ["latent exclusion did not settle: exploratory only"]
    methods = [str(m).upper() for m in as_list(ci(options, "METHOD", default=["NONPARAMETRIC"]))]
    settings = {
        "repetitions": int(ci(options, "BOOTSTRAP_N", default=0)), "how": str(ci(options, "CI_METHOD", default="AUTO")).upper(), "coverage": float(ci(options, "COVERAGE", default=0.95)), "confidence": float(ci(options, "CI_LEVEL", default=0.90)),
        "kind": str(ci(options, "BOOTSTRAP_TYPE", default="PERCENTILE")).upper(), "quantile": str(ci(options, "BOOTSTRAP_QUANTILE", default="TYPE7")).upper(),
    }
    trim = float(ci(options, "TRIM")) if ci(options, "TRIM") else None
    for c in results:
        x = numbers(ds, c, options)
        base = df
        if members is not None:
            kept = members.where(F.col("included") & (F.col("target") == c)).select(F.col("subject").alias("_subject"))
            base = df.join(kept, F.col(f"`{subject}`").eqNullSafe(F.col("_subject")), "left_semi")
        parts = [intervals.reference_intervals(base, by, x, m, ci(options, "OUTLIERS"), trim=trim if m in TRIMMED else None, **settings).withColumn("method", F.lit(m)) for m in methods]
        cell = F.col(f"`{c}`").cast("string")
        bounded = base.groupBy(*by).agg(F.sum(F.coalesce(V.comparator_sign(cell).isin("<", "<=", ">", ">="), F.lit(False)).cast("bigint")).alias("censored"))
        tables[f"{c}:limits"] = _judged(reduce(DataFrame.unionByName, parts).join(bounded, by), by, subject is not None, options)
        # The primary method without exclusion, outliers or trimming, beside what the study reports.
        plain = intervals.reference_intervals(df, by, x, methods[0], **{**settings, "how": "NONE"}).select(*by, F.col("n").alias("n_all"), F.col("low").alias("low_all"), F.col("high").alias("high_all"))
        tables[f"{c}:sensitivity"] = parts[0].select(*by, "n", "low", "high").join(plain, by).select("*", *[F.round(F.col(k) - F.col(f"{k}_all"), 6).alias(f"{k}_shift") for k in ("low", "high")])
        tables[f"{c}:normality"] = study.normality(base, by, x)
        if len(by) == 1 and by != ["_all"]:
            g = F.col(f"`{by[0]}`")
            tables[f"{c}:partition"] = intervals.harris_boyd(base, [], g, x)
            tables[f"{c}:wilcoxon"] = study.wilcoxon_pairs(base, g, x)
            tables[f"{c}:sdr"] = intervals.standard_deviation_ratio(base, g, x)
            tables[f"{c}:bias"] = _bias_pairs(base, by[0], x)
        if low := ci(options, "VERIFY_LOW"):
            tables[f"{c}:tails"] = intervals.tails(base, by, x, float(low), float(ci(options, "VERIFY_HIGH")))
    return Output("RI_EP28", ds, tables, message="; ".join(notes))


#: Methods that trimming is for.
TRIMMED = ("PARAMETRIC", "LOG_PARAMETRIC", "BOXCOX_PARAMETRIC", "BOXCOX_SHIFTED_PARAMETRIC")


def _exclusion(ds: Dataset, df: DataFrame, results: list[str], subject: str | None, spec: dict, options: dict) -> tuple[DataFrame, DataFrame, bool]:
    """Latent exclusion over the wide result columns: they are melted to (subject, item, value) first."""
    if subject is None:
        raise ValueError("LAVE needs SUBJECT")
    panel = ds.resolve_all(*as_list(ci(spec, "REFERENCE"))) if ci(spec, "REFERENCE") else results
    cells = F.array(*[F.struct(F.lit(c).alias("item"), numbers(ds, c, options).alias("x")) for c in dict.fromkeys([*panel, *results])])
    long = df.select(F.col(f"`{subject}`").alias("subject"), F.explode(cells).alias("e")).select("subject", "e.*")
    return intervals.latent_exclusion(
        long, F.col("item"), F.col("subject"), F.col("x"), results, int(ci(spec, "MAX_ABNORMAL", default=1)), float(ci(spec, "EXPANSION", default=intervals.LAVE_EXPANSION)),
        int(ci(spec, "ITERATIONS", default=intervals.LAVE_ROUNDS)), str(ci(spec, "METHOD", default="NONPARAMETRIC")).upper(), str(ci(spec, "MISSING_POLICY", default="EXCLUDE")).upper(), panel,
    )


def _judged(limits: DataFrame, by: list[str], subjects: bool, options: dict) -> DataFrame:
    """Limits with the adequacy of their confidence limits and one word of status; clamped and rounded if asked for."""
    ends = lambda k: (F.col(f"{k}_from"), F.col(f"{k}_to"))
    adequacy = intervals.ci_adequacy(F.col("low"), F.col("high"), ends("low"), ends("high"), float(ci(options, "CI_WIDTH", default=0.2)))
    parametric = F.col("method").isin(*TRIMMED)
    out = limits.withColumn("adequacy", adequacy)
    status = intervals.interval_status(
        F.col("n"), F.col("low"), F.col("high"), order_resolved=F.col("note") != "the tails lie beyond the ranks", confirmed=F.lit(bool(ci(options, "CONFIRMED", default=False))), subjects_known=F.lit(subjects),
        censored=F.col("censored"), adequacy=F.col("adequacy"), fits=~parametric | F.coalesce(F.col("fit_p") >= 0.05, F.lit(False)), least=F.col("least"), min_n=int(ci(options, "MIN_N", default=intervals.MIN_NONPARAMETRIC)),
    )
    out = out.withColumn("status", status)
    if ci(options, "DECIMALS") is not None or ci(options, "CLAMP"):
        least = F.col("least") if ci(options, "CLAMP", default=True) else F.lit(-1.0)
        out = intervals.adjust_limits(out, least, ["low", "high", "low_from", "low_to", "high_from", "high_to"], None if ci(options, "DECIMALS") is None else int(ci(options, "DECIMALS")))
    return out


def _bias_pairs(df: DataFrame, by: str, x: Column) -> DataFrame:
    """Bias ratios of every pair of at most 64 groups against the pooled interval: one row a group is compared."""
    bounded_groups(df, F.col(f"`{by}`"))
    cut = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    v = df.select(F.col(f"`{by}`").cast("string").alias("g"), x.cast("double").alias("x")).where("x is not null and g is not null")
    each, pooled = v.groupBy("g").agg(cut("x").alias("q")), v.agg(cut("x").alias("p"))
    ends = lambda c: (F.col(c)[0], F.col(c)[1])
    pairs = each.select(F.col("g").alias("group_a"), F.col("q").alias("a")).join(each.select(F.col("g").alias("group_b"), F.col("q").alias("b")), F.col("group_a") < F.col("group_b")).crossJoin(F.broadcast(pooled))  # one row
    return pairs.select("group_a", "group_b", intervals.bias_ratio(ends("a"), ends("b"), ends("p")).alias("r")).select("group_a", "group_b", "r.*")


#: Types of planned analyses, the options each needs beside its results, and those it may have.
ANALYSES: dict[str, tuple[set[str], set[str]]] = {
    "SUMMARY": (set(), {"POLICY"}),
    "HISTOGRAM": ({"LOW", "HIGH"}, {"BINS", "LOG", "POLICY"}),
    "SURVEY_MEAN": ({"WEIGHT_ID", "STRATUM_ID", "PSU_ID"}, {"POLICY"}),
    "SURVEY_CONTRAST": ({"WEIGHT_ID", "STRATUM_ID", "PSU_ID", "GROUP_A", "GROUP_B"}, {"POLICY"}),
    "BOUNDS": ({"WEIGHT_ID", "LOWER", "UPPER"}, {"POLICY"}),
    "ROC": ({"LABEL_ID"}, {"POLICY"}),
    "GROUP_TEST": ({"BY_ID"}, {"POLICY"}),
    "CORRELATION": ({"WITH_IDS"}, {"METHOD"}),
    "MODEL": ({"COVARIATE_IDS"}, {"CATEGORICAL", "COVARIANCE", "CLUSTER_ID", "WEIGHT_ID", "STRATUM_ID", "PSU_ID", "GROUP"}),
    "INTERVALS": (set(), {"BY_ID", "METHOD", "OUTLIERS", "POLICY"}),
}
_EVERY = {"TYPE", "NAME", "RESULT_IDS", "RESULT_TAGS", "RESULT"}


def plan_problems(ds: Dataset, plan: dict) -> list[str]:
    """Everything that is wrong with a plan, before any of it runs."""
    out, groups, seen = [], {"ALL"}, set()
    ids = {ds.column_id(c) for c in ds.columns} - {None}
    if odd := {str(k).upper() for k in plan} - {"GROUPS", "ANALYSES"}:
        out.append(f"unknown key {', '.join(sorted(odd))}")
    for name, tests in (ci(plan, "GROUPS", default={}) or {}).items():
        groups.add(name)
        for t in as_list(tests):
            keys = {str(k).upper() for k in t}
            if "COLUMN_ID" not in keys or t.get("COLUMN_ID") not in ids:
                out.append(f"group {name}: no column has the identity {t.get('COLUMN_ID')!r}")
            if not keys - {"COLUMN_ID"} or keys - {"COLUMN_ID", "MIN", "MAX", "MIN_EXCLUSIVE", "MAX_EXCLUSIVE", "IN_NUMBERS", "IN_TEXT"}:
                out.append(f"group {name}: a test needs MIN, MAX, MIN_EXCLUSIVE, MAX_EXCLUSIVE, IN_NUMBERS or IN_TEXT, and nothing else")
    for i, a in enumerate(as_list(ci(plan, "ANALYSES"))):
        keys, kind = {str(k).upper() for k in a}, str(ci(a, "TYPE")).upper()
        name = str(ci(a, "NAME", default=f"{i + 1}_{kind}"))
        if kind not in ANALYSES:
            out.append(f"{name}: unknown analysis {kind!r}")
            continue
        if name in seen:
            out.append(f"{name}: the name repeats")
        seen.add(name)
        need, may = ANALYSES[kind]
        if lack := need - keys:
            out.append(f"{name}: lacks {', '.join(sorted(lack))}")
        if odd := keys - need - may - _EVERY:
            out.append(f"{name}: unknown option {', '.join(sorted(odd))}")
        for k in keys:
            if k.endswith(("_ID", "_IDS")):
                out += [f"{name}: no column has the identity {v!r}" for v in as_list(ci(a, k)) if v not in ids]
        out += [f"{name}: unknown group {ci(a, k)!r}" for k in ("GROUP_A", "GROUP_B", "GROUP") if k in keys and ci(a, k) not in groups]
        if kind == "MODEL":
            out += [f"{name}: {why}" for why in _model_problems(a, keys)]
    return out


def _model_problems(a: dict, keys: set[str]) -> list[str]:
    kind = str(ci(a, "COVARIANCE", default="HC3")).upper()
    need = {"HC3": set(), "CLUSTER": {"CLUSTER_ID"}, "SURVEY": {"WEIGHT_ID", "STRATUM_ID", "PSU_ID"}}
    if kind not in need:
        return [f"COVARIANCE must be one of {', '.join(need)}"]
    odd = ({"CLUSTER_ID", "WEIGHT_ID", "STRATUM_ID", "PSU_ID"} & keys) - need[kind]
    return ([f"{kind} lacks {', '.join(sorted(need[kind] - keys))}"] if need[kind] - keys else []) + ([f"{', '.join(sorted(odd))} has no meaning with {kind}"] if odd else [])


def _table(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows)


@step("ANALYZE")
def analyze(ds: Dataset, options: dict) -> Output:
    """A declared plan: GROUPS (name -> tests, which may overlap) and ANALYSES (TYPE and options, see ANALYSES).  A plan with any problem is refused whole."""
    plan = options or ci(ds.meta, "ANALYSIS_PLAN", default={}) or {}
    if problems := plan_problems(ds, plan):
        raise ValueError("; ".join(problems))
    groups: dict[str, Column] = {"ALL": F.lit(True)}
    for name, tests in (ci(plan, "GROUPS", default={}) or {}).items():
        tests = as_list(tests)
        groups[name], _ = eligibility(tests, {t["COLUMN_ID"]: ds.col(f"id:{t['COLUMN_ID']}") for t in tests})
    tables: dict[str, DataFrame] = {}
    for i, a in enumerate(as_list(ci(plan, "ANALYSES"))):
        kind = str(ci(a, "TYPE")).upper()
        name = str(ci(a, "NAME", default=f"{i + 1}_{kind}"))
        cols = [c for k in as_list(ci(a, "RESULT_IDS")) for c in ds.resolve_all(f"id:{k}")] or result_columns(ds, a)
        for c in cols:
            for part, table in _planned(ds, kind, a, c, groups).items():
                tables[":".join(x for x in (name, c, part) if x)] = table
    return Output("ANALYZE", ds, tables)


def _planned(ds: Dataset, kind: str, a: dict, c: str, groups: dict[str, Column]) -> dict[str, DataFrame]:
    spark, x = ds.df.sparkSession, numbers(ds, c, a)
    by_id = lambda k: ds.col(f"id:{ci(a, k)}")
    name_of = lambda v: ds.resolve(f"id:{v}")
    if kind == "SUMMARY":
        return {"": study.sample_summary(ds.df, groups, c, str(ci(a, "POLICY", default="DELETE")).upper())}
    if kind == "HISTOGRAM":
        return {"": study.fixed_histogram(ds.df, x, float(ci(a, "LOW")), float(ci(a, "HIGH")), int(ci(a, "BINS", default=10)), bool(ci(a, "LOG", default=False)))}
    if kind == "SURVEY_MEAN":
        return {g: statistics.survey_mean(ds.df, x, by_id("WEIGHT_ID"), by_id("STRATUM_ID"), by_id("PSU_ID"), inside) for g, inside in groups.items()}
    if kind == "SURVEY_CONTRAST":
        return {"": statistics.survey_contrast(ds.df, x, by_id("WEIGHT_ID"), by_id("STRATUM_ID"), by_id("PSU_ID"), groups[ci(a, "GROUP_A")], groups[ci(a, "GROUP_B")])}
    if kind == "BOUNDS":
        return {"": statistics.missingness_bounds(ds.df, x, by_id("WEIGHT_ID"), float(ci(a, "LOWER")), float(ci(a, "UPPER")))}
    if kind == "ROC":
        return {"": statistics.roc_auc(ds.df, x, by_id("LABEL_ID").cast("int") == 1)}
    if kind == "GROUP_TEST":
        got = statistics.group_test(ds.df, by_id("BY_ID"), x)
        return {"": _table(spark, [(k, float(v)) for k, v in got.items()]).toDF("statistic", "value")}
    if kind == "CORRELATION":
        return {"": statistics.correlation(ds.df, [c, *[name_of(v) for v in as_list(ci(a, "WITH_IDS"))]], str(ci(a, "METHOD", default="pearson")).lower())}
    if kind == "INTERVALS":
        by = [name_of(v) for v in as_list(ci(a, "BY_ID"))]
        frame = ds.df if by else ds.df.withColumn("_all", F.lit("ALL"))
        return {"": intervals.reference_intervals(frame, by or ["_all"], x, str(ci(a, "METHOD", default="NONPARAMETRIC")).upper(), ci(a, "OUTLIERS"))}
    xs = [name_of(v) for v in as_list(ci(a, "COVARIATE_IDS"))]
    inside = groups[ci(a, "GROUP", default="ALL")]
    how = str(ci(a, "COVARIANCE", default="HC3")).upper()
    if levels := as_list(ci(a, "CATEGORICAL")):
        # Each {COLUMN_ID, LEVELS, REFERENCE}; COVARIATE_IDS may be empty beside them.
        listed = {name_of(ci(v, "COLUMN_ID")): (as_list(ci(v, "LEVELS")), ci(v, "REFERENCE")) for v in levels}
        keys = {k: name_of(ci(a, f"{k}_ID".upper())) for k in {"CLUSTER": ("cluster",), "SURVEY": ("weight", "stratum", "psu")}.get(how, ())}
        fit = models.linear_model(ds.df.withColumn("_y", x), "_y", xs, listed, how, domain=inside, **keys)
    elif how == "SURVEY":
        fit = statistics.survey_regression(ds.df.withColumn("_y", x), "_y", xs, *[name_of(ci(a, k)) for k in ("WEIGHT_ID", "STRATUM_ID", "PSU_ID")], inside)
    else:
        fit = statistics.least_squares(ds.df.where(inside).withColumn("_y", x), "_y", xs, name_of(ci(a, "CLUSTER_ID")) if how == "CLUSTER" else None)
    return {"": _table(spark, fit)}
