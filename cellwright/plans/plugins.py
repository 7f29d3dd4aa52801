"""Analyses as steps: flags, autoverification, trends, control charts, method comparison, tests, survey means, evaluation.

Each binds columns by option (a selector) or by tag, and returns lazy tables; the work is in ``operators``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import Dataset, as_list, ci
from ..functions import values as V
from ..operators import checks, integration, laboratory, multirule, starting, statistics, summaries
from .analyses import instant, numbers, result_columns, roles_of
from .runner import Output, step


def _column(ds: Dataset, options: dict, key: str, *tags: str, need: bool = True) -> str | None:
    """The column an option names, else the only one with one of the tags."""
    if ci(options, key):
        return ds.resolve(str(ci(options, key)))
    hits = ds.find(any_of=list(tags)) if tags else []
    if len(hits) == 1:
        return hits[0]
    if need:
        raise ValueError(f"{key} is not given, and {len(hits)} columns have the tags {', '.join(tags)}")
    return None


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


@step("NORMALIZE_CATEGORIES")
def _categories(ds: Dataset, options: dict) -> Output:
    return Output("NORMALIZE_CATEGORIES", starting.normalise_categories(ds))


@step("NORMALIZE_DATETIMES")
def _datetimes(ds: Dataset, options: dict) -> Output:
    return Output("NORMALIZE_DATETIMES", starting.normalise_dates(ds, as_list(ci(options, "FORMATS")) or None))


@step("CENSOR")
def _censor(ds: Dataset, options: dict) -> Output:
    """COLUMNS: column -> FLAG (selector), BELOW (code), LIMIT (number or selector), NAME (default <column>_cens)."""
    df, tags = ds.df, {}
    for name, spec in (ci(options, "COLUMNS", default={}) or {}).items():
        c, limit = ds.resolve(name), ci(spec, "LIMIT")
        new = str(ci(spec, "NAME", default=f"{c}_cens"))
        bound = F.lit(limit) if isinstance(limit, int | float) else ds.col(str(limit))
        df = df.withColumn(new, starting.censor(_q(c), ds.col(str(ci(spec, "FLAG"))), str(ci(spec, "BELOW", default="1")), bound))
        tags[new] = ("RESULT", "<NUM>")
    return Output("CENSOR", ds.with_df(df, **tags))


@step("EVALUATE")
def _evaluate(ds: Dataset, options: dict) -> Output:
    """Quality of a dataset in one row, and its cells against a BASELINE dataset by KEY."""
    cells = summaries.state_counts(ds.df, ds.columns).agg(*[F.sum(s.lower()).alias(s.lower()) for s in V.STATES])
    found = checks.issues(ds).agg(F.count("*").alias("issues"), F.count_distinct("column").alias("columns_with_issues"))
    quality = cells.crossJoin(found).crossJoin(ds.df.agg(F.count("*").alias("rows")))  # one row each
    filled = F.col("value") / (F.col("value") + F.col("absent") + F.col("null") + F.col("empty") + F.col("ws"))
    tables = {"quality": quality.select("rows", F.lit(len(ds.columns)).alias("columns"), *[s.lower() for s in V.STATES], F.round(filled, 6).alias("filled"), "issues", "columns_with_issues")}
    if (other := ci(options, "BASELINE")) is not None:
        if not isinstance(other, Dataset):
            from ..sources.tables import read_any

            other = read_any(ds.df.sparkSession, str(other))
        compared = integration.compare_outputs(other.df, ds.df, ds.resolve(str(ci(options, "KEY"))))
        tables |= {"comparison": compared, "improvements": compared.where("unequal > 0")}
    return Output("EVALUATE", ds, tables)


# Flags --------------------------------------------------------------------------


def bounds_of(ds: Dataset, column: str) -> tuple[Column, Column]:
    """A result's reference bounds: REFERENCE_INTERVAL of its controls, its pivot context, else the columns tagged REF_LOW and REF_HIGH."""
    spec = ci(ci(ds.meta, "COLUMN", default={}), column, default={}) or {}
    own = ci(spec, "REFERENCE_INTERVAL") or {}
    context = ci(spec, "PIVOT_CONTEXT") or {}
    ends = []
    for key in ("LOW", "HIGH"):
        given = ci(own, key, default=ci(context, f"REF_{key}"))
        tagged = ds.find(any_of=[f"REF_{key}"])
        ends.append(F.lit(None if given is None else float(given)).cast("double") if given is not None or not tagged else V.comparator_number(_q(tagged[0])))
    return ends[0], ends[1]


def applies(ds: Dataset, column: str, at: Column | None) -> Column:
    """Whether the declared interval is valid at the time of a row."""
    own = ci(ci(ci(ds.meta, "COLUMN", default={}), column, default={}) or {}, "REFERENCE_INTERVAL") or {}
    tests = []
    if ci(own, "VALID_FROM") and at is not None:
        tests.append(at >= F.lit(str(ci(own, "VALID_FROM"))).cast("timestamp"))
    if ci(own, "VALID_TO") and at is not None:
        tests.append(at < F.lit(str(ci(own, "VALID_TO"))).cast("timestamp"))
    return F.coalesce(V.all_of(tests), F.lit(False)) if tests else F.lit(True)


def with_flags(ds: Dataset, column: str, at: Column | None = None) -> DataFrame:
    """``<column>_flag`` and ``<column>_reason`` beside the data."""
    low, high = bounds_of(ds, column)
    valid = applies(ds, column, at)
    x = ds.df.withColumns({"_low": F.when(valid, low), "_high": F.when(valid, high), "_valid": valid})
    x = laboratory.flag_results(x, _q(column), F.col("_low"), F.col("_high"), f"{column}_flag", keep_parsed=True)
    reason = F.when(~F.col("_valid"), "OUTSIDE_VALIDITY").when(F.col("_low").isNull() & F.col("_high").isNull(), "NO_INTERVAL").when(F.col("_number").isNull(), "NO_NUMBER").when(_q(f"{column}_flag") == "IND", "BOUNDED_RESULT").otherwise("")
    return x.withColumn(f"{column}_reason", reason).drop("_low", "_high", "_valid", "_sign", "_number")


@step("ABNORMAL_FLAG")
def _flag(ds: Dataset, options: dict) -> Output:
    """MODE FLAG adds flag and reason of each result; RATE counts flags by GROUP (default: the test)."""
    at = roles_of(ds, options).get("reported")
    out, tables = ds, {}
    for c in result_columns(ds, options):
        out = out.with_df(with_flags(out, c, at), **{f"{c}_flag": ("CATEGORY",), f"{c}_reason": ("STR",)})
    if str(ci(options, "MODE", default="FLAG")).upper() == "RATE":
        by = ds.resolve_all(*as_list(ci(options, "GROUP"))) if ci(options, "GROUP") else ds.find(any_of=["ITEM", "TESTNAME"])[:1]
        for c in result_columns(ds, options):
            tables[f"{c}:rate"] = laboratory.abnormal_rate(out.df, {b: _q(b) for b in by} or {"all": F.lit("ALL")}, _q(f"{c}_flag"))
        return Output("ABNORMAL_FLAG", ds, tables)
    return Output("ABNORMAL_FLAG", out, tables)


@step("AUTOVERIFICATION")
def _autoverify(ds: Dataset, options: dict) -> Output:
    """decision and reasons of each result: CRITICAL_LOW, CRITICAL_HIGH, DELTA_ABS, DELTA_PERCENT and HOLD_INSTRUMENTS are the limits.

    A patient's results of one test at one time repeat the series: they are refused where deltas are asked for.
    """
    roles, out = roles_of(ds, options), ds
    number = lambda key: None if ci(options, key) is None else float(ci(options, key))
    for c in result_columns(ds, options):
        x = V.with_parsed(with_flags(out, c, roles.get("reported")), _q(c))
        change = share = F.lit(None).cast("double")
        if {"patient", "test", "reported"} <= set(roles) and (number("DELTA_ABS") is not None or number("DELTA_PERCENT") is not None):
            w = Window.partitionBy("_p", "_t").orderBy("_at")
            x = x.withColumns({"_p": roles["patient"], "_t": roles["test"], "_at": roles["reported"], "_x": F.when(F.col("_sign").isin("", "="), F.col("_number"))})
            x = x.withColumns({"_was": F.lag("_x").over(w), "_twice": F.lag("_at").over(w) == F.col("_at")})
            x = x.withColumn("_x", F.when(F.coalesce(F.col("_twice"), F.lit(False)), F.raise_error(F.lit("two results of one patient, test and time")).cast("double")).otherwise(F.col("_x")))
            change = F.abs(F.col("_x") - F.col("_was"))
            share = F.when(F.col("_was") != 0, 100 * change / F.abs(F.col("_was")))
        decision, why = laboratory.autoverify(
            F.when(F.col("_sign").isin("", "="), F.col("_number")), F.col("_sign"), _q(f"{c}_flag"), change, share, number("CRITICAL_LOW"), number("CRITICAL_HIGH"), number("DELTA_ABS"), number("DELTA_PERCENT"),
            roles.get("instrument"), as_list(ci(options, "HOLD_INSTRUMENTS")),
        )
        x = x.withColumns({f"{c}_decision": decision, f"{c}_reasons": why})
        out = out.with_df(x.drop("_sign", "_number", "_p", "_t", "_at", "_x", "_was", "_twice"), **{f"{c}_decision": ("CATEGORY",), f"{c}_reasons": ("STR",)})
    tables = {f"{c}:decisions": out.df.groupBy(_q(f"{c}_decision").alias("decision"), _q(f"{c}_reasons").alias("reasons")).agg(F.count("*").alias("n")) for c in result_columns(ds, options)}
    return Output("AUTOVERIFICATION", out, tables)


@step("RESULT_TREND")
def _trend(ds: Dataset, options: dict) -> Output:
    """PERIOD D, W, M, Q or Y, and WINDOW periods of the moving mean."""
    roles = roles_of(ds, options)
    at = roles.get("reported", roles.get("collected"))
    unit = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}[str(ci(options, "PERIOD", default="D")).upper()[:1]]
    parts = {c: laboratory.trend(ds.df, roles.get("test", F.lit("ALL")), at, numbers(ds, c, options), unit, int(ci(options, "WINDOW", default=7))) for c in result_columns(ds, options)}
    return Output("RESULT_TREND", ds, {f"{c}:trend": t for c, t in parts.items()})


# Control material -----------------------------------------------------------------


def qc_points(ds: Dataset, options: dict) -> tuple[DataFrame, list[str]]:
    """(points, keys): control measurements under plain names (test, material, run, order, value and instrument where there is one), and the keys of a chart.

    A row without test, material or run can't be charted: it is refused.
    """
    names = {
        "test": _column(ds, options, "TEST", "ITEM", "TESTNAME"), "material": _column(ds, options, "MATERIAL", "QC_LEVEL", "LOT"), "run": _column(ds, options, "RUN", "RUN_ID"), "order": _column(ds, options, "ORDER", "RESULT_TIME", "REPORT_DATE"),
        "instrument": _column(ds, options, "INSTRUMENT", "INSTRUMENT", need=False),
    }
    c = result_columns(ds, options)[0]
    cells = {k: _q(n) for k, n in names.items() if n}
    cells["order"] = instant(ds, names["order"]) if dict(ds.df.dtypes)[names["order"]] == "string" else cells["order"]
    lacking = V.any_of([V.text(cells[k]) == "" for k in ("test", "material", "run")])
    guard = F.when(lacking, F.raise_error(F.lit("a control measurement without test, material or run")).cast("string")).otherwise(cells["test"].cast("string"))
    x = ds.df.select(guard.alias("test"), *[v.alias(k) for k, v in cells.items() if k != "test"], numbers(ds, c, options).alias("value"))
    return x, ["test", *(["instrument"] if "instrument" in cells else [])]


def _z(points: DataFrame, keys: list[str], options: dict) -> DataFrame:
    """z against BASELINES (material -> MEAN, SD), else against each chart's own mean and SD; with the series' key."""
    by = [*keys, "material"]
    series = F.sha2(F.to_json(F.struct(*by)), 256).alias("series")
    fixed = ci(options, "BASELINES")
    if fixed:
        rows = [(str(k), float(ci(v, "MEAN")), float(ci(v, "SD"))) for k, v in fixed.items()]
        base = points.sparkSession.createDataFrame(rows, "_material string, mean double, sd double")
        j = points.join(F.broadcast(base), F.col("material").cast("string") == F.col("_material"), "left").drop("_material")  # declared in the options
    else:
        j = points.join(points.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), by)
    return j.select("*", F.round(F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")), 6).alias("z"), series)


@step("QC_ANALYSIS")
def _qc(ds: Dataset, options: dict) -> Output:
    """MODE PRECISION, SIGMA (with TEA and BIAS in percent), LEVEY_JENNINGS or WESTGARD; all of them by default."""
    points, keys = qc_points(ds, options)
    by = [*keys, "material"]
    modes = [str(m).upper() for m in as_list(ci(options, "MODE"))] or ["PRECISION", "LEVEY_JENNINGS", "WESTGARD"]
    tables = {}
    for mode in modes:
        if mode in ("PRECISION", "SIGMA"):
            tea = ci(options, "TEA") if mode == "SIGMA" else None
            tables[mode] = laboratory.qc_precision(points, by, F.col("value"), None if tea is None else float(tea), float(ci(options, "BIAS", default=0)))
        elif mode == "LEVEY_JENNINGS":
            tables[mode] = laboratory.levey_jennings(points, by, ["order"], F.col("value"), ["run"])
        elif mode == "WESTGARD":
            tables[mode] = laboratory.westgard_basic(_z(points, keys, options), keys, "run", "order")
        else:
            raise ValueError(f"unknown mode {mode!r}")
    return Output("QC_ANALYSIS", ds, tables)


@step("WESTGARD_QC")
def _westgard(ds: Dataset, options: dict) -> Output:
    """Multirule decisions: RULES, WARNING_RULES, SCOPE, TRIGGER, AFTER_REJECT, RULE_SETTINGS and BY_RESULT (keyed by test)."""
    points, keys = qc_points(ds, options)
    settings = {k: v for k, v in (options or {}).items() if str(k).upper() in ("RULES", "WARNING_RULES", "SCOPE", "TRIGGER", "AFTER_REJECT", "RULE_SETTINGS", "BY_RESULT")}
    group = F.col("test") if len(keys) == 1 else F.concat_ws("\x1f", *keys)
    judged = multirule.multirule(_z(points, keys, options).withColumn("_group", group).withColumn("_test", F.col("test")), "_group", settings=settings, result="_test").drop("_group", "_test")
    severity = F.array_position(F.array(*[F.lit(s) for s in multirule.SEVERITY]), F.col("decision"))
    rules = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("violation").isin("NONE", "NE"), F.split("violation", ", ")))))), ", ")
    runs = judged.groupBy(*keys, "run").agg(F.min("order").alias("order"), F.count("*").alias("points"), F.round(F.max(F.abs("z")), 6).alias("max_abs_z"), rules.alias("rules"), F.max_by("decision", severity).alias("decision"))
    return Output("WESTGARD_QC", ds, {"points": judged, "runs": runs, "rejected": runs.where("decision = 'REJECT'")})


@step("QC_WORKFLOW")
def _workflow(ds: Dataset, options: dict) -> Output:
    """What is invalid, precision, multirule decisions, their trend by day, and runs to review."""
    points, keys = qc_points(ds, options)
    judged = _westgard(ds, options).tables
    daily = judged["points"].groupBy(*keys, F.to_date("order").alias("date")).agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_z"))
    invalid = points.where("value is null").groupBy(*keys, "material").agg(F.count("*").alias("n"))
    return Output("QC_WORKFLOW", ds, {"issues": checks.issues(ds), "invalid": invalid, "precision": laboratory.qc_precision(points, [*keys, "material"], F.col("value")), **judged, "daily": daily, "review": judged["runs"].where("decision <> 'IN_CONTROL'")})


# Comparison and tests ---------------------------------------------------------------


@step("METHOD_COMPARISON")
def _methods(ds: Dataset, options: dict) -> Output:
    """METHOD (selector), A and B (its values), KEYS that pair results, BY, POINTS of predicted bias, RATIO of error variances."""
    method, keys = _column(ds, options, "METHOD", "METHOD", "INSTRUMENT"), ds.resolve_all(*as_list(ci(options, "KEYS")))
    by = ds.resolve_all(*as_list(ci(options, "BY"))) if ci(options, "BY") else []
    tables = {}
    for c in result_columns(ds, options):
        df = ds.df if by else ds.df.withColumn("_all", F.lit("ALL"))
        got = statistics.method_comparison(df, keys, by or ["_all"], method, numbers(ds, c, options), str(ci(options, "A")), str(ci(options, "B")), [float(p) for p in as_list(ci(options, "POINTS"))], float(ci(options, "RATIO", default=1)))
        tables |= {f"{c}:{k}": t.drop("_all") for k, t in got.items()}
    return Output("METHOD_COMPARISON", ds, tables)


@step("GROUP_TEST")
def _groups(ds: Dataset, options: dict) -> Output:
    by = _column(ds, options, "GROUP", "GROUP", "COHORT", "BY")
    rows = [(c, k, float(v)) for c in result_columns(ds, options) for k, v in statistics.group_test(ds.df, _q(by), numbers(ds, c, options)).items()]
    return Output("GROUP_TEST", ds, {"tests": ds.df.sparkSession.createDataFrame(rows, "result_column string, statistic string, value double")})


@step("CORRELATION")
def _correlation(ds: Dataset, options: dict) -> Output:
    columns = result_columns(ds, options)
    df = ds.df.select(*[numbers(ds, c, options).alias(c) for c in columns])
    return Output("CORRELATION", ds, {"correlation": statistics.correlation(df, columns, str(ci(options, "METHOD", default="pearson")).lower())})


@step("ROC_ANALYSIS")
def _roc(ds: Dataset, options: dict) -> Output:
    """LABEL (selector) is positive where its text is POSITIVE (1 by default); the best cut-off has the largest Youden index."""
    label, tables = _column(ds, options, "LABEL", "LABEL", "OUTCOME"), {}
    positive = V.text(_q(label)) == str(ci(options, "POSITIVE", default="1"))
    for c in result_columns(ds, options):
        x = numbers(ds, c, options)
        curve = statistics.roc_curve(ds.df, x, positive)
        tables |= {f"{c}:curve": curve, f"{c}:auc": statistics.roc_auc(ds.df, x, positive), f"{c}:best": curve.orderBy(F.desc("youden"), "threshold").limit(1)}
    return Output("ROC_ANALYSIS", ds, tables)


@step("SURVEY_DESCRIBE")
def _survey(ds: Dataset, options: dict) -> Output:
    """Design-based means of each result: WEIGHT, STRATUM, PSU (selectors), and BY for domains, with t intervals."""
    w, h, i = (ds.col(str(ci(options, k))) for k in ("WEIGHT", "STRATUM", "PSU"))
    by = ds.resolve(str(ci(options, "BY"))) if ci(options, "BY") else None
    levels = [r[0] for r in ds.df.select(V.text(_q(by))).distinct().orderBy(F.lit(1)).limit(101).collect()] if by else [None]
    if len(levels) > 100:
        raise ValueError(f"{by} has more than 100 domains")
    parts = []
    for c in result_columns(ds, options):
        for level in levels:
            inside = None if level is None else V.text(_q(by)) == level
            got = statistics.survey_mean(ds.df, numbers(ds, c, options), w, h, i, inside)
            half = statistics.t_quantile_column(0.975, F.col("df")) * F.col("se")
            parts.append(got.select(F.lit(c).alias("result_column"), F.lit(level or "ALL").alias("domain"), "n", "mean", "se", "df", F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high")))
    return Output("SURVEY_DESCRIBE", ds, {"means": _stacked(parts)})
