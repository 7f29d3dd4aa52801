"""Laboratory analytics: turnaround, workload, deltas, flags, trends, control charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .summaries import number_stats, quantile, quantiles

#: Stage, start, end.
STAGES = [
    ("order_to_collection", "ORDER_PLACED_AT", "SPECIMEN_COLLECTED_AT"),
    ("collection_to_lab", "SPECIMEN_COLLECTED_AT", "LAB_RECEIVED_AT"),
    ("lab_to_section", "LAB_RECEIVED_AT", "LAB_SECTION_RECEIVED_AT"),
    ("section_to_test_start", "LAB_SECTION_RECEIVED_AT", "TEST_STARTED_AT"),
    ("test_start_to_result", "TEST_STARTED_AT", "RESULT_CREATED_AT"),
    ("result_to_preliminary", "RESULT_CREATED_AT", "PRELIMINARY_REPORTED_AT"),
    ("preliminary_to_final", "PRELIMINARY_REPORTED_AT", "FINAL_REPORTED_AT"),
    ("order_to_final", "ORDER_PLACED_AT", "FINAL_REPORTED_AT"),
    ("collection_to_final", "SPECIMEN_COLLECTED_AT", "FINAL_REPORTED_AT"),
]
#: Other tags of a time point.
POINT_ALIASES = {"ORDER_PLACED_AT": "ORDER_AT", "SPECIMEN_COLLECTED_AT": "COLLECTION_AT", "LAB_RECEIVED_AT": "RECEIVED_AT", "RESULT_CREATED_AT": "RESULT_TIME", "FINAL_REPORTED_AT": "REPORT_DATE"}


def minutes(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 6e7


def item_counts(df: DataFrame, item: Column, top: int | None = None) -> DataFrame:
    out = df.groupBy(item.alias("item")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "item").limit(top) if top else out


def result_summary(df: DataFrame, item: Column, value: Column, accuracy: int | None = None) -> DataFrame:
    return df.select(item.alias("item"), value.cast("double").alias("x")).groupBy("item").agg(*number_stats(F.col("x"), sd_of_one=0.0, accuracy=accuracy))


def instrument_bias(df: DataFrame, item: Column, instrument: Column, value: Column, accuracy: int | None = None) -> DataFrame:
    """Median of each instrument against the item's median over all instruments."""
    x = df.select(item.alias("item"), instrument.alias("instrument"), value.cast("double").alias("x"))
    by = x.groupBy("item", "instrument").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), quantile(F.col("x"), 0.5, accuracy).alias("median"))
    whole = x.groupBy("item").agg(quantile(F.col("x"), 0.5, accuracy).alias("m"))
    diff = F.col("median") - F.col("m")
    return by.join(whole, "item").select("item", "instrument", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("m", 6).alias("item_median"), F.round(diff, 6).alias("bias"), F.round(F.when(F.col("m") != 0, 100 * diff / F.col("m")), 6).alias("bias_pct"))


def _upper(x: Column, accuracy: int | None) -> list[Column]:
    """Median, P90 and P95 from one aggregate."""
    q = quantiles(x, [0.5, 0.9, 0.95], accuracy)
    return [F.round(q[i], 6).alias(a) for i, a in enumerate(("median", "p90", "p95"))]


def turnaround(df: DataFrame, by: dict[str, Column], start: Column, end: Column, accuracy: int | None = None) -> DataFrame:
    x = df.select(*[c.alias(k) for k, c in by.items()], minutes(start, end).alias("x")).where("x >= 0")
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), *_upper(F.col("x"), accuracy), F.round(F.min("x"), 6).alias("min"), F.round(F.max("x"), 6).alias("max"))


def workload(df: DataFrame, at: Column, item: Column, unit: str = "day") -> DataFrame:
    slot = F.to_date(at).alias("date") if unit == "day" else F.hour(at).cast("bigint").alias("hour")
    return df.groupBy(slot, item.alias("item")).agg(F.count("*").alias("n"))


def age_sex_summary(df: DataFrame, item: Column, sex: Column, age: Column, value: Column, accuracy: int | None = None) -> DataFrame:
    x = df.select(item.alias("item"), sex.alias("sex"), V.age_band(age).alias("age_band"), value.cast("double").alias("x"))
    return x.groupBy("item", "sex", "age_band").agg(*number_stats(F.col("x"), (50,), sd_of_one=0.0, accuracy=accuracy))


def tukey_outliers(df: DataFrame, item: Column, value: Column, k: float = 1.5, accuracy: int | None = None) -> DataFrame:
    x = df.select(item.alias("item"), value.cast("double").alias("x")).where("x is not null")
    q = x.groupBy("item").agg(quantiles(F.col("x"), [0.25, 0.75], accuracy).alias("q"))
    q = q.select("item", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumn("low", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    n = lambda c: F.sum(c.cast("bigint"))
    return x.join(q, "item").groupBy("item", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")).agg(F.count("*").alias("n"), n(F.col("x") < F.col("low")).alias("below"), n(F.col("x") > F.col("high")).alias("above"))


def delta(df: DataFrame, patient: Column, item: Column, at: Column, value: Column, keep: list[str] = (), digits: int | None = 6) -> DataFrame:
    """Change from the previous result of the same patient and item.  A zero before gives no percentage.

    Limits are held against unrounded changes (``digits=None``): 40.0000000001 is beyond 40.
    """
    r = lambda c: c if digits is None else F.round(c, digits)
    x = df.select(*keep, patient.alias("patient"), item.alias("item"), at.alias("at"), value.cast("double").alias("x")).where("x is not null and at is not null")
    w = Window.partitionBy("patient", "item").orderBy("at", *keep)
    x = x.withColumns({"previous": F.lag("x").over(w), "previous_at": F.lag("at").over(w)})
    d = F.col("x") - F.col("previous")
    return x.where("previous is not null").select(*keep, "patient", "item", "at", F.col("x").alias("value"), "previous", r(d).alias("change"), r(F.abs(d)).alias("abs_change"), r(F.when(F.col("previous") != 0, 100 * F.abs(d) / F.abs("previous"))).alias("pct_change"), r(minutes(F.col("previous_at"), F.col("at")) / 60).alias("hours"))


def top_delta(deltas: DataFrame, k: int = 500, *ties: str) -> DataFrame:
    return deltas.orderBy(F.desc_nulls_last("abs_change"), *ties).limit(k)


def reference_flag(value: Column, low: Column, high: Column, sign: Column | None = None) -> Column:
    """N, H, L, NE (no number or no bound) or IND (a bounded result that may lie on either side)."""
    flag = F.when(value.isNull() | (low.isNull() & high.isNull()), "NE")
    if sign is not None:
        below, above = sign.isin("<", "<="), sign.isin(">", ">=")
        sure_low = below & ((value < low) | ((value == low) & (sign == "<")))
        sure_high = above & ((value > high) | ((value == high) & (sign == ">")))
        flag = flag.when(sure_low, "L").when(sure_high, "H")
        flag = flag.when(below & low.isNull() & (value <= high), "N").when(above & high.isNull() & (value >= low), "N").when(below | above, "IND")
    return flag.when(value < low, "L").when(value > high, "H").otherwise("N")


def flag_results(df: DataFrame, value: Column, low: Column, high: Column, name: str = "flag", keep_parsed: bool = False) -> DataFrame:
    """``df`` with the flag of a result that may carry a comparator; the result is parsed once."""
    out = V.with_parsed(df, value).withColumn(name, reference_flag(F.col("_number"), low, high, F.col("_sign")))
    return out if keep_parsed else out.drop("_sign", "_number")


def abnormal_rate(df: DataFrame, by: dict[str, Column], flag: Column) -> DataFrame:
    # Counted by flag first: six conditions would each work the flag out again.
    some = df.groupBy(*[c.alias(k) for k, c in by.items()], flag.alias("_flag")).agg(F.count("*").alias("_n"))
    n = lambda *f: F.coalesce(F.sum(F.when(F.col("_flag").isin(*f), F.col("_n"))), F.lit(0))
    out = some.groupBy(*by).agg(F.sum("_n").alias("total"), n("N", "H", "L").alias("evaluated"), *[n(f).alias(f.lower()) for f in ("NE", "IND", "H", "L")])
    share = lambda c: F.round(F.when(F.col("evaluated") > 0, 100 * c / F.col("evaluated")), 6)
    return out.select("*", share(F.col("h")).alias("h_pct"), share(F.col("l")).alias("l_pct"), share(F.col("h") + F.col("l")).alias("abnormal_pct"))


def autoverify(value: Column, sign: Column, flag: Column, change: Column, change_pct: Column, critical_low: float | None = None, critical_high: float | None = None, delta_abs: float | None = None, delta_pct: float | None = 50.0, instrument: Column | None = None, hold: list[str] = ()) -> tuple[Column, Column]:
    """(decision, reasons): HOLD for critical values and held instruments, REVIEW for any other reason, else PASS."""
    no = F.lit(False)
    crit = [(value < critical_low if critical_low is not None else no, "CRITICAL_LOW"), (value > critical_high if critical_high is not None else no, "CRITICAL_HIGH"), (F.lower(V.strip(instrument)).isin([h.lower() for h in hold]) if instrument is not None and hold else no, "INSTRUMENT_HOLD")]
    soft = [(sign.isin("<", "<=", ">", ">="), "CENSORED_RESULT"), (flag.isin("NE", "IND"), "REFERENCE_UNEVALUABLE"), (value.isNull(), "RESULT_PARSE"), (flag == "L", "REF_LOW"), (flag == "H", "REF_HIGH"), (change > delta_abs if delta_abs is not None else no, "DELTA_ABS"), (change_pct > delta_pct if delta_pct is not None else no, "DELTA_PERCENT")]
    listed = F.array_compact(F.array(*[F.when(c, r) for c, r in [*soft[:3], *crit[:2], *soft[3:], crit[2]]]))
    held = F.coalesce(V.any_of([F.coalesce(c, no) for c, _ in crit]), no)
    return F.when(held, "HOLD").when(F.size(listed) > 0, "REVIEW").otherwise("PASS"), F.array_join(listed, ";")


def stage_rows(df: DataFrame, points: dict[str, Column], keep: list[str], targets: dict[str, float] | None = None) -> DataFrame:
    """One row per input row and stage: minutes, status, breach.  All stages come from one pass."""
    out = []
    for name, a, b in STAGES:
        if a in points and b in points:
            m = minutes(points[a], points[b])
            status = F.when(points[a].isNull(), "missing_start").when(points[b].isNull(), "missing_end").when(m < 0, "negative").otherwise("ok")
            limit = (targets or {}).get(name)
            out.append(F.struct(F.lit(name).alias("stage"), F.round(m, 6).alias("minutes"), status.alias("status"), (F.coalesce((status == "ok") & (m > limit), F.lit(False)) if limit is not None else F.lit(False)).alias("breach")))
    listed = F.array(*out) if out else F.array().cast("array<struct<stage:string,minutes:double,status:string,breach:boolean>>")
    return df.select(*keep, F.explode(listed).alias("s")).select(*keep, "s.*")


def stage_summary(rows: DataFrame, by: list[str], accuracy: int | None = None) -> DataFrame:
    ok = F.when(F.col("status") == "ok", F.col("minutes"))
    n = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy(*by, "stage").agg(F.count("*").alias("rows"), F.count(ok).alias("valid"), n(F.col("status").startswith("missing")).alias("missing"), n(F.col("status") == "negative").alias("negative"), n(F.col("breach")).alias("breaches"), F.round(F.avg(ok), 6).alias("mean"), *_upper(ok, accuracy), F.min(ok).alias("min"), F.max(ok).alias("max"))


def bottlenecks(summary: DataFrame, k: int = 10) -> DataFrame:
    return summary.orderBy(F.desc_nulls_last("p95"), F.desc_nulls_last("median"), "stage").limit(k)


def trend(df: DataFrame, item: Column, at: Column, value: Column, unit: str = "day", window: int = 7, accuracy: int | None = None) -> DataFrame:
    """Per period with results: n, mean, median, and the mean of the last ``window`` periods' means."""
    x = df.select(item.alias("item"), F.date_trunc(unit, at).alias("period"), value.cast("double").alias("x")).where("x is not null")
    p = x.groupBy("item", "period").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), quantile(F.col("x"), 0.5, accuracy).alias("median"))
    w = Window.partitionBy("item").orderBy("period").rowsBetween(-(window - 1), 0)
    return p.select("item", "period", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round(F.avg("mean").over(w), 6).alias("moving_mean"))


def qc_precision(df: DataFrame, by: list[str], value: Column, tea: float | None = None, bias: float = 0.0) -> DataFrame:
    """mean, SD, CV% and, with an allowed total error in percent, sigma = (TEa - |bias|) / CV."""
    x = df.select(*by, value.cast("double").alias("x")).where("x is not null")
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    cv = F.when(F.col("m") != 0, 100 * F.col("s") / F.col("m"))
    out = g.select(*by, "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round(cv, 6).alias("cv_pct"), *([F.round(F.when(cv > 0, (tea - abs(bias)) / cv), 6).alias("sigma")] if tea is not None else []))
    return out


def levey_jennings(df: DataFrame, by: list[str], order: list[str], value: Column, keep: list[str] = ()) -> DataFrame:
    """Point number and z against the group's own mean and SD.

    Mean and SD are aggregated and joined back; only the numbering sorts a group.
    """
    x = df.select(*dict.fromkeys([*by, *order, *keep]), value.cast("double").alias("x")).where("x is not null")
    s = x.groupBy(*by).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("x") - F.col("mean")) / F.col("sd"))
    return x.join(s, by).select(*dict.fromkeys([*by, *order, *keep]), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint").alias("point"), F.col("x").alias("value"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(z, 6).alias("z"))


def westgard_basic(points: DataFrame, by: list[str], run: str, order: str) -> DataFrame:
    """``points(by, run, order, material, z)``: 1_3s, R_4s and 2_2s within a run, 2_2s across runs of a material."""
    in_run = Window.partitionBy(*by, run)
    across = Window.partitionBy(*by, "material").orderBy(order)
    before = F.lag("z").over(across)
    one = F.abs("z") > 3
    high, low = F.max("z").over(in_run), F.min("z").over(in_run)
    r4 = (high > 2) & (low < -2) & (F.abs("z") > 2)
    pair = F.sum((F.col("z") > 2).cast("int")).over(in_run), F.sum((F.col("z") < -2).cast("int")).over(in_run)
    two_in = ((F.col("z") > 2) & (pair[0] >= 2)) | ((F.col("z") < -2) & (pair[1] >= 2))
    two_across = ((F.col("z") > 2) & (before > 2)) | ((F.col("z") < -2) & (before < -2))
    no = F.lit(False)
    found = F.array_compact(F.array(F.when(F.coalesce(one, no), "1_3s"), F.when(F.coalesce(r4, no), "R_4s"), F.when(F.coalesce(two_in | F.coalesce(two_across, no), no), "2_2s")))
    return points.withColumn("violation", F.when(F.col("z").isNull(), "NOT_EVALUATED").when(F.size(found) == 0, "NONE").otherwise(F.array_join(found, ", ")))


def run_review(judged: DataFrame, by: list[str], run: str) -> DataFrame:
    v = F.col("violation")
    hit = ~v.isin("NONE", "NOT_EVALUATED")
    rules = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.split(v, ", ")))))), ", ")
    out = judged.groupBy(*by, run).agg(F.count("*").alias("observations"), F.sum(hit.cast("bigint")).alias("flagged"), F.sum((v == "NOT_EVALUATED").cast("bigint")).alias("not_evaluated"), rules.alias("rules"), F.round(F.max(F.abs("z")), 6).alias("max_abs_z"))
    return out.withColumn("review", F.col("flagged") > 0)


def match_baselines(points: DataFrame, baselines: DataFrame, keys: list[str], at: str, start: str = "valid_from", end: str = "valid_to", bucket_days: int = 30) -> DataFrame:
    """Range join: the baseline of equal keys with start <= at < end, and how many there are.

    Baselines are listed under each bucket of days they touch, so that the join is an equi-join on keys and bucket.
    """
    day = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / (86400 * bucket_days)).cast("bigint")
    b = baselines.withColumn("_bucket", F.explode(F.sequence(day(F.col(start)), day(F.col(end)))))
    p = points.withColumn("_bucket", day(F.col(at)))
    extra = [c for c in baselines.columns if c not in keys]
    hits = p.join(b, [*keys, "_bucket"], "left").withColumn("_in", F.coalesce((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)), F.lit(False)))
    g = hits.groupBy(*points.columns).agg(F.sum(F.col("_in").cast("bigint")).alias("matches"), *[F.min(F.when(F.col("_in"), F.col(c))).alias(c) for c in extra])
    return g
