"""Catalogue, continued: contracts, profiles, control rules, samples, snapshots and interval studies, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _ORACLES, _CMP, _FLAG, _LABELLED, _QC, _STAGES, _ev, _flags, _holes, _labelled, _qc_points, _stage_rows, bounded, events, query, table
from .dataset import Dataset
from .functions.conditions import eligibility
from .operators import actions, checks, comparators, intervals, laboratory, multi, multirule, statistics, study

# Contracts --------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) FILTER (l_quantity >= 10 AND l_discount < 0.05 AND l_linenumber IN (1, 2, 3)) AS holds, count(*) FILTER (l_quantity IS NULL) AS missing FROM lineitem GROUP BY 1")
def planned_predicate(spark, sf_dir):
    tests = [{"COLUMN_ID": "q", "MIN": 10}, {"COLUMN_ID": "d", "MAX_EXCLUSIVE": 0.05}, {"COLUMN_ID": "n", "IN_NUMBERS": [1, 2, 3]}]
    holds, missing = eligibility(tests, {"q": F.col("l_quantity"), "d": F.col("l_discount"), "n": F.col("l_linenumber")})
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.when(holds, 1)).alias("holds"), F.count(F.when(missing, 1)).alias("missing"))


@query("SELECT status, reason, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 1000 THEN 'ELIGIBLE' WHEN o_totalprice IS NULL THEN 'MISSING' ELSE 'NOT_ELIGIBLE' END AS status, o_orderstatus AS reason FROM orders) GROUP BY ALL")
def eligibility_by_text(spark, sf_dir):
    tests = [{"COLUMN_ID": "p", "IN_TEXT": ["1-URGENT", "2-HIGH"]}, {"COLUMN_ID": "t", "MIN_EXCLUSIVE": 1000}]
    holds, missing = eligibility(tests, {"p": F.col("o_orderpriority"), "t": F.col("o_totalprice")})
    status = F.when(holds, "ELIGIBLE").when(missing, "MISSING").otherwise("NOT_ELIGIBLE")
    return table(spark, sf_dir, "orders").groupBy(status.alias("status"), F.col("o_orderstatus").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT 'event_type' AS \"column\", 'CATEGORY' AS tag, event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def category_vocabulary(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "events").select("event_type"), {"event_type": ("CATEGORY",)}, {"COLUMN": {"event_type": {"VALUES": ["Click", " VIEW "]}}})
    return checks.issues(ds).groupBy("column", "tag", "value").agg(F.count("*").alias("n"))


@query("SELECT 'size' AS \"column\", 'ORDINAL' AS tag, CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part WHERE p_size > 30 GROUP BY p_size")
def ordinal_levels(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("size")), {"size": ("ORDINAL",)}, {"COLUMN": {"size": {"LEVELS": [str(i) for i in range(1, 31)]}}})
    return checks.issues(ds).groupBy("column", "tag", "value").agg(F.count("*").alias("n"))


@query("SELECT tag, value, count(*) AS n FROM (SELECT 'DATE' AS tag, CASE o_orderkey % 5 WHEN 0 THEN '1996-13-40' WHEN 1 THEN 'soon' END AS value FROM orders) WHERE value IS NOT NULL GROUP BY ALL")
def temporal_issues(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    day = F.when(k == 0, "1996-13-40").when(k == 1, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    ds = Dataset(table(spark, sf_dir, "orders").select(day.alias("day")), {"day": ("DATE",)})
    return checks.issues(ds).groupBy("tag", "value").agg(F.count("*").alias("n"))


@query("SELECT event_type AS raw, 'go' AS canonical, true AS recognised, true AS will_change, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS canonical_n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def category_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    return checks.value_profile(e, "event_type", F.when(F.col("event_type").isin("click", "view"), "go"))


@query("SELECT \"column\", count(*) FILTER (v IS NULL) AS absent, 0 AS \"null\", 0 AS empty, 0 AS ws, count(v) AS value FROM (SELECT unnest(['event_id', 'value', 'site']) AS \"column\", unnest([CAST(event_id AS VARCHAR), CASE WHEN event_id % 11 <> 0 THEN CAST(value AS VARCHAR) END, CASE WHEN event_id % 5 <> 0 THEN 's' END]) AS v FROM events) GROUP BY 1")
def missing_quality(spark, sf_dir):
    from .plans.runner import run_step

    ds = _holes(spark, sf_dir)
    ds = ds.with_df(ds.df.select("event_id", "value", "site"))
    out = run_step(ds, "CHEMISTRY_ANALYSIS", {"MODE": "MISSING_QUALITY"}).tables["MISSING_QUALITY"]
    return out.select("column", "absent", *[F.col(c).cast("int").alias(c) for c in ("null", "empty", "ws")], "value")


@query("SELECT \"column\", \"value\", \"count\" FROM (SELECT 'event_type' AS \"column\", event_type AS \"value\", count(*) AS \"count\" FROM events GROUP BY event_type UNION ALL SELECT 'site', 's' || CAST(user_id % 3 AS VARCHAR), count(*) FROM events WHERE event_id % 5 <> 0 GROUP BY 2)")
def eda_categories(spark, sf_dir):
    from .plans.runner import run_step

    ds = _holes(spark, sf_dir)
    ds = Dataset(ds.df.select("event_type", "site"), {"event_type": ("CATEGORY",), "site": ("CATEGORY",)})
    tables = run_step(ds, "EDA", {}).tables
    parts = [tables[f"category:{c}"].select(F.lit(c).alias("column"), "value", "count") for c in ("event_type", "site")]
    return parts[0].unionByName(parts[1])


# Pairs, turnaround, flags -----------------------------------------------------------


_PAIRED = "(SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS x, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS y FROM orders GROUP BY 1)"


@query(f"SELECT o_custkey, round(x, 6) AS x, round(y, 6) AS y FROM {_PAIRED} WHERE x IS NOT NULL AND y IS NOT NULL")
def method_pairs(spark, sf_dir):
    return statistics.pair_methods(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", F.col("o_totalprice"), "F", "O").select("o_custkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"SELECT part, count(*) AS n, round(avg(y - x), 6) AS bias, round(100 * avg(y - x) / avg(x), 6) AS bias_pct FROM (SELECT o_custkey % 4 AS part, x, y FROM {_PAIRED} WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY part")
def method_bias(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("part", F.col("o_custkey") % 4)
    return statistics.method_comparison(df, ["o_custkey"], ["part"], "o_orderstatus", F.col("o_totalprice"), "F", "O")["bias"].select("part", "n", "bias", "bias_pct")


@query(f"SELECT event_type, stage, round(quantile_cont(v, 0.95), 6) AS p95, round(median(v), 6) AS median FROM (SELECT *, CASE WHEN minutes >= 0 THEN minutes END AS v FROM {_STAGES}) GROUP BY ALL ORDER BY p95 DESC NULLS LAST, median DESC NULLS LAST, stage, event_type LIMIT 10")
def tat_bottlenecks(spark, sf_dir):
    return laboratory.bottlenecks(laboratory.stage_summary(_stage_rows(spark, sf_dir), ["event_type"])).select("event_type", "stage", "p95", "median")


@query("SELECT decision, reasons, count(*) AS n FROM (SELECT CASE WHEN value > 400 THEN 'HOLD' WHEN value < 2 OR value > 60 OR a > 40 OR p > 500 THEN 'REVIEW' ELSE 'PASS' END AS decision, concat_ws(';', CASE WHEN value > 400 THEN 'CRITICAL_HIGH' END, CASE WHEN value < 2 THEN 'REF_LOW' END, CASE WHEN value > 60 THEN 'REF_HIGH' END, CASE WHEN a > 40 THEN 'DELTA_ABS' END, CASE WHEN p > 500 THEN 'DELTA_PERCENT' END) AS reasons FROM (SELECT value, abs(value - lag(value) OVER w) AS a, CASE WHEN lag(value) OVER w <> 0 THEN 100 * abs(value - lag(value) OVER w) / abs(lag(value) OVER w) END AS p FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))) GROUP BY ALL")
def autoverification_delta(spark, sf_dir):
    e = _ev(spark, sf_dir)
    d = laboratory.delta(e, F.col("user_id"), F.col("event_type"), F.col("ts"), F.col("value"), ["event_id"], digits=None).select("event_id", "abs_change", "pct_change")
    x = laboratory.flag_results(e.withColumn("low", F.lit(2.0)).withColumn("high", F.lit(60.0)), F.col("value"), F.col("low"), F.col("high"), keep_parsed=True).join(d, "event_id", "left")
    decision, why = laboratory.autoverify(F.col("_number"), F.col("_sign"), F.col("flag"), F.col("abs_change"), F.col("pct_change"), None, 400.0, 40.0, 500.0)
    return x.groupBy(decision.alias("decision"), why.alias("reasons")).agg(F.count("*").alias("n"))


@query(f"SELECT l_returnflag, {_FLAG} AS flag, count(*) AS n FROM {_CMP} GROUP BY ALL")
def flag_counts(spark, sf_dir):
    return _flags(spark, sf_dir).groupBy("l_returnflag", "flag").agg(F.count("*").alias("n"))


# Control rules ----------------------------------------------------------------------


_SIDES = ", ".join(f"min(z) OVER (PARTITION BY grp, material ORDER BY run ROWS {n - 1} PRECEDING) AS lo{n}, max(z) OVER (PARTITION BY grp, material ORDER BY run ROWS {n - 1} PRECEDING) AS hi{n}, count(*) OVER (PARTITION BY grp, material ORDER BY run ROWS {n - 1} PRECEDING) AS n{n}" for n in (2, 4, 10))
_BEYOND = lambda n, k: f"n{n} = {n} AND (lo{n} > {k} OR hi{n} < -{k})"
_RULES = f"(SELECT *, concat_ws(', ', CASE WHEN abs(z) > 3 THEN '1_3s' END, CASE WHEN {_BEYOND(2, 2)} THEN '2_2s' END, CASE WHEN top > 2 AND low < -2 AND abs(z) > 2 THEN 'R_4s' END, CASE WHEN {_BEYOND(4, 1)} THEN '4_1s' END, CASE WHEN {_BEYOND(10, 0)} THEN '10x' END) AS v FROM (SELECT *, {_SIDES}, max(z) OVER (PARTITION BY grp, run) AS top, min(z) OVER (PARTITION BY grp, run) AS low FROM {_QC}))"


@query(f"SELECT event_id, violation, warning, decision, CASE max(CASE decision WHEN 'REJECT' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) OVER (PARTITION BY grp, run) WHEN 2 THEN 'REJECT' WHEN 1 THEN 'WARNING' ELSE 'IN_CONTROL' END AS run_decision FROM (SELECT *, CASE WHEN v = '' THEN 'NONE' ELSE v END AS violation, CASE WHEN abs(z) > 2 THEN '1_2s' ELSE 'NONE' END AS warning, CASE WHEN v <> '' THEN 'REJECT' WHEN abs(z) > 2 THEN 'WARNING' ELSE 'IN_CONTROL' END AS decision FROM {_RULES})")
def westgard_continue(spark, sf_dir):
    return multirule.multirule(_qc_points(spark, sf_dir), "grp", after_reject="CONTINUE", scope="WITHIN_MATERIAL").select("event_id", "violation", "warning", "decision", "run_decision")


@query(_ORACLES["westgard_continue"])
def westgard_segments(spark, sf_dir):
    """The same charts, each cut into segments that are judged side by side."""
    return multirule.multirule(_qc_points(spark, sf_dir), "grp", after_reject="CONTINUE", scope="WITHIN_MATERIAL", segment_points=300).select("event_id", "violation", "warning", "decision", "run_decision")


# Samples, digests, snapshots --------------------------------------------------------


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || CAST(event_id AS VARCHAR))) AS i FROM events) WHERE i <= 5")
def sample_hash_n(spark, sf_dir):
    return multi.sample(events(spark, sf_dir).df, F.col("event_id"), n=5, by=["event_type"], seed=7).select("event_type", "event_id")


@query("SELECT event_id FROM events WHERE ('0x' || substr(md5('3:' || CAST(event_id AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0 < 0.25")
def sample_fraction(spark, sf_dir):
    return multi.sample(events(spark, sf_dir).df, F.col("event_id"), fraction=0.25, seed=3).select("event_id")


@query("SELECT event_type, CAST(50 AS BIGINT) AS n FROM events GROUP BY 1")
def sample_with_replacement(spark, sf_dir):
    return multi.sample(events(spark, sf_dir).df, F.col("event_id"), n=50, by=["event_type"], seed=3, replace=True).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, CAST(sum(('0x' || substr(md5(md5('=' || CAST(c_custkey AS VARCHAR)) || md5(coalesce('=' || c_name, '-')) || md5('=' || CAST(c_nationkey AS VARCHAR))), 1, 15))::HUGEINT) AS VARCHAR) AS digest FROM customer")
def content_hash(spark, sf_dir):
    return multi.content_hash(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))


@query("SELECT position, 'modified' AS change, 'status' AS columns FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS position, o_orderkey AS k FROM (SELECT DISTINCT o_orderkey FROM orders)) WHERE k % 7 = 0")
def snapshot_positional(spark, sf_dir):
    old = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_orderstatus").alias("status"))
    new = old.withColumn("status", F.when(F.col("o_orderkey") % 7 == 0, "moved").otherwise(F.col("status")))
    return multi.positional_diff(old, new, "o_orderkey")


@query("SELECT k, v, CASE WHEN k % 10 = 1 THEN 4 ELSE 2 END AS sync_seq, CASE WHEN k % 10 = 1 THEN 'now' ELSE 'then' END AS synced_at, CASE WHEN k % 10 = 1 THEN 'NEW' WHEN k % 10 = 2 THEN 'CHANGED' ELSE 'SAME' END AS status FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer)")
def result_first_seen(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    k = F.col("k")
    old = new.select(F.when(k % 10 == 1, -k - 1).otherwise(k).alias("k"), F.when(k % 10 == 2, F.col("v") + 1).otherwise(F.col("v") * (1 + 1e-14)).alias("v"), F.lit(2).cast("bigint").alias("sync_seq"), F.lit("then").alias("synced_at"))
    return multi.annotate_results(old, new, ["k"], "v", 4, "now").withColumn("sync_seq", F.col("sync_seq").cast("int"))


@query("SELECT name, tag, value FROM (SELECT o_orderstatus AS name, unnest(['UNIT', 'REF_LOW']) AS tag, unnest(['u' || o_orderstatus, CAST(o_orderkey % 3 AS VARCHAR)]) AS value FROM orders) GROUP BY name, tag, value QUALIFY count(*) OVER (PARTITION BY name, tag) = 1")
def pivot_context(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.concat(F.lit("u"), "o_orderstatus").alias("unit"), (F.col("o_orderkey") % 3).cast("string").alias("low"))
    return actions.pivot_context(Dataset(df, {"unit": ("UNIT",), "low": ("REF_LOW",)}), "o_orderstatus")


@query("SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id) AS value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events)")
def act_impute_ffill_all(spark, sf_dir):
    ds = events(spark, sf_dir)
    ds = ds.with_df(ds.df.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value"))))
    return actions.run_action(ds, {"TYPE": "IMPUTE", "METHOD": "ffill", "COLUMNS": ["value"]}).df.select("event_id", "value")


@query("SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id DESC) AS value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM events)")
def act_impute_bfill_all(spark, sf_dir):
    ds = events(spark, sf_dir)
    ds = ds.with_df(ds.df.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value"))))
    return actions.run_action(ds, {"TYPE": "IMPUTE", "METHOD": "bfill", "COLUMNS": ["value"]}).df.select("event_id", "value")


@query("SELECT c_name AS value, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_known, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_rows, row_number() OVER (ORDER BY count(*) DESC, c_name) AS rank FROM (SELECT c_name FROM customer UNION ALL SELECT c_name FROM customer WHERE c_custkey % 3 = 0) GROUP BY c_name")
def category_distribution_many(spark, sf_dir):
    """Every customer's name is a category: places without one task that sees them all."""
    from .operators import summaries

    c = table(spark, sf_dir, "customer").select("c_name", "c_custkey")
    return summaries.category_distribution(c.union(c.where("c_custkey % 3 = 0")), "c_name")


@query(f"SELECT l_returnflag, min(num) FILTER (sign = '>') AS upper, max(num) FILTER (sign = '<') AS lower FROM {_CMP} GROUP BY 1")
def comparator_thresholds(spark, sf_dir):
    return comparators.thresholds(bounded(spark, sf_dir), "l_returnflag", "res").select(F.col("item").alias("l_returnflag"), "upper", "lower")


# Tests and fits ---------------------------------------------------------------------


_RANKS = f"(SELECT p, t, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS r FROM {_LABELLED})"
_TWO = f"(SELECT count(*) FILTER (p = 0) AS na, count(*) FILTER (p = 1) AS nb, avg(t) FILTER (p = 0) AS ma, avg(t) FILTER (p = 1) AS mb, var_samp(t) FILTER (p = 0) AS va, var_samp(t) FILTER (p = 1) AS vb, sum(r) FILTER (p = 0) - count(*) FILTER (p = 0) * (count(*) FILTER (p = 0) + 1) / 2.0 AS u FROM {_RANKS})"


@query(f"SELECT unnest(['welch_t', 'welch_df', 'u', 'cohen_d', 'rank_biserial']) AS statistic, round(unnest([(ma - mb) / sqrt(va / na + vb / nb), (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), u, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 2 * u / (na * nb) - 1]), 6) AS value FROM {_TWO}")
def group_test_statistics(spark, sf_dir):
    got = statistics.group_test(_labelled(spark, sf_dir), F.col("quality"), F.col("n_chars"))
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in got.items() if not k.endswith("_p")], "statistic string, value double")


_XY = "(SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem)"


@query(f"WITH s AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bt FROM {_XY}), k AS (SELECT *, (ay * bb - bt * ab) / (aa * bb - ab * ab) AS ka, (bt * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM s) SELECT unnest(['intercept', 'l_quantity', 'l_discount']) AS term, round(unnest([my - ka * ma - kb * mb, ka, kb]), 4) AS estimate, n FROM k")
def least_squares_estimates(spark, sf_dir):
    fit = statistics.least_squares(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame(fit[["term", "estimate", "n"]].round(4))


@query("WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), c AS (SELECT event_type, n, avg((value - m) ** 2) AS m2, avg((value - m) ** 3) AS m3, avg((value - m) ** 4) AS m4 FROM events JOIN m USING (event_type) GROUP BY 1, 2) SELECT event_type, n, round(m3 / m2 ** 1.5, 6) AS skewness, round(m3 / m2 ** 1.5 * sqrt(n * (n - 1.0)) / (n - 2), 6) AS skewness_corrected, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM c")
def ri_shape(spark, sf_dir):
    return study.shape(_ev(spark, sf_dir), ["event_type"], F.col("value"))


_FENCED = "(SELECT event_type, value, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS bad FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) USING (event_type))"


@query(f"WITH c AS (SELECT event_type, count(*) FILTER (NOT bad) AS n, count(*) FILTER (bad) AS removed FROM {_FENCED} GROUP BY 1), r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i FROM {_FENCED} WHERE NOT bad), q AS (SELECT *, least(greatest(p * (n + 1), 1), n) AS h FROM c, (SELECT unnest([0.025::DOUBLE, 0.975::DOUBLE]) AS p)), v AS (SELECT q.event_type, n, removed, a.value + (h - floor(h)) * (coalesce(b.value, a.value) - a.value) AS v FROM q JOIN r a ON a.event_type = q.event_type AND a.i = CAST(floor(h) AS BIGINT) LEFT JOIN r b ON b.event_type = q.event_type AND b.i = CAST(floor(h) AS BIGINT) + 1) SELECT event_type, n, removed, round(min(v), 6) AS low, round(max(v), 6) AS high FROM v GROUP BY ALL")
def ri_outliers_removed(spark, sf_dir):
    out = intervals.reference_intervals(_ev(spark, sf_dir), ["event_type"], F.col("value"), outliers="TUKEY")
    return out.select("event_type", "n", "removed", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_PANEL = "(SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY 1, 2)"


def _members(rounds: int) -> str:
    """Rounds of synchronous exclusion, written out one after the other."""
    parts = [f"p AS (SELECT *, count(*) OVER (PARTITION BY user_id) = (SELECT count(DISTINCT event_type) FROM events) AS complete FROM {_PANEL})", "m0 AS (SELECT *, complete AS member FROM p)"]
    for r in range(rounds + 1):
        parts.append(f"l{r} AS (SELECT event_type, avg(x) - 1.959963984540054 * stddev_samp(x) AS lo, avg(x) + 1.959963984540054 * stddev_samp(x) AS hi FROM m{r} WHERE member GROUP BY 1)")
        parts.append(f"f{r} AS (SELECT user_id, event_type, x, complete, CASE WHEN x < lo - 0.05 * (hi - lo) OR x > hi + 0.05 * (hi - lo) THEN 1 ELSE 0 END AS bad FROM p JOIN l{r} USING (event_type))")
        parts.append(f"m{r + 1} AS (SELECT *, complete AND others <= 0 AS member FROM (SELECT *, sum(bad) OVER (PARTITION BY user_id) - bad AS others FROM f{r}))")
    return "WITH " + ", ".join(parts) + f" SELECT user_id AS subject, event_type AS target, member AS included, CAST(others AS BIGINT) AS abnormal_others, complete, CASE WHEN NOT complete THEN 'PANEL_MISSING' WHEN member THEN 'RETAINED' ELSE 'EXCLUDED' END AS reason FROM m{rounds + 1} WHERE complete"


@query(_members(2))
def ri_latent_exclusion(spark, sf_dir):
    x = _ev(spark, sf_dir).groupBy("user_id", "event_type").agg(F.avg("value").alias("x"))
    members, _, _ = intervals.latent_exclusion(x, F.col("event_type"), F.col("user_id"), F.col("x"), allowed=0, rounds=2, method="PARAMETRIC")
    return members.where("complete")


_HALVES = "(SELECT event_type, user_id % 2 AS half, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM events GROUP BY 1, 2)"


@query(f"SELECT a.event_type, round(abs(a.lo - b.lo), 6) AS delta_low, round(abs(a.lo - b.lo) / ((p.hi - p.lo) / 3.92), 6) AS br_low, round(abs(a.hi - b.hi), 6) AS delta_high, round(abs(a.hi - b.hi) / ((p.hi - p.lo) / 3.92), 6) AS br_high FROM {_HALVES} a JOIN {_HALVES} b ON a.event_type = b.event_type AND a.half = 0 AND b.half = 1 JOIN (SELECT event_type, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM events GROUP BY 1) p ON p.event_type = a.event_type")
def bias_ratios(spark, sf_dir):
    e = _ev(spark, sf_dir)
    cut = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    half = lambda k: F.when(F.col("user_id") % 2 == k, F.col("value"))
    g = e.groupBy("event_type").agg(cut(half(0)).alias("a"), cut(half(1)).alias("b"), cut(F.col("value")).alias("p"))
    ends = lambda c: (F.col(c)[0], F.col(c)[1])
    return g.select("event_type", intervals.bias_ratio(ends("a"), ends("b"), ends("p")).alias("r")).select("event_type", "r.*")


@query("SELECT event_type, low < 0 AS clamped, round(greatest(low, 0), 2) AS low, round(high, 2) AS high FROM (SELECT event_type, avg(value) - 1.96 * stddev_samp(value) AS low, avg(value) + 1.96 * stddev_samp(value) AS high FROM events GROUP BY 1)")
def ri_adjusted(spark, sf_dir):
    g = _ev(spark, sf_dir).groupBy("event_type").agg(F.min("value").alias("least"), (F.avg("value") - 1.96 * F.stddev_samp("value")).alias("low"), (F.avg("value") + 1.96 * F.stddev_samp("value")).alias("high"))
    return intervals.adjust_limits(g, F.col("least"), ["low", "high"], 2).drop("least")


@query("SELECT kind, n, CASE WHEN kind = 'gap' THEN 'not_calculated' WHEN kind = 'wide' THEN 'inadequate' ELSE 'adequate' END AS adequacy, CASE WHEN n < 20 THEN 'insufficient_n' WHEN n < 120 THEN 'small_sample_review' WHEN kind <> 'fine' THEN 'ci_review' ELSE 'candidate_requires_verification' END AS status FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'fine' WHEN 1 THEN 'wide' ELSE 'gap' END AS kind, s_suppkey AS n FROM supplier)")
def ri_status(spark, sf_dir):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "fine").when(F.col("s_suppkey") % 3 == 1, "wide").otherwise("gap")
    x = table(spark, sf_dir, "supplier").select(kind.alias("kind"), F.col("s_suppkey").alias("n"), F.lit(1.0).alias("low"), F.lit(11.0).alias("high"))
    half = F.when(F.col("kind") == "fine", 0.5).when(F.col("kind") == "wide", 2.0)
    ci = lambda c: (F.col(c) - half, F.col(c) + half)
    x = x.withColumn("adequacy", intervals.ci_adequacy(F.col("low"), F.col("high"), ci("low"), ci("high")))
    yes = F.lit(True)
    return x.select("kind", "n", "adequacy", intervals.interval_status(F.col("n"), F.col("low"), F.col("high"), order_resolved=yes, confirmed=yes, subjects_known=yes, censored=F.lit(0), adequacy=F.col("adequacy"), fits=yes, least=F.lit(0.0)).alias("status"))


_MOMENTS = "m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), c AS (SELECT event_type, count(*)::DOUBLE AS n, avg((value - m) ** 3) / avg((value - m) ** 2) ** 1.5 AS g1, avg((value - m) ** 4) / avg((value - m) ** 2) ** 2 AS b2 FROM events JOIN m USING (event_type) GROUP BY 1)"


@query(f"WITH {_MOMENTS}, d AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w, (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM c), e AS (SELECT *, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM d), k AS (SELECT event_type, n, (asinh(y / sqrt(2 / (w - 1))) / sqrt(0.5 * ln(w))) ** 2 + ((1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))) ** 2 AS k2 FROM e) SELECT event_type, CAST(n AS BIGINT) AS n, round(k2, 4) AS k2, round(exp(-k2 / 2), 8) AS p FROM k")
def ri_dagostino(spark, sf_dir):
    return study.dagostino(_ev(spark, sf_dir), ["event_type"], F.col("value")).withColumn("k2", F.round("k2", 4))


@query("WITH c AS (SELECT event_type AS g, user_id % 7 AS h, count(*)::DOUBLE AS n, sum(value) AS s, sum(value * value) AS ss FROM events GROUP BY 1, 2), g AS (SELECT g, count(*) AS cells, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS sc, sum(n * n) AS n2 FROM c GROUP BY 1), t AS (SELECT count(*) AS a, sum(cells) AS b, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS sg, sum(sc) AS sc, sum(n * n) AS g2, sum(n2 / n) AS c1, sum(n2) AS c2 FROM g), r AS (SELECT *, (ss - sc) / (n - b) AS e FROM t), w AS (SELECT *, ((sc - sg) / (b - a) - e) / ((n - c1) / (b - a)) AS w FROM r), o AS (SELECT *, ((sg - s * s / n) / (a - 1) - e - (c1 - c2 / n) / (a - 1) * w) / ((n - g2 / n) / (a - 1)) AS o FROM w) SELECT a AS groups, CAST(b AS BIGINT) AS cells, CAST(n AS BIGINT) AS n, round(e, 4) AS residual, round(sqrt(greatest(o, 0) / e), 6) AS sdr, round(sqrt(greatest(w, 0) / e), 6) AS nested_sdr, o < 0 OR w < 0 AS negative FROM o")
def sdr_nested(spark, sf_dir):
    return intervals.nested_deviation_ratios(_ev(spark, sf_dir), F.col("event_type"), F.col("user_id") % 7, F.col("value")).withColumn("residual", F.round("residual", 4))


@query("WITH b AS (SELECT p_size AS x, p_retailprice AS y, CAST(p_partkey % 5 + 1 AS DOUBLE) AS w, p_partkey % 6 AS h, p_partkey // 6 % 8 AS i FROM part), s AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy, count(*) AS n FROM b), f AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS k, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) AS c FROM s), u AS (SELECT h, i, sum(w * (y - c - k * x)) AS u0, sum(w * (y - c - k * x) * x) AS u1 FROM b, f GROUP BY h, i), m AS (SELECT sum(v00) AS m00, sum(v01) AS m01, sum(v11) AS m11, CAST(sum(psus) - count(*) AS BIGINT) AS df FROM (SELECT h, count(*) AS psus, var_samp(u0) * count(*) AS v00, covar_samp(u0, u1) * count(*) AS v01, var_samp(u1) * count(*) AS v11 FROM u GROUP BY h)) SELECT unnest(['intercept', 'p_size']) AS term, round(unnest([c, k]), 4) AS estimate, round(sqrt(unnest([(sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11), (sx * sx * m00 - 2 * sx * sw * m01 + sw * sw * m11)])) / (sw * sxx - sx * sx), 4) AS se, df, n FROM f, m")
def survey_regression(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_size", "p_retailprice", (k % 5 + 1).cast("double").alias("w"), (k % 6).alias("h"), (F.floor(k / 6) % 8).alias("i"))
    fit = statistics.survey_regression(p, "p_retailprice", ["p_size"], "w", "h", "i")
    return spark.createDataFrame(fit[["term", "estimate", "se", "df", "n"]].round(4))
