"""Catalogue, continued: order statistics and distribution tests of groups that no task holds, each with its SQL twin.

Ranges are kept small here, so that the small tables are searched in the rounds that large ones need.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _ORACLES, SEX, bounded, events, query, table  # noqa: F401
from .functions import values as V  # noqa: F401
from .operators import distributions, intervals, ordering, statistics, summaries

_SPREAD = [0.0, 0.01, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


def _quantile_rows(source: str, by: str, value: str) -> str:
    head = f"{by}, " if by else ""
    one = f"SELECT {head}count({value}) AS n, " + ", ".join(f"round(quantile_cont({value}, {p}), 6) AS q{i}" for i, p in enumerate(_SPREAD)) + f" FROM {source}" + (f" GROUP BY {by}" if by else "")
    return f"SELECT {head}n, unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in _SPREAD)}]) AS p, unnest([{', '.join(f'q{i}' for i in range(len(_SPREAD)))}]) AS value FROM ({one})"


def _listed(q):
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in _SPREAD]).alias("p"), F.col("q").alias("v"))
    return q.withColumn("r", F.explode(pairs)).select(*[c for c in q.columns if c not in ("q", "n")], "n", F.col("r.p").alias("p"), F.round("r.v", 6).alias("value"))


@query(_quantile_rows("lineitem", "", "l_extendedprice"))
def quantiles_one_group(spark, sf_dir):
    return _listed(ordering.exact_quantiles(table(spark, sf_dir, "lineitem"), [], F.col("l_extendedprice"), _SPREAD, rows=200))


@query(_quantile_rows("lineitem", "l_linestatus", "l_quantity"))
def quantiles_hot_values(spark, sf_dir):
    """Fifty values share all rows: each is a range of its own."""
    return _listed(ordering.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_quantity"), _SPREAD, rows=100))


@query(_ORACLES["percentile_bands"])
def percentile_bands_by_rounds(spark, sf_dir):
    return summaries.percentile_bands(events(spark, sf_dir).df, "value", [25, 50, 75], summaries.ROUNDS)


def _every_percentile(column: str, source: str) -> str:
    ps = summaries.PERCENTILES
    return f"SELECT '{column}' AS \"column\", unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in ps)}]) AS percentile, unnest([{', '.join(f'round(quantile_cont(CAST({column} AS DOUBLE), {p / 100}), 6)' for p in ps)}]) AS value, count({column}) AS n FROM {source}"


@query(f"{_every_percentile('o_totalprice', 'orders')} UNION ALL {_every_percentile('o_custkey', 'orders')}")
def percentiles_by_rounds(spark, sf_dir):
    return summaries.percentile_table(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], summaries.ROUNDS)


# Correlation and lines ----------------------------------------------------------------


def _tau(head: str, source: str, a: str, b: str, key: str, by: str = "") -> str:
    """Tau-b from all pairs."""
    g, on = (f"p.{by} AS {by}, ", f" AND p.{by} = q.{by}") if by else ("", "")
    pairs = f"SELECT {g}sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) AS s, sum(abs(sign(p.{a} - q.{a}))) AS u, sum(abs(sign(p.{b} - q.{b}))) AS v FROM {source} p JOIN {source} q ON p.{key} < q.{key}{on}" + (f" GROUP BY p.{by}" if by else "")
    sizes = f"SELECT {f'{by}, ' if by else ''}count(*) AS n FROM {source}" + (f" GROUP BY {by}" if by else "")
    return f"SELECT {head} FROM ({pairs}) s, ({sizes}) n" + (f" WHERE s.{by} = n.{by}" if by else "")


@query(_tau("'c_nationkey' AS a, 'c_acctbal' AS b, n, round(s / sqrt(u * v), 6) AS r", "customer", "c_nationkey", "c_acctbal", "c_custkey"))
def corr_kendall(spark, sf_dir):
    return statistics.correlation(table(spark, sf_dir, "customer"), ["c_nationkey", "c_acctbal"], "kendall")


@query(_tau("s.o_orderstatus, n, round(s / sqrt(u * v), 6) AS tau", "(SELECT *, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS thousands FROM orders)", "o_custkey", "thousands", "o_orderkey", "o_orderstatus"))
def kendall_by_ranges(spark, sf_dir):
    """Each group lies in many ranges of both columns."""
    df = table(spark, sf_dir, "orders").withColumn("thousands", F.floor(F.col("o_totalprice") / 1000).cast("double"))
    return ordering.kendall(df, ["o_orderstatus"], "o_custkey", "thousands", task_rows=300)


_LINE = "(SELECT CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 97 + floor(c_acctbal / 500) AS DOUBLE) AS y, c_custkey AS k FROM customer)"


@query(f"""WITH p AS MATERIALIZED (SELECT * FROM {_LINE}),
s AS (SELECT (b.y - a.y) / (b.x - a.x) AS s FROM p a JOIN p b ON a.k < b.k WHERE a.x <> b.x AND b.y - a.y <> a.x - b.x),
c AS (SELECT list_sort(list(s)) AS l, count(*) AS m, count(*) FILTER (s < -1) AS k FROM s),
m AS (SELECT CASE WHEN m // 2 + k < m THEN (l[(m - 1) // 2 + k + 1] + l[m // 2 + k + 1]) / 2 ELSE (l[(m - 1) // 2 + 1] + l[m // 2 + 1]) / 2 END AS slope FROM c)
SELECT count(*) AS n, round(any_value(slope), 6) AS slope, round(median(y - slope * x), 6) AS intercept FROM p, m""")
def passing_bablok_one_group(spark, sf_dir):
    """One group, searched by counts over ranges; many points share an x."""
    c = table(spark, sf_dir, "customer")
    x = (F.col("c_custkey") % 97).cast("double")
    return ordering.passing_bablok(c.select(x.alias("x"), (x + F.floor(F.col("c_acctbal") / 500)).cast("double").alias("y")), [], task_rows=200)


# Distribution tests -------------------------------------------------------------------

_CDF = "CASE WHEN z > 0 THEN 1 - {t} ELSE {t} END".format(t="exp(-z * z / 2) / sqrt(2 * pi()) * w * (0.319381530 + w * (-0.356563782 + w * (1.781477937 + w * (-1.821255978 + w * 1.330274429))))")


@query(f"""WITH c AS (SELECT event_type, value AS x, count(*) AS k FROM events WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1),
u AS (SELECT event_type, n, k, sum(k) OVER (PARTITION BY event_type ORDER BY x) AS upto, (x - m) / sd AS z FROM c JOIN m USING (event_type)),
f AS (SELECT *, {_CDF} AS f FROM (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS w FROM u)),
d AS (SELECT event_type, n, max(greatest(upto / n - f, f - (upto - k) / n)) AS d FROM f GROUP BY ALL),
h AS (SELECT *, CASE WHEN n <= 100 THEN d ELSE d * pow(n / 100, 0.49) END AS h, CAST(least(n, 100) AS DOUBLE) AS q FROM d)
SELECT event_type, n, round(d, 6) AS d, round(least(1.0, exp(-7.01256 * h * h * (q + 2.78019) + 2.99587 * h * sqrt(q + 2.78019) - 0.122119 + 0.974598 / sqrt(q) + 1.67997 / q)), 6) AS p FROM h""")
def lilliefors(spark, sf_dir):
    return distributions.lilliefors(events(spark, sf_dir).df, ["event_type"], F.col("value"))


_KS = """WITH x AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL),
n AS (SELECT g, count(*) AS n FROM x GROUP BY g),
p AS (SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b FROM n a JOIN n b ON a.g < b.g),
v AS (SELECT group_a, group_b, n_a, n_b, x.x, count(*) FILTER (x.g = group_a) AS ka, count(*) FILTER (x.g = group_b) AS kb FROM p JOIN x ON x.g IN (group_a, group_b) GROUP BY ALL),
u AS (SELECT *, sum(ka) OVER w / n_a - sum(kb) OVER w / n_b AS off FROM v WINDOW w AS (PARTITION BY group_a, group_b ORDER BY x)),
d AS (SELECT group_a, group_b, n_a, n_b, max(abs(off)) AS d, sqrt(n_a * n_b / (n_a + n_b)) AS r FROM u GROUP BY ALL),
s AS (SELECT *, (r + 0.12 + 0.11 / r) * d AS s FROM d),
k AS (SELECT group_a, group_b, n_a, n_b, round(d, 6) AS d, round(CASE WHEN s < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 21), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * i * i * s * s))))) END, 6) AS p FROM s)"""


@query(f"{_KS} SELECT * FROM k")
def ks_pairs(spark, sf_dir):
    return distributions.ks_pairs(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_totalprice"))


@query(f"""{_KS}, m AS (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM x GROUP BY g),
j AS (SELECT k.group_a, k.group_b, k.n_a, k.n_b, k.p AS ks_p, abs(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS z, 3 * sqrt((a.n + b.n) / 2 / 120) AS z_limit,
  greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / least(a.hi - a.lo, b.hi - b.lo) AS overlap FROM k JOIN m a ON a.g = group_a JOIN m b ON b.g = group_b)
SELECT group_a, group_b, n_a, n_b, ks_p, round(z, 6) AS z, round(z_limit, 6) AS z_limit, round(overlap, 6) AS overlap,
  CASE WHEN least(n_a, n_b) < 20 THEN 'collect_more_data' WHEN z > z_limit AND overlap >= 0.75 THEN 'review_partition_high_overlap' WHEN z > z_limit THEN 'partition_recommended' WHEN overlap < 0.25 THEN 'review_low_overlap' ELSE 'combine_ok' END AS recommendation FROM j""")
def group_difference(spark, sf_dir):
    return distributions.group_difference(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_totalprice")).drop("welch_p", "mann_whitney_p", "distribution")


# Intervals from ranks -----------------------------------------------------------------

_RANKED = """WITH x AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
s AS (SELECT DISTINCT event_type, n FROM x),
e AS (SELECT event_type, n, unnest([0.025, 0.975]) AS p, unnest(['low', 'high']) AS side FROM s),
l AS (SELECT e.event_type, e.n, side, max(x) FILTER (r = floor(h)) AS a, max(x) FILTER (r = least(floor(h) + 1, e.n)) AS b, any_value(h - floor(h)) AS f FROM (SELECT *, least(greatest(p * (n + 1), 1), n) AS h FROM e) e JOIN x ON x.event_type = e.event_type AND r IN (floor(h), least(floor(h) + 1, e.n)) GROUP BY ALL),
v AS (SELECT event_type, n, max(a + f * (b - a)) FILTER (side = 'low') AS low, max(a + f * (b - a)) FILTER (side = 'high') AS high FROM l GROUP BY ALL)"""


@query(f"""{_RANKED},
b AS (SELECT event_type, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.025) + (n - k) * ln(0.975))) OVER (PARTITION BY event_type ORDER BY k) AS c FROM (SELECT event_type, n, unnest(range(0, n)) AS k FROM s)),
q AS (SELECT event_type, n, min(k) FILTER (c >= 0.05) AS lo, min(k) FILTER (c >= 0.95) + 1 AS hi FROM b GROUP BY ALL)
SELECT v.event_type, v.n, round(low, 6) AS low, round(high, 6) AS high, round(max(x) FILTER (r = lo), 6) AS low_from, round(max(x) FILTER (r = hi), 6) AS low_to, round(max(x) FILTER (r = v.n + 1 - hi), 6) AS high_from, round(max(x) FILTER (r = v.n + 1 - lo), 6) AS high_to
FROM v JOIN q ON q.event_type = v.event_type JOIN x ON x.event_type = v.event_type GROUP BY ALL""")
def ri_ranked(spark, sf_dir):
    out = intervals.ranked_intervals(events(spark, sf_dir).df, ["event_type"], F.col("value"), rows=100)
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "low_from", "low_to", "high_from", "high_to")])


@query(f"{_RANKED} SELECT event_type, n, round(low, 6) AS low, round(high, 6) AS high, true AS around FROM v")
def ri_ranked_bootstrap(spark, sf_dir):
    """Resamples by their ranks' law; each limit lies within its confidence limits."""
    out = intervals.ranked_intervals(events(spark, sf_dir).df, ["event_type"], F.col("value"), "BOOTSTRAP", rows=100)
    around = (F.col("low_from") <= F.col("low")) & (F.col("low") <= F.col("low_to")) & (F.col("high_from") <= F.col("high")) & (F.col("high") <= F.col("high_to"))
    return out.select("event_type", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), around.alias("around"))
