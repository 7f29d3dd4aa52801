"""Catalogue, continued: linear models with levels, their errors against closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, table
from .operators import models


def _terms(spark, fit):
    """A row a term."""
    rows = [(t, round(float(b), 4), round(float(s), 4), int(n), int(d)) for t, b, s, n, d in fit[["term", "estimate", "se", "n", "df"]].itertuples(index=False)]
    return spark.createDataFrame(rows, "term string, estimate double, se double, n bigint, df bigint")


def _contrasts(column: str, reference: str, own: str, cross: str, n: str, df: str) -> str:
    """Group means against the reference's: v(g, m, vv) with each mean's variance, c(g, vr) with its covariance with the reference's."""
    return f"""SELECT CASE WHEN v.g = '{reference}' THEN 'intercept' ELSE '{column}=' || v.g END AS term, round(CASE WHEN v.g = '{reference}' THEN v.m ELSE v.m - r.m END, 4) AS estimate,
  round(sqrt(CASE WHEN v.g = '{reference}' THEN v.vv ELSE v.vv + r.vv - 2 * {cross} END), 4) AS se, CAST({n} AS BIGINT) AS n, CAST({df} AS BIGINT) AS df FROM {own} v, (SELECT * FROM {own} WHERE g = '{reference}') r"""


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""WITH m AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1),
v AS (SELECT g, any_value(m) AS m, sum(pow((o_totalprice - m) / (1 - 1 / n), 2)) / pow(any_value(n), 2) AS vv FROM orders JOIN m ON g = o_orderpriority GROUP BY g)
{_contrasts("o_orderpriority", "1-URGENT", "v", "0", "(SELECT count(*) FROM orders)", "(SELECT count(*) - count(DISTINCT o_orderpriority) FROM orders)")}""")
def model_levels_hc3(spark, sf_dir):
    return _terms(spark, models.linear_model(table(spark, sf_dir, "orders"), "o_totalprice", categorical={"o_orderpriority": (_PRIORITIES, "1-URGENT")}))


@query("""WITH p AS (SELECT o_orderstatus AS g, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM orders),
m AS (SELECT *, x - avg(x) OVER (PARTITION BY g) AS dx, y - avg(y) OVER (PARTITION BY g) AS dy, count(*) OVER (PARTITION BY g) AS n FROM p),
b AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS sxx, count(*) AS n FROM m)
SELECT 'o_custkey' AS term, round(any_value(b), 4) AS estimate, round(sqrt(sum(pow(dx * (dy - b * dx) / (1 - 1 / m.n - dx * dx / sxx), 2))) / any_value(sxx), 4) AS se, any_value(b.n) AS n, any_value(b.n) - 4 AS df FROM m, b""")
def model_mixed_hc3(spark, sf_dir):
    fit = models.linear_model(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"], {"o_orderstatus": (["F", "O", "P"], "F")})
    return _terms(spark, fit[fit["term"] == "o_custkey"])


@query(f"""WITH m AS (SELECT o_orderstatus AS g, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1),
u AS (SELECT o_custkey AS c, g, sum(o_totalprice - m) / any_value(n) AS u FROM orders JOIN m ON g = o_orderstatus GROUP BY ALL),
s AS (SELECT k / (k - 1) * (n - 1) / (n - 3) AS s, n, k FROM (SELECT CAST(count(DISTINCT o_custkey) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM orders)),
v AS (SELECT m.g, m.m, (SELECT sum(u * u) FROM u WHERE u.g = m.g) * (SELECT s FROM s) AS vv, (SELECT sum(a.u * b.u) FROM u a JOIN u b ON a.c = b.c WHERE a.g = m.g AND b.g = 'F') * (SELECT s FROM s) AS vr FROM m)
{_contrasts("o_orderstatus", "F", "v", "v.vr", "(SELECT n FROM s)", "(SELECT k - 1 FROM s)")}""")
def model_levels_cluster(spark, sf_dir):
    return _terms(spark, models.linear_model(table(spark, sf_dir, "orders"), "o_totalprice", categorical={"o_orderstatus": (["F", "O", "P"], "F")}, covariance="CLUSTER", cluster="o_custkey"))


@query(f"""WITH p AS (SELECT o_orderstatus AS g, o_totalprice AS y, CAST(1 + o_orderkey % 3 AS DOUBLE) AS w, o_orderpriority AS h, o_custkey % 40 AS i FROM orders),
m AS (SELECT g, sum(w) AS n, sum(w * y) / sum(w) AS m FROM p GROUP BY g),
k AS (SELECT DISTINCT h, i FROM p),
u AS (SELECT k.h, k.i, m.g, coalesce(sum(w * (y - m)) / any_value(n), 0) AS u FROM k CROSS JOIN m LEFT JOIN p ON p.h = k.h AND p.i = k.i AND p.g = m.g GROUP BY ALL),
c AS (SELECT h, i, g, u - avg(u) OVER (PARTITION BY h, g) AS u, count(*) OVER (PARTITION BY h, g) AS k FROM u),
v AS (SELECT m.g, m.m, (SELECT sum(k / (k - 1) * u * u) FROM c WHERE c.g = m.g) AS vv, (SELECT sum(a.k / (a.k - 1) * a.u * b.u) FROM c a JOIN c b ON a.h = b.h AND a.i = b.i WHERE a.g = m.g AND b.g = 'F') AS vr FROM m)
{_contrasts("o_orderstatus", "F", "v", "v.vr", "(SELECT count(*) FROM p)", "(SELECT count(*) - count(DISTINCT h) FROM k)")}""")
def model_levels_survey(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"w": 1 + F.col("o_orderkey") % 3, "psu": F.col("o_custkey") % 40})
    return _terms(spark, models.linear_model(o, "o_totalprice", categorical={"o_orderstatus": (["F", "O", "P"], "F")}, covariance="SURVEY", weight="w", stratum="o_orderpriority", psu="psu"))
