"""Limits against unrounded changes, and order statistics and charts of groups that no task holds."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__


def events(spark, tmp_path, rows):
    """An events table of (user, type, value) in order of time."""
    pdf = pd.DataFrame([(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), *r) for i, r in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value"])
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_a_change_just_beyond_its_limit_is_reviewed(spark, tmp_path):
    path = events(spark, tmp_path, [(1, "a", 10.0), (1, "a", 50.000000001), (2, "a", 10.0), (2, "a", 50.0)])
    got = {(r.decision, r.reasons): r.n for r in __spark_entry__.queries()["autoverification_delta"](spark, path).collect()}
    assert got == {("PASS", ""): 3, ("REVIEW", "DELTA_ABS"): 1}


def test_a_comparison_builds_only_the_tables_that_are_read(spark, monkeypatch):
    from cellwright.operators import statistics

    def never(*_):
        raise AssertionError("no line is asked for")

    monkeypatch.setattr(statistics, "passing_bablok", never)
    df = spark.createDataFrame([(i, "g", m, float(i + (m == "B"))) for i in range(5) for m in "AB"], "k long, g string, m string, v double")
    got = statistics.method_comparison(df, ["k"], ["g"], "m", F.col("v"), "A", "B", [1.0])
    assert got["bias"].first().bias == 1.0 and set(got) == {"pairs", "deming", "passing_bablok", "bland_altman", "bias", "deming_predicted", "passing_bablok_predicted"}


@pytest.mark.parametrize("after", ["RESTART", "SKIP", "CONTINUE"])
def test_ends_of_segments_follow_each_other(after):
    """What segments leave behind, one by one, is what the whole chart remembers, whichever way an end is found."""
    from cellwright.operators import multirule as M

    rng = np.random.default_rng(4)
    rows = [("g", r, r, m, float(z)) for r in range(400) for m, z in zip("ABC", rng.normal(0, 1.3, 3), strict=True) if m != "C" or r % 29 < 9]
    points = pd.DataFrame(rows, columns=["g", "run", "order", "material", "z"])
    points.loc[rng.choice(len(points), 12, replace=False), "z"] = np.nan
    plan, state, kinds = M.plan_of(after_reject=after), M.Chart(M.plan_of()).state, set()
    for start in range(0, 400, 23):
        part = points[(points["run"] >= start) & (points["run"] < start + 23)]
        end = M.ending(part, plan, state)
        state = M.followed(state, end, plan)
        kinds.add(end["kind"])
        chart = M.Chart(plan)
        M.judge(points[points["run"] < start + 23], chart=chart)
        assert state == chart.state, start
    assert kinds <= {"RESTART": {"sure", "from"}, "SKIP": {"from"}, "CONTINUE": {"adds"}}[after]


def test_all_pairs_of_groups_are_read_in_one_pass(spark, monkeypatch):
    """Ranges hold counts of distinct values of all groups; nothing is multiplied by the number of pairs."""
    from cellwright.functions import special as S
    from cellwright.operators import ordering

    monkeypatch.setattr(ordering, "CUTS", 7)
    rng = np.random.default_rng(5)
    each = {g: np.round(rng.normal(i, 2, 90 + i), 1) for i, g in enumerate("abcd")} | {"flat": np.full(50, 1.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in each.items() for v in vs] + [("a", None), (None, 1.0)], "g string, x double")
    got = {(r.group_a, r.group_b): r for r in ordering.pair_counts(df, F.col("g"), F.col("x")).collect()}
    assert len(got) == 10
    for (a, b), r in got.items():
        both = pd.Series(np.concatenate([each[a], each[b]]))
        assert (r.n_a, r.n_b, r.w) == (len(each[a]), len(each[b]), pytest.approx(both.rank()[: len(each[a])].sum()))
        assert r.d == pytest.approx(S.ks_two_sample(each[a], each[b])[0]) and r.ties == sum(t**3 - t for t in both.value_counts())


def test_rows_of_large_groups_are_looked_up_where_they_are(spark, monkeypatch):
    """Rows are not moved by group before they are cut into ranges, else a group is one task's."""
    from cellwright.operators import intervals

    seen, plainly = [], intervals.values_at

    def spy(x, *rest):
        seen.append(x._jdf.queryExecution().sparkPlan().toString())
        return plainly(x, *rest)

    monkeypatch.setattr(intervals, "values_at", spy)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(60_030).select(F.when(F.col("id") >= 30, "hot").otherwise("small").alias("g"), F.col("id").cast("double").alias("v"))
        ranked = {r.g: (r.n, r.low) for r in intervals.ranked_intervals(df, ["g"], F.col("v")).collect()}
        got = {r.g: (r.n, r.low) for r in intervals.reference_intervals(df, ["g"], F.col("v"), how="RANK").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    hot = (60_000, 30 + 0.025 * 60_001 - 1)
    assert ranked["hot"] == pytest.approx(hot) and got["hot"] == pytest.approx(hot) and got["small"][0] == ranked["small"][0] == 30
    assert len(seen) == 2 and "Join" not in seen[0] and "BroadcastHashJoin" in seen[1] and "SortMergeJoin" not in seen[1]


def test_large_groups_alone_leave_nothing_to_list(spark, monkeypatch):
    from cellwright.operators import ordering

    hows, plainly = [], ordering.meet

    def spy(left, right, by, how="inner"):
        hows.append(how)
        return plainly(left, right, by, how)

    monkeypatch.setattr(ordering, "meet", spy)
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") % 50).cast("double").alias("v"))
    got = {r.g: (r.n, r.q) for r in ordering.exact_quantiles(df, ["g"], F.col("v"), [0.0, 0.5, 1.0], rows=100).collect()}
    assert got == {0: (2000, [0.0, 24.0, 48.0]), 1: (2000, [1.0, 25.0, 49.0])} and "left_anti" not in hows


@pytest.mark.parametrize("after", ["RESTART", "CONTINUE"])
def test_cuts_of_long_charts_are_not_shuffled_with_their_rows(spark, capsys, after):
    """Points of a run lie far apart or have no order; they stay in one segment, and no row takes its group's cuts through a shuffle."""
    from cellwright.operators import multirule as M

    rng = np.random.default_rng(8)
    rows = [("g", r, None if r % 40 == k else float(r + 30 * k * (r % 3)), m, float(np.round(rng.normal(0, 1.4), 2))) for r in range(240) for k, m in enumerate("ab")]
    rows += [("g", 900 + r, None, "a", 1.5) for r in range(3)]
    df = spark.createDataFrame(rows, "g string, run long, order double, material string, z double")
    out = M.multirule(df, "g", after_reject=after, segment_points=12)
    got = {(r.run, r.material): tuple(r[c] for c in M.ADDED) for r in out.collect()}
    want = M.judge(pd.DataFrame(rows, columns=["g", "run", "order", "material", "z"]), after_reject=after)
    assert got == {(r.run, r.material): tuple(getattr(r, c) for c in M.ADDED) for r in want.itertuples()}
    out.explain(mode="formatted")
    shuffled = re.findall(r"\) Exchange\nInput [^\n]*", capsys.readouterr().out)
    assert any("_seg" in line for line in shuffled) and not any("_cuts" in line for line in shuffled)
