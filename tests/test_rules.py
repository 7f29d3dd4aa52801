"""Control rules: names and settings, and every decision against a plain reading of the rules."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwright.operators import multirule as M

MATERIALS = ["high", "low", "mid"]


def frame(runs):
    """Runs as {material: z}, numbered from 1."""
    return pd.DataFrame([(k, k, m, z) for k, run in enumerate(runs, 1) for m, z in run.items()], columns=["run", "order", "material", "z"])


def plainly(runs, plan):
    """Reads every rule from the whole history, which is kept as a list of the runs that count, or breaks (None)."""
    out, past = [], []
    for run in runs:
        known = {m: z for m, z in run.items() if not math.isnan(z)}
        hits = {m: {} for m in run}
        if plan.trigger == "ALWAYS" or any(abs(z) > 2 for z in known.values()):
            for name in plan.actions:
                r, scope = M.parse_rule(name), plan.scopes.get(name, plan.scope)
                over = lambda z, s, r=r: s * z > r.limit
                for m, z in known.items():
                    where = set()
                    if r.kind == "point" and abs(z) > r.limit:
                        where.add("point")
                    if r.kind == "range" and len(known) > 1:
                        top, low = max(known.values()), min(known.values())
                        if plan.forms.get(name) == "RANGE":
                            if top - low >= r.limit and z in (top, low):
                                where.add("within_run")
                        elif top > r.limit / 2 and low < -r.limit / 2 and abs(z) > r.limit / 2:
                            where.add("within_run")
                    if r.counts_runs and scope != "ACROSS_MATERIAL":
                        mine = [z]
                        for kind, p in reversed(past):
                            if kind == "break" and m in p or len(mine) == r.of:
                                break
                            if kind == "run" and m in p:
                                mine.append(p[m])
                        if any(over(z, s) and sum(over(v, s) for v in mine) >= r.need for s in (1, -1)):
                            where.add("across_run")
                    if r.counts_runs and scope != "WITHIN_MATERIAL" and len(known) > 1:
                        if r.need <= len(known):
                            if any(over(z, s) and sum(over(v, s) for v in known.values()) >= r.need for s in (1, -1)):
                                where.add("within_run")
                        elif r.kind == "sequence" and len(known) == len(run):
                            values, back = list(known.values()), math.ceil(r.of / len(known)) - 1
                            for kind, p in reversed(past):
                                if not back or kind == "break" or set(p) != set(run):
                                    break
                                values, back = values + list(p.values()), back - 1
                            if not back and any(all(over(v, s) for v in values) for s in (1, -1)):
                                where.add("across_run_material")
                    if where:
                        hits[m][name] = where
        rows = {}
        for m in run:
            bad, odd = ([n for n, a in plan.actions.items() if a == action and n in hits[m]] for action in ("REJECT", "WARNING"))
            if m not in known:
                rows[m] = ("NE", "NE", "NE", "NOT_EVALUATED")
            else:
                rows[m] = (", ".join(bad) or "NONE", ", ".join(odd) or "NONE", "; ".join(f"{n}:{'+'.join(sorted(hits[m][n]))}" for n in [*odd, *bad]) or "NONE", "REJECT" if bad else "WARNING" if odd else "IN_CONTROL")
        worst = max((r[3] for r in rows.values()), key=M.SEVERITY.index)
        out.append({m: (*r, worst) for m, r in rows.items()})
        if worst == "REJECT" and plan.after_reject == "RESTART":
            past = []
            continue
        missing = set(run) - set(known)
        counts = not (worst == "REJECT" and plan.after_reject == "SKIP")
        if counts:
            past.append(("run", known))
        if missing:
            past.append(("break", missing))
    return out


VALUES = st.sampled_from([0.2, -0.3, 0.9, 1.3, -1.4, 1.8, 2.2, -2.4, 2.7, 3.4, -3.3, 0.0])


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3).flatmap(lambda n: st.lists(st.tuples(*[VALUES] * n), min_size=1, max_size=25)), st.sampled_from(M.AFTER), st.sampled_from(M.SCOPES), st.sampled_from(M.TRIGGERS), st.sampled_from(M.FORMS), st.sampled_from([None, ["2of3_2s", "3of5_1s", "6x", "R_4s"]]))
def test_decisions_are_those_of_a_plain_reading(values, after, scope, trigger, form, rules):
    runs = [dict(zip(MATERIALS, z)) for z in values]
    plan = M.plan_of(rules, None, after, scope, form, trigger)
    got = M.judge(frame(runs), plan)
    want = plainly(runs, plan)
    for r in got.itertuples():
        assert (r.violation, r.warning, r.rule_scope, r.decision, r.run_decision) == want[r.run - 1][r.material], (r.run, r.material)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(VALUES, st.just(math.nan)), min_size=1, max_size=30), st.sampled_from(M.AFTER))
def test_missing_results_break_a_material(values, after):
    runs = [{"only": z} for z in values]
    plan = M.plan_of(after_reject=after, scope="WITHIN_MATERIAL")
    want = plainly(runs, plan)
    for r in M.judge(frame(runs), plan).itertuples():
        assert (r.violation, r.warning, r.rule_scope, r.decision, r.run_decision) == want[r.run - 1]["only"]


def test_a_missing_level_starts_whole_runs_again():
    shift = [{"high": 1.5, "low": 1.6}, {"high": 1.4, "low": math.nan}, {"high": 1.3, "low": 1.2}]
    got = M.judge(frame(shift), M.plan_of(["4_1s"], []))
    assert set(got.violation) == {"NONE", "NE"} and set(got[got.run == 2].run_decision) == {"NOT_EVALUATED"}
    assert set(M.judge(frame([*shift, {"high": 1.9, "low": 1.1}]), M.plan_of(["4_1s"], [])).query("run == 4").rule_scope) == {"4_1s:across_run_material", "4_1s:across_run+across_run_material"}
    unmeasured = M.judge(frame([{"high": 2.5, "low": 0.1}, {"low": 0.2}, {"high": 2.6, "low": 0.0}]))
    assert unmeasured.query("run == 3 and material == 'high'").violation.item() == "2_2s"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(VALUES, VALUES), min_size=2, max_size=40), st.data())
def test_a_chart_goes_on_where_it_stopped(values, data):
    runs = [dict(zip(MATERIALS, z)) for z in values]
    whole = M.judge(frame(runs))
    cut = data.draw(st.integers(1, len(runs) - 1))
    first = M.Chart(M.Plan())
    a = M.judge(frame(runs)[: 2 * cut], chart=first)
    again = M.Chart(M.Plan(), {m: list(t) for m, t in first.tails.items()}, [(sorted(m), z) for m, z in first.runs])
    b = M.judge(frame(runs)[2 * cut :], chart=again)
    pd.testing.assert_frame_equal(pd.concat([a, b], ignore_index=True), whole)


def test_names():
    canonical = {"1_3s": "1_3s", "1_3S": "1_3s", "r_4s": "R_4s", " 2OF3_2.0S ": "2of3_2s", "10X": "10x", "1_2.5s": "1_2.5s", "6_1s": "6_1s"}
    assert {t: M.parse_rule(t).name for t in canonical} == canonical
    assert [M.parse_rule(t).error for t in ("1_3s", "R_4s", "2_2s", "2of3_2s", "9x")] == ["random"] * 2 + ["systematic"] * 3
    for wrong in ("", "s", "2s", "0_2s", "1x", "0x", "3of3_2s", "0of2_1s", "4of3_1s", "R_0s", "Rx", "2ofR_1s", "2of5x", "1_0s", "1_2", "x_2s"):
        with pytest.raises(ValueError):
            M.parse_rule(wrong)


def test_settings_come_in_layers():
    plan = M.rule_plan({"WARNING_RULES": "1_2s,10x", "rule_settings": {"6x": {"action": "reject", "scope": "within_material"}}, "BY_RESULT": {"k": {"RULE_SETTINGS": {"6X": {"ACTION": "OFF"}, "R_4s": {"FORM": "range"}}, "AFTER_REJECT": "skip"}}})
    assert (plan.named("WARNING"), plan.named("REJECT"), plan.scopes) == (["1_2s", "10x"], ["1_3s", "2_2s", "R_4s", "4_1s", "6x"], {"6x": "WITHIN_MATERIAL"})
    own = M.rule_plan({"BY_RESULT": {"k": {"RULES": ["1_3s", "1_2s"], "RULE_SETTINGS": {"1_3s": {"ACTION": "OFF"}}, "AFTER_REJECT": "skip"}}}, "k")
    assert (own.named("WARNING"), own.named("REJECT"), own.after_reject) == ([], ["1_2s"], "SKIP")
    wrong = [{"RULES": ["1_3s", "1_3S"]}, {"RULES": ["1_3s"], "WARNING_RULES": ["1_3s"]}, {"SCOPE": "SOME"}, {"LIMIT": 1}, {"TRIGGER": "2s"}, {"AFTER_REJECT": "x"}, {"RULES": 5}]
    wrong += [{"RULE_SETTINGS": s} for s in ({"1_3s": {"SCOPE": "BOTH"}}, {"R_4s": {"SCOPE": "BOTH"}}, {"2_2s": {"FORM": "RANGE"}}, {"2_2s": {"SIZE": 1}}, {"2_2s": {"ACTION": "MAYBE"}}, {"9": {}})]
    for given_ in wrong:
        with pytest.raises(ValueError):
            M.rule_plan(given_)


def test_two_points_of_a_material_are_refused():
    with pytest.raises(ValueError):
        M.judge(pd.concat([frame([{"a": 1.0}]), frame([{"a": 1.1}])]))
    assert list(M.judge(frame([])).columns) == ["run", "order", "material", "z", *M.ADDED]


def test_long_charts_take_linear_time():
    import time

    rng = np.random.default_rng(2)
    runs = [{"a": x, "b": y} for x, y in rng.normal(0, 1.2, (50_000, 2))]
    data = frame(runs)
    started = time.perf_counter()
    out = M.judge(data)
    assert len(out) == 100_000 and time.perf_counter() - started < 40


def test_groups_on_frames(spark):
    data = frame([{"a": 2.3, "b": 0.0}, {"a": 2.4, "b": 0.1}])
    both = spark.createDataFrame(pd.concat([data.assign(g="x"), data.assign(g="y")]))
    got = M.multirule(both, "g", settings={"BY_RESULT": {"y": {"RULE_SETTINGS": {"2_2s": {"ACTION": "OFF"}}}}}).where("run = 2 and material = 'a'").collect()
    assert {r.g: r.violation for r in got} == {"x": "2_2s", "y": "NONE"}
