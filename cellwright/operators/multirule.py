"""Control rules over runs: N_ks, MofN_ks, R_ks, Nx, with scopes and what a rejected run does to later counts.

RESTART and SKIP make a decision depend on the decisions before it, so one group (an analyte on an instrument) is judged in order.
What a group must remember is small: for each material the last few values that still count, and the last few
complete runs; a stream carries exactly that (see ``streaming.streams.stateful_multirule``).

A long group is judged in segments side by side, once the beginning of each is known.  With CONTINUE a segment adds its values to whatever came before;
with RESTART it leaves behind what follows its last rejection that a single value makes.  Where there is none, and with SKIP, a segment is judged from what the
one before it seems to leave behind, and again where that turns out otherwise, until none does: each next one is right at the latest a round later.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from .ordering import _small, below, meet

#: Default rules, words of the options, the limit of the classic trigger, severities in rising order.
WARN, REJECT = ["1_2s"], ["1_3s", "2_2s", "R_4s", "4_1s", "10x"]
SCOPES, TRIGGERS, AFTER, FORMS, ACTIONS = ("BOTH", "WITHIN_MATERIAL", "ACROSS_MATERIAL"), ("ALWAYS", "1_2S"), ("RESTART", "SKIP", "CONTINUE"), ("COUNT", "RANGE"), ("REJECT", "WARNING", "OFF")
TRIGGER_SD = 2.0
SEVERITY = ["IN_CONTROL", "NOT_EVALUATED", "WARNING", "REJECT"]
#: Points of a segment of a long group, segments of a group, and of all groups together (a row each on the driver).
SEGMENT_POINTS, MAX_SEGMENTS, MAX_STATES = 50_000, 1024, 1 << 18
ADDED = ["violation", "warning", "rule_scope", "error_type", "decision", "run_decision"]

_NAME = re.compile(r"(?:(?P<need>\d+)of)?(?P<of>\d+|R)(?:_(?P<limit>\d+(?:\.\d+)?)s|(?P<mean>x))", re.IGNORECASE)


@dataclass(frozen=True)
class Rule:
    """``need`` of the last ``of`` values beyond ``limit`` SD on one side; kinds: point, sequence, count, range."""

    name: str
    kind: str
    need: int
    of: int
    limit: float

    @property
    def error(self) -> str:
        return "random" if self.kind in ("point", "range") else "systematic"

    @property
    def counts_runs(self) -> bool:
        return self.kind in ("sequence", "count")


def parse_rule(name: str) -> Rule:
    """``1_3s``, ``2_2s``, ``2of3_2s``, ``R_4s``, ``10x``, in any case and with their usual spelling as ``name``."""
    m = _NAME.fullmatch(str(name).strip())
    if not m:
        raise ValueError(f"unknown control rule {name!r}; examples: 1_3s, 2_2s, 2of3_2s, R_4s, 10x")
    limit, spread = float(m["limit"] or 0), m["of"].upper() == "R"
    of = 2 if spread else int(m["of"])
    need = int(m["need"]) if m["need"] else of
    sound = (m["mean"] and not m["need"] and not spread and of > 1) or (limit > 0 and not (spread and m["need"]) and 1 <= need and (need < of if m["need"] else of > 0))
    if not sound:
        raise ValueError(f"control rule {name!r} can't be met or means nothing")
    if m["mean"]:
        return Rule(f"{of}x", "sequence", of, of, 0.0)
    tail = f"_{limit:g}s"
    if spread:
        return Rule("R" + tail, "range", 2, 2, limit)
    if m["need"]:
        return Rule(f"{need}of{of}{tail}", "count", need, of, limit)
    return Rule(f"{of}{tail}", "point" if of == 1 else "sequence", of, of, limit)


def _word(value: object, allowed: tuple[str, ...], what: str) -> str:
    word = str(value).strip().upper()
    if word not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}")
    return word


def _names(given: object) -> list[str]:
    items = given.split(",") if isinstance(given, str) else given
    if not isinstance(items, (list, tuple)):
        raise ValueError("rules are a list of names")
    out = [parse_rule(x).name for x in items]
    if len(set(out)) < len(out):
        raise ValueError("rules must be distinct")
    return out


@dataclass
class Plan:
    """Rules in force: name -> REJECT or WARNING in order of evaluation, with each rule's own scope or form."""

    actions: dict[str, str] = field(default_factory=lambda: dict.fromkeys(WARN, "WARNING") | dict.fromkeys(REJECT, "REJECT"))
    scope: str = "BOTH"
    trigger: str = "ALWAYS"
    after_reject: str = "RESTART"
    scopes: dict[str, str] = field(default_factory=dict)
    forms: dict[str, str] = field(default_factory=dict)

    def named(self, action: str) -> list[str]:
        return [n for n, a in self.actions.items() if a == action]

    def _list(self, action: str, names: list[str]) -> None:
        """``names`` become the rules of this action; the others of it go."""
        rest = {n: a for n, a in self.actions.items() if a != action and n not in names}
        self.actions = rest | dict.fromkeys(names, action)

    def layer(self, settings: Mapping) -> Plan:
        """One level of settings on top: lists first, then single rules."""
        given = {str(k).upper(): v for k, v in settings.items() if v is not None}
        if odd := set(given) - {"RULES", "WARNING_RULES", "SCOPE", "TRIGGER", "AFTER_REJECT", "RULE_SETTINGS"}:
            raise ValueError(f"unknown control rule option: {', '.join(sorted(odd))}")
        lists = {a: _names(given[k]) for k, a in (("WARNING_RULES", "WARNING"), ("RULES", "REJECT")) if k in given}
        if len(lists) == 2 and (both := set(lists["WARNING"]) & set(lists["REJECT"])):
            raise ValueError(f"both a warning and a rejection rule: {', '.join(sorted(both))}")
        for action, names in lists.items():
            self._list(action, names)
        self.scope = _word(given.get("SCOPE", self.scope), SCOPES, "SCOPE")
        self.trigger = _word(given.get("TRIGGER", self.trigger), TRIGGERS, "TRIGGER")
        self.after_reject = _word(given.get("AFTER_REJECT", self.after_reject), AFTER, "AFTER_REJECT")
        for spelled, options in given.get("RULE_SETTINGS", {}).items():
            self._single(parse_rule(spelled), {str(k).upper(): v for k, v in options.items() if v is not None})
        return self

    def _single(self, rule: Rule, options: dict) -> None:
        if odd := set(options) - {"ACTION", "SCOPE", "FORM"}:
            raise ValueError(f"unknown option of {rule.name}: {', '.join(sorted(odd))}")
        if "ACTION" in options:
            action = _word(options["ACTION"], ACTIONS, "ACTION")
            self.actions.pop(rule.name, None)
            if action != "OFF":
                self.actions[rule.name] = action
        for key, fits, allowed, held in (("SCOPE", rule.counts_runs, SCOPES, self.scopes), ("FORM", rule.kind == "range", FORMS, self.forms)):
            if key in options:
                word = _word(options[key], allowed, key)
                if not fits:
                    raise ValueError(f"{rule.name} has no {key}")
                held[rule.name] = word


def rule_plan(settings: Mapping | None = None, result_id: str | None = None) -> Plan:
    """Settings for all results, then those under BY_RESULT for one of them."""
    top = {str(k).upper(): v for k, v in (settings or {}).items()}
    own = (top.pop("BY_RESULT", None) or {}).get(result_id, {})
    return Plan().layer(top).layer(own)


def plan_of(reject: Iterable[str] | None = None, warn: Iterable[str] | None = None, after_reject: str = "RESTART", scope: str = "BOTH", form: str | None = None, trigger: str = "ALWAYS", scopes: Mapping[str, str] | None = None) -> Plan:
    """A plan from plain arguments; ``form`` holds for every range rule."""
    lists = {k: list(v) for k, v in (("RULES", reject), ("WARNING_RULES", warn)) if v is not None}
    plan = Plan().layer({**lists, "AFTER_REJECT": after_reject, "SCOPE": scope, "TRIGGER": trigger})
    for name, value in (scopes or {}).items():
        plan._single(parse_rule(name), {"SCOPE": value})
    for name in plan.actions:
        if form and parse_rule(name).kind == "range":
            plan._single(parse_rule(name), {"FORM": form})
    return plan


class Chart:
    """What one group remembers between runs, and the judgement of the next run.

    ``tails``: material -> its last values that still count; ``runs``: the last complete runs as (materials, values).
    """

    def __init__(self, plan: Plan, tails: Mapping[str, list[float]] | None = None, runs: Iterable[tuple[list[str], list[float]]] = ()):
        self.plan = plan
        self.rules = [(parse_rule(n), a, plan.scopes.get(n, plan.scope), plan.forms.get(n, "COUNT")) for n, a in plan.actions.items()]
        self.depth = max((r.of for r, *_ in self.rules if r.counts_runs), default=1) - 1
        self.tails = {m: deque(v, self.depth) for m, v in (tails or {}).items()}
        self.runs = deque(((frozenset(m), list(v)) for m, v in runs), (self.depth + 2) // 2)

    @property
    def state(self) -> str:
        """What the chart remembers, spelled alike whenever it is alike."""
        return json.dumps([sorted((m, list(v)) for m, v in self.tails.items() if v), [[sorted(m), v] for m, v in self.runs]])

    @classmethod
    def at(cls, plan: Plan, state: str | None) -> Chart:
        tails, runs = json.loads(state) if state else ([], [])
        return cls(plan, dict(tails), runs)

    def judge(self, materials: list[str], z: list[float]) -> list[list[str]]:
        """The columns ADDED for each point of one run."""
        if len(set(materials)) < len(materials):
            raise ValueError("one material has two points in one run")
        known = [k for k, v in enumerate(z) if not math.isnan(v)]
        hits: list[dict[str, set[str]]] = [{} for _ in z]
        if self.plan.trigger == "ALWAYS" or any(abs(z[k]) > TRIGGER_SD for k in known):
            for rule, _, scope, form in self.rules:
                for k, place in self._places(rule, scope, form, materials, z, known):
                    hits[k].setdefault(rule.name, set()).add(place)
        rows = [self._row(hit) if k in known else ["NE", "NE", "NE", "NE", "NOT_EVALUATED"] for k, hit in enumerate(hits)]
        worst = max((r[4] for r in rows), key=SEVERITY.index)
        self._remember(materials, z, len(known) == len(z), worst == "REJECT")
        return [[*r, worst] for r in rows]

    def _places(self, rule: Rule, scope: str, form: str, materials: list[str], z: list[float], known: list[int]) -> Iterable[tuple[int, str]]:
        if rule.kind == "point":
            yield from ((k, "point") for k in known if abs(z[k]) > rule.limit)
        elif rule.kind == "range":
            top, low = max((z[k] for k in known), default=0.0), min((z[k] for k in known), default=0.0)
            half = rule.limit / 2
            if form == "RANGE" and len(known) > 1 and top - low >= rule.limit:
                yield from ((k, "within_run") for k in known if z[k] in (top, low))
            elif form == "COUNT" and top > half and low < -half:
                yield from ((k, "within_run") for k in known if abs(z[k]) > half)
        else:
            beyond = lambda v: (v > rule.limit) - (v < -rule.limit)
            sides = {k: beyond(z[k]) for k in known}
            if not any(sides.values()):
                return
            if scope != "ACROSS_MATERIAL":
                # Enough values on this value's side also means that there are enough values.
                for k, side in sides.items():
                    tail = self.tails.get(materials[k], ())
                    before = sum(beyond(v) == side for v in list(tail)[len(tail) - min(len(tail), rule.of - 1) :])
                    if side and before + 1 >= rule.need:
                        yield k, "across_run"
            if scope != "WITHIN_MATERIAL" and len(known) > 1:
                yield from self._together(rule, sides, materials, len(known) == len(z), beyond)

    def _together(self, rule: Rule, sides: dict[int, int], materials: list[str], whole: bool, beyond) -> Iterable[tuple[int, str]]:
        """All materials as one sequence: within the run if it has enough points, else over whole runs of the same materials."""
        if rule.need <= len(sides):
            for side in (1, -1):
                same = [k for k, s in sides.items() if s == side]
                if len(same) >= rule.need:
                    yield from ((k, "within_run") for k in same)
        elif rule.kind == "sequence" and whole:
            before = math.ceil(rule.of / len(sides)) - 1
            earlier = list(self.runs)[-before:]
            if len(earlier) == before and all(m == frozenset(materials) for m, _ in earlier):
                if len({*sides.values(), *(beyond(v) for _, run in earlier for v in run)}) == 1:
                    yield from ((k, "across_run_material") for k in sides)

    def _row(self, hit: dict[str, set[str]]) -> list[str]:
        bad, odd = ([r for r, a, *_ in self.rules if a == action and r.name in hit] for action in ("REJECT", "WARNING"))
        spelled = "; ".join(f"{r.name}:{'+'.join(sorted(hit[r.name]))}" for r in [*odd, *bad])
        errors = "+".join(sorted({r.error for r in bad}))
        return [", ".join(r.name for r in bad) or "NONE", ", ".join(r.name for r in odd) or "NONE", spelled or "NONE", errors or "NONE", "REJECT" if bad else "WARNING" if odd else "IN_CONTROL"]

    def _remember(self, materials: list[str], z: list[float], whole: bool, rejected: bool) -> None:
        if rejected and self.plan.after_reject == "RESTART":
            self.tails.clear(), self.runs.clear()
            return
        counts = not (rejected and self.plan.after_reject == "SKIP")
        for m, v in zip(materials, z, strict=True):
            if math.isnan(v):  # a missing result ends its material's sequence
                self.tails.pop(m, None)
            elif counts:
                self.tails.setdefault(m, deque(maxlen=self.depth)).append(v)
        if not whole:
            self.runs.clear()
        elif counts:
            self.runs.append((frozenset(materials), list(z)))


def judge(points: pd.DataFrame, plan: Plan | None = None, chart: Chart | None = None, **options) -> pd.DataFrame:
    """One group's points (run, order, material, z), run by run, with the columns ADDED.

    Runs follow each other by their smallest order, then by name.  A run with two points of a material is refused.  A point without z is
    NOT_EVALUATED.  A decision depends on its own and earlier runs alone.  ``chart`` goes on from earlier runs.
    """
    chart = chart or Chart(plan or plan_of(**options))
    out, run, materials, z = _ordered(points)
    rows: list[list[str]] = []
    for start, end in _bounds(run):
        rows += chart.judge(materials[start:end], z[start:end])
    return out.assign(**dict(zip(ADDED, map(list, zip(*rows, strict=True)) if rows else [[]] * len(ADDED), strict=True)))


def _ordered(points: pd.DataFrame) -> tuple[pd.DataFrame, list[str], list[str], list[float]]:
    """Points in the order of their runs; run, material and z of each."""
    first = points.groupby("run", sort=False)["order"].transform("min")
    out = points.assign(_first=first, _run=points["run"].astype(str), _material=points["material"].astype(str)).sort_values(["_first", "_run", "_material"], kind="stable").reset_index(drop=True)
    return out.drop(columns=["_first", "_run", "_material"]), out["_run"].tolist(), out["_material"].tolist(), out["z"].astype(float).tolist()


def _bounds(run: list[str]) -> Iterable[tuple[int, int]]:
    start = 0
    for end in range(1, len(run) + 1):
        if end == len(run) or run[end] != run[start]:
            yield start, end
            start = end


def ending(points: pd.DataFrame, plan: Plan, state: str | None = None) -> dict:
    """What a segment leaves behind: ``state``, and whether it holds for any beginning (``sure``), adds to any beginning (``adds``; ``ended``: materials and
    runs whose sequence the segment ends), or was judged from ``state`` (``from``).

    After a rejection that a single value makes, RESTART remembers nothing of before; CONTINUE remembers values whatever was decided.
    """
    _, run, materials, z = _ordered(points)
    bounds, chart = list(_bounds(run)), Chart.at(plan, state)
    if plan.after_reject == "CONTINUE":
        chart = Chart(plan)
        ended: set[str] = set()
        broken = False
        for start, end in bounds:
            missing = {materials[k] for k in range(start, end) if math.isnan(z[k])}
            ended |= missing
            broken |= bool(missing)
            chart._remember(materials[start:end], z[start:end], not missing, False)
        return {"kind": "adds", "state": chart.state, "ended": sorted(ended), "broken": broken}
    if plan.after_reject == "RESTART":
        limits = [r.limit for r, action, *_ in chart.rules if r.kind == "point" and action == "REJECT"]
        sure = max(min(limits), TRIGGER_SD if plan.trigger == "1_2S" else 0.0) if limits else math.inf
        for at in reversed(range(len(bounds))):
            if any(abs(v) > sure for v in z[slice(*bounds[at])]):
                chart = Chart(plan)
                for start, end in bounds[at + 1 :]:
                    chart.judge(materials[start:end], z[start:end])
                return {"kind": "sure", "state": chart.state}
    for start, end in bounds:
        chart.judge(materials[start:end], z[start:end])
    return {"kind": "from", "state": chart.state, "begin": state}


def followed(begin: str, end: dict, plan: Plan) -> str:
    """The state after a segment that begins with ``begin``; a supposition if it was judged from another one."""
    if end["kind"] != "adds":
        return end["state"]
    was, more = Chart.at(plan, begin), Chart.at(plan, end["state"])
    for m, tail in was.tails.items():
        if m not in end["ended"]:
            more.tails[m] = deque([*tail, *more.tails.get(m, ())], more.depth)
    if not end["broken"]:
        more.runs = deque([*was.runs, *more.runs], more.runs.maxlen)
    return more.state


def multirule(points: DataFrame, group: str, plan: Plan | None = None, settings: Mapping | None = None, result: str | None = None, segment_points: int = SEGMENT_POINTS, **options) -> DataFrame:
    """``points(group, run, order, material, z)`` with the columns ADDED; one group's runs are in sequence by definition.

    ``settings`` may hold BY_RESULT entries keyed by the text of the column ``result``, or of the group.  Groups of more than ``segment_points`` points are
    judged in segments of about so many, if ``order`` is a number or a time.
    """

    def plan_named(name: object) -> Plan:
        return rule_plan(settings, str(name)) if settings is not None else plan or plan_of(**options)

    def plan_for(pdf: pd.DataFrame) -> Plan:
        return plan_named(pdf[result or group].iloc[0])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return judge(pdf, plan_for(pdf))

    rule_plan(settings)  # a wrong setting fails here, not in a task
    schema = StructType([*points.schema.fields, *[StructField(c, StringType()) for c in ADDED]])
    whole = lambda df: df.groupBy(group).applyInPandas(one, schema)
    if dict(points.dtypes)["order"] in ("string", "binary"):
        return whole(points)
    # Cuts are taken once and held, so that every later read cuts alike.
    share = F.ceil(F.lit(MAX_SEGMENTS) * segment_points / F.col("_n"))
    cuts = F.percentile_approx(F.col("order").cast("double"), [(i + 1) / MAX_SEGMENTS for i in range(MAX_SEGMENTS - 1)], 4 * MAX_SEGMENTS)
    sizes = points.groupBy(group).agg(F.count("*").alias("_n"), cuts.alias("_cuts")).where(F.col("_n") > segment_points)
    every = F.greatest(F.lit(1), share).cast("int")
    thin = sizes.select(group, F.array_distinct(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda _, i: (i + 1) % every == 0)).alias("_cuts"))
    held = [tuple(r) for r in thin.limit(MAX_STATES + 1).collect()]
    if not held:
        return whole(points)
    if sum(len(c) + 1 for _, c in held) > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} segments: raise segment_points")
    long = _small(points.sparkSession, held, points.select(group), "_cuts array<double>")
    # A run lies in one segment, that of its first point; runs without an order come last, as in ``judge``.  Each row leaves its group's cuts before it is shuffled.
    at = F.when(F.col("order").isNull(), F.size("_cuts")).otherwise(below("_cuts", F.col("order").cast("double")))
    pieces = meet(points, long, [group]).withColumn("_seg", at).drop("_cuts").withColumn("_seg", F.min("_seg").over(Window.partitionBy(group, "run")))
    judged = _side_by_side(pieces, group, result or group, plan_named, schema)
    return whole(meet(points, long.select(group), [group], "left_anti")).unionByName(judged)


def _side_by_side(pieces: DataFrame, group: str, result: str, plan_named, schema: StructType) -> DataFrame:
    """Each segment's end is sought by itself; segments whose end depends on a beginning that turns out otherwise are judged again, until none does."""
    spark = pieces.sparkSession
    kind = pieces.schema[group].dataType.simpleString()
    begin = StructType([pieces.schema[group], *StructType.fromDDL("_seg int, _state string").fields])

    def ends(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({group: [], "_seg": [], "_name": [], "_end": []})
        name = pdf[result].iloc[0]
        end = ending(pdf.drop(columns="_seg"), plan_named(name), states["_state"].iloc[0] if len(states) else None)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "_seg": [pdf["_seg"].iloc[0]], "_name": [str(name)], "_end": [json.dumps(end)]})

    def judged(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return judge(pdf.drop(columns="_seg"))
        return judge(pdf.drop(columns="_seg"), chart=Chart.at(plan_named(pdf[result].iloc[0]), states["_state"].iloc[0]))

    def beside(rows: DataFrame, states: list[tuple], one, out) -> DataFrame:
        keys = [F.col(group), F.col("_seg")]
        return rows.groupBy(*keys).cogroup(spark.createDataFrame(states, begin).groupBy(*keys)).applyInPandas(one, out)  # a state reaches its segment once

    fresh = Chart(plan_of()).state
    found: dict[tuple, dict] = {}
    names: dict[tuple, str] = {}
    states: dict[tuple, str] = {}
    again: list[tuple] | None = None
    while again is None or again:
        rows = pieces if again is None else meet(pieces, F.broadcast(spark.createDataFrame([(*k, states[k]) for k in again], begin).drop("_state")), [group, "_seg"], "left_semi")
        for r in beside(rows, [(*k, states[k]) for k in again or ()], ends, f"`{group}` {kind}, _seg int, _name string, _end string").collect():  # a row a segment
            found[r[group], r["_seg"]], names[r[group], r["_seg"]] = json.loads(r["_end"]), r["_name"]
        last: dict = {}
        for k in sorted(found, key=lambda k: k[1]):
            states[k] = last.get(k[0], fresh)
            last[k[0]] = followed(states[k], found[k], plan_named(names[k]))
        again = [k for k in found if found[k]["kind"] == "from" and (found[k]["begin"] or fresh) != states[k]]
    return beside(pieces, [(*k, s) for k, s in states.items()], judged, schema)
