"""Named chains: action pipelines, work lists, command strings, and workflows of named branches."""

from __future__ import annotations

import hashlib
import json
import shlex
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from .. import tags as T
from ..dataset import Dataset, as_list, ci
from ..operators import checks, comparators, multi, summaries
from ..operators.actions import run_action


@dataclass
class Output:
    name: str
    dataset: Dataset
    tables: dict[str, DataFrame] = field(default_factory=dict)
    status: str = "OK"
    message: str = ""


STEPS: dict[str, Callable[[Dataset, dict], Output]] = {}


def step(name: str):
    def register(f):
        STEPS[name] = f
        return f

    return register


@step("VALIDATE")
def _validate(ds: Dataset, options: dict) -> Output:
    found = checks.issues(ds)
    out = checks.drop_invalid(ds) if str(ci(options, "VALIDATE_ERROR", default="")).upper() == "DELETE" else ds
    return Output("VALIDATE", out, {"issues": found})


@step("DESCRIBE")
def _describe(ds: Dataset, options: dict) -> Output:
    num = ds.find(any_of=["NUM", "<NUM>", "AGE"])
    return Output("DESCRIBE", ds, {"describe": summaries.describe(ds.df, num, [c for c in ds.columns if c not in num])})


@step("EDA")
def _eda(ds: Dataset, options: dict) -> Output:
    from pyspark.sql import functions as F

    from ..functions import values as V

    num, cats = ds.find(any_of=["NUM", "<NUM>"]), ds.find(any_of=["CATEGORY", "BY"])
    item = next(iter(ds.find(any_of=["ITEM", "TESTNAME"])), None)
    tables = {"states": summaries.state_counts(ds.df, ds.columns), **{f"category:{c}": summaries.category_distribution(ds.df, c) for c in cats}}
    policy = str(ci(options, "POLICY", default="DELETE")).upper()
    for c in num:
        x = V.comparator_value(F.col(f"`{c}`").cast("string"), policy)
        tables[f"result_by:{c}"] = summaries.result_by(ds.df, x, {b: F.col(f"`{b}`") for b in cats if b != item}, F.col(f"`{item}`") if item else F.lit(c))
        tables[f"policy:{c}"] = comparators.policy_impact(ds.df, c)
        if item:
            tables[f"profile:{c}"] = comparators.profile(ds.df, item, c)
            tables[f"harmonize:{c}"] = comparators.harmonize_preview(ds.df, item, c)
    return Output("EDA", ds, tables)


@step("ANONYMIZE")
def _anonymize(ds: Dataset, options: dict) -> Output:
    out, maps = multi.anonymize(ds, ci(options, "COLUMNS"), str(ci(options, "SALT", default="")))
    return Output("ANONYMIZE", out, {f"mapping:{k}": v for k, v in maps.items()})


@step("SAMPLE")
def _sample(ds: Dataset, options: dict) -> Output:
    from pyspark.sql import functions as F

    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in ds.columns]))
    df = multi.sample(ds.df, key, ci(options, "N"), ci(options, "FRACTION"), ds.resolve_all(*as_list(ci(options, "BY"))) if ci(options, "BY") else [], int(ci(options, "SEED", default=0)))
    return Output("SAMPLE", ds.with_df(df))


@step("SPLIT_COMPARATOR")
def _split(ds: Dataset, options: dict) -> Output:
    df = ds.df
    for c in ds.find(any_of=["<NUM>"]):
        df = comparators.split_comparator(df, c)
    return Output("SPLIT_COMPARATOR", ds.with_df(df))


@step("HARMONIZE_COMPARATOR")
def _harmonize(ds: Dataset, options: dict) -> Output:
    item, df = ds.resolve(str(ci(options, "ITEM", default="tag:ITEM"))), ds.df
    for c in ds.resolve_all(*as_list(ci(options, "COLUMNS"))) if ci(options, "COLUMNS") else ds.find(any_of=["<NUM>"]):
        df = comparators.harmonize(df, item, c)
    return Output("HARMONIZE_COMPARATOR", ds.with_df(df))


@step("COLUMNS")
def _columns(ds: Dataset, options: dict) -> Output:
    return Output("COLUMNS", ds, {"columns": ds.column_frame()})


def register_plugin(name: str, handler: Callable[[Dataset, dict], Output | Dataset]) -> None:
    """A step of one's own: (dataset, options) -> output or dataset, all lazy."""

    def run(ds: Dataset, options: dict) -> Output:
        out = handler(ds, options)
        return out if isinstance(out, Output) else Output(name, out)

    STEPS[name.upper()] = run


def steps() -> list[str]:
    """Names of all steps, one's own included."""
    from . import analyses, plugins  # noqa: F401  (register their steps)

    return list(STEPS)


def run_step(ds: Dataset, name: str, options: dict | None = None) -> Output:
    from . import analyses, plugins  # noqa: F401  (register their steps)

    key = name.upper()
    if key not in STEPS:
        raise ValueError(f"unknown step {name!r}")
    return STEPS[key](ds, options if options is not None else ci(ds.meta, key, default={}) or {})


def run_chain(ds: Dataset, steps: list[str], run: Callable[[Dataset, str], Output]) -> tuple[Dataset, list[Output]]:
    """Steps in order; a skipped one ends the chain.  Every step is logged with its parent's digest."""
    outputs = []
    for s in steps:
        out = run(ds, s)
        outputs.append(out)
        ds = log_step(out.dataset, s, out.status)
        if out.status == "SKIPPED":
            break
    return ds, outputs


def run_actions(ds: Dataset, pipeline: str) -> tuple[Dataset, list[Output]]:
    spec = ci(ci(ds.meta, "ACTION_PIPELINES", default={}), pipeline)
    names = as_list(ci(spec, "ACTIONS") if isinstance(spec, dict) else spec)
    actions = ci(ds.meta, "ACTIONS", default={})
    return run_chain(ds, [str(n) for n in names], lambda d, n: Output(n, run_action(d, ci(actions, n))))


def run_work(ds: Dataset, work: str = "DEFAULT") -> tuple[Dataset, list[Output]]:
    """A named work list; names of other works expand one level."""
    works = ci(ds.meta, "WORKS", default={})
    steps: list[str] = []
    for s in as_list(ci(works, work)):
        sub = ci(ci(ds.meta, "SUBWORKS", default={}), s)
        steps += [str(x) for x in as_list(sub)] if sub else [str(s)]
    actions = ci(ds.meta, "ACTIONS", default={})
    return run_chain(ds, steps, lambda d, s: Output(s, run_action(d, ci(actions, s))) if ci(actions, s) else run_step(d, s))


def run_commands(ds: Dataset, pipeline: str) -> tuple[Dataset, list[Output]]:
    """Command strings such as ``sample --n 10`` or ``action NAME``."""

    def one(d: Dataset, line: str) -> Output:
        word, *rest = shlex.split(line)
        if word.lower() == "action":
            return Output(line, run_action(d, ci(ci(d.meta, "ACTIONS", default={}), rest[0])))
        if word.lower() == "run":
            out, _ = run_work(d, rest[0] if rest else "DEFAULT")
            return Output(line, out)
        opts: dict[str, Any] = {}
        while rest:
            k = rest.pop(0).lstrip("-").upper().replace("-", "_")
            opts[k] = rest.pop(0) if rest and not rest[0].startswith("--") else True
        for k in ("N", "SEED"):
            opts[k] = int(opts[k]) if k in opts else None
        return run_step(d, word, {k: v for k, v in opts.items() if v is not None})

    return run_chain(ds, [str(x) for x in as_list(ci(ci(ds.meta, "PIPELINES", default={}), pipeline))], one)


@dataclass
class Workflow:
    """Named branches: each reads INPUT or an earlier branch; results stay lazy."""

    results: dict[str, Any] = field(default_factory=dict)

    def add(self, name: str, source: str, f: Callable[[Any], Any]) -> Workflow:
        if name in self.results or source not in self.results:
            raise ValueError(f"branch {name!r} repeats, or {source!r} is unknown")
        self.results[name] = f(self.results[source])
        return self


def log_step(ds: Dataset, name: str, status: str = "OK", **detail) -> Dataset:
    parent = ds.log[-1]["digest"] if ds.log else ""
    entry = {"step": name, "status": status, "columns": list(ds.columns), "parent": parent, **detail}
    entry["digest"] = hashlib.sha256(json.dumps(entry, sort_keys=True, default=str).encode()).hexdigest()
    return replace(ds, log=(*ds.log, entry))


def verify_log(ds: Dataset) -> bool:
    """Every entry's digest fits its content and names the one before it."""
    parent = ""
    for e in ds.log:
        body = {k: v for k, v in e.items() if k != "digest"}
        if e["parent"] != parent or hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest() != e["digest"]:
            return False
        parent = e["digest"]
    return True


def reproducible(run: Callable[[], DataFrame], times: int = 2) -> bool:
    """Equal content digests of repeated runs."""
    return len({tuple(multi.content_hash(run()).first()) for _ in range(times)}) == 1


def stamp(ds: Dataset) -> Dataset:
    """The content's digest under INTEGRITY of the controls."""
    rows, digest = _content(ds)
    return replace(ds, meta={**{k: v for k, v in ds.meta.items() if k.upper() != "INTEGRITY"}, "INTEGRITY": {"ROWS": rows, "DIGEST": digest}})


def check_integrity(ds: Dataset) -> str:
    """OK, CHANGED or UNSTAMPED."""
    was = ci(ds.meta, "INTEGRITY")
    if not was:
        return "UNSTAMPED"
    return "OK" if _content(ds) == (ci(was, "ROWS"), ci(was, "DIGEST")) else "CHANGED"


def _content(ds: Dataset) -> tuple[int, str]:
    """Headers with tags, and cells as a file stores them, sexes in canonical words."""
    from ..sources.container import export_frame

    headers = hashlib.sha256("\t".join(T.build_header(c, ds.tags.get(c, ())) for c in ds.columns).encode()).hexdigest()
    row = multi.content_hash(export_frame(ds)).first()
    return row.rows, f"{headers[:16]}-{row.digest}"
