"""Command line: one thin command per operator over tagged files.  ``-`` as FILE reads a sectioned text from standard input."""

from __future__ import annotations

import argparse
import io
import json
import sys
import tomllib
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import Dataset, ci
from .operators import checks, integration, multi, starting
from .operators.actions import ACTIONS, run_action
from .plans import runner
from .session import session
from .sources import container as C
from .sources import reports, tables
from .streaming.sync import Project

#: Command -> (handler, arguments).  A handler takes the parsed arguments and the dataset of FILE, and returns what :func:`_finish` shows or writes.
COMMANDS: dict[str, tuple[Callable, list[tuple]]] = {}

OUT = ("--out", {"help": "file to write: the format follows its suffix"})


def command(name: str, *args: tuple, file: bool = True):
    def register(f):
        COMMANDS[name] = (f, [*([("file", {})] if file else []), *args])
        return f

    return register


def register_command(name: str, handler: Callable[[argparse.Namespace, Dataset], object], *args: tuple) -> None:
    """A command of one's own over a file."""
    COMMANDS[name] = (handler, [("file", {}), *args])


def show(name: str, df: DataFrame, limit: int) -> None:
    print(f"# {name}")
    for row in df.limit(limit).toJSON().collect():  # at most `limit` rows
        print(row)


def load(spark: SparkSession, path: str, sidecar: str | None = None) -> Dataset:
    if path == "-":
        stream = sys.stdin.buffer if hasattr(sys.stdin, "buffer") else io.BytesIO(sys.stdin.read().encode())
        return C.read_container(spark, C.spool(spark, stream), sidecar)
    return C.read_container(spark, path, sidecar) if sidecar else tables.read_any(spark, path)


def save(ds: Dataset, path: str) -> None:
    """Sectioned text, unless the suffix names a table format."""
    suffix = Path(path).suffix.lstrip(".").lower()
    tabular = suffix in {"csv", "tsv", "json", "jsonl", "parquet", "orc", "feather", "sql", "xlsx", *C.EXPORTERS}
    C.write_table(ds, path) if tabular else C.write_container(ds, path)


def _finish(a: argparse.Namespace, done: object) -> int:
    if isinstance(done, runner.Output):
        for k, t in done.tables.items():
            show(k, t, a.limit)
        if done.message:
            print(f"# {done.message}")
        done = done.dataset if getattr(a, "out", None) else None
    if isinstance(done, Dataset):
        save(done, a.out) if getattr(a, "out", None) else show("data", done.df, a.limit)
    elif isinstance(done, DataFrame):
        show(a.command, done, a.limit)
    elif isinstance(done, int):
        return done
    elif done is not None:
        print(done if isinstance(done, str) else json.dumps(done, ensure_ascii=False))
    return 0


def _options(pairs: list[str]) -> dict:
    """KEY=VALUE, where a value that reads as TOML is one."""
    out = {}
    for pair in pairs or []:
        key, _, value = pair.partition("=")
        try:
            out[key.upper()] = tomllib.loads(f"v = {value}")["v"]
        except tomllib.TOMLDecodeError:
            out[key.upper()] = value
    return out


OPTION = ("--option", {"action": "append", "metavar": "KEY=VALUE"})

# Looking ----------------------------------------------------------------------

command("info")(lambda a, ds: ds.column_frame())
command("columns")(lambda a, ds: ds.column_frame())
command("tags")(lambda a, ds: {c: list(ds.effective(c)) for c in ds.columns})
command("validate")(lambda a, ds: checks.issues(ds))
command("describe")(lambda a, ds: runner.run_step(ds, "DESCRIBE", {}))
command("eda", OPTION)(lambda a, ds: runner.run_step(ds, "EDA", _options(a.option)))
command("analyze", OPTION)(lambda a, ds: runner.run_step(ds, "ANALYZE", _options(a.option)))
command("infer")(lambda a, ds: {k: list(v) for k, v in tables.infer(ds.df, ds.columns).items()})
command("works")(lambda a, ds: {k: list((ds.meta.get(k) or {}).keys()) for k in ("WORKS", "ACTION_PIPELINES", "PIPELINES", "ACTIONS")})
command("actions")(lambda a, ds: {"types": sorted(ACTIONS), "named": list(ci(ds.meta, "ACTIONS", default={}))})
command("plugins", file=False)(lambda a, ds: sorted(runner.steps()))
command("presets", file=False)(lambda a, ds: {r: {"tags": t, "names": w} for r, (t, w) in starting.ROLES.items()})
command("hash")(lambda a, ds: multi.content_hash(ds.df))
command("check-excel")(lambda a, ds: checks.excel_damage(ds.df, ds.columns))
command("logs")(lambda a, ds: list(ds.log))
command("verify")(lambda a, ds: 0 if runner.verify_log(ds) else 1)
command("check-integrity")(lambda a, ds: print(word := runner.check_integrity(ds)) or int(word == "CHANGED"))


@command("check")
def _check(a, ds):
    """Contradictions in tags and controls, then whether any cell has an issue."""
    for c, why in checks.measurement_conflicts(ds):
        print(f"{c}: {why}")
    found = checks.issues(ds).groupBy("column", "tag", "message").agg(F.count("*").alias("n"))
    show("check", found, a.limit)
    return int(not found.isEmpty())


@command("review", ("--source", {}))
def _review(a, ds):
    show("columns", ds.column_frame(), a.limit)
    return starting.review(ds, a.source)


@command("evaluate", ("other", {}), ("key", {}))
def _evaluate(a, ds):
    return integration.compare_outputs(ds.df, load(ds.df.sparkSession, a.other).df, a.key)


# Changing ---------------------------------------------------------------------

command("save", ("out", {}))(lambda a, ds: ds)
command("export", ("out", {}))(lambda a, ds: ds)
command("convert", ("out", {}))(lambda a, ds: ds)
command("tags-to-meta", OUT)(lambda a, ds: starting.place_tags(ds, "meta"))
command("tags-to-header", OUT)(lambda a, ds: starting.place_tags(ds, "header"))
command("fix", ("--comparators", {"choices": ["DELETE", "VALUE"]}), OPTION, OUT)(lambda a, ds: starting.fix(ds, a.comparators, _options(a.option)))
command("normalize-datetimes", OUT)(lambda a, ds: starting.normalise_dates(ds))
command("normalize-categories", OUT)(lambda a, ds: starting.normalise_categories(ds))
command("apply-preset", OPTION, OUT)(lambda a, ds: starting.apply_preset(ds, {k.lower(): v for k, v in _options(a.option).items()}))
command("stamp", ("out", {}))(lambda a, ds: runner.stamp(ds))
command("clear-log", ("out", {}))(lambda a, ds: replace(ds, log=()))
command("split-comparator", OUT)(lambda a, ds: runner.run_step(ds, "SPLIT_COMPARATOR", {}).dataset)
command("harmonize-comparator", OPTION, OUT)(lambda a, ds: runner.run_step(ds, "HARMONIZE_COMPARATOR", _options(a.option)).dataset)
command("run-action", ("name", {}), OUT)(lambda a, ds: ds.with_df(run_action(ds, ci(ci(ds.meta, "ACTIONS", default={}), a.name)).df))
COMMANDS["action"] = COMMANDS["run-action"]


@command("anonymize", ("out", {}), ("--salt", {"default": ""}), ("--mappings", {"help": "folder for the mapping tables"}))
def _anonymize(a, ds):
    out, maps = multi.anonymize(ds, None, a.salt)
    for name, table in maps.items() if a.mappings else ():
        table.write.mode("errorifexists").option("header", True).csv(f"{a.mappings}/{name}")
    return out


@command("sample", ("--n", {"type": int}), ("--fraction", {"type": float}), ("--by", {"action": "append"}), ("--seed", {"type": int, "default": 0}), ("--replace", {"action": "store_true"}), OUT)
def _sample(a, ds):
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in ds.columns]))
    return ds.with_df(multi.sample(ds.df, key, a.n, a.fraction, ds.resolve_all(*a.by) if a.by else [], a.seed, a.replace))


@command("init", ("out", {}), ("--review", {"help": "JSON lines of what a person should decide"}))
def _init(a, ds):
    """A table becomes a starter file: tags from names and values; NAME and SEX included."""
    out = ds.with_df(ds.df, **tables.infer(ds.df, ds.columns))
    if a.review:
        starting.review(out).write.mode("errorifexists").json(a.review)
    return out


@command("extract-images", ("column", {}), ("folder", {}))
def _extract(a, ds):
    """Binary cells as a table of (kind, bytes) in a folder."""
    tables.extract_images(ds, a.column).write.mode("errorifexists").parquet(a.folder)


@command("embed-images", ("column", {}), OUT)
def _embed(a, ds):
    return ds.with_df(tables.embed_images(ds, a.column))


@command("merge", ("others", {"nargs": "+"}), ("--numbers", {"default": "strict"}), OUT)
def _merge(a, ds):
    spark = ds.df.sparkSession
    return multi.merge({Path(p).stem: d for p, d in [(a.file, ds), *[(p, load(spark, p)) for p in a.others]]}, numbers=a.numbers)


@command("integrate", ("profile", {"help": "TOML with KEYS, SOURCES (label = file) and TARGETS"}), ("out", {}), file=False)
def _integrate(a, _):
    profile = tomllib.loads(Path(a.profile).read_text(encoding="utf-8"))
    spark = session(a.master)
    sources = {k: load(spark, p) for k, p in profile["SOURCES"].items()}
    targets = [integration.Target(n, t["UNIT"], {k: {x.lower(): y for x, y in v.items()} for k, v in t["SOURCES"].items()}) for n, t in profile["TARGETS"].items()]
    return Dataset(integration.integrate(sources, targets, profile["KEYS"]))


@command("split-file", ("out", {"help": "stem of the two files"}))
def _split(a, ds):
    C.write_controls(ds, a.out + ".meta.txt"), C.write_data(ds, a.out + ".data.txt")


@command("attach-meta", ("controls", {}), ("out", {}))
def _attach(a, _):
    return load(session(a.master), a.file, a.controls)


@command("import-xlsx", ("table", {}), ("out", {}))
def _import(a, ds):
    return C.import_rows(ds, load(ds.df.sparkSession, a.table))


@command("sync", ("folder", {}), ("--key", {"action": "append", "default": []}), ("--work", {}), ("--result-key", {"action": "append", "default": []}), ("--accept", {"action": "store_true"}), ("--dry-run", {"action": "store_true"}))
def _sync(a, ds):
    """Bring a project folder up to date with FILE; 1 if it was blocked."""
    work = (lambda df: runner.run_work(ds.with_df(df), a.work)[0].df) if a.work else None
    report = Project(ds.df.sparkSession, a.folder, a.key, work, a.result_key).sync(ds.df, a.accept, a.dry_run)
    print(json.dumps({"sequence": report.sequence, "counts": report.counts, "blocked": report.blocked}))
    show("changes", report.changes, a.limit)
    return int(bool(report.blocked))


# Chains -----------------------------------------------------------------------


def _chain(run: Callable[[Dataset, str], tuple[Dataset, list]]):
    def handler(a, ds):
        out, steps = run(ds, a.name)
        for s in steps:
            for k, t in s.tables.items():
                show(f"{s.name}/{k}", t, a.limit)
        if getattr(a, "report", None):
            reports.write_report({f"{s.name}-{k}": t for s in steps for k, t in s.tables.items()}, a.report, a.name, [s.message for s in steps if s.message])
        return out

    return handler


REPORT = ("--report", {"help": "new folder for the tables as CSV, page and document"})
command("run", ("name", {"nargs": "?", "default": "DEFAULT"}), OUT, REPORT)(_chain(runner.run_work))
for _name in ("pipeline", "run-action-pipeline"):
    command(_name, ("name", {}), OUT, REPORT)(_chain(runner.run_actions))
for _name in ("commands", "run-pipeline"):
    command(_name, ("name", {}), OUT, REPORT)(_chain(runner.run_commands))
command("run-plugin", ("name", {}), OPTION, OUT)(lambda a, ds: runner.run_step(ds, a.name, _options(a.option) or None))
for _name, _key in (("action-pipelines", "ACTION_PIPELINES"), ("pipelines", "PIPELINES")):
    command(_name)(lambda a, ds, key=_key: {k: v for k, v in (ci(ds.meta, key, default={}) or {}).items()})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellwright", description=__doc__)
    p.add_argument("--master")
    p.add_argument("--limit", type=int, default=500)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (handler, args) in COMMANDS.items():
        s = sub.add_parser(name, description=handler.__doc__)
        for flag, how in args:
            s.add_argument(flag, **how)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    handler, args = COMMANDS[a.command]
    spark = session(a.master)
    ds = load(spark, a.file) if any(flag == "file" for flag, _ in args) and a.command != "attach-meta" else None
    return _finish(a, handler(a, ds))


if __name__ == "__main__":
    raise SystemExit(main())
