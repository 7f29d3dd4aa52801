"""A project that follows a growing source: compare, block or accept, run its work again, annotate, commit.

A project is a folder.  Every sync reads its source once, into a table of its own, and compares, runs and commits that table: rows that come
while it works wait for the next one.  It then names its tables in one small file that is put in place by a rename, so that a reader or a
sync that was cut off sees the state before it or after it.

With keys, tables are written by buckets of the keys' hash and carry a digest a bucket.  Only buckets whose digest moved are read again, on
both sides.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import ROW
from ..operators.multi import annotate_results, positional_diff, snapshot_diff
from .streams import exists

#: Column of the bucket, and how many there are.
BUCKET, BUCKETS = "__bucket", 32


@dataclass
class Report:
    """``changes`` and ``result`` are lazy tables; ``blocked`` says why nothing was written."""

    sequence: int
    counts: dict[str, int]
    changes: DataFrame
    blocked: str = ""
    result: DataFrame | None = None


@dataclass
class Project:
    """``keys``: columns that name a row; without keys the source is append-only and rows are matched by place (``__row_id``).

    ``work`` makes the result of the whole source, ``result_keys`` name its rows.
    """

    spark: SparkSession
    folder: str
    keys: list[str] = field(default_factory=list)
    work: Callable[[DataFrame], DataFrame] | None = None
    result_keys: list[str] = field(default_factory=list)
    buckets: int = BUCKETS

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), lambda p: self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)

    def records(self) -> list[dict]:
        """All syncs that were committed, oldest first, each with the digest of the one before."""
        if not exists(self.spark, f"{self.folder}/state.json"):
            return []
        return json.loads("".join(r.value for r in self.spark.read.option("wholetext", True).text(f"{self.folder}/state.json").collect()))

    def verify(self) -> list[int]:
        """Numbers of records that were changed, or don't follow the one before."""
        wrong, parent = [], ""
        for r in self.records():
            if r["parent"] != parent or r["digest"] != _digest({k: v for k, v in r.items() if k != "digest"}):
                wrong.append(r["sequence"])
            parent = r["digest"]
        return wrong

    def snapshot(self) -> DataFrame | None:
        past = self.records()
        return self.spark.read.parquet(f"{self.folder}/data/{_place(past[-1])}").drop(BUCKET) if past else None

    def result(self) -> DataFrame | None:
        past = self.records()
        return self.spark.read.parquet(f"{self.folder}/result/{_place(past[-1])}") if past and self.work else None

    def _stage(self, source: DataFrame, place: str) -> DataFrame:
        """The source as read once, by buckets of its keys."""
        if self.keys:
            bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
            source.withColumn(BUCKET, bucket).repartition(self.buckets, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/data/{place}")
        else:
            source.write.mode("overwrite").parquet(f"{self.folder}/data/{place}")
        return self.spark.read.parquet(f"{self.folder}/data/{place}")

    def _digests(self, staged: DataFrame, cells: list[str]) -> dict[str, list]:
        """By bucket: rows, rows with a missing key, and two sums of row hashes under different seeds, which change together by chance only."""
        row = [F.col(f"`{c}`") for c in cells]
        missing = F.sum(F.expr(" or ".join(f"`{k}` is null" for k in self.keys)).cast("bigint"))
        sums = [F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
        got = staged.groupBy(BUCKET).agg(F.count("*").alias("n"), missing.alias("missing"), *[x.alias(f"h{i}") for i, x in enumerate(sums)]).collect()  # a row a bucket
        return {str(r[BUCKET]): [r.n, r.missing, r.h0, r.h1] for r in got}

    def sync(self, source: DataFrame, accept: bool = False, dry_run: bool = False, now: str | None = None) -> Report:
        """Added rows are taken over; modified, removed or repeated ones block unless ``accept`` (repeated keys always do)."""
        past = self.records()
        number = past[-1]["sequence"] + 1 if past else 1
        place = f"{number}-{uuid.uuid4().hex[:8]}"
        cells = [c for c in source.columns if c != ROW]
        staged = self._stage(source, place)
        before = self.spark.read.parquet(f"{self.folder}/data/{_place(past[-1])}") if past else None
        missing, digests = False, None
        if self.keys:
            digests = {"columns": cells, "types": [t for c, t in source.dtypes if c != ROW], "buckets": self.buckets, "sums": self._digests(staged, cells)}
            missing = any(m for _, m, _, _ in digests["sums"].values())
            changes = self._changes(before, staged, cells, past[-1].get("digests") if past else None, digests)
        else:
            changes = positional_diff(source.limit(0) if before is None else before, staged, ROW, cells)
        counts = {r.change: r.n for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}  # four rows at most
        why = "keys repeat" if counts.get("repeated") else "keys are missing" if missing else ""
        if not why and not accept and (counts.get("modified") or counts.get("removed")):
            why = "rows were modified or removed: accept the changes to go on"
        report = Report(number, counts, changes, why)
        if why or dry_run or not counts and past:
            return report
        stamp = now or datetime.now(timezone.utc).isoformat(timespec="seconds")
        if self.work:
            made = self.work(staged.drop(BUCKET))
            annotate_results(self.result(), made, self.result_keys, None, number, stamp).write.mode("overwrite").parquet(f"{self.folder}/result/{place}")
            report.result = self.spark.read.parquet(f"{self.folder}/result/{place}")
        # Only the last record carries digests of its buckets.
        record = {"sequence": number, "place": place, "at": stamp, "counts": counts, "accepted": bool(accept), "keys": self.keys}
        self._commit([*past, record | ({"digests": digests} if digests else {})])
        # The tables of this sync are the source of its report from now on; those of syncs before the last one, and of syncs that were stopped, go.
        self._sweep({place, *[_place(r) for r in past[-1:]]})
        return report

    def _changes(self, before: DataFrame | None, staged: DataFrame, cells: list[str], old: dict | None, new: dict) -> DataFrame:
        """Changes by key, from the buckets whose digest moved."""
        if before is None:
            return snapshot_diff(staged.limit(0).select(*cells), staged.select(*cells), self.keys)
        comparable = old is not None and all(old[k] == new[k] for k in ("columns", "types", "buckets"))
        if comparable:
            moved = [int(b) for b in {*old["sums"], *new["sums"]} if old["sums"].get(b) != new["sums"].get(b)]
            before, staged = (d.where(F.col(BUCKET).isin(moved) if moved else F.lit(False)) for d in (before, staged))
        return snapshot_diff(before.select(*cells), staged.select(*cells), self.keys)

    def _sweep(self, kept: set[str]) -> None:
        fs, path = self._fs()
        for kind in ("data", "result"):
            if fs.exists(path(f"{self.folder}/{kind}")):
                for found in fs.listStatus(path(f"{self.folder}/{kind}")):
                    if found.getPath().getName() not in kept:
                        fs.delete(found.getPath(), True)

    def _commit(self, records: list[dict]) -> None:
        last = records[-1]
        last["parent"] = records[-2]["digest"] if len(records) > 1 else ""
        last["digest"] = _digest(last)
        fs, path = self._fs()
        out = fs.create(path(f"{self.folder}/state.tmp"), True)
        out.write(bytearray(json.dumps(records).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = rename
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri()).rename(path(f"{self.folder}/state.tmp"), path(f"{self.folder}/state.json"), option)


def _place(record: dict) -> str:
    """Folder of a record's tables."""
    return record.get("place", str(record["sequence"]))


def _digest(record: dict) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()
