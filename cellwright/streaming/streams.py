"""Streams: windows with watermarks, stateful control rules, and synchronised snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.multirule import ADDED, Chart, Plan, judge, plan_of


def events_stream(spark: SparkSession, folder: str, schema: StructType, time: str = "ts", watermark: str = "10 minutes", glob: str | None = None) -> DataFrame:
    """A growing folder as a stream; NTZ times become instants, which watermarks need."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    df = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def windowed(stream: DataFrame, keys: list[str], value: str, time: str = "ts", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts and sums; in append mode only closed windows come out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes") -> DataFrame:
    return stream.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated events within the watermark are dropped; state is bounded by it."""
    return stream.dropDuplicatesWithinWatermark(keys)


def stateful_multirule(points: DataFrame, group: str, plan: Plan | None = None) -> DataFrame:
    """Control decisions over a stream of complete runs (group, run, order, material, z), in order.

    A decision depends on its own and earlier runs only, and equals that of one batch over all runs: the state is what the rules
    themselves remember of a group, its size is set by the longest rule.  A run that comes after one with a larger (order, run) was judged
    changes nothing; its points are OUT_OF_ORDER.
    """
    plan = plan or plan_of()
    out = f"{group} string, run bigint, material string, z double, " + ", ".join(f"{c} string" for c in ADDED)
    held = "tails map<string,array<double>>, runs array<struct<materials:array<string>,z:array<double>>>, ord bigint, run bigint"

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tails, runs, *last = state.get if state.exists else ({}, [], None, None)
        chart = Chart(plan, tails, [tuple(r) for r in runs])
        new = pd.concat([b[["run", "order", "material", "z"]] for b in batches], ignore_index=True)
        new["order"] = new.groupby("run")["order"].transform("min")
        late = [last[0] is not None and (o, r) <= tuple(last) for o, r in zip(new["order"], new["run"], strict=True)]
        fresh, late = new[~np.asarray(late, dtype=bool)], new[np.asarray(late, dtype=bool)]
        if len(fresh):
            last = max(zip(fresh["order"].tolist(), fresh["run"].tolist(), strict=True))
        # Runs of one order follow each other by number, as (order, run) does.
        order = sorted({(int(o), int(r)) for o, r in zip(fresh["order"], fresh["run"], strict=True)})
        at = {k: i for i, k in enumerate(order)}
        judged = judge(fresh.assign(order=[at[(int(o), int(r))] for o, r in zip(fresh["order"], fresh["run"], strict=True)]), chart=chart)
        both = pd.concat([judged, late.assign(**dict.fromkeys(ADDED, "OUT_OF_ORDER"))], ignore_index=True)
        state.update(({m: [float(v) for v in t] for m, t in chart.tails.items()}, [(sorted(m), [float(v) for v in z]) for m, z in chart.runs], *(None if v is None else int(v) for v in last)))
        yield pd.DataFrame({group: str(key[0]), "run": both["run"].astype("int64"), "material": both["material"], "z": both["z"], **{c: both[c] for c in ADDED}})

    return points.groupBy(F.col(group).cast("string").alias(group)).applyInPandasWithState(update, out, held, "append", GroupStateTimeout.NoTimeout)


def sync_writer(target: str, quarantine: str, keys: list[str]):
    """For ``foreachBatch``: new keys are appended, equal rows ignored, changed ones set aside for review.

    A new key with differing rows in one batch is set aside with all of them, as none can be told to be the right one.
    Removed keys are not noticed, as batches are additions: ``sync.Project`` compares whole sources.
    Batches carry their number into the folder, so that a batch that is run again overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cols = batch.columns
        rest = [c for c in cols if c not in keys]
        batch = batch.distinct().withColumn("_rows", F.count("*").over(Window.partitionBy(*keys)))
        # A folder that is there is read, whatever it takes: only where there is none yet is nothing known.
        seen = spark.read.parquet(target).where(F.col("batch") < number).drop("batch") if exists(spark, target) else batch.select(*cols).limit(0)
        old = seen.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*rest).alias("_old"))
        j = batch.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        j.where("_old is null and _rows = 1").select(*cols).write.mode("overwrite").parquet(f"{target}/batch={number}")
        j.where((F.col("_old").isNull() & (F.col("_rows") > 1)) | (F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.struct(*rest)))).select(*cols).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return write


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def run_once(stream: DataFrame, sink: Any, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, then stop.  ``sink``: a memory table's name or a function for batches."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.format("memory").queryName(sink) if isinstance(sink, str) else w.foreachBatch(sink)).start()
    q.awaitTermination()
