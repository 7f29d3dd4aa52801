"""Bounded all-against-all work: groups are cut into blocks, and pairs of blocks are tasks' units."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker


def with_tiles(df: DataFrame, size: Column, key: Column, block_rows: int) -> DataFrame:
    """Add ``bi``, ``bj``, ``own``: a row of block b goes to all tiles (min(b, j), max(b, j)).

    ``size`` is the number of rows of the row's group; blocks hold about ``block_rows`` rows by the hash of ``key``, so
    that a unit of work is bounded whatever the group's size.
    """
    blocks = F.greatest(F.ceil(size / F.lit(block_rows)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    return df.withColumn("_n", blocks).withColumn("own", own).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("bi", F.least("own", "_j")).withColumn("bj", F.greatest("own", "_j")).drop("_n", "_j")


def by_tile(df: DataFrame, keys: list[str], n: int, work: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Run ``work`` on the rows of each combination of ``keys``; only one unit's rows are held at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget()
        held: list[dict] = []
        at, out = None, []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        types = [{"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]
        rows = (row for batch in batches for a in range(0, batch.num_rows, 256) for row in batch.slice(a, 256).to_pylist())
        for row in rows:
            unit = tuple(row[k] for k in keys)
            if unit != at and held:
                out += work(held)
                held = []
                if len(out) > 10_000:
                    yield emit()
                    out.clear()
            at = unit
            held.append(row)
        if held:
            out += work(held)
        yield emit()

    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Smallest index of each index's component under the links left[k] - right[k]."""
    up = np.arange(n)
    while len(left):
        low = np.minimum(up[left], up[right])
        np.minimum.at(up, up[left], low)
        np.minimum.at(up, up[right], low)
        while (up[up] != up).any():
            up = up[up]
        apart = up[left] != up[right]
        left, right = left[apart], right[apart]
    return up.tolist()
