"""PCA whitening of vectors by polarisation covariance, in whole numbers until the eigenvectors.

1. Entries become whole numbers.  A first pass counts the vectors and sums every dimension.
2. With n and the sums S known, a vector's centred form is n*x - S, still whole.  A second pass sums its squares for every
   dimension and for the sum of every pair of dimensions, exactly.
3. Var(a + b) - Var(a) - Var(b) is twice the covariance of a and b: differences of the sums give all of it, each divided once.
4. The matrix goes through ``eigh`` on the driver; its size is the square of a vector's length and is checked, whatever the rows.
5. Vectors are projected where they lie.  The covariance of what comes out is summed again and held against the identity.

Vectors of different lengths are fitted apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import worker
from .names import column

#: Steps of a unit, offset, components at most, largest vector length and sum of squared lengths, rows summed at once, bits of a limb.
STEPS, OFFSET, COMPONENTS, MAX_LENGTH, MAX_CELLS, ROWS, LIMB = 64, 1_000_000, 32, 2048, 1 << 24, 8192, 24


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors of a batch, a length at a time."""
    vectors = batch.column("vector")
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            c = pc.list_flatten(vectors.take(pa.array(part))).to_numpy(zero_copy_only=False).reshape(len(part), int(d))
            yield part, np.clip(np.floor(STEPS * c), -(2.0**62), 2.0**62).astype(np.int64) + OFFSET


def _total(x: np.ndarray) -> np.ndarray:
    """Exact sums of columns."""
    if not x.size or int(np.abs(x).max()) < 1 << 48:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def _sum_squares(z: np.ndarray, axis: int = 0) -> np.ndarray:
    """Exact sums of squares, at most ROWS long, from products of limbs that fit 64 bits."""
    if z.dtype == object:
        return (z * z).sum(axis=axis)
    z = np.abs(z)
    limbs = [(z >> at) & ((1 << LIMB) - 1) for at in range(0, max(1, int(z.max(initial=0)).bit_length()), LIMB)]
    out = 0
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out = out + ((a * b).sum(axis=axis).astype(object) << (LIMB * (i + j)))
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, in 64 bits if twice its size fits them, else in Python's whole numbers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    return n * x - np.array(sums, dtype=np.int64) if most < 1 << 61 else n * x.astype(object) - np.array(sums, dtype=object)


_SUMS = "size int, i int, j int, rows bigint, high decimal(38,0), low decimal(38,0)"


def _rows(found: dict[tuple[int, int, int], list[int]]) -> pa.RecordBatch:
    """Sums as multiples of 2^64 and a rest, so that 38 digits hold them."""
    keys, values = list(found), list(found.values())
    wide = pa.decimal128(38, 0)
    cols = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
    return pa.record_batch([*cols, pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] >> 64 for v in values], wide), pa.array([v[1] & (1 << 64) - 1 for v in values], wide)], names=[f.split()[0] for f in _SUMS.split(", ")])


def _add(found: dict, key: tuple[int, int, int], rows: int, value: int) -> None:
    held = found.setdefault(key, [0, 0])
    held[0] += rows
    held[1] += int(value)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each length; dimension -1 carries the rows, also of vectors without entries."""
    worker.forget()
    found: dict = {}
    for batch in batches:
        for part, x in _by_length(batch):
            _add(found, (x.shape[1], -1, -1), len(part), 0)
            for i, s in enumerate(_total(x)):
                _add(found, (x.shape[1], i, i), 0, s)
    yield _rows(found)


def _second(fits: dict[int, tuple[int, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of squares of each dimension (i, i) and of the sum of each two (i, j)."""
        worker.forget()
        found: dict = {}
        for batch in batches:
            for _, x in _by_length(batch):
                d = x.shape[1]
                y = _centred(x, *fits[d])
                for i, q in enumerate(_sum_squares(y)):
                    _add(found, (d, i, i), 0, q)
                for i in range(d - 1):
                    for j, q in enumerate(_sum_squares(y[:, i : i + 1] + y[:, i + 1 :]), i + 1):
                        _add(found, (d, i, j), 0, q)
        yield _rows(found)

    return run


def _summed(df: DataFrame) -> list:
    """Totals over all tasks: as many rows as there are cells, whatever the number of vectors."""
    return df.groupBy("size", "i", "j").agg(F.sum("rows").alias("rows"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()


def _whole(row) -> int:
    return (int(row["high"]) << 64) + int(row["low"])


class Model:
    """One length: n, sums, unit components by falling variance (columns), their variances, shares of the whole variance."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int]):
        d = len(sums)
        self.n, self.sums = n, sums
        v = np.zeros((d, d))
        for (i, j), q in squares.items():
            v[i, j] = v[j, i] = q / n**3 if i == j else (q - squares[i, i] - squares[j, j]) / (2 * n**3)
        values, vectors = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
        k = min(COMPONENTS, d)
        self.variances, self.components = values[::-1][:k], vectors[:, ::-1][:, :k]
        trace = sum(squares[i, i] for i in range(d)) / n**3
        self.flat = self.variances <= d * np.finfo(float).eps * (values[-1] if d else 0.0)
        self.explained = [None if not trace else max(0.0, float(e)) / trace for e in self.variances]

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Exact deviations (null beyond 64 bits) and whitened rows; flat components are NaN."""
        y = _centred(x, self.n, self.sums)
        deviation = [int(s) if s < 1 << 63 else None for s in np.atleast_1d(_sum_squares(y, axis=1))] if y.shape[1] else [0] * len(y)
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = (y / self.n).astype(np.float64) @ (self.components / np.sqrt(np.where(self.flat, np.nan, self.variances)))
        return deviation, scaled


def _projected(models: dict[int, Model], out: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget()
        for batch in batches:
            for part, x in _by_length(batch):
                m = models[x.shape[1]]
                deviation, scaled = m.apply(x)
                listed = [[None if f else v for f, v in zip(m.flat, row, strict=True)] for row in scaled.tolist()]
                cols = [batch.column("vec_id").take(pa.array(part)), pa.array([m.n] * len(part), pa.int64()), pa.array(deviation, pa.int64()), pa.array(listed, pa.list_(pa.float64())), pa.array([m.explained] * len(part), pa.list_(pa.float64()))]
                yield pa.record_batch(cols, names=out.names)

    return run


def _products(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums and sums of products of whitened components."""
        worker.forget()
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                m = models[x.shape[1]]
                w = m.apply(x)[1][:, ~m.flat]
                w = np.column_stack([np.ones(len(w)), w])
                found[x.shape[1]] = found.get(x.shape[1], 0) + w.T @ w
        cells = [(d, i, j, float(v)) for d, s in found.items() for (i, j), v in np.ndenumerate(s)]
        yield pa.record_batch([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["size", "i", "j", "v"])

    return run


def _identity_error(rows: DataFrame, models: dict[int, Model]) -> float:
    sums = rows.mapInArrow(_products(models), "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect()
    worst = 0.0
    for d, m in models.items():
        k = int((~m.flat).sum())
        s = np.zeros((k + 1, k + 1))
        for r in sums:
            if r["size"] == d:
                s[r["i"], r["j"]] = r["v"]
        if k:
            mean = s[0, 1:] / m.n
            worst = max(worst, float(np.abs(s[1:, 1:] / m.n - np.outer(mean, mean) - np.eye(k)).max()))
    return worst


def fit(vectors: DataFrame, vector: str = "embedding") -> dict[int, Model]:
    """A model for each length of the vectors that remain (see ``whiten``)."""
    rows = _remaining(vectors, None, vector)
    sums = _summed(rows.mapInArrow(_first, _SUMS))
    lengths = sorted({r["size"] for r in sums})
    if lengths and (lengths[-1] > MAX_LENGTH or sum(d * d for d in lengths) > MAX_CELLS):
        raise ValueError(f"vectors of {lengths[-1]} entries, {len(lengths)} lengths: the covariance has more than {MAX_LENGTH} rows or {MAX_CELLS} cells")
    fits: dict[int, tuple[int, list[int]]] = {}
    for d in lengths:
        own = {r["i"]: r for r in sums if r["size"] == d}
        fits[d] = (own[-1]["rows"], [_whole(own[i]) for i in range(d)])
    squares: dict[int, dict] = {d: {} for d in lengths}
    for r in _summed(rows.mapInArrow(_second(fits), _SUMS)):
        squares[r["size"]][r["i"], r["j"]] = _whole(r)
    return {d: Model(*fits[d], squares[d]) for d in lengths}


def _remaining(vectors: DataFrame, vec_id: str | None, vector: str) -> DataFrame:
    v = column(vector).cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(*([column(vec_id).alias("vec_id")] if vec_id else []), v.alias("vector")).where(F.col("vector").isNotNull() & ~bad)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened and explained (arrays over up to 32 components), identity_error; one row per remaining row.

    Rows drop out whose vector is null or holds a null or non-finite entry.  Ids are carried, of any type, null and
    repeated ones too; other columns are not read, under any names.  Entries c become floor(64*c) + 1000000, clipped to
    63 bits.  Repeated vectors count as often as they occur.  A vector without entries has empty arrays.  A component without variance
    (all vectors equal, a single vector, fewer vectors than entries) has a null ``whitened`` and stays out of ``identity_error``,
    which is 0 if no component is left.  ``explained`` is null if nothing varies, ``deviation`` if it is beyond 63 bits.
    Equal variances leave their components' directions open; all rows use the same ones.  An empty table gives an empty result.
    """
    models = fit(vectors, vector)
    rows = _remaining(vectors, vec_id, vector)
    error = _identity_error(rows, models)
    doubles = ArrayType(DoubleType())
    out = StructType([StructField("vec_id", vectors.schema[vec_id].dataType), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", doubles), StructField("explained", doubles)])
    return rows.mapInArrow(_projected(models, out), out).withColumn("identity_error", F.lit(error))
