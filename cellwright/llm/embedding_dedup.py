"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are turned so that leading dimensions carry most variance.  Each label's vectors are cut into strata along the first
dimension and strata into blocks; a tile compares two blocks of one label, unless their strata lie too far apart for any pair of them:
unit vectors of a cosine ``c`` are sqrt(2 - 2c) apart at most, in every dimension.  In a tile
leading dimensions are accumulated first, the rest of each product is bounded by the product of the
suffixes' norms (Cauchy-Schwarz), and a pair is given up once its cosine cannot reach the threshold.  Pairs
that survive get their exact cosine, in double precision, from the vectors as given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .components import connected_components
from .names import column
from .storage import Scratch, partitions
from .tiles import by_tile, forest

#: Least cosine, vectors in a block, numbers in a block (long vectors get smaller blocks), dimensions after which pairs are given up.
THRESHOLD, BLOCK_ROWS, BLOCK_CELLS, STOPS = 0.93, 4096, 1 << 20, (4, 8, 16, 32)
#: Most strata of a label, pairs of a tile compared at once, slack of the bounds against rounding.
STRATA, PAIRS, SLACK = 64, 1 << 22, 1e-9


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of outer products of a task's unit vectors, by dimension."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, at, x in _by_dimension(batch.column("vector")):
            n = batch.column("n").to_numpy()[at].astype(np.float64)
            if d not in sums:
                sums[d] = np.zeros((d, d))
            sums[d] += (x * n[:, None]).T @ x
    for d, m in sums.items():
        yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["d", "i", "row"])


def _by_dimension(vectors: pa.Array, rows: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, unit vectors) of packed vectors, a slice at a time."""
    for a in range(0, len(vectors), rows):
        raws = vectors.slice(a, rows).to_pylist()
        sizes = np.asarray([len(r) // 8 for r in raws])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = np.frombuffer(b"".join([raws[k] for k in at]), dtype="<f8").reshape(len(at), d)
            yield int(d), a + at, x / np.linalg.norm(x, axis=1)[:, None]


def _scaled(v: list | None) -> np.ndarray | None:
    """Doubles divided by a power of two, so that no square overflows or vanishes; None for an unusable vector."""
    x = np.asarray([np.nan if c is None else c for c in v], dtype="<f8") if v else np.zeros(0)
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    return np.ldexp(x, -np.frexp(np.abs(x).max())[1]) + 0.0  # one zero


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubles and digest of each usable vector; unusable ones become null."""
    for batch in batches:
        raws = [None if x is None else x.tobytes() for x in map(_scaled, batch.column("embedding").to_pylist())]
        keys = [hashlib.blake2b(raw, digest_size=16).digest() if raw else None for raw in raws]
        yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["vec_id", "label", "key", "vector"])


def near_vectors(vectors: DataFrame, scratch: Scratch, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, strata: int = STRATA) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link if their labels (of any type that can be grouped by) are equal and not null, their dimensions agree and their cosine is at least
    ``threshold``.  Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    their own component; finite ones of any size are compared, as powers of two are divided out first.  Vectors equal but for a power of two are compared once and counted as often as they occur.  component_id is
    the smallest vec_id reachable by links; a null vec_id is reachable but never smallest unless alone.  Rows with one vec_id share a component only if
    linked; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(column(vec_id).cast("bigint").alias("vec_id"), column(label).alias("label"), column(embedding).cast("array<double>").alias("embedding"))
    schema = StructType([StructField("vec_id", LongType()), StructField("label", rows.schema["label"].dataType), StructField("key", BinaryType()), StructField("vector", BinaryType())])
    coded = scratch.put(rows.mapInArrow(_classes, schema), "coded")
    # A class is a label and a vector; its id is its smallest row's.  A null vec_id sorts last.
    classes = coded.where("key is not null and label is not null").groupBy("label", "key").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("vector").alias("vector"))
    classes = scratch.put(classes.withColumn("cls", F.concat(F.col("key"), F.encode(F.col("label").cast("string"), "UTF-8"))), "classes")
    held = spark.sparkContext.broadcast(_turn(classes))
    tiled = _tiles(classes, held, scratch, threshold, block_rows, strata)

    def compare(unit: list[dict]) -> list[tuple]:
        return _compare(unit, held.value, threshold)

    found = scratch.put(by_tile(tiled, ["label", "bi", "bj"], 4 * partitions(spark), compare, "cls binary, links bigint, parent binary"), "found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    grouped = connected_components(found.where("parent is not null").select(F.col("cls").alias("a"), F.col("parent").alias("b")), scratch).withColumnRenamed("node", "cls")
    named = classes.select("label", "key", "cls", "n", "first").join(links, "cls", "left").join(grouped, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # Both are written, so that the join has two plain exchanges, whose large partitions adaptive execution can split.
    named = scratch.put(named, "named")
    least = scratch.put(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    of = scratch.put(named.join(least, "component").select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "of")
    scratch.drop(classes, found, named, least)
    out = coded.select("vec_id", "label", "key").join(of, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _tiles(classes: DataFrame, turn: Broadcast, scratch: Scratch, threshold: float, block_rows: int, strata: int) -> DataFrame:
    """label, bi, bj, own, cls, n, vector: every row of a block goes to all tiles of its block that can hold a link.

    Strata are at most ``strata`` for each label and dimension; their bounds may be approximate, what lies in a stratum is counted exactly.
    """

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, dim = np.empty(batch.num_rows), np.empty(batch.num_rows, dtype=np.int32)
            for d, at, x in _by_dimension(batch.column("vector")):
                lead[at], dim[at] = x @ turn.value[d][:, 0], d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(lead)], names=[*batch.schema.names, "dim", "lead"])

    chosen = classes.select("label", "cls", "n", "vector")
    ordered = scratch.put(chosen.mapInArrow(leading, StructType([*chosen.schema.fields, StructField("dim", IntegerType()), StructField("lead", DoubleType())])), "ordered")
    full = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_CELLS) / F.col("dim")))).cast("int")
    cuts = [k / strata for k in range(1, strata)]
    bounds = ordered.groupBy("label", "dim").agg(F.count("*").alias("size"), F.percentile_approx("lead", cuts, 1000).alias("cuts"))
    # As many strata as blocks: every q-th bound, and none where one block does.
    q = F.ceil(F.lit(strata) / F.ceil(F.col("size") / full)).cast("int")
    # Written, so that their size is known when the join is planned: no shuffle by label where they can be broadcast.
    bounds = scratch.put(bounds.select("label", "dim", F.filter("cuts", lambda c, i: (i + 1) % q == 0).alias("cuts")), "bounds")
    cut = scratch.put(ordered.join(bounds, ["label", "dim"]).withColumn("stratum", F.size(F.filter("cuts", lambda c: c <= F.col("lead")))).drop("cuts"), "cut")
    # A quarter more than a full block is let be, so that strata near to one block are not cut in two.
    counted = cut.groupBy("label", "dim", "stratum").agg(F.ceil(F.count("*") / (full * 1.25)).cast("int").alias("blocks"), F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    lists = counted.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("stratum", "blocks", "lo", "hi"))).alias("strata"))
    # The first block of each stratum; a row's block by the hash of its class.
    first = F.aggregate("strata", F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x["blocks"])))
    lists = scratch.put(lists.withColumn("ends", first), "strata")
    joined = cut.join(lists, ["label", "dim"])
    mine = F.filter("strata", lambda x: x["stratum"] == F.col("stratum"))[0]
    reach = F.sqrt(F.lit(2 - 2 * threshold)) + SLACK
    near = F.filter(F.transform("strata", lambda x, i: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), (F.get("ends", i) - x["blocks"]).alias("a"), F.get("ends", i).alias("b"))), lambda x: (x["lo"] - F.col("mine.hi") <= reach) & (F.col("mine.lo") - x["hi"] <= reach))
    others = F.flatten(F.transform("near", lambda x: F.sequence(x["a"], x["b"] - 1)))
    at = F.aggregate(F.filter("strata", lambda x: x["stratum"] < F.col("stratum")), F.lit(0), lambda acc, x: acc + x["blocks"])
    rows = joined.withColumn("mine", mine).withColumn("near", near).withColumn("own", at + F.pmod(F.xxhash64("cls"), F.col("mine.blocks")).cast("int"))
    spread = rows.select("label", "dim", "cls", "n", "vector", "own", F.explode(others).alias("other"))
    return spread.select("label", F.concat_ws(":", "dim", F.least("own", "other")).alias("bi"), F.concat_ws(":", "dim", F.greatest("own", "other")).alias("bj"), F.concat_ws(":", "dim", "own").alias("own"), "cls", "n", "vector")


def _turn(classes: DataFrame) -> dict[int, np.ndarray]:
    """Dimension -> rotation.  d^2 sums for each dimension reach the driver, whatever the rows."""
    parts = classes.select("vector", "n").mapInArrow(_moments, "d int, i int, row array<double>")
    cells = parts.select("d", "i", F.posexplode("row").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    lists = cells.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "j", "v"))).alias("m")).select("d", F.transform("m", lambda x: x["v"]).alias("m")).collect()
    return {r.d: np.linalg.eigh(np.asarray(r.m).reshape(r.d, r.d))[1][:, ::-1].copy() for r in lists}


def _compare(unit: list[dict], turns: dict[int, np.ndarray], threshold: float) -> list[tuple]:
    rows = sorted(unit, key=lambda r: r["cls"])
    d = len(rows[0]["vector"]) // 8
    same = rows[0]["bi"] == rows[0]["bj"]
    x = np.frombuffer(b"".join(r["vector"] for r in rows), dtype="<f8").reshape(len(rows), d)
    own = np.asarray([r["own"] for r in rows])
    a = np.flatnonzero(own == rows[0]["bi"])
    b = a if same else np.flatnonzero(own == rows[0]["bj"])
    i, j = near_pairs(x, turns[d], a, b, threshold)
    if not len(i):
        return []
    n = np.asarray([r["n"] for r in rows])
    counts = np.bincount(i, weights=n[j], minlength=len(rows)) + np.bincount(j, weights=n[i], minlength=len(rows))
    up = forest(len(rows), i, j)
    return [(r["cls"], int(c), rows[u]["cls"] if u != k else None) for k, (r, c, u) in enumerate(zip(rows, counts, up, strict=True)) if c]


def near_pairs(x: np.ndarray, turn: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (from a, from b) with cosine >= threshold; if a and b are the same, each pair once, smaller index first."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    y = (x / norms[:, None]) @ turn
    tails = np.sqrt(np.maximum(0, np.cumsum(y[:, ::-1] ** 2, axis=1)[:, ::-1]))
    found = []
    step = max(1, PAIRS // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = _promising(y, tails, a[at : at + step], b[at:] if a is b else b, threshold)
        if a is b:
            i, j = i[i < j], j[i < j]
        exact = np.empty(len(i))
        for lo in range(0, len(i), 200_000):
            s = slice(lo, lo + 200_000)
            exact[s] = np.einsum("ij,ij->i", x[i[s]], x[j[s]]) / (norms[i[s]] * norms[j[s]])
        ok = exact >= threshold
        found.append((i[ok], j[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _promising(y: np.ndarray, tails: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose leading products and suffix norms allow the threshold, after each stop and at the end."""
    d = y.shape[1]
    stops = [s for s in STOPS if s < d] + [d]
    first = stops[0]
    part = y[a, :first] @ y[b, :first].T
    bound = part + tails[a, first][:, None] * tails[b, first][None, :] if first < d else part
    i, j = np.nonzero(bound >= threshold - SLACK)
    acc = part[i, j]
    i, j = a[i], b[j]
    for lo, hi in zip(stops, stops[1:], strict=False):
        for at in range(0, len(i), 200_000):
            s = slice(at, at + 200_000)
            acc[s] += np.einsum("ij,ij->i", y[i[s], lo:hi], y[j[s], lo:hi])
        bound = acc + (tails[i, hi] * tails[j, hi] if hi < d else 0)
        ok = bound >= threshold - SLACK
        i, j, acc = i[ok], j[ok], acc[ok]
    return i, j
