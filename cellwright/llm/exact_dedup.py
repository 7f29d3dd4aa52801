"""Exact dedup by exchanging Golomb-coded fingerprints.

1. Each input task reduces its texts to SHA-256 of the normalised bytes.  The first 8 bytes are
   the fingerprint, its top bits name an owner.  For every owner a chunk of rows sends one
   sorted, Golomb-Rice-coded set of distinct fingerprints.
2. Owners decode their sets, count in how many chunks each fingerprint occurs and answer each
   chunk with a bitmap of duplicates.  Fingerprints repeated inside a chunk are known there.
3. Only rows whose bit is set are suspects.  Their normalised texts are grouped byte by byte,
   combined on the map side, so that a hot text crosses the network once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker
from .bloom import with_maybe
from .names import column, columns, fresh
from .storage import Scratch, partitions

#: Rows that share one set of coded fingerprints.
CHUNK_ROWS = 65_536
#: The bytes that do not count: space and \x09-\x0D.  In UTF-8 no other character contains them.
BLANKS = b" \t\n\x0b\x0c\r"
#: The same for Spark's regular expressions.
BLANK_PATTERN = r"[\x20\x09-\x0D]"


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct uint64 -> (remainder bits, unary quotients then remainders)."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // len(values)
    k = min(63, max(0, mean.bit_length() - 1))
    unary = np.ones(int((gaps >> np.uint64(k)).sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1] = 0
    rest = np.empty((len(gaps), k), dtype=np.uint8)
    for j in range(k):
        rest[:, j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    return k, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def rice_decode(k: int, stream: bytes, n: int) -> np.ndarray:
    """Inverse of :func:`rice_encode`."""
    if not n:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(stream, dtype=np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotient = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    at = -(-int(ends[-1] + 1) // 8) * 8
    remainders = bits[at : at + n * k].reshape(n, k)
    rest = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        rest = (rest << np.uint64(1)) | remainders[:, j]
    return np.cumsum((quotient << np.uint64(k)) | rest, dtype=np.uint64)


def _owner(prints: np.ndarray, owners: int) -> np.ndarray:
    return ((prints >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _prints(owners: int):
    """Task body of step 1: rows with their slot in the coded set, then the coded sets."""
    schema = pa.schema([("chunk", pa.string()), ("owner", pa.int32()), ("slot", pa.int32()), ("again", pa.bool_()), ("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("k", pa.int32()), ("n", pa.int32()), ("stream", pa.binary())])

    def flush(chunk: str, first: int, ids: list, lengths: list, shas: list) -> Iterator[pa.RecordBatch]:
        prints = np.frombuffer(b"".join(s[:8] for s in shas), dtype=">u8").astype(np.uint64)
        distinct, where, times = np.unique(prints, return_inverse=True, return_counts=True)
        of = _owner(distinct, owners).astype(np.int32)
        first_of = np.searchsorted(of, np.arange(owners + 1))
        rows = len(ids)
        yield pa.record_batch([pa.array([chunk] * rows), pa.array(of[where], pa.int32()), pa.array((where - first_of[of[where]]).astype(np.int32)), pa.array(times[where] > 1), pa.array(np.arange(first, first + rows)), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(shas, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema=schema)
        full = [o for o in range(owners) if first_of[o] < first_of[o + 1]]
        coded = [rice_encode(distinct[first_of[o] : first_of[o + 1]]) for o in full]
        m = len(full)
        yield pa.record_batch([pa.array([chunk] * m), pa.array(full, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([k for k, _ in coded], pa.int32()), pa.array([int(first_of[o + 1] - first_of[o]) for o in full], pa.int32()), pa.array([s for _, s in coded], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget()
        part = TaskContext.get().partitionId()
        ids, lengths, shas, done = [], [], [], 0
        for batch in batches:
            for text, doc in zip(batch.column("text"), batch.column("doc_id"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                shas.append(hashlib.sha256(raw.translate(None, BLANKS)).digest())
                ids.append(doc.as_py())
            lengths += batch.column("n_chars").to_pylist()
            if len(ids) >= CHUNK_ROWS:
                yield from flush(f"{part}-{done}", (part << 33) + done, ids, lengths, shas)
                done += len(ids)
                ids, lengths, shas = [], [], []
        if ids:
            yield from flush(f"{part}-{done}", (part << 33) + done, ids, lengths, shas)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, for the coded sets of one owner: sets arrive sorted by owner."""
    held, owner = [], None

    def bitmaps() -> pa.RecordBatch:
        sets = [rice_decode(k, stream, n) for _, k, n, stream in held]
        distinct, times = np.unique(np.concatenate(sets), return_counts=True)
        twice = distinct[times > 1]
        maps = []
        for x in sets:
            at = np.searchsorted(twice, x)
            hit = at < len(twice)
            hit[hit] = twice[at[hit]] == x[hit]
            maps.append(np.packbits(hit, bitorder="little").tobytes())
        return pa.record_batch([pa.array([h[0] for h in held]), pa.array([owner] * len(held), pa.int32()), pa.array(maps, pa.binary())], names=["chunk", "owner", "bitmap"])

    for batch in batches:
        for row in batch.to_pylist():
            if owner is not None and row["owner"] != owner:
                yield bitmaps()
                held = []
            owner = row["owner"]
            held.append((row["chunk"], row["k"], row["n"], row["stream"]))
    if held:
        yield bitmaps()


def exact_groups(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", owner_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; a null text is
    the empty text, and all empty texts are equal.  The row with the most code points in its
    original text stays, then the smallest doc_id (nulls last), then, for repeated rows, one of
    them: ``kept`` is true for exactly one row of a group.  Other columns are not read.  An
    owner holds about ``owner_rows`` fingerprints whatever the input's size.
    """
    spark = docs.sparkSession
    source = docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text"))
    owners = max(4, -(-docs.select(F.lit(1)).count() // owner_rows))
    out = "chunk string, owner int, slot int, again boolean, row_id bigint, doc_id bigint, n_chars bigint, sha binary, k int, n int, stream binary"
    both = scratch.put(source.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).mapInArrow(_prints(owners), out), "prints")
    sent = both.where("stream is not null").select("chunk", "owner", "k", "n", "stream")
    maps = sent.repartition(max(owners, partitions(spark)), "owner").sortWithinPartitions("owner").mapInArrow(_answer, "chunk string, owner int, bitmap binary")
    rows = both.where("stream is null").select("chunk", "owner", "slot", "again", "row_id", "doc_id", "n_chars", "sha")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(slot div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = scratch.put(rows.join(maps, ["chunk", "owner"], "left").select("row_id", "doc_id", "n_chars", "sha", (F.col("again") | F.coalesce(F.getbit(byte, F.col("slot") % 8) == 1, F.lit(False))).alias("suspect")), "marked")
    scratch.drop(both)

    # Byte verification: equal bytes meet in one group, a text that only shares a fingerprint does not.  Only
    # suspects, and the few rows that the filter takes for some, are read further and shuffled.
    suspects = marked.where("suspect").select("doc_id").distinct()
    texts = with_maybe(source, F.col("doc_id"), suspects).where("_maybe").select(F.regexp_replace(F.coalesce("text", F.lit("")), BLANK_PATTERN, "").alias("body"))
    verified = texts.groupBy("body").agg(F.count("*").alias("copies")).select(F.sha2(F.col("body").cast("binary"), 256).alias("hex"), "copies").where("copies > 1")
    best = F.max_by("row_id", F.struct("n_chars", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))), -F.col("row_id")))
    top = marked.where("suspect").groupBy(F.lower(F.hex("sha")).alias("hex")).agg(best.alias("keep_row"), F.count("*").alias("group_size"))
    first = marked.where("suspect").select(F.col("row_id").alias("keep_row"), F.col("doc_id").alias("keep_id"))
    groups = scratch.put(top.join(verified, "hex", "left_semi").join(first, "keep_row"), "groups")
    joined = marked.where("suspect").withColumn("hex", F.lower(F.hex("sha"))).join(groups, "hex", "left").select("row_id", "doc_id", F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.coalesce(F.col("keep_row") == F.col("row_id"), F.lit(True)).alias("kept"), F.col("hex").alias("text_sha256"))
    alone = marked.where("not suspect").select("row_id", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return joined.unionByName(alone)


def drop_exact_copies(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are, whatever their names.

    Ids without a dropped row pass unread; the others are settled by id and SHA-256.  Where both repeat, the longest of the
    rows stays, then the one whose columns (but maps) hash highest.
    """
    marked = scratch.put(exact_groups(docs, scratch, doc_id, text).select("doc_id", "kept", "text_sha256"), "marked")
    maybe, gid, kid, ksha, sha, row = fresh(docs.columns, "_maybe", "_gid", "_kid", "_ksha", "_sha", "_row")
    key = column(doc_id).cast("bigint")
    # Ids with a dropped row, and their rows that stay: one for each digest.
    gone = scratch.put(marked.where("not kept").select(F.col("doc_id").alias(gid)).distinct(), "gone")
    kept = marked.where("kept").join(gone, F.col("doc_id").eqNullSafe(F.col(gid)), "left_semi").select(F.col("doc_id").alias(kid), F.col("text_sha256").alias(ksha)).distinct()
    flagged = with_maybe(docs, key, gone, maybe)
    untouched = flagged.where(~F.col(maybe)).select(*columns(docs))
    touched = flagged.where(maybe)
    other = touched.join(gone, key.eqNullSafe(F.col(gid)), "left_anti").select(*columns(docs))
    digest = F.sha2(F.regexp_replace(F.coalesce(column(text), F.lit("")), BLANK_PATTERN, "").cast("binary"), 256)
    found = touched.withColumn(sha, digest).join(kept, key.eqNullSafe(F.col(kid)) & (F.col(sha) == F.col(ksha)), "left_semi")
    # Combined on the map side, so that rows repeated without end meet as one per task.
    first = F.max_by(F.struct(*columns(docs)), F.struct(F.coalesce(F.length(column(text)), F.lit(0)), F.xxhash64(*[column(c) for c, t in docs.dtypes if "map<" not in t])))
    one = found.groupBy(key.alias(kid), F.col(sha)).agg(first.alias(row)).select(f"{row}.*")
    return untouched.union(other).union(one)
