"""Repeated byte strings by column-wise construction of multi-document suffix arrays.

1. One pass cuts each text into runs of neighbouring starts whose 200-byte windows have the same smallest hash of a
   64-byte gram.  Equal windows have equal smallest hashes, so that they lie in runs of one key.  Keys with a single
   occurrence in all texts are settled.
2. The bytes of the other runs, pieces of at most 339 bytes, go to a task by key.  Equal pieces travel once a task and
   carry their number; a key with many different pieces is dealt in blocks.
3. A unit of some hundred pieces becomes one collection.  A piece gives eight documents, one for each phase of its 8-byte
   symbols, so that every start is a suffix.  Each round inserts one more symbol of every document, last symbols first:
   the new suffix's place follows from the rank of its symbol in the collection's Burrows-Wheeler transform, and its
   common prefixes with its neighbours from a range minimum over those of the round before.
4. Neighbours that share 25 symbols share 200 bytes.  For keys in several blocks, the windows left single in their
   block meet again by digest.
5. Spans go back to every text of the piece, and texts lose the bytes they cover.

The transform is kept inverted, as the sorted rows before which each symbol stands: that list is what ranks are read
from.  A round reads the columns of the last one in order and writes new ones; a unit is bounded, so that they fit
memory.  Nothing is dropped by frequency: a hash that two different grams share only brings pieces together, and the
transform decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import worker
from .bloom import with_maybe
from .names import column, columns, fresh
from .ngram_jaccard import _mix
from .storage import Scratch, partitions

#: Bytes of a repeated string, of a hashed gram, of a symbol.
LENGTH, GRAM, SYMBOL = 200, 64, 8
#: Most starts of a run, pieces of a key in a block, of a unit before it is closed, digests a task remembers.
STARTS, BLOCK_PIECES, UNIT_PIECES, SENT = 140, 1024, 256, 100_000
_VALUES = _mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
_BASE = 0x9E3779B97F4A7C15


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position, by doubling."""
    h, step = _VALUES[raw], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        step *= 2
    return _mix(h)


def _slide(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        h = pick(h[:-step], h[step:])
        step *= 2
    return pick(h[: len(h) - (width - step)], h[width - step :]) if step < width else h


def runs_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one smallest hash: first start, end, hash, and how often it surely or perhaps occurs (1 or 2)."""
    width = LENGTH - GRAM + 1
    h = _grams(np.frombuffer(text, np.uint8))
    low = _slide(h, width, np.minimum)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    end = np.append(first[1:], len(low))
    if (end - first).max() > STARTS:
        first = np.concatenate([np.arange(a, b, STARTS) for a, b in zip(first, end, strict=True)])
        end = np.append(first[1:], len(low))
    key = low[first]
    # A gram is its window's least if no window around it has a lesser one; the same least twice in a row may be a window that repeats within its run.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    least = h[_slide(padded, width, np.maximum) == h]
    again = least[1:][least[1:] == least[:-1]]
    return first, end, key, 1 + np.isin(key, again).astype(np.int64) if len(again) else np.ones(len(key), np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text: its digest, and its runs unless this task has sent them."""
    worker.forget()
    sent: set[bytes] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            cols: list[list] = [[], [], [], []]
            for cid, text in zip(batch.column("cid").to_pylist(), batch.column("body"), strict=True):
                if cid in sent:
                    found = [None] * 4
                else:
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(cid)
                    first, end, key, times = runs_of(text.as_py())
                    found = [key.view(np.int64), first.astype(np.int32), end.astype(np.int32), times.astype(np.int8)]
                for c, f in zip(cols, found, strict=True):
                    c.append(f)
            yield pa.record_batch([batch.column("cid"), *[pa.array(c, pa.list_(t)) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int8()), strict=True)]], names=["cid", "key", "a", "e", "times"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text this task has not sent yet, as far as it remembers."""
    sent: set[bytes] = set()
    for batch in batches:
        keep = []
        for cid in batch.column("cid").to_pylist():
            if len(sent) >= SENT:
                sent.clear()
            keep.append(cid not in sent)
            sent.add(cid)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text; bytes go along once a task."""
    sent: set[bytes] = set()
    last = None
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            cids, copies, starts, sids, keys, bodies = [], [], [], [], [], []
            for row in batch.to_pylist():
                if row["cid"] == last:
                    continue
                last, text = row["cid"], row["body"]
                for run in row["runs"]:
                    piece = text[run["a"] : run["e"] + LENGTH - 1]
                    sid = hashlib.blake2b(piece, digest_size=16).digest()
                    cids.append(last)
                    copies.append(row["copies"])
                    starts.append(run["a"])
                    sids.append(sid)
                    keys.append(run["key"])
                    bodies.append(None if sid in sent else piece)
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(sid)
            yield pa.record_batch([pa.array(cids, pa.binary()), pa.array(copies, pa.int64()), pa.array(starts, pa.int32()), pa.array(sids, pa.binary()), pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], names=["cid", "copies", "a", "sid", "key", "piece"])


class _Least:
    """Smallest value in any range of a column of small numbers."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while step * 2 <= len(values):
            level = values.copy()
            np.minimum(self.levels[-1][:-step], self.levels[-1][step:], out=level[:-step])
            self.levels.append(level)
            step *= 2
        self.flat, self.n = np.concatenate(self.levels), len(values)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Both ends included."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1].astype(np.int64) - 1
        return np.minimum(self.flat[level * self.n + lo], self.flat[level * self.n + hi + 1 - (1 << level)])


def collection_runs(pieces: list[bytes], length: int = LENGTH, symbol: int = SYMBOL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of ``length`` bytes in a piece, in suffix order: piece, start, and a number that equal strings share.

    ``length`` is a multiple of ``symbol``, which is 8 at most.
    """
    depth = length // symbol
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(pieces) else np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(pieces) + bytes(symbol), np.uint8)
    words = np.zeros((int(sizes.sum()), 8), np.uint8)
    words[:, :symbol] = np.lib.stride_tricks.sliding_window_view(raw, symbol)[: len(words)]
    ids = np.unique(words.view(np.uint64).ravel(), return_inverse=True)[1].astype(np.int64)
    phase = np.tile(np.arange(symbol), len(pieces))
    base, count = np.repeat(off, symbol) + phase, (np.repeat(sizes, symbol) - phase) // symbol
    base, count = base[count >= depth], count[count >= depth]
    order = np.argsort(-count, kind="stable")
    base, count = base[order], count[order]
    docs, low = len(base), (1 << 32) - 1
    # Rows: an empty suffix for each document, then the suffixes in order.  Suffix k is symbol keys[k] >> 32 before row keys[k] & low.
    keys, shared, at = np.empty(0, np.int64), np.zeros(docs, np.uint8), np.arange(docs)
    for r in range(1, int(count[0]) + 1 if docs else 1):
        active = int(np.searchsorted(-count, -r, "right"))
        new = (ids[base[:active] + symbol * (count[:active] - r)] << 32) | at[:active]
        by = np.argsort(new)
        new = new[by]
        put = np.searchsorted(keys, new) + np.arange(active)
        fresh_row = np.zeros(len(keys) + active, dtype=bool)
        fresh_row[put] = True
        moved = np.concatenate([np.arange(docs), docs + np.flatnonzero(~fresh_row)])
        merged = np.empty(len(fresh_row), np.int64)
        merged[~fresh_row], merged[put] = keys, new
        prefixes = np.zeros(docs + len(fresh_row), np.uint8)
        prefixes[moved] = shared
        fresh_row[1:] |= fresh_row[:-1].copy()
        ask = np.flatnonzero(fresh_row)
        before, this = merged[ask - 1], merged[ask]
        same = ((before >> 32) == (this >> 32)) & (ask > 0)
        prefixes[docs + ask] = 0
        prefixes[docs + ask[same]] = np.minimum(_Least(shared).of((before[same] & low) + 1, this[same] & low) + 1, depth)
        tail = merged & low
        merged ^= tail
        merged |= moved[tail]
        keys, shared = merged, prefixes
        at = moved[at]
        at[by] = docs + put
    where, tail = np.empty(len(keys), np.int64), keys & low
    for r in range(int(count[0]) if docs else 0):  # from whole documents on, a symbol less each time
        active = int(np.searchsorted(-count, -r, "left"))
        where[at[:active] - docs] = base[:active] + symbol * r
        at = tail[at[:active] - docs]
    run = np.cumsum(shared[docs:] < depth)
    piece = np.searchsorted(off, where, "right") - 1
    start = where - off[piece]
    whole = start + length <= sizes[piece]
    return piece[whole], start[whole], run[whole]


_FOUND = "sid binary, f int, t int, digest binary, times int"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of the pieces of each unit, and the windows that other blocks of the key have to see."""
    worker.forget()
    unit: dict[bytes, list] = {}
    group: dict[bytes, list] = {}
    whole: list[tuple[bytes, int]] = []
    at = None

    def close() -> None:
        """Pieces that occur twice are repeated from end to end: without a single piece beside them, nothing is left to find."""
        if all(n > 1 and not split for _, n, split in group.values()):
            whole.extend((sid, len(piece)) for sid, (piece, _, _) in group.items())
        else:
            unit.update(group)
        group.clear()

    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            for key, block, blocks, sid, piece, times in zip(*[part.column(c).to_pylist() for c in ("key", "block", "blocks", "sid", "piece", "times")], strict=True):
                if (key, block) != at:
                    close()
                    at = (key, block)
                    if len(unit) >= UNIT_PIECES or len(whole) >= SENT:
                        yield _judged(unit, whole)
                        unit, whole = {}, []
                held = group.setdefault(sid, [None, 0, blocks > 1])
                held[0] = held[0] if piece is None else piece
                held[1] += times
    close()
    yield _judged(unit, whole)


def _judged(unit: dict[bytes, list], whole: list[tuple[bytes, int]]) -> pa.RecordBatch:
    sids, pieces = list(unit), [p for p, _, _ in unit.values()]
    times, split = np.array([n for _, n, _ in unit.values()], np.int64), np.array([s for _, _, s in unit.values()], bool)
    piece, start, run = collection_runs(pieces)
    total = np.bincount(run, weights=np.minimum(times, 2)[piece]) if len(run) else np.zeros(0)
    again = total[run] >= 2 if len(run) else np.zeros(0, bool)
    # Neighbouring repeated starts of a piece become one span.
    p, s = piece[again], start[again]
    by = np.lexsort((s, p))
    p, s = p[by], s[by]
    head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] > s[:-1] + LENGTH)])) if len(p) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(p)) - 1 if len(p) else head
    n = len(head) + len(whole)
    out = [[*[sids[i] for i in p[head]], *[sid for sid, _ in whole]], [*s[head].tolist(), *[0] * len(whole)], [*(s[tail] + LENGTH).tolist(), *[size for _, size in whole]], [None] * n, [0] * n]
    for k in np.flatnonzero(split[piece]) if split.any() else ():
        i, a = int(piece[k]), int(start[k])
        if not again[k] or k == 0 or run[k - 1] != run[k]:
            out[0].append(None if again[k] else sids[i])
            out[1].append(a)
            out[2].append(a + LENGTH)
            out[3].append(hashlib.blake2b(pieces[i][a : a + LENGTH], digest_size=16).digest())
            out[4].append(2 if again[k] else 1)
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names=["sid", "f", "t", "digest", "times"])


def _class_of(body: Column) -> Column:
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def _blocks(pieces: DataFrame, scratch: Scratch, block_pieces: int) -> DataFrame:
    """Key, block and number of blocks for each piece's row; keys with few pieces are one block."""
    sizes = pieces.select("key", "sid").distinct().groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block_pieces)
    large = scratch.put(sizes.select("key", F.ceil(F.col("size") / block_pieces).cast("int").alias("n")), "large")
    many = pieces.join(large, "key", "left").withColumn("blocks", F.coalesce("n", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    return many.select("key", "block", "blocks", "sid", "piece", "times")


def find_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``(cid, spans)``: for each text with repeated strings, by the first 16 bytes of its SHA-256, spans of bytes (f, t).

    Spans may overlap and touch; together they cover each byte of a 200-byte string that also starts anywhere else.
    """
    spark = docs.sparkSession
    body = F.coalesce(column(text), F.lit("")).cast("binary")
    texts = docs.select(_class_of(body).alias("cid"), body.alias("body")).where(F.octet_length("body") >= LENGTH)
    marked = texts.mapInArrow(_mark, "cid binary, key array<bigint>, a array<int>, e array<int>, times array<tinyint>")
    runs = F.struct("key", "a", "e", "times")
    classes = scratch.put(marked.groupBy("cid").agg(F.count("*").alias("copies"), F.first(F.when(F.col("key").isNotNull(), runs), ignorenulls=True).alias("m")), "classes")
    each = classes.select("cid", "copies", F.explode(F.arrays_zip("m.key", "m.a", "m.e", "m.times")).alias("r")).select("cid", "copies", "r.*")
    common = scratch.put(each.groupBy("key").agg(F.sum(F.least("copies", F.lit(2)) * F.col("times")).alias("n")).where("n > 1").select("key"), "common")
    hits = each.join(common, "key", "left_semi").groupBy("cid").agg(F.first("copies").alias("copies"), F.collect_list(F.struct("key", "a", "e")).alias("runs"))
    hits = scratch.put(hits, "hits")
    sent = with_maybe(texts, F.col("cid"), hits.select("cid")).where("_maybe").select("cid", "body").mapInArrow(_once, "cid binary, body binary")
    pieces = scratch.put(sent.join(hits, "cid").mapInArrow(_pieces, "cid binary, copies bigint, a int, sid binary, key bigint, piece binary"), "pieces")
    scratch.drop(classes, common, hits)
    at = scratch.put(pieces.groupBy("cid", "a").agg(F.first("sid").alias("sid"), F.first("key").alias("key"), F.first("copies").alias("copies")), "at")
    weights = at.groupBy("sid", "key").agg(F.sum("copies").alias("n")).select("key", "sid", F.lit(None).cast("binary").alias("piece"), F.least("n", F.lit(2)).cast("int").alias("times"))
    bytes_of = pieces.where("piece is not null").select("key", "sid", "piece", F.lit(0).alias("times"))
    dealt = _blocks(bytes_of.unionByName(weights), scratch, block_pieces)
    found = dealt.repartition(partitions(spark), "key", "block").sortWithinPartitions("key", "block").mapInArrow(_judge, _FOUND)
    found = scratch.put(found, "found")
    scratch.drop(pieces)
    seen = found.where("digest is not null")
    across = seen.where("sid is not null").join(seen.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest"), "digest", "left_semi")
    spans = found.where("digest is null").select("sid", "f", "t").unionByName(across.select("sid", "f", "t"))
    back = at.join(spans, "sid").groupBy("cid").agg(F.collect_list(F.struct((F.col("a") + F.col("f")).alias("f"), (F.col("a") + F.col("t")).alias("t"))).alias("spans"))
    return scratch.put(back, "spans")


@F.pandas_udf(StructType([StructField("kept", BinaryType()), StructField("spans", ArrayType(StructType([StructField("f", IntegerType()), StructField("t", IntegerType())])))]))
def _cut(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
    kept, runs = [], []
    for body, found in zip(bodies, spans, strict=True):
        ends: list[list[int]] = []
        for f, t in sorted((s["f"], s["t"]) for s in found):
            if ends and f <= ends[-1][1]:
                ends[-1][1] = max(ends[-1][1], t)
            else:
                ends.append([f, t])
        edges = [0, *[x for e in ends for x in e], len(body)]
        kept.append(b"".join(body[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
        runs.append([{"f": f, "t": t} for f, t in ends])
    return pd.DataFrame({"kept": kept, "spans": runs})


def cut_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", names: tuple[str, str] = ("kept_bytes", "removed_spans"), block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Every row of ``docs`` with the bytes that stay, and the maximal removed spans (f, t) in order, end excluded.

    A byte goes if a string of 200 bytes that covers it also starts anywhere else in any text, in the same one included.
    A null text is the empty text, texts below 200 bytes stay whole, and equal rows are cut alike: all copies of a text
    of 200 bytes or more go.  ``docs`` may be empty and may have any other columns, under any names; the two new
    columns get a number behind their name if it is taken.  Bytes are cut where they fall, also within a character.
    """
    spans = find_repeats(docs, scratch, text, block_pieces)
    cid, maybe, found, out = fresh([*docs.columns, "cid", "spans"], "_cid", "_maybe", "_found", "_out")
    kept, removed = fresh(docs.columns, *names)
    body = F.coalesce(column(text), F.lit("")).cast("binary")
    flagged = with_maybe(docs.withColumn(cid, _class_of(body)), column(cid), spans.select("cid"), maybe)
    none = F.array().cast("array<struct<f:int,t:int>>")
    whole = flagged.where(~column(maybe)).select(*columns(docs), body.alias(kept), none.alias(removed))
    met = flagged.where(column(maybe)).join(spans.select(F.col("cid").alias(found), F.col("spans").alias(out)), column(cid) == column(found), "left")
    cut = met.select(*columns(docs), _cut(body, F.coalesce(column(out), none)).alias(out)).select(*columns(docs), column(out)["kept"].alias(kept), column(out)["spans"].alias(removed))
    return whole.unionByName(cut) if len(set(c.lower() for c in docs.columns)) == len(docs.columns) else whole.union(cut)
