"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens.  A queue's deficit is what its share of the tokens handed out
so far entitles it to, less what it has got; each slot of a window goes to the queue with the largest
deficit relative to its share, that is, token ``i`` of queue ``s`` is due at ``(i + 1/2) / share(s)``.  Exhausted queues drop out and
the others go on.  Because due times are a closed form, the number of tokens each queue has got
when a window begins is computed, not simulated: every partition starts with the deficits that
all windows before it leave behind, and windows are filled in parallel.

Up to MAX_QUEUES sources, a worker holds the counts of all queues before a block of windows.  Beyond, the
order is the same, but the stream is cut into cells of due time; a task orders the tokens of a cell and notes
at which due time and queue each window begins, and offsets are running sums over a window's pieces.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import worker
from .names import column
from .storage import Scratch

#: Window length, the id that ends a document, most queues whose counts are held densely, largest broadcast of offsets (rows).
LENGTH, END_ID, MAX_QUEUES, BROADCAST_ROWS = 2048, 1, 1024, 200_000
#: Words a worker remembers, in each of two generations; longer words are encoded each time.
MEMO_WORDS, MEMO_CHARS = 400_000, 64
#: Windows whose counts are computed together.
BLOCK = 512
#: Tokens of a cell of due time (more if there are more queues), and queues handled together in one.
CELL, SLICE = 1_000_000, 1_000_000
#: ASCII marks around a word; the apostrophe only after it, as it can start a pre-token with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"


class WordMemo:
    """Encodes texts word by word with a tokenizer whose pre-tokens never span white space.

    The tokenizer composes (NFC), lower-cases and cuts at white space, then into runs of letters, single
    digits and runs of marks; so a text's ids are those of its words, one after the other.  Ids of a word
    are remembered as packed uint32.  Letters between marks are encoded by the same model without
    its normaliser, many at once: a word's last id is known by its end mark.  Two generations bound
    the memory: when the young one is full it becomes the old one.  Texts to which this doesn't
    apply (not composed, added tokens inside, odd separators) are encoded whole.
    """

    END = "</w>"

    def __init__(self, path: str, words: int = MEMO_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.bare, self.limit = Tokenizer.from_file(path), Tokenizer.from_file(path), words
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith(self.END)]] = True
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bool:
        if not text.isascii() and ("\u03a3" in text or not unicodedata.is_normalized("NFC", text)):
            return False  # capital sigma lower-cases by context in Python
        return not any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", *self.special))

    def _learn(self, words: set[str]) -> None:
        """Ids of new words: those of letters alone many at once, then those with marks around letters from their parts."""
        young = self.young
        plain, marked, fresh = [], [], set()
        for w in words:
            if w.isalpha():
                plain.append(w)
            else:
                core = w.strip(MARKS)
                if core.isalpha() and len(w) <= MEMO_CHARS:
                    marked.append((w, core))
                    if core not in young:
                        fresh.add(core)
                else:
                    young[w] = self._ids(w)
        if self.old:
            for core in [c for c in fresh if c in self.old]:
                young[core] = self.old[core]
        new = [w for w in fresh.difference(young).union(plain) if len(w) <= MEMO_CHARS]
        for w in plain:
            if len(w) > MEMO_CHARS:
                young[w] = self._ids(w)
        for a in range(0, len(new), 512):
            some = new[a : a + 512]
            flat = np.asarray(self.bare.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[flat]) + 1
            if len(cut) != len(some):
                raise ValueError("the tokenizer does not mark word ends")
            raw, ends = flat.tobytes(), (cut * 4).tolist()
            young.update(zip(some, [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        marks = self.marks
        for w, core in marked:
            before, _, after = w.partition(core)
            if "'" in before:  # an apostrophe can start a pre-token with letters
                young[w] = self._ids(w)
            else:
                young[w] = (marks.get(before) or self._mark(before)) + young[core] + (marks.get(after) or self._mark(after))

    def _mark(self, marks: str) -> bytes:
        if marks and marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {}
            self.marks[marks] = self._ids(marks)
        return self.marks[marks] if marks else b""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null is the empty text."""
        texts = [t or "" for t in texts]
        plain = [self._plain(t) for t in texts]
        split = [t.lower().split() if ok else [] for t, ok in zip(texts, plain, strict=True)]
        out = []
        for a in range(0, len(texts), 256):
            missing = set().union(*split[a : a + 256]).difference(self.young)
            if missing and self.old:
                for w in [w for w in missing if w in self.old]:
                    self.young[w] = self.old[w]
                    missing.discard(w)
            if missing:
                self._learn(missing)
            get = self.young.__getitem__
            out += [b"".join(map(get, words)) if ok else self._ids(t) for t, ok, words in zip(texts[a : a + 256], plain[a : a + 256], split[a : a + 256], strict=True)]
            for w in [w for w in missing if len(w) > MEMO_CHARS]:
                del self.young[w]
            if len(self.young) > self.limit:
                self.young, self.old = {}, self.young
        return out


def memo_of(path: str, words: int = MEMO_WORDS) -> WordMemo:
    """One memo for each worker process, kept between tasks."""
    return worker.keep(("words", path, words), lambda: WordMemo(path, words))


class Schedule:
    """How many tokens of each queue lie before a position of the packed stream."""

    def __init__(self, totals: list[int], shares: list[float] | None = None):
        self.totals = np.asarray(totals, dtype=np.int64)
        share = np.asarray(shares if shares is not None else totals, dtype=np.float64)
        if (share <= 0)[self.totals > 0].any():
            raise ValueError("every queue with tokens needs a share above 0")
        self.rate = np.where(self.totals > 0, share, 1.0) / max(1.0, float(share[self.totals > 0].sum()) if len(share) else 1.0)
        self.total = int(self.totals.sum())

    def _due(self, p: np.ndarray) -> np.ndarray:
        return np.minimum(np.floor(p[:, None] * self.rate[None, :] + 0.5).astype(np.int64), self.totals[None, :])

    def before(self, positions: np.ndarray) -> np.ndarray:
        """(positions, queues) counts; each row sums to its position.  Counts never fall as positions grow."""
        x = np.minimum(np.asarray(positions, dtype=np.int64), self.total)
        lo = np.zeros(len(x))
        hi = np.full(len(x), float(((self.totals + 1) / self.rate).max()) if len(self.totals) else 1.0)
        while True:  # to neighbouring floats, so that only ties are left between lo and hi
            mid = lo + (hi - lo) / 2
            if not ((mid > lo) & (mid < hi)).any():
                break
            low = self._due(mid).sum(axis=1) <= x
            lo, hi = np.where(low & (mid > lo), mid, lo), np.where(low, hi, np.where(mid < hi, mid, hi))
        base, tie = self._due(lo), self._due(hi) - self._due(lo)
        want = (x - base.sum(axis=1))[:, None]
        earlier = np.cumsum(tie, axis=1) - tie
        return base + np.clip(want - earlier, 0, tie)

    # Many queues: a position at a time, and slices of queues.

    def _count(self, p: float, a: int = 0, b: int | None = None) -> np.ndarray:
        return np.minimum(np.floor(p * self.rate[a:b] + 0.5).astype(np.int64), self.totals[a:b])

    def handed(self, p: float) -> int:
        """Tokens due at ``p``."""
        return sum(int(self._count(p, a, a + SLICE).sum()) for a in range(0, len(self.totals), SLICE))

    def _end(self) -> float:
        return float(((self.totals + 1) / self.rate).max()) if len(self.totals) else 1.0

    def _edge(self, x: int) -> float:
        """A due time with at most ``x`` tokens before or at it, and near to the last such one."""
        lo, hi = 0.0, self._end()
        for _ in range(64):
            mid = lo + (hi - lo) / 2
            if not lo < mid < hi:
                break
            got = self.handed(mid)
            lo, hi = (mid, hi) if got <= x else (lo, mid)
            if x - CELL // 16 <= got <= x:
                break
        return lo

    def cells(self) -> int:
        return -(-self.total // self._cell())

    def _cell(self) -> int:
        return max(CELL, len(self.totals))

    def begins(self, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that begin in cell ``k``: number, due time and queue of the first token."""
        size, last = self._cell(), k + 1 >= self.cells()
        lo = self._edge(k * size) if k else 0.0
        hi = self._end() if last else self._edge((k + 1) * size)
        at = self.handed(lo)
        keys, queues = [], []
        for a in range(0, len(self.totals), SLICE):
            x = self._count(lo, a, a + SLICE)
            n = np.maximum(self._count(hi, a, a + SLICE) - x, 0)
            q = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + x[q]
            keys.append(due_at(i, self.rate[a + q])), queues.append((a + q).astype(np.int32))
        key, queue = np.concatenate(keys or [np.zeros(0)]), np.concatenate(queues or [np.zeros(0, np.int32)])
        order = np.argsort(key, kind="stable")  # queues ascend within equal due times
        first = np.arange(-(-at // length), -(-(at + len(key)) // length))
        pick = order[first * length - at]
        return first, key[pick], queue[pick]


def due_at(i: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Least float ``p`` at which token ``i`` is due: floor(p * rate + 1/2) > i, as rounded."""
    p = (i + 0.5) / rate
    while (late := np.floor(p * rate + 0.5) <= i).any():
        p = np.where(late, np.nextafter(p, np.inf), p)
    while True:
        less = np.nextafter(p, -np.inf)
        early = np.floor(less * rate + 0.5) > i
        if not early.any():
            return p
        p = np.where(early, less, p)


def window_of(key: np.ndarray, queue: np.ndarray, due: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Window of each token (due time, queue), where windows begin at (``due``, ``first`` queue), in order."""
    out = np.searchsorted(due, key, side="left")
    upto = np.searchsorted(due, key, side="right")
    # A queue has one token at most at a due time, so that the queue settles ties.
    for t in np.flatnonzero(out < upto):
        out[t] += np.searchsorted(first[out[t] : upto[t]], queue[t], side="right")
    return out - 1


def _counted(encoder: Callable, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("queue", pa.string()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, sums = encoder(), TaskContext.get().partitionId(), {}
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                ids = [x + tail for x in encode(batch.column("text").to_pylist())]
                queues = [s or "" for s in batch.column("source").to_pylist()]
                n, before = [len(x) // 4 for x in ids], []
                for q, k in zip(queues, n, strict=True):
                    before.append(sums.get(q, 0))
                    sums[q] = before[-1] + k
                yield pa.record_batch([pa.array([part] * len(ids), pa.int32()), pa.array(queues), pa.array(before, pa.int64()), batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array([_narrow(x) for x in ids], pa.binary())], schema=schema)

    return run


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where all fit; the first byte says which."""
    x = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + x.astype("<u2").tobytes() if not len(x) or x.max() < 65_536 else b"\x04" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u2" if ids[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def pack(docs: DataFrame, scratch: Scratch, encoder: Callable[[], Callable[[list], list[bytes]]], doc_id: str = "doc_id", text: str = "text", source: str = "source", length: int = LENGTH, end_id: int = END_ID, shares: dict[str, float] | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    ``encoder()`` returns, on an executor, a function from texts to packed uint32 ids.  Every document
    ends with ``end_id``, so that empty and null texts have one token.  ``shares`` are target
    proportions by source, ('' for a null source; 1 unless named); by default a source's share
    of all tokens, so that all queues end together.  Every source has its own queue, however many there are.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and
    ``ids`` if asked for).  Sequences are full but for the last.  Repeated rows are packed each for itself; an empty
    table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text"), column(source).cast("string").alias("source"))
    coded = scratch.put(rows.mapInArrow(_counted(encoder, end_id), "part int, queue string, before bigint, doc_id bigint, n bigint, ids binary"), "ids")
    sums = scratch.put(coded.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("bigint").alias("base"))
    if sums.select("queue").distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES:
        return _pack_many(coded, sums, base, scratch, length, shares, keep_ids)
    # At most MAX_QUEUES rows reach the driver.
    totals = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}
    names = list(totals)
    index = {q: k for k, q in enumerate(names)}
    plan = Schedule([totals[q] for q in names], None if shares is None else [float(shares.get(q, 1.0)) for q in names])
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}  # counts before the windows of a block

        def block(i: int) -> np.ndarray:
            if i not in blocks:
                if len(blocks) > 64:
                    blocks.clear()
                blocks[i] = plan.before((np.arange(BLOCK) + i * BLOCK) * length)
            return blocks[i]

        def cuts(first: int, last: int) -> np.ndarray:
            parts = [block(i) for i in range(first // BLOCK, last // BLOCK + 1)]
            at = first - first // BLOCK * BLOCK
            return (parts[0] if len(parts) == 1 else np.concatenate(parts))[at : at + last - first + 1]

        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                yield pieces(whole.slice(a, 1024), cuts)

    def pieces(batch: pa.RecordBatch, cuts: Callable[[int, int], np.ndarray]) -> pa.RecordBatch:
        docs_, starts, lengths, crcs, tokens, seqs, offsets, kept = [], [], [], [], [], [], [], []
        for queue, base_, before, doc, n, ids in zip(*[batch.column(c).to_pylist() for c in ("queue", "base", "before", "doc_id", "n", "ids")], strict=True):
            s, lo, raw = index[queue], base_ + before, _wide(ids)
            # The closed form gives the windows but for ties; the exact counts settle them.
            first, last = (int(plan._due(np.asarray([(t + 0.5) / plan.rate[s]])).sum()) // length for t in (lo, lo + n - 1))
            first, last = max(0, first - 1), last + 2
            table = cuts(first, last)
            while table[0, s] > lo or table[-1, s] < lo + n:
                first, last = max(0, first - 1), last + 1
                table = cuts(first, last)
            own = table[:, s]
            a = int(np.searchsorted(own, lo, side="right")) - 1
            w = first + a
            at = 0
            while at < n:
                take = min(n - at, int(own[a + 1]) - (lo + at))
                if take > 0:
                    ahead = int((table[a + 1, :s] - table[a, :s]).sum())
                    part = raw[at : at + take].tobytes()
                    docs_.append(doc), starts.append(at), lengths.append(take), crcs.append(zlib.crc32(part)), tokens.append(n), seqs.append(w)
                    offsets.append(ahead + lo + at - int(own[a]))
                    if keep_ids:
                        kept.append(part)
                    at += take
                a, w = a + 1, w + 1
        cols = [pa.array(x, pa.int64()) for x in (docs_, starts, lengths, crcs, tokens, seqs, offsets)] + ([pa.array(kept, pa.binary())] if keep_ids else [])
        return pa.record_batch(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if keep_ids else []))

    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if keep_ids else "")
    return coded.join(base, ["part", "queue"]).select("queue", "base", "before", "doc_id", "n", "ids").mapInArrow(place, out)


def _pack_many(coded: DataFrame, sums: DataFrame, base: DataFrame, scratch: Scratch, length: int, shares: dict[str, float] | None, keep_ids: bool) -> DataFrame:
    """The same sequences as the dense counts give, for any number of queues.

    Names stay in tables; two numbers a queue, and two a window, reach the driver and the workers.
    """
    spark = coded.sparkSession
    total = sums.groupBy("queue").agg(F.sum("n").alias("n"))
    if shares is not None:
        given = spark.createDataFrame([(q, float(x)) for q, x in shares.items()], "queue string, share double")
        total = total.join(given, "queue", "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    else:
        total = total.withColumn("share", F.col("n").cast("double"))
    queues = scratch.put(total.withColumn("s", F.row_number().over(Window.orderBy("queue")) - 1), "queues")
    table = queues.select("s", "n", "share").orderBy("s").toArrow()
    plan = spark.sparkContext.broadcast(Schedule(table.column("n").to_numpy(), table.column("share").to_numpy()))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                w, due, s = plan.value.begins(k, length)
                yield pa.record_batch([pa.array(w, pa.int64()), pa.array(due, pa.float64()), pa.array(s, pa.int32())], names=["w", "due", "s"])

    cells = plan.value.cells()
    begun = scratch.put(spark.range(0, cells, 1, min(cells, 10_000)).mapInArrow(begin, "w bigint, due double, s int"), "windows").orderBy("w").toArrow()
    starts = spark.sparkContext.broadcast((begun.column("due").to_numpy(), begun.column("s").to_numpy()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due, first = starts.value
        rate = plan.value.rate
        for whole in batches:
            for x in range(0, whole.num_rows, 256):
                batch = whole.slice(x, 256)
                out: list[list] = [[] for _ in names]
                for s, b, before, doc, n, ids in zip(*[batch.column(c).to_pylist() for c in ("s", "base", "before", "doc_id", "n", "ids")], strict=True):
                    lo, raw = b + before, _wide(ids)
                    w = window_of(due_at(np.arange(lo, lo + n), np.full(n, rate[s])), np.full(n, s), due, first)
                    cut = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), n]
                    for u, v in zip(cut, cut[1:]):  # noqa: B905
                        part = raw[u:v].tobytes()
                        row = [doc, u, v - u, zlib.crc32(part), n, int(w[u]), s, lo + u, *([part] if keep_ids else [])]
                        for held, cell in zip(out, row, strict=True):
                            held.append(cell)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "s", "at"] + (["ids"] if keep_ids else [])
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()] + ([pa.binary()] if keep_ids else [])
    fields = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, s int, at bigint" + (", ids binary" if keep_ids else "")
    pieces = coded.join(base, ["part", "queue"]).join(queues.select("queue", "s"), "queue").select("s", "base", "before", "doc_id", "n", "ids").mapInArrow(place, fields)
    earlier = Window.partitionBy("sequence_id").orderBy("s", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("bigint"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def padded_length(used: int, length: int = LENGTH) -> int:
    """A sequence is padded to ``length`` unless its own length is a power of two."""
    return used if used and used & (used - 1) == 0 else length
