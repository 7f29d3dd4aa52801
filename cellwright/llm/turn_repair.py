"""Repair of conversation structure by Four-Russians block tables.

A conversation's turns become symbols: the initial of the role (system, user, assistant, other), whether the text is cut off, or
that the turn has to go (blank, or said before).  Cheapest edits to a conversation of the form ``(s?(ua)+)?`` are a
shortest path through four states; what matters of the turns to the right is the vector of the four costs still
to come, and less its least entry that vector is one of a small fixed set.

1. Tables hold, for every block of BLOCK symbols and every vector at its right end, the vector at its left end, what it costs
   more, and for each state that enters the block the state that leaves it.
2. Rows are dealt by ranges of (conversation, turn) and cut into chunks, so that one long conversation is many chunks.  A chunk is
   looked up block by block from its right end, for all vectors at once: that is its summary.
3. A conversation's chunk summaries are folded from the right for vectors and costs, then from the left for states.
4. Each chunk is expanded, blocks from right to left for the vectors before each turn, then edits are read from the left: in every state
   the first of D, I, K, R that is still cheapest.  Choices differ in that letter, so that the audit is the least of all cheapest ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from . import worker
from .names import column
from .storage import Scratch, partitions

#: Costs of a new role, of a deletion, of an inserted turn, of a cut-off turn that stays; symbols of a block; turns of a chunk.
REROLE, DELETE, INSERT, CUT_OFF, BLOCK, CHUNK = 3, 4, 3, 3, 4, 4096
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.  NEXT: state after a user or assistant turn that fits.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost of the turns still missing at the end.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: s, u, a, other; the same cut off; to be deleted.
SYMBOLS = "suaoSUAOx"


def _choices(symbol: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """Ways to treat a turn: letter, cost with all that follows, next state."""
    ways = [("D", DELETE + after[state], state)]
    if symbol < 8:
        extra, role = (CUT_OFF if symbol >= 4 else 0), symbol % 4
        if (role == 0 and state == START) or (role == 1 and state != USER) or (role == 2 and state == USER):
            to = SYSTEM if role == 0 else NEXT[state]
            ways.append(("K", extra + after[to], to))
        ways.append(("R", extra + REROLE + after[NEXT[state]], NEXT[state]))
    return ways


def _step(symbol: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], list[tuple[str, int]]]:
    """Costs before a turn by state; and by state the letters up to the turn's own and the state behind it."""
    least = [min(c for _, c, _ in _choices(symbol, q, after)) for q in range(4)]
    u, a = min(least[USER], INSERT + least[ASSISTANT]), min(least[ASSISTANT], INSERT + least[USER])
    costs = (min(least[START], INSERT + u), min(least[SYSTEM], INSERT + u), u, a)
    traces = []
    for q in range(4):
        letters = ""
        while True:
            ways = [*_choices(symbol, q, after), ("I", INSERT + costs[NEXT[q]], -1)]
            letter, _, to = min(w for w in ways if w[1] == costs[q])
            letters += letter
            if letter != "I":
                break
            q = NEXT[q]
        traces.append((letters, to))
    return costs, traces


class Tables:
    """Normalised vectors, and transitions of single symbols and of blocks over them."""

    def __init__(self) -> None:
        self.vectors, seen = [END], {END: 0}
        left: list[list[int]] = []
        more: list[list[int]] = []
        self.traces: list[list[list[tuple[str, int]]]] = []
        for v in self.vectors:  # grows while it is read
            left.append([])
            more.append([])
            self.traces.append([])
            for s in range(len(SYMBOLS)):
                costs, traces = _step(s, v)
                low = min(costs)
                norm = tuple(c - low for c in costs)
                if norm not in seen:
                    seen[norm] = len(self.vectors)
                    self.vectors.append(norm)
                left[-1].append(seen[norm])
                more[-1].append(low)
                self.traces[-1].append(traces)
        one_left, one_more = np.array(left, np.int32).T, np.array(more, np.int64).T
        one_exit = np.array([[[t[1] for t in by] for by in v] for v in self.traces], np.int8).transpose(1, 0, 2)
        #: By length of a block: block, vector at its right -> vector at its left, cost; and state that enters -> state that leaves.
        self.by: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.arange(len(self.vectors))[None], np.zeros((1, len(self.vectors)), np.int64), np.broadcast_to(np.arange(4, dtype=np.int8), (1, len(self.vectors), 4)))]
        for _ in range(BLOCK):
            l, m, e = self.by[-1]
            wide = len(SYMBOLS) * len(l)
            state = one_exit[:, l]  # symbol, rest of the block, vector, state that enters
            exits = np.take_along_axis(np.broadcast_to(e, state.shape), state.astype(np.int64), axis=3)
            self.by.append((one_left[:, l].reshape(wide, -1), (one_more[:, l] + m).reshape(wide, -1), exits.reshape(wide, len(self.vectors), 4)))


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _cut(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """Blocks of a chunk from the left: number, length, first symbol; the first may be short."""
    out, at = [], 0
    while at < len(symbols):
        n = (len(symbols) - at) % BLOCK or BLOCK
        code = 0
        for s in symbols[at : at + n]:
            code = code * len(SYMBOLS) + int(s)
        out.append((code, n, at))
        at += n
    return out


def summary(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every vector at the chunk's right: vector at its left, cost, and by entering state the leaving one."""
    t = tables()
    v, cost = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    exits = np.broadcast_to(np.arange(4, dtype=np.int8), (len(v), 4))
    for code, n, _ in reversed(_cut(symbols)):
        left, more, out = t.by[n]
        exits = np.take_along_axis(exits, out[code][v].astype(np.int64), axis=1)
        cost = cost + more[code][v]
        v = left[code][v]
    return v, cost, exits


def expand(symbols: np.ndarray, right: int, state: int) -> list[tuple[str, int]]:
    """For each turn the letters up to its own (inserted turns first) and the state before the first of them."""
    t, out = tables(), []
    blocks = _cut(symbols)
    ends = []
    for code, n, _ in reversed(blocks):
        ends.append(right)
        right = int(t.by[n][0][code][right])
    for (_, n, at), end in zip(blocks, reversed(ends), strict=True):
        after = [end]
        for s in symbols[at + n - 1 : at : -1] if at else symbols[at + n - 1 : 0 : -1]:
            after.append(int(t.by[1][0][s][after[-1]]))
        for s, v in zip(symbols[at : at + n], reversed(after), strict=True):
            letters, to = t.traces[v][s][state]
            out.append((letters, state))
            state = to
    return out


def closing(state: int) -> int:
    """Turns to insert at the end."""
    return END[state] // INSERT


def roles_from(state: int, letters: str) -> list[str | None]:
    """The role that each letter gives, None where the turn keeps its own or goes."""
    out: list[str | None] = []
    for letter in letters:
        if letter in "IR":
            out.append("assistant" if state == USER else "user")
            state = NEXT[state]
        else:
            out.append(None)
    return out


# Rows, chunks, conversations --------------------------------------------------------


def _place(schema: StructType, chunk_rows: int):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number rows and chunks of a sorted range."""
        worker.forget()
        part, at, chunk, held, last = TaskContext.get().partitionId(), 0, -1, 0, None
        for batch in batches:
            chunks = []
            for conv in batch.column("conv").to_pylist():
                if chunk < 0 or conv != last or held == chunk_rows:
                    chunk, held, last = chunk + 1, 0, conv
                held += 1
                chunks.append(chunk)
            n = batch.num_rows
            yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array(chunks, pa.int32()), pa.array(range(at, at + n), pa.int64()), *[batch.column(c) for c in names[3:]]], names=names)
            at += n

    return run


def _summarise(schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget()
        for batch in batches:
            packed = []
            for symbols in batch.column("symbols").to_pylist():
                v, cost, exits = summary(np.array([SYMBOLS.index(c) for c in symbols]))
                packed.append(v.astype(np.int16).tobytes() + cost.astype(np.int64).tobytes() + exits.astype(np.int8).tobytes())
            cols = {"summary": pa.array(packed, pa.binary())} | {c: batch.column(c) for c in schema.names if c != "summary"}
            yield pa.record_batch([cols[c] for c in schema.names], names=schema.names)

    return run


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(tables().vectors)
    return np.frombuffer(packed, np.int16, n), np.frombuffer(packed, np.int64, n, 2 * n), np.frombuffer(packed, np.int8, 4 * n, 10 * n).reshape(n, 4)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_LEGAL = ("su", "ua", "au")


def _fold(schema: StructType):
    def one(conv, rows: list[dict]) -> Iterator[tuple]:
        right, vectors, cost = 0, [], 0
        for r in reversed(rows):
            vectors.append(right)
            v, more, _ = _unpack(r["summary"])
            cost += int(more[right])
            right = int(v[right])
        cost += tables().vectors[right][START]
        sums = {c: sum(r[c] for r in rows) for c in _COUNTS[1:]}
        first, last, distinct, turn, initial = None, None, 0, None, None
        state = START
        for k, (r, at) in enumerate(zip(rows, reversed(vectors), strict=True)):
            sums["illegal"] += k > 0 and initial + r["first_initial"] not in _LEGAL
            initial = r["last_initial"]
            if r["last_turn"] is not None:
                first = r["first_turn"] if first is None else first
                distinct += r["turns"] - (turn == r["first_turn"])
                turn = last = r["last_turn"]
            yield (conv, r["part"], r["chunk"], at, state, k == len(rows) - 1, *[None] * 6)
            state = int(_unpack(r["summary"])[2][at][state])
        gaps = 0 if last is None else last - first + 1 - distinct
        yield (conv, None, None, None, None, None, gaps, *[sums[c] for c in _COUNTS[1:]], cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's vector at the right and entering state, and a row of counts for each conversation."""
        worker.forget()
        types = None
        held: list[dict] = []
        out: list[tuple] = []
        begun, at = False, None

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema.names]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            types = types or [batch.schema.field("conv").type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6]
            for row in batch.to_pylist():
                if held and row["conv"] != at:
                    out += one(at, held)
                    held = []
                    if len(out) > 5000:
                        yield emit()
                        out.clear()
                at = row["conv"]
                held.append(row)
                begun = True
        if begun:
            out += one(at, held)
            yield emit()

    return run


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per turn: its letters, their roles, and the roles of turns to add behind the last one."""
    worker.forget()
    names = ["part", "idx", "letters", "roles", "after"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            symbols = np.array([SYMBOLS.index(c) for c in row["symbols"]])
            turns = expand(symbols, row["right"], row["state"])
            for k, (letters, state) in enumerate(turns):
                roles, after = roles_from(state, letters), []
                if row["last"] and k == len(turns) - 1:
                    to = tables_exit(symbols[k], letters, state)
                    after = roles_from(to, "I" * closing(to))
                out.append((row["part"], row["first_idx"] + k, letters, roles, after))
        cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def tables_exit(symbol: int, letters: str, state: int) -> int:
    """State behind a turn that was treated so."""
    for letter in letters:
        if letter == "K":
            state = SYSTEM if symbol % 4 == 0 else NEXT[state]
        elif letter != "D":
            state = NEXT[state]
    return state


def _spoken(schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Audit and digest of each conversation, from its turns in order; texts are not held."""
        worker.forget()
        conv_type, begun, conv, digest, audit, said = None, False, None, None, [], False
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (conv_type, pa.string(), pa.string()), strict=True)], names=schema.names)

        for batch in batches:
            conv_type = conv_type or batch.schema.field("conv").type
            for row in batch.to_pylist():
                if not begun or row["conv"] != conv:
                    if begun:
                        out.append((conv, "".join(audit), digest.hexdigest()))
                    begun, conv, digest, audit, said = True, row["conv"], hashlib.sha256(), [], False
                audit.append(row["letters"] + "I" * len(row["after"]))
                for role, text in _turns(row):
                    digest.update((("\n" if said else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    said = True
            if len(out) > 5000:
                yield emit()
                out.clear()
        if begun:
            out.append((conv, "".join(audit), digest.hexdigest()))
            yield emit()

    return run


def _turns(row: dict) -> Iterator[tuple[str, str]]:
    for letter, role in zip(row["letters"], row["roles"], strict=True):
        if letter == "I":
            yield role, ""
        elif letter != "D":
            yield role or row["role"], row["text"]
    for role in row["after"]:
        yield role, ""


_BLANK = r"[\x20\x09-\x0D]"


def _symbol(role: Column, text: Column, again: Column) -> tuple[Column, Column]:
    """The first fault of a turn, and its symbol."""
    bare = F.regexp_replace(text, _BLANK, "")
    fault = F.when(bare == "", "blank").when(again, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return fault, F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(known)).otherwise(known)


class Repair:
    """Repair of a table of turns: ``conversations``, ``repaired`` and ``audits`` are lazy over written tables.

    Turns of a conversation are ordered by turn number (nulls first), then role, then text; null roles and texts are one space.
    Ids may be of any type that sorts; null ids are one conversation.  Rows that are wholly equal are repeats, of which the first stays.
    Other columns are not read, under any names.  An empty table gives empty results.
    """

    def __init__(self, turns: DataFrame, scratch: Scratch, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK):
        spark = turns.sparkSession
        space = F.lit(" ")
        rows = turns.select(column(conv_id).alias("conv"), column(turn).cast("bigint").alias("turn"), F.coalesce(column(role).cast("string"), space).alias("role"), F.coalesce(column(text).cast("string"), space).alias("text"))
        number = [StructField("part", IntegerType()), StructField("chunk", IntegerType()), StructField("idx", LongType())]
        schema = StructType([*number, *rows.schema.fields])
        dealt = rows.repartitionByRange(partitions(spark), "conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
        self.placed = scratch.put(dealt.mapInArrow(_place(schema, chunk_rows), schema), "placed")
        p = self.placed
        # The first row that says the same, by conversation: combined on the map side, and joined back by place.
        first = p.groupBy("conv", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("said")).agg(F.min(F.struct("part", "idx")).alias("at")).select("at.*").withColumn("new", F.lit(True))
        fault, symbol = _symbol(F.col("role"), F.col("text"), F.col("new").isNull())
        coded = p.join(first, ["part", "idx"], "left").select("conv", "part", "chunk", "idx", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), symbol.alias("symbol"))
        listed = F.array_sort(F.collect_list(F.struct("idx", "symbol", "initial")))
        one = lambda k: F.sum((F.col("fault") == k).cast("long"))
        pairs = F.transform(F.sequence(F.lit(2), F.size("all")), lambda k: F.concat(F.element_at("all", k - 1)["initial"], F.element_at("all", k)["initial"]))
        illegal = F.when(F.size("all") < 2, 0).otherwise(F.size(F.filter(pairs, lambda x: ~x.isin(*_LEGAL)))).cast("bigint")
        chunks = coded.groupBy("part", "chunk").agg(F.first("conv").alias("conv"), listed.alias("all"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.size(F.collect_set("turn")).cast("bigint").alias("turns"), *[F.coalesce(one(k), F.lit(0)).alias(k) for k in _COUNTS[1:4]])
        ends = [F.element_at("all", k)["initial"].alias(n) for k, n in ((1, "first_initial"), (-1, "last_initial"))]
        chunks = chunks.select("conv", "part", "chunk", F.element_at("all", 1)["idx"].alias("first_idx"), F.array_join(F.transform("all", lambda x: x["symbol"]), "").alias("symbols"), "first_turn", "last_turn", "turns", *_COUNTS[1:4], illegal.alias("illegal"), *ends)
        with_sum = StructType([*chunks.schema.fields, *StructType.fromDDL("summary binary").fields])
        chunks = scratch.put(chunks.mapInArrow(_summarise(with_sum), with_sum), "chunks")
        conv = StructField("conv", chunks.schema["conv"].dataType)
        folded = StructType([conv, *StructType.fromDDL("part int, chunk int, right int, state int, last boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint").fields])
        self._folded = scratch.put(chunks.drop("symbols", "first_idx").repartition(partitions(spark), "conv").sortWithinPartitions("conv", "part", "chunk").mapInArrow(_fold(folded), folded), "folded")
        found = self._folded.where("part is not null").select("part", "chunk", "right", "state", "last")
        work = chunks.select("part", "chunk", "first_idx", "symbols").join(found, ["part", "chunk"])
        self.edits = scratch.put(work.mapInArrow(_edits, "part int, idx bigint, letters string, roles array<string>, after array<string>"), "edits")
        self._treated = p.join(self.edits, ["part", "idx"])
        self._digests = StructType([conv, StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def conversations(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost: a row for each conversation with turns."""
        return self._folded.where("part is null").select("conv", *_COUNTS, "cost")

    def repaired(self) -> DataFrame:
        """conv, place (sorts a conversation's turns), role, text: the turns that stay or are added."""
        turn = "struct<role:string,text:string>"
        own = F.zip_with(F.split("letters", ""), "roles", lambda x, r: F.when(x == "I", F.struct(r.alias("role"), F.lit("").alias("text"))).when(x != "D", F.struct(F.coalesce(r, F.col("role")).alias("role"), F.col("text").alias("text"))))
        after = F.transform("after", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
        every = F.filter(F.concat(own.cast(f"array<{turn}>"), after.cast(f"array<{turn}>")), lambda x: x.isNotNull())
        return self._treated.select("conv", "part", "idx", F.posexplode(every).alias("k", "t")).select("conv", F.struct("part", "idx", "k").alias("place"), "t.role", "t.text")

    def audits(self) -> DataFrame:
        """conv, audit, repaired_sha256 (``role:text`` of repaired turns, joined by newlines).

        A digest is sequential, so that one task reads a conversation's turns; it holds one at a time, and the audit.
        """
        rows = self._treated.select("conv", "part", "idx", "letters", "roles", "after", "role", "text")
        return rows.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "part", "idx").mapInArrow(_spoken(self._digests), self._digests)
