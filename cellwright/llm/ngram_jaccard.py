"""N-gram Jaccard join by MinHash banding.

1. One pass over the texts gives each document a digest of its words and a MinHash value for every band;
   band and row counts follow from the target recall.  Documents with equal words form a class.
2. Classes that share a band hash are candidates.  Buckets are chained, not paired, and chains that meet are one
   cluster, so that a cluster holds every pair that shares a band, and links stay linear in the rows.
3. Clusters are cut into blocks; a tile of two blocks compares the pairs that share a band on their full n-gram sets
   and returns counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import worker
from .bloom import with_maybe
from .components import connected_components
from .names import column, columns, fresh, numbered
from .storage import Scratch, partitions
from .tiles import by_tile, forest, with_tiles

#: Words in an n-gram, least similarity, target recall for a pair just at it, rows in a band.
WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
#: Classes in a block.
BLOCK_ROWS = 256
#: N-grams of a class, on average, in a full block; long texts get blocks of fewer classes.
BLOCK_GRAMS = 4096
#: White space between words.
BLANKS = b" \t\n\x0b\x0c\r"
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS)] = True


def choose_bands(threshold: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of ``rows`` rows with 1 - (1 - threshold^rows)^bands >= recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def words_of(text: str | None) -> bytes:
    """Lower-cased words, joined by single spaces, in UTF-8."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split())


_TO_SPACE = bytes(32 if _BLANK[b] else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(1 << 16)
_VALUES = _mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def shingles(joined: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all n-grams; a text with fewer words has one, of all its words; an empty one none."""
    if not joined:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(joined, dtype=np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends + 1])
    global _POW
    lengths = np.diff(np.concatenate([starts, [len(raw) + 1]])) - 1
    if (longest := int(lengths.max())) > len(_POW):
        _POW = _powers(1 << longest.bit_length())
    within = np.arange(len(raw)) - np.repeat(starts, lengths + 1)[: len(raw)]
    word = _mix(np.add.reduceat(_VALUES[raw] * _POW[np.minimum(within, len(_POW) - 1)] * (raw != 32), starts) + lengths.astype(np.uint64))
    n = min(words, len(word))
    out = np.zeros(len(word) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(3) + word[k : k + len(out)])
    return np.unique(out)


class Banding:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """A 64-bit hash per band.  Grams are cut to 32 well-mixed bits for the multiply-shift family."""
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 1024):
            part = grams[at : at + 1024]
            h = part[None, :] * self.a[:, None]
            h += self.b[:, None]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(low, h.min(axis=1), out=low)
        out = np.arange(self.bands, dtype=np.uint64)
        m = low.reshape(self.bands, self.rows)
        for k in range(self.rows):
            out = _mix(out * np.uint64(5) + m[:, k])
        return out.view(np.int64)


def _signed(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget()
        banding = Banding(bands, rows)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                nodes, found, sizes = [], [], []
                for text in batch.column("text").to_pylist():
                    joined = words_of(text)
                    nodes.append(hashlib.blake2b(joined, digest_size=16).digest() if joined else None)
                    grams = shingles(joined, words)
                    sizes.append(len(grams))
                    found.append(banding.of(grams).tolist() if joined else None)
                yield pa.record_batch([batch.column("doc_id"), batch.column("uid"), pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["doc_id", "uid", "node", "bands", "n_grams"])

    return run


#: Digests a task remembers so that repeated texts are not sent again.
SENT = 100_000


def _shingled(words: int):
    """Digest and n-grams of each text with words, most repeated texts once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                nodes, grams = [], []
                for joined in {words_of(t) for t in whole.column("text").slice(a, 256).to_pylist()} - {b""}:
                    node = hashlib.blake2b(joined, digest_size=16).digest()
                    if node not in sent:
                        sent.add(node)
                        nodes.append(node)
                        grams.append(shingles(joined, words).tobytes())
                if len(sent) > SENT:
                    sent.clear()
                yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(grams, pa.binary())], names=["node", "grams"])

    return run


def near_texts(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document row: doc_id, class_id, n_links, group_id, kept (and uid, node).

    Words are runs without the characters of ``[\\x20\\x09-\\x0D]``, lower-cased.  ``class_id`` is the smallest doc_id of the same words, ``n_links`` the
    number of other rows with a Jaccard similarity of at least ``threshold`` on the sets of their n-grams, those of the same
    words included; ``group_id`` the smallest doc_id reachable by links, and ``kept`` true for one row of each group.  Texts without words,
    null ones too, link with nothing.  A null doc_id is never smallest unless alone.  Repeated rows
    link with each other; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bands = choose_bands(threshold, recall, rows)
    source = docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text"))
    signed = scratch.put(source.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_signed(words, bands, rows), "doc_id bigint, uid bigint, node binary, bands array<bigint>, n_grams bigint"), "signed")
    classes = scratch.put(signed.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid")).alias("first"), F.first("bands").alias("bands"), F.max("n_grams").alias("n_grams")), "classes")
    buckets = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    heads = buckets.groupBy("band", "hash").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1").select("band", "hash", "head")
    chained = buckets.join(heads, ["band", "hash"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    clusters = scratch.put(connected_components(chained, scratch).withColumnRenamed("component", "cluster"), "clusters")
    # A block is full at BLOCK_ROWS classes or at BLOCK_GRAMS n-grams each on average, whatever comes first.
    # Written, so that the join below has two plain exchanges, whose large partitions adaptive execution can split.
    sizes = scratch.put(clusters.join(classes.select("node", "n_grams"), "node").groupBy("cluster").agg(F.greatest(F.count("*"), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).alias("size")), "sizes")
    members = scratch.put(clusters.join(sizes, "cluster").join(classes, "node").select("node", "cluster", "size", "n", "bands", F.col("first.doc_id").alias("rid")), "members")
    # Only ids of members are read again.  N-grams meet their class by digest, and a text is sent about once a task, so that an id on
    # many rows multiplies nothing; what several tasks send is reduced where it meets, on the partitioning of the join.
    likely = with_maybe(source, F.col("doc_id"), members.select("rid")).where("_maybe").select("text")
    grams = likely.mapInArrow(_shingled(words), "node binary, grams binary").repartition("node").groupBy("node").agg(F.first("grams").alias("grams"))
    tiled = with_tiles(members.select("node", "cluster", "size", "n", "bands").join(grams, "node"), F.col("size"), F.col("node"), block_rows).select("cluster", "bi", "bj", "own", "node", "n", "bands", "grams")

    def compare(unit: list[dict]) -> list[tuple]:
        return _compare(unit, threshold)

    found = scratch.put(by_tile(tiled, ["cluster", "bi", "bj"], 2 * partitions(spark), compare, "node binary, links bigint, parent binary"), "found")
    scratch.drop(clusters, sizes, members)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b")), scratch)
    linked = links.join(groups, "node", "left").join(classes, "node").withColumn("component", F.coalesce("component", "node"))
    linked = scratch.put(linked, "linked")
    best = scratch.put(linked.groupBy("component").agg(F.min("first").alias("best")), "best")
    of = scratch.put(linked.join(best, "component").select("node", "links", "best"), "of")
    # Rows of classes that link with no other class need no more than their class.
    per_class = scratch.put(classes.join(of, "node", "left").where("links is not null or n > 1").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("best", "first").alias("best")), "per_class")
    scratch.drop(classes, found, linked, best, of)
    out = signed.select("doc_id", "uid", "node").join(per_class, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("group_id"), F.when(F.col("best").isNull(), F.lit(True)).otherwise(F.col("best.uid") == F.col("uid")).alias("kept"), "uid", "node")


def _compare(unit: list[dict], threshold: float) -> list[tuple]:
    rows = sorted(unit, key=lambda r: r["node"])
    own = np.asarray([r["own"] for r in rows])
    same = rows[0]["bi"] == rows[0]["bj"]
    a = np.flatnonzero(own == rows[0]["bi"])
    b = a if same else np.flatnonzero(own == rows[0]["bj"])
    if not len(a) or not len(b) or same and len(a) < 2:
        return []
    bands = np.asarray([r["bands"] for r in rows], dtype=np.int64)
    share = np.zeros((len(a), len(b)), dtype=bool)
    for k in range(bands.shape[1]):
        share |= bands[a, k][:, None] == bands[b, k][None, :]
    i, j = np.nonzero(share)
    i, j = a[i], b[j]
    if same:
        i, j = i[i < j], j[i < j]
    grams = [np.frombuffer(r["grams"], dtype=np.uint64) for r in rows]
    size = np.asarray([len(g) for g in grams])
    ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
    i, j = i[ok], j[ok]
    if not len(i):
        return []
    both = _common(grams, i, j)
    ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
    i, j = i[ok], j[ok]
    n = np.asarray([r["n"] for r in rows])
    counts = np.bincount(i, weights=n[j], minlength=len(rows)) + np.bincount(j, weights=n[i], minlength=len(rows))
    up = forest(len(rows), i, j)
    return [(r["node"], int(c), rows[u]["node"] if u != k else None) for k, (r, c, u) in enumerate(zip(rows, counts, up, strict=True)) if c]


def _common(grams: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of grams[i[k]] and grams[j[k]]."""
    if len(i) <= 4 * len(grams):
        return np.asarray([len(grams[x]) - len(np.setdiff1d(grams[x], grams[y], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    # Many pairs: 0/1 matrices over the n-grams that at least two members share, some columns at a time.
    flat = np.concatenate(grams)
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    distinct, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    total, out = int(shared.sum()), np.zeros(len(i))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, total, 8192):
        lo, hi = np.searchsorted(column, [at, at + 8192])
        m = np.zeros((len(grams), min(8192, total - at)), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += (m @ m.T)[i, j]
    return np.rint(out)


def drop_near_copies(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which none of the same group stays before them, with all their columns as they are, whatever their names.

    Rows are found again by doc_id; a doc_id with both kept and dropped rows is settled by its words.  Every row without words stays.  Where
    doc_id and words both repeat, the row whose columns (but maps) hash highest stays.
    """
    marked = scratch.put(near_texts(docs, scratch, doc_id, text).select("doc_id", "node", "kept"), "marked")
    maybe, gid, rid, node, row = fresh(docs.columns, "_maybe", "_gid", "_rid", "_node", "_row")
    key = column(doc_id).cast("bigint")
    gone = scratch.put(marked.where("not kept").select(F.col("doc_id").alias(gid)).distinct(), "gone")
    repeated = marked.groupBy(F.col("doc_id").alias(rid)).agg(F.count("*").alias("n")).where("n > 1")
    clash = scratch.put(repeated.join(gone, F.col(rid).eqNullSafe(F.col(gid)), "left_semi").select(rid), "clash")
    flagged = with_maybe(docs, key, gone, maybe)
    plain = flagged.where(~F.col(maybe)).select(*columns(docs)).union(flagged.where(maybe).join(gone, key.eqNullSafe(F.col(gid)), "left_anti").select(*columns(docs)))
    if clash.isEmpty():
        return plain
    # Repeated ids: keep, for each kept (id, words), one row.
    stay = marked.where("kept and node is not null").join(clash, F.col("doc_id").eqNullSafe(F.col(rid)), "left_semi").select(F.col("doc_id").alias(rid), F.col("node").alias(f"{node}_"))
    tagged = numbered(docs.join(clash, key.eqNullSafe(F.col(rid)), "left_semi"))
    again = tagged.mapInArrow(_with_node(docs.columns.index(text)), StructType([*tagged.schema.fields, StructField("node", BinaryType())])).toDF(*docs.columns, node)
    found = again.join(stay, key.eqNullSafe(F.col(rid)) & (F.col(node) == F.col(f"{node}_")), "left_semi")
    first = F.max_by(F.struct(*columns(docs)), F.xxhash64(*[column(c) for c, t in docs.dtypes if "map<" not in t]))
    one = found.groupBy(key.alias(rid), F.col(node)).agg(first.alias(row)).select(f"{row}.*")
    return plain.union(again.where(F.col(node).isNull()).select(*columns(docs))).union(one)


def _with_node(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [words_of(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hashlib.blake2b(w, digest_size=16).digest() if w else None for w in joined], pa.binary())], names=[*batch.schema.names, "node"])

    return run
