"""Quality classification by nearest-neighbour voting in a latent semantic space.

Terms are runs of three character classes (letters in each case, digits, single marks, ...), plus
coarse terms for how much of a text repeats.  A bounded sample of labelled documents gives term
weights and the latent space (SVD).  Its vectors, labels and weights are broadcast: their size depends on the
parameters below only.  Every document is projected, compared with all labelled vectors in
blocks of exact cosine products, and scored by its nearest neighbours' labels, weighted by similarity.  Neighbours as near as the last of
them (copies, say) vote as well, and a text's score doesn't depend on the rows it is scored with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import worker
from .names import column, numbered
from .storage import small_batches

#: Fixed values.  Bound of the labelled sample, dimensions of the latent space, voting neighbours, cut.
SAMPLE_ROWS, DIMS, NEIGHBOURS, THRESHOLD = 4096, 48, 25, 0.3
#: How fast a neighbour's vote falls with 1 - cosine.
SHARPNESS = 20.0
#: Documents compared with the labelled vectors at once.
BLOCK = 1024
#: Digits of a cosine, so that equally near neighbours tie whatever else is in their block, and of a score.
DIGITS, SCORE_DIGITS = 6, 9
#: Texts held as Python objects at once.
SLICE = 512
#: Marks that are a class of their own; other ASCII marks share one.
MARKS = "\n .,!?|#$%&*-:@/'\""
_CLASSES = 6 + len(MARKS)
N_TERMS = _CLASSES**3 + 24


def _class_table() -> np.ndarray:
    table = np.full(256, 4, dtype=np.int32)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[0x80:0xC0] = 3  # continuation bytes of letters beyond ASCII
    table[0xC0:] = 5
    for k, mark in enumerate(MARKS):
        table[ord(mark)] = 6 + k
    return table


_TABLE = _class_table()


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(term, count) of a whole text; a null or empty text has only the terms for emptiness."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    classes = _TABLE[np.frombuffer(raw, dtype=np.uint8)]
    tri = (classes[:-2] * _CLASSES + classes[1:-1]) * _CLASSES + classes[2:] if len(classes) > 2 else classes[:0]
    base, weight = _CLASSES**3, max(4.0, len(raw) / 20)
    lines, words = [x for x in raw.split(b"\n") if x], raw.lower().split()
    shares = (1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / max(1, len(words)))
    extra = [base + 8 * k + min(7, int(s * 8)) for k, s in enumerate(shares)] + [base + 16 + min(7, len(raw).bit_length() // 2)]
    counts = np.bincount(tri)
    terms = np.flatnonzero(counts)
    counts = counts[terms]
    return np.concatenate([terms, extra]).astype(np.int64), np.concatenate([counts, [weight] * 3]).astype(np.float32)


@dataclass
class Model:
    """What is broadcast: at most N_TERMS * (DIMS + 1) + SAMPLE_ROWS * (DIMS + 1) numbers."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), dtype=np.float32)
        for i, text in enumerate(texts):
            terms, counts = term_counts(text)
            x = np.log1p(counts) * self.weight[terms]
            out[i] = (x / max(1e-9, float(np.sqrt(x @ x)))) @ self.axes[terms]
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        scores = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        vectors = self.vectors.astype(np.float64)
        for a in range(0, len(texts), BLOCK):
            own = self.project(texts[a : a + BLOCK])
            # Rounded products of doubles are the same in any block; all neighbours as near as the last one vote with it.
            cos = np.round(own.astype(np.float64) @ vectors.T, DIGITS)
            row, near = np.nonzero(cos >= np.partition(cos, -k, axis=1)[:, -k, None])
            votes = np.exp(SHARPNESS * (cos[row, near] - 1))
            good, every = (np.bincount(row, weights=v, minlength=len(own)) for v in (votes * self.labels[near], votes))
            # A text without any term of a labelled one has no neighbours: it scores as labelled texts do on average.
            scores[a : a + BLOCK] = np.where(own.any(axis=1), good / every, self.prior)
        return np.round(np.clip(scores, 0.0, 1.0), SCORE_DIGITS)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    y = np.asarray(labels, dtype=np.float64)
    if not len(y):
        return Model(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 1.0)
    found = [term_counts(t) for t in texts]
    return fit_terms(found, y)


def fit_terms(found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    n = len(found)
    df = np.bincount(np.concatenate([t for t, _ in found]), minlength=N_TERMS)
    weight = (np.log((1 + n) / (1 + df)) + 0.3).astype(np.float32)
    used = np.flatnonzero(df)
    at = np.full(N_TERMS, -1)
    at[used] = np.arange(len(used))
    x = np.zeros((n, len(used)), dtype=np.float32)
    for i, (terms, counts) in enumerate(found):
        x[i, at[terms]] = np.log1p(counts) * weight[terms]
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    # Right singular vectors by a few power iterations on a seeded random start.
    dims = min(DIMS, n, len(used))
    q = np.random.default_rng(0).standard_normal((len(used), dims + 8 if dims + 8 <= min(n, len(used)) else dims)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    u, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    axes = np.zeros((N_TERMS, dims), dtype=np.float32)
    axes[used] = (q @ vt.T)[:, :dims]
    v = x @ axes[used]
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    return Model(weight, axes, v.astype(np.float32), y, float(y.mean()))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled documents: those whose doc_id hashes lowest.

    ``labels(doc_id, quality)``; rows with crc32(doc_id) mod 5 = 0 are held out and never learnt.
    Only the sample's term counts reach the driver, never texts.  A label repeated for a document counts once,
    its largest value; of several texts with one doc_id that with the smallest digest is learnt; null ids and labels teach nothing; without any label every score is 1.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()
    if not len(chosen):
        return fit([], [])
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen.astype({"doc_id": "int64", "quality": "int64"}))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [term_counts(t) for t in pdf["text"]]
            digest = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "digest": digest, "terms": [t.astype(np.int32).tobytes() for t, _ in found], "counts": [c.tobytes() for _, c in found]})

    # Repetitions of an id are combined on the map side: at most sample_rows rows reach the driver.
    counted = texts.mapInPandas(count, "doc_id long, quality long, digest binary, terms binary, counts binary")
    got = counted.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min(F.struct("digest", "terms", "counts")).alias("x")).select("doc_id", "quality", "x.terms", "x.counts").toPandas().sort_values("doc_id")
    if not len(got):
        return fit([], [])
    found = [(np.frombuffer(t, np.int32).astype(np.int64), np.frombuffer(c, np.float32)) for t, c in zip(got["terms"], got["counts"], strict=True)]
    return fit_terms(found, got["quality"].to_numpy().clip(0, 1).astype(np.float64))


def held_out(name: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(column(name).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _model(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, sample_rows: int) -> Broadcast:
    small_batches(docs.sparkSession)
    named = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    return docs.sparkSession.sparkContext.broadcast(learn(named, labels, sample_rows))


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Texts become Python objects a slice at a time."""
    found = [model.score(texts.slice(a, SLICE).to_pylist()) for a in range(0, len(texts), SLICE)]
    return np.concatenate(found) if found else np.empty(0)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts get a score as well, repeated rows the same one; an empty table gives no rows.  Only texts enter a score; other columns are
    not read, whatever their names.  The model stays on the driver's broadcast; there is no shuffle of texts.
    """
    model = _model(docs, labels, doc_id, text, sample_rows)
    named = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model.value, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    out = named.mapInArrow(run, StructType([named.schema.fields[0], StructField("score", DoubleType())]))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns as they are, whatever their names."""
    model = _model(docs, labels, doc_id, text, sample_rows)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.forget()
        for batch in batches:
            yield batch.filter(pa.array(_scores(model.value, batch.column(at)) >= threshold))

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
