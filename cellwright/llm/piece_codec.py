"""SentencePiece-style encoding and decoding: an Aho-Corasick automaton drives a one-pass Viterbi.

The automaton holds all pieces.  At each position the matches that end there, found along the output
links, relax the best score; so a text is read once, whatever its pieces.  Scores are the
pieces' scores in the model, added along a path (the unigram criterion).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import worker
from .names import column

#: The mark for a space, what an unknown character costs below the worst piece.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Words a worker remembers, in each of two generations; longer words are encoded each time.
MEMO_WORDS, MEMO_CHARS = 400_000, 64


class PieceCodec:
    """Encoder and decoder for one table of pieces.

    ``pieces`` are (text, score); ids are positions in ``pieces``.  ``byte_ids`` has the ids of the 256
    bytes, which spell characters that no piece covers.  Where two paths have the same score, the one whose last piece is longer wins,
    position by position.
    """

    def __init__(self, pieces: list[tuple[str, float] | None], byte_ids: list[int], memo_words: int = MEMO_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes_of = [b""] * len(pieces)
        worst = 0.0
        for i, p in enumerate(pieces):
            if p:
                self.automaton.add_word(p[0], (len(p[0]), i, p[1]))
                self.bytes_of[i] = p[0].replace(SPACE, " ").encode()
                worst = min(worst, p[1])
        self.automaton.make_automaton()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        self.byte_ids, self.unknown = byte_ids, worst - UNKNOWN_PENALTY
        # Words can be encoded apart if no piece has a space after something else.
        self.by_word = not any(p and re.search(f"[^{SPACE}]{SPACE}", p[0]) for p in pieces)
        self.limit, self.young, self.old = memo_words, {}, {}

    @classmethod
    def from_file(cls, path: str, memo_words: int = MEMO_WORDS) -> PieceCodec:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) else (sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
        return cls(plain, byte_ids, memo_words)

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Best path over a text whose spaces are marked already.

        A character that is no piece by itself can be an unknown one, also where a longer piece ends with it.
        """
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0], done, known = 0.0, 0, 0  # positions up to `done` are settled; `known`: last end of a one-character piece
        for end, (size, i, score) in self.automaton.iter(text):
            end += 1
            while done < end - 1:
                done += 1
                if done != known:
                    self._unknown(best, back, done)
            before = best[end - size]
            if best[end] is None or before + score > best[end]:
                best[end], back[end] = before + score, (end - size, i)
            if size == 1:
                known = end
        while done < n:
            done += 1
            if done != known:
                self._unknown(best, back, done)
        return self._walk(text, back, best[n])

    def _unknown(self, best: list[float | None], back: list[tuple[int, int]], at: int) -> None:
        score = best[at - 1] + self.unknown
        if best[at] is None or score > best[at]:
            best[at], back[at] = score, (at - 1, -1)

    def _walk(self, text: str, back: list[tuple[int, int]], score: float) -> tuple[list[int], float]:
        out, at = [], len(text)
        while at:
            start, i = back[at]
            if i < 0:
                out += [self.byte_ids[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass"))]
            else:
                out.append(i)
            at = start
        return out[::-1], score

    def _word(self, word: str) -> tuple[bytes, float]:
        got = self.young.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                ids, score = self.viterbi(word)
                got = (np.asarray(ids, dtype="<i4").tobytes(), score)
                if len(word) > MEMO_CHARS:
                    return got
            if len(self.young) >= self.limit:
                self.young, self.old = {}, self.young
            self.young[word] = got
        return got

    def encode(self, text: str | None) -> tuple[bytes, float]:
        """Packed int32 ids and score.  A null or empty text has no ids."""
        if not text:
            return b"", 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            ids, score = self.viterbi(marked)
            return np.asarray(ids, dtype="<i4").tobytes(), score
        if SPACE + SPACE in marked or marked.endswith(SPACE):
            words = re.findall(f"{SPACE}+[^{SPACE}]*", marked)
        else:
            words = [SPACE + w for w in marked[1:].split(SPACE)]
        got = list(map(self._word, words))
        return b"".join([g[0] for g in got]), sum([g[1] for g in got])

    def decode(self, ids: list[int]) -> str:
        """Bytes of all pieces without the space put before the text."""
        raw = b"".join([self.bytes_of[i] for i in ids])
        return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


def codec_of(path: str, memo_words: int = MEMO_WORDS) -> PieceCodec:
    """One codec for each worker process, kept between tasks."""
    return worker.keep(("pieces", path, memo_words), lambda: PieceCodec.from_file(path, memo_words))


def encode_pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", digest_only: bool = False) -> DataFrame:
    """One row per row: doc_id, n_pieces, score, ids_crc32, round_trip, and ``ids`` unless ``digest_only``.

    ``round_trip`` says whether the decoded ids give the text again; only the mark U+2581 in a text prevents it,
    which decodes to a space.  Whole texts are encoded; a null text is empty.  Rows are independent: no shuffle,
    repeated rows give repeated results, an empty table gives none, other columns are not read.
    """
    names = ["doc_id", "n_pieces", "score", "ids_crc32", "round_trip"] + ([] if digest_only else ["ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts = batch.column("text").to_pylist()
                coded = [codec.encode(t) for t in texts]
                ids = [np.frombuffer(c, dtype="<i4") for c, _ in coded]
                cols = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([float(s) for _, s in coded], pa.float64()), pa.array([zlib.crc32(c) for c, _ in coded], pa.int64()), pa.array([codec.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)])]
                if not digest_only:
                    cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                yield pa.record_batch(cols, names=names)

    schema = "doc_id bigint, n_pieces bigint, score double, ids_crc32 bigint, round_trip boolean" + ("" if digest_only else ", ids array<int>")
    return docs.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).alias("text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([codec.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(column(doc_id).cast("bigint").alias("doc_id"), column(ids).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
