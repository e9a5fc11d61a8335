"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where no piece of the vocabulary can reach across, and every
segment is encoded by an agenda: adjacent symbol pairs that form a piece wait
in order of score, then place; the best is merged, and the pairs with its new
neighbours join the agenda.  Symbols that are no piece in the end fall back to
their bytes.  Segments that a task has not met before are checked, batch by
batch, against the sentencepiece library, which must agree.

Null counts as empty text; an empty text is the begin and end id alone and
decodes to an empty text.  Rows that repeat a document are encoded alike.
Very long segments cost n log n.  Spaces and the visible space mark are one
symbol to the vocabulary, so that mark decodes to a space.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
import sys
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortscan.llm.common import pick, small_batches

MARK = "▁"
#: Segments of a generation; a task keeps two, and what it meets again moves to the younger one.
KNOWN = 350_000
#: A run of signs and digits, a line end, or a run of anything else, each with the marks before it.
SIGNS = r"!-@\[-`{-~\r¡-©«-´¶-¹»-¿‐-⁞"
SEGMENT = re.compile(rf"{MARK}*(?:[{SIGNS}]+|\n|[^{SIGNS}\n{MARK}]+)|{MARK}+")


class Vocabulary:
    """A merge-type model file: pieces, scores, and the segments that can be encoded alone."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown, self.begin, self.end = lib.unk_id(), lib.bos_id(), lib.eos_id()
        self.text = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.text |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.text[self.unknown] = " ⁇ ".encode()
        for i in range(n):
            if lib.is_control(i):
                self.text[i] = b""
        # A segment stands alone only if no piece reaches from one into another.
        self.cuts = all(len(SEGMENT.findall(p)) == 1 for p in self.ids) and not any("\n" in p for p in self.ids)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment: merge the best-scored adjacent pair, the leftmost of equals, until none is left."""
        if segment in self.ids and len(segment) == 1:
            return [self.ids[segment]]
        scores = self.scores
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []
        for i in range(n - 1):
            s = scores.get(segment[i: i + 2])
            if s is not None:
                waiting.append((-s, i, 2))
        heapq.heapify(waiting)
        while waiting:
            _, i, size = heapq.heappop(waiting)
            left = symbols[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = left + symbols[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                s = scores.get(symbols[i] + symbols[k])
                if s is not None:
                    heapq.heappush(waiting, (-s, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                s = scores.get(symbols[h] + symbols[i])
                if s is not None:
                    heapq.heappush(waiting, (-s, h, size + len(symbols[h])))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def learn(self, segments: list[str], check: bool = True) -> None:
        """Encode segments that are new, and hold them against the library."""
        found = [self.agenda(s) for s in segments]
        if check and self.cuts:
            # A line end never merges; behind it no mark is put before the segment.
            expected = self.library.encode(["\n" + s for s in segments], num_threads=1)
            skip = len(self.library.encode("\n"))
            for s, ours, theirs in zip(segments, found, expected):
                if ours != theirs[skip:]:
                    raise AssertionError(f"the library encodes {s[:80]!r} differently")
        elif check:
            for s, ours in zip(segments, found):
                if ours != self.library.encode(s[1:]):
                    raise AssertionError(f"the library encodes {s[:80]!r} differently")
        self.known.update((s, _packed(ids)) for s, ids in zip(segments, found))

    def encode_batch(self, texts: list[str | None], check: bool = True) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers, with begin and end id."""
        cut = [self.segments(t) for t in texts]
        distinct: set[str] = set()
        for parts in cut:
            distinct.update(parts)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.known, self.older, new = {}, self.known, distinct
        again = {s: self.older[s] for s in new if s in self.older}
        self.known.update(again)
        self.learn(sorted(new.difference(again)), check)
        known, first, last = self.known, _packed([self.begin]), _packed([self.end])
        return [first + b"".join([known[s] for s in parts]) + last for parts in cut]

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return SEGMENT.findall(marked) if self.cuts else [marked]

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that form no character become replacement marks."""
        text = self.text
        out = b"".join([text[i] for i in _unpacked(ids)]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _unpacked(ids: bytes) -> array:
    a = array("I")
    a.frombytes(ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _sent(spark: SparkSession, path: str):
    """The model file (a vocabulary has a few hundred KB), read by the driver and sent to the tasks."""
    if os.path.getsize(path) > 64 << 20:
        raise ValueError("a vocabulary file of over 64 MB is not sent to the tasks")
    return spark.sparkContext.broadcast(model_bytes(path))


def encoded(documents: DataFrame, model: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids (packed) of every row of ``documents``."""
    documents = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(documents.sparkSession)
    held = _sent(documents.sparkSession, model)

    def run(batches):
        v = vocabulary(held.value)
        for b in batches:
            ids = v.encode_batch(b.column("text").to_pylist(), check)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )

    return documents.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """The columns of ``tokens`` (doc_id, n_tokens, ids) and text, decoded from the ids."""
    tokens = pick(tokens, "doc_id", "n_tokens", "ids")
    held = _sent(tokens.sparkSession, model)

    def run(batches):
        v = vocabulary(held.value)
        for b in batches:
            texts = [v.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def round_trip(documents: DataFrame, model: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Encodes and decodes in one pass, so that a task holds one Python worker.
    """
    documents = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(documents.sparkSession)
    held = _sent(documents.sparkSession, model)

    def run(batches):
        v = vocabulary(held.value)
        for b in batches:
            ids = v.encode_batch(b.column("text").to_pylist(), check)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
