"""Operator 8: byte-level BPE encoding and decoding with a two-tier lookup."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from marlstone.llm.common import Memo, bounded, documents, tidied
from marlstone.llm.pretokens import units

_MASK = (1 << 64) - 1


class MinimalPerfectHash:
    """Hash, displace: n keys fill exactly n slots; a slot keeps its key, so foreign keys are told apart."""

    def __init__(self, keys: list[bytes], values: list[int]):
        import xxhash

        self._hash = xxhash.xxh3_64_intdigest
        n = self.n = max(1, len(keys))
        self.buckets = r = max(1, n // 2)
        grouped: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = self._hash(k)
            grouped.setdefault(h % r, []).append((h, i))
        self.shift = [0] * r
        self.slots: list[bytes | None] = [None] * n
        self.values = [-1] * n
        single = []
        for b, items in sorted(grouped.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(items) == 1:
                single.append((b, items[0]))
                continue
            d = 0
            while True:
                places = [self._slot(h, d) for h, _ in items]
                if len(set(places)) == len(places) and all(self.slots[p] is None for p in places):
                    break
                d += 1
            self.shift[b] = d
            for p, (_, i) in zip(places, items, strict=True):
                self.slots[p], self.values[p] = keys[i], values[i]
        free = iter([p for p in range(n) if self.slots[p] is None])
        for b, (_, i) in single:
            p = next(free)
            self.shift[b] = -p - 1
            self.slots[p], self.values[p] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        h = (h + d * 0x9E3779B97F4A7C15) & _MASK
        return (((h ^ (h >> 32)) * 0xBF58476D1CE4E5B9 & _MASK) >> 24) % self.n

    def get(self, key: bytes) -> int:
        """The value of key, or -1."""
        h = self._hash(key)
        d = self.shift[h % self.buckets]
        p = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[p] if self.slots[p] == key else -1


def merge(piece: bytes, rank) -> list[bytes]:
    """Parts of a piece by lowest rank first, leftmost on ties: a heap over linked parts, n log n in its length."""
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        k = rank(parts[i] + parts[i + 1])
        if k is not None:
            heap.append((k, i, parts[i], parts[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if parts[i] is not a or j >= n or parts[j] is not b:
            continue  # one of the two has been merged meanwhile
        whole = parts[i] = a + b
        parts[j] = None
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            r = rank(whole + parts[k])
            if r is not None:
                heapq.heappush(heap, (r, i, whole, parts[k]))
        k = left[i]
        if k >= 0:
            r = rank(parts[k] + whole)
            if r is not None:
                heapq.heappush(heap, (r, k, parts[k], whole))
    return [p for p in parts if p is not None]


class ByteBpe:
    """Encoder and decoder over a file of ranks; ids are 32-bit."""

    def __init__(self, ranks_path: str, pattern: str, remembered: int = 200_000):
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = MinimalPerfectHash(list(self.ranks), list(self.ranks.values()))
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self._matches = regex.compile(pattern).findall
        self._cut = pattern == PATTERN  # what units() may cut apart is known for that pattern only
        self._pieces = Memo(lambda new: [self._encode_piece(x) for x in new], remembered)
        self._units = Memo(self._join_pieces, remembered)

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        known = self.words.get(raw)
        ids = [known] if known >= 0 else [self.ranks[p] for p in merge(raw, self.ranks.get)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _join_pieces(self, texts: list[str]) -> list[bytes]:
        pieces = [self._matches(x) for x in texts]
        known = self._pieces.known(set().union(*pieces))
        return [b"".join(map(known.__getitem__, x)) for x in pieces]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self._cut:
            return self._join_pieces(texts)
        own = [units(t) for t in texts]
        known = self._units.known(set().union(*own))
        return [b"".join(map(known.__getitem__, x)) for x in own]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(ranks_path: str, pattern: str, remembered: int = 200_000) -> ByteBpe:
    """One for each Python worker; the vocabulary file's path must be the same on all machines."""
    return ByteBpe(ranks_path, pattern, remembered)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of each whole text; null and empty texts have no ids.

    One row for each row of docs, repeated and null ids too; narrow, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [x for texts in bounded(part["text"].to_pylist()) for x in codec.encode_all(texts)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of a table of encode(); null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = [codec.decode(x or b"") for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, remembered: int = 200_000, tidy: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass over the texts and keeps digests.

    Null and empty texts: 0 tokens and the digests of nothing.  Ties and repeated rows: each row by itself.
    remembered: words that a task keeps the ids of, for speed only; tidy: it leaves none of them to the next task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern, remembered)
        for b in batches:
            n, one, two = [], [], []
            for texts in bounded(x.as_py() for x in b["text"]):
                for ids in codec.encode_all(texts):
                    n.append(len(ids) // 4)
                    one.append(hashlib.sha256(ids).hexdigest())
                    two.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(tidied(run) if tidy else run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
