"""Operator 1: token ids in flat binary files with 64-bit document offsets, read back through memory maps.

A data set is a folder and the table of its parts.  Each part has three files: ``.ids`` (unsigned 16-bit where the
vocabulary allows, else 32-bit, little-endian), ``.offsets`` (unsigned 64-bit, one more than documents, counted over
the whole data set) and ``.docs`` (signed 64-bit document ids; the least one stands for null).  Parts and documents
ascend by doc_id.  Where a part begins comes from prefix sums of the parts' totals.

Every attempt of a task writes files of its own name, which is in the table only if the attempt is the one that
counts.  Nothing is renamed or overwritten, so tasks can fail, run again or twice on any store.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.batches import pieces
from marlstone.llm.common import Memo, Workspace, documents, partitions
from marlstone.llm.pretokens import cuts

#: Letters, digits or marks, with a space before them or not: one match of ByteLevel's pattern.
_WORD = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
_BYTES = 8 << 20  # of texts that are encoded at once
_NULL_ID = np.iinfo(np.int64).min


def _letters() -> dict[int, int]:
    """ByteLevel's letter for each byte that isn't its own."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


_LETTERS = _letters()


class _Encoder:
    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        # strings that the library takes for one token wherever they stand: texts that hold one go to it whole
        self._added = [t.content for t in self._t.get_added_tokens_decoder().values()]
        # cuts() may cut texts apart for this way of pre-tokenizing only; with another one texts go to the library whole
        made = json.loads(self._t.to_str())
        way = made.get("pre_tokenizer") or {}
        self._cut = made.get("normalizer") is None and way.get("type") == "ByteLevel" and not way.get("add_prefix_space", True) and way.get("use_regex", True)
        self._dtype, self._code = dtype, "H" if dtype == "<u2" else "I"
        # what is one match of the library's pattern goes to its model at once
        model = made.get("model") or {}
        plain = self._cut and model.get("type") == "BPE" and not model.get("dropout") and not any(_WORD.fullmatch(x) for x in self._added)
        self._model = self._t.model if plain else None
        self._pieces = Memo(self._compute, 120_000)

    def _compute(self, new: list[str]) -> list[bytes]:
        out, rest = {}, []
        for x in new:
            if self._model is not None and _WORD.fullmatch(x):
                word = ("\u0120" + x[1:] if x[0] == " " else x) if x.isascii() else x.encode().decode("latin-1").translate(_LETTERS)
                ids = [t.id for t in self._model.tokenize(word)]
                out[x] = struct.pack(f"<{len(ids)}{self._code}", *ids)
            else:
                rest.append(x)
        # the fast call leaves out where in the text tokens stand, which nobody asks for
        out.update((x, np.array(e.ids, self._dtype).tobytes()) for x, e in zip(rest, self._t.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return [out[x] for x in new]

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Buffer, np.ndarray]:
        """Ids of all texts (no nulls) one behind the other in the files' type, end behind each, and where each begins
        and the last one ends, in bytes."""
        if not self._cut:
            own = [np.array(e.ids, self._dtype).tobytes() + end for e in self._t.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return pa.py_buffer(b"".join(own)), np.cumsum([0, *map(len, own)])
        texts = pa.concat_arrays([texts.cast(pa.large_string())])
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        where = cuts(raw, at[:-1])
        joined = raw.tobytes() if self._added else b""
        if any(x.encode() in joined for x in self._added):
            # such texts stay whole
            for k, t in enumerate(texts.to_pylist()):
                if any(x in t for x in self._added):
                    where = where[(where <= at[k]) | (where >= at[k + 1])]
        bounds = np.append(where, len(raw)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(bounds), pa.py_buffer(raw)).dictionary_encode()
        names = found.dictionary.to_pylist()
        known = self._pieces.known(set(names))
        values = pa.array([*map(known.__getitem__, names), end], pa.large_binary())
        first = np.searchsorted(where, at)  # the first piece of each text
        order = np.insert(found.indices.to_numpy(zero_copy_only=False), first[1:], len(names))
        ids = values.take(pa.array(order))
        places = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        held = ids.buffers()[2]
        held = held.slice(int(places[0]), int(places[-1] - places[0])) if held is not None else pa.py_buffer(b"")
        return held, places[first + np.arange(len(first))] - places[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text in the files' type."""
        ids, at = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:z].to_pybytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> _Encoder:
    return _Encoder(path, dtype)


@lru_cache(maxsize=4)
def id_dtype(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, chunks) -> None:
    fs, path = _open(uri)
    with fs.open_output_stream(path) as out:
        for c in chunks:
            out.write(c)


def _array(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is a local or mounted one."""
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write(spark: SparkSession, docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, write the files; returns the table of parts.

    Columns: part, path (without the files' endings), n_docs, n_tokens, base (tokens of all parts before).  Documents
    of one id stand side by side, in the order of their texts' hashes, so that a frequent id can fill many parts; null
    ids come first.  Texts are encoded as the library does it, strings of its added tokens included.  An empty table
    gives no parts.
    """
    dtype = id_dtype(tokenizer_path)
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    end = np.array([end_id], dtype).tobytes()
    size = len(end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, dtype)
        part = TaskContext.get().partitionId()
        where = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        ids, lens = [], []

        def chunks():
            for b in batches:
                ids.append(np.array([_NULL_ID if x is None else x for x in b["doc_id"].to_pylist()], "<i8"))
                for texts in pieces(b["text"], _BYTES):
                    out, at = encoder.encode(texts, end)
                    lens.append(np.diff(at) // size)
                    yield out

        first = next(found := chunks(), None)
        if first is None:
            return
        _put(f"{where}.ids", (c for src in ((first,), found) for c in src))
        _put(f"{where}.docs", [np.concatenate(ids).tobytes()])
        sizes = np.concatenate(lens).astype("<u8")
        _put(f"{where}.lens", [sizes.tobytes()])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [where], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([int(sizes.sum())], pa.int64())})

    n = parts or partitions(spark)
    hashed = documents(docs).withColumn("h", F.xxhash64("text"))
    ranged = hashed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    done = Workspace(spark, "token-parts").save(ranged.select("doc_id", "text").mapInArrow(encode, "part int, path string, n_docs long, n_tokens long"), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    return done.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def finish(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """Second pass: each part's lengths become offsets in the whole data set.  Returns the parts with the column
    offsets, the name of that file."""

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = []
            for path, base in zip(b["path"].to_pylist(), b["base"].to_pylist(), strict=True):
                lens = _array(f"{path}.lens", "<u8")
                at = np.concatenate([[0], np.cumsum(lens)]).astype("<u8") + np.uint64(base)
                names.append(f"{path}-{uuid.uuid4().hex}.offsets")
                _put(names[-1], [at.astype("<u8").tobytes()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], [*b.schema.names, "offsets"])

    spread = parts.repartition(partitions(spark))
    return Workspace(spark, "token-parts").save(spread.mapInArrow(offsets, T.StructType([*parts.schema.fields, T.StructField("offsets", T.StringType())])), "offsets")


def read(spark: SparkSession, parts: DataFrame, dtype: str, digest: bool = False) -> DataFrame:
    """Documents of finished parts: doc_id, start, n_tokens and ids (array), or with digest ids_crc32 instead of ids."""
    kind = "ids_crc32 long" if digest else "ids array<long>"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offsets in zip(b["path"].to_pylist(), b["offsets"].to_pylist(), strict=True):
                docs, at, ids = _array(f"{path}.docs", "<i8"), _array(offsets, "<u8"), _array(f"{path}.ids", dtype)
                base = int(at[0])
                for i in range(0, len(docs), 1000):
                    own = np.asarray(docs[i : i + 1000])
                    cut = np.asarray(at[i : i + 1001]).astype(np.int64)
                    texts = [ids[a - base : z - base] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in texts], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in texts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == _NULL_ID), pa.array(cut[:-1]), pa.array(np.diff(cut)), last], ["doc_id", "start", "n_tokens", kind.split()[0]])

    return parts.select("path", "offsets").repartition(partitions(spark)).mapInArrow(load, f"doc_id long, start long, n_tokens long, {kind}")
