"""Operator 4: removing long repeated strings by bucket-pointer refinement.

Sorting every suffix would move some sixteen bytes for each byte of text.  A string of the wanted length is instead
named by its anchor: the 16-gram with the least hash in it, the leftmost on ties, which equal strings have at the same
offset.  Positions with one anchor form an interval, cut at fixed offsets, so that a bucket holds the positions of one
anchor whose strings have the same offsets' block.  Initial buckets are formed by the q-gram that all strings of a
block share.  A bucket with one member is final: nothing in it repeats.  Members that agree on everything that their
strings cover are final too: all of them repeat.  What is left is refined: the block is cut into smaller ones, and a
member's new bucket is named by its old bucket's identifier and what stands at the offsets before and behind the old
q-gram.  Identifiers of one round are the keys of the next, down to single positions, where both tests agree.

Symbols are the bytes of a text or, to find passages by their number of words, 32-bit hashes of its words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Workspace, documents

_CHUNK = 1 << 22  # positions treated at once in a long text; a place in a chunk has 24 bits
_FANOUT = 14
_PIECE = 1 << 20  # bytes of words hashed at once
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: A passage is a string of so many words, so any of more words holds one.
PASSAGE_WORDS = 50
#: Keys of up to so many rows (some tens of MB) are broadcast after they are counted; more are shuffled.
BROADCAST_ROWS = 1_000_000

_ROWS = "rk binary, at long, lo int, hi int, start long, stop long, c long, w1 long, w2 long, n int"


@dataclass(frozen=True)
class Symbols:
    """What a text is a string of: unit bytes a symbol, gram symbols an anchor, blocks of offsets to start from."""

    unit: int
    gram: int
    blocks: int

    def of(self, raws: list[bytes]) -> list[bytes]:
        return raws if self.unit == 1 else word_codes(raws)


BYTES, WORDS = Symbols(1, 16, 2), Symbols(4, 8, 1)


def _is_space() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


_SPACE = _is_space()


def _weighed(letters: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What each letter adds to its word's sum, by its place in the word."""
    by = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    by ^= by >> np.uint64(29)
    by *= np.uint64(0xBF58476D1CE4E5B9)
    return (letters.astype(np.uint64) + np.uint64(1)) * (by | np.uint64(1))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype("<u4")


def _codes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin, 32-bit hash) of each word: sums of bytes times a multiplier for their place in the word, mixed."""
    b = np.frombuffer(joined, np.uint8)
    gap = np.concatenate([[True], _SPACE[b], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return begin, np.empty(0, np.uint32)
    inside = np.flatnonzero(~gap[1:-1])
    size = end - begin
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, size)
    return begin, _mixed(np.add.reduceat(_weighed(b[inside], place), first))


def _code_of_long(word: memoryview) -> np.ndarray:
    """The same hash of one word of any length, summed by pieces."""
    total = np.zeros(1, np.uint64)
    for at in range(0, len(word), _PIECE):
        letters = np.frombuffer(word[at : at + _PIECE], np.uint8)
        total += _weighed(letters, np.arange(at, at + len(letters))).sum(dtype=np.uint64)
    return _mixed(total)


def word_codes(raws: list[bytes]) -> list[bytes]:
    """Words (between ASCII white space) of each text as 32-bit hashes; about a MiB of text is held as numbers at once."""
    out: list[list[bytes]] = [[] for _ in raws]
    group: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not group:
            return
        starts = np.cumsum([0, *[len(p) + 1 for _, p in group]])
        begin, code = _codes(b" ".join(p for _, p in group))
        cut = np.searchsorted(begin, starts)
        for (i, _), a, z in zip(group, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[i].append(code[a:z].tobytes())
        group.clear()

    held = 0
    for i, raw in enumerate(raws):
        at = 0
        while at < len(raw):
            end = at + _PIECE
            if end < len(raw):
                space = max(raw.rfind(bytes([c]), at, end) for c in (0x20, *range(0x09, 0x0E)))
                if space < 0:  # inside a long word, which begins here
                    flush()
                    held = 0
                    blank = _BLANK.search(raw, end)
                    end = blank.start() if blank else len(raw)
                    out[i].append(_code_of_long(memoryview(raw)[at:end]).tobytes())
                    at = end
                    continue
                end = space + 1
            piece = raw[at:end]
            group.append((i, piece))
            held += len(piece)
            at = end
            if held >= _PIECE:
                flush()
                held = 0
    flush()
    return [b"".join(x) for x in out]


def anchors(raw: bytes, at: int, length: int, symbols: Symbols = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) of the runs of positions in a chunk from symbol at with one anchor, in symbols of raw."""
    unit, gram = symbols.unit, symbols.gram
    part = raw[at * unit : (at + _CHUNK + length - 1) * unit]
    n = len(part) // unit
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none
    half = 8 // unit  # symbols in 8 bytes
    words = np.ndarray((n - half + 1,), "<u8", part, strides=(unit,)).copy()
    count = n - gram + 1
    h = words[:count] * np.uint64(0x9E3779B97F4A7C15)
    for i, k in enumerate(range(half, gram, half)):
        h ^= words[k : k + count] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * i)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    width = length - gram + 1
    size = -(-len(key) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    anchor = (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    cut = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [m - 1]])
    return anchor[first] + at, first + at, last + at


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _names(text: bytes, unit: int, origin: int, at: int, lo: int, hi: int, start: int, stop: int, length: int, seed: int, old: tuple[int, int] | None) -> tuple[int, int, int]:
    """Identifiers of a member: its bucket (from the old one's and the new offsets only), and all that it covers.

    text begins at symbol origin; old: the block that seed is the identifier of.
    """
    import xxhash

    def part(a: int, z: int) -> bytes:
        return text[(a - origin) * unit : (z - origin) * unit]

    a, z = at - lo, at - hi + length
    if old is None:
        c = xxhash.xxh3_64_intdigest(part(a, z), lo)
    else:
        before, behind = part(a, at - old[0]), part(at - old[1] + length, z)
        c = xxhash.xxh3_64_intdigest(b"%d %d %d|" % (seed, lo, len(before)) + before + behind)
    w = xxhash.xxh3_128_intdigest(part(start, stop + length))
    return _signed(c), _signed(w >> 64), _signed(w & ((1 << 64) - 1))


def _first_round(docs: DataFrame, length: int, symbols: Symbols) -> DataFrame:
    """Members of the initial buckets; n: how often what they cover was met in this batch, whose repeats come as
    resolved spans (lo -1) side by side, so runs of one character or hot copies stay few rows."""
    unit = symbols.unit
    blocks = _blocks(length, symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                yield from one(b.slice(at, 2000))

    def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        seen: dict[tuple[int, int], int] = {}
        spans: list[tuple[int, int, int]] = []
        for rk, raw in zip(b["rk"].to_pylist(), symbols.of(b["raw"].to_pylist()), strict=True):
            for chunk in range(0, max(1, len(raw) // unit - length + 1), _CHUNK):
                own: list[tuple[int, int]] = []
                found, first, last = anchors(raw, chunk, length, symbols)
                for lo, hi in blocks:
                    p, q = np.maximum(first, found - hi), np.minimum(last, found - lo)
                    ok = p <= q
                    for a, s, e in zip(found[ok].tolist(), p[ok].tolist(), q[ok].tolist(), strict=True):
                        c, w1, w2 = _names(raw, unit, 0, a, lo, hi, s, e, length, 0, None)
                        i = seen.setdefault((w1, w2), len(rows))
                        if i < len(rows):
                            rows[i][9] += 1
                            own.append((s, e))
                        else:
                            rows.append([rk, a, lo, hi, s, e, c, w1, w2, 1])
                for s, e in sorted(own):
                    if spans and spans[-1][0] == rk and spans[-1][2] + 1 >= s >= spans[-1][1]:
                        spans[-1] = (rk, spans[-1][1], max(e, spans[-1][2]))
                    else:
                        spans.append((rk, s, e))
        rows += [[rk, 0, -1, -1, s, e, 0, 0, 0, 0] for rk, s, e in spans]
        if rows:
            yield _batch(rows)

    return docs.select("rk", "raw").mapInArrow(run, _ROWS)


def _blocks(length: int, symbols: Symbols) -> list[tuple[int, int]]:
    """Offsets that an anchor can have in a string, in so many equal blocks."""
    n = length - symbols.gram + 1
    cuts = [n * i // symbols.blocks for i in range(symbols.blocks + 1)]
    return [(a, z - 1) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def _batch(rows: list) -> pa.RecordBatch:
    i32, i64 = pa.int32(), pa.int64()
    kinds = (pa.binary(), i64, i32, i32, i64, i64, i64, i64, i64, i32)
    names = [x.split()[0] for x in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _identity(*parts: Column | str) -> Column:
    """128 bits that stand for all parts: rows and members are told apart by them alone."""
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _resolve(ws: Workspace, members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(members all of whose positions repeat, members to refine): the latter are the open ones, and one of each set
    of final ones that an open one shares its bucket with."""
    shared = ws.save(members.groupBy("c").agg(F.sum("n").alias("k")).where("k > 1").select("c"), f"{name}-buckets")
    alive = ws.save(members.join(_small(shared), "c", "left_semi"), f"{name}-alive")
    equal = ws.save(alive.groupBy("w1", "w2").agg(F.sum("n").alias("k")).where("k > 1").select("w1", "w2"), f"{name}-equal")
    known = _small(equal)
    whole = ws.save(alive.join(known, ["w1", "w2"], "left_semi").select("rk", "start", "stop"), f"{name}-spans")
    unsure = ws.save(alive.join(known, ["w1", "w2"], "left_anti").where("hi > lo"), f"{name}-open")
    buckets = _small(ws.save(unsure.select("c").distinct(), f"{name}-open-buckets"))
    partners = alive.where("hi > lo").join(known, ["w1", "w2"], "left_semi").join(buckets, "c", "left_semi").groupBy("w1", "w2").agg(F.min(F.struct("rk", "at", "lo", "hi", "start", "stop", "c")).alias("m"))
    more = partners.select("m.*", "w1", "w2", F.lit(2).alias("n"), F.lit(False).alias("open"))
    rest = unsure.withColumn("open", F.lit(True)).unionByName(more).withColumn("wid", _identity(F.hex("rk"), "at", "lo", "start"))
    rest = ws.save(rest, f"{name}-rest")
    ws.drop(shared, alive, equal, unsure)
    return whole, rest


def _refine(windows: DataFrame, length: int, unit: int) -> DataFrame:
    """Members of the next round's buckets; windows: members with wid, origin, window (the symbols around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                step = max(1, -(-(r["hi"] - r["lo"] + 1) // _FANOUT))
                for lo in range(r["lo"], r["hi"] + 1, step):
                    hi = min(lo + step - 1, r["hi"])
                    s, e = max(r["start"], r["at"] - hi), min(r["stop"], r["at"] - lo)
                    if s <= e:
                        names = _names(r["window"], unit, r["origin"], r["at"], lo, hi, s, e, length, r["c"], (r["lo"], r["hi"]))
                        rows.append([r["rk"], r["at"], lo, hi, s, e, *names, r["n"], r["open"], r["wid"]])
            if rows:
                yield pa.RecordBatch.from_arrays([*_batch([x[:10] for x in rows]).columns, pa.array([x[10] for x in rows]), pa.array([x[11] for x in rows])], [*(x.split()[0] for x in _ROWS.split(", ")), "open", "wid"])

    return windows.mapInArrow(run, _ROWS + ", open boolean, wid binary")


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = 400, symbols: Symbols = BYTES) -> DataFrame:
    """rk, start, stop: runs of positions of the rows of docs (rk, raw binary) whose string of length symbols also
    starts elsewhere.  Runs of a row can overlap or touch."""
    ws = Workspace(spark, "suffix-dedup")
    unit = symbols.unit
    first = ws.save(_first_round(docs, length, symbols), "first")
    spans = [ws.save(first.where("lo < 0").select("rk", "start", "stop"), "met-spans")]
    whole, rest = _resolve(ws, first.where("lo >= 0"), "r0")
    ws.drop(first)
    spans.append(whole)

    # the symbols around each member to refine, cut from their texts once
    per_text = rest.groupBy("rk").agg(F.collect_set(F.struct("wid", "start", "stop")).alias("m"))
    own = ws.save(rest.select("rk").distinct(), "texts")
    held = docs.select("rk", "raw").join(_small(own), "rk", "left_semi").dropDuplicates(["rk"]).join(per_text, "rk")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wid, origin, window = [], [], []
            for raw, members in zip(symbols.of(b["raw"].to_pylist()), b["m"].to_pylist(), strict=True):
                for m in members:
                    wid.append(m["wid"])
                    origin.append(m["start"])
                    window.append(raw[m["start"] * unit : (m["stop"] + length) * unit])
            yield pa.RecordBatch.from_arrays([pa.array(wid, pa.binary()), pa.array(origin, pa.int64()), pa.array(window, pa.binary())], ["wid", "origin", "window"])

    windows = ws.save(held.select("raw", "m").mapInArrow(cut, "wid binary, origin long, window binary"), "windows")
    ws.drop(own)
    size, step = max(hi - lo + 1 for lo, hi in _blocks(length, symbols)), 0
    while size > 1:
        step += 1
        size = -(-size // _FANOUT)
        members = ws.save(_refine(rest.join(windows.dropDuplicates(["wid"]), "wid"), length, unit), f"r{step}-members")
        ws.drop(rest)
        shared = ws.save(members.groupBy("c").agg(F.sum("n").alias("k")).where("k > 1").select("c"), f"r{step}-buckets")
        alive = ws.save(members.join(_small(shared), "c", "left_semi"), f"r{step}-alive")
        ws.drop(members, shared)
        equal = ws.save(alive.groupBy("w1", "w2").agg(F.sum("n").alias("k")).where("k > 1").select("w1", "w2"), f"r{step}-equal")
        known = _small(equal)
        spans.append(ws.save(alive.where("open").join(known, ["w1", "w2"], "left_semi").select("rk", "start", "stop"), f"r{step}-spans"))
        if size == 1:
            ws.drop(alive, equal)
            break
        unsure = ws.save(alive.where("open and hi > lo").join(known, ["w1", "w2"], "left_anti"), f"r{step}-open")
        buckets = _small(ws.save(unsure.select("c").distinct(), f"r{step}-open-buckets"))
        others = alive.join(known, ["w1", "w2"], "left_semi").where("hi > lo").unionByName(alive.where("not open and hi > lo").join(known, ["w1", "w2"], "left_anti")).join(buckets, "c", "left_semi")
        partners = others.groupBy("w1", "w2").agg(F.min(F.struct("rk", "at", "lo", "hi", "start", "stop", "c", "wid")).alias("m"), F.max("n").alias("n1"), F.count("*").alias("k"))
        more = partners.select("m.*", "w1", "w2", F.least(F.greatest(F.col("n1"), F.col("k")), F.lit(2)).cast("int").alias("n"), F.lit(False).alias("open"))
        rest = ws.save(unsure.unionByName(more), f"r{step}-rest")
        ws.drop(alive, equal, unsure)
    ws.drop(windows)
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def _runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of [begin, end) intervals."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def remove(spark: SparkSession, docs: DataFrame, length: int = 400, passage: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), n_passage_words of every row of docs.

    A byte goes if a string of length bytes that covers it also starts anywhere else in docs, in the same text
    included; strings don't cross texts.  Null texts are empty; texts under length bytes stay whole.  Rows with equal
    id and text are treated alike (each repeats the other).

    n_passage_words counts the words that a string of passage words covers which also starts anywhere else: it finds
    repeated passages of short words too, which have fewer than length bytes.  Nothing is removed for it.
    """
    keyed = documents(docs).select("doc_id", F.col("text").cast("binary").alias("raw"), _identity(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("rk"))
    of_bytes = repeated_spans(spark, keyed, length).withColumn("words", F.lit(False))
    of_words = repeated_spans(spark, keyed, passage, WORDS).withColumn("words", F.lit(True))
    spans = of_bytes.unionByName(of_words).groupBy("rk").agg(F.collect_set(F.struct("words", "start", "stop")).alias("spans"))
    joined = keyed.join(spans, "rk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, own in zip(b["raw"].to_pylist(), b["spans"].to_pylist(), strict=True):
                runs = _runs([(x["start"], x["stop"] + length) for x in own or () if not x["words"]])
                words = _runs([(x["start"], x["stop"] + passage) for x in own or () if x["words"]])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                out.append((len(raw), sum(e - s for s, e in runs), len(runs), b"".join(kept), sum(e - s for s, e in words)))
            n, gone, runs_, kept_, words_ = zip(*out, strict=True) if out else ((), (), (), (), ())
            i64 = pa.int64()
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, i64), pa.array(gone, i64), pa.array(runs_, i64), pa.array(kept_, pa.binary()), pa.array(words_, i64)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    return joined.select("doc_id", "raw", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def passage_words_by_hand(texts: list[str], passage: int) -> list[int]:
    """Brute force for tests: every string of so many words is counted."""
    words = [t.encode().split() for t in texts]
    count: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - passage + 1):
            count[tuple(w[i : i + passage])] = count.get(tuple(w[i : i + passage]), 0) + 1
    out = []
    for w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - passage + 1):
            if count[tuple(w[i : i + passage])] > 1:
                gone[i : i + passage] = b"\1" * passage
        out.append(sum(gone))
    return out


def removed_by_hand(texts: list[str], length: int) -> list[tuple[int, int, int, str]]:
    """Brute force for tests: every string of length bytes is counted."""
    raws = [t.encode() for t in texts]
    count: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r) + 1)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(r, gone, strict=False) if not g)).hexdigest()))
    return out
