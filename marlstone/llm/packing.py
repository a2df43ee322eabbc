"""Operator 13: documents packed into training sequences by cutting-stock patterns.

Documents shorter than a sequence stay whole where patterns hold them.  Their length histogram goes to the driver,
where a linear program (``cutting_stock``) says how many sequences have which lengths.  Documents are ranked by length
in one sort, and a rank says by arithmetic which sequence of which pattern a document belongs to.  Longer documents
fill sequences of their own; what they leave, and documents that no pattern has, are cut freely to fill the gaps of the
patterns' sequences, then sequences of their own.  The last tokens become sequences whose lengths are powers of two.
So nothing is padded at all, and patterns decide how few documents are cut for it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import cutting_stock
from marlstone.llm.common import Memo, Workspace, bounded, documents, partitions
from marlstone.llm.token_files import id_dtype

_MARKS = ".,;:!?*&%$#)"
_ODD = "\x1c\x1d\x1e\x1f"  # white space for Python, not for the tokenizer
_LONG = 64  # longer words aren't remembered


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Encoder:
    """Ids of texts.  White space ends every match of a word tokenizer's pattern, so words are encoded independently."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t, self._dtype = Tokenizer.from_file(path), dtype
        self._added = [t.content for t in self._t.get_added_tokens_decoder().values()]
        # words are cut apart for this way of reading texts only; with another one texts go to the library whole
        made = json.loads(self._t.to_str())
        norm, way = ((made.get(k) or {}).get(s, []) for k, s in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        drops = [x.get("invert") and x["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in x["pattern"].get("Regex", "") for x in way[:1]]
        self._cut = [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"] and drops == [True] and not way[1].get("add_prefix_space", True)
        suffix = made["model"].get("end_of_word_suffix")
        self._ends = None
        if suffix:
            vocab = self._t.get_vocab(with_added_tokens=False)
            self._ends = np.zeros(max(vocab.values()) + 1, bool)
            self._ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self._parts, self._words = Memo(self._pieces, 300_000), Memo(self._split, 450_000)

    def _library(self, new: list[str]) -> list[bytes]:
        return [np.array(e.ids, self._dtype).tobytes() for e in self._t.encode_batch_fast(new, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> list[bytes]:
        """Plain words are one match each and go to the library in one text: each ends with the next token that ends a word."""
        plain = [x for x in new if x.isalpha()]
        if not _latin("".join(plain)):
            plain = [x for x in plain if max(x) < "ɐ" and "İ" not in x]
        out = {}
        if plain and self._ends is not None:
            ids = np.array(self._t.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, self._dtype)
            cut = np.flatnonzero(self._ends[ids]) + 1
            if len(cut) == len(plain):
                data, size = ids.tobytes(), ids.itemsize
                out = {w: data[a:z] for w, a, z in zip(plain, [0, *(cut[:-1] * size).tolist()], (cut * size).tolist(), strict=True)}
        rest = [x for x in new if x not in out]
        out.update(zip(rest, self._library(rest), strict=True))
        return [out[x] for x in new]

    def _split(self, new: list[str]) -> list[bytes]:
        """A word and the marks behind it never share a match."""
        cores = [x.rstrip(_MARKS) for x in new]
        cores = [c if c == x or (e := c[-1:]).isalnum() and e < "ɐ" and e != "İ" else x for c, x in zip(cores, new, strict=True)]
        ends = [x[len(c) :] for c, x in zip(cores, new, strict=True)]
        known = self._parts.known({*cores, *ends} - {""})
        return [known[c] + known[e] if e else known[c] for c, e in zip(cores, ends, strict=True)]

    def _split_text(self, text: str) -> list[str] | None:
        """Words of a text; none if the library has to see it whole."""
        if not self._cut or any(x in text for x in self._added) or any(x in text for x in _ODD):
            return None
        return (text.lower() if _latin(text) else text).split()  # the tokenizer's own way, letter by letter, is the same there

    def encode_all(self, texts: list[str]) -> list[bytes]:
        own = [self._split_text(t) for t in texts]
        words = set().union(*filter(None, own))
        long = {x for x in words if len(x) > _LONG}
        known = self._words.known(words - long)
        if not long:
            return [b"".join(itemgetter(*x)(known) if len(x) > 1 else map(known.__getitem__, x)) if x is not None else self._library([t])[0] for t, x in zip(texts, own, strict=True)]
        once = dict(zip(long, self._library(list(long)), strict=True))
        return [b"".join(once[w] if w in once else known[w] for w in x) if x is not None else self._library([t])[0] for t, x in zip(texts, own, strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> _Encoder:
    return _Encoder(path, dtype)


def tokens(ws: Workspace, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """row (unique), doc_id, n, ids (little-endian) of every whole text with the end id, saved."""
    dtype = id_dtype(path)
    end = np.array([end_id], dtype).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _encoder(path, dtype), len(end)
        for b in batches:
            ids, at = b["doc_id"].cast(pa.int64()), 0
            for texts in bounded((x.as_py() for x in b["text"]), 3 << 20):
                out = [x + end for x in encoder.encode_all(texts)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(out)), pa.array([len(x) // size for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "ids"])
                at += len(out)

    made = documents(docs).mapInArrow(encode, "doc_id long, n long, ids binary")
    return ws.save(made.select(F.monotonically_increasing_id().alias("row"), "*"), "tokens")


def running(ws: Workspace, df: DataFrame, keys: list[Column], weight: str, name: str) -> tuple[DataFrame, int]:
    """Adds idx (place in the order of keys) and before (sum of weights before), and gives the sum of all weights.

    A range sort; tasks count up their rows, and sums over parts, a row each, say where a part begins.  keys have to
    tell all rows apart, so that no value fills a part.
    """
    spark = df.sparkSession
    fields = [T.StructField(c, T.LongType()) for c in ("part", "i", "own")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            w = b[weight].to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(w) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(w), part)), pa.array(np.arange(i, i + len(w))), pa.array(upto - w)], [*b.schema.names, "part", "i", "own"])
            i, total = i + len(w), int(upto[-1])

    ranged = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    saved = ws.save(ranged.mapInArrow(count, T.StructType([*df.schema.fields, *fields])), name)
    sums = saved.groupBy("part").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).orderBy("part").collect()  # a row for each partition
    rows, at, w = [], 0, 0
    for s in sums:
        rows.append((s["part"], at, w))
        at, w = at + s["n"], w + s["w"]
    bases = spark.createDataFrame(rows, "part long, first long, base long")
    return saved.join(F.broadcast(bases), "part").select(*df.columns, (F.col("first") + F.col("i")).alias("idx"), (F.col("base") + F.col("own")).alias("before")), w


class Plan:
    """What the driver makes of the histogram: where ranks go, and how many sequences there are of each kind.

    histogram has the number of documents of each length below capacity; full and rest are the full sequences and the
    tokens beyond them of all longer documents.  Sequences are numbered: patterns', loose tokens', full ones.
    """

    def __init__(self, histogram: dict[int, int], longer: int, rest: int, capacity: int, gap: float):
        tops = sorted({cutting_stock.top(n) for n in histogram})
        place = {t: i for i, t in enumerate(tops)}
        demand = np.zeros(len(tops), np.int64)
        for n, c in histogram.items():
            demand[place[cutting_stock.top(n)]] += c
        found, self.bound = cutting_stock.patterns(np.array(tops, np.int64), demand, capacity, gap)
        loose = rest + sum(n * c for n, c in histogram.items())
        # so many sequences can be filled to the last token; the least full patterns beyond them are given up
        room = loose // capacity
        begin = longer + np.concatenate([np.cumsum(demand[::-1])[::-1][1:], [0]]).astype(np.int64)  # ranks go from long to short
        spans, self.patterned = [], 0
        for p in found:
            times, slot = min(p.times, room - self.patterned), 0
            if times <= 0:
                break
            for i in np.flatnonzero(p.counts)[::-1].tolist():
                size = int(p.counts[i]) * times
                spans.append((int(begin[i]), int(begin[i]) + size, self.patterned, times, slot))
                begin[i] += size
                slot += int(p.counts[i])
            self.patterned += times
        spans.sort()
        self.spans = np.array(spans, np.int64).reshape(-1, 5).T
        left = loose - capacity * self.patterned
        self.loose, tail = divmod(left, capacity)
        self.tails = [1 << k for k in reversed(range(tail.bit_length())) if tail >> k & 1]

    def place(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence and place in it of ranks, and whether a pattern has them."""
        lo, hi, base, times, slot = self.spans
        if not len(lo):
            return idx, idx, np.zeros(len(idx), bool)
        j = np.searchsorted(lo, idx, "right") - 1
        has = (j >= 0) & (idx < hi[j])
        q = idx - lo[j]
        return base[j] + q % times[j], slot[j] + q // times[j], has


def _placed(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Adds sequence_id and slot; null where no pattern has the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, slot, has = plan.place(b["idx"].to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq, pa.int64(), mask=~has), pa.array(slot, pa.int64(), mask=~has)], [*b.schema.names, "sequence_id", "slot"])

    return ranked.mapInArrow(run, T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())]))


def _fill(items: DataFrame, gaps: DataFrame, size: int) -> DataFrame:
    """Pieces of items (row, start, length, before) in gaps (sequence_id, offset, room, before).

    Both lie one behind the other on one line of tokens; they meet by the bins of that line that they touch.
    """
    bins = lambda at, n: F.explode(F.sequence(F.expr(f"{at} div {size}"), F.expr(f"({at} + {n} - 1) div {size}")))
    i = items.select("row", "start", "length", F.col("before").alias("f"), bins("before", "length").alias("bin"))
    g = gaps.select("sequence_id", "offset", "room", F.col("before").alias("g"), bins("before", "room").alias("bin"))
    begin, end = F.greatest("f", "g"), F.least(F.col("f") + F.col("length"), F.col("g") + F.col("room"))
    met = i.join(g, "bin").where((begin < end) & (F.floor(begin / size) == F.col("bin")))
    return met.select("row", (F.col("start") + begin - F.col("f")).alias("start"), (end - begin).alias("length"), "sequence_id", (F.col("offset") + begin - F.col("g")).alias("offset"))


def pieces(ws: Workspace, tokens: DataFrame, capacity: int, gap: float = 1e-3) -> tuple[DataFrame, Plan]:
    """row, start, length, sequence_id, offset of every piece; rows have n tokens each."""
    spark = tokens.sparkSession
    cap = F.lit(capacity)
    docs = tokens.select("row", "doc_id", "n", F.expr(f"n div {capacity}").alias("full"))
    held = docs.groupBy(F.least("n", cap).alias("n")).agg(F.count("*").alias("c"), F.sum("full").alias("full"), F.sum(F.col("n") % capacity).alias("rest")).collect()  # at most capacity rows
    longer = next((r for r in held if r["n"] == capacity), None)
    plan = Plan({r["n"]: r["c"] for r in held if 0 < r["n"] < capacity}, longer["c"] if longer else 0, longer["rest"] if longer else 0, capacity, gap)
    ranked, full = running(ws, docs, [F.least("n", cap).desc(), F.col("doc_id"), F.col("row")], "full", "ranked")
    placed = ws.save(_placed(ranked, plan), "placed")
    whole, other = placed.where("sequence_id is not null"), placed.where("sequence_id is null")
    # whole documents, one behind the other; a sequence has at most capacity of them
    order = Window.partitionBy("sequence_id").orderBy("slot")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead("slot").over(order).isNull()
    whole = ws.save(whole.select("row", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), "sequence_id", (upto - F.col("n")).alias("offset"), last.alias("last")), "whole")
    # what is cut freely fills their gaps and sequences after them
    used = F.col("offset") + F.col("length")
    gaps, room = running(ws, whole.where("last").select("sequence_id", used.alias("offset"), (cap - used).cast("long").alias("room")).where("room > 0"), [F.col("sequence_id")], "room", "gaps")
    start = F.col("full") * capacity
    items = other.select("row", start.alias("start"), (F.col("n") - start).alias("length"), F.col("idx").alias("rank")).where("length > 0")
    items, _ = running(ws, items, [F.col("rank")], "length", "items")
    first = plan.patterned + plan.loose
    own = spark.range(plan.loose).select((F.col("id") + plan.patterned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(capacity).cast("long").alias("room"), (F.col("id") * capacity + room).alias("before"))
    at = room + plan.loose * capacity
    tails = [(first + k, 0, size, at + sum(plan.tails[:k])) for k, size in enumerate(plan.tails)]
    gaps = gaps.select("sequence_id", "offset", "room", "before").unionByName(own).unionByName(spark.createDataFrame(tails, "sequence_id long, offset long, room long, before long"))
    cut = _fill(items, gaps, capacity)
    rows = other.where("full > 0").select("row", "before", F.explode(F.expr("sequence(0L, full - 1)")).alias("k"))
    full_ones = rows.select("row", (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.col("before") + F.col("k") + (first + len(tails))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.drop("last").unionByName(cut).unionByName(full_ones), plan


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, gap: float = 1e-3) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece.

    Every whole text (null: empty) is encoded as the library does it and ends with end_id, so an empty one is one token.
    Sequences have at most capacity tokens, a power of two; none needs padding.  Repeated rows, repeated and null ids
    are documents of their own.  An empty table gives no rows.  Other columns are left out.  gap is how near the
    linear program's optimum the patterns have to come.
    """
    if capacity & (capacity - 1) or capacity < 2:
        raise ValueError("capacity has to be a power of two")
    dtype = id_dtype(tokenizer_path)
    ws = Workspace(spark, "packing")
    held = tokens(ws, docs, tokenizer_path, end_id)
    cuts, _ = pieces(ws, held, capacity, gap)
    of = cuts.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))  # no more than a document's tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "length", "sequence_id", "offset"]
        for b in batches:
            lists = b["cuts"].flatten()
            at = [f.to_numpy() for f in (lists.field(c) for c in names)]
            size = np.diff(b["cuts"].offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), size)
            cut = [[b["doc_id"].take(pa.array(of)), *map(pa.array, at)], b["n"].take(pa.array(of))]
            ids, lo, doc = [], 0, -1
            for k, (d, a, n) in enumerate(zip(of.tolist(), at[0].tolist(), at[1].tolist(), strict=True)):
                if d != doc:
                    doc, own = d, np.frombuffer(b["ids"][d].as_buffer(), dtype)
                ids.append(own[a : a + n].astype("<u4").tobytes())
                if k + 1 == len(of) or k + 1 - lo >= 2000:
                    part = [c.slice(lo, k + 1 - lo) for c in (*cut[0], cut[1])]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(ids, pa.binary())], ["doc_id", *names, "doc_tokens", "ids"])
                    ids, lo = [], k + 1

    found = held.join(of, "row").select("doc_id", "n", "ids", "cuts")
    return found.mapInArrow(cut, "doc_id long, start long, length long, sequence_id long, offset long, doc_tokens long, ids binary").select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
