"""Operator 2: language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are hashes of its byte n-grams, n from 2 to 4, after lower-casing A-Z.  Their embeddings are
averaged and a linear layer with softmax gives the languages.  Both are trained together by stochastic gradient
descent in numpy.  As everything before the softmax is linear, embeddings times layer is one table of a few scores
for each bucket, and a whole text is one gather and sum.

Rejection is calibrated on rows kept out of training, in two ways.  A temperature and a threshold are fitted for the
softmax, which tells known languages apart.  As a softmax is sure of any text, foreign ones are told by their fit: the
mean log frequency of their n-grams in the language predicted.  Its limit lies between the fit of rows in their own
language and that of rows in languages other than their own, and of random letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import Workspace, documents, tidied

BUCKET_BITS = 16
SIZES = (2, 3, 4)
#: Training reads at most so many rows of each language, chosen by hash.  The driver streams their features, which it
#: keeps only up to MEMORY bytes.
ROWS_PER_LANGUAGE = 1000
MEMORY = 1 << 25
#: Rows that calibrate, at most.
CALIBRATION_ROWS = 5000
_PRIOR = 60  # n-grams; a text of few has a fit near the usual one
_STRIDE = 1 << 22  # bytes hashed at once, so memory is bounded for very long texts


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_LOWER = _lower_table()


def features(raw: bytes) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in blocks of bounded size."""
    whole = np.frombuffer(raw, np.uint8)
    for at in range(0, len(whole), _STRIDE):
        b = _LOWER[whole[at : at + _STRIDE + SIZES[-1] - 1]].astype(np.uint32)
        room = min(_STRIDE, len(whole) - at)
        code = b.copy()
        for n in range(2, SIZES[-1] + 1):
            if len(b) < n:
                break
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
            if n in SIZES:
                h = (code[:room] + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA77)
                yield (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # languages x buckets
    temperature: float = 1.0
    threshold: float = 0.0
    frequency: np.ndarray | None = None  # languages x buckets: log frequency less the language's usual one
    limit: float = -np.inf
    report: dict = field(default_factory=dict)

    def judge(self, raw: bytes) -> tuple[str, float, bool]:
        """Language, calibrated probability, accepted.  Of equal scores the first language in order wins; a text of a
        single byte has no n-gram, gets the first language and 1 / languages."""
        blocks = list(features(raw)) if len(raw) <= _STRIDE else None
        total, n = np.zeros(len(self.languages)), 0
        for ids in blocks if blocks is not None else features(raw):
            n += len(ids)
            for k in range(len(total)):
                total[k] += np.take(self.table[k], ids).sum(dtype=np.float64)
        if not n:
            return self.languages[0], 1.0 / len(self.languages), 1.0 / len(self.languages) >= self.threshold
        z = total / n / self.temperature
        p = np.exp(z - z.max())
        k = int(z.argmax())
        score = float(p[k] / p.sum())
        if score < self.threshold or self.frequency is None:
            return self.languages[k], score, score >= self.threshold
        fit = sum(float(np.take(self.frequency[k], ids).sum(dtype=np.float64)) for ids in (blocks if blocks is not None else features(raw)))
        return self.languages[k], score, fit / (n + _PRIOR) >= self.limit


Row = tuple[str, np.ndarray, np.ndarray]  # language, distinct buckets, their counts


def train(rows: Iterable[Row], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """rows: read once for each epoch and twice more, in an order that has nothing to do with the language.  Each fifth
    row calibrates (up to CALIBRATION_ROWS), the others train."""
    rng = np.random.default_rng(seed)
    count: dict[str, int] = {}
    for lang, *_ in rows:
        count[lang] = count.get(lang, 0) + 1
    languages, n = sorted(count), sum(count.values())
    own = {x: k for k, x in enumerate(languages)}
    kept_out = lambda i: n >= 20 and i % 5 == 0 and i < 5 * CALIBRATION_ROWS
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    layer = np.zeros((dim, len(languages)), np.float32)
    seen = np.zeros((len(languages), 1 << BUCKET_BITS), np.float32)
    steps, done = epochs * n, 0
    for epoch in range(epochs):
        for i, (lang, ids, counts) in enumerate(rows):
            done += 1
            if kept_out(i):
                continue
            if not epoch:
                seen[own[lang], ids] += counts
            lr = rate * (1 - done / steps)
            w = (counts / counts.sum()).astype(np.float32)
            hidden = w @ emb[ids]
            z = hidden @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[own[lang]] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            # scaled by the number of distinct buckets: an averaged gradient alone barely moves an embedding
            emb[ids] -= lr * min(len(ids), 100) * w[:, None] * back[None, :]
    model = Model(languages, np.ascontiguousarray((emb @ layer).T))
    seen += 0.1
    model.frequency = np.log(seen / seen.sum(1, keepdims=True))
    return _calibrate(model, [r for i, r in enumerate(rows) if kept_out(i)], own)


def _random_letters(rng: np.random.Generator) -> bytes:
    """A text of random words of random letters."""
    letters = rng.integers(97, 123, 400).astype(np.uint8)
    letters[np.cumsum(rng.integers(3, 10, 60))[:55] % 400] = 32
    return letters.tobytes()


def _calibrate(model: Model, rows: list[Row], own: dict[str, int]) -> Model:
    """Temperature by least log loss with a doubt; threshold: half of the lowest score but one in a thousand of right predictions.
    Limit of fit: a fifth of the way from the foreign rows' to the own rows'."""
    if not rows:
        model.frequency = None
        return model
    z = np.array([(model.table[:, ids] @ counts) / counts.sum() for _, ids, counts in rows])
    y = np.array([own[r[0]] for r in rows])

    def scores(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    # one row in all is taken as wrong, so that a temperature is found even where every row is right
    doubt = 1 / (len(y) + 2)
    target = np.full(z.shape, doubt / max(1, z.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - doubt
    grid = np.geomspace(0.05, 20, 60)
    loss = [-(target * np.log(np.maximum(scores(t), 1e-300))).sum(1).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = scores(model.temperature)
    right = p.argmax(1) == y
    floor = 1 / len(model.languages)
    if right.any():
        model.threshold = float(max(floor, min(0.5, 0.5 * np.quantile(p.max(1)[right], 0.001))))

    logs = np.array([model.frequency[:, ids] @ counts for _, ids, counts in rows])
    size = np.array([counts.sum() for *_, counts in rows])
    for k in range(len(model.languages)):
        mine = y == k
        model.frequency[k] -= logs[mine, k].sum() / size[mine].sum() if mine.any() else logs[:, k].sum() / size.sum()
    fit = np.array([model.frequency[:, ids] @ counts for _, ids, counts in rows]) / (size + _PRIOR)[:, None]
    low = min(0.0, float(np.quantile(fit[np.arange(len(y)), y], 0.001)))
    rng = np.random.default_rng(11)
    noise = []
    for _ in range(50):
        ids = np.concatenate(list(features(_random_letters(rng))))
        noise.append(max(float(f[ids].sum()) for f in model.frequency) / (len(ids) + _PRIOR))
    high = float(np.quantile(noise, 0.95))
    if len(model.languages) > 1:
        fit[np.arange(len(y)), y] = -np.inf
        high = max(high, float(np.quantile(fit.max(1)[size > _PRIOR], 0.95))) if (size > _PRIOR).any() else high
    model.limit = high + 0.2 * (low - high) if high < low else 1.5 * low
    model.report = {"rows": len(rows), "accuracy": float(right.mean()), "temperature": model.temperature, "threshold": model.threshold, "own_fit": low, "foreign_fit": high, "limit": model.limit}
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is a multiple of 5 are never learnt from; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class _Saved:
    """Feature rows of a saved table, streamed by the driver partition by partition; kept where they are few bytes."""

    def __init__(self, table: DataFrame, n_bytes: int):
        self.table, self.few, self.kept = table, n_bytes <= MEMORY, None

    def __iter__(self) -> Iterator[Row]:
        if self.kept is not None:
            return iter(self.kept)
        rows = ((r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in self.table.toLocalIterator())
        if self.few:
            self.kept = list(rows)
            return iter(self.kept)
        return rows


def fit(spark: SparkSession, docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Learn from rows with text and language that aren't held out: at most per_language of each language, chosen by
    hash of id and text (equal rows are chosen alike).  All languages are learnt.  None if there are no rows."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 1)).select("doc_id", "text", "lang")
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.least(F.lit(1.0), (1.3 * per_language + 20) / F.col("n"))
    ws = Workspace(spark, "langid")
    languages = ws.save(usable.groupBy("lang").agg(F.count("*").alias("n")).select("lang", share.alias("share")), "languages")  # a row a language
    picked = usable.withColumn("u", u).join(languages, "lang").where("u < share")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = [], []
            for t in b["text"]:
                n = np.zeros(1 << BUCKET_BITS, np.int64)
                for block in features(t.as_py().encode("utf-8", "surrogatepass")):
                    n += np.bincount(block, minlength=1 << BUCKET_BITS)
                own = np.flatnonzero(n)
                ids.append(own.astype(np.int32).tobytes())
                counts.append(n[own].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b["lang"], b["u"], pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "u", "ids", "counts"])

    best = picked.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("k") <= per_language)
    rows = ws.save(best.select("lang", "u", "text").mapInArrow(tidied(count), "lang string, u double, ids binary, counts binary").where("length(ids) > 0"), "rows")
    n_bytes = rows.agg(F.sum(F.length("ids") + F.length("counts"))).first()[0]
    if not n_bytes:
        ws.drop(languages, rows)
        return None
    # dealt and ordered by hash, in parts of some megabytes, of which the driver holds one
    mixed = F.xxhash64("u", F.lit(5))
    dealt = ws.save(rows.withColumn("h", mixed).repartition(1 + n_bytes // (1 << 23), "h").sortWithinPartitions("h"), "dealt")
    model = train(_Saved(dealt, n_bytes))
    ws.drop(languages, rows, dealt)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of each whole text; lang, source and ids aren't inputs.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learnt.  accepted is false for
    those, below the calibrated threshold, and for texts that fit no language learnt.  One row for each row, repeated
    ones alike; narrow, no shuffle.
    """
    letter = F.col("text").rlike(r"\p{L}")
    known = documents(docs).select("doc_id", held_out().alias("held_out"), F.when(letter, F.col("text")).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 256 KB for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            found = [("und", 0.0, False) if m is None or t is None else m.judge(t.encode("utf-8", "surrogatepass")) for t in (x.as_py() for x in b["text"])]
            lang, score, ok = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return known.mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, whose language is accepted; where nothing was learnt, those with a letter."""
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if model is None:
        return lettered
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([held.value.judge(t.as_py().encode("utf-8", "surrogatepass"))[2] for t in b["text"]], pa.bool_()))

    return lettered.mapInArrow(tidied(run), docs.schema)
