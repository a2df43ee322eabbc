"""Operator 11: vectors compressed to codes by Lloyd rounds that filter codebook entries through kd-trees.

A vector is cut into equal parts, and each part position has a codebook.  Vectors lie in blocks, a task has some of
them.  For every part position of a block a kd-tree is built once and saved: the points in the tree's order and, for
each node, its bounding box and the sum of its points (its count follows from the tree's shape).  A round sends the
codebooks, whose size is fixed, to all blocks.  From the root down, each node keeps the entries that can be nearest
to a point in its box; where one is left, the node's cached sum and count go to it and its whole subtree is done.
Only points of leaves with several entries left are compared one by one.

All arithmetic is in whole numbers, so results don't depend on blocks, partitions or the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Workspace

BLOCK = 8192  # vectors of a block at most
LEAF = 16  # points of a leaf, about
EXACT = 1 << 21  # up to this magnitude doubles hold all sums of products; beyond, Python's integers do
LABELS = 100_000  # sums of so many labels at most are broadcast, after they are counted

_TREES = "vec_ids binary, no_id binary, labels binary, no_label binary, n int, width int, points binary, orders binary, boxes binary"


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v: components as floor(scale * x).  Vectors that are null, empty or hold null or non-finite
    components are left out; other columns too."""
    x = F.col("embedding")
    good = F.size(x) > 0
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.where(F.coalesce(good & finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _levels(n: int) -> int:
    """Halvings until leaves have about LEAF points."""
    return max(0, (max(n - 1, 0) // LEAF).bit_length())


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and n.  A node's children share out its range."""
    return (np.arange((1 << level) + 1) * n) >> level


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A kd-tree over rows: their order, and for each node, level by level, least and greatest coordinates and sums.

    Each node is cut in the middle of its points along the widest side of its box.
    """
    n, levels = len(points), _levels(len(points))
    order, boxes = np.arange(n), []
    for level in range(levels + 1):
        at = _bounds(n, level)
        own = points[order]
        low, high, total = (f.reduceat(own, at[:-1], axis=0) for f in (np.minimum, np.maximum, np.add))
        boxes.append(np.stack([low, high, total], 1))
        if level < levels:
            node = np.repeat(np.arange(len(at) - 1), np.diff(at))
            key = own[np.arange(n), np.argmax(high - low, axis=1)[node]]
            order = order[np.lexsort((key, node))]
    return order, np.concatenate(boxes)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


def assign(points: np.ndarray, boxes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: lower index) of each point in the tree's order, and sums and counts of the entries' points.

    An entry goes from a box if another one is nearer at the corner that lies farthest towards it, and so everywhere in
    the box; at a tie there the one of lower index stays.
    """
    n, k = len(points), len(entries)
    code = np.zeros(n, np.int64)
    sums, counts = np.zeros_like(entries), np.zeros(k, np.int64)
    nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    first, number = 0, np.arange(k)
    for level in range(_levels(n) + 1):
        at = _bounds(n, level)
        low, high, total = np.moveaxis(boxes[first : first + len(at) - 1][nodes], 1, 0)
        # the entry nearest to the box's middle, everything doubled
        far = _squares(2 * entries[None] - (low + high)[:, None])
        best = np.where(left, far, far.max() + 1).argmin(1)
        z = entries[best]
        towards = entries[None] > z[:, None]
        corner = np.where(towards, high[:, None], low[:, None])
        worse = _squares(entries[None] - corner) - _squares(z[:, None] - corner)
        left = left & ~((worse > 0) | ((worse == 0) & (number > best[:, None])))
        left[np.arange(len(best)), best] = True
        alone = left.sum(1) == 1
        begin, end = at[nodes], at[nodes + 1]
        np.add.at(sums, best[alone], total[alone])
        np.add.at(counts, best[alone], (end - begin)[alone])
        for a, b, c in zip(begin[alone].tolist(), end[alone].tolist(), best[alone].tolist(), strict=True):
            code[a:b] = c
        nodes, left = nodes[~alone], left[~alone]
        if level == _levels(n):
            _compare(points, entries, begin[~alone], end[~alone], left, code, sums, counts)
        else:
            nodes, left = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(left, 2, axis=0)
            first += len(at) - 1
        if not len(nodes):
            break
    return code, sums, counts


def _compare(points, entries, begin, end, left, code, sums, counts) -> None:
    """Points of leaves with several entries left, one by one against those."""
    size = end - begin
    if not len(size):
        return
    row = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    own = points[row]
    far = _squares(entries)[None] - 2 * (own @ entries.T)  # without the point's own square
    near = np.where(np.repeat(left, size, axis=0), far, far.max() + 1).argmin(1)
    code[row] = near
    np.add.at(sums, near, own)
    np.add.at(counts, near, 1)


def _kind(*arrays) -> type:
    """The numbers to reckon with: doubles are whole numbers as long as they are small."""
    return np.float64 if all(not a.size or int(np.abs(a).max()) <= EXACT for a in arrays) else object


#: Any whole numbers as Python's.
_ints = np.vectorize(int, otypes=[object])


class _Block:
    """A saved block: its trees are read once a task and used for one set of codebooks."""

    def __init__(self, row: dict, parts: int):
        self.n, self.parts = row["n"], parts
        kind = f"<i{len(row['points']) // (parts * self.n * row['width'])}"
        self.points = np.frombuffer(row["points"], kind).reshape(parts, self.n, row["width"])
        self.orders = np.frombuffer(row["orders"], "<u2").reshape(parts, self.n)
        self.boxes = np.frombuffer(row["boxes"], "<i8").reshape(parts, -1, 3, row["width"])

    def assign(self, books: np.ndarray) -> Iterator[tuple]:
        kind = _kind(self.points, books)
        for p in range(self.parts):
            yield assign(self.points[p].astype(kind), self.boxes[p].astype(kind), books[p].astype(kind))


def trees(ws: Workspace, vectors: DataFrame, parts: int, dims: int) -> DataFrame:
    """Blocks of vectors with their kd-trees, saved."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = -(-b.num_rows // max(1, -(-b.num_rows // BLOCK)))  # blocks of one size
            for i in range(0, b.num_rows, step or 1):
                own = b.slice(i, step)
                n = own.num_rows
                v = own["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, parts, dims // parts)
                made = [build(v[:, p]) for p in range(parts)]
                points = np.stack([v[o, p] for p, (o, _) in enumerate(made)])
                small = "<i2" if np.abs(points).max() < 1 << 15 else "<i8"
                ids, labels = ((own[c].fill_null(0).to_numpy().astype("<i8").tobytes(), own[c].is_null().to_numpy(zero_copy_only=False).tobytes()) for c in ("vec_id", "label"))
                row = [*ids, *labels, n, dims // parts, points.astype(small).tobytes(), np.stack([o for o, _ in made]).astype("<u2").tobytes(), np.stack([x for _, x in made]).astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in row], [c.split()[0] for c in _TREES.split(", ")])

    return ws.save(vectors.select("vec_id", "label", "v").mapInArrow(make, _TREES), "trees")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):  # a block at a time
            yield b.slice(i, 1).to_pylist()[0]


def refine(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every entry to floor(sum / count) of its parts; unused ones stay.

    Tasks add up their blocks, so at most one row for each part, entry and task is shuffled; the driver gets one row
    for each part and entry, however many vectors there are.
    """
    parts, k, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, object), np.zeros((parts, k), np.int64)
        for row in _rows(batches):
            for p, (_, s, c) in enumerate(_Block(row, parts).assign(books)):
                sums[p] += _ints(s)
                counts[p] += c
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array([list(sums[i, j]) for i, j in zip(p, e, strict=True)], pa.list_(pa.int64()))], ["p", "e", "n", "s"])

    part = blocks.select("n", "width", "points", "orders", "boxes").mapInArrow(add, "p int, e int, n long, s array<long>")
    out = books.copy()
    for r in part.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect():
        out[r["p"], r["e"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (bytes of indexes in part order) and error (squared distances summed over parts)."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row, parts)
            codes, errors = np.zeros((b.n, parts), np.uint8), np.zeros(b.n, object)
            for p, (code, _, _) in enumerate(b.assign(books)):
                codes[b.orders[p], p] = code
                kind = _kind(b.points, books)
                errors[b.orders[p]] += _squares(b.points[p].astype(kind) - books[p].astype(kind)[code]).astype(object)
            ids, labels = (pa.array(np.frombuffer(row[c], "<i8"), mask=np.frombuffer(row[no], bool)) for c, no in (("vec_ids", "no_id"), ("labels", "no_label")))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(_ints(errors).tolist(), pa.int64())], ["vec_id", "label", "codes", "error"])

    return blocks.mapInArrow(run, "vec_id long, label long, codes binary, error long")


def compress(spark: SparkSession, vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors (vec_id, embedding, label) and the final codebooks (part, entry, position).

    Codebooks start as the parts of the vectors with the least vec_ids (ties: by components; null ids last), at most 256
    of them.  Scaled components have to be under 2^50 in magnitude and errors fit a long.  Vectors that are null, empty or hold null or non-finite components are left out, and so are those whose
    length isn't that of the first codebook vector; that length has to be a multiple of parts.  Repeated ids and rows
    are vectors of their own.  Where nothing is left, so are no rows, and codebooks are empty.
    """
    if not 0 < size <= 256:
        raise ValueError("an index is one byte")
    ws = Workspace(spark, "vector-codes")
    found = whole_numbers(vectors, scale)
    first = [r["v"] for r in found.orderBy(F.asc_nulls_last("vec_id"), "v").limit(size).collect()]
    dims = len(first[0]) if first else parts
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    first = [v for v in first if len(v) == dims] if all(len(v) == dims for v in first) else [r["v"] for r in found.where(F.size("v") == dims).orderBy(F.asc_nulls_last("vec_id"), "v").limit(size).collect()]
    books = np.array(first, object).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    books = books if _kind(books) is object else books.astype(np.int64)
    blocks = trees(ws, found.where(F.size("v") == dims), parts, dims)
    for _ in range(rounds if first else 0):
        books = refine(blocks, books)
    return ws.save(encode(blocks, books), "codes"), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors of all vectors of a label (nulls together).  Sums are partial before they are
    shuffled; few labels are broadcast, of many the join is shuffled and its skew split."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    few = sums.limit(LABELS + 1).count() <= LABELS
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
