"""Operator 6: exact Jaccard join of word n-gram sets as a join in a metric space.

Jaccard distance is a metric, but unrelated texts are all at distance 1, where pivots tell nothing apart.  So the
space is first cut exactly: linked sets share one of their least shingles in a common order (frequent ones last), and
texts that no chain of such shingles joins are never compared.

The blocks left are joined by pivots.  Distances to a few pivots give their links at once.  A text so near a pivot
that by the triangle inequality nothing outside the pivot's links can be linked to it is done, so a dense group is
gone after one round.  The others go to their nearest pivot's Voronoi region and to each whose pivot is at most twice
the radius farther; regions are joined in the same way, recursively, with new pivots.  Blocks over BLOCK_TEXTS are cut
in rounds of Spark jobs until their regions fit a task, which goes on by itself down to regions of LEAF texts.
What pivots can't cut is dealt by the distance to one pivot into chunks, of which only those in each other's window
meet.  Tasks give out a spanning forest of the links, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Workspace, documents, partitions, tidied
from marlstone.llm.components import components

WIDTH = 5
PERCENT = 75
#: What one task joins at once: texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 1_000, 2_000_000
#: Regions of so many texts are joined text by text.
LEAF = 32
#: Where so many texts near the borders of regions make more copies than this of each, regions would repeat the work.
CROWDED = 1.5
#: Size of the list of frequent shingles that every task gets (8 bytes each), and from how many texts on one is
#: frequent; only speed depends on them.
HOT_SHINGLES, HOT_TEXTS = 1 << 20, 16
#: Texts that share a prefix shingle are taken two by two up to this number, as one block beyond it.
PAIRED = 64
#: Shingles that a task splits into buckets at once.
SPLIT = 4_000_000
_PIVOTS, _DEPTH = 8, 4
#: Texts meet by 40 bits of their shingles: two that share these only are compared and found not to link.
_BITS, _BYTES = 24, 5
BROADCAST_ROWS = 1_000_000


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles of a text: A-Z lower-cased, words between ASCII white space."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


def _key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8"))


def _texts(b: pa.RecordBatch) -> Iterator[str]:
    for t in b["text"]:
        yield t.as_py()


def _least(size: int, percent: int) -> int:
    """Of so many shingles of a set, in the common order, a linked set has one at least among its own as many first."""
    return size - -(-percent * size // 100) + 1


def _marked(s: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of s are in known; both ascending."""
    if not len(known):
        return np.zeros(len(s), bool)
    return known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s


def _buckets(spark: SparkSession) -> int:
    """Several for each partition, so that partitions are even; 40 bits less a bucket's fit into 4 bytes from 256 on."""
    return max(256, 8 * partitions(spark))


def _bucketed(t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket (it keeps the order within), the buckets that aren't empty, and where each begins and ends."""
    bucket = t % np.uint64(n)
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32), kind="stable")
    count = np.bincount(bucket.astype(np.int64), minlength=n)
    own = np.flatnonzero(count)
    return order, own, np.concatenate([[0], np.cumsum(count[own])])


def _slices(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values between each two bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _by_bucket(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[list]]]:
    """(bucket, its rows' values of names) of rows that are sorted by bucket."""
    now, own = None, []
    for b in batches:
        for bucket, *values in zip(b["bucket"].to_pylist(), *(b[x].to_pylist() for x in names), strict=True):
            if bucket != now:
                if own:
                    yield now, own
                now, own = bucket, []
            own.append(values)
    if own:
        yield now, own


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


def _hot(ws: Workspace, docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """The most frequent of the shingles that stand early in the common order, counted over all documents; ascending.

    A task tells of its texts' early shingles (twice a prefix, in the order without those that three of its own texts
    share) 4 bytes each by bucket, and of those that several of its texts share one number.
    """
    buckets = _buckets(docs.sparkSession)

    def told(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        common = n >= 3
        found, n = found[common], n[common]
        early = [x[~_marked(x, found)][: 2 * _least(len(x), percent)] for x in sets]
        rest, m = np.unique(np.concatenate(early), return_counts=True)
        t, n = np.concatenate([rest, found]) >> np.uint64(_BITS), np.concatenate([m, n])
        rows = []
        for own in (n == 1, n > 1):  # of the first the number is left out
            order, bucket, bounds = _bucketed(t[own], buckets)
            h = (t[own][order] // np.uint64(buckets)).astype("<u4")
            times = _slices(n[own][order].astype("<u4"), bounds) if rows else pa.nulls(len(bucket), pa.binary())
            rows.append((pa.array(bucket, pa.int32()), _slices(h, bounds), times))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*rows, strict=True)], ["bucket", "h", "n"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, many = {}, 0
            for t in _texts(b):
                x = shingle_set(t, width)
                if len(x):
                    sets[_key(x)] = x
                    many += len(x)
                if many > SPLIT:
                    yield told(list(sets.values()))
                    sets, many = {}, 0
            if sets:
                yield told(list(sets.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches, ["h", "n"]):
            h = np.concatenate([np.frombuffer(x, "<u4") for x, _ in rows])
            n = np.concatenate([np.ones(len(x) // 4, np.int64) if y is None else np.frombuffer(y, "<u4").astype(np.int64) for x, y in rows])
            order = np.argsort(h, kind="stable")
            h = h[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.add.reduceat(n[order], at)
            often = n >= HOT_TEXTS
            t = h[at][often].astype(np.int64) * buckets + bucket
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n[often])], ["t", "n"])

    dealt = _dealt(docs.select("text").mapInArrow(tidied(tell), "bucket int, h binary, n binary"))
    counted = ws.save(dealt.mapInArrow(tidied(count), "t long, n long"), "counted")
    least, many = 0, 0
    for n, own in sorted(map(tuple, counted.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        many += own
        if many > HOT_SHINGLES:
            break
        least = n
    top = counted.where(F.col("n") >= least).select("t").toArrow() if least else None
    ws.drop(counted)
    return np.sort(top["t"].to_numpy()).astype(np.uint64) if least else np.empty(0, np.uint64)


def _signatures(docs: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, n, k1, k2 (name of the set) and its prefix, the shingles one of which any linked set's prefix has too:
    rare, 5 bytes of each, and hot, the frequent ones, which come last in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, rare, often = [], [], [], [], []
            for t in _texts(b):
                s = shingle_set(t, width)
                k = _key(s)
                n.append(len(s))
                k1.append(k[0])
                k2.append(k[1])
                size = _least(len(s), percent) if len(s) else 0
                short = s >> np.uint64(_BITS)
                known = _marked(short, hot)
                first = short[~known][:size].astype("<u8")
                rare.append(first.view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes())
                often.append(s[known][: size - len(first)].view(np.int64) if len(first) < size else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(rare, pa.binary()), pa.array(often, pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "rare", "hot"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n long, k1 long, k2 long, rare binary, hot array<long>")


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes each as the largest asks for."""
    return x.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if k == "<u8" or x.max(initial=0) < 1 << 8 * int(k[2])))


def _numbers(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // count}").astype(np.uint64)


def _met(leads: DataFrame) -> DataFrame:
    """t, m: for each rare prefix shingle that several texts have, these texts (rep, n), ascending.

    A task sends what falls into a bucket as one row, some 7 bytes a shingle: 4 of it, and the step from the last text's
    id and the size in as few as do.  What three texts of a task's share is hot, so no shingle has very many texts here.
    """
    buckets = _buckets(leads.sparkSession)

    def split(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows.sort()
        raw = np.frombuffer(b"".join(x for _, _, x in rows), np.uint8).reshape(-1, _BYTES)
        t = np.zeros((len(raw), 8), np.uint8)
        t[:, :_BYTES] = raw
        t = t.view("<u8").ravel()
        owner = np.repeat(np.arange(len(rows)), [len(x) // _BYTES for _, _, x in rows])
        order, bucket, bounds = _bucketed(t, buckets)
        owner = owner[order]
        ids = np.array([i for i, _, _ in rows], np.int64)[owner]
        step = np.diff(ids.view(np.uint64), prepend=np.uint64(0))  # modulo 2 ** 64
        step[bounds[:-1]] = 0
        h = (t[order] // np.uint64(buckets)).astype("<u4")
        n = np.array([n for _, n, _ in rows], np.uint64)[owner]
        columns = [pa.array(bucket, pa.int32()), pa.array(ids[bounds[:-1]]), *(_slices(x, bounds) for x in (h, _narrow(step), _narrow(n)))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "first", "h", "step", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, many = [], 0
            for row in zip(b["rep"].to_pylist(), b["n"].to_pylist(), b["rare"].to_pylist(), strict=True):
                if row[2]:
                    own.append(row)
                    many += len(row[2]) // _BYTES
                if many > SPLIT:
                    yield split(own)
                    own, many = [], 0
            if own:
                yield split(own)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches, ["first", "h", "step", "n"]):
            h = np.concatenate([np.frombuffer(x, "<u4") for _, x, _, _ in rows])
            ids = np.concatenate([np.cumsum(_numbers(x, len(y) // 4)).view(np.int64) + np.int64(i) for i, y, x, _ in rows])
            n = np.concatenate([_numbers(x, len(y) // 4) for _, y, _, x in rows]).astype(np.int64)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            several = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            h, ids, n = h[several], ids[several], n[several]
            order = np.lexsort((n, ids, h))
            h, ids, n = h[order], ids[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
            t = h[at].astype(np.int64) * buckets + bucket
            m = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)), pa.int32()), pa.StructArray.from_arrays([pa.array(ids), pa.array(n)], ["rep", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array(t), m], ["t", "m"])

    dealt = _dealt(leads.select("rep", "n", "rare").mapInArrow(tidied(deal), "bucket int, first long, h binary, step binary, n binary"))
    return dealt.mapInArrow(tidied(meet), "t long, m array<struct<rep: long, n: long>>")


def _candidates(ws: Workspace, leads: DataFrame, percent: int) -> DataFrame:
    """a, b: edges whose components hold all links; leads: rep, n, rare, hot, a row for each set.

    Where few texts share a shingle, each two are counted: common shingles of both prefixes (counted exactly, but for
    chance), plus at most what stands behind the longer rest, must reach the overlap that their sizes ask for.  Shingles
    with the same texts are counted together.  Where many share one, those whose sizes allow a link are tied to the
    least of them instead: no pairs are made.
    """
    rare = ws.save(_met(leads), "met")
    shared = leads.select("rep", "n", F.explode("hot").alias("s"))
    # counted with partial sums and joined back, so that no task holds all texts of a frequent shingle
    many = shared.groupBy("s").agg(F.count("*").alias("g")).where("g > 1")
    hot = ws.save(shared.join(many, "s"), "shared")
    texts = F.array_sort(F.collect_list(F.struct("rep", "n")))
    each = rare.where(F.size("m") <= PAIRED).select("m").unionByName(hot.where(F.col("g") <= PAIRED).groupBy("s").agg(texts.alias("m")).select("m"))
    groups = each.groupBy("m").agg(F.count("*").alias("c"))
    two = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, PAIRED), lambda y: F.struct(x["rep"].alias("a"), x["n"].alias("na"), y["rep"].alias("b"), y["n"].alias("nb")))))
    pairs = groups.select("c", F.explode(two).alias("p")).select("c", "p.*").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = pairs.groupBy("a", "na", "b", "nb").agg(F.sum("c").alias("c"))
    behind = F.ceil(F.greatest("na", "nb") * percent / 100 - 1e-9) - 1
    wanted = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-9)
    likely = pairs.where(F.col("c") + behind >= wanted).select("a", "b")
    # sizes of linked texts differ by a factor of at most 100 / percent: each text is in its own class of sizes and the next
    band = F.floor(F.ln(F.col("n").cast("double")) / F.lit(math.log(100 / percent) + 1e-9)) if percent < 100 else F.col("n")
    crowds = hot.where(F.col("g") > PAIRED).select("s", "rep", "n").unionByName(rare.where(F.size("m") > PAIRED).select(F.col("t").alias("s"), F.explode("m").alias("x")).select("s", "x.rep", "x.n"))
    crowds = crowds.select("s", "rep", F.explode(F.array(band, band + 1)).alias("band"))
    leaders = crowds.groupBy("s", "band").agg(F.min("rep").alias("lead"))
    tied = crowds.join(leaders, ["s", "band"]).where("lead < rep").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    found = ws.save(likely.unionByName(tied).distinct(), "candidates")
    ws.drop(rare, hot)
    return found


def forest(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links enough to connect what is linked in a small region or one that pivots can't cut: each text is compared
    with those not yet reached."""
    m = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    _, token = np.unique(np.concatenate(sets), return_inverse=True) if m else (None, np.empty(0, np.int64))
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    begins = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
    waiting, out = np.ones(m, bool), []
    for root in range(m):
        if not waiting[root]:
            continue
        waiting[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            own = token[bounds[i] : bounds[i + 1]]
            lens = begins[own + 1] - begins[own]
            if lens.sum() == len(own):
                continue  # nobody else has any of them
            flat = np.repeat(begins[own] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            other = posting[flat]
            common = np.bincount(other[waiting[other]], minlength=m)
            js = np.flatnonzero((100 * common >= percent * (size[i] + size - common)) & waiting & (common > 0))
            for j in js.tolist():
                waiting[j] = False
                stack.append(j)
                out.append((ids[i], ids[j]))
    return out


def voronoi(ids: list[int], sets: list[np.ndarray], percent: int, seed: int = 0) -> list[tuple[int, int]]:
    """Links enough to connect what is linked among texts that fit a task, by pivots and regions, recursively."""
    if len(ids) <= LEAF:
        return forest(ids, sets, percent)
    size = np.array([len(x) for x in sets], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    kinds, token = np.unique(np.concatenate(sets), return_inverse=True)
    radius = (100 - percent) / 100 + 1e-9
    out: list[tuple[int, int]] = []
    open_ = np.ones(len(ids), bool)
    distance, farthest = [], np.full(len(ids), np.inf)
    pivot = seed % len(ids)
    for _ in range(_PIVOTS):
        mark = np.zeros(len(kinds), bool)
        mark[token[begin[pivot] : begin[pivot] + size[pivot]]] = True
        common = np.add.reduceat(mark[token], begin)
        union = size + size[pivot] - common
        d = 1 - common / union
        linked = 100 * common >= percent * union
        out += [(ids[pivot], ids[i]) for i in np.flatnonzero(linked).tolist() if i != pivot]
        # nothing outside the pivot's links is within the radius of those so near to it
        outside = d[~linked].min(initial=np.inf)
        open_ &= ~(linked & (d < outside - radius))
        open_[pivot] = False
        distance.append(d)
        farthest = np.minimum(farthest, d)
        left = np.where(open_, farthest, -1)
        pivot = int(left.argmax())  # the open text farthest from all pivots
        if left[pivot] < 0:
            return out
    d = np.array(distance)
    inside = (d <= d.min(0) + 2 * radius) & open_
    if inside.sum() > CROWDED * open_.sum() or inside.sum(1).max() > 0.7 * open_.sum():  # regions would repeat the work
        rest = np.flatnonzero(open_)
        return out + forest([ids[i] for i in rest], [sets[i] for i in rest], percent)
    for region in inside:
        rest = np.flatnonzero(region)
        if len(rest) > 1:
            out += voronoi([ids[i] for i in rest], [sets[i] for i in rest], percent, seed + 1)
    return out


def _joined(rows: DataFrame, key: list[str], percent: int, width: int) -> DataFrame:
    """Links (a, b) inside each group of rows (key, id, text); a group is one that fits a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, {}

        def links() -> Iterator[pa.RecordBatch]:
            if len(own) > 1:
                found = voronoi([i for i, _ in own], list(own.values()), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for b in batches:
            groups = list(zip(*(b[k].to_pylist() for k in key), strict=True))
            for g, i, t in zip(groups, b["id"].to_pylist(), _texts(b), strict=True):
                if g != now:
                    yield from links()
                    now, own = g, {}
                s = shingle_set(t, width)
                own[(i, _key(s))] = s
        yield from links()

    dealt = rows.select(*key, "id", "text").repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(tidied(run), "a long, b long")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).withColumn("large", (F.col("texts") > BLOCK_TEXTS) | (F.col("shingles") > BLOCK_SHINGLES))


def _measure(ws: Workspace, rows: DataFrame, percent: int, width: int, depth: int) -> DataFrame:
    """rows with d and linked (distances to their block's pivots, and whether linked to them) and p (the pivots' ids);
    other pivots at each depth."""
    hashed = rows.withColumn("h", F.xxhash64("id", "text", F.lit(depth)))
    pivots = hashed.groupBy("block", F.pmod("h", F.lit(_PIVOTS)).alias("j")).agg(F.min(F.struct("h", "id", "text")).alias("p"))
    pivots = ws.save(pivots.groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("pivots")), "pivots")  # at most _PIVOTS a block
    both = rows.join(pivots, "block")  # AQE splits a large block's side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, [])
        for b in batches:
            d, linked, p = [], [], []
            for block, t, pivots_ in zip(b["block"].to_pylist(), _texts(b), b["pivots"], strict=True):
                if known[0] != block:
                    known = (block, [(x["id"], shingle_set(x["text"], width)) for x in pivots_.as_py()])
                s = shingle_set(t, width)
                common = [(np.intersect1d(s, x, assume_unique=True).size, len(s) + len(x)) for _, x in known[1]]
                d.append([1 - c / (both_ - c) for c, both_ in common])
                linked.append([100 * c >= percent * (both_ - c) for c, both_ in common])
                p.append([i for i, _ in known[1]])
            lists = pa.array(d, pa.list_(pa.float64())), pa.array(linked, pa.list_(pa.bool_())), pa.array(p, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["block"], b["id"], b["n"], b["text"], *lists], ["block", "id", "n", "text", "d", "linked", "p"])

    found = both.select("block", "id", "n", "text", "pivots").mapInArrow(tidied(run), "block string, id long, n long, text string, d array<double>, linked array<boolean>, p array<long>")
    return ws.save(found, "measured")


def _cut(ws: Workspace, rows: DataFrame, percent: int, width: int, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links to pivots, open rows dealt to the Voronoi regions of their blocks, boundary texts to several; open rows
    of blocks that pivots don't cut, with at, the distance to the first pivot)."""
    radius = (100 - percent) / 100 + 1e-9
    measured = _measure(ws, rows, percent, width, depth)
    each = measured.select("block", "id", F.posexplode(F.arrays_zip("d", "p", "linked")).alias("j", "x")).select("block", "id", "j", "x.d", "x.p", "x.linked")
    pivot_links = ws.save(each.where("linked and p <> id").select(F.col("id").alias("a"), F.col("p").alias("b")), "links")
    outside = each.where("not linked").groupBy("block", "j").agg(F.min("d").alias("d"))
    outside = ws.save(outside.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("j", "d"))).alias("outside")), "outside")
    beyond = F.transform("d", lambda x, j: F.coalesce(F.try_element_at("outside", j), F.lit(2.0)) - radius > x)
    done = F.array_contains("p", F.col("id")) | F.exists(F.arrays_zip(F.col("linked"), beyond.alias("far")), lambda x: x["linked"] & x["far"])
    left = open_ = ws.save(measured.join(outside, "block", "left").where(~done).drop("outside", "linked", "p"), "open")
    ws.drop(measured)
    near = F.array_min("d") + 2 * radius
    own = F.filter(F.transform("d", lambda x, j: F.when(x <= near, j)), lambda j: j.isNotNull())
    sizes = left.select("block", "n", F.size(own).alias("k")).groupBy("block").agg(F.sum("k").alias("copies"), F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    large = (F.col("texts") > BLOCK_TEXTS) | (F.col("shingles") > BLOCK_SHINGLES)
    way = F.when(~large, "whole").when(F.col("copies") > CROWDED * F.col("texts"), "stuck").otherwise("cut")
    left = left.join(ws.save(sizes.select("block", way.alias("way")), "ways"), "block")
    to = F.explode(F.when(F.col("way") == "whole", F.array(F.lit(-1))).otherwise(own)).alias("j")
    regions = left.where("way <> 'stuck'").select("id", "n", "text", "block", to).select(F.concat_ws("/", "block", "j").alias("block"), "id", "n", "text")
    stuck = left.where("way = 'stuck'").select("block", "id", "n", "text", F.col("d")[0].alias("at"))
    regions, stuck = ws.save(regions, "regions"), ws.save(stuck, "stuck")
    ws.drop(open_)
    return pivot_links, regions, stuck


def _chunked(ws: Workspace, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Links inside blocks that pivots don't cut (block, id, n, text, at).  Texts are dealt by their distance to one
    pivot into chunks that fit a task; a chunk meets those that begin within the radius behind its end only."""
    radius = (100 - percent) / 100 + 1e-9
    step = radius / 16  # cells of distance; a cell of many texts has several chunks
    celled = rows.withColumn("cell", F.floor(F.col("at") / step).cast("int"))
    sizes = celled.groupBy("block", "cell").agg(F.greatest(F.ceil(F.count("*") / (BLOCK_TEXTS / 2)), F.ceil(F.sum("n") / (BLOCK_SHINGLES / 2))).cast("int").alias("k"))
    sizes = ws.save(sizes, "cells")  # a row for each of at most 65 cells of a block
    near = sizes.alias("x").join(sizes.select("block", F.col("cell").alias("to"), F.col("k").alias("many")).alias("y"), "block").where(F.abs(F.col("to") - F.col("cell")) <= 17)
    near = near.groupBy("block", "cell", "k").agg(F.collect_list(F.struct("to", "many")).alias("others"))
    placed = celled.join(near, ["block", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.col("k")).cast("int"))
    own = F.struct(F.col("cell").alias("c"), F.col("chunk").alias("i"))
    cells = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["many"] - 1), lambda i: F.struct(o["to"].alias("c"), i.cast("int").alias("i")))))
    meet = F.transform(cells, lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    dealt = placed.select("block", "id", "text", F.explode(meet).alias("m")).select("block", F.concat_ws("-", "m.x.c", "m.x.i", "m.y.c", "m.y.i").alias("pair"), "id", "text")
    return _joined(dealt, ["block", "pair"], percent, width)


def links(spark: SparkSession, ws: Workspace, rows: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """a, b: enough links to connect what is linked inside each block of rows (block string, id, n, text)."""
    found, cut = [], []
    for depth in range(_DEPTH + 1):
        sizes = ws.save(_sizes(rows), "sizes")
        large = sizes.where("large").count()
        small = rows.join(sizes.where("not large").select("block"), "block", "left_semi") if large else rows
        found.append(ws.save(_joined(small, ["block"], percent, width), "links"))
        if not large:
            break
        rows = rows.join(sizes.where("large").select("block"), "block", "left_semi")
        pivot_links, regions, stuck = _cut(ws, rows, percent, width, depth)
        found += [pivot_links, ws.save(_chunked(ws, stuck, percent, width), "links")]
        ws.drop(stuck, *cut)
        rows, cut = regions, [regions]
        if depth == _DEPTH:
            found.append(ws.save(_chunked(ws, rows.withColumn("at", F.lit(0.0)), percent, width), "links"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = ws.save(out.distinct(), "links")
    ws.drop(*found, *cut)
    return out


def group(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included) of every row.

    Two texts link when 100 * common >= percent * all shingles.  Fewer words than width are one shingle; null texts and
    texts without words have none and link with nothing.  Rows of one doc_id are one document.  A null doc_id takes no
    part in links and has a null component_id.
    """
    ws = Workspace(spark, "jaccard-join")
    every = documents(docs)
    whole = ws.save(_signatures(every, _hot(ws, every, width, percent), width, percent), "signatures")
    named = whole.where("n > 0 and doc_id is not null")
    reps = ws.save(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "reps")
    # of equal sets only the one with the least id goes on with its prefix
    equal = ws.save(named.select("doc_id", "k1", "k2").join(reps, ["k1", "k2"]).where("doc_id <> rep").select("doc_id", "k1", "k2").distinct(), "equal")
    leads = named.join(F.broadcast(equal) if equal.count() <= BROADCAST_ROWS else equal, ["doc_id", "k1", "k2"], "left_anti").withColumnRenamed("doc_id", "rep")
    near = _candidates(ws, leads, percent)
    sig = ws.save(whole.select("doc_id", "n", "k1", "k2"), "names")
    ws.drop(whole, equal)
    known = sig.where("n > 0 and doc_id is not null")
    blocks = ws.save(components(ws, near), "blocks")
    ws.drop(near)
    few = blocks.count() <= BROADCAST_ROWS
    wanted = reps.join(blocks.withColumnRenamed("id", "rep"), "rep").select(F.col("rep").alias("doc_id"), F.col("component").cast("string").alias("block"), "n").groupBy("doc_id", "block").agg(F.max("n").alias("n"))
    rows = every.join(F.broadcast(wanted) if few else wanted, "doc_id").select("block", F.col("doc_id").alias("id"), "n", "text")
    found = links(spark, ws, rows, percent, width)
    joined = ws.save(components(ws, found), "components")
    ws.drop(blocks, found)
    names = reps.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    linked = known.select("doc_id", "n", "k1", "k2").join(names, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sig.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(rest)


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of docs, all columns, without those that share a component with a lesser doc_id."""
    gone = Workspace(spark, "jaccard-join").save(group(spark, docs, percent, width).where("component_id < doc_id").select(F.col("doc_id").alias("_marlstone_gone")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col("doc_id") == F.col("_marlstone_gone"), "left_anti")
