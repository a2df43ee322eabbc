"""Operator 9: SimHash fingerprints and search within a Hamming radius, with DataFrame functions only.

Terms are pairs of neighbouring words (a single word stands for itself), weighted by how often they occur.  Each
term's 128-bit hash votes on every bit.  Votes are counted four to a long, in lanes of 16 bits, over pieces of 32,767
terms, so that 32 sums serve 128 bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import Workspace, documents, partitions

BITS = 128
_LANES = 0x0001000100010001
_PIECE = 32_767  # a lane's sum stays under 2 ** 15, so sums of lanes never overflow
_SEEDS = (0, 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _votes(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp_hi, fp_lo of the column text: two longs of 64 bits."""
    worded = texts.withColumn("_w", _words(F.col("text"))).drop("text")
    terms = worded.select(*keys, F.posexplode_outer(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))).alias("b"))).alias("_at", "_t"))
    # the last word has no right neighbour and counts only where it is the only one
    terms = terms.where(F.col("_t").isNull() | F.col("_t.b").isNotNull() | (F.col("_at") == 0))
    hashed = terms.select(*keys, (F.col("_at") / _PIECE).cast("int").alias("_piece"), *[F.when(F.col("_t").isNotNull(), F.xxhash64(F.lit(s), F.col("_t.a"), F.coalesce(F.col("_t.b"), F.lit("")))).alias(f"_h{s}") for s in _SEEDS])
    lanes = [F.sum(F.shiftrightunsigned(f"_h{s}", j).bitwiseAND(_LANES)).alias(f"_s{s}_{j}") for s in _SEEDS for j in range(16)]
    pieces = hashed.groupBy(*keys, "_piece").agg(F.count("_h0").alias("_n"), *lanes)
    # lanes of 16 bits widen to 32 before pieces are added up
    wide = [F.sum(F.shiftrightunsigned(f"_s{s}_{j}", 16 * half).bitwiseAND(0x0000FFFF0000FFFF)).alias(f"_v{s}_{j}_{half}") for s in _SEEDS for j in range(16) for half in (0, 1)]
    whole = pieces.groupBy(*keys).agg(F.sum("_n").alias("_n"), *wide)

    def word(s: int) -> Column:
        """Lane k of sum j votes on bit 16 k + j; lanes 0 and 2 are in half 0."""
        bits = []
        for j in range(16):
            for k in range(4):
                count = F.shiftrightunsigned(f"_v{s}_{j}_{k % 2}", 32 * (k // 2)).bitwiseAND(0xFFFFFFFF)
                bits.append(F.when(count * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), 16 * k + j)).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return whole.select(*keys, word(0).alias("fp_hi"), word(1).alias("fp_lo"))


def hex_of(hi: str = "fp_hi", lo: str = "fp_lo") -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))) / F.lit(float(BITS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp_hi, fp_lo of each distinct (doc_id, text): equal texts have equal ones, texts without a word 0 and 0."""
    return _votes(documents(docs).withColumn("_text_key", F.sha2("text", 256)), ["doc_id", "_text_key"]).drop("_text_key")


#: Characters of texts in a range, about, and ranges in a task: several, so that dealing them by hash is even.
RANGE_CHARS, RANGES = 1 << 23, 8


def _ranges(spark: SparkSession, every: DataFrame, tasks: int) -> tuple[DataFrame, int, int, int]:
    """At least so many ranges, and more of larger data: (bucket, lo, hi, first, parts: ids from lo to hi - 1 are dealt to parts ranges from first on), least id, width of a
    bucket, number of ranges.  An id of many rows has a line of its own with several ranges, dealt by the text's hash;
    so has null, in bucket -1.  A row for each range, joined through buckets of ids, so none is sought one by one."""
    found = every.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum(F.length("text").cast("long")).alias("chars")).first()
    tasks = max(tasks, (found["chars"] or 0) // RANGE_CHARS)
    at = [i / tasks for i in range(1, tasks)] or [0.5]
    at = every.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0]
    rows, lines = [], 0
    nulls = found["rows"] - found["ids"]
    if nulls:
        lines = 1 + nulls * tasks // found["rows"]
        rows.append((-1, None, None, 0, lines))
    lo, hi = found["lo"] or 0, found["hi"] or 0
    width = max(1, (hi - lo) // (4 * tasks) + 1)
    bounds = sorted(at or [])
    begin = lo
    spans = []
    for v in dict.fromkeys(bounds):
        if v > begin:
            spans.append((begin, v, 1))
            begin = v
        if (many := bounds.count(v)) > 1:
            spans.append((v, v + 1, many))
            begin = v + 1
    if begin <= hi:
        spans.append((begin, hi + 1, 1))
    for a, z, parts in spans:
        rows += [(k, a, z, lines, parts) for k in range((a - lo) // width, (z - 1 - lo) // width + 1)]
        lines += parts
    return spark.createDataFrame(rows, "bucket long, lo long, hi long, first int, parts int"), lo, width, lines


def with_next(docs: DataFrame, n: int) -> DataFrame:
    """rid (place in ascending doc_id, then hash of the text), doc_id, text, next_text (after the last: the first).

    Documents are dealt to several ranges of ids for each of n tasks or more, and rows of a frequent id to ranges of their texts' hashes; each range
    gets a copy of the next one's first document as a guest at its end, so a window inside ranges sees every neighbour.
    """
    spark = docs.sparkSession
    every = documents(docs).withColumn("h", F.xxhash64("text"))
    lines, lo, width, count = _ranges(spark, every, RANGES * n)
    bucket = F.coalesce(F.floor((F.col("doc_id") - lo) / F.lit(width)).cast("long"), F.lit(-1))
    met = every.withColumn("bucket", bucket).join(F.broadcast(lines), "bucket").where("doc_id is null or (doc_id >= lo and doc_id < hi)")  # a line a range
    part = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("parts")).cast("int"), F.col("parts") - 1)
    ranged = met.select("doc_id", "text", "h", (F.col("first") + part).alias("range"))
    # a row a range: how many documents are before it, the first one, the range that it is a guest of
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("least"))
    order = Window.orderBy("range")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    host = F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sizes = Workspace(spark, "simhash").save(sizes.select("range", before.alias("base"), host.alias("host"), "least.doc_id", "least.h"), "ranges")
    firsts = F.broadcast(sizes.select("range", F.col("doc_id").alias("id"), F.col("h").alias("hash"), "host"))
    guests = ranged.join(firsts, "range").where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))).groupBy("host").agg(F.min("text").alias("text"))
    both = ranged.withColumn("guest", F.lit(0)).unionByName(guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("h"), F.col("host").alias("range"), F.lit(1).alias("guest")))
    w = Window.partitionBy("range").orderBy("guest", "doc_id", "h", "text")
    out = both.repartition(max(n, count // RANGES), "range").withColumn("next_text", F.lead("text").over(w)).withColumn("k", F.row_number().over(w)).where("guest = 0")
    bases = F.broadcast(sizes.select("range", "base"))
    return out.join(bases, "range").select((F.col("base") + F.col("k") - 1).alias("rid"), "doc_id", "text", "next_text")


def neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last half replaced by as much of the next document's start.  Null and empty texts: n_chars
    0, the digest of nothing, a fingerprint of zeros.  Rows of one id are ordered by their texts' hashes; a null id
    comes first.
    """
    n = partitions(spark)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    each = with_next(docs, n).select("rid", "doc_id", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(edited, 256)).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), edited.alias("text")))).alias("t"))
    voted = _votes(each.select("rid", "doc_id", "n_chars", "sha", "t.kind", "t.text"), ["rid", "doc_id", "n_chars", "sha", "kind"])
    paired = voted.groupBy("rid", "doc_id", "n_chars", "sha").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("fp_hi", "fp_lo")])
    saved = Workspace(spark, "simhash").save(paired, "fingerprints")
    total = saved.count()
    after = saved.select(((F.col("rid") - 1 + total) % total).alias("rid"), F.col("fp_hi0").alias("next_hi"), F.col("fp_lo0").alias("next_lo"))
    own = ("fp_hi0", "fp_lo0")
    return saved.join(after, "rid").select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), hex_of(*own).alias("fingerprint"), hex_of("fp_hi1", "fp_lo1").alias("edited_fingerprint"), likeness(own, ("fp_hi1", "fp_lo1")).alias("near_edited"), likeness(own, ("next_hi", "next_lo")).alias("near_next"))


def near_pairs(prints: DataFrame, radius: int = 7, joint: int = 2) -> tuple[DataFrame, DataFrame]:
    """All fingerprints within radius of each other: (pairs of distinct fingerprints' ids, membership).

    prints: doc_id, fp_hi, fp_lo.  Membership has doc_id and class_id, the least id of its fingerprint; pairs have
    left_id < right_id (class ids) and distance.  The 128 bits are cut into radius + joint blocks, of which two
    fingerprints within the radius agree on joint at least.  A table for each choice of joint blocks is permuted to have
    them in front and joined on them: 36 tables with keys of 28 bits at radius 7 and joint 2, so a table compares one
    pair in 2 ** 28 of unrelated fingerprints.  A pair is given out by the first choice that it agrees on, so none
    comes twice and none is lost.
    """
    classes = prints.groupBy("fp_hi", "fp_lo").agg(F.min("doc_id").alias("class_id"))
    membership = prints.join(classes, ["fp_hi", "fp_lo"]).select("doc_id", "class_id")
    count = radius + joint
    bits = [round(i * BITS / count) for i in range(count + 1)]
    choices = list(combinations(range(count), joint))

    def block(i: int) -> Column:
        """Bits [bits[i], bits[i + 1]) of both longs as one long."""
        parts = []
        for c, base in (("fp_hi", 0), ("fp_lo", 64)):
            a, z = max(bits[i], base) - base, min(bits[i + 1], base + 64) - base
            if a < z:
                parts.append((F.shiftrightunsigned(F.shiftleft(F.col(c), 64 - z), 64 - z + a), z - a))
        return parts[0][0] if len(parts) == 1 else F.shiftleft(parts[0][0], parts[1][1]).bitwiseOR(parts[1][0])

    blocked = classes.select("class_id", "fp_hi", "fp_lo", F.array(*[block(i) for i in range(count)]).alias("blocks"))

    def tables(side: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k).alias("i"), F.concat_ws("-", *[F.col("blocks")[i].cast("string") for i in c]).alias("b")) for k, c in enumerate(choices)])
        renamed = blocked.select(F.col("class_id").alias(f"{side}_id"), F.col("fp_hi").alias(f"{side}_hi"), F.col("fp_lo").alias(f"{side}_lo"), F.col("blocks").alias(f"{side}_blocks"), F.explode(keys).alias("k"))
        return renamed.select("*", "k.i", "k.b").drop("k")

    met = tables("left").join(tables("right"), ["i", "b"]).where("left_id < right_id")
    distance = F.bit_count(F.col("left_hi").bitwiseXOR(F.col("right_hi"))) + F.bit_count(F.col("left_lo").bitwiseXOR(F.col("right_lo")))
    equal = F.filter(F.transform(F.arrays_zip("left_blocks", "right_blocks"), lambda x, i: F.when(x["left_blocks"] == x["right_blocks"], i)), lambda i: i.isNotNull())
    known = F.array(*[F.array(*[F.lit(i) for i in c]) for c in choices])
    near = met.withColumn("distance", distance).where(F.col("distance") <= radius)
    return near.where(F.slice(equal, 1, joint) == known[F.col("i")]).select("left_id", "right_id", "distance"), membership
