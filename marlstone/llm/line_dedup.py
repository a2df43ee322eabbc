"""Operator 7: near-duplicate lines by deletion neighbourhoods, with DataFrame functions only.

Two strings within one edit share a variant: one of them, or both, with one character deleted.  All variants of a
line are emitted as hashed keys and equal ones meet.  To keep that linear for long lines, a line is first cut into
segments.  An edit lies in one segment, so what is before and behind it is equal: those parts' hashes make the first
part of the key, and only the middle is varied.  Lines whose parts meet no other line's are out before that.

No pair of a group is ever built.  Lines that agree but for the character at one position are all within one edit of
each other, so the earliest of a group stands for all; and where a line equals another's variant, the group has that
one line and those others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Workspace

FINE = 8
_BLANKS = " \t\r\v\f"
#: Ids of up to so many lines (16 bytes each) are broadcast after they are counted; more are shuffled.
BROADCAST_LINES = 1_000_000


def _halves(n: Column, line: Column) -> Column:
    """Four keys: for both lengths that a pair's shorter line can have (this one's, one less), what stands behind its
    first half and what stands before its second.  One edit leaves one of the two as it is."""
    out = []
    for short in (n, n - 1):
        half = F.floor(short / 2).cast("int")
        out += [F.xxhash64(short, F.lit(0), F.right(line, short - half)), F.xxhash64(short, F.lit(1), F.left(line, half))]
    return F.array(*out)


def _parts(n: Column, line: Column, segments: int) -> Column:
    """Keys of a line for both lengths that a pair's shorter line can have (its own, one less) and each segment.

    A struct has: same (own length), k1, k2 (hashes of what stands before and behind, with length and segment), mid.
    """

    def part(j: Column) -> Column:
        same, i = j < segments, F.pmod(j, F.lit(segments))
        short = n - F.when(same, 0).otherwise(1)
        a, z = F.floor(short * i / segments).cast("int"), F.floor(short * (i + 1) / segments).cast("int")
        tail = short - z
        before, behind = F.substring(line, F.lit(1), a), F.substring(line, n - tail + 1, tail)
        keys = F.xxhash64(short, i, before, behind).alias("k1"), F.xxhash64(before, F.lit("|"), behind, i, short).alias("k2")
        return F.struct(same.alias("same"), *keys, F.substring(line, a + 1, n - tail - a).alias("mid"))

    return F.transform(F.sequence(F.lit(0), F.lit(2 * segments - 1)), part)


def _trimmed(line: Column) -> Column:
    """Without ASCII white space at both ends; the general trim is slow and only runs where more than spaces stand there."""
    t = F.trim(line)
    return F.when((F.ascii(t) <= 32) | (F.ascii(F.right(t, F.lit(1))) <= 32), F.btrim(t, F.lit(_BLANKS))).otherwise(t)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line (trimmed), chars, h1, h2 of lines that aren't blank."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    cut = cut.select("doc_id", "line_no", _trimmed(F.col("raw")).alias("line")).withColumn("chars", F.length("line"))
    return cut.where(F.col("chars") > 0).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _shared(keys: DataFrame, by: list[str]) -> DataFrame:
    """Rows of keys whose key others have too; counted with partial sums, then a semi join, which Spark can split."""
    many = keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(many, by, "left_semi")


def near_earlier(spark: SparkSession, ws: Workspace, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2 of distinct lines that are within one edit of a line with an earlier first occurrence."""
    keyed = distinct.select("h1", "h2", F.explode("keys").alias("k"))
    met = ws.save(_shared(keyed, ["k"]).select("h1", "h2").distinct(), "met")
    few = F.broadcast(met) if met.count() <= BROADCAST_LINES else met
    texts = _lines(docs).join(few, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "line", "chars")).alias("first"))
    texts = texts.select("h1", "h2", F.struct("first.doc_id", "first.line_no").alias("place"), F.col("first.line").alias("line"), F.col("first.chars").alias("chars"))
    fine = texts.select("h1", "h2", F.col("place").alias("first"), F.explode(_parts(F.col("chars"), F.col("line"), FINE)).alias("k")).select("h1", "h2", "first", "k.*")
    fine = ws.save(_shared(fine, ["k1", "k2"]), "fine")
    ws.drop(met)

    n = F.length("mid")
    deleted = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.struct(p.alias("p"), F.xxhash64(F.concat(F.substring(F.col("mid"), F.lit(1), p - 1), F.substring(F.col("mid"), p + 1, n))).alias("v")))).otherwise(F.array().cast("array<struct<p:int,v:bigint>>"))
    itself = F.array(F.struct(F.lit(0).alias("p"), F.xxhash64("mid").alias("v")))
    # role 0: alike but for position p; role 1: the line itself; role 2: a line with one character more
    role = lambda r, rows: F.transform(rows, lambda x: F.struct(F.lit(r).alias("role"), (x["p"] if r == 0 else F.lit(0)).alias("p"), x["v"].alias("v")))
    emitted = F.when(F.col("same"), F.concat(role(0, deleted), role(1, itself))).otherwise(F.array_distinct(role(2, deleted)))
    variants = fine.select("h1", "h2", "first", "mid", "k1", "k2", F.explode(emitted).alias("e")).select("h1", "h2", "first", "mid", "k1", "k2", (F.col("e.role") > 0).alias("whole"), "e.role", "e.p", "e.v")
    key = ["k1", "k2", "whole", "p", "v"]
    entry = F.struct("first", "mid")
    groups = variants.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.when(F.col("role") == 0, entry)).alias("any"), F.min(F.when(F.col("role") == 1, entry)).alias("one"), F.min(F.when(F.col("role") == 2, entry)).alias("longer")).where("n > 1")
    other = F.when(F.col("role") == 0, F.col("any")).when(F.col("role") == 1, F.col("longer")).otherwise(F.col("one"))
    linked = variants.join(groups, key).withColumn("other", other).where(F.col("other").isNotNull())
    near = linked.where((F.col("other.first") < F.col("first")) & (F.levenshtein("mid", "other.mid") <= 1))
    found = ws.save(near.select("h1", "h2").distinct(), "near")
    ws.drop(fine)
    return found


def removed_lines(spark: SparkSession, docs: DataFrame, bound: int = 1, edit_chars: int = 0) -> DataFrame:
    """doc_id, removed (array of line numbers from 0) of documents that lose lines.

    Lines are parts between line ends, compared without ASCII white space at their ends; blank lines stay.  Of equal
    lines the first by (doc_id, line number) stays, null ids first; a line also goes if one within bound edits (0 or 1
    characters) occurs earlier, even one that goes itself.  A caller for whom one edit makes "1." of "2." gives
    edit_chars: lines of fewer characters are then compared for equality only.  Rows of one doc_id are one place:
    equal rows are treated alike.
    """
    if bound not in (0, 1):
        raise ValueError("bound is 0 or 1")
    ws = Workspace(spark, "line-dedup")
    lines = _lines(docs)
    keys = [F.first("keys", True).alias("keys")] if bound else []
    keyed = lines.withColumn("keys", F.when(F.col("chars") >= edit_chars, _halves(F.col("chars"), F.col("line")))) if bound else lines
    distinct = ws.save(keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"), *keys), "distinct")
    several = distinct.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    if bound:
        near = near_earlier(spark, ws, docs, distinct).withColumn("near", F.lit(True))
        marked = distinct.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left")
        several = marked.where("n > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    met = lines.select("doc_id", "line_no", "h1", "h2").join(several, ["h1", "h2"])
    gone = met.where("near or not (struct(doc_id, line_no) <=> first)")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(spark: SparkSession, docs: DataFrame, bound: int = 1, edit_chars: int = 0) -> DataFrame:
    """The rows of docs with text, n_lines and n_removed: text has lost the lines of removed_lines().

    Null texts stay null with 0 lines; a text whose lines all go becomes empty.
    """
    gone = Workspace(spark, "line-dedup").save(removed_lines(spark, docs, bound, edit_chars), "removed").select(F.col("doc_id").alias("_marlstone_id"), F.col("removed").alias("_marlstone_removed"))
    # always dealt by id: what is removed grows with the corpus
    joined = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_marlstone_id")), "left").drop("_marlstone_id")
    # a column of its own: inside a lambda an expression is computed for each element
    joined, lines = joined.withColumn("_marlstone_lines", F.split("text", "\n", -1)), F.col("_marlstone_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_marlstone_removed")), lambda i: F.element_at(lines, i + 1))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    out = joined.withColumn("n_lines", n).withColumn("n_removed", F.when(F.col("text").isNull() | F.col("_marlstone_removed").isNull(), F.lit(0)).otherwise(F.size(F.array_intersect("_marlstone_removed", F.sequence(F.lit(0), F.size(lines) - 1)))).cast("long"))
    return out.withColumn("text", F.when(F.col("_marlstone_removed").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_marlstone_removed", "_marlstone_lines")
