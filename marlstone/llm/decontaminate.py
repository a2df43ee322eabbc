"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

Short test items are sought inside long documents.  Items are partitioned by the number of their shingles; a
partition's MinHash sketch keeps so many least hashes of an item that, at the wanted containment, a document can't
miss all of them.  So documents probe a small table with their shingle hashes, no candidate is lost whatever the
document's length, and candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Workspace, documents

WIDTH = 5
#: Tables of up to so many narrow rows (a few tens of MB) are broadcast after they are counted; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, so that punctuation and case hide nothing."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(w: Column, width: int) -> Column:
    return F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def hashes(w: Column, width: int = WIDTH) -> Column:
    """Hash of each shingle; fewer words than width are one shingle; no words, none."""
    return F.transform(_starts(w, width), lambda i: F.xxhash64(F.slice(w, i, width)))


def shingles(w: Column, width: int = WIDTH) -> Column:
    return F.array_distinct(F.transform(_starts(w, width), lambda i: F.array_join(F.slice(w, i, width), " ")))


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sketches(items: DataFrame, least: float) -> DataFrame:
    """item_id, hash: of an item with n distinct shingles in the partition of sizes up to u, the u - ceil(least u) + 1
    least hashes.  A document that misses all of them misses more than (1 - least) n."""
    sized = items.select("item_id", F.array_sort(F.array_distinct(hashes(F.col("w")))).alias("h")).where(F.size("h") > 0)
    upper = F.pow(2, F.floor(F.log2(F.size("h").cast("double"))) + 1) - 1
    k = (upper - F.ceil(upper * F.lit(least) - 1e-9) + 1).cast("int")
    return sized.select("item_id", F.explode(F.slice("h", F.lit(1), F.least(k, F.size("h")))).alias("hash")).distinct()


def search(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment of every item of which a document holds at least that share.

    Shingles are five words of letters and digits; an item or document with fewer words is one shingle, one without
    words holds nothing and is found nowhere.  Rows of one doc_id are judged each by itself and the best counts;
    likewise rows of one item_id.  Null ids are kept as an id of their own.
    """
    ws = Workspace(spark, "decontaminate")
    items = ws.save(benchmark.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0).distinct(), "items")
    probe = ws.save(sketches(items, least), "sketches")
    texts = documents(docs).withColumn("w", words(F.col("text")))
    hits = texts.select("doc_id", F.explode(hashes(F.col("w"))).alias("hash")).join(_checked(probe), "hash")
    candidates = ws.save(hits.select("doc_id", "item_id").distinct(), "candidates")

    own = _checked(ws.save(candidates.select(F.col("doc_id").alias("id")).distinct(), "documents"))
    held = texts.join(own, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    held = held.select("doc_id", F.xxhash64("text").alias("row"), F.explode(shingles(F.col("w"))).alias("s"))
    tests = items.select("item_id", F.xxhash64("w").alias("item_row"), shingles(F.col("w")).alias("all"))
    tests = tests.select("item_id", "item_row", F.size("all").alias("n_shingles"), F.explode("all").alias("s"))
    found = held.distinct().join(_checked(ws.save(tests, "tests")), "s").groupBy("doc_id", "row", "item_id", "item_row", "n_shingles").agg(F.count("*").alias("n_found"))
    good = found.where(F.col("n_found") * 1_000_000 >= F.col("n_shingles") * int(round(least * 1_000_000)))
    # a pair that the sketches gave, verified
    good = good.join(candidates.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i")), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi")
    share = F.col("n_found") / F.col("n_shingles")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(share.alias("containment"), "n_shingles", "n_found")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_shingles").cast("long").alias("n_shingles"), F.col("b.n_found").cast("long").alias("n_found"), F.col("b.containment").alias("containment"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """The rows of docs, with all their columns, whose id isn't found by search()."""
    bad = Workspace(spark, "decontaminate").save(search(spark, docs, benchmark, least).select(F.col("doc_id").alias("_marlstone_bad")).distinct(), "bad")
    return docs.join(_checked(bad), F.col("doc_id").eqNullSafe(F.col("_marlstone_bad")), "left_anti")
