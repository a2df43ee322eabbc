"""Incremental maintenance of snapshots: change detection, upsert, delete, states, roll-ups."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.batches import pieces


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and added, changed or removed by a full join; the digest decides only where both sides know it."""
    o = old.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.col("sha256").alias("h0"), F.lit(True).alias("was"))
    n = new.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"), F.col("sha256").alias("h1"), F.lit(True).alias("is"))
    both_known = F.col("h0").isNotNull() & F.col("h1").isNotNull()
    differs = ~F.col("s0").eqNullSafe(F.col("s1")) | F.when(both_known, F.col("h0") != F.col("h1")).otherwise(~F.col("m0").eqNullSafe(F.col("m1")))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(differs, "changed")
    return o.join(n, "path", "full").select("path", state.alias("change")).where("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows of files that come anew replace the old ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def delete(records: DataFrame, gone: DataFrame, key: str = "data_id") -> DataFrame:
    return records.join(gone.select(key).distinct(), key, "left_anti")


def in_scope(records: DataFrame, scope: DataFrame) -> DataFrame:
    """Records that the scope allows: whole knowledge bases or single documents; an empty scope allows nothing."""
    whole = scope.where("all_documents").select("kb_id").distinct()
    single = scope.where("not all_documents").select("kb_id", F.explode("documents").alias("file_name")).distinct()
    one = records.join(whole, "kb_id", "left_semi")
    return one.unionByName(records.join(whole, "kb_id", "left_anti").join(single, ["kb_id", "file_name"], "left_semi"))


def documents_with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with what the manifest says of their processed path, if anything."""
    entry = manifest.select(F.explode("processed").alias("path"), F.col("source").alias("source_path"), "title")
    return files.join(entry, "path", "left").withColumn("known", F.col("source_path").isNotNull())


def document_results(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures go to the document of their processed key, else of their source key, else of their prefix; roll-up."""
    by_processed = documents.select(F.col("processed").alias("key"), F.col("doc").alias("d1"))
    by_source = documents.select(F.col("source").alias("key"), F.col("doc").alias("d2"))
    prefix = F.split_part("key", F.lit(":"), F.lit(1))
    by_prefix = documents.select(F.col("processed").alias("prefix"), F.col("doc").alias("d3"))
    owned = failures.join(by_processed, "key", "left").join(by_source, "key", "left").withColumn("prefix", prefix).join(by_prefix, "prefix", "left").withColumn("doc", F.coalesce("d1", "d2", "d3"))
    n = owned.where("doc is not null").groupBy("doc").agg(F.count("*").alias("failures"), F.count_if(F.col("stage") == "image").alias("image_failures"))
    out = documents.join(n, "doc", "left").na.fill(0, ["failures", "image_failures"])
    return out.select("doc", "failures", "image_failures", F.when(F.col("failures") == 0, "ready").when(F.col("failures") == F.col("image_failures"), "warning").otherwise("failed").alias("status"))


def publish_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("documents"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "warning", "failed")])


def insert_stats(records: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows that can be indexed, their documents, and how many vectors the cache has."""
    good = records.where("body <> '' and data_id <> ''").withColumn("key", F.sha2("body", 256)).join(cached.select("key", F.lit(1).alias("hit")), "key", "left")
    return good.agg(F.count("*").alias("rows"), F.countDistinct("data_id").alias("documents"), F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


def add_documents(existing: DataFrame, offered: DataFrame, replace: bool = False) -> DataFrame:
    """What becomes of offered files: added, replaced or skipped."""
    known = existing.select("path", F.lit(True).alias("known"))
    return offered.join(known, "path", "left").select("path", F.when(F.col("known").isNull(), "added").when(F.lit(replace), "replaced").otherwise("skipped").alias("action"))


def pending_images(records: DataFrame, meta: str) -> DataFrame:
    """Image records to analyse again: made otherwise, failed, or with nothing to show."""
    return records.where((F.col("kind") == "image") & ((F.col("meta") != meta) | (F.col("analysis_error") != "") | ((F.col("description") == "") & (F.col("table_markdown") == ""))))


def unreferenced(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest.select(F.explode("processed").alias("path")).distinct(), "path", "left_anti")


def base_status(facts: DataFrame) -> DataFrame:
    """State of a knowledge base by the first fact that holds; a changed source takes ready back."""
    state = (
        F.when(F.col("processing"), "processing").when(F.col("n_records") == 0, "empty").when(~F.col("path_exists"), "missing").when(F.col("indexed") != F.col("n_records"), "broken")
        .when((F.col("failures") > 0) | F.col("source_changed"), "ready_with_warnings").otherwise("ready")
    )
    return facts.select("kb_id", state.alias("status"))


def import_sessions(known: DataFrame, offered: DataFrame) -> DataFrame:
    """Counts of sessions added (new ids with messages, once each) and skipped."""
    new = offered.where("n_messages > 0").select("id").distinct().join(known.select("id"), "id", "left_anti").agg(F.count("*").alias("added"))
    return new.crossJoin(offered.agg(F.count("*").alias("offered"))).select("added", (F.col("offered") - F.col("added")).alias("skipped"))  # one row each


def reconcile_suffix(runs: DataFrame) -> DataFrame:
    """Segments that equal the full text stay; where it goes on, the rest joins the last; else null."""
    whole = F.array_join("segments", "")
    rest = F.substring("full", F.length(whole) + 1, F.length("full"))
    longer = F.concat(F.slice("segments", F.lit(1), F.greatest(F.size("segments") - 1, F.lit(0))), F.array(F.concat(F.element_at("segments", -1), rest)))
    return runs.withColumn("out", F.when(F.size("segments") == 0, None).when(whole == F.col("full"), F.col("segments")).when(F.startswith("full", whole), longer))


def citations(references: DataFrame, most: int = 24) -> DataFrame:
    """Image references, distinct by their four-part key, the first so many."""
    key = ["kb_id", "source_data_id", "ref_key", "data_id"]
    return references.where("kind = 'image'").groupBy(*key).agg(F.min("pos").alias("pos")).orderBy("pos", *key).limit(most)


def merge_progress(events: DataFrame) -> DataFrame:
    """State of each file: the last value of each field that isn't null."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("status", "error", "current")]
    return events.groupBy("source").agg(*last)


def live_names(names: DataFrame, logs: DataFrame) -> DataFrame:
    """Names whose log is there."""
    return names.join(logs.select("log").distinct(), "log", "left_semi")


def last_runs(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks with the last time that a finished file names them (``yyyy-MM-dd_HHmm_task.md``)."""
    at = F.try_to_timestamp(F.left("file", F.lit(15)), F.lit("yyyy-MM-dd_HHmm"))
    runs = done.select(F.regexp_extract("file", r"^.{15}_(.*)\.md$", 1).alias("task"), at.alias("at")).groupBy("task").agg(F.max("at").alias("last_run"))
    return tasks.join(runs, "task", "left")


def next_number(names: DataFrame, pattern: str) -> DataFrame:
    return names.agg((F.coalesce(F.max(F.regexp_extract("name", pattern, 1).try_cast("long")), F.lit(0)) + 1).alias("next"))


def same_multiset(a: DataFrame, b: DataFrame, by: str | None = None) -> DataFrame:
    """Whether two tables hold the same rows as often, by one aggregation of both: same, or by and same for each value of
    a column."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    each = both.groupBy(*a.columns).agg(F.sum("_n").alias("_d"))
    most = F.coalesce(F.max(F.abs("_d")), F.lit(0)).alias("_most")
    return (each.groupBy(by).agg(most) if by else each.agg(most)).select(*([by] if by else []), (F.col("_most") == 0).alias("same"))


def checkpoint_matches(files: DataFrame, checkpoint: DataFrame, by: str) -> DataFrame:
    """by and matches: a checkpoint serves a run again only if both name the same files with the same contents."""
    return same_multiset(files, checkpoint, by).withColumnRenamed("same", "matches")


def distinct_sources(files: DataFrame) -> DataFrame:
    """Of selected files with one real path the first by path: real_path, path, n."""
    return files.groupBy("real_path").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def access_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("file").agg(F.count("*").alias("n"), F.max("day").alias("last"))


def next_in_cycle(items: DataFrame, by: str) -> DataFrame:
    """Each item with the next of its group, the first behind the last."""
    w = Window.partitionBy(by).orderBy("id")
    return items.withColumn("next_id", F.coalesce(F.lead("id").over(w), F.min("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def common_lines(old: list, new: list) -> int:
    """Length of the longest common subsequence of two lists.

    What both begin and end with, and lines of one side alone, are set aside.  If few places match, it is the longest
    rising run of matched places; if lines repeat so that places would multiply, one bit for each old line says
    where the longest run so far grows, and a new line moves all bits at once.  Both are exact.
    """
    begin = 0
    while begin < min(len(old), len(new)) and old[begin] == new[begin]:
        begin += 1
    end = 0
    while end < min(len(old), len(new)) - begin and old[-1 - end] == new[-1 - end]:
        end += 1
    old, new = old[begin : len(old) - end], new[begin : len(new) - end]
    here, there = set(old), set(new)
    old, new = [x for x in old if x in there], [x for x in new if x in here]
    places: dict = {}
    for i, x in enumerate(old):
        places.setdefault(x, []).append(i)
    if sum(len(places[x]) for x in new) <= 8 * (len(old) + len(new)):
        ends: list[int] = []  # the least place at which a run of each length ends
        for x in new:
            for i in reversed(places[x]):
                at = bisect_left(ends, i)
                ends[at : at + 1] = [i]
        return begin + end + len(ends)
    often = {x: sum(1 << i for i in p) for x, p in places.items() if len(p) > 1024}
    every = (1 << len(old)) - 1
    bits = every
    for x in new:
        met = bits & (often[x] if x in often else sum(1 << i for i in places[x]))
        bits = ((bits + met) | (bits - met)) & every
    return begin + end + len(old) - bits.bit_count()


def line_delta(versions: DataFrame) -> DataFrame:
    """doc_id, added, removed: lines of the new text, and of the old one, that aren't in the longest run of lines that
    both have in this order.  A line that moves is removed and added.

    versions: doc_id, old, new; null is empty.  Rows are independent; lines are cut in SQL, and only their comparison is
    a function, over batches.
    """

    def lines(c: str) -> Column:
        ended = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"\n\z", "")
        return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(ended, "\n", -1))

    @F.arrow_udf("long")
    def common(old: pa.Array, new: pa.Array) -> pa.Array:
        both = pa.RecordBatch.from_arrays([old, new], ["old", "new"])
        return pa.concat_arrays([pa.array([common_lines(a, b) for a, b in zip(own["old"].to_pylist(), own["new"].to_pylist(), strict=True)], pa.int64()) for own in pieces(both)])

    both = versions.select("doc_id", lines("old").alias("_old"), lines("new").alias("_new")).withColumn("_both", common("_old", "_new"))
    return both.select("doc_id", (F.size("_new") - F.col("_both")).alias("added"), (F.size("_old") - F.col("_both")).alias("removed"))



def reindex(records: DataFrame, texts: DataFrame, published: dict, contract: dict) -> DataFrame:
    """doc_id, chunk_index, body and the other columns of chunks: the published records (with those columns) as they are,
    or the texts chunked anew where the way of chunking has changed (contract: its names and sizes, target among them)."""
    from marlstone.operators import chunking

    if published == contract:
        return records
    return chunking.chunks(texts, contract.get("target", chunking.TARGET))
