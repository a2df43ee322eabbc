"""Interval and reference joins inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T


def overlaps(spans: DataFrame, windows: DataFrame, width: int = 4096) -> DataFrame:
    """Spans [start, end) that overlap windows [lo, hi) of the same document.

    Both sides go to bins of a document, so one long document is many keys; a pair is given out in the first bin that
    both lie in.
    """
    s = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / width))))
    w = windows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.greatest(F.col("lo"), F.col("hi") - 1) / width))))
    met = s.join(w, ["doc_id", "bin"]).where("start < hi and end > lo")
    return met.where(F.col("bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("lo") / width))).drop("bin")


def line_of(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """Line of each offset: one sort of offsets and line starts together, and the last start so far."""
    both = starts.select("doc_id", F.col("start").alias("at"), F.col("line_no"), F.lit(None).cast("long").alias("offset")).unionByName(offsets.select("doc_id", F.col("offset").alias("at"), F.lit(None).cast("int").alias("line_no"), "offset"))
    w = Window.partitionBy("doc_id").orderBy("at", F.col("offset").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("line_no", F.last("line_no", True).over(w)).where("offset is not null").select("doc_id", "offset", "line_no")


def heading_within(lines: DataFrame, back: int = 80) -> DataFrame:
    """Nearest heading at most so many lines above."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-back, 0)
    title = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), T.strip(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    return lines.withColumn("heading", F.last(title, True).over(w))


def related_paragraphs(paragraphs: DataFrame, keys: DataFrame, most: int = 5, budget: int = 1800) -> DataFrame:
    """Paragraphs that name a key: not captions, images or lists of eight numbers or more; the first ones of each
    document and key, up to a budget of characters, the last one cut."""
    signed = paragraphs.where(F.contains("text", F.lit("图")) | F.contains("text", F.lit("表")))  # cheap, before any expression
    keys_of = lambda refs: F.when((F.size(refs) > 0) & (F.size(refs) < 8), F.array_distinct(F.transform(refs, T.ref_key)))
    # outer, as Spark would search each text once more to see whether there is anything to explode
    named = signed.where(~F.contains("text", F.lit("!["))).select("doc_id", "pos", "text", F.explode_outer(T.bound(T.ref_candidates(F.col("text")), keys_of)).alias("ref_key")).where(F.col("ref_key").isNotNull())
    caption = (F.length(T.strip(F.col("text"))) <= 80) & T.strip(F.col("text")).rlike("^" + T.REF) & (T.ref_key(F.col("text")) == F.col("ref_key"))
    w = Window.partitionBy("doc_id", "ref_key").orderBy("pos")
    met = named.where(~caption).join(keys, ["doc_id", "ref_key"], "left_semi").withColumns({"k": F.row_number().over(w), "before": F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return met.where((F.col("k") <= most) & (F.col("before") < budget)).select("doc_id", "ref_key", "pos", F.substring("text", F.lit(1), (budget - F.col("before")).cast("int")).alias("text"))


def title_keys(titles: DataFrame, keys: DataFrame) -> DataFrame:
    """The longest key that a title begins with."""
    t = titles.withColumn("_t", T.compact_ref(F.col("title")))
    k = keys.select("doc_id", "ref_key", T.compact_ref(F.col("ref_key")).alias("_k"))
    met = t.join(k, "doc_id").where(F.startswith("_t", F.col("_k")) & (F.col("_k") != ""))
    return met.groupBy("doc_id", "title").agg(F.max_by("ref_key", F.length("_k")).alias("ref_key"))


def one_job_a_hash(jobs: DataFrame, contexts: int = 3, chars: int = 1200) -> DataFrame:
    """One analysis job for each content hash: the best focus first, a few distinct contexts, all origins."""
    rank = F.when(F.col("focus") == "table", 2).when(F.col("focus") == "figure", 1).otherwise(0)
    distinct = jobs.groupBy("sha", "context").agg(F.min("pos").alias("pos"), F.max(F.struct(rank.alias("rank"), (-F.col("pos")).alias("p"), "focus")).alias("f"), F.count("*").alias("n"))
    first = distinct.withColumn("k", F.row_number().over(Window.partitionBy("sha").orderBy("pos", "context")))
    return first.groupBy("sha").agg(F.max("f").alias("f"), F.array_sort(F.collect_list(F.when(F.col("k") <= contexts, F.struct("k", "context")))).alias("c"), F.sum("n").alias("origins")).select("sha", F.col("f.focus").alias("focus"), F.left(F.array_join(F.transform("c", lambda x: x["context"]), "\n"), F.lit(chars)).alias("context"), "origins")


def focus(c):
    """table, figure or general by the words of a text."""
    return F.when(c.rlike(r"(?i)(?:表\s*[0-9]|\btable\b|表格)"), "table").when(c.rlike(r"(?i)(?:图\s*[0-9]|\bfig(?:ure)?\b|示意图)"), "figure").otherwise("general")


def unique_basenames(names: DataFrame, files: DataFrame) -> DataFrame:
    """Names with the one file of that base name; those with none or several are left out."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    single = files.groupBy(base.alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").drop("n")
    return names.withColumn("base", F.lower("name")).join(single, "base").select("name", "path")
