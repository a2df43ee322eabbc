"""Scopes of access as columns: normalised so that anything unclear allows nothing, checked by joins on their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.retrieval import chunk_page

# The shape of a scope, its modes and where it can come from.
SHAPE = "mode string, origin string, kb_id string, kb_name string, data_id string, title string, targets array<struct<kb_id string, kb_name string, all_documents string, documents array<struct<data_id string, title string>>>>"
MODES, ORIGINS = ("none", "all", "kb", "document", "selection"), ("chat", "knowledge")
LIMITS = (1, 50)


def _firsts(values: Column, key) -> Column:
    """Elements whose key no earlier element has."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: ~F.array_contains(F.slice(keys, F.lit(1), i), key(x)))


def _within(data_id: Column, kb_id: Column) -> Column:
    return (data_id != "") & F.startswith(data_id, F.concat(kb_id, F.lit("::")))


def _target(t: Column) -> Column:
    kb = T.text(t["kb_id"])
    named = F.transform(F.coalesce(t["documents"], F.array().cast("array<struct<data_id:string,title:string>>")), lambda d: F.struct(T.text(d["data_id"]).alias("data_id"), T.text(d["title"]).alias("title")))
    whole = F.coalesce(t["all_documents"] == "true", F.lit(False))
    own = _firsts(F.filter(named, lambda d: _within(d["data_id"], kb)), lambda d: d["data_id"])
    return F.struct(kb.alias("kb_id"), T.text(t["kb_name"]).alias("kb_name"), whole.alias("all_documents"), F.when(whole, F.slice(own, 1, 0)).otherwise(own).alias("documents"))


def normalize(scopes: DataFrame) -> DataFrame:
    """id, mode, origin, kb_id, data_id, title, targets of scopes (id, scope as JSON).

    None or an empty object is all; what isn't an object, has an unknown mode or lacks what its mode needs is none.
    A selection keeps the first target of a base, with the first of equal documents, if it has all or any of its own.
    """
    raw = scopes.select("id", F.coalesce("scope", F.lit("{}")).alias("scope")).withColumn("s", F.from_json("scope", SHAPE))
    mode, kb, doc = F.lower(T.text(F.col("s.mode"))), T.text(F.col("s.kb_id")), T.text(F.col("s.data_id"))
    targets = F.filter(F.transform(F.coalesce("s.targets", F.from_json(F.lit("[]"), SHAPE.split("targets ", 1)[1])), _target), lambda t: (t["kb_id"] != "") & (t["all_documents"] | (F.size(t["documents"]) > 0)))
    rows = raw.select("id", "scope", mode.alias("asked"), F.lower(T.text(F.col("s.origin"))).alias("from"), kb.alias("kb"), doc.alias("doc"), T.text(F.col("s.title")).alias("name"), _firsts(targets, lambda t: t["kb_id"]).alias("wanted"))
    an_object, empty = F.col("scope").rlike(r"(?s)^\s*\{.*\}\s*$"), F.col("scope").rlike(r"^\s*(?:\{\s*\}|null)\s*$")
    good = (
        F.when(F.col("asked").isin("kb"), F.col("kb") != "").when(F.col("asked") == "document", (F.col("kb") != "") & _within(F.col("doc"), F.col("kb")))
        .when(F.col("asked") == "selection", F.size("wanted") > 0).otherwise(F.col("asked").isin("none", "all"))
    )
    known = an_object & F.col("asked").isin(*MODES)
    final = F.when(empty, "all").when(known & good, F.col("asked")).otherwise("none")
    origin = F.when(empty | ~known, "chat").when(F.col("from").isin(*ORIGINS), F.col("from")).when(F.col("asked").isin("kb", "document"), "knowledge").otherwise("chat")
    out = rows.select("id", final.alias("mode"), origin.alias("origin"), "kb", "doc", "name", "wanted")
    narrow, single = F.col("mode").isin("kb", "document"), F.col("mode") == "document"
    return out.select("id", "mode", "origin", F.when(narrow, F.col("kb")).alias("kb_id"), F.when(single, F.col("doc")).alias("data_id"), F.when(single, F.nullif("name", F.lit(""))).alias("title"), F.when(F.col("mode") == "selection", F.col("wanted")).alias("targets"))


def allowed(requests: DataFrame, normal: DataFrame) -> DataFrame:
    """requests (id of a scope, kb_id, data_id) with allowed; an unknown scope allows nothing."""
    own = normal.select("id", "mode", F.col("kb_id").alias("_kb"), F.col("data_id").alias("_doc"), "targets")
    kb, doc = F.col("kb_id"), F.col("data_id")
    chosen = F.exists("targets", lambda t: (t["kb_id"] == kb) & (t["all_documents"] | F.exists(t["documents"], lambda d: d["data_id"] == doc)))
    ok = F.when(F.col("mode") == "all", True).when(F.col("mode") == "kb", F.col("_kb") == kb).when(F.col("mode") == "document", (F.col("_kb") == kb) & (F.col("_doc") == doc)).when(F.col("mode") == "selection", chosen)
    return requests.join(own, "id", "left").select(*requests.columns, F.coalesce(ok, F.lit(False)).alias("allowed"))


def list_documents(records: DataFrame, normal: DataFrame, scope) -> DataFrame:
    """kb_id, data_id, n_chunks of the documents that a scope allows, each once."""
    every = records.groupBy("kb_id", "data_id").agg(F.count("*").alias("n_chunks"))
    return allowed(every.withColumn("id", F.lit(scope)), normal).where("allowed").drop("id", "allowed")


def list_chunks(records: DataFrame, normal: DataFrame, scope, data_id: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of a document's chunks (chunk_index, preview, evidence_type, next_offset, null on the last page) if the
    scope allows it; nothing otherwise.  The limit is from 1 to 50."""
    if offset < 0 or not LIMITS[0] <= limit <= LIMITS[1]:
        raise ValueError(f"offset is 0 or more, limit from {LIMITS[0]} to {LIMITS[1]}")
    own = records.where(F.col("data_id") == data_id)
    seen = allowed(own.withColumn("id", F.lit(scope)), normal).where("allowed")
    page = chunk_page(seen, data_id, offset, limit)
    kinds = seen.select("data_id", "chunk_index", T.content_type(F.col("content_type"), F.col("kind"), F.col("table_markdown"), F.col("body")).alias("evidence_type"))
    return page.join(kinds, ["data_id", "chunk_index"]).select("chunk_index", "preview", "evidence_type", F.when(F.col("has_more"), F.lit(offset + limit)).alias("next_offset"))
