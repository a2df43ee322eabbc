"""Queries of the lookups, paths, and their SQL."""

from __future__ import annotations

import contextlib
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import caching, chunking, control, lookups, maintenance, paths, scopes, sessions, tree
from marlstone.plans.inputs import RECORDS, REF_KEY, records, table
from marlstone.session import shared
from marlstone.sources import imports

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("r14_resolve_images", f"WITH {RECORDS}, i AS (SELECT '图' || (doc_id % 9) || '-' || chunk_index AS ref_key, count(*) AS n, array_to_string(list_sort(list_distinct(list(data_id)))[1:10], ',') AS ids FROM records WHERE kind = 'image' GROUP BY 1), q AS (SELECT unnest(['图1-2', '图8-203', '图77-1']) AS ref_key) SELECT ref_key, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, coalesce(ids, '') AS candidates FROM q LEFT JOIN i USING (ref_key)")
def r14(spark, d):
    images = records(spark, d).where("kind = 'image'").select(T.ref_key(F.col("label")).alias("ref_key"), F.col("data_id").alias("image_id"))
    return lookups.resolve_images(spark.createDataFrame([("图1-2",), ("图8-203",), ("图77-1",)], "ref_key string"), images)


@query("r15_chunk_citation", f"WITH {RECORDS} SELECT data_id, chunk_index, 'file=' || file_name || '; section=' || lang || '; chunk=' || chunk_index AS hint FROM records JOIN documents USING (doc_id) WHERE data_id = 'd3'")
def r15(spark, d):
    r = records(spark, d).where("data_id = 'd3'").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return r.select("data_id", "chunk_index", lookups.hint({"file": F.col("file_name"), "section": F.col("lang"), "note": F.lit(""), "chunk": F.col("chunk_index").cast("string")}).alias("hint"))


@query("r22_keyword_filter", "SELECT DISTINCT conv_id FROM conversations WHERE contains(lower(text), 'tion')")
def r22(spark, d):
    return table(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit("tion"))).select("conv_id").distinct()


@query("f8_uncertain", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a|' || event_type WHEN 1 THEN event_type ELSE '' END AS uncertain FROM events")
def f8(spark, d):
    k = F.col("event_id") % 3
    c = F.when(k == 0, F.to_json(F.array(F.lit("a"), "event_type"))).when(k == 1, F.col("event_type")).otherwise("")
    return table(spark, d, "events").select("event_id", F.array_join(lookups.uncertain_list(c), "|").alias("uncertain"))


@query("f10_resolve_documents", "WITH k AS (SELECT lower(source) AS key, count(*) AS n, min(doc_id) AS d FROM documents GROUP BY 1), q AS (SELECT doc_id AS request, 'src1' AS key FROM documents WHERE doc_id < 5 UNION ALL SELECT -1, 'src1' UNION ALL SELECT -2, 'nothing') SELECT request, CASE WHEN request >= 0 THEN request WHEN n = 1 THEN d END AS doc FROM q LEFT JOIN k USING (key)")
def f10(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    asked = docs.where("doc < 5").select(F.col("doc").alias("request"), F.lit("src1").alias("key")).unionByName(spark.createDataFrame([(-1, "src1"), (-2, "nothing")], "request long, key string"))
    return lookups.resolve_documents(asked, docs, F.lower("source"))


@query("g1_image_references", "SELECT doc_id, 0 AS pos, 'cat ' || doc_id AS alt, 'img/' || doc_id || '.png' AS path FROM documents")
def g1(spark, d):
    """Texts whose own images are defused, so that SQL knows what is left; g1_image_references_whole has them as they are."""
    i = F.col("doc_id").cast("string")
    own = F.replace(F.coalesce("text", F.lit("")), F.lit("!["), F.lit("!("))
    t = F.concat(F.lit("![ cat "), i, F.lit("](img/"), i, F.lit('.png "t") '), own, F.lit(" ![x](http://a/b.png)"))
    return lookups.image_references(table(spark, d, "documents").select("doc_id", t.alias("text")))


@query("g1_image_references_whole")
def g1_all(spark, d):
    i = F.col("doc_id").cast("string")
    t = F.concat(F.lit("![ cat "), i, F.lit("](img/"), i, F.lit('.png "t") '), F.coalesce("text", F.lit("")), F.lit(" ![x](http://a/b.png)"))
    return lookups.image_references(table(spark, d, "documents").select("doc_id", t.alias("text")))


# Lines with an explicit caption: a number at the line's begin, behind heading marks, then a delimiter or nothing.
_EXPLICIT = r"""c AS (SELECT doc_id, line_no, line, trim(regexp_replace(line, '\A\s+|\s+\z', '', 'g')) <> '' AS full_, regexp_matches(line, '!\[[^\]]*\]\([^)\s]+(?:\s+"[^"]*")?\)') AS has,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '!\[[^\]]*\]\([^)\s]+(?:\s+"[^"]*")?\)', '', 'g'), '\A\s+|\s+\z', '', 'g'), '\\([~*_#])', '\1', 'g'), '^[*_`]+|[*_`]+$', '', 'g'), '\s+', ' ', 'g')) AS clean FROM l),
h AS (SELECT *, replace(regexp_replace(clean, '^\s{0,3}#{1,6}\s+', ''), '：', ':') AS head FROM c),
k AS (SELECT *, regexp_extract(head, '^(?:图|表)\s*[0-9]{1,3}(?:\s*[-–—.·]\s*[0-9]{1,3}){0,3}', 0) AS number FROM h),
x AS (SELECT *, CASE WHEN number <> '' AND (trim(substr(head, length(number) + 1)) = '' OR regexp_matches(ltrim(substr(head, length(number) + 1)), '^[:.、—–-]')) THEN clean END AS cap FROM k)"""

# Each line of kind image is an image before its own text, by document: on one line with it, or with blank lines between
# it and what is above, or above and below. Odd documents name every other figure on both sides of its image.
_G6 = f"""WITH {RECORDS}, b AS (SELECT doc_id, chunk_index, kind, CASE WHEN doc_id % 2 = 1 AND chunk_index % 3 > 0 AND (chunk_index - 1) // 3 % 2 = 0 THEN '图 ' || (chunk_index - 1) // 3 % 500 || '： ' || body ELSE body END AS body FROM records),
a AS (SELECT doc_id, chunk_index, CASE WHEN kind <> 'image' THEN [body] WHEN doc_id % 8 < 2 THEN ['![x](y.png) ' || body] WHEN doc_id % 8 < 4 THEN ['![x](y.png)', body] WHEN doc_id % 8 < 6 THEN ['', '![x](y.png)', body] ELSE ['', '![x](y.png)', '', body] END AS ls FROM b),
l AS (SELECT doc_id, chunk_index * 4 + i AS line_no, ls[i + 1] AS line FROM (SELECT *, unnest(range(0, len(ls))) AS i FROM a)),
{{EXPLICIT}},
n AS (SELECT *, lag(full_) OVER w AS f1, lag(full_, 2) OVER w AS f2, lag(cap) OVER w AS c1, lag(cap, 2) OVER w AS c2, lead(full_) OVER w AS g1, lead(full_, 2) OVER w AS g2, lead(cap) OVER w AS d1, lead(cap, 2) OVER w AS d2 FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
m AS (SELECT *, CASE WHEN f1 THEN 1 WHEN f1 IS NOT NULL AND f2 THEN 2 END AS at_a, CASE WHEN g1 THEN 1 WHEN g1 IS NOT NULL AND g2 THEN 2 END AS at_b FROM n WHERE has),
o AS (SELECT *, CASE at_a WHEN 1 THEN c1 WHEN 2 THEN c2 END AS a, CASE at_b WHEN 1 THEN d1 WHEN 2 THEN d2 END AS b FROM m)
SELECT doc_id, line_no, coalesce(cap, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN at_a < at_b THEN a WHEN at_b < at_a THEN b WHEN {REF_KEY.format("a")} = {REF_KEY.format("b")} AND {REF_KEY.format("a")} <> '' THEN a END) AS caption FROM o"""
_G6 = _G6.replace("{EXPLICIT}", _EXPLICIT)


@query("g6_captions", _G6)
def g6(spark, d):
    c, n = F.col("chunk_index"), F.expr("(chunk_index - 1) div 3")
    named = (F.col("doc_id") % 2 == 1) & (c % 3 > 0) & (n % 2 == 0)
    body = F.when(named, F.concat(F.lit("图 "), (n % 500).cast("string"), F.lit("： "), "body")).otherwise(F.col("body"))
    image, blank, k = F.lit("![x](y.png)"), F.lit(""), F.col("doc_id") % 8
    ls = F.when(F.col("kind") != "image", F.array("body")).when(k < 2, F.array(F.concat(image, F.lit(" "), "body"))).when(k < 4, F.array(image, "body")).when(k < 6, F.array(blank, image, "body")).otherwise(F.array(blank, image, blank, "body"))
    rows = records(spark, d).withColumn("body", body).select("doc_id", "chunk_index", F.posexplode(ls).alias("i", "line"))
    return lookups.captions(rows.select("doc_id", (c * 4 + F.col("i")).alias("line_no"), "line"))


@query("g8_near_text")
def g8(spark, d):
    """All lines; those of kind image are images with captions above, sources below and prose before, in turn."""
    c, k = F.col("chunk_index"), F.col("doc_id") % 3
    number = F.concat(F.lit("图 "), (c % 1000).cast("string"))
    ls = F.array(F.concat(number, F.lit("： "), "body"), F.lit(""), F.lit('![x](y.png "t") [a link](z)'), F.when(k == 0, F.lit("来源：报告")).when(k == 1, F.concat(number, F.lit(" 所示"))).otherwise(F.concat(number, F.lit(". below"))))
    rows = records(spark, d).select("doc_id", "chunk_index", F.posexplode(F.when(F.col("kind") == "image", ls).otherwise(F.array("body"))).alias("i", "line"))
    return lookups.near_text(rows.select("doc_id", (c * 4 + F.col("i")).alias("line_no"), "line"))


@query("w14_fold_turns", "SELECT conv_id, turn, turn = max(turn) OVER (PARTITION BY conv_id) AS last, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN text ELSE left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 72) END AS shown FROM conversations")
def w14(spark, d):
    return lookups.fold_turns(table(spark, d, "conversations"))


_FLAT = "left(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')), 60)"


@query("w15_recent_context", f"WITH p AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS q, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS a, max(turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, {_FLAT.format('q')} AS question, {_FLAT.format('a')} AS answer FROM p WHERE conv_id <> 3 ORDER BY t DESC, conv_id LIMIT 5")
def w15(spark, d):
    return lookups.recent_context(sessions.previews(table(spark, d, "conversations")), 3)


@query("a15_progress", "SELECT lang, CAST(count_if(doc_id % 3 = 0) AS BIGINT) AS done, count(*) AS total, bool_and(doc_id % 3 = 0) AS complete FROM documents GROUP BY 1")
def a15(spark, d):
    return lookups.progress(table(spark, d, "documents").select("lang", (F.col("doc_id") % 3 == 0).alias("done")), "lang")


@query("a19_history_size", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) // 2 AS BIGINT) AS rough FROM conversations GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars")).withColumn("rough", F.expr("chars div 2"))


@query("v7_tail_behind", "SELECT conv_id, CASE conv_id % 2 WHEN 0 THEN 'b|' || conv_id END AS tail FROM (SELECT DISTINCT conv_id FROM conversations)")
def v7(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct()
    log = F.array(F.lit("a"), F.lit("b"), F.col("conv_id").cast("string"))
    known = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("z")))
    return tree.tail_behind(c.select("conv_id", log.alias("log"), known.alias("known"))).select("conv_id", F.array_join("tail", "|").alias("tail"))


@query("x11_lenient_json", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE props END AS object FROM events")
def x11(spark, d):
    k = F.col("event_id") % 3
    c = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" done"))).otherwise("nothing {")
    return table(spark, d, "events").select("event_id", lookups.lenient_json(c).alias("object"))


@query("x13_tool_calls", """WITH p AS (SELECT event_id, CAST(json(props) AS VARCHAR) AS a, 'n' || event_id % 5 AS n FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN n || a || '|m{}' WHEN 1 THEN n || a || '|m{"x":[1]}' WHEN 2 THEN 'f' || a || '|' || n || '{}' WHEN 3 THEN 'bad_json{"msg":"Failed to parse function arguments for f"}' WHEN 4 THEN '' ELSE 't' || a || '|f' || a END AS calls FROM p""")
def x13(spark, d):
    name = F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string"))
    forms = [
        F.concat(F.lit('said [{"type": "tool_use", "name": "'), name, F.lit('", "input": '), "props", F.lit('}, {"type": "text"}, {"type": "tool_use", "name": "m"}]')),
        F.concat(F.lit('x <tool_use>{"name": "'), name, F.lit('", "arguments": '), "props", F.lit('}</tool_use> y <tool_call>\n{"name": "m", "input": {"x": [1]}}</tool_call> <tool_use>{bad, not any JSON}</tool_use>')),
        F.concat(F.lit("<function = f>"), "props", F.lit("</function><FUNCTION="), name, F.lit("> </FUNCTION >")),
        F.lit("<function=f>[1, 2]</function>"), F.lit('nothing [{"type": "text"}]'),
        F.concat(F.lit('<tool_call>{"name": "t", "args": '), "props", F.lit('}</tool_call><function=f>{"args": '), "props", F.lit("}</function>")),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    # JSON without white space, as the reader of a column may keep or drop it
    shown = F.transform(lookups.tool_calls(text), lambda x: F.concat(x["name"], F.when(F.startswith(x["args"], F.lit('{"msg"')), x["args"]).otherwise(F.to_json(F.try_parse_json(x["args"])))))
    return table(spark, d, "events").select("event_id", F.array_join(shown, "|").alias("calls"))


_SCOPES = """CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '[1]' WHEN 2 THEN '{"mode": "everything"}' WHEN 3 THEN '{"mode": " KB ", "kb_id": "' || source || '"}'
  WHEN 4 THEN '{"mode": "document", "kb_id": "' || source || '", "data_id": "' || source || '::d' || doc_id || '", "origin": "chat"}' WHEN 5 THEN '{"mode": "document", "kb_id": "a", "data_id": "b::d"}'
  WHEN 6 THEN '{"mode": "selection", "targets": [{"kb_id": "' || source || '", "documents": [{"data_id": "b::d"}]}, {"kb_id": "' || source || '", "all_documents": true}, {"kb_id": "x", "documents": [{"data_id": "x::1"}, {"data_id": "x::1"}]}]}'
  ELSE '{"mode": "selection", "targets": [{"kb_id": "' || source || '"}]}' END"""


@query("f9_scopes", """SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN 'all' WHEN 3 THEN 'kb' WHEN 4 THEN 'document' WHEN 6 THEN 'selection' ELSE 'none' END AS mode,
  CASE WHEN doc_id % 8 IN (3, 5) THEN 'knowledge' ELSE 'chat' END AS origin, CASE WHEN doc_id % 8 IN (3, 4) THEN source END AS kb_id, CASE WHEN doc_id % 8 = 4 THEN source || '::d' || doc_id END AS data_id,
  CASE WHEN doc_id % 8 = 6 THEN source || ':0,x:1' END AS targets FROM documents""")
def f9(spark, d):
    normal = scopes.normalize(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_SCOPES).alias("scope")))
    shown = F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["kb_id"], F.size(t["documents"]).cast("string"))), ",")
    return normal.select("id", "mode", "origin", "kb_id", "data_id", shown.alias("targets"))


@query("f9_allowed", """SELECT d.doc_id AS id, r.doc_id AS request, CASE d.doc_id % 8 WHEN 0 THEN true WHEN 3 THEN d.source = r.source WHEN 4 THEN d.doc_id = r.doc_id WHEN 6 THEN d.source = r.source ELSE false END AS allowed
FROM documents d JOIN documents r ON r.doc_id // 8 = d.doc_id // 8""")
def f9_check(spark, d):
    docs = table(spark, d, "documents")
    normal = scopes.normalize(docs.select(F.col("doc_id").alias("id"), F.expr(_SCOPES).alias("scope")))
    group = F.expr("doc_id div 8")
    asked = docs.select(F.col("doc_id").alias("id"), group.alias("g")).join(docs.select(F.col("doc_id").alias("request"), F.col("source").alias("kb_id"), group.alias("g")), "g")
    asked = asked.select("id", "request", "kb_id", F.concat("kb_id", F.lit("::d"), F.col("request").cast("string")).alias("data_id"))
    return scopes.allowed(asked, normal).select("id", "request", "allowed")


@query("m14_list_documents", f"WITH {RECORDS} SELECT kb_id, data_id, count(*) AS n_chunks FROM records WHERE kb_id IN ('kb-src1', 'kb-src2') GROUP BY 1, 2")
def m14_documents(spark, d):
    normal = scopes.normalize(spark.createDataFrame([(1, '{"mode": "selection", "targets": [{"kb_id": "kb-src1", "all_documents": true}, {"kb_id": "kb-src2", "all_documents": true}]}')], "id int, scope string"))
    return scopes.list_documents(records(spark, d).select("kb_id", "data_id"), normal, 1)


@query("m14_list_chunks", f"""WITH {RECORDS}, n AS (SELECT * FROM records WHERE data_id = 'd7')
SELECT chunk_index, left(body, 80) AS preview, CASE WHEN content_type <> '' THEN content_type WHEN kind = 'image' THEN CASE WHEN trim(table_markdown) <> '' THEN 'table' ELSE 'image' END WHEN regexp_matches(body, '(?i)<table\\b') OR regexp_matches(body, '(?m)^\\s*\\|?.+\\|.+$') THEN 'table' ELSE 'prose' END AS evidence_type,
  CASE WHEN (SELECT max(chunk_index) FROM n) >= 5 THEN 5 END AS next_offset FROM n WHERE chunk_index BETWEEN 1 AND 4""")
def m14_chunks(spark, d):
    normal = scopes.normalize(spark.createDataFrame([(1, '{"mode": "all"}')], "id int, scope string"))
    return scopes.list_chunks(records(spark, d), normal, 1, "d7", 1, 4)


@query("u5_cache_misses", "SELECT DISTINCT sha256('embed' || chr(0) || text) AS cache_key, text FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)")
def u5(spark, d):
    keyed = caching.keyed(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "embed")
    return caching.misses(keyed, keyed.where("doc_id % 3 = 0"))


@query("u5_cached_lengths", "SELECT doc_id, length(text) AS value, bool_or(doc_id % 3 = 0) OVER (PARTITION BY text) AS hit FROM documents WHERE text IS NOT NULL")
def u5_all(spark, d):
    """The lengths of texts stand for a model's answers; a third of the documents is known."""
    keyed = caching.keyed(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "embed")
    cache = keyed.where("doc_id % 3 = 0").select("cache_key", F.length("text").cast("long").alias("value"))
    return caching.answered(keyed, cache, lambda texts: [len(t) for t in texts], "long", 256).select("doc_id", "value", "hit")


@query("t3_reconcile", "SELECT event_id AS call, CASE WHEN event_id % 2 = 0 AND event_id % 120 > 60 THEN ts + INTERVAL 1 SECOND * (event_id % 120) ELSE ts END AS ts, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE 100 END AS tokens, CASE WHEN event_id % 2 = 0 AND event_id % 120 > 60 THEN 0 ELSE 1 END AS requests FROM events")
def t3(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("call"), "ts")
    ended = e.where("call % 2 = 0").select("call", (F.col("ts") + F.make_dt_interval(secs=(F.col("call") % 120).cast("decimal(18,6)"))).alias("ended"), (F.col("call") % 7).alias("used"))
    return lookups.reconcile(e.withColumn("tokens", F.lit(100).cast("long")), ended)


@query("t8_budget_gate", "SELECT user_id, count(*) < 70 AND epoch_us(TIMESTAMP '2024-01-20 12:30:00') // 1000000 - epoch_us(min(ts)) // 1000000 < 1700000 AS go_on FROM events GROUP BY 1")
def t8(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("turns"), F.min("ts").alias("started"))
    return control.within_budget(s.withColumns({"max_turns": F.lit(70), "max_seconds": F.lit(1_700_000)}), datetime(2024, 1, 20, 12, 30)).select("user_id", "go_on")


@query("s17_expand_references", f"WITH {RECORDS} SELECT d.doc_id, 0 AS ref_no, string_agg(r.body, chr(10) ORDER BY r.chunk_index) AS body FROM documents d JOIN records r ON r.doc_id = d.doc_id // 2 AND r.chunk_index BETWEEN 1 AND 3 GROUP BY 1")
def s17(spark, d):
    t = F.concat(F.lit("see {{file:f"), F.expr("doc_id div 2").cast("string"), F.lit(":1:3}} and {{file:none:1:2}}"))
    lines = records(spark, d).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("chunk_index").alias("line_no"), F.col("body").alias("line"))
    return lookups.expand_references(table(spark, d, "documents").select("doc_id", t.alias("text")), lines)


@query("s7_index_rows", f"WITH {RECORDS} SELECT kb_id, count(*) AS rows, count(DISTINCT data_id) AS documents FROM records WHERE body <> '' GROUP BY 1")
def s7(spark, d):
    return records(spark, d).where("body <> '' and data_id <> ''").groupBy("kb_id").agg(F.count("*").alias("rows"), F.countDistinct("data_id").alias("documents"))


@query("m1_checkpoint_matches", "SELECT source, bool_and(doc_id % 11 <> 0 AND NOT (doc_id % 13 = 0 AND text <> '')) AS matches FROM documents GROUP BY 1")
def m1(spark, d):
    """Some files are missing from the checkpoint, some have other contents."""
    files_ = table(spark, d, "documents").select("source", "doc_id", F.md5("text").alias("hash"), "text")
    old = F.when((F.col("doc_id") % 13 == 0) & (F.col("text") != ""), F.lit("old")).otherwise(F.col("hash"))
    return maintenance.checkpoint_matches(files_.drop("text"), files_.where("doc_id % 11 <> 0").select("source", "doc_id", old.alias("hash")), "source")


@query("m3_delete_document", "SELECT doc_id AS doc, CASE WHEN lang = 'de' THEN 'removed' ELSE 'kept' END AS state FROM documents")
def m3(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang")
    left = maintenance.delete(docs.select("doc"), docs.where("lang = 'de'"), "doc").withColumn("state", F.lit("kept"))
    return docs.join(left, "doc", "left").select("doc", F.coalesce("state", F.lit("removed")).alias("state"))


@query("m9_source_inputs", "SELECT md5(text) AS real_path, min(source || '/' || doc_id) AS path, count(*) AS n FROM documents GROUP BY 1")
def m9(spark, d):
    """The digest of its text stands for a file's real path."""
    return maintenance.distinct_sources(table(spark, d, "documents").select(F.md5("text").alias("real_path"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")))


@query("k13_k14_table_context", """WITH t AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '#`~$|>-*+[!', '...........'), '(?m)^(\\s*\\d+)[.)]', '\\1:', 'g') AS own FROM documents)
SELECT doc_id, '表 ' || doc_id % 9 || '-2 Sales' AS title, '表格：表 ' || doc_id % 9 || '-2 Sales' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '单位：kg' ELSE '' END AS lead, 'about ' || doc_id AS before, nullif(left(regexp_replace(own, '\\A\\s+|\\s+\\z', '', 'g'), 384), '') AS after FROM t""")
def k14(spark, d):
    """Names, units and texts around tables; marks of the documents' own are defused, so that SQL knows the blocks."""
    i = F.col("doc_id")
    own = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "#`~$|>-*+[!", "..........."), r"(?m)^(\s*\d+)[.)]", "$1:")
    unit = F.when(i % 2 == 0, "\n单位：kg\n").otherwise("")
    t = F.concat(F.lit("about "), i.cast("string"), F.lit("\n\n表 "), (i % 9).cast("string"), F.lit("-2 Sales"), unit, F.lit("\n| a |\n| --- |\n| 1 |\n\n"), own)
    rows = chunking.bound(chunking.blocks(chunking.sections(chunking.classified(chunking.lines(table(spark, d, "documents").select("doc_id", t.alias("text")))))))
    return chunking.table_context(rows).drop("block")


# Links and files named after documents' texts: every third link is two links in one, the second with an old folder in
# front; every third is one link; every third ends in a file that isn't there.
_FILE = "'img/' || left(md5(coalesce(text, '')), 10) || '-' || doc_id || '.png'"


@query("g15_split_links", f"""WITH f AS (SELECT doc_id, {_FILE} AS path FROM documents)
SELECT a.doc_id AS link_id, CASE WHEN a.doc_id % 3 = 0 AND b.path IS NOT NULL THEN '../' || a.path || '|../' || b.path END AS parts FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id + 1""")
def g15(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("img/"), F.left(F.md5(F.coalesce("text", F.lit(""))), F.lit(10)), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".png"))
    files = docs.select("doc_id", path.alias("path"))
    following = files.select((F.col("doc_id") - 1).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"))
    k = F.col("doc_id") % 3
    first, second = F.concat(F.lit("../"), "path"), F.coalesce("name", F.lit("gone.png"))
    value = F.when(k == 0, F.concat(first, F.lit("old.assets/"), second)).when(k == 1, first).otherwise(F.concat(first, second, F.lit("/none.png")))
    links = files.join(following, "doc_id", "left").select(F.col("doc_id").alias("link_id"), F.lit("docs").alias("folder"), value.alias("value"))
    return paths.split_links(links, files).select("link_id", F.array_join("parts", "|").alias("parts"))


def _package(spark, d):
    """Documents as entries of a manifest, some of whose sources lead out of their root or have no file; and the files."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    source = F.when(k == 0, F.concat(F.lit("a/../in/"), i, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("../in/"), i, F.lit(".pdf"))).when(k == 2, F.concat(F.lit("/in/"), i, F.lit(".pdf"))).when(k == 3, F.lit("")).when(k == 4, F.concat(F.lit("in/"), i, F.lit(".gone"))).otherwise(F.concat(F.lit("in\\"), i, F.lit(".pdf")))
    docs = table(spark, d, "documents")
    md = F.concat(F.lit("processed/"), i, F.when(k == 5, ".txt").otherwise(".md"))
    manifest = docs.select(F.lit("kb").alias("kb_id"), F.col("doc_id").alias("pos"), source.alias("source"), "lang", F.coalesce("source", F.lit("")).alias("name"), F.when(k == 4, "asset").otherwise("document").alias("kind"), F.array(md).alias("processed"))
    manifest = manifest.drop("lang")
    originals = docs.select(F.lit("kb").alias("kb_id"), F.concat(F.lit("in/"), i, F.lit(".pdf")).alias("path"))
    return docs.select(F.col("doc_id").alias("request"), F.lit("kb").alias("kb_id"), "lang", md.alias("registered"), F.regexp_replace(md, "^processed/", "").alias("bare")), manifest, originals


@query("r17_sources", """SELECT doc_id AS request, CASE WHEN doc_id % 6 IN (0, 5) THEN 'ok' WHEN doc_id % 6 = 3 THEN 'source_document_not_registered' ELSE 'source_document_not_found' END AS status,
CASE WHEN doc_id % 6 IN (0, 5) THEN 'in/' || doc_id || '.pdf' END AS path, CASE WHEN doc_id % 6 IN (0, 5) THEN coalesce(nullif(source, ''), doc_id || '.pdf') END AS title FROM documents""")
def r17_sources(spark, d):
    asked, manifest, originals = _package(spark, d)
    return paths.sources(asked.withColumnRenamed("registered", "processed"), manifest, originals).drop("kb_id")


@query("r17_processed", """SELECT doc_id AS request, CASE WHEN lang = 'en' THEN 'processed_document_not_found' WHEN doc_id % 6 = 5 THEN 'processed_document_not_markdown' WHEN doc_id % 6 = 4 THEN 'processed_document_not_registered' ELSE 'ok' END AS status,
CASE WHEN coalesce(lang <> 'en', true) AND doc_id % 6 < 4 THEN doc_id || '.md' END AS path FROM documents""")
def r17_processed(spark, d):
    """Documents in English have no file of their own."""
    asked, manifest, _ = _package(spark, d)
    made = asked.where("lang is distinct from 'en'").select("kb_id", F.col("bare").alias("path"))
    return paths.processed(asked.withColumnRenamed("bare", "processed"), manifest, made)


@query("r17_assets", "SELECT doc_id AS request, CASE WHEN doc_id % 6 IN (0, 5) AND (lang = 'en' OR lang = 'de') THEN 'pics/' || doc_id || ' x.png' END AS path FROM documents")
def r17_assets(spark, d):
    """Images beside the originals' folder; those of French documents lie outside the root, others have a scheme or no image's ending."""
    asked, manifest, originals = _package(spark, d)
    i = F.col("request").cast("string")
    image = F.concat(F.when(F.col("lang").isin("en", "de"), "../pics/").when(F.col("lang") == "fr", "../../pics/").when(F.col("lang") == "es", "http://h/").otherwise("../pdf/"), i, F.when(F.col("lang") == "de", "%20x.png").otherwise(" x.png?size=2"))
    pictures = originals.select("kb_id", F.concat(F.lit("pics/"), F.regexp_extract("path", r"in/(\d+)", 1), F.lit(" x.png")).alias("path"))
    return paths.assets(asked.select("request", "kb_id", F.col("registered").alias("processed"), image.alias("image")), manifest, originals.unionByName(pictures))


@query("s7_index_sink", f"WITH {RECORDS} SELECT data_id || '#' || chunk_index AS id, length(body) AS value FROM records WHERE body <> ''")
def s7_sink(spark, d):
    """Half of the records, half of them again under the same batch, then all; what is read back is each record once."""
    index = imports.Index(spark, f"{shared(spark)}/index-{uuid.uuid4().hex}")
    rows = records(spark, d).select(F.concat("data_id", F.lit("#"), F.col("chunk_index").cast("string")).alias("id"), F.col("body").alias("text"))
    half = rows.where(F.xxhash64("id") % 2 == 0)
    for batch, part in (("half", half), ("half", half), ("all", rows)):
        index.upsert(part, batch, lambda texts: [len(t) for t in texts], "long")
    return index.read().select("id", "value")


@query("m1_resumed_import", "SELECT doc_id AS key, length(coalesce(text, '')) AS n_chars FROM documents")
def m1_resumed(spark, d):
    """An import that is broken off at its third part; a rerun does the rest and publishes all."""
    root, done = f"{shared(spark)}/import-{uuid.uuid4().hex}", []
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"), F.coalesce("text", F.lit("")).alias("text"))

    def convert(part):
        done.append(1)
        if len(done) == 3:
            raise InterruptedError("broken off")
        return part.select("key", F.length("text").alias("n_chars"))

    for _ in range(2):
        with contextlib.suppress(InterruptedError):
            imports.Import(spark, root, "lengths", parts=4).run(docs, convert)
    return imports.Import(spark, root, "lengths", parts=4).published.read()
