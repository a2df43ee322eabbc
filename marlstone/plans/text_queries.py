"""Queries of the scalar operators, each over a whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import caching
from marlstone.plans.inputs import RECORDS, REF_KEY, records, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_STRIP = r"regexp_replace({}, '\A\s+|\s+\z', '', 'g')"


@query("f2_content_type", f"""WITH {RECORDS}
SELECT data_id, chunk_index, CASE WHEN content_type <> '' THEN content_type WHEN kind = 'image' THEN CASE WHEN trim(table_markdown) <> '' THEN 'table' ELSE 'image' END
  WHEN regexp_matches(body, '(?i)<table\\b') OR regexp_matches(body, '(?m)^\\s*\\|?.+\\|.+$') THEN 'table' ELSE 'prose' END AS effective FROM records""")
def f2(spark, d):
    return records(spark, d).select("data_id", "chunk_index", T.content_type(F.col("content_type"), F.col("kind"), F.col("table_markdown"), F.col("body")).alias("effective"))


_TEXT = "('prose', 'equation', 'code', 'list', 'quote', 'note', 'figure')"


@query("f3_evidence_rows", f"""WITH {RECORDS}
SELECT data_id, chunk_index FROM records WHERE CASE WHEN kind = 'image' THEN content_type = 'table' AND trim(table_markdown) <> '' ELSE content_type = 'table' OR content_type IN {_TEXT} END""")
def f3(spark, d):
    return records(spark, d).where(T.matches_evidence(["text", "table"], F.col("kind"), F.col("content_type"), F.col("table_markdown"))).select("data_id", "chunk_index")


@query("f4_evidence_filter", f"""WITH {RECORDS}
SELECT data_id, chunk_index, content_type FROM records WHERE (content_type = 'table' AND (kind = 'text' OR (kind = 'image' AND table_markdown <> ''))) OR kind = 'image'""")
def f4(spark, d):
    return records(spark, d).where(T.evidence_filter(["table", "image"])).select("data_id", "chunk_index", "content_type")


@query("f5_document_names", f"""WITH {RECORDS}
SELECT DISTINCT data_id, file_name FROM records WHERE file_name IN ('doc7', 'doc7.md', 'doc7.markdown', 'src0/doc10.md', 'doc25.md')
  OR list_extract(string_split(file_name, '/'), -1) IN ('doc7', 'doc7.md', 'doc7.markdown', 'doc25.md') OR ends_with(file_name, '/doc7.md') OR ends_with(file_name, '/src0/doc10.md') OR ends_with(file_name, '/doc25.md')""")
def f5(spark, d):
    return records(spark, d).where(T.names_document(F.col("file_name"), F.lit(""), ["doc7", "src0/doc10.md", " doc25.md "])).select("data_id", "file_name").distinct()


@query("f7_image_rows", f"WITH {RECORDS} SELECT data_id, chunk_index, label FROM records WHERE kind = 'image' AND label IN ('图 1－2', '图 3－5') AND data_id <> 'd1' ORDER BY data_id, chunk_index LIMIT 100")
def f7(spark, d):
    r = records(spark, d)
    return r.where((F.col("kind") == "image") & F.col("label").isin("图 1－2", "图 3－5") & (F.col("data_id") != "d1")).select("data_id", "chunk_index", "label").orderBy("data_id", "chunk_index").limit(100)


@query("f1_normalize_record", f"""WITH {RECORDS}
SELECT data_id, chunk_index, coalesce(nullif(content_type, ''), CASE WHEN kind = 'image' THEN CASE WHEN table_markdown <> '' THEN 'table' ELSE 'figure' END ELSE 'prose' END) AS content_type, coalesce(nullif(caption, ''), body) AS search_text,
  CAST(-1 AS BIGINT) AS source_chunk_index, CAST(1 AS BIGINT) AS structure_part_count, '' AS uncertain FROM records""")
def f1(spark, d):
    from marlstone.schema import normalize

    r = records(spark, d).withColumn("search_text", F.col("caption")).drop("caption", "label", "doc_id")
    return normalize(r).select("data_id", "chunk_index", "content_type", "search_text", "source_chunk_index", "structure_part_count", "uncertain")


@query("f11_clean_hit", f"""WITH {RECORDS}, s AS (SELECT *, regexp_replace(body, '\\A\\s+|\\s+\\z', '', 'g') AS b FROM records WHERE kind = 'text')
SELECT data_id, chunk_index, CASE WHEN b <> '' AND length(b) <= 200 THEN b END AS body, b = '' OR length(b) > 200 AS requires_read FROM s""")
def f11(spark, d):
    from marlstone.operators.retrieval import public_hit

    return public_hit(records(spark, d).where("kind = 'text'"), 200)


@query("f12_source_names", f"WITH {RECORDS} SELECT DISTINCT data_id, list_extract(string_split(file_name, '/'), -1) AS source_file_name, source_section FROM (SELECT *, CASE WHEN file_name LIKE '%/%' THEN list_extract(string_split(file_name, '/'), -1) ELSE '' END AS source_section FROM records)")
def f12(spark, d):
    return records(spark, d).select("data_id", T.source_name(F.concat(F.lit("0123456789abcdef-"), "file_name")).alias("a"), T.source_name(F.col("file_name")).alias("source_file_name"), T.section_name(F.col("file_name")).alias("source_section")).drop("a").distinct()


# What public_text does to a text, in SQL.
_PUBLIC = _STRIP.format("""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?m)^\\s*章节路径：/[^\\r\\n]*\\r?\\n+', '', 'g'), '!\\[\\s*\\]\\([^\\r\\n)]*(?:\\)|$)', '[图片]', 'g'),
  '!\\[\\s*([^\\]]*?)\\s*\\]\\([^\\r\\n)]*(?:\\)|$)', '[图片：\\1]', 'g'), '(?i)\\S*?\\.assets-[^\\s()]*[\\\\/][^\\s()]+\\.(?:png|jpe?g|jp2|webp|gif|bmp|tiff?)(?:\\?[^\\s)]*)?\\)?', '[图片]', 'g')""")


@query("f13_redact", f"""WITH p AS (SELECT doc_id, {_PUBLIC.format("'/var/data/x.md in kb-src1 ' || coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(t, '(?:[A-Za-z]:[\\\\/]|/)[^\\s,;]+', '[内部路径]', 'g'), '(?i)\\bkb-[a-z0-9_-]+\\b', '[内部知识库]', 'g') AS redacted FROM p""")
def f13(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact(F.concat(F.lit("/var/data/x.md in kb-src1 "), F.coalesce("text", F.lit("")))).alias("redacted"))


@query("f14_url_substring", "SELECT page_id, url FROM pages WHERE contains(url, 'example.com/en')")
def f14(spark, d):
    return table(spark, d, "pages").where(F.contains("url", F.lit("example.com/en"))).select("page_id", "url")


@query("f15_mask_data_urls", "SELECT page_id, '{\"u\":\"[image data omitted]\",\"v\":\"' || url || '\"}' AS masked FROM pages")
def f15(spark, d):
    return table(spark, d, "pages").select("page_id", T.mask_data(F.concat(F.lit('{"u":"data:image/png;base64,'), F.base64(F.encode("url", "utf-8")), F.lit('","v":"'), "url", F.lit('"}'))).alias("masked"))


@query("r9_searchable_text", f"""WITH {RECORDS} SELECT data_id, chunk_index, CASE WHEN kind = 'image' THEN concat_ws(chr(10), nullif(trim(caption, ' '), ''), CASE WHEN trim(body, ' ') <> trim(caption, ' ') THEN nullif(trim(body, ' '), '') END, nullif(table_markdown, '')) ELSE body END AS searchable FROM records""")
def r9(spark, d):
    return records(spark, d).select("data_id", "chunk_index", T.searchable(F.col("kind"), F.col("body"), F.trim("caption"), F.col("body"), F.col("table_markdown")).alias("searchable"))


@query("r10_owner", f"WITH {RECORDS} SELECT data_id || '::image::' || chunk_index AS id, data_id AS document FROM records WHERE kind = 'image'")
def r10(spark, d):
    i = F.concat("data_id", F.lit("::image::"), F.col("chunk_index").cast("string"))
    return records(spark, d).where("kind = 'image'").select(i.alias("id"), T.owner(F.when(F.col("doc_id") % 2 == 0, F.col("data_id")).otherwise(""), i).alias("document"))


@query("r16_snippet", """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents), p AS (SELECT *, least(nullif(strpos(lower(flat), 'the'), 0), nullif(strpos(lower(flat), 'der'), 0)) - 1 AS p0 FROM f),
w AS (SELECT *, greatest(0, p0 - 73) AS s FROM p), e AS (SELECT *, least(length(flat), s + 220) AS e FROM w)
SELECT doc_id, CASE WHEN p0 IS NOT NULL THEN CASE WHEN s > 0 THEN '… ' ELSE '' END || substr(flat, s + 1, e - s) || CASE WHEN e < length(flat) THEN ' …' ELSE '' END WHEN length(flat) > 220 THEN left(flat, 220) || ' …' ELSE flat END AS snippet FROM e""")
def r16(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), ["the", "Der", "x"]).alias("snippet"))


@query("g4_ref_key", f"WITH {RECORDS} SELECT data_id, chunk_index, {REF_KEY.format("'见 ' || label || '。'")} AS ref_key FROM records")
def g4(spark, d):
    return records(spark, d).select("data_id", "chunk_index", T.ref_key(F.concat(F.lit("见 "), "label", F.lit("。"))).alias("ref_key"))


@query("g5_ref_candidates", f"WITH {RECORDS} SELECT data_id, chunk_index, '图 ' || (doc_id % 9) || ' 表2-1' AS found FROM records")
def g5(spark, d):
    t = F.concat(F.lit("见图　"), F.translate((F.col("doc_id") % 9).cast("string"), "0123456789", "０１２３４５６７８９"), F.lit("，表2-1；表2-1 "))
    return records(spark, d).select("data_id", "chunk_index", F.array_join(T.ref_candidates(t), " ").alias("found"))


@query("g13_asset_body", f"WITH {RECORDS} SELECT data_id, chunk_index, concat_ws(chr(10), '图题: ' || nullif(caption, ''), '图表编号: ' || label, '表格: ' || nullif(table_markdown, '')) AS asset_body FROM records WHERE kind = 'image'")
def g13(spark, d):
    return records(spark, d).where("kind = 'image'").select("data_id", "chunk_index", T.asset_body({"title": F.col("caption"), "ref_key": F.col("label"), "table_markdown": F.col("table_markdown")}).alias("asset_body"))


@query("k17_clean_transport", f"""WITH s AS (SELECT doc_id, {_STRIP.format("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END || 'end x' AS cleaned FROM s""")
def k17(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_transport(F.concat(F.lit(" \r\n"), T.text(F.col("text")), F.lit("\r\nend\0x\r"))).alias("cleaned"))


@query("x1_middle_ellipsis", "SELECT doc_id, CASE WHEN length(text) < 110 THEN text ELSE left(text, 50) || ' ... ' || right(text, 50) END AS short FROM documents")
def x1(spark, d):
    return table(spark, d, "documents").select("doc_id", T.middle_ellipsis(F.col("text")).alias("short"))


@query("x2_clip_rows", """WITH s AS (SELECT doc_id, regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') AS t FROM documents), c AS (SELECT *, 301 - strpos(reverse(left(t, 301)), chr(10)) AS p0, strpos(left(t, 301), chr(10)) AS has FROM s)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(left(t, CASE WHEN has > 0 AND p0 >= 150 THEN p0 ELSE 300 END), '\\s+\\z', '') || chr(10) || '…[结构化内容已截断]' END AS clipped FROM c""")
def x2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip_rows(F.col("text"), 300).alias("clipped"))


@query("x3_public_text", f"""SELECT doc_id, {_PUBLIC.format("'章节路径：/a/b' || chr(10) || chr(10) || '![ cat ](x/y.png) ' || coalesce(text, '') || ' p.assets-1/i.png'")} AS public_text FROM documents""")
def x3(spark, d):
    t = F.concat(F.lit("章节路径：/a/b\n\n![ cat ](x/y.png) "), F.coalesce("text", F.lit("")), F.lit(" p.assets-1/i.png"))
    return table(spark, d, "documents").select("doc_id", T.public_text(t).alias("public_text"))


@query("x4_folded_ascii", "SELECT doc_id, lower(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) AS folded FROM documents")
def x4(spark, d):
    """The ASCII characters of every text, for which SQL has the folding."""
    from marlstone.functions.unicode import fold

    return table(spark, d, "documents").select("doc_id", fold(F.regexp_replace("text", "[^\\x00-\\x7f]", "")).alias("folded"))


@query("x4_folded")
def x4_all(spark, d):
    """All documents; DuckDB has no NFKC and no case folding, so there is no SQL."""
    from marlstone.functions.unicode import fold

    return table(spark, d, "documents").select("doc_id", fold("text").alias("folded"))


@query("x6_last_segment", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS last FROM pages")
def x6(spark, d):
    return table(spark, d, "pages").select("page_id", T.source_name(F.concat(F.lit("/"), "url")).alias("last"))


@query("x7_safe_component", "SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(url, '[\\\\/:*?\"<>|]+', '_', 'g'), '\\A[ ._]+|[ ._]+\\z', '', 'g'), '\\s+', ' ', 'g'), 48), ''), 'document') AS component FROM pages")
def x7(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_component(F.col("url")).alias("component"))


@query("x8_token_estimates", """WITH n AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '[㐀-鿿豈-﫿]', '', 'g')) AS cjk FROM documents)
SELECT doc_id, greatest(1, n // 2) AS rough, greatest(1, CAST(floor((cjk + (n - cjk) / CAST(4.0 AS DOUBLE) + 8) * CAST(1.15 AS DOUBLE) + CAST(0.999 AS DOUBLE)) AS BIGINT)) AS limiter FROM n""")
def x8(spark, d):
    return table(spark, d, "documents").select("doc_id", T.rough_tokens(F.col("text")).cast("long").alias("rough"), T.limiter_tokens(F.col("text")).alias("limiter"))


@query("x10_cache_key", "SELECT doc_id, sha256('search-v2' || chr(0) || coalesce(text, '')) AS cache_key, sha1(doc_id || '#' || 0) AS row_id FROM documents")
def x10(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return caching.keyed(texts, "search-v2").select("doc_id", "cache_key", F.sha1(F.concat_ws("#", F.col("doc_id").cast("string"), F.lit("0"))).alias("row_id"))


@query("x12_split_objects", "SELECT event_id, '{\"k\": 1}|' || props AS objects FROM events")
def x12(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(T.split_objects(F.concat(F.lit('{"k": 1}'), "props")), "|").alias("objects"))


@query("x14_visible", f"""SELECT doc_id, {_STRIP.format("replace(coalesce(text, ''), '<', '(')")} AS visible FROM documents""")
def x14(spark, d):
    """Texts whose own tags are defused, so that SQL knows what is left; x14_visible_whole has them as they are."""
    t = F.concat(F.lit("<thinking a>x\ny</thinking><tool_use>{}</tool_use>"), F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit("(")), F.lit(" <function = run.it> rest"))
    return table(spark, d, "documents").select("doc_id", T.visible(t).alias("visible"))


@query("x14_visible_whole")
def x14_all(spark, d):
    t = F.concat(F.lit("<thinking a>x\ny</thinking><tool_use>{}</tool_use>"), F.coalesce("text", F.lit("")), F.lit(" <function = run.it> rest"))
    return table(spark, d, "documents").select("doc_id", T.visible(t).alias("visible"))


@query("x15_last_code_block", f"""WITH t AS (SELECT doc_id, '```py' || chr(10) || 'first' || chr(10) || '```' || chr(10) || '```bash' || chr(10) || 'ls' || chr(10) || '```' || chr(10) || '```python' || chr(10) || coalesce(text, '') || chr(10) || '```' AS t FROM documents)
SELECT doc_id, {_STRIP.format("list_extract(regexp_extract_all(t, '(?s)```(?:python|py)\\n(.*?)\\n```', 1), -1)")} AS code FROM t""")
def x15(spark, d):
    t = F.concat(F.lit("```py\nfirst\n```\n```bash\nls\n```\n```python\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))
    return table(spark, d, "documents").select("doc_id", T.last_code_block(t, "python").alias("code"))


@query("x16_stamp", "SELECT event_id, strftime(ts, '%m%d_%H%M') AS stamp FROM events")
def x16(spark, d):
    return table(spark, d, "events").select("event_id", T.stamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("stamp"))


@query("x17_retry", "SELECT event_id, event_id % 600 IN (408, 409, 425, 429) OR event_id % 600 >= 500 AS retryable, greatest(least(30.0::DOUBLE, pow(2.0, greatest(0, event_id % 9 - 1))), value) AS base FROM events")
def x17(spark, d):
    return table(spark, d, "events").select("event_id", T.retryable(F.col("event_id") % 600).alias("retryable"), T.retry_base((F.col("event_id") % 9), F.col("value")).alias("base"))


@query("x18_abbreviate", "SELECT event_id, CASE WHEN n >= 1000000 THEN printf('%.2f', n / 1e6) || 'M' WHEN n >= 1000 THEN printf('%.1f', n / 1e3) || 'k' ELSE CAST(n AS VARCHAR) END AS short FROM (SELECT event_id, event_id * 128 AS n FROM events)")
def x18(spark, d):
    return table(spark, d, "events").select("event_id", T.abbreviate(F.col("event_id") * 128).alias("short"))


@query("x19_path_identity", "SELECT page_id, replace(url, '\\', '/') AS path FROM pages")
def x19(spark, d):
    return table(spark, d, "pages").select("page_id", T.normal_path(F.concat(F.lit(" //"), F.replace("url", F.lit("/"), F.lit("\\")))).alias("path"))


@query("x21_compact_lines", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '(?m)^ +', '', 'g'), '(\\n\\s*){3,}', chr(10) || chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g') AS compact FROM documents")
def x21(spark, d):
    return table(spark, d, "documents").select("doc_id", T.compact_lines(F.concat(F.lit("\n\n\n   "), F.replace("text", F.lit(" "), F.lit("  ")))).alias("compact"))


@query("x27_history_lines", "SELECT conv_id, turn, '[USER] ' || role || '|[Agent] done' AS history FROM conversations")
def x27(spark, d):
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n [USER] "), "role", F.lit("\nnoise\n[Agent] done "))).otherwise(F.concat(F.lit("[USER] "), "role", F.lit("\\nnoise\\n[Agent] done")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.history_lines(raw), "|").alias("history"))


@query("s18_unique_patch", "SELECT doc_id, CASE WHEN (length(text) - length(replace(text, ' in ', ''))) // 4 = 1 THEN replace(text, ' in ', ' <in> ') END AS patched, CAST((length(text) - length(replace(text, ' in ', ''))) // 4 AS INTEGER) AS found FROM documents")
def s18(spark, d):
    return table(spark, d, "documents").select("doc_id", T.patch_unique(F.col("text"), " in ", " <in> ").alias("patched"), T.occurrences(F.col("text"), " in ").alias("found"))
