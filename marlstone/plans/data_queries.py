"""Queries of the table operators, each over whole tables, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import board, control, folds, maintenance, references, retrieval, sessions, splitting, tree, usage
from marlstone.plans.inputs import COUNTERS, CURRENCY_RATE, DEFAULT_PRICE, POSTS, PRICES, PRICES_SQL, RECORDS, counters, posts, records, table
from marlstone.sources import files

QUERIES, SQL = {}, {}
NOW = datetime(2024, 1, 20, 12, 30)
_NOW = "TIMESTAMP '2024-01-20 12:30:00'"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ---- retrieval

QUERY_TERMS = {"the": 1.0, "of": 0.5, "der": 2.0, "la": 0.75}


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _query_vector(spark, d):
    """The vector of row 7 stands for an embedded query: one row of fixed length."""
    return table(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]


_DENSE = """v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id <> 7), q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 7),
dist AS (SELECT doc_id, 1 - list_inner_product(v.e, q.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e))) AS distance FROM v, q)"""
_TERMS = """t AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents WHERE text IS NOT NULL),
sim AS (SELECT doc_id, CAST(sum(CASE term WHEN 'the' THEN 1.0 WHEN 'of' THEN 0.5 WHEN 'der' THEN 2.0 WHEN 'la' THEN 0.75 END) AS DOUBLE) AS similarity FROM t WHERE term IN ('the', 'of', 'der', 'la') GROUP BY 1)"""


@query("r1_dense_top", f"WITH {_DENSE} SELECT doc_id, round(distance, 6) AS distance FROM dist ORDER BY dist.distance, doc_id LIMIT 20")
def r1(spark, d):
    return retrieval.dense_top(_vectors(spark, d).where("doc_id <> 7"), _query_vector(spark, d), 20, ["doc_id"]).select("doc_id", F.round("distance", 6).alias("distance"))


def _terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("term"), F.lit(1.0).alias("weight"))


@query("r2_sparse_top", f"WITH {_TERMS} SELECT doc_id, similarity FROM sim ORDER BY similarity DESC, doc_id LIMIT 20")
def r2(spark, d):
    return retrieval.sparse_top(_terms(spark, d), QUERY_TERMS, 20, ["doc_id"])


@query("r3_first_hits", f"""WITH {RECORDS}, h AS (SELECT *, CASE WHEN content_type NOT IN ('prose') THEN chunk_index - chunk_index % 3 ELSE chunk_index END AS public_chunk, length(body) AS n FROM records),
k AS (SELECT *, row_number() OVER (PARTITION BY data_id, public_chunk ORDER BY n, chunk_index) AS k FROM h) SELECT data_id, public_chunk, chunk_index, n FROM k WHERE k = 1""")
def r3(spark, d):
    r = records(spark, d).select("data_id", "chunk_index", "content_type", F.lit("s").alias("structure_id"), (F.col("chunk_index") % 3).alias("structure_part_index"), F.length("body").alias("n"))
    return retrieval.first_hits(r, "n").select("data_id", "public_chunk", "chunk_index", "n")


@query("r4_exact_references", f"WITH {RECORDS}, i AS (SELECT data_id, chunk_index, '图' || (doc_id % 9) || '-' || chunk_index AS ref_key FROM records WHERE kind = 'image' AND '图' || (doc_id % 9) || '-' || chunk_index IN ('图1-2', '图4-5') ORDER BY data_id, chunk_index LIMIT 120) SELECT data_id, min(chunk_index) AS chunk_index FROM i GROUP BY 1 ORDER BY 1 LIMIT 30")
def r4(spark, d):
    images = records(spark, d).withColumn("ref_key", T.ref_key(F.col("label")))
    return retrieval.exact_references(images, "see 图 1-2 and 图4 - 5", 30).select("data_id", "chunk_index")


_FUSED = """ranked AS (SELECT doc_id, 'dense' AS channel, row_number() OVER (ORDER BY distance, doc_id) AS r FROM (SELECT * FROM dist ORDER BY distance, doc_id LIMIT 20)
UNION ALL SELECT doc_id, 'sparse', row_number() OVER (ORDER BY similarity DESC, doc_id) FROM (SELECT * FROM sim ORDER BY similarity DESC, doc_id LIMIT 20)
UNION ALL SELECT doc_id, 'exact', 1 FROM documents WHERE doc_id IN (3, 11)),
fused AS (SELECT doc_id, round(sum(CASE channel WHEN 'dense' THEN CAST(1.2 AS DOUBLE) WHEN 'sparse' THEN CAST(1.0 AS DOUBLE) ELSE CAST(4.0 AS DOUBLE) END / (60 + r)), 6) AS score, string_agg(channel, '+' ORDER BY channel) AS score_type FROM ranked GROUP BY 1)"""


@query("r5_hybrid_search", f"WITH {_DENSE}, {_TERMS}, {_FUSED} SELECT doc_id, score, score_type, row_number() OVER (ORDER BY score DESC, doc_id) AS final_rank FROM fused ORDER BY score DESC, doc_id LIMIT 5")
def r5(spark, d):
    k, ids = retrieval.pool_size(5), ["doc_id"]
    dense = retrieval.ranked(retrieval.dense_top(_vectors(spark, d).where("doc_id <> 7"), _query_vector(spark, d), k, ids), "dense", "distance", ids=ids)
    sparse = retrieval.ranked(retrieval.sparse_top(_terms(spark, d), QUERY_TERMS, k, ids), "sparse", "similarity", ascending=False, ids=ids)
    exact = retrieval.ranked(table(spark, d, "documents").where("doc_id in (3, 11)"), "exact", ids=ids)
    return retrieval.fuse([dense, sparse, exact], 5, ids)


@query("r6_channel_ranks", f"WITH {_DENSE}, p AS (SELECT * FROM dist ORDER BY distance, doc_id LIMIT 30) SELECT doc_id, 'dense' AS channel, CAST(row_number() OVER (ORDER BY distance, doc_id) AS INTEGER) AS rank FROM p")
def r6(spark, d):
    return retrieval.ranked(retrieval.dense_top(_vectors(spark, d).where("doc_id <> 7"), _query_vector(spark, d), 30, ["doc_id"]), "dense", "distance", ids=["doc_id"])


@query("r7_reference_status", f"WITH {RECORDS}, k AS (SELECT '图' || (doc_id % 9) || '-' || chunk_index AS ref_key, data_id, chunk_index FROM records WHERE kind = 'image'), q AS (SELECT unnest(['图1-2', '图2-5', '图88-1']) AS ref_key), n AS (SELECT ref_key, count(DISTINCT (data_id, chunk_index)) AS n FROM k GROUP BY 1) SELECT ref_key, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM q LEFT JOIN n USING (ref_key)")
def r7(spark, d):
    images = records(spark, d).where("kind = 'image'").withColumn("ref_key", T.ref_key(F.col("label")))
    return retrieval.reference_status(spark.createDataFrame([("图1-2",), ("图2-5",), ("图88-1",)], "ref_key string"), images)


@query("r8_find_terms", "SELECT doc_id AS document, concat_ws('|', CASE WHEN contains(lower(text), 'the ') THEN 'The ' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN contains(lower(text), 'der') THEN 'der' END) AS found, contains(lower(text), 'the ') OR contains(lower(text), 'license') OR contains(lower(text), 'der') AS matched FROM documents")
def r8(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document"), F.col("text").alias("searchable"))
    return retrieval.find_terms(docs, ["The ", " ", "license", "der"], max_documents=None).withColumn("found", F.array_join("found", "|"))


@query("r11_pages", f"""WITH {RECORDS}, s AS (SELECT data_id, chunk_index, sum(length(body) + 2) OVER w - 2 AS s, row_number() OVER w AS k FROM records WINDOW w AS (PARTITION BY data_id ORDER BY chunk_index))
SELECT data_id, CAST(count_if(s <= 1000 OR k = 1) AS BIGINT) AS n_chunks, CAST(max(CASE WHEN s <= 1000 OR k = 1 THEN least(s, 1000) END) AS BIGINT) AS n_chars, min(CASE WHEN NOT (s <= 1000 OR k = 1) THEN chunk_index END) AS next_chunk FROM s GROUP BY 1""")
def r11(spark, d):
    return retrieval.pages(records(spark, d), 1000)


@query("r12_chunk_page", f"WITH {RECORDS} SELECT data_id, chunk_index, left(body, 80) AS preview, (SELECT count(*) > 5 FROM records WHERE data_id = 'd10' AND chunk_index BETWEEN 2 AND 7) AS has_more FROM records WHERE data_id = 'd10' AND chunk_index BETWEEN 2 AND 6")
def r12(spark, d):
    return retrieval.chunk_page(records(spark, d), "d10", 2, 5)


@query("r13_documents", f"""WITH {RECORDS}, f AS (SELECT DISTINCT file_name AS path FROM records), m AS (SELECT 'doc' || doc_id || '.md' AS path, 'src/' || doc_id AS source_path, lang AS title FROM documents WHERE doc_id % 2 = 0)
SELECT f.path, m.source_path, m.title, m.source_path IS NOT NULL AS known FROM f LEFT JOIN m USING (path)""")
def r13(spark, d):
    m = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.array(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("processed"), F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("source"), F.col("lang").alias("title"))
    return maintenance.documents_with_manifest(records(spark, d).select(F.col("file_name").alias("path")).distinct(), m)


def _fuzzy_sql(query: str) -> str:
    """The first place of each letter behind the one before, step by step."""
    steps = ["p0 AS (SELECT DISTINCT url AS path, lower(url) AS p, 0 AS pos, 0 AS score FROM pages WHERE url IS NOT NULL)"]
    for i, c in enumerate(query, 1):
        steps.append(f"q{i} AS (SELECT *, strpos(substr(p, pos + 1), '{c}') AS d FROM p{i - 1})")
        steps.append(f"p{i} AS (SELECT path, p, pos + d AS pos, score + 1 + CASE WHEN d = 1 AND pos > 0 THEN 2 ELSE 0 END + CASE WHEN pos + d = 1 OR contains('/\\_-. ', substr(p, pos + d - 1, 1)) THEN 3 ELSE 0 END AS score FROM q{i} WHERE d > 0)")
    whole = f"CASE WHEN contains(list_extract(string_split(p, '/'), -1), '{query}') THEN 8 WHEN contains(p, '{query}') THEN 4 ELSE 0 END"
    return "WITH " + ", ".join(steps) + f" SELECT path, CAST(score + {whole} AS INTEGER) AS score FROM p{len(query)} ORDER BY 2 DESC, length(path), path LIMIT 10"


@query("r18_fuzzy_rank", _fuzzy_sql("exen1"))
def r18(spark, d):
    return retrieval.fuzzy_rank(table(spark, d, "pages").select(F.col("url").alias("path")).where("path is not null").distinct(), "exen1", 10)


@query("r19_complete_paths", "SELECT DISTINCT path, is_dir FROM (SELECT url AS path, ends_with(url, '/') AS is_dir FROM pages) WHERE starts_with(path, 'http://t') ORDER BY is_dir DESC, path LIMIT 50")
def r19(spark, d):
    return retrieval.complete_paths(table(spark, d, "pages").select(F.col("url").alias("path"), F.endswith("url", F.lit("/")).alias("is_dir")).distinct(), "http://t")


@query("r20_did_you_mean")
def r20(spark, d):
    return retrieval.did_you_mean(table(spark, d, "pages").select(F.col("url").alias("path")), "12345.html")


@query("m15_filter_choices", """WITH p AS (SELECT *, lower('Page' || page_id || chr(10) || coalesce(url, '')) AS t FROM pages) SELECT page_id FROM p WHERE (contains(t, 'page') AND contains(t, '1') AND contains(t, '/en/')) OR (contains(lower(left(html, 1048576)), 'page') AND contains(lower(left(html, 1048576)), '1') AND contains(lower(left(html, 1048576)), '/en/'))""")
def m15(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("Page"), F.col("page_id").cast("string")).alias("label"), F.col("url").alias("value"), F.left("html", F.lit(1 << 20)).alias("head"))
    return retrieval.filter_choices(p, "page 1 /EN/").select("page_id")


@query("r21_search_sessions", "SELECT conv_id FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS log FROM conversations GROUP BY 1) WHERE contains(lower(left(log, 1048576)), 'the') AND contains(lower(left(log, 1048576)), 'ing')")
def r21(spark, d):
    logs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("log"))
    return retrieval.search_sessions(logs.withColumns({"name": F.lit("n"), "preview": F.lit("p")}), "The ing").select("conv_id")


@query("s8_point_lookup", f"WITH {RECORDS} SELECT data_id, chunk_index, body FROM records WHERE data_id = 'd5' AND chunk_index = 1")
def s8(spark, d):
    return records(spark, d).where("data_id = 'd5' and chunk_index = 1").select("data_id", "chunk_index", "body")


@query("s16_line_window", f"WITH {RECORDS}, h AS (SELECT doc_id, min(chunk_index) AS p0 FROM records WHERE contains(lower(body), 'license') GROUP BY 1) SELECT r.doc_id, r.chunk_index, left(r.body, 8000) AS line FROM records r JOIN h USING (doc_id) WHERE chunk_index BETWEEN p0 - 2 AND p0 + 3")
def s16(spark, d):
    lines = records(spark, d).select("doc_id", "chunk_index", "body")
    first = lines.where(F.contains(F.lower("body"), F.lit("license"))).groupBy("doc_id").agg(F.min("chunk_index").alias("at"))
    return lines.join(first, "doc_id").where("chunk_index between at - 2 and at + 3").select("doc_id", "chunk_index", F.left("body", F.lit(8000)).alias("line"))


# ---- board and usage


@query("l1_poll", f"WITH {POSTS} SELECT * FROM posts WHERE id > 100 ORDER BY id LIMIT 50")
def l1(spark, d):
    return board.poll(posts(spark, d), 100)


@query("l2_page", f"WITH {POSTS} SELECT * FROM posts WHERE author = 'user7' ORDER BY id DESC LIMIT 5 OFFSET 2")
def l2(spark, d):
    return board.page(posts(spark, d), "user7", 5, 2)


@query("l3_pinned_first", f"WITH {POSTS} SELECT author AS id, max(created_at) AS updated_at, bool_or(id % 97 = 0) AS pinned FROM posts GROUP BY 1")
def l3(spark, d):
    return board.pinned_first(posts(spark, d).groupBy(F.col("author").alias("id0")).agg(F.max("created_at").alias("updated_at"), F.bool_or(F.col("id") % 97 == 0).alias("pinned")).withColumnRenamed("id0", "id"))


@query("l4_retain_jobs", f"WITH {POSTS}, j AS (SELECT id, created_at AS updated_at, content = 'error' AS ended FROM posts) SELECT id, updated_at, ended FROM j WHERE NOT (ended AND {_NOW} - updated_at > INTERVAL 24 HOUR) ORDER BY updated_at DESC, id DESC LIMIT 100")
def l4(spark, d):
    jobs = posts(spark, d).select("id", F.col("created_at").alias("updated_at"), (F.col("content") == "error").alias("ended"))
    return board.retain(jobs, NOW)


@query("l5_evict_cache", f"""WITH f AS (SELECT event_id AS path, event_type AS cache, ts AS mtime, CAST(value * 100 AS BIGINT) AS size, {_NOW} - ts > INTERVAL 30 DAY AS expired FROM events),
k AS (SELECT *, sum(size) OVER (PARTITION BY cache, expired ORDER BY mtime DESC, path DESC ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT cache, expired, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM k WHERE expired OR s > 2000000 GROUP BY 1, 2""")
def l5(spark, d):
    files = table(spark, d, "events").select(F.col("event_id").alias("path"), F.col("event_type").alias("cache"), F.col("ts").alias("mtime"), F.round(F.col("value") * 100).cast("long").alias("size"))
    return board.evict(files, 2_000_000, NOW).groupBy("cache", "expired").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("l8_new_ids", """WITH e AS (SELECT user_id || '-' || strftime(ts, '%d') AS id, event_type FROM events)
SELECT DISTINCT id FROM e WHERE event_type = 'purchase' AND id NOT IN (SELECT id FROM e WHERE event_type = 'signup')""")
def l8(spark, d):
    """Users' days with a purchase that are new, that is without a signup."""
    e = table(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("id"), "event_type")
    return board.new_ids(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"))


@query("l9_stream_blocks", """SELECT user_id AS stream, CASE WHEN event_id % 2 = 0 THEN 'text' ELSE 'thinking' END AS kind, string_agg(event_type || ' ' || event_id, '' ORDER BY event_id) AS text FROM events GROUP BY 1, 2""")
def l9(spark, d):
    """The events as token streams of their users, a third of them in each wire format."""
    part = F.to_json(F.struct(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("p")))
    part = F.substring(part, F.lit(6), F.length(part) - 6)  # the JSON string
    first = lambda a, b: F.when(F.col("event_id") % 2 == 0, F.lit(a)).otherwise(F.lit(b))
    forms = [
        F.concat(F.lit('{"index": 0, "delta": {"type": "'), first('text_delta", "text": ', 'thinking_delta", "thinking": '), part, F.lit("}}")),
        F.concat(F.lit('{"choices": [{"delta": {"'), first("content", "reasoning_content"), F.lit('": '), part, F.lit("}}]}")),
        F.concat(F.lit('{"type": "response.'), first("output_text.delta", "reasoning_text.delta"), F.lit('", "delta": '), part, F.lit("}")),
    ]
    value = F.concat(F.lit("data: "), F.element_at(F.array(*forms), (F.col("user_id") % 3 + 1).cast("int")))
    lines = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), value.alias("value"))
    return files.token_stream(lines).select("stream", "kind", "text")


@query("l10_ordered_distinct", "SELECT user_id, event_type, min(event_id) AS pos FROM events GROUP BY 1, 2")
def l10(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("pos"))


@query("a1_count_posts", f"WITH {POSTS} SELECT count(*) AS total FROM posts WHERE author = 'user7'")
def a1(spark, d):
    return board.count(posts(spark, d), "user7")


@query("a2_authors", f"WITH {POSTS} SELECT DISTINCT author FROM posts")
def a2(spark, d):
    return board.authors(posts(spark, d))


@query("s11_register", "WITH u AS (SELECT 'user' || user_id AS name FROM events WHERE event_type = 'signup'), n AS (SELECT 'user' || user_id AS name FROM events) SELECT DISTINCT 'known' AS token, name FROM u UNION ALL SELECT DISTINCT left(sha256(name), 16), name FROM n WHERE name NOT IN (SELECT name FROM u)")
def s11(spark, d):
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"))
    return board.register(e.where("event_type = 'signup'").select(F.lit("known").alias("token"), "name").distinct(), e)


_KINDS = ("input", "output", "cache_create", "cache_read")
_DELTAS = COUNTERS + ", d AS (SELECT *, " + ", ".join(f"{k} - coalesce(lag({k}) OVER w, 0) AS d_{k}" for k in _KINDS) + """ FROM counters WINDOW w AS (PARTITION BY thread ORDER BY ts, seq)),
ledger AS (SELECT * FROM (SELECT thread, ts, seq, model, """ + ", ".join(f"CASE WHEN least(d_input, d_output, d_cache_create, d_cache_read) < 0 THEN {k} ELSE d_{k} END AS {k}" for k in _KINDS) + " FROM d) WHERE greatest(input, output, cache_create, cache_read) > 0)"


def _ledger(spark, d):
    return usage.deltas(counters(spark, d))


@query("w1_counter_deltas", f"WITH {_DELTAS} SELECT thread, ts, seq, model, input, output, cache_create, cache_read FROM ledger")
def w1(spark, d):
    return _ledger(spark, d)


@query("a3_usage_totals", f"WITH {COUNTERS} SELECT count(*) AS requests, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_create) AS BIGINT) AS cache_create, CAST(sum(cache_read) AS BIGINT) AS cache_read, round(sum(cache_read) / sum(input + cache_create + cache_read) * 100.0, 6) AS hit_rate FROM counters")
def a3(spark, d):
    return usage.totals(counters(spark, d))


@query("a4_log_lines", """WITH l AS (SELECT CASE event_id % 4 WHEN 0 THEN '[Output] tokens=' || event_id WHEN 1 THEN '[Cache] input=' || event_id || ' creation=3 read=4' WHEN 2 THEN '[Cache] input=100 cached=' || event_id ELSE 'noise [Output] tokens=1' END AS v, event_id FROM events)
SELECT CAST(count_if(event_id % 4 = 0) AS BIGINT) AS requests, CAST(sum(CASE WHEN event_id % 4 = 0 THEN event_id ELSE 0 END) AS BIGINT) AS output, CAST(sum(CASE event_id % 4 WHEN 1 THEN event_id WHEN 2 THEN greatest(0, 100 - event_id) ELSE 0 END) AS BIGINT) AS input, CAST(count_if(event_id % 4 = 1) * 3 AS BIGINT) AS cache_create, CAST(sum(CASE event_id % 4 WHEN 1 THEN 4 WHEN 2 THEN event_id ELSE 0 END) AS BIGINT) AS cache_read FROM l""")
def a4(spark, d):
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 4
    v = F.when(k == 0, F.concat(F.lit("[Output] tokens="), i)).when(k == 1, F.concat(F.lit("[Cache] input="), i, F.lit(" creation=3 read=4"))).when(k == 2, F.concat(F.lit("[Cache] input=100 cached="), i)).otherwise("noise [Output] tokens=1")
    return usage.log_lines(table(spark, d, "events").select(v.alias("value")))


@query("a5_session_ledger", f"WITH {_DELTAS} SELECT thread AS session, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_create) AS BIGINT) AS cache_create, CAST(sum(cache_read) AS BIGINT) AS cache_read, max(ts) AS last_ts, arg_max('t' || seq, (ts, seq)) AS title, count(*) AS rows FROM ledger GROUP BY 1")
def a5(spark, d):
    return usage.by_session(_ledger(spark, d).select(F.col("thread").alias("session"), "ts", "seq", *_KINDS, F.concat(F.lit("t"), F.col("seq").cast("string")).alias("title")))


@query("a6_header_totals", f"WITH {_DELTAS} SELECT CAST(sum(CASE WHEN ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15' THEN input + output + cache_create + cache_read ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN input + output + cache_create + cache_read ELSE 0 END) AS BIGINT) AS today FROM ledger")
def a6(spark, d):
    return usage.header_totals(_ledger(spark, d), datetime(2024, 1, 5), datetime(2024, 1, 15), datetime(2024, 1, 20))


_PRICED = f"""{COUNTERS}, {PRICES_SQL}, m AS (SELECT DISTINCT model, regexp_replace(lower(model), '\\[.*\\]', '') AS m FROM counters),
own AS (SELECT model, coalesce(arg_min(p_in, (k <> m, i)), 3.0) AS p_in, coalesce(arg_min(p_out, (k <> m, i)), 15.0) AS p_out FROM m LEFT JOIN prices ON contains(m, k) GROUP BY 1)"""


@query("j10_prices", f"WITH {_PRICED} SELECT model, CAST(p_in AS DOUBLE) AS p_in, CAST(p_out AS DOUBLE) AS p_out, count(*) AS n FROM counters JOIN own USING (model) GROUP BY ALL")
def j10(spark, d):
    return usage.priced(counters(spark, d), PRICES, DEFAULT_PRICE).groupBy("model", "p_in", "p_out").agg(F.count("*").alias("n"))


@query("a7_cost", f"""WITH {_PRICED} SELECT seq, round((input * p_in + output * p_out + cache_read * p_in * CASE WHEN regexp_matches(lower(model), 'claude|deepseek') THEN CAST(0.1 AS DOUBLE) ELSE 0.5 END + cache_create * p_in * CASE WHEN regexp_matches(lower(model), 'claude|deepseek') THEN CAST(1.25 AS DOUBLE) ELSE 1.0 END) / 1e6 * CAST(7.2 AS DOUBLE), 8) AS cost FROM counters JOIN own USING (model)""")
def a7(spark, d):
    return usage.priced(counters(spark, d), PRICES, DEFAULT_PRICE).select("seq", F.round(usage.cost(F.col("model"), CURRENCY_RATE), 8).alias("cost"))


@query("a8_carried_totals", f"WITH {COUNTERS}, l AS (SELECT *, " + ", ".join(f"lag({k}) OVER w AS l_{k}" for k in _KINDS) + " FROM counters WINDOW w AS (PARTITION BY thread ORDER BY ts, seq)), f AS (SELECT *, coalesce(" + " OR ".join(f"{k} < l_{k}" for k in _KINDS) + ", false) AS fell FROM l) SELECT thread, " + ", ".join(f"CAST(sum(CASE WHEN fell THEN l_{k} ELSE 0 END) + arg_max({k}, (ts, seq)) AS BIGINT) AS {k}" for k in _KINDS) + " FROM f GROUP BY 1")
def a8(spark, d):
    return usage.carried_totals(counters(spark, d))


@query("a9_build_summary", "SELECT user_id AS build, greatest(sum(CASE WHEN event_id % 2 = 0 THEN 1 END), sum(CASE WHEN event_id % 2 = 1 THEN 1 END))::BIGINT AS calls, CAST(sum(event_id % 3) AS BIGINT) AS requests, CASE WHEN bool_and(value > 1) THEN CAST(sum(event_id) AS BIGINT) END AS tokens FROM events GROUP BY 1")
def a9(spark, d):
    parts = table(spark, d, "events").select(F.col("user_id").alias("build"), F.when(F.col("event_id") % 2 == 0, "dense").otherwise("sparse").alias("part"), F.lit(1).cast("long").alias("calls"), (F.col("event_id") % 3).alias("requests"), F.when(F.col("value") > 1, F.col("event_id")).alias("tokens"))
    return usage.build_summary(parts)


@query("a14_access_counts", "SELECT user_id AS file, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS last FROM events GROUP BY 1")
def a14(spark, d):
    return maintenance.access_counts(table(spark, d, "events").select(F.col("user_id").alias("file"), F.date_format("ts", "yyyy-MM-dd").alias("day")))


@query("a16_status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def a16(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("a17_same_multiset", "SELECT user_id, list_sort(list(event_type)) = list_sort(list(CASE WHEN event_id % 97 = 0 THEN 'click' ELSE event_type END)) AS same FROM events GROUP BY 1")
def a17(spark, d):
    e = table(spark, d, "events")
    changed = e.select("user_id", F.when(F.col("event_id") % 97 == 0, "click").otherwise(F.col("event_type")).alias("event_type"))
    return maintenance.same_multiset(e.select("user_id", "event_type"), changed, "user_id")


@query("a18_next_number", "SELECT max(CAST(nullif(regexp_extract(url, '/(\\d+)', 1), '') AS BIGINT)) + 1 AS next FROM pages")
def a18(spark, d):
    return maintenance.next_number(table(spark, d, "pages").select(F.col("url").alias("name")), r"/(\d+)")


# ---- sessions

_ROUNDS = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("w3_turns", "WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM conversations) SELECT conv_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, arg_min(text, turn) AS question, string_agg(text, chr(10) ORDER BY turn) AS body FROM g WHERE grp > 0 GROUP BY 1, 2")
def w3(spark, d):
    return sessions.turns(table(spark, d, "conversations"))


@query("w4_merge_roles", """WITH c AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER w AS run, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS users FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, run, any_value(role) AS role, min(turn) AS turn, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM r WHERE users > 0 GROUP BY 1, 2) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY run) AS INTEGER) AS pos, role, turn, n, text FROM m""")
def w4(spark, d):
    return sessions.merge_roles(table(spark, d, "conversations"))


@query("w5_fold_runs", f"""WITH h AS (SELECT conv_id, turn AS pos, role = 'user' AS u, CASE WHEN role = 'user' THEN '[USER]: ' || {_ROUNDS} ELSE '[Agent] ' || left({_ROUNDS}, 80) END AS line FROM conversations),
i AS (SELECT *, sum(CASE WHEN u OR coalesce(pu, false) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(u) OVER (PARTITION BY conv_id ORDER BY pos) AS pu FROM h)),
f AS (SELECT conv_id, island, min(pos) AS pos, any_value(u) AS u, arg_max(line, pos) AS line, count(*) AS n FROM i GROUP BY 1, 2) SELECT conv_id, pos, CASE WHEN u THEN line ELSE line || '（' || n || ' turns）' END AS line FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) <= 70""")
def w5(spark, d):
    return sessions.fold_runs(sessions.round_history(table(spark, d, "conversations")))


@query("w6_recent_lines", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 AS recent FROM conversations")
def w6(spark, d):
    return sessions.recent(table(spark, d, "conversations").withColumn("pos", F.col("turn")), 3).select("conv_id", "turn", "recent")


@query("w7_trim_history", """WITH s AS (SELECT *, sum(length(text)) OVER w AS rest, count(*) OVER w AS left_ FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT conv_id, max(rest) AS whole, min(CASE WHEN (rest <= 480 OR left_ <= 3) AND role = 'user' THEN turn END) AS from_, count(*) AS n FROM s GROUP BY 1) SELECT conv_id, turn FROM conversations JOIN c USING (conv_id) WHERE whole <= 800 OR n <= 3 OR turn >= from_""")
def w7(spark, d):
    return folds.trim_history(table(spark, d, "conversations"), 800, 0.6, 3).select("conv_id", "turn")


@query("w12_previews", "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_answer, CAST(count_if(role = 'user') AS BIGINT) AS questions, max(turn) AS last_turn FROM conversations GROUP BY 1")
def w12(spark, d):
    return sessions.previews(table(spark, d, "conversations"))


@query("w13_round_history", f"SELECT conv_id, turn AS pos, CASE WHEN role = 'user' THEN '[USER]: ' || {_ROUNDS} ELSE '[Agent] ' || left({_ROUNDS}, 80) END AS line FROM conversations")
def w13(spark, d):
    return sessions.round_history(table(spark, d, "conversations"))


def _sections(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("Prompt", "Response", "USER", "ASSISTANT"))), (F.col("event_id") * 7 % 11 % 4 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("pos"), kind.alias("kind"), F.col("event_type").alias("body"))


_SECTIONS = "sections AS (SELECT user_id AS name, event_id AS pos, (['Prompt', 'Response', 'USER', 'ASSISTANT'])[event_id * 7 % 11 % 4 + 1] AS kind, event_type AS body FROM events)"


@query("w2_pairs", f"WITH {_SECTIONS}, l AS (SELECT *, lag(kind) OVER w AS before, lag(body) OVER w AS prompt FROM sections WHERE kind IN ('Prompt', 'Response') WINDOW w AS (PARTITION BY name ORDER BY pos)) SELECT name, pos, prompt, body AS response FROM l WHERE kind = 'Response' AND before = 'Prompt'")
def w2(spark, d):
    return sessions.pairs(_sections(spark, d))


@query("w10_drop_prompts", f"WITH {_SECTIONS}, l AS (SELECT *, lead(kind) OVER (PARTITION BY name ORDER BY pos) AS after FROM sections) SELECT name, pos, kind, body FROM l WHERE NOT (kind = 'Prompt' AND coalesce(after, '') = 'USER') AND kind <> 'ASSISTANT'")
def w10(spark, d):
    return sessions.drop_prompts(_sections(spark, d))


@query("w11_archivable", f"""WITH e AS (SELECT user_id * 100 + day(ts) AS name, ts, event_type FROM events), s AS (SELECT name, max(ts) AS mtime, count(*) * 2500 AS size FROM e GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, name) AS k FROM s)
SELECT name, mtime, size, strftime(mtime, '%Y-%m') AS month FROM k WHERE k > 10 AND {_NOW} - mtime >= INTERVAL 2 HOUR AND size >= 4500 AND name NOT IN (SELECT name FROM e WHERE event_type = 'signup')""")
def w11(spark, d):
    """Each user's day is a session; days with a signup are archived."""
    e = table(spark, d, "events").select((F.col("user_id") * 100 + F.day("ts")).alias("name"), "ts", "event_type")
    s = e.groupBy("name").agg(F.max("ts").alias("mtime"), (F.count("*") * 2500).alias("size"))
    return sessions.archivable(s, e.where("event_type = 'signup'").select("name"), NOW)


@query("a13_months", "SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def a13(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.countDistinct("user_id").alias("sessions"))


@query("j6_tool_results", "WITH u AS (SELECT DISTINCT event_id % 500 AS id FROM events), r AS (SELECT event_id % 700 + 100 AS t, arg_min(event_type, event_id) AS content FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT id, 'run' AS name, coalesce(content, '(error)') AS content FROM u LEFT JOIN r ON t = id")
def j6(spark, d):
    e = table(spark, d, "events")
    uses = e.select((F.col("event_id") % 500).alias("id"), F.lit("run").alias("name"))
    return sessions.match_results(uses, e.where("event_id % 3 = 0").select((F.col("event_id") % 700 + 100).alias("tool_use_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("content")))


@query("j7_write_results", "WITH n AS (SELECT conv_id, turn, role, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, coalesce(next_role = 'user' AND contains(lower(next_text), 'the'), false) AS confirmed FROM n WHERE role = 'assistant'")
def j7(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"next_text": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'assistant'")
    return c.select("conv_id", "turn", F.coalesce((F.col("next_role") == "user") & F.contains(F.lower("next_text"), F.lit("the")), F.lit(False)).alias("confirmed"))


@query("t5_turn_buffer", "SELECT conv_id AS stream, turn // 2 AS turn, string_agg(text, '' ORDER BY conversations.turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id, turn // 2")
def t5(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.expr("turn div 2").alias("turn"), F.col("turn").alias("seq"), "text")
    return sessions.turn_buffer(c, 1000)


# ---- maintenance

_OLD = "o AS (SELECT doc_id AS path, length(text) AS size, doc_id * 10 AS mtime, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS sha256 FROM documents WHERE doc_id % 10 <> 1)"
_NEW = "n AS (SELECT doc_id AS path, length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, doc_id * 10 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 2)"


def _fingerprints(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.length("text").cast("long").alias("size"), (F.col("doc_id") * 10).alias("mtime"), F.sha2("text", 256).alias("sha256"))
    old = t.where("path % 10 <> 1").withColumn("sha256", F.when(F.col("path") % 3 == 0, F.col("sha256")))
    new = t.where("path % 10 <> 2").withColumns({"size": F.col("size") + (F.col("path") % 7 == 0).cast("long"), "mtime": F.col("mtime") + (F.col("path") % 5 == 0).cast("long")})
    return old, new


@query("j5_changes", f"WITH {_OLD}, {_NEW} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.size <> n.size OR (CASE WHEN o.sha256 IS NOT NULL THEN o.sha256 <> n.sha256 ELSE o.mtime <> n.mtime END)")
def j5(spark, d):
    return maintenance.changes(*_fingerprints(spark, d))


@query("j3_upsert", f"WITH {RECORDS}, n AS (SELECT file_name, data_id, chunk_index, 'new ' || body AS body FROM records WHERE doc_id % 4 = 0 AND chunk_index < 2) SELECT file_name, data_id, chunk_index, body FROM records WHERE file_name NOT IN (SELECT file_name FROM n) UNION ALL SELECT * FROM n")
def j3(spark, d):
    r = records(spark, d).select("file_name", "data_id", "chunk_index", "body", "doc_id")
    new = r.where("doc_id % 4 = 0 and chunk_index < 2").withColumn("body", F.concat(F.lit("new "), "body"))
    return maintenance.upsert(r.drop("doc_id"), new)


@query("j4_delete", f"WITH {RECORDS} SELECT data_id, count(*) AS n FROM records WHERE doc_id % 6 <> 0 GROUP BY 1")
def j4(spark, d):
    r = records(spark, d)
    return maintenance.delete(r, r.where("doc_id % 6 = 0")).groupBy("data_id").agg(F.count("*").alias("n"))


@query("j8_scope", f"WITH {RECORDS} SELECT kb_id, file_name, count(*) AS n FROM records WHERE kb_id = 'kb-src1' OR (kb_id = 'kb-src2' AND file_name IN ('doc2.md', 'src2/doc25.md', 'doc16.md')) GROUP BY 1, 2")
def j8(spark, d):
    scope = spark.createDataFrame([("kb-src1", True, []), ("kb-src2", False, ["doc2.md", "src2/doc25.md", "doc16.md"])], "kb_id string, all_documents boolean, documents array<string>")
    return maintenance.in_scope(records(spark, d), scope).groupBy("kb_id", "file_name").agg(F.count("*").alias("n"))


@query("j2_document_results", """WITH d AS (SELECT doc_id AS doc, 'p' || doc_id AS processed, 's' || doc_id AS source FROM documents), f AS (SELECT CASE event_id % 3 WHEN 0 THEN 'p' || event_id % 997 WHEN 1 THEN 's' || event_id % 997 ELSE 'p' || event_id % 997 || ':image' END AS key, CASE WHEN event_id % 5 = 0 THEN 'image' ELSE 'text' END AS stage FROM events),
o AS (SELECT coalesce(a.doc, b.doc, c.doc) AS doc, stage FROM f LEFT JOIN d a ON a.processed = key LEFT JOIN d b ON b.source = key LEFT JOIN d c ON c.processed = split_part(key, ':', 1)), n AS (SELECT doc, count(*) AS failures, count_if(stage = 'image') AS i FROM o WHERE doc IS NOT NULL GROUP BY 1)
SELECT d.doc, coalesce(failures, 0) AS failures, CAST(coalesce(i, 0) AS BIGINT) AS image_failures, CASE WHEN coalesce(failures, 0) = 0 THEN 'ready' WHEN failures = i THEN 'warning' ELSE 'failed' END AS status FROM d LEFT JOIN n USING (doc)""")
def j2(spark, d):
    s = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("p"), s).alias("processed"), F.concat(F.lit("s"), s).alias("source"))
    i, k = (F.col("event_id") % 997).cast("string"), F.col("event_id") % 3
    fails = table(spark, d, "events").select(F.when(k == 0, F.concat(F.lit("p"), i)).when(k == 1, F.concat(F.lit("s"), i)).otherwise(F.concat(F.lit("p"), i, F.lit(":image"))).alias("key"), F.when(F.col("event_id") % 5 == 0, "image").otherwise("text").alias("stage"))
    return maintenance.document_results(docs, fails)


@query("a10_publish_summary", "WITH s AS (SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'warning' ELSE 'ready' END AS status FROM events) SELECT count(*) AS documents, CAST(count_if(status = 'ready') AS BIGINT) AS ready, CAST(count_if(status = 'warning') AS BIGINT) AS warning, CAST(count_if(status = 'failed') AS BIGINT) AS failed FROM s")
def a10(spark, d):
    return maintenance.publish_summary(table(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "warning").otherwise("ready").alias("status")))


@query("a11_kind_counts", f"WITH {RECORDS} SELECT CAST(count_if(kind = 'text') AS BIGINT) AS text, CAST(count_if(kind = 'image') AS BIGINT) AS image, CAST(count_if(content_type = 'table') AS BIGINT) AS tables FROM records")
def a11(spark, d):
    return records(spark, d).agg(F.count_if(F.col("kind") == "text").alias("text"), F.count_if(F.col("kind") == "image").alias("image"), F.count_if(F.col("content_type") == "table").alias("tables"))


@query("a12_insert_stats", f"WITH {RECORDS}, c AS (SELECT DISTINCT sha256(body) AS key FROM records WHERE doc_id % 2 = 0) SELECT count(*) AS rows, count(DISTINCT data_id) AS documents, count(c.key) AS hits, CAST(count_if(c.key IS NULL) AS BIGINT) AS misses FROM records LEFT JOIN c ON c.key = sha256(body) WHERE body <> ''")
def a12(spark, d):
    r = records(spark, d)
    return maintenance.insert_stats(r, r.where("doc_id % 2 = 0").select(F.sha2("body", 256).alias("key")).distinct())


@query("m2_add_documents", "SELECT doc_id AS path, CASE WHEN lang = 'en' THEN 'replaced' ELSE 'added' END AS action, CASE WHEN lang = 'en' THEN 'skipped' ELSE 'added' END AS kept FROM documents")
def m2(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "lang")
    known, offered = t.where("lang = 'en'"), t.select("path")
    return maintenance.add_documents(known, offered, replace=True).join(maintenance.add_documents(known, offered).withColumnRenamed("action", "kept"), "path")


@query("m4_reindex", "SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index, 'one of ' || doc_id AS body FROM documents UNION ALL SELECT doc_id, CAST(1 AS INTEGER), '| two |' || chr(10) || '| --- |' || chr(10) || '| ' || doc_id || ' |' FROM documents UNION ALL SELECT -doc_id - 1, 0, 'old' FROM documents")
def m4(spark, d):
    """Chunked anew where the contract has changed (ids as they are), the published records where it hasn't (negative ids)."""
    i = F.col("doc_id").cast("string")
    texts = table(spark, d, "documents").select("doc_id", F.concat(F.lit("one of "), i, F.lit("\n\n| two |\n| --- |\n| "), i, F.lit(" |")).alias("text"))
    records_ = texts.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("old").alias("body"))
    new = maintenance.reindex(records_, texts, {"target": 768, "parser": 1}, {"target": 768, "parser": 2}).select("doc_id", "chunk_index", "body")
    return new.unionByName(maintenance.reindex(records_, texts, {"target": 768}, {"target": 768}))


@query("m5_pending_images", f"WITH {RECORDS} SELECT data_id, chunk_index FROM records WHERE kind = 'image' AND (doc_id % 4 = 1 OR (caption = '' AND table_markdown = ''))")
def m5(spark, d):
    r = records(spark, d).withColumns({"meta": F.when(F.col("doc_id") % 4 == 1, "old").otherwise("v2"), "analysis_error": F.lit(""), "description": F.col("caption")})
    return maintenance.pending_images(r, "v2").select("data_id", "chunk_index")


@query("m6_unreferenced", "SELECT doc_id AS path FROM documents WHERE lang IS DISTINCT FROM 'en' AND NOT contains(coalesce(text, ''), 'the ')")
def m6(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "lang", "source", "text")
    manifest = t.where("lang = 'en' or contains(text, 'the ')").groupBy("source").agg(F.collect_list("path").alias("processed"))
    return maintenance.unreferenced(t.select("path"), manifest)


@query("m8_base_status", "SELECT user_id AS kb_id, CASE WHEN bool_or(event_type = 'signup') THEN 'processing' WHEN count(*) < 3 THEN 'empty' WHEN user_id % 9 = 0 THEN 'missing' WHEN user_id % 8 = 0 THEN 'broken' WHEN bool_or(event_type = 'error') THEN 'ready_with_warnings' ELSE 'ready' END AS status FROM events GROUP BY 1")
def m8(spark, d):
    n = F.count("*")
    facts = table(spark, d, "events").groupBy(F.col("user_id").alias("kb_id")).agg(F.bool_or(F.col("event_type") == "signup").alias("processing"), F.when(n < 3, 0).otherwise(n).alias("n_records"), F.count_if(F.col("event_type") == "error").alias("failures"))
    facts = facts.withColumns({"path_exists": F.col("kb_id") % 9 != 0, "indexed": F.col("n_records") - (F.col("kb_id") % 8 == 0).cast("int"), "source_changed": F.lit(False)})
    return maintenance.base_status(facts)


@query("m10_import_sessions", "WITH o AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1) SELECT CAST(count_if(n > 5 AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')) AS BIGINT) AS added, CAST(count(*) - count_if(n > 5 AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')) AS BIGINT) AS skipped FROM o")
def m10(spark, d):
    e = table(spark, d, "events")
    offered = e.where("event_type <> 'signup'").groupBy(F.col("user_id").alias("id")).agg((F.count("*") - 5).alias("n_messages"))
    return maintenance.import_sessions(e.where("event_type = 'signup'").select(F.col("user_id").alias("id")).distinct(), offered)


@query("m11_reconcile_suffix", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'a|' || text WHEN 1 THEN 'a|' || text || ' more' END AS out FROM conversations")
def m11(spark, d):
    k = F.col("turn") % 3
    full = F.when(k == 0, F.concat(F.lit("a"), "text")).when(k == 1, F.concat(F.lit("a"), "text", F.lit(" more"))).otherwise("other")
    return maintenance.reconcile_suffix(table(spark, d, "conversations").select("conv_id", "turn", full.alias("full"), F.array(F.lit("a"), "text").alias("segments"))).select("conv_id", "turn", F.array_join("out", "|").alias("out"))


@query("m12_citations", f"WITH {RECORDS} SELECT kb_id, data_id AS source_data_id, label AS ref_key, 'x' AS data_id, min(doc_id) AS pos FROM records WHERE kind = 'image' GROUP BY ALL ORDER BY pos, kb_id, source_data_id, ref_key LIMIT 24")
def m12(spark, d):
    r = records(spark, d).select("kb_id", F.col("data_id").alias("source_data_id"), F.col("label").alias("ref_key"), F.lit("x").alias("data_id"), "kind", F.col("doc_id").alias("pos"))
    return maintenance.citations(r)


@query("a21_merge_progress", "SELECT user_id AS source, arg_max(event_type, event_id) AS status, arg_max(CASE WHEN value > 50 THEN 'high' END, event_id) AS error, arg_max(CASE WHEN event_id % 4 = 0 THEN event_id END, event_id) AS current FROM events GROUP BY 1")
def a21(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.when(F.col("value") > 50, "high").alias("error"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("current"))
    return maintenance.merge_progress(e)


@query("j11_live_names", "SELECT 'n' || conv_id AS name, conv_id AS log FROM conversations WHERE turn = 0 AND conv_id IN (SELECT event_id FROM events WHERE event_type = 'view')")
def j11(spark, d):
    return maintenance.live_names(table(spark, d, "conversations").where("turn = 0").select(F.concat(F.lit("n"), F.col("conv_id").cast("string")).alias("name"), F.col("conv_id").alias("log")), table(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("log")))


@query("j12_last_runs", "WITH r AS (SELECT user_id, max(date_trunc('minute', ts)) AS last_run FROM events WHERE event_type = 'view' GROUP BY 1), t AS (SELECT DISTINCT user_id FROM events) SELECT 'task' || t.user_id AS task, last_run FROM t LEFT JOIN r USING (user_id)")
def j12(spark, d):
    e = table(spark, d, "events")
    task = F.concat(F.lit("task"), F.col("user_id").cast("string"))
    return maintenance.last_runs(e.select(task.alias("task")).distinct(), e.where("event_type = 'view'").select(F.concat(F.date_format("ts", "yyyy-MM-dd_HHmm"), F.lit("_"), task, F.lit(".md")).alias("file")))


# ---- references, trees, control


@query("g2_overlaps", """WITH s AS (SELECT doc_id, unnest(range(0, length(text), 97)) AS s FROM documents), w AS (SELECT doc_id, unnest(range(50, length(text), 301)) AS lo FROM documents)
SELECT s.doc_id, s AS start, lo FROM s JOIN w ON s.doc_id = w.doc_id AND s < lo + 120 AND s + 40 > lo""")
def g2(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    spans = t.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(97)).cast("array<bigint>")).alias("start")).withColumn("end", F.col("start") + 40)
    windows = t.where("n > 50").select("doc_id", F.explode(F.sequence(F.lit(50), F.col("n") - 1, F.lit(301)).cast("array<bigint>")).alias("lo")).withColumn("hi", F.col("lo") + 120)
    return references.overlaps(spans, windows).select("doc_id", "start", "lo")


@query("g3_line_of_offset", """WITH r AS (SELECT doc_id, string_split(text, chr(10)) AS ls, length(text) AS n FROM documents), l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM r),
s AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l), o AS (SELECT doc_id, unnest(range(0, n, 250)) AS "offset" FROM r)
SELECT o.doc_id, o."offset", CAST(max(line_no) AS INTEGER) AS line_no FROM o JOIN s ON s.doc_id = o.doc_id AND start <= o."offset" GROUP BY 1, 2""")
def g3(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.select("doc_id", "line_no", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).alias("start"))
    offsets = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(250)).cast("array<bigint>")).alias("offset"))
    return references.line_of(offsets, starts)


@query("g7_heading_within", f"WITH {RECORDS}, h AS (SELECT doc_id, chunk_index AS line_no, CASE WHEN chunk_index % 4 = 0 THEN left(trim(regexp_replace(body, '\\s+', ' ', 'g')), 20) END AS t FROM records) SELECT doc_id, line_no, last_value(trim(t) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS heading FROM h WHERE t IS NULL OR t <> ''")
def g7(spark, d):
    flat = F.left(F.trim(F.regexp_replace("body", r"\s+", " ")), F.lit(20))
    lines = records(spark, d).select("doc_id", F.col("chunk_index").alias("line_no"), F.when(F.col("chunk_index") % 4 == 0, F.concat(F.lit("## "), flat)).otherwise("x").alias("line")).where("line <> '## '")
    return references.heading_within(lines, 2).select("doc_id", "line_no", "heading")


@query("g9_related_paragraphs", f"""WITH {RECORDS}, p AS (SELECT doc_id, chunk_index AS pos, '见图1 ' || body AS text FROM records WHERE chunk_index % 2 = 0 AND NOT contains(body, '![')), w AS (SELECT *, row_number() OVER o AS k, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, '图1' AS ref_key, pos, substr(text, 1, CAST(900 - before AS BIGINT)) AS text FROM w WHERE k <= 5 AND before < 900""")
def g9(spark, d):
    p = records(spark, d).select("doc_id", F.col("chunk_index").alias("pos"), F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("见图1 "), "body")).otherwise(F.concat(F.lit("图1 "), F.lit("caption"))).alias("text"))
    return references.related_paragraphs(p, p.select("doc_id", F.lit("图1").alias("ref_key")).distinct(), 5, 900)


@query("g10_title_keys", """WITH t AS (SELECT doc_id, doc_id % 3 AS a, doc_id % 7 AS b, doc_id % 5 AS c FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '图 ' || a || '－' || b || ' － ' || c || ' x' WHEN 1 THEN '图' || a || '-' || b || '.' ELSE '图 ' || a || ' 7' END AS title,
  CASE doc_id % 4 WHEN 0 THEN '图' || a || '-' || b || '-' || c WHEN 1 THEN '图' || a || '-' || b ELSE '图' || a END AS ref_key FROM t WHERE doc_id % 4 < 3""")
def g10(spark, d):
    """Titles with a key of three numbers, two, one, and of another kind that has none."""
    n = {k: (F.col("doc_id") % m).cast("string") for k, m in (("a", 3), ("b", 7), ("c", 5), ("kind", 4))}
    one = F.concat(F.lit("图"), n["a"])
    two = F.concat(one, F.lit("-"), n["b"])
    title = F.when(n["kind"] == "0", F.concat(F.lit("图 "), n["a"], F.lit("－"), n["b"], F.lit(" － "), n["c"], F.lit(" x"))).when(n["kind"] == "1", F.concat(two, F.lit("."))).when(n["kind"] == "2", F.concat(F.lit("图 "), n["a"], F.lit(" 7"))).otherwise("表 1")
    docs = table(spark, d, "documents").select("doc_id", title.alias("title"))
    keys = docs.select("doc_id", F.explode(F.array(one, two, F.concat(two, F.lit("-"), n["c"]))).alias("ref_key"))
    return references.title_keys(docs, keys)


@query("g11_one_job_a_hash", f"""WITH {RECORDS}, j AS (SELECT sha256(body) AS sha, min((CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END, doc_id, chunk_index)) AS f, count(*) AS origins FROM records GROUP BY 1)
SELECT sha, CASE WHEN f[1] = 0 THEN 'table' ELSE 'general' END AS focus, 'same' AS context, origins FROM j""")
def g11(spark, d):
    return references.one_job_a_hash(records(spark, d).select(F.sha2("body", 256).alias("sha"), F.lit("same").alias("context"), F.when(F.col("doc_id") % 3 == 0, "table").otherwise("general").alias("focus"), (F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("pos")))


@query("g12_focus", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'general' END AS focus FROM pages")
def g12(spark, d):
    k = F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", references.focus(F.when(k == 0, "See Table 3, Fig. 1").when(k == 1, "图 7").otherwise("nothing")).alias("focus"))


@query("g14_unique_basenames", "WITH f AS (SELECT lower(list_extract(string_split(url, '/'), -1)) AS b, url FROM pages), s AS (SELECT b, min(url) AS path FROM f GROUP BY 1 HAVING count(*) = 1) SELECT DISTINCT name, path FROM (SELECT list_extract(string_split(url, '/'), -1) AS name FROM pages) JOIN s ON lower(name) = b")
def g14(spark, d):
    p = table(spark, d, "pages")
    return references.unique_basenames(p.select(F.element_at(F.split("url", "/"), -1).alias("name")).distinct(), p.select(F.col("url").alias("path")))


def _nodes(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 == 0, None).when(F.col("doc_id") % 7 == 0, F.col("doc_id") - F.col("doc_id") % 50).otherwise(F.col("doc_id") - 1).alias("parent"))


_TREE = """nodes AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN doc_id - doc_id % 50 ELSE doc_id - 1 END AS parent FROM documents),
up AS (SELECT id, id AS ancestor, 0 AS up FROM nodes UNION ALL SELECT up.id, nodes.parent, up.up + 1 FROM up JOIN nodes ON nodes.id = up.ancestor WHERE nodes.parent IS NOT NULL),
paths AS (SELECT *, max(up) OVER (PARTITION BY id) - up AS depth FROM up)"""


@query("v1_path_to", f"WITH RECURSIVE {_TREE} SELECT depth, ancestor AS id FROM paths WHERE id = 148")
def v1(spark, d):
    return tree.path_to(_nodes(spark, d), 148)


@query("v2_rebuild", f"WITH RECURSIVE {_TREE} SELECT id, string_agg('d' || ancestor, '' ORDER BY depth) AS history, max(CASE WHEN ancestor % 3 = 0 THEN (depth, 'n' || ancestor) END)[2] AS note FROM paths GROUP BY 1")
def v2(spark, d):
    n = _nodes(spark, d)
    s = F.col("id").cast("string")
    deltas = n.select("id", F.array(F.concat(F.lit("d"), s)).alias("delta"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("n"), s)).alias("note"))
    return tree.rebuild(n, deltas).withColumn("history", F.array_join("history", ""))


@query("v3_delete_subtree", f"WITH RECURSIVE {_TREE} SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM paths WHERE ancestor = 105)")
def v3(spark, d):
    n = _nodes(spark, d)
    return tree.delete_subtree(n, 105).select("id")


@query("v4_garbage", "SELECT DISTINCT md5(text) AS hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def v4(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    return tree.garbage(t.select("hash").distinct(), t.where("doc_id % 2 = 0"))


@query("v5_chains", f"WITH RECURSIVE {_TREE}, c AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1), h AS (SELECT id FROM nodes LEFT JOIN c USING (parent) WHERE n IS NULL OR n > 1) SELECT p.id, arg_min(p.ancestor, p.up) AS head, min(p.up) AS steps FROM paths p JOIN h ON h.id = p.ancestor GROUP BY 1")
def v5(spark, d):
    n = _nodes(spark, d)
    return tree.chains(n)


@query("v6_file_state", f"WITH RECURSIVE {_TREE}, w AS (SELECT id, 'f' || id % 4 AS path, CASE WHEN id % 5 <> 0 THEN 'h' || id END AS hash FROM nodes), s AS (SELECT p.id, path, max((depth, hash))[2] AS hash FROM paths p JOIN w ON w.id = p.ancestor GROUP BY 1, 2) SELECT * FROM s WHERE hash IS NOT NULL")
def v6(spark, d):
    n = _nodes(spark, d)
    s = F.col("id").cast("string")
    return tree.file_state(n, n.select("id", F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("path"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("h"), s)).alias("hash")))


@query("v8_same_depth", f"WITH RECURSIVE {_TREE}, n AS (SELECT id, depth FROM paths WHERE up = 0) SELECT id, depth, coalesce(lead(id) OVER (PARTITION BY depth ORDER BY id), min(id) OVER (PARTITION BY depth)) AS next_id FROM n")
def v8(spark, d):
    return tree.same_depth(_nodes(spark, d))


@query("v9_roots", "SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 1 OR doc_id = 0")
def v9(spark, d):
    n = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 1, -1).otherwise(F.col("doc_id") - 1).alias("parent"))
    return tree.roots(n)


_BUCKETS = "e AS (SELECT user_id % 20 AS bucket, ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"


def _bucket_events(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 20).alias("bucket"), "ts", F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("event_type").alias("type"))


@query("t2_window_load", f"WITH {_BUCKETS} SELECT bucket, seq, count(*) OVER m AS requests_60, CAST(sum(tokens) OVER m AS BIGINT) AS tokens_60, count(*) OVER s AS requests_1 FROM e WINDOW m AS (PARTITION BY bucket ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), s AS (PARTITION BY bucket ORDER BY epoch_us(ts) RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW)")
def t2(spark, d):
    return control.window_load(_bucket_events(spark, d), 100, 1000).select("bucket", "seq", F.col("requests_60").cast("long").alias("requests_60"), "tokens_60", F.col("requests_1").cast("long").alias("requests_1"))


@query("t2_admission", f"""WITH RECURSIVE {_BUCKETS}, i AS (SELECT bucket, seq, epoch_us(ts) AS us, tokens, row_number() OVER (PARTITION BY bucket ORDER BY epoch_us(ts), seq) AS k FROM e),
r AS (SELECT bucket, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, false AS admitted, CAST([] AS STRUCT(us BIGINT, tokens BIGINT)[]) AS held FROM (SELECT DISTINCT bucket FROM i)
UNION ALL SELECT bucket, seq, k, admitted, CASE WHEN admitted THEN list_append(long, {{'us': us, 'tokens': tokens}}) ELSE long END FROM (
  SELECT *, len(long) < 108 AND coalesce(list_sum(list_transform(long, lambda x: x.tokens)), 0) + tokens <= 5400 AND len(short) < 1 AND (len(short) = 0 OR list_sum(list_transform(short, lambda x: x.tokens)) + tokens <= 90) AS admitted FROM (
    SELECT i.*, list_filter(r.held, lambda x: x.us > i.us - 60000000) AS long, list_filter(r.held, lambda x: x.us > i.us - 1000000) AS short FROM r JOIN i ON i.bucket = r.bucket AND i.k = r.k + 1)))
SELECT bucket, seq, admitted FROM r WHERE k > 0""")
def t2a(spark, d):
    return control.admit(_bucket_events(spark, d), 120, 6000)


@query("t4_bursts", "WITH e AS (SELECT user_id % 20 AS bucket, ts, event_id AS seq, event_type AS type FROM events), f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 60000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS far FROM e WINDOW w AS (PARTITION BY bucket ORDER BY ts, seq)), b AS (SELECT *, sum(far) OVER (PARTITION BY bucket ORDER BY ts, seq) AS burst FROM f) SELECT bucket, CAST(burst AS BIGINT) AS burst, arg_min(type, (ts, seq)) AS type, count(*) AS n, min(ts) AS first FROM b GROUP BY 1, 2")
def t4(spark, d):
    return control.bursts(_bucket_events(spark, d), 60_000)


@query("t6_idle", f"SELECT user_id, max(ts) AS last_seen, 'stopped' AS status FROM events WHERE ts < {_NOW} GROUP BY 1 HAVING epoch_us(date_trunc('second', {_NOW})) // 1000000 - epoch_us(max(ts)) // 1000000 > 3600")
def t6(spark, d):
    return control.idle(table(spark, d, "events").where(F.col("ts") < F.lit(NOW)).groupBy("user_id").agg(F.max("ts").alias("last_seen")).withColumn("status", F.lit("stopped")), NOW)


@query("t7_due_tasks", f"""WITH t AS (SELECT user_id AS name, user_id % 5 <> 0 AS enabled, (['daily', 'weekday', 'weekly', 'once', 'every_5h', 'odd'])[user_id % 6 + 1] AS repeat, user_id % 13 AS h, max(ts) AS last_run FROM events WHERE ts < {_NOW} GROUP BY user_id),
c AS (SELECT *, 750 - (h * 60 + 15) AS late, CASE repeat WHEN 'once' THEN CAST(999999 AS BIGINT) * 86400 WHEN 'weekly' THEN 6 * 86400 WHEN 'every_5h' THEN 18000 ELSE 72000 END AS cool FROM t)
SELECT name FROM c WHERE enabled AND late >= 0 AND late <= 360 AND repeat <> 'weekday' AND epoch_us({_NOW}) // 1000000 - epoch_us(last_run) // 1000000 >= cool""")
def t7(spark, d):
    names = F.array(*map(F.lit, ("daily", "weekday", "weekly", "once", "every_5h", "odd")))
    t = table(spark, d, "events").where(F.col("ts") < F.lit(NOW)).groupBy(F.col("user_id").alias("name")).agg(F.max("ts").alias("last_run"))
    t = t.select("name", (F.col("name") % 5 != 0).alias("enabled"), F.element_at(names, (F.col("name") % 6 + 1).cast("int")).alias("repeat"), F.concat((F.col("name") % 13).cast("string"), F.lit(":15")).alias("schedule"), F.lit(None).cast("int").alias("max_delay_hours"), "last_run")
    return control.due(t, NOW).select("name")


@query("t10_transient", "WITH s AS (SELECT DISTINCT event_type AS text FROM events) SELECT text FROM s WHERE text NOT IN ('view') AND text NOT IN ('purchase')")
def t10(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("text"))
    return control.transient(e.withColumn("phase", F.lit("seen")).unionByName(spark.createDataFrame([("view", "initial"), ("purchase", "final"), ("error", "final")], "text string, phase string")))


@query("t11_failover", "WITH c AS (SELECT user_id, ts, event_id, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM events) SELECT event_id AS seq, CASE WHEN epoch_us(ts) // 1000000 - epoch_us(f) // 1000000 < 300 THEN 1 ELSE 0 END AS backend FROM c")
def t11(spark, d):
    return control.failover(table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))).select("seq", "backend")


@query("l6_batches", """WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n, length(text) - length(regexp_replace(text, '[㐀-鿿豈-﫿]', '', 'g')) AS cjk FROM documents),
i AS (SELECT doc_id % 16 AS bucket, doc_id AS pos, greatest(1, CAST(floor((cjk + (n - cjk) / CAST(4.0 AS DOUBLE) + 8) * CAST(1.15 AS DOUBLE) + CAST(0.999 AS DOUBLE)) AS BIGINT)) AS tokens, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS k FROM t),
r AS (SELECT bucket, pos, k, 0 AS batch, 1 AS n, least(tokens, 18000) AS used FROM i WHERE k = 1
UNION ALL SELECT bucket, pos, k, batch + CAST(full_ AS INTEGER), CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN 0 ELSE used END + least(tokens, 18000) FROM (SELECT i.*, r.batch, r.n, r.used, r.n >= 10 OR r.used + i.tokens > 18000 AS full_ FROM r JOIN i ON i.bucket = r.bucket AND i.k = r.k + 1))
SELECT bucket, pos, batch FROM r""")
def l6(spark, d):
    t = table(spark, d, "documents").select((F.col("doc_id") % 16).alias("bucket"), F.col("doc_id").alias("pos"), T.limiter_tokens(F.col("text")).alias("tokens"))
    return folds.batches(t, 10, 18_000)


@query("k5_pack_lines", f"""WITH RECURSIVE {RECORDS}, i AS (SELECT doc_id, chunk_index AS k, length(body) AS n FROM records),
r AS (SELECT doc_id, k, 0 AS part, n AS used FROM i WHERE k = 0
UNION ALL SELECT doc_id, k, part + CAST(full_ AS INTEGER), CASE WHEN full_ THEN n ELSE used + n + CASE WHEN used > 0 THEN 1 ELSE 0 END END FROM (SELECT i.*, r.part, r.used, r.used > 0 AND r.used + 1 + i.n > 768 AS full_ FROM r JOIN i ON i.doc_id = r.doc_id AND i.k = r.k + 1))
SELECT doc_id, k AS line_no, part FROM r""")
def k5(spark, d):
    return folds.pack_lines(records(spark, d).select("doc_id", F.col("chunk_index").alias("line_no"), F.col("body").alias("line")), 768)


def _last(mark: str) -> str:
    """Where the last mark of window w ends, counted in w, if it begins past a third of the target."""
    m, back = (" || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in x) for x in (mark, mark[::-1]))
    begin = f"length(w) - strpos(reverse(w), {back}) + 1 - {len(mark)}"
    return f"CASE WHEN contains(w, {m}) AND {begin} > 256 THEN {begin} + {len(mark)} END"


_K4 = f"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE text <> ''),
r AS (SELECT doc_id, text, 0 AS part, 0 AS b, CASE WHEN length(text) <= 768 THEN length(text) ELSE coalesce({", ".join(map(_last, splitting.CUTS))}, 768) END AS e FROM (SELECT *, left(text, 769) AS w FROM d)
UNION ALL SELECT doc_id, text, part + 1, b, CASE WHEN length(text) - b <= 768 THEN length(text) ELSE b + coalesce({", ".join(map(_last, splitting.CUTS))}, 768) END FROM (SELECT *, substr(text, b + 1, 769) AS w FROM (SELECT doc_id, text, part, greatest(b + 1, e - 96) AS b FROM r WHERE length(text) - b > 768))),
s AS (SELECT doc_id, part, CASE WHEN length(text) <= 768 THEN text ELSE regexp_replace(substr(text, b + 1, e - b), '\\A\\s+|\\s+\\z', '', 'g') END AS body FROM r)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS part, body FROM s WHERE body <> ''"""


@query("k4_overlapping_parts", _K4)
def k4(spark, d):
    return splitting.exploded(table(spark, d, "documents"), splitting.split_overlapping)


@query("k18_split_messages", """WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, -1 AS part, '' AS body, CASE WHEN t = '' THEN '...' ELSE t END AS rest FROM d
UNION ALL SELECT doc_id, part + 1, regexp_replace(left(rest, cut), '\\s+\\z', ''), regexp_replace(substr(rest, cut + 1), '\\A\\s+', '') FROM (
  SELECT *, CASE WHEN length(rest) <= 1900 THEN length(rest) WHEN contains(w, chr(10)) AND length(w) - strpos(reverse(w), chr(10)) >= 1140 THEN length(w) - strpos(reverse(w), chr(10)) ELSE 1900 END AS cut FROM (SELECT *, left(rest, 1900) AS w FROM r WHERE rest <> '')))
SELECT doc_id, part, body FROM r WHERE part >= 0""")
def k18(spark, d):
    return splitting.exploded(table(spark, d, "documents"), lambda t: splitting.split_message(t, 1900))


@query("w8_compress_tags")
def w8(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.concat(F.lit("<thinking>"), "text", F.lit("</thinking><history>x</history>")))
    return folds.compress_tags(c, 2, 80)


@query("w9_merge_histories")
def w9(spark, d):
    lines = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 0)
    return folds.merge_histories(lines.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.collect_list("text").over(w).alias("lines")))


@query("l11_drop_overlapping", """WITH RECURSIVE w AS (SELECT conv_id AS page_id, turn AS cand, list_distinct(string_split(lower(text), ' ')) AS items FROM conversations WHERE text IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY len(items) DESC, cand) AS k FROM w),
r AS (SELECT page_id, cand, k, true AS keep, [items] AS kept FROM i WHERE k = 1
UNION ALL SELECT page_id, cand, k, keep, CASE WHEN keep THEN list_append(kept, items) ELSE kept END FROM (SELECT i.*, r.kept, len(list_filter(r.kept, lambda x: len(list_intersect(x, i.items)) > 0.5 * len(i.items))) = 0 AS keep FROM r JOIN i ON i.page_id = r.page_id AND i.k = r.k + 1))
SELECT page_id, cand FROM r WHERE keep""")
def l11(spark, d):
    words = F.array_distinct(F.split(F.lower("text"), " "))
    return folds.drop_overlapping(table(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("cand"), F.size(words).alias("score"), words.alias("items")))
