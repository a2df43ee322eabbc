"""Inputs that queries share: the driver's tables in the shapes that the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each line of each document; every third line is an image, every fifth document lies in a folder."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "body"))
    image = F.col("chunk_index") % 3 == 2
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("/"))).otherwise(""), F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    return lines.select(
        F.concat(F.lit("kb-"), "source").alias("kb_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("data_id"), F.col("chunk_index").cast("long").alias("chunk_index"),
        name.alias("file_name"), F.when(image, "image").otherwise("text").alias("kind"), F.when(image & (F.col("doc_id") % 2 == 0), F.concat(F.lit("| a | b |\n| "), F.left("body", F.lit(20)), F.lit(" |"))).otherwise("").alias("table_markdown"),
        F.when(F.col("chunk_index") % 4 == 1, "").when(F.col("chunk_index") % 7 == 3, "table").when(image, "figure").otherwise("prose").alias("content_type"),
        "body", F.when(image, F.left("body", F.lit(30))).otherwise("").alias("caption"), F.concat(F.lit("图 "), (F.col("doc_id") % 9).cast("string"), F.lit("－"), F.col("chunk_index").cast("string")).alias("label"), "doc_id",
    )


RECORDS = """
raw AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, source, unnest(ls) AS body, unnest(range(0, len(ls))) AS chunk_index FROM raw),
records AS (SELECT 'kb-' || source AS kb_id, 'd' || doc_id AS data_id, chunk_index, CASE WHEN doc_id % 5 = 0 THEN source || '/' ELSE '' END || 'doc' || doc_id || '.md' AS file_name,
  CASE WHEN chunk_index % 3 = 2 THEN 'image' ELSE 'text' END AS kind, CASE WHEN chunk_index % 3 = 2 AND doc_id % 2 = 0 THEN '| a | b |' || chr(10) || '| ' || left(body, 20) || ' |' ELSE '' END AS table_markdown,
  CASE WHEN chunk_index % 4 = 1 THEN '' WHEN chunk_index % 7 = 3 THEN 'table' WHEN chunk_index % 3 = 2 THEN 'figure' ELSE 'prose' END AS content_type,
  body, CASE WHEN chunk_index % 3 = 2 THEN left(body, 30) ELSE '' END AS caption, '图 ' || (doc_id % 9) || '－' || chunk_index AS label, doc_id FROM lines)"""


# The first figure or table number of a text, half-width and with one kind of dash and dot; REF takes at most three digits.
_WIDE = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　–—·"
_HALF = ("".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " --.").replace("'", "''")
_NUMBER = "(图|表)\\s*([0-9]{{1,3}}(?:\\s*[-.]\\s*[0-9]{{1,3}}){{0,3}})"
REF_KEY = f"regexp_replace(regexp_extract(translate({{0}}, '{_WIDE}', '{_HALF.replace('{', '{{').replace('}', '}}')}'), '{_NUMBER}', 0), '\\s+', '', 'g')"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a message board."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"), F.col("event_type").alias("content"), F.col("ts").alias("created_at"))


POSTS = "posts AS (SELECT event_id AS id, 'user' || user_id AS author, event_type AS content, ts AS created_at FROM events)"

# Prices in dollars for a million tokens in and out, by model, in order of lookup.
PRICES = (
    ("gpt-5.4", 2.50, 15.0), ("gpt-5", 1.25, 10.0), ("gpt-5-mini", 0.25, 2.0), ("gpt-4o", 2.50, 10.0), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4.1", 2.0, 8.0), ("gpt-4.1-mini", 0.40, 1.60),
    ("gpt-4.1-nano", 0.10, 0.40), ("o4-mini", 0.55, 2.20), ("claude-opus-4-8", 5.0, 25.0), ("claude-opus-4-7", 5.0, 25.0), ("claude-opus-4-6", 5.0, 25.0), ("claude-sonnet-4-6", 3.0, 15.0),
    ("claude-sonnet-4-5", 3.0, 15.0), ("claude-haiku-4-5", 1.0, 5.0), ("deepseek-v4", 0.14, 0.28), ("deepseek-v4-pro", 0.435, 0.87), ("deepseek-chat", 0.14, 0.28), ("deepseek-reasoner", 0.55, 2.19),
    ("glm-5.1", 0.50, 0.50), ("minimax-m2.7", 0.50, 0.50), ("kimi-for-coding", 0.50, 2.0),
)
DEFAULT_PRICE = (3.0, 15.0)
CURRENCY_RATE = 7.2
MODELS = ("gpt-4o", "Claude-Opus-4-6[1m]", "x-deepseek-chat-1", "unknown", "GPT-5-mini", "kimi-for-coding-2")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative token counters that are set back now and then: thread, ts, seq and four counters."""
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % len(MODELS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), "ts", F.col("event_id").alias("seq"), (k * 10 + F.col("event_id") % 7).alias("input"), (k * 3).alias("output"), (F.col("event_id") % 3).alias("cache_create"), (k * 2 + F.col("event_id") % 5).alias("cache_read"), model.alias("model"))


COUNTERS = f"""
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
counters AS (SELECT user_id AS thread, ts, event_id AS seq, k * 10 + event_id % 7 AS input, k * 3 AS output, event_id % 3 AS cache_create, k * 2 + event_id % 5 AS cache_read,
  ({list(MODELS)!r})[user_id % {len(MODELS)} + 1] AS model FROM k)"""
PRICES_SQL = "prices(k, p_in, p_out, i) AS (VALUES " + ", ".join(f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), {i})" for i, (m, a, b) in enumerate(PRICES)) + ")"
