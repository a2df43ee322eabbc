"""The queries of the numbered operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import byte_bpe, decontaminate, fill_middle, jaccard_join, langid, line_dedup, packing, simhash, suffix_dedup, token_counts, token_files, url_filter, vector_codes
from marlstone.llm.common import Workspace, table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = Workspace(spark, "token-files").path("data")
    parts = token_files.write(spark, table(spark, sf_dir, "documents"), path, folder, end_id=2)
    return token_files.read(spark, token_files.finish(spark, parts), token_files.id_dtype(path), digest=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(spark, docs))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove(spark, table(spark, sf_dir, "documents"), length=400))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.75)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.group(spark, table(spark, sf_dir, "documents"), percent=75, width=5)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), bound=1)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.neighbours(spark, table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"), URL_RULES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark, table(spark, sf_dir, "embeddings"), parts=16, size=64, rounds=2, scale=256)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    return vector_codes.with_label_errors(codes).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"), seed="42", plain_percent=50, spm_percent=80)
    digest = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return fill_middle.restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_SHINGLED = r"""
{name}_w AS (SELECT {id}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}),
{name}_i AS (SELECT {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {name}_w WHERE len(w) > 0),
{name} AS (SELECT DISTINCT {id}, array_to_string(w[i:i + 4], ' ') AS s FROM {name}_i)"""

# levenshtein() there counts bytes, of which a character has up to four, so what it finds is compared by characters.
SQL = {
    "op5_decontaminate": "WITH " + _SHINGLED.format(name="d", id="doc_id", table="documents") + "," + _SHINGLED.format(name="b", id="item_id", table="benchmark") + """,
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_found * 100 >= 75 * n_shingles
""",
    "op7_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l),
f AS (SELECT line, min((doc_id, line_no)) AS first FROM t WHERE line <> '' GROUP BY 1),
c AS (SELECT a.line, CASE WHEN length(a.line) < length(b.line) THEN b.line ELSE a.line END AS x, CASE WHEN length(a.line) < length(b.line) THEN a.line ELSE b.line END AS y
      FROM f a JOIN f b ON length(a.line) - length(b.line) BETWEEN -1 AND 1 AND b.first < a.first AND levenshtein(a.line, b.line) <= 4),
near AS (SELECT DISTINCT line FROM c WHERE len(list_filter(range(1, length(x) + 1), lambda p: x[:p - 1] || x[p + 1:] = CASE WHEN length(x) = length(y) THEN y[:p - 1] || y[p + 1:] ELSE y END)) > 0),
gone AS (SELECT doc_id, line_no FROM t JOIN f USING (line) LEFT JOIN near USING (line) WHERE near.line IS NOT NULL OR (doc_id, line_no) <> first),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY l.line_no) FILTER (WHERE g.doc_id IS NULL), '') AS kept
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)
""",
    "op10_url_filter": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.k = 1
""",
}
# Operator 11: one part after the other of each vector, three assignments with two new sets of codebooks between them.
_CODES = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM v, range(16) r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
"""
_ASSIGNED = """a{0} AS (SELECT vec_id, label, part, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m FROM p JOIN b{0} USING (part) GROUP BY ALL)"""
_REFINED = """,
s{0} AS (SELECT part, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT part, m.e AS e, x, unnest(range(1, len(x) + 1)) AS i FROM a{0}) GROUP BY ALL),
f{0} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{0} GROUP BY ALL),
b{1} AS (SELECT part, e, coalesce(f{0}.c, b{0}.c) AS c FROM b{0} LEFT JOIN f{0} USING (part, e)),
"""
SQL["op11_vector_codes"] = _CODES + _ASSIGNED.format(0) + _REFINED.format(0, 1) + _ASSIGNED.format(1) + _REFINED.format(1, 2) + _ASSIGNED.format(2) + """,
r AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for k, v in list(globals().items()) if k.startswith("op") and k[2].isdigit()}
