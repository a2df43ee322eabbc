"""Queries of the chunking and HTML operators, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions import unicode as U
from marlstone.operators import chunking, html, maintenance, markup
from marlstone.plans.inputs import RECORDS, records, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _markdown(spark, d):
    """The documents with headings, a table, a list and a fence around their lines."""
    head = F.concat(F.lit("# Source "), "source", F.lit("\n\n## Document "), F.col("doc_id").cast("string"), F.lit("\n\n| id | lang |\n| --- | --- |\n| "), F.col("doc_id").cast("string"), F.lit(" | "), "lang", F.lit(" |\n\n- [x] read\n- [ ] keep "), "lang", F.lit("\n\n```py\nx = 1\n```\n\n"))
    return table(spark, d, "documents").select("doc_id", F.concat(head, "text").alias("text"))


@query("k1_chunks")
def k1(spark, d):
    return chunking.chunks(_markdown(spark, d))


@query("k2_sections", """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, source FROM documents), r AS (SELECT doc_id, source, unnest(range(0, len(ls))) AS i FROM l)
SELECT doc_id, i + 4 AS line_no, '/Source ' || source || '/Document ' || doc_id || '/' AS header_path FROM r""")
def k2(spark, d):
    """Texts whose own marks are defused, so that SQL knows the sections; k2_sections_whole has them as they are."""
    own = F.translate(F.coalesce("text", F.lit("")), "#`~$", "....")
    text = F.concat(F.lit("# Source "), "source", F.lit("\n\n## Document <b>"), F.col("doc_id").cast("string"), F.lit("</b> ##\n\n"), own, F.lit("|"))
    rows = chunking.sections(chunking.classified(chunking.lines(table(spark, d, "documents").select("doc_id", text.alias("text")))))
    return rows.where("line_no > 3").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "header_path")


@query("k2_sections_whole")
def k2_all(spark, d):
    """All lines of all documents; SQL can't say what their own headings, fences and formulas give."""
    text = F.concat(F.lit("# Source "), "source", F.lit("\n\n## Document <b>"), F.col("doc_id").cast("string"), F.lit("</b> ##\n\n"), F.coalesce("text", F.lit("")))
    rows = chunking.sections(chunking.classified(chunking.lines(table(spark, d, "documents").select("doc_id", text.alias("text")))))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "header_path")


@query("k10_html_tables")
def k10(spark, d):
    t = F.concat(F.lit("<table><tr><th rowspan=2>page</th><th colspan=2>url</th></tr><tr><th>a</th><th>b</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"), "url", F.lit("</td></tr></table>"), "html")
    return html.tables(table(spark, d, "pages").select("page_id", t.alias("html")))


@query("k11_markdown_rows", f"WITH {RECORDS} SELECT doc_id, chunk_index AS line_no, 'a|b' || '/' || trim(replace(replace(body, '|', ''), '\\', '')) AS cells FROM records")
def k11(spark, d):
    line = F.concat(F.lit("| a\\|b | "), F.replace(F.replace("body", F.lit("|"), F.lit("")), F.lit("\\"), F.lit("")), F.lit(" |"))
    return html.markdown_rows(records(spark, d).select("doc_id", F.col("chunk_index").alias("line_no"), line.alias("line"))).withColumn("cells", F.array_join("cells", "/"))


_ENTITIES = "{}"
for _name, _char in html.ENTITIES:
    _ENTITIES = "replace(" + _ENTITIES + f", '{_name}', " + ("chr(34))" if _char == '"' else "'" + _char.replace("'", "''") + "')")


@query("k16_plain_text", """WITH t AS (SELECT page_id, """ + _ENTITIES.format("""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g'), '(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/table)\\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')""") + """ AS t FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g') AS plain FROM t""")
def k16(spark, d):
    return table(spark, d, "pages").select("page_id", html.plain_text(F.col("html")).alias("plain"))


@query("k16_list_markdown", """WITH t AS (SELECT page_id, """ + _ENTITIES.format("coalesce(url, '')") + """ AS url, """ + _ENTITIES.format("replace(coalesce(html, ''), '<', '(')") + """ AS html FROM pages),
c AS (SELECT page_id, ltrim(regexp_replace(url, '\\s+', ' ', 'g'), ' ') AS url, ltrim(regexp_replace(html, '\\s+', ' ', 'g'), ' ') AS html FROM t)
SELECT page_id, rtrim('- page ' || page_id || ' ' || chr(10) || '  1. ' || url || chr(10) || '  2. ' || html || chr(10) || '    - within' || chr(10) || '- last', ' ') AS markdown FROM c""")
def k16_lists(spark, d):
    """Pages' addresses and sources, their own tags defused, as items; k16_list_markdown_whole has pages as they are."""
    own = F.replace(F.coalesce("html", F.lit("")), F.lit("<"), F.lit("("))
    html_ = F.concat(F.lit("none<ul><li>page "), F.col("page_id").cast("string"), F.lit("<ol>\n<li>"), F.coalesce("url", F.lit("")), F.lit("</li><li>"), own, F.lit("<ul><li>within</ul></li></ol></li>\n<li> last</ul> none"))
    return markup.list_markdown(markup.nodes(table(spark, d, "pages").select("page_id", html_.alias("html"))))


@query("k16_list_markdown_whole")
def k16_lists_whole(spark, d):
    return markup.list_markdown(markup.nodes(table(spark, d, "pages")))


@query("k19_checklist", "SELECT doc_id, unnest(['read', 'keep ' || coalesce(lang, '')]) AS content, unnest([true, false]) AS done, unnest([0, 1]) AS pos FROM documents")
def k19(spark, d):
    """Texts whose own brackets are defused, so that SQL knows the list; k19_checklist_whole has them as they are."""
    own = F.replace(F.coalesce("text", F.lit("")), F.lit("["), F.lit("("))
    text = F.concat(F.lit("- [x] read\n- [ ] keep "), F.coalesce("lang", F.lit("")), F.lit("\n\n"), own)
    return chunking.checklist(table(spark, d, "documents").select("doc_id", text.alias("text")))


@query("k19_checklist_whole")
def k19_all(spark, d):
    docs = table(spark, d, "documents")
    text = F.concat(F.lit("- [x] read\n- [ ] keep "), F.coalesce("lang", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return chunking.checklist(docs.select("doc_id", text.alias("text")))


@query("x5_label", "SELECT page_id, 'a & b ' || page_id AS label FROM pages")
def x5(spark, d):
    return table(spark, d, "pages").select("page_id", U.label(F.concat(F.lit(" **a &amp;  <b>b</b> "), F.col("page_id").cast("string"), F.lit("** "))).alias("label"))


@query("x9_trim_to_tokens", """WITH n AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, CASE WHEN greatest(1, n // 2) <= 500 THEN t ELSE left(t, greatest(1, CAST(floor(n * (CAST(500 AS DOUBLE) / CAST(n // 2 AS DOUBLE))) AS BIGINT) - 50)) END AS trimmed FROM n""")
def x9(spark, d):
    return table(spark, d, "documents").select("doc_id", T.trim_to_tokens(F.col("text"), 500).alias("trimmed"))


@query("x20_simplify_html")
def x20(spark, d):
    return table(spark, d, "pages").select("page_id", html.simplify(F.col("html")).alias("html"))


@query("x22_changed_elements", """WITH m AS (SELECT page_id, html AS b, replace(html, '</article>', '<p class="new">added</p></article>') AS a FROM pages)
SELECT page_id, 'p:class="new":added' AS signature, CAST(1 AS BIGINT) AS more FROM m WHERE contains(b, '</article>')""")
def x22(spark, d):
    p = table(spark, d, "pages").select("page_id", "html")
    return html.changed_elements(p, p.withColumn("html", F.replace("html", F.lit("</article>"), F.lit('<p class="new">added</p></article>'))))


@query("x25_sample_lists", """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<(?:ul|ol)\\b[^>]*>(.*?)</(?:ul|ol)>', 1) AS ls FROM pages), u AS (SELECT page_id, unnest(range(0, len(ls))) AS list_no, unnest(ls) AS body FROM l),
i AS (SELECT page_id, list_no, regexp_extract_all(body, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS items FROM u)
SELECT page_id, CAST(list_no AS INTEGER) AS list_no, CAST(len(items) AS INTEGER) AS n, CAST(unnest(range(0, least(3, len(items)))) AS INTEGER) AS pos, unnest(items[:3]) AS item FROM i WHERE len(items) >= 5""")
def x25(spark, d):
    return html.sample_lists(table(spark, d, "pages"))


@query("x22_page_changes")
def x22_pages(spark, d):
    """Pages with a paragraph added, others with an attribute that doesn't count, an item renamed, or nothing changed."""
    p = table(spark, d, "pages").select("page_id", "html")
    more = F.replace("html", F.lit("</article>"), F.lit('<p class="new">added</p><p>and <b>more</b></p></article>'))
    tracked = F.replace("html", F.lit("<h1>"), F.lit('<h1 data-track-id="7">'))
    renamed = F.regexp_replace("html", "<li>(.*?)</li>", "<li>$1</li >")
    kind = F.col("page_id") % 4
    return markup.page_changes(p, p.withColumn("html", F.when(kind == 0, more).when(kind == 1, tracked).when(kind == 2, renamed).otherwise(F.col("html"))))


@query("x23_truncated_pages")
def x23(spark, d):
    return markup.truncate(table(spark, d, "pages").select("page_id", "html"), 2500)


@query("x24_repeated_siblings")
def x24(spark, d):
    return markup.repeated(markup.nodes(table(spark, d, "pages").select("page_id", "html")))


@query("x25_sampled_pages")
def x25_pages(spark, d):
    """The best group of like siblings of each element is a list; its long ones are cut to those that name "the"."""
    pages = table(spark, d, "pages").select("page_id", "html")
    tree = markup.nodes(pages)
    return markup.sample_items(pages, tree, markup.members(tree, markup.repeated(tree, limit=1)), instruction="the")


@query("a20_line_delta", """WITH v AS (SELECT doc_id, coalesce(text, '') AS old, 'new' || chr(10) || regexp_replace(coalesce(text, ''), '\\n[^\\n]*$', '') AS new FROM documents),
l AS (SELECT doc_id, unnest(string_split(regexp_replace(old, '\\n$', ''), chr(10))) AS line, -1 AS n FROM v WHERE old <> '' UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(new, '\\n$', ''), chr(10))), 1 FROM v),
e AS (SELECT doc_id, line, sum(n) AS n FROM l GROUP BY 1, 2)
SELECT doc_id, CAST(sum(greatest(n, 0)) AS BIGINT) AS added, CAST(sum(greatest(-n, 0)) AS BIGINT) AS removed FROM e GROUP BY 1""")
def a20(spark, d):
    text = F.coalesce("text", F.lit(""))
    return maintenance.line_delta(table(spark, d, "documents").select("doc_id", text.alias("old"), F.concat(F.lit("new\n"), F.regexp_replace(text, r"\n[^\n]*$", "")).alias("new")))


@query("a20_moved_lines", """WITH v AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\n$', ''), chr(10)) AS ls FROM documents)
SELECT doc_id, CAST(CASE WHEN len(list_distinct(ls)) > 1 THEN 1 ELSE 0 END AS INTEGER) AS added, CAST(CASE WHEN len(list_distinct(ls)) > 1 THEN 1 ELSE 0 END AS INTEGER) AS removed FROM v""")
def a20_moved(spark, d):
    """The last line of every document comes first: it is removed and added, unless all lines are the same."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\z", "")
    ls = F.split(text, "\n", -1)
    moved = F.array_join(F.concat(F.slice(ls, F.size(ls), 1), F.slice(ls, 1, F.size(ls) - 1)), "\n")
    return maintenance.line_delta(table(spark, d, "documents").select("doc_id", text.alias("old"), moved.alias("new")))
