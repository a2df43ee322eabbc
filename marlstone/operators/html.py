"""HTML reduction and comparison over page tables, in SQL functions; only nested tables need a parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T

# Attributes that a reduced page keeps, entities that plain text resolves.
KEPT = (
    "id", "class", "name", "src", "href", "alt", "value", "type", "placeholder", "disabled", "checked", "selected", "readonly", "required", "multiple",
    "role", "aria-label", "aria-expanded", "aria-hidden", "contenteditable", "title", "for", "action", "method", "target", "colspan", "rowspan",
)
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Text of a page: no scripts, styles or comments; blocks on lines of their own; common entities resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/table)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return T.strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))


#: A page's pieces: elements whose content isn't markup, comments, start tags, anything else.
_PIECES = r"""(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|<svg\b.*?</svg\s*>|<[a-z][^\s<>/]*(?:"[^"]*"|'[^']*'|[^"'<>])*>|[^<]+|<"""
_OUTSIDE = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'  # not inside a quoted value


def simplify(html: Column, long: int = 30, data: int = 20, most: int = 100, cut: int = 50) -> Column:
    """Fewer tokens: svg elements are emptied; of start tags style and unknown attributes go, and generated data-v ones;
    inline images, long addresses and long data become placeholders; long values, titles and alternative texts are cut."""

    def attribute(t: Column, name: str, value: str, to: str) -> Column:
        return F.regexp_replace(t, rf'(?i)(\s(?:{name})=")({value})"', to)

    def tag(t: Column) -> Column:
        t = F.regexp_replace(t, rf"""(?i)\s+(?!(?:{"|".join(KEPT)})[\s=/>]|data-(?!v))[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?""" + _OUTSIDE, "")
        t = F.regexp_replace(t, r"""(\s[^\s"'<>/=]+)\s*=\s*'([^'"]*)'""" + _OUTSIDE, '$1="$2"')
        t = F.regexp_replace(t, r"""(\s[^\s"'<>/=]+)\s*=\s*([^\s"'<>=]+)(?=[\s>])""" + _OUTSIDE, '$1="$2"')
        t = attribute(t, "src", "data:[^\"]*", '$1__img__"')
        t = attribute(t, "src|action", rf"[^\"]{{{long + 1},}}", '$1__url__"')
        t = attribute(t, "href", rf"[^\"]{{{long + 1},}}", '$1__link__"')
        t = attribute(t, r"data-[^\s=]+", rf"[^\"]{{{data + 1},}}", '$1__data__"')
        return F.regexp_replace(t, rf'(?i)(\s(?:value|title|alt)="[^"]{{{cut}}})[^"]{{{most - cut + 1},}}"', '$1 ..."')

    def piece(x: Column) -> Column:
        return F.when(x.rlike(r"(?is)^<svg\b"), F.lit("<svg></svg>")).when(x.rlike(r"(?i)^<(?:script|style)\b"), x).when(x.rlike(r"(?i)^<[a-z]"), tag(x)).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_PIECES), F.lit(0)), piece), "")


def elements(pages: DataFrame) -> DataFrame:
    """page_id and signature (tag, attributes, direct text) of every element that opens."""
    m = r"<([a-zA-Z][\w-]*)((?:\s[^<>]*)?)>([^<]*)"
    found = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(m), F.lit(i)).alias(n) for i, n in ((1, "tag"), (2, "attrs"), (3, "text"))])
    e = pages.select("page_id", F.explode(found).alias("e"))
    return e.select("page_id", F.concat_ws(":", F.lower("e.tag"), F.trim("e.attrs"), F.trim("e.text")).alias("signature"))


def changed_elements(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signatures that a page has more of than before, and how many more, by one aggregation of both sides."""
    both = elements(after).withColumn("n", F.lit(1)).unionByName(elements(before).withColumn("n", F.lit(-1)))
    return both.groupBy("page_id", "signature").agg(F.sum("n").alias("more")).where("more > 0")


def sample_lists(pages: DataFrame, least: int = 5, keep: int = 3) -> DataFrame:
    """Items of long lists, the first few of each: page_id, list_no, pos, item, n."""
    lists = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:ul|ol)\b[^>]*>(.*?)</(?:ul|ol)>"), F.lit(1))).alias("list_no", "body"))
    items = lists.withColumn("items", F.regexp_extract_all("body", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))).withColumn("n", F.size("items")).where(F.col("n") >= least)
    return items.select("page_id", "list_no", "n", F.posexplode(F.slice("items", 1, keep)).alias("pos", "item"))


class _Tables(HTMLParser):
    """Cells of the outer tables of a page with their spans."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple]]] = []
        self.depth = 0
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            span = [max(1, min(1000, int(a[k]))) if (a.get(k) or "").isdigit() else 1 for k in ("rowspan", "colspan")]
            self.cell = [[], *span, tag == "th"]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        if tag in ("td", "th", "tr") and self.depth == 1:
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None and self.depth == 1:
            self.cell[0].append(data)


def grid(rows: list[list]) -> list[list[tuple[str, bool]]]:
    """Cells repeated over their spans, all rows of one width."""
    taken: dict[tuple[int, int], tuple[str, bool]] = {}
    for y, cells in enumerate(rows):
        x = 0
        for parts, down, across, head in cells:
            while (y, x) in taken:
                x += 1
            value = (" ".join("".join(parts).split()), head)
            taken.update(((y + i, x + j), value) for i in range(down) for j in range(across))
            x += across
    width = 1 + max((x for _, x in taken), default=-1)
    return [[taken.get((y, x), ("", False)) for x in range(width)] for y in range(len(rows))]


def relation(rows: list[list]) -> tuple[list[str], list[list[str]]]:
    """Header, leading header rows merged in each column, and rows; without header cells the first row is the header."""
    cells = grid(rows)
    heads = next((i for i, r in enumerate(cells) if not any(h for _, h in r)), len(cells)) or 1
    names = [" / ".join(dict.fromkeys(r[x][0] for r in cells[:heads] if r[x][0])) for x in range(len(cells[0]) if cells else 0)]
    return names, [[c for c, _ in r] for r in cells[heads:]]


def tables(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row_no, header, cells of every outer table's rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
                p = _Tables()
                p.feed(html or "")
                for i, t in enumerate(p.tables):
                    names, rows = relation(t)
                    out += [(page, i, j, names, r) for j, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["page_id", "table_no", "row_no", "header", "cells"])

    return pages.where(F.col("html").rlike("(?i)<table")).select("page_id", "html").mapInPandas(run, "page_id long, table_no int, row_no int, header array<string>, cells array<string>")


def markdown_rows(texts: DataFrame) -> DataFrame:
    """Cells of the rows of pipe tables, cut at pipes that aren't escaped."""
    row = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    return texts.where(F.contains("line", F.lit("|"))).select("doc_id", "line_no", F.transform(F.split(row, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|")))).alias("cells"))
