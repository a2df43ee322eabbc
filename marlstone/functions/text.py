"""Scalar text operators as Column functions: everything stays in the JVM and can be pushed and fused by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The content types that count as text, the labels of an asset's parts and of omitted things.
TEXT_TYPES = ("prose", "equation", "code", "list", "quote", "note", "figure")
ASSET_PARTS = (("章节", "section"), ("图题", "title"), ("图表编号", "ref_key"), ("图片描述", "description"), ("表格", "table_markdown"), ("正文引用", "related_text"), ("邻近正文", "near_text"))
IMAGE_LABEL, PATH_LABEL, KB_LABEL, DATA_LABEL = "[图片]", "[内部路径]", "[内部知识库]", "[image data omitted]"
CLIPPED, CLIPPED_ROWS = "\n…[检索摘要已截断]", "\n…[结构化内容已截断]"
#: A reference number: figure or table sign and up to four numbers.
REF = r"(图|表)\s*([0-9]{1,3}(?:\s*[-.]\s*[0-9]{1,3}){0,3})"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+\z", "")


def text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def clean_transport(c: Column) -> Column:
    """NUL to space, all line ends to LF, stripped."""
    return strip(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(" ")), r"\r\n?", "\n"))


def middle_ellipsis(c: Column, most: int = 100, mark: str = " ... ") -> Column:
    """Long texts keep both ends."""
    return F.when(F.length(c) < most + 2 * len(mark), c).otherwise(F.concat(F.left(c, F.lit(most // 2)), F.lit(mark), F.right(c, F.lit(-(-most // 2)))))


def clip(c: Column, limit: int, suffix: str = CLIPPED) -> Column:
    t = text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(rstrip(F.left(t, F.lit(limit))), F.lit(suffix)))


def clip_rows(c: Column, limit: int, suffix: str = CLIPPED_ROWS) -> Column:
    """Cut behind the last whole row if that is past half of the budget."""
    t = text(c)
    head = F.left(t, F.lit(limit + 1))
    at = F.length(head) - F.locate("\n", F.reverse(head))  # place of the last line end
    cut = F.when((F.locate("\n", head) > 0) & (at >= limit // 2), at).otherwise(F.lit(limit))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(rstrip(F.left(t, cut)), F.lit(suffix)))


def half_width(c: Column) -> Column:
    """Full-width forms U+FF01 to U+FF5E and the ideographic space to ASCII."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(c, wide, "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " ")


def compact_ref(c: Column) -> Column:
    """Half-width, one kind of dash and dot, no white space."""
    return F.regexp_replace(F.translate(half_width(c), "－–—．·", "---.."), r"\s+", "")


def ref_key(c: Column) -> Column:
    """The first figure or table number of a text, or empty."""
    t = F.translate(half_width(F.coalesce(c, F.lit(""))), "－–—．·", "---..")
    return F.concat(F.regexp_extract(t, REF, 1), F.regexp_replace(F.regexp_extract(t, REF, 2), r"\s+", ""))


def ref_candidates(c: Column) -> Column:
    """All distinct figure and table numbers as written, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(half_width(F.coalesce(c, F.lit(""))), F.lit(REF), F.lit(0)), strip))


def content_type(stored: Column, kind: Column, table_markdown: Column, body: Column) -> Column:
    """What is stored; else by kind; else table where the body has a table tag or a row of pipes; else prose."""
    own = F.lower(text(stored))
    return (
        F.when(own != "", own)
        .when(kind == "image", F.when(text(table_markdown) != "", "table").otherwise("image"))
        .when(F.coalesce(body, F.lit("")).rlike(r"(?i)<table\b") | F.coalesce(body, F.lit("")).rlike(r"(?m)^\s*\|?.+\|.+$"), "table")
        .otherwise("prose")
    )


def matches_evidence(wanted: list[str], kind: Column, type_: Column, table_markdown: Column) -> Column:
    """Row form of the evidence predicate over text, table and image."""
    if not wanted:
        return F.lit(True)
    image = F.lit("image" in wanted) | (F.lit("table" in wanted) & (type_ == "table") & (text(table_markdown) != ""))
    other = (F.lit("table" in wanted) & (type_ == "table")) | (F.lit("text" in wanted) & type_.isin(*TEXT_TYPES))
    return F.when(kind == "image", image).otherwise(other)


def evidence_filter(wanted: list[str]) -> Column:
    """The same over stored columns, in a form that Parquet can push."""
    kind, type_ = F.col("kind"), F.col("content_type")
    clauses = {"text": (kind == "text") & type_.isin(*TEXT_TYPES), "table": (type_ == "table") & ((kind == "text") | ((kind == "image") & (F.col("table_markdown") != ""))), "image": kind == "image"}
    found = [clauses[w] for w in ("text", "table", "image") if w in wanted]
    out = F.lit(not wanted)
    for f in found:
        out = out | f
    return out


def names_document(file_name: Column, title: Column, names: list[str]) -> Column:
    """Whether a document is named exactly, by base name, or by the end of its path; names without extension also
    stand for Markdown files."""
    tried: list[str] = []
    for n in (x.strip().replace("\\", "/") for x in names):
        if n:
            tried += [n] if "." in n.rsplit("/", 1)[-1].lstrip(".") else [n, n + ".md", n + ".markdown"]
    if not tried:
        return F.lit(True)
    out = F.lit(False)
    for c in (file_name, title):
        path = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))
        out = out | path.isin(*tried) | F.element_at(F.split(path, "/"), -1).isin(*tried)
        for n in tried:
            out = out | F.endswith(path, F.lit("/" + n))
    return out


def searchable(kind: Column, body: Column, caption: Column, description: Column, table_markdown: Column) -> Column:
    """Text rows: the body; images: their distinct parts that aren't empty."""
    parts = F.array_distinct(F.filter(F.transform(F.array(caption, description, table_markdown), text), lambda x: x != ""))
    return F.when(kind == "image", F.array_join(parts, "\n")).otherwise(F.coalesce(body, F.lit("")))


def owner(source_data_id: Column, data_id: Column) -> Column:
    """Id of the document that a record belongs to."""
    own = F.coalesce(F.nullif(source_data_id, F.lit("")), data_id)
    return F.split_part(own, F.lit("::image::"), F.lit(1))


def redact(c: Column) -> Column:
    """Absolute paths and names of knowledge bases give way to labels."""
    t = F.regexp_replace(public_text(c), r"(?:[A-Za-z]:[\\/]|/)[^\s,;]+", PATH_LABEL)
    return F.regexp_replace(t, r"(?i)\bkb-[a-z0-9_-]+\b", KB_LABEL)


def public_text(c: Column) -> Column:
    """Without generated context; images become their labels."""
    t = F.regexp_replace(text(c), r"(?m)^\s*章节路径：/[^\r\n]*\r?\n+", "")
    t = F.regexp_replace(t, r"!\[\s*\]\([^\r\n)]*(?:\)|$)", IMAGE_LABEL)
    t = F.regexp_replace(t, r"!\[\s*([^\]]*?)\s*\]\([^\r\n)]*(?:\)|$)", "[图片：$1]")
    return strip(F.regexp_replace(t, r"(?i)\S*?\.assets-[^\s()]*[\\/][^\s()]+\.(?:png|jpe?g|jp2|webp|gif|bmp|tiff?)(?:\?[^\s)]*)?\)?", IMAGE_LABEL))


def source_name(c: Column) -> Column:
    """Base name without a content prefix."""
    path = F.regexp_replace(F.replace(text(c), F.lit("\\"), F.lit("/")), "^/+", "")
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)^[0-9a-f]{12,16}-", "")


def section_name(c: Column) -> Column:
    """Last heading of a path of two or more."""
    parts = F.filter(F.transform(F.split(F.replace(text(c), F.lit("\\"), F.lit("/")), "/"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))


def safe_component(c: Column, limit: int = 48) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\\/:*?\"<>|]+", "_"), r"\A[ ._]+|[ ._]+\z", "")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(t, r"\s+", " "), F.lit(limit)), F.lit("")), F.lit("document"))


def rough_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 2))


def limiter_tokens(c: Column) -> Column:
    """Estimate for the rate limiter: a token for each Chinese character, a quarter for others, eight a text, 15 % more."""
    n = F.length(F.coalesce(c, F.lit("")))
    cjk = n - F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[㐀-鿿豈-﫿]", ""))
    whole = (cjk + (n - cjk) / F.lit(4.0) + F.lit(8.0)) * F.lit(1.15).cast("double") + F.lit(0.999).cast("double")
    return F.greatest(F.lit(1).cast("long"), F.floor(whole))


def visible(c: Column) -> Column:
    """A response without thinking, summaries and tool calls."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(?:thinking|summary)\b[^>]*>.*?</(?:thinking|summary)>", "")
    t = F.regexp_replace(t, r"(?is)<(?:tool_use|tool_call)>.*?</(?:tool_use|tool_call)>", "")
    return strip(F.regexp_replace(t, r"(?is)<function\s*=\s*[A-Za-z_][\w.-]*\s*>.*?(?:</function\s*>|\z)", ""))


def last_code_block(c: Column, kind: str) -> Column:
    """Body of the last fenced block of a kind, or null."""
    names = {"python": "python|py", "powershell": "powershell|ps1|pwsh", "bash": "bash|sh|shell"}.get(kind, kind)
    return strip(F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?s)```(?:{names})\n(.*?)\n```"), F.lit(1)), F.lit(-1)))


def stamp(c: Column) -> Column:
    """``2026-04-03 20:13:06`` to ``0403_2013``, null for anything else."""
    return F.date_format(F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd HH:mm:ss")), "MMdd_HHmm")


def retryable(status: Column) -> Column:
    return status.isin(408, 409, 425, 429) | (status >= 500)


def retry_base(attempt: Column, retry_after: Column) -> Column:
    """Seconds before a retry, jitter left out: doubling up to 30, at least what the server asks for."""
    return F.greatest(F.least(F.lit(30.0).cast("double"), F.pow(F.lit(2.0).cast("double"), F.greatest(F.lit(0), attempt - 1))), F.coalesce(retry_after, F.lit(0.0)).cast("double"))


def abbreviate(n: Column) -> Column:
    """1234 to 1.2k, 2500000 to 2.50M."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.2f", n / F.lit(1e6)), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / F.lit(1e3)), F.lit("k"))).otherwise(n.cast("string"))


def compact_lines(c: Column) -> Column:
    """Text form of a page: single spaces, no indentation, no runs of empty lines."""
    t = F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "(?m)^ +", "")
    return strip(F.regexp_replace(t, r"(\n\s*){3,}", "\n\n"))


def mask_data(c: Column) -> Column:
    """Data URLs of images, empty ones and those broken into lines too, give way to a label."""
    return F.regexp_replace(c, r"(?i)data:image/[a-z0-9.+-]+;base64,[a-z0-9+/=\r\n]*", DATA_LABEL)


def bound(c: Column, use) -> Column:
    """use(value of c), which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def snippet(c: Column, terms: list[str], width: int = 220) -> Column:
    """A window around the earliest hit of a term of two letters or more."""
    wanted = [t.lower() for t in terms if len(t) > 1]

    def earliest(low: Column) -> Column:
        return F.array_min(F.filter(F.array(*[F.locate(t, low) for t in wanted] or [F.lit(0)]), lambda p: p > 0)) - 1

    def around(flat: Column, at: Column) -> Column:
        start = F.greatest(F.lit(0), at - width // 3)
        end = F.least(F.length(flat), start + width)
        hit = F.concat(F.when(start > 0, "… ").otherwise(""), F.substring(flat, start + 1, end - start), F.when(end < F.length(flat), " …").otherwise(""))
        return F.when(at.isNotNull(), hit).when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width)), F.lit(" …"))).otherwise(flat)

    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return bound(flat, lambda f: bound(bound(F.lower(f), earliest), lambda at: around(f, at)))


def occurrences(c: Column, old: str) -> Column:
    """How often old stands in a text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / len(old)).cast("int")


def patch_unique(c: Column, old: str, new: str) -> Column:
    """The text with old replaced if it stands there exactly once, else null."""
    return F.when(occurrences(c, old) == 1, F.replace(c, F.lit(old), F.lit(new)))


def asset_body(columns: dict[str, Column]) -> Column:
    """Labelled parts of an image's record that aren't empty."""
    return strip(F.array_join(F.filter(F.array(*[F.when(columns[k] != "", F.concat(F.lit(f"{label}: "), columns[k])) for label, k in ASSET_PARTS if k in columns]), lambda x: x.isNotNull()), "\n"))


def history_lines(c: Column) -> Column:
    """Lines of a history block that begin with a speaker; escaped line ends are tried where fewer than two do."""

    def lines(t: Column) -> Column:
        return F.filter(F.transform(F.split(t, "\n"), strip), lambda x: F.startswith(x, F.lit("[USER]")) | F.startswith(x, F.lit("[Agent]")))

    plain, escaped = lines(c), lines(F.replace(c, F.lit("\\n"), F.lit("\n")))
    return F.when((F.size(plain) < 2) & (F.size(escaped) > 0), escaped).otherwise(plain)


def split_objects(c: Column) -> Column:
    """Concatenated JSON objects one by one; what can't be parsed comes back whole."""
    parts = F.split(c, r"(?<=\})(?=\{)")
    good = F.forall(parts, lambda p: F.try_parse_json(p).isNotNull())
    return F.when(F.coalesce(c, F.lit("")) == "", F.array(F.lit("{}"))).when(good, parts).otherwise(F.array(F.to_json(F.struct(c.alias("_raw")))))


def normal_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(text(c), F.lit("\\"), F.lit("/")), "^/+", "")


def trim_to_tokens(c: Column, most: int) -> Column:
    """A text cut to a budget of tokens, where half of the characters is the estimate: over the budget its length is
    scaled by budget over estimate, less 50, one character at least.  One cut always fits; a budget under one keeps none."""
    n = F.length(text(c))
    estimate = F.greatest(F.lit(1), F.floor(n / 2)).cast("double")
    if most < 1:
        return F.lit("")
    return F.when(estimate <= most, text(c)).otherwise(F.left(c, F.greatest(F.lit(1), F.floor(n * (F.lit(float(most)) / estimate)).cast("int") - 50)))


def path_score(path: Column, query: str) -> Column:
    """Fuzzy score of a path in lower case, null unless the query's letters stand in it in order (the first place each).

    A letter counts 1, 2 more right behind the one before and 3 more at the start of a word; 8 more if the whole query
    stands in the base name, else 4 if in the path.
    """
    q, p = query.lower(), F.lower(path)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"), F.lit(True).alias("found"))

    def step(now: Column, letter: Column) -> Column:
        at = F.call_function("locate", letter, p, now["at"] + 1)
        close = F.when((at == now["at"] + 1) & (now["at"] > 0), 2).otherwise(0)
        word = F.when((at == 1) | F.substring(p, at - 1, F.lit(1)).isin(*"/\\_-. "), 3).otherwise(0)
        hit = F.struct(at.alias("at"), (now["score"] + 1 + close + word).alias("score"), F.lit(True).alias("found"))
        return F.when(now["found"] & (at > 0), hit).otherwise(F.struct(now["at"].alias("at"), now["score"].alias("score"), F.lit(False).alias("found")))

    walked = F.aggregate(F.array(*[F.lit(x) for x in q]), start, step)
    whole = F.when(F.contains(F.element_at(F.split(p, "/"), -1), F.lit(q)), 8).when(F.contains(p, F.lit(q)), 4).otherwise(0)
    return F.when(walked["found"], walked["score"] + whole)
