"""Pages as tables of nodes: every element, text and comment with the interval of the source that it takes.

Whatever a page's tree is asked then is a join or a window over intervals: children, repeated siblings, changed elements,
budgets from the root down.  Edits are intervals too, and all edits of a page are applied to its source at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.html import ENTITIES
from marlstone.session import checkpointed

#: Elements that have no content.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
HINT = "[FAKE ELEMENT]"
_NAME = re.compile(r"[^\s<>/\"']+")

#: Elements whose content isn't markup, comments, declarations, end tags, start tags, text, a stray sign.
_PIECES = (
    r"""(?is)<(?:script|style)\b[^>]*+>.*?(?:</(?:script|style)\s*+>|\z)|<!--.*?(?:-->|\z)|<[!?][^>]*+>?|</[a-z][^>]*+>|"""
    r"""<[a-z][^\s<>/"']*+(?:"[^"]*+"|'[^']*+'|[^"'<>]++)*+>|[^<]++|<"""
)
_NODE = "page_id long, begin int, inner int, inner_end int, end int, depth int, parent int, kind string, name string, attrs string, text string"


def _nest(pieces: list[str]) -> Iterator[tuple]:
    """Nodes of a page's pieces.  An end tag closes the nearest open element of its name and all within; without one it
    is ignored; what is open at the end ends there."""
    at, open_, names = 0, [], {}

    def close(inner_end: int, end: int) -> tuple:
        begin, inner, parent, name, attrs = open_.pop()
        names[name] -= 1
        return begin, inner, inner_end, end, len(open_), parent, "element", name, attrs, None

    for piece in pieces:
        begin, at = at, at + len(piece)
        parent = open_[-1][0] if open_ else -1
        if piece.startswith("</") and len(piece) > 2:
            name = _NAME.match(piece, 2)[0].lower()
            if names.get(name):
                while open_[-1][3] != name:
                    yield close(begin, begin)
                yield close(begin, at)
        elif piece.startswith("<!--"):
            yield begin, begin, at, at, len(open_), parent, "comment", None, None, piece.removeprefix("<!--").removesuffix("-->")
        elif piece[:1] == "<" and piece[1:2] in "!?":
            if piece == "<":
                yield begin, begin, at, at, len(open_), parent, "text", None, None, piece
        elif piece[:1] == "<":
            tag = piece[: piece.index(">") + 1] if piece[:7].lower().startswith(("<script", "<style")) else piece
            body = tag[1:-1].removesuffix("/")
            name = _NAME.match(body)[0].lower()
            attrs = body[len(name) :].strip()
            inner = begin + len(tag)
            if len(tag) < len(piece):  # its content is text
                cut = piece.rfind("</")
                end = begin + cut if cut >= len(tag) else at
                yield begin, inner, end, at, len(open_), parent, "element", name, attrs, None
                if end > inner:
                    yield inner, inner, end, end, len(open_) + 1, begin, "text", None, None, piece[len(tag) : end - begin]
            elif name in VOID or tag.endswith("/>"):
                yield begin, inner, inner, at, len(open_), parent, "element", name, attrs, None
            else:
                open_.append((begin, inner, parent, name, attrs))
                names[name] = names.get(name, 0) + 1
        else:
            yield begin, begin, at, at, len(open_), parent, "text", None, None, piece
    while open_:
        yield close(at, at)


def nodes(pages: DataFrame) -> DataFrame:
    """page_id; begin, end: the node's characters in html; inner, inner_end: those of its content; depth; parent: where
    its parent begins (-1: none); kind (element, text, comment), name, attrs (source), text.

    SQL cuts pages into pieces; nesting is a fold with a stack of open elements, page by page where the page is, so
    nothing is shuffled.  Null pages have no nodes.  page_id has to be unique.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _NODE.split(", ")]
        for b in batches:
            rows = []
            for page, pieces in zip(b["page_id"], b["pieces"], strict=True):
                for node in _nest(pieces.as_py() or []):
                    rows.append((page.as_py(), *node))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays(_columns(rows), names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(_columns(rows), names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_extract_all("html", F.lit(_PIECES), F.lit(0)).alias("pieces")).mapInArrow(run, _NODE)


_TYPES = [pa.int64(), *[pa.int32()] * 6, *[pa.string()] * 4]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]


def _cut(html: Column, begin: Column, end: Column) -> Column:
    return F.substring(html, begin + 1, end - begin)


# Edits


def edited(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages with edits (page_id, begin, end, put) applied: characters from begin to end become put.

    An edit that begins inside another one is dropped with what it is in; at one place insertions come first.
    """
    order = Window.partitionBy("page_id").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = edits.withColumn("_upto", F.coalesce(before, F.lit(0))).where(F.col("begin") >= F.col("_upto"))
    per_page = outer.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "put"))).alias("_cuts"))  # no more than a page's nodes
    p = pages.join(per_page, "page_id", "left")
    kept = F.transform("_cuts", lambda c, i: F.concat(_cut(F.col("html"), F.when(i > 0, F.get("_cuts", i - 1)["end"]).otherwise(0), c["begin"]), c["put"]))
    rest = F.substring(F.col("html"), F.element_at("_cuts", -1)["end"] + 1, F.length("html"))
    return p.withColumn("html", F.when(F.col("_cuts").isNull(), F.col("html")).otherwise(F.concat(F.array_join(kept, ""), rest))).select(*pages.columns)


# Changed elements


def signatures(tree: DataFrame) -> DataFrame:
    """Elements of a node table with signature: name, attributes but data-track-id, direct text and comments, each trimmed."""
    own = tree.where("kind <> 'element' and parent >= 0").select("page_id", F.col("parent").alias("begin"), F.struct("begin", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t")).alias("t"))
    texts = own.groupBy("page_id", "begin").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["t"]), "").alias("own"))
    attrs = F.trim(F.regexp_replace("attrs", r"""(?i)(?:^|\s+)data-track-id(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|$)""", ""))
    return tree.where("kind = 'element'").join(texts, ["page_id", "begin"], "left").select("page_id", "begin", "end", "parent", F.concat_ws(":", "name", attrs, F.coalesce("own", F.lit(""))).alias("signature"))


def page_changes(before: DataFrame, after: DataFrame, longest: int = 2000) -> DataFrame:
    """page_id, changed (elements of the page after that it has more of than before) and top_change, the source of the
    largest of them whose parent hasn't changed, cut at longest characters.

    Of several equal elements the first are the changed ones.  If no signature has become more frequent though the
    sources differ, elements are compared by their places.  Pages of either side alone have no row.  Sums and numbers
    are by page and signature, so no task has more than a page of one key.
    """
    both = before.select("page_id", F.col("html").alias("_old")).join(after.select("page_id", "html"), "page_id")
    # equal sources have no changes; the elements of the others are written once, as are the changed ones
    unequal = both.where(~F.col("html").eqNullSafe(F.col("_old")))
    old = checkpointed(signatures(nodes(unequal.select("page_id", F.col("_old").alias("html")))))
    new = checkpointed(signatures(nodes(unequal.select("page_id", "html"))))
    group, place = Window.partitionBy("page_id", "signature"), Window.partitionBy("page_id").orderBy("begin")
    counted = old.groupBy("page_id", "signature").agg(F.count("*").alias("had"))
    numbered = new.withColumn("n", F.count("*").over(group)).withColumn("i", F.row_number().over(group.orderBy("begin"))).withColumn("first", F.min("begin").over(group))
    more = numbered.join(counted, ["page_id", "signature"], "left").where(F.col("i") <= F.col("n") - F.coalesce("had", F.lit(0)))
    more = more.select("page_id", "begin", "end", "parent", "first")
    quiet = unequal.select("page_id").join(more.select("page_id").distinct(), "page_id", "left_anti")
    was = old.join(quiet, "page_id", "left_semi").select("page_id", F.row_number().over(place).alias("i"), F.col("signature").alias("was"))
    now = new.join(quiet, "page_id", "left_semi").withColumn("i", F.row_number().over(place))
    moved = now.join(was, ["page_id", "i"]).where("signature <> was").select("page_id", "begin", "end", "parent", F.col("begin").alias("first"))
    changed = checkpointed(more.unionByName(moved))
    inner = changed.select("page_id", F.col("begin").alias("parent"))
    size = F.col("end") - F.col("begin")
    tops = changed.join(inner, ["page_id", "parent"], "left_anti").groupBy("page_id").agg(F.max(F.struct(size, -F.col("first"), -F.col("begin"), "end")).alias("top"))
    sums = changed.groupBy("page_id").agg(F.count("*").alias("changed"))
    source = F.substring(F.col("html"), 1 - F.col("top.col3"), F.col("top.end") + F.col("top.col3"))
    cut = F.when(F.length(source) > longest, F.concat(F.left(source, F.lit(longest)), F.lit("...[TRUNCATED]"))).otherwise(source)
    out = both.join(sums, "page_id", "left").join(tops, "page_id", "left")
    return out.select("page_id", F.coalesce("changed", F.lit(0)).alias("changed"), cut.alias("top_change"))


# Repeated siblings


def _children(tree: DataFrame) -> DataFrame:
    """page_id, parent, begin, end, name, classes of the elements that have a parent and aren't in an svg element."""
    order = Window.partitionBy("page_id").orderBy("begin")
    drawn = F.max(F.when(F.col("name") == "svg", F.col("end"))).over(order)
    elements = tree.where("kind = 'element'").withColumn("drawn", F.coalesce(drawn >= F.col("end"), F.lit(False)))
    value = F.regexp_extract("attrs", r"""(?i)(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    words = F.array_distinct(F.filter(F.split(F.translate(value, "\"'", ""), r"\s+"), lambda w: w != ""))
    return elements.where("parent >= 0 and not drawn").select("page_id", "parent", "begin", "end", "name", words.alias("classes"))


def repeated(tree: DataFrame, limit: int = 3, share: float = 0.2) -> DataFrame:
    """The best groups of like children of every element: page_id, parent, rank, selector, n, total, score.

    Groups are children of one tag (not td; div counts only with a class), of one class, of a frequent tag with a
    frequent class, and of two frequent classes; they have three children at least and a share of all.  The score is
    half coverage, half how specific the selector is; a tag alone gets half a point less.  Elements inside svg are left
    out.  Ties go by kind of group, then by first appearance.
    """
    kids = _children(tree)
    key = ["page_id", "parent"]
    totals = kids.groupBy(*key).agg(F.count("*").alias("total")).where("total >= 3").withColumn("least", F.greatest(F.lit(3), F.floor(F.col("total") * share)))
    kids = kids.join(totals, key)
    own = kids.where("name <> 'td'")

    def counted(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*key, "total", "least", *by).agg(F.count("*").alias("n"), F.min("begin").alias("first")).where("n >= least")

    tags = counted(own, "name")
    by_class = own.select("*", F.posexplode("classes").alias("place", "class"))
    classes = by_class.groupBy(*key, "total", "least", "class").agg(F.count("*").alias("n"), F.min(F.struct("begin", "place")).alias("first")).where("n >= least")
    # at most three tags (the first) and three classes (the most frequent) are combined
    top_tags = tags.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("first"))).where("k <= 3").select(*key, "name", F.col("k").alias("kt"))
    top_classes = classes.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first"))).where("k <= 3").select(*key, "class", F.col("k").alias("kc"))
    frequent = kids.select("*", F.explode("classes").alias("class")).join(top_classes, [*key, "class"])
    with_tag = counted(frequent.withColumnRenamed("name", "tag").join(top_tags.withColumnRenamed("name", "tag"), [*key, "tag"]), "tag", "class", "kt", "kc")
    pairs = frequent.select(*key, "total", "least", "begin", F.col("class").alias("a"), F.col("kc").alias("ka")).join(frequent.select(*key, "begin", F.col("class").alias("b"), F.col("kc").alias("kb")), [*key, "begin"]).where("ka < kb")
    pairs = counted(pairs, "a", "b", "ka", "kb")
    dots = lambda s: F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))

    def scored(groups: DataFrame, kind: int, selector: Column, specific, order: Column, less: float = 0.0) -> DataFrame:
        g = groups.withColumn("selector", selector)
        score = F.col("n") / F.col("total") * 0.5 + specific(dots(F.col("selector"))) * 0.5 - less
        return g.select(*key, "selector", "n", "total", score.alias("score"), F.lit(kind).alias("kind"), order.alias("at"))

    at = lambda *c: F.array(*[F.col(x).cast("int") for x in c])
    every = [
        scored(tags.where("name <> 'div'"), 0, F.col("name"), lambda d: F.lit(0.3), at("first"), 0.5),
        scored(classes, 1, F.concat(F.lit("."), "class"), lambda d: 0.6 + (d - 1) * 0.1, at("first.begin", "first.place")),
        scored(with_tag, 2, F.concat("tag", F.lit("."), "class"), lambda d: 0.7 + d * 0.1, at("kt", "kc")),
        scored(pairs, 3, F.concat(F.lit("."), "a", F.lit("."), "b"), lambda d: 0.6 + (d - 1) * 0.1, at("ka", "kb")),
    ]
    groups = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).withColumn("score", F.round("score", 9))
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "kind", "at")
    return groups.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(*key, "rank", "selector", "n", "total", "score")


def members(tree: DataFrame, groups: DataFrame) -> DataFrame:
    """page_id, parent, selector, begin of the children that each group (page_id, parent, selector) has."""
    names = F.split("selector", r"\.")
    tag, classes = F.get(names, 0), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))
    found = _children(tree).join(groups.select("page_id", "parent", "selector"), ["page_id", "parent"])
    return found.where(((tag == "") | (tag == F.col("name"))) & (F.size(F.array_except(classes, "classes")) == 0)).select("page_id", "parent", "selector", "begin")


# Lists


def sample_items(pages: DataFrame, tree: DataFrame, items: DataFrame, instruction: str = "", least: int = 5, keep: int = 3, hits: int = 6) -> DataFrame:
    """Pages whose long lists are cut to a few items, with a hint in place of the others.

    items: page_id, selector and begin of each list's items.  Lists of fewer than least items stay, and so do short
    ones (items under 200 characters on average, or under 700 with under 2500 in all).  If items have the instruction
    in their text, the first hits of those are kept, else the first keep items.  The hint says how many are hidden and
    how five of them begin.  A list inside a hidden item goes with it.
    """
    rows = items.select("page_id", "selector", "begin").join(tree.where("kind = 'element'").select("page_id", "begin", "end"), ["page_id", "begin"])
    rows = rows.join(pages.select("page_id", "html"), "page_id")
    pieces = F.filter(F.regexp_extract_all(_cut(F.col("html"), F.col("begin"), F.col("end")), F.lit(_PIECES), F.lit(0)), lambda x: ~x.startswith("<"))
    words = F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = rows.withColumn("text", F.array_join(words, " ")).drop("html")
    whole = Window.partitionBy("page_id", "selector")
    size = F.col("end") - F.col("begin")
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("all", F.sum(size).over(whole))
    mean = F.col("all") / F.col("n")
    rows = rows.where((F.col("n") >= least) & ~((mean < 200) | ((mean < 700) & (F.col("all") < 2500))))
    hit = F.contains("text", F.lit(instruction)) if instruction.strip() else F.lit(False)
    rows = rows.withColumn("hit", hit).withColumn("found", F.max("hit").over(whole))
    wanted = F.row_number().over(Window.partitionBy("page_id", "selector", F.col("hit")).orderBy("begin"))
    rows = rows.withColumn("i", wanted).withColumn("kept", F.when(F.col("found"), F.col("hit") & (F.col("i") <= hits)).otherwise(F.col("i") <= keep))
    hidden = F.sort_array(F.collect_list(F.when(~F.col("kept"), F.struct("begin", F.left("text", F.lit(40)).alias("t")))))
    per_list = rows.groupBy("page_id", "selector").agg(F.max(F.when(F.col("kept"), F.col("end"))).alias("at"), F.count_if(~F.col("kept")).alias("gone"), hidden.alias("hidden"))
    shown = F.filter(F.transform(F.slice("hidden", 1, 5), lambda x: x["t"]), lambda t: t != "")
    named = F.when(F.size(shown) > 0, F.concat(F.lit(" Hidden items: "), F.array_join(F.transform(shown, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ","))).otherwise("")
    hint = F.concat(F.lit(f"<div>{HINT} "), F.col("gone").cast("string"), F.lit(' more items hidden, selector: "'), "selector", F.lit('"'), named, F.lit("</div>"))
    hints = per_list.select("page_id", F.col("at").alias("begin"), F.col("at").alias("end"), hint.alias("put"))
    gone = rows.where(~F.col("kept")).select("page_id", "begin", "end", F.lit("").alias("put")).distinct()
    return edited(pages, hints.unionByName(gone))


# Budgets


def truncate(pages: DataFrame, budget: int, deep: int = 8000) -> DataFrame:
    """Pages cut to about budget characters, level by level from the root.

    A node over its budget with one child hands what it has left to it.  If the three largest children can bear what is
    too much, they do in proportion (those under a tenth of the largest are spared if the others can); a child that
    keeps more than deep characters is cut further down, another one loses the end of its content to a marker, or goes
    if it keeps nothing.  Else children go from the end.  Hints of hidden items stay.  Text of a node's own isn't cut,
    so a page without elements to cut stays over its budget.

    Each level is one job over the nodes that are still too long; a page has at most one row for each of them.
    """
    tree = nodes(pages).where("kind = 'element'").withColumn("size", F.col("end") - F.col("begin"))
    source = pages.select("page_id", "html")
    tree = tree.join(source, "page_id").withColumn("hint", F.when(_cut(F.col("html"), F.col("inner"), F.col("inner") + len(HINT)) == HINT, _cut(F.col("html"), F.col("begin"), F.col("end"))))
    tree = checkpointed(tree.drop("html", "attrs", "text"))
    level = source.where(F.length("html") > budget).select("page_id", F.lit(-1).alias("begin"), F.length("html").alias("size"), F.lit(budget).cast("long").alias("keep"))
    edits = None
    key = ["page_id", "parent"]
    while True:
        kids = tree.where("hint is null").join(level.select("page_id", F.col("begin").alias("parent"), F.col("size").alias("whole"), "keep"), key)
        every = Window.partitionBy(*key)
        kids = kids.withColumn("n", F.count("*").over(every)).withColumn("sum", F.sum("size").over(every))
        left = F.greatest(F.col("keep") - (F.col("whole") - F.col("sum")), F.lit(0))
        kids = kids.withColumn("left", left).withColumn("over", F.col("sum") - F.col("left"))
        kids = kids.withColumn("r", F.row_number().over(every.orderBy(F.desc("size"), "begin"))).withColumn("largest", F.max("size").over(every))
        wide = (F.col("r") <= 3) & (F.col("size") * 10 >= F.col("largest"))
        kids = kids.withColumn("three", F.sum(F.when(F.col("r") <= 3, F.col("size"))).over(every)).withColumn("few", F.sum(F.when(wide, F.col("size"))).over(every))
        behind = F.sum("size").over(every.orderBy(F.desc("begin")).rowsBetween(Window.unboundedPreceding, -1))
        kids = kids.withColumn("behind", F.coalesce(behind, F.lit(0)))
        bears = F.when(F.col("few") >= F.col("over"), wide).otherwise(F.col("r") <= 3)
        of = F.when(F.col("few") >= F.col("over"), F.col("few")).otherwise(F.col("three"))
        share = F.expr("over * size") / of
        tail = F.col("three") < F.col("over")
        new = F.when(F.col("n") == 1, F.col("left")).when((F.col("over") <= 0) | (~tail & ~bears), None).when(tail, F.when(F.col("behind") < F.col("over"), F.lit(0))).otherwise(F.col("size") - F.floor(share))
        kids = checkpointed(kids.withColumn("new", new).where("new is not null").withColumn("deeper", (F.col("n") == 1) | (~tail & (F.col("new") > deep))))
        done = kids.where("not deeper").select("page_id", "begin", "inner", "inner_end", "end", "size", F.when(F.col("new") > 0, F.col("new")).alias("keep"))
        edits = done if edits is None else edits.unionByName(done)
        level = kids.where("deeper and size > new").select("page_id", "begin", "size", F.col("new").alias("keep"))
        if level.isEmpty():
            break
    marker = F.concat(F.lit(" [TRUNCATED "), F.floor((F.col("size") - F.col("keep")) / 1000).cast("string"), F.lit("k chars]"))
    content = F.greatest(F.col("keep") - (F.col("size") - (F.col("inner_end") - F.col("inner"))) - F.length(marker), F.lit(0))
    shorter = F.col("keep") < F.col("size")
    cut = edits.where(F.col("keep").isNull() | shorter).join(source, "page_id")
    # a tag that the cut goes through goes whole
    kept = F.length(F.regexp_replace(_cut(F.col("html"), F.col("inner"), F.col("inner") + content.cast("int")), r"<[^<>]*$", ""))
    begin = F.when(F.col("keep").isNull(), F.col("begin")).otherwise(F.col("inner") + kept)
    end = F.when(F.col("keep").isNull(), F.col("end")).otherwise(F.col("inner_end"))
    cut = cut.select("page_id", begin.cast("int").alias("begin"), end.alias("end"), F.when(F.col("keep").isNull(), F.lit("")).otherwise(marker).alias("put"))
    # hints inside a content that is cut come behind the marker
    hints = tree.where("hint is not null").select("page_id", F.col("begin").alias("h"), "hint").join(cut.where("put <> ''"), "page_id").where("h >= begin and h < end")
    hints = hints.groupBy("page_id", "begin").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("h", "hint"))), lambda x: x["hint"]), "").alias("hints"))
    return edited(pages, cut.join(hints, ["page_id", "begin"], "left").withColumn("put", F.concat("put", F.coalesce("hints", F.lit("")))).drop("hints"))


# Lists


def list_markdown(tree: DataFrame) -> DataFrame:
    """page_id, markdown of pages with list items: one line an item, indented by two blanks for each list around its own,
    with a dash or, in ordered lists, its number.

    Items and lists of a node table become events at their ends; sums of them over the page give each text the lists and
    items it is in, and a line begins where an item begins or ends and at each break.  Text outside items is left out, as
    are pages without items.  White space within a line is one blank.  An item that isn't closed ends with its list.
    """
    name, at_end = F.col("name"), F.col("inner_end")
    event = lambda at, rank, sub, what, step: F.struct(at.alias("at"), F.lit(rank).alias("rank"), sub.alias("sub"), F.lit(what).alias("what"), F.lit(step).alias("step"))
    here = lambda what, step=0: event(F.col("begin"), 1, F.col("depth"), what, step)
    ends = lambda what: event(at_end, 0, -F.col("depth"), what, -1)
    found = (
        F.when(name.isin("ul", "ol"), F.array(here("list", 1), ends("list"))).when(name == "li", F.array(here("item", 1), ends("item")))
        .when(name == "br", F.array(here("break"))).when(F.col("kind") == "text", F.array(here("text")))
    )
    rows = tree.select("page_id", (name == "ol").alias("numbered"), "text", F.explode(found).alias("e")).select("page_id", "numbered", "text", "e.*")

    upto = lambda *by: Window.partitionBy("page_id", *by).orderBy("at", "rank", "sub").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda what: F.sum(F.when(F.col("what") == what, F.col("step")).otherwise(0)).over(upto())
    rows = rows.withColumns({"lists": total("list"), "items": total("item")})
    opens = (F.col("what") == "item") & (F.col("step") == 1)
    breaks = (F.col("what") == "break") & (F.col("items") > 0)
    rows = rows.withColumn("line", F.sum(((F.col("what") == "item") | breaks).cast("int")).over(upto()))
    # the list around a place is the last that began as deep as the place is
    own = F.last(F.when((F.col("what") == "list") & (F.col("step") == 1), F.struct("at", "numbered")), True).over(upto("lists"))
    rows = rows.withColumn("list", F.when(F.col("lists") > 0, own))
    rows = rows.withColumn("number", F.sum(opens.cast("int")).over(upto("list.at")))

    mark = F.when(F.col("list.numbered"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- ")
    pad = lambda n: F.repeat(F.lit("  "), F.greatest(n, F.lit(0)).cast("int"))
    begins = F.when(opens, F.concat(pad(F.col("lists") - 1), mark)).when(breaks, pad(F.col("lists")))
    text = F.when((F.col("what") == "text") & (F.col("items") > 0), F.struct("at", "text"))
    lines = rows.groupBy("page_id", "line").agg(F.max(begins).alias("begins"), F.max(breaks).alias("broken"), F.sort_array(F.collect_list(text)).alias("t"))
    body = F.array_join(F.transform("t", lambda x: x["text"]), "")
    for entity, char in ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(char))
    body = F.regexp_replace(F.regexp_replace(body, r"(?U)\s+", " "), "^ ", "")
    whole = F.concat(F.coalesce("begins", F.lit("")), body)
    before_break = F.coalesce(F.lead("broken").over(Window.partitionBy("page_id").orderBy("line")), F.lit(False))
    lines = lines.where("line > 0").select("page_id", "line", whole.alias("whole"), (F.col("begins").isNotNull() | (body != "") | before_break).alias("kept")).where("kept")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "whole"))), lambda x: x["whole"]), "\n")
    return lines.groupBy("page_id").agg(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "").alias("markdown"))
