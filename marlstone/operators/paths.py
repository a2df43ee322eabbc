"""Paths as values: normal forms that can't leave their root, links joined by mistake, and documents behind records.

Whether a file is there is a join with the table of files, whose paths are relative to their root and normal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.html import ENTITIES

# Endings of images.
IMAGE_SUFFIXES = (".jpeg", ".webp", ".tiff", ".png", ".jpg", ".jp2", ".gif", ".bmp", ".tif")
ENDINGS = "|".join(x.replace(".", r"\.") for x in IMAGE_SUFFIXES)
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def normal(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty segments, both slashes alike; null if it has a root of its own (slash, drive,
    scheme), a null character, or leaves where it begins."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))

    def step(stack: Column, s: Column) -> Column:
        up = F.when(F.size(stack) > 0, F.slice(stack, 1, F.size(stack) - 1))
        return F.when(stack.isNull(), None).when(s.isin("", "."), stack).when(s == "..", up).otherwise(F.concat(stack, F.array(s)))

    rooted = p.startswith("/") | p.rlike(SCHEME) | F.contains(p, F.lit("\0"))
    return F.when(~rooted, F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/"))


def within(folder: Column, path: Column) -> Column:
    """The normal form of path seen from folder; null if path has a root of its own or leads out of folder's root."""
    bare = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = bare.startswith("/") | bare.rlike(SCHEME)
    return F.when(~rooted, normal(F.concat(folder, F.lit("/./"), path)))


def _base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """Where a path's file lies; ``.`` at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(".")


def seen_from(folder: Column, path: Column) -> Column:
    """The way from a normal folder (``.``: the root) to a normal path, percent-encoded."""
    a, b = F.filter(F.split(folder, "/"), lambda s: ~s.isin("", ".")), F.split(path, "/")
    both = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    same = F.aggregate(both, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))["n"]
    same = F.least(same, F.size(b) - 1)
    way = F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b)))

    def coded(s: Column) -> Column:
        out = F.url_encode(s)
        for there, here in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            out = F.replace(out, F.lit(there), F.lit(here))
        return out

    return F.array_join(F.transform(way, coded), "/")


def decoded(link: Column) -> Column:
    """A link's text without percent codes and common entities."""
    t = F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


# Links joined by mistake


def split_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (link_id, folder, value) that are several image links in one, as parts: array of the images' ways from
    folder; null where a link is fine as it is or can't be cut so that every part is an image that is there.

    Cuts are behind image endings only.  A part is an image if its path leads to a file, or else if only one file has
    its name (upper and lower case alike), wherever that lies.  Of several ways to cut, each part is as short as can be.
    Links with a scheme, ``?`` or ``#`` are fine as they are.

    Parts meet the files by equal paths and names.  A part whose name begins behind a slash has one name for all places
    that it may begin at, so these are one row for each ending; the others are no longer than paths are.  What can
    be reached from each ending backwards is then a fold over a link's own endings.
    """
    files = files.select("path").distinct()
    by_name = files.groupBy(F.lower(_base(F.col("path"))).alias("name")).agg(F.min("path").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    most = files.agg(F.max(F.length("path"))).first()[0] or 0
    value = F.regexp_replace(F.trim("value"), r"^[<>]+|[<>]+$", "")
    rows = links.select("link_id", F.coalesce("folder", F.lit(".")).alias("folder"), value.alias("value"))
    open_ = rows.where((F.col("value") != "") & ~F.col("value").rlike(r"[?#]") & ~F.col("value").rlike(SCHEME))
    whole = open_.withColumn("path", within(F.col("folder"), decoded(F.col("value"))))
    open_ = whole.join(files, "path", "left_anti").drop("path")
    pieces = F.regexp_extract_all("value", F.lit(rf"(?is).*?(?:{ENDINGS})"), F.lit(0))
    open_ = open_.withColumn("pieces", pieces).withColumn("k", F.size("pieces")).where((F.col("k") > 1) & (F.array_join("pieces", "") == F.col("value")))
    # where pieces end
    ends = F.aggregate("pieces", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    open_ = open_.withColumn("ends", ends)
    # parts that aren't longer than paths are (a character takes twelve at most when it is coded)
    begun = open_.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    near = F.filter(F.sequence(F.col("i") + 1, F.col("k")), lambda j: F.get("ends", j) - F.get("ends", F.col("i")) <= 12 * most)
    parts = begun.select("*", F.explode(near).alias("j")).withColumn("part", decoded(F.substring(F.col("value"), F.get("ends", F.col("i")) + 1, F.get("ends", F.col("j")) - F.get("ends", F.col("i")))))
    parts = parts.withColumn("path", within(F.col("folder"), F.col("part"))).withColumn("name", F.when(~F.contains("part", F.lit("/")), F.lower("part")))
    parts = parts.where(~F.col("part").rlike(SCHEME))
    met = parts.join(files.withColumn("there", F.col("path")), "path", "left").join(by_name, "name", "left").withColumn("to", F.coalesce("there", "only")).where("to is not null")
    short = met.groupBy("link_id").agg(F.collect_list(F.struct("i", "j", "to")).alias("short"))
    # parts with a slash end in one name, whatever they begin with
    ended = open_.select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j"))
    until = F.left("value", F.get("ends", F.col("j")))
    slash = F.length(until) - F.length(F.element_at(F.split(until, "/"), -1))  # characters up to the last slash
    ended = ended.withColumn("slash", slash).where("slash > 0").withColumn("name", F.lower(decoded(F.substring(until, F.col("slash") + 1, F.length(until)))))
    far = ended.join(by_name, "name").groupBy("link_id").agg(F.sort_array(F.collect_list(F.struct("j", "slash", F.col("only").alias("to")))).alias("far"))
    both = open_.join(short, "link_id", "left").join(far, "link_id", "left")
    both = both.withColumn("short", F.coalesce("short", F.array().cast("array<struct<i:int,j:int,to:string>>"))).withColumn("far", F.coalesce("far", F.array().cast("array<struct<j:int,slash:int,to:string>>")))

    def choices(i: Column) -> Column:
        """Ends of parts from i, with the files behind them; a path goes before a name."""
        own = F.transform(F.filter("short", lambda e: e["i"] == i), lambda e: F.struct(e["j"].alias("j"), F.lit(0).alias("by"), e["to"].alias("to")))
        others = F.transform(F.filter("far", lambda e: (e["j"] > i) & (e["slash"] > F.get("ends", i))), lambda e: F.struct(e["j"].alias("j"), F.lit(1).alias("by"), e["to"].alias("to")))
        return F.concat(own, others)

    # best[0] is the choice at i + 1, and so on up to the end of the link
    end = F.struct(F.col("k").alias("j"), F.lit(0).alias("by"), F.lit("").alias("to"))
    best = F.aggregate(
        F.sequence(F.col("k") - 1, F.lit(0)),
        F.array(end),
        lambda best, i: F.concat(F.array(F.array_min(F.filter(choices(i), lambda c: F.get(best, c["j"] - i - 1).isNotNull()))), best),
    )
    way = F.aggregate(
        F.sequence(F.lit(1), F.col("k")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("to")),
        lambda s, _: F.when((s["at"] >= F.col("k")) | F.get("best", s["at"]).isNull(), s).otherwise(F.struct(F.get("best", s["at"])["j"].alias("at"), F.concat(s["to"], F.array(F.get("best", s["at"])["to"])).alias("to"))),
    )
    cut = both.withColumn("best", best).withColumn("way", way).where((F.col("way.at") == F.col("k")) & (F.size("way.to") > 1))
    cut = cut.select("link_id", F.transform("way.to", lambda t: seen_from(F.col("folder"), t)).alias("parts"))
    return links.select("link_id").join(cut, "link_id", "left")


# Documents behind records


def sources(requests: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """request, status and path of the original of each processed document (request, kb_id, processed).

    manifest: kb_id, pos, source, name, kind and processed (array of paths); the first entry that names the document
    counts.  files: kb_id and path of the originals.  status is ok, source_document_not_registered or, where the path
    leads out of its root or to no file, source_document_not_found.
    """
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    entries = manifest.select("kb_id", "pos", slashed(F.col("source")).alias("source"), "name", F.explode("processed").alias("p")).withColumn("processed", slashed(F.col("p"))).drop("p")
    first = entries.groupBy("kb_id", "processed").agg(F.min(F.struct("pos", "source", "name")).alias("e"))
    named = requests.select("request", "kb_id", "processed").join(first, ["kb_id", "processed"], "left")
    named = named.withColumn("source", F.nullif("e.source", F.lit(""))).withColumn("path", within(F.lit("."), F.col("source")))
    there = named.join(files.select("kb_id", "path", F.lit(True).alias("there")).distinct(), ["kb_id", "path"], "left")
    status = F.when(F.col("source").isNull(), "source_document_not_registered").when(F.col("there").isNull(), "source_document_not_found").otherwise("ok")
    ok = status == "ok"
    title = F.coalesce(F.nullif("e.name", F.lit("")), _base(F.col("path")))
    return there.select("request", "kb_id", status.alias("status"), F.when(ok, F.col("path")).alias("path"), F.when(ok, title).alias("title"))


def processed(requests: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """request, status and path of the Markdown made of a document: it has to be a file within its root, Markdown, and
    registered as a document; status names the first of these that fails."""
    path = within(F.lit("."), F.col("processed"))
    asked = requests.select("request", "kb_id", "processed", path.alias("path"))
    there = asked.join(files.select("kb_id", "path", F.lit(True).alias("there")).distinct(), ["kb_id", "path"], "left")
    bare = F.regexp_replace(F.regexp_replace(F.replace(F.col("p"), F.lit("\\"), F.lit("/")), "^/+", ""), "^processed/", "")
    known = manifest.where("kind = 'document'").select("kb_id", F.explode("processed").alias("p")).select("kb_id", bare.alias("processed"), F.lit(True).alias("known")).distinct()
    out = there.join(known, ["kb_id", "processed"], "left")
    md = F.lower("path").rlike(r"[^/]\.(md|markdown)$")
    status = F.when(F.col("there").isNull(), "processed_document_not_found").when(~md, "processed_document_not_markdown").when(F.col("known").isNull(), "processed_document_not_registered").otherwise("ok")
    return out.select("request", status.alias("status"), F.when(status == "ok", F.col("path")).alias("path"))


def assets(requests: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """request and path of an image that a document's original names (request, kb_id, processed, image); null where it
    has a root or scheme of its own, is no image, leads out of the root, or isn't there."""
    origin = sources(requests, manifest, files).where("status = 'ok'").select("request", "kb_id", "path")
    raw = F.regexp_replace(F.trim("image"), r"^[<>]+|[<>]+$", "")
    raw = F.coalesce(F.try_url_decode(F.replace(F.regexp_extract(raw, r"(?s)^([^?#]*)", 1), F.lit("+"), F.lit("%2B"))), raw)
    asked = requests.select("request", F.replace(raw, F.lit("\\"), F.lit("/")).alias("image")).where(F.lower("image").rlike(rf"[^/](?:{ENDINGS})$"))
    target = origin.join(asked, "request").select("request", "kb_id", within(folder_of(F.col("path")), F.col("image")).alias("path"))
    found = target.join(files.select("kb_id", "path").distinct(), ["kb_id", "path"]).select("request", "path")
    return requests.select("request").join(found, "request", "left")
