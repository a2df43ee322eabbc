"""Lookups that answer with a state: found, missing or ambiguous, and what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import paths


def resolve_images(requests: DataFrame, images: DataFrame, most: int = 10) -> DataFrame:
    """Each requested ref_key with its image if there is one, else not_found or ambiguous with a few candidates."""
    found = images.groupBy("ref_key").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("image_id")), 1, most).alias("ids"))
    out = requests.select("ref_key").distinct().join(found, "ref_key", "left")
    state = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return out.select("ref_key", state.alias("status"), F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",").alias("candidates"))


def resolve_documents(requests: DataFrame, documents: DataFrame, key: Column) -> DataFrame:
    """Requested names by exact id, else by a key that one document alone has: request, doc (null: none or several)."""
    exact = documents.select(F.col("doc").alias("request"), F.col("doc").alias("d0")).distinct()
    keyed = documents.select("doc", key.alias("key")).groupBy("key").agg(F.countDistinct("doc").alias("n"), F.min("doc").alias("d1")).where("n = 1").drop("n")
    return requests.join(exact, "request", "left").join(keyed, "key", "left").select("request", F.coalesce("d0", "d1").alias("doc"))


def uncertain_list(c: Column) -> Column:
    """A JSON list of texts, or the text itself as a list of one; nothing for empty text."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(c, "array<string>"), F.array(c)))


def lenient_json(c: Column) -> Column:
    """The JSON object in a model's answer, as text: fences off, else the first braces to the last, else with stray
    backslashes escaped, else null."""
    bare = T.strip(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    span = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    escaped = F.regexp_replace(span, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")
    good = lambda x: F.when(x.rlike(r"^\s*\{") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(good(bare), good(span), good(escaped))


CALL = "array<struct<name:string,args:string>>"


def tool_calls(c: Column) -> Column:
    """name and args (JSON) of tool calls written into text: a JSON array of calls at its end and nothing else, or calls
    in tags and then function tags.  A function whose arguments aren't an object is called bad_json."""
    begin = F.regexp_instr(c, F.lit(r'\[\{"type": ?"tool_use"'))
    array = F.from_json(F.when((begin > 0) & F.endswith(c, F.lit("}]")), F.substring(c, begin, F.length(c))), "array<struct<type:string,name:string,input:string>>")
    listed = F.transform(F.filter(array, lambda x: x["type"] == "tool_use"), lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["input"], F.lit("{}")).alias("args")))

    def args(x: Column, otherwise: Column) -> Column:
        return F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("arguments", "args", "input")], otherwise)

    tagged = F.regexp_extract_all(c, F.lit(r"(?s)<(?:tool_use|tool_call)>((?:(?!<(?:tool_use|tool_call)>).){15,}?)</(?:tool_use|tool_call)>"), F.lit(1))
    tagged = F.transform(F.filter(tagged, lambda x: F.try_parse_json(x).isNotNull()), lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), args(x, F.lit("{}")).alias("args")))
    tagged = F.filter(tagged, lambda x: F.coalesce(x["name"], F.lit("")) != "")
    tag = F.lit(r"(?is)<function\s*=\s*([A-Za-z_][\w.-]*)\s*>(.*?)</function\s*>")
    functions = F.arrays_zip(F.regexp_extract_all(c, tag, F.lit(1)).alias("name"), F.transform(F.regexp_extract_all(c, tag, F.lit(2)), T.strip).alias("body"))

    def called(x: Column) -> Column:
        inner = args(x["body"], x["body"])
        good = F.try_parse_json(x["body"]).isNotNull() & F.startswith(x["body"], F.lit("{")) & F.startswith(inner, F.lit("{"))
        return F.struct(F.when((x["body"] == "") | good, x["name"]).otherwise("bad_json").alias("name"), F.when(x["body"] == "", "{}").when(good, inner).otherwise(F.to_json(F.struct(F.concat(F.lit("Failed to parse function arguments for "), x["name"]).alias("msg")))).alias("args"))

    return F.coalesce(F.when(F.size(listed) > 0, listed), F.concat(tagged.cast(CALL), F.transform(functions, called).cast(CALL)), F.array().cast(CALL))


IMAGE = r"""!\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)"""
_NUMBERED = r"(?U)^(?:图|表)\s*[0-9]{1,3}+(?:\s*[-–—.·]\s*[0-9]{1,3}+){0,3}+\s*(?:$|[:.、—–-])"


def _described(lines: DataFrame) -> tuple[DataFrame, Column]:
    """Lines with what captions hang on: has (an image), src (a source line), cap (an explicit caption or null), each
    with its neighbours in _p (above) and _n (below), nearest first; and the line's own."""
    clean = T.strip(F.regexp_replace("line", IMAGE, ""))
    clean = F.regexp_replace(F.regexp_replace(clean, r"\\([~*_#])", "$1"), r"^[*_`]+|[*_`]+$", "")
    clean = F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))
    source = clean.rlike(r"(?iU)^(?:资料)?来源\b|^source\b")
    head = T.half_width(T.strip(F.regexp_replace(clean, r"^\s{0,3}#{1,6}\s+", "")))
    caption = F.when(~source & head.rlike(_NUMBERED), clean)
    rows = lines.select("doc_id", "line_no", "line", F.struct("line", (T.strip(F.col("line")) != "").alias("full"), F.col("line").rlike(IMAGE).alias("has"), source.alias("src"), caption.alias("cap")).alias("_own"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    around = {k: F.array(*[f("_own", i).over(w) for i in range(1, 5)]) for k, f in (("_p", F.lag), ("_n", F.lead))}
    return rows.withColumns(around), F.col("_own")


def _nearest(side: str, past: Column | int = 0) -> Column:
    """How far the next line that isn't empty lies, one empty line at most between; counted behind the first past lines."""
    past = F.lit(past) if isinstance(past, int) else past
    at = lambda i: F.get(side, past + i)
    return F.when(at(0)["full"], past + 1).when(at(0).isNotNull() & at(1)["full"], past + 2)


def captions(lines: DataFrame) -> DataFrame:
    """Lines with an image and their caption (null: none).

    Only a line that begins, behind heading marks, with a figure or table number and then ends or has a delimiter is a
    caption; mentions and source lines aren't.  The image's own line goes first, then the nearer of the next lines with
    content above and below, one empty line at most between; at equal distance they have to name the same number.
    """
    rows, own = _described(lines)
    rows = rows.where(own["has"]).withColumn("_a", _nearest("_p")).withColumn("_b", _nearest("_n"))
    above, below = F.get("_p", F.col("_a") - 1)["cap"], F.get("_n", F.col("_b") - 1)["cap"]
    same = (T.ref_key(above) == T.ref_key(below)) & (T.ref_key(above) != "")
    both = F.when(F.col("_a") < F.col("_b"), above).when(F.col("_b") < F.col("_a"), below).when(same, above)
    near = F.when(above.isNotNull() & below.isNotNull(), both).otherwise(F.coalesce(above, below))
    return rows.select("doc_id", "line_no", F.coalesce(own["cap"], near).alias("caption"))


#: Paths that conversion makes for images.
_MADE = r"(?i)\S*?\.assets-[^\s()]*[\\/][^\s()]+\.(?:png|jpe?g|jp2|webp|gif|bmp|tiff?)(?:\?[^\s)]*)?\)?"


def near_text(lines: DataFrame, most: int = 600) -> DataFrame:
    """Lines with an image and the text that belongs to it: the line, the captions next to it, a source line behind
    them, and one line of prose before them.  Images become labels, links their texts; of long texts the end is kept."""
    rows, own = _described(lines)
    rows = rows.where(own["has"])
    a, b = _nearest("_p"), _nearest("_n")
    rows = rows.withColumn("_up", F.when(F.get("_p", a - 1)["cap"].isNotNull(), a).otherwise(0)).withColumn("_down", F.when(F.get("_n", b - 1)["cap"].isNotNull(), b).otherwise(0))
    rows = rows.withColumn("_s", _nearest("_n", F.col("_down"))).withColumn("_q", _nearest("_p", F.col("_up")))
    before = F.get("_p", F.col("_q") - 1)
    text = lambda c: c["line"]
    parts = F.array(
        F.when(~before["has"] & ~before["src"] & before["cap"].isNull(), text(before)),
        F.when(F.col("_up") > 0, text(F.get("_p", F.col("_up") - 1))),
        text(own),
        F.when(F.col("_down") > 0, text(F.get("_n", F.col("_down") - 1))),
        F.when(F.get("_n", F.col("_s") - 1)["src"], text(F.get("_n", F.col("_s") - 1))),
    )
    raw = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    raw = F.regexp_replace(raw, r"""!\[\]\(([^)\s]+)(?:\s+"[^"]*")?\)""", "[图片:image]")
    raw = F.regexp_replace(raw, r"""!\[\s*([^\]]*?)\s*\]\(([^)\s]+)(?:\s+"[^"]*")?\)""", "[图片:$1]")
    raw = F.regexp_replace(raw, r"""(?<!!)\[\s*([^\]\r\n]+?)\s*\]\(([^)\s]+)(?:\s+"[^"]*")?\)""", "$1")
    flat = F.trim(F.regexp_replace(F.regexp_replace(raw, _MADE, "[图片]"), r"(?U)\s+", " "))
    return rows.select("doc_id", "line_no", F.ltrim(F.when(F.length(flat) > most, F.right(flat, F.lit(most))).otherwise(flat)).alias("near"))


def image_references(texts: DataFrame) -> DataFrame:
    """Images of Markdown texts, and links whose path ends as an image's does, in order: doc_id, pos, alt, path.

    pos counts all images and links.  Paths are without percent codes and entities; addresses in other stores are left
    out, and so are links around an image.
    """
    m = r"""!\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)|(?<!!)\[((?:(?!!\[)[^\]\r\n])+)\]\(([^)\s]+)(?:\s+"[^"]*")?\)"""
    names = ("alt", "path", "text", "to")
    all_ = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(m), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    found = texts.select("doc_id", F.posexplode(all_).alias("pos", "i"))
    image = F.col("i.path") != ""
    path = paths.decoded(F.when(image, F.col("i.path")).otherwise(F.col("i.to")))
    found = found.select("doc_id", "pos", image.alias("image"), F.trim(F.when(image, F.col("i.alt")).otherwise(F.col("i.text"))).alias("alt"), path.alias("path"))
    ending = F.lower(F.regexp_extract("path", r"(?s)^([^?#]*)", 1)).rlike(rf"(?:{paths.ENDINGS})$")
    return found.where((F.col("image") | ending) & ~F.col("path").rlike(paths.SCHEME)).drop("image")


def fold_turns(messages: DataFrame, most: int = 72) -> DataFrame:
    """All but the last turn of a session become a title: the first summary, or the start of the text."""
    w = Window.partitionBy("conv_id")
    summary = T.strip(F.regexp_extract("text", r"(?s)<summary>(.*?)</summary>", 1))
    title = F.left(F.when(summary != "", summary).otherwise(F.trim(F.regexp_replace("text", r"\s+", " "))), F.lit(most))
    return messages.withColumn("last", F.col("turn") == F.max("turn").over(w)).select("conv_id", "turn", "last", F.when(F.col("last"), F.col("text")).otherwise(title).alias("shown"))


def recent_context(previews: DataFrame, current, k: int = 5, most: int = 60) -> DataFrame:
    """The newest other sessions with the start of their last question and answer."""
    short = lambda c: F.left(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")), F.lit(most))
    return previews.where(F.col("conv_id") != current).orderBy(F.desc("last_turn"), "conv_id").limit(k).select("conv_id", short("last_user").alias("question"), short("last_answer").alias("answer"))


def progress(items: DataFrame, by: str) -> DataFrame:
    """Done and all of each list, and whether it is complete."""
    return items.groupBy(by).agg(F.count_if("done").alias("done"), F.count("*").alias("total"), F.bool_and("done").alias("complete"))


def reconcile(reservations: DataFrame, actual: DataFrame, seconds: int = 60) -> DataFrame:
    """Reservations with the tokens that count: what a call really took, booked at its end if its window is over."""
    both = reservations.join(actual, "call", "left")
    late = F.unix_timestamp("ended") - F.unix_timestamp("ts") > seconds
    return both.select("call", F.when(F.coalesce(late, F.lit(False)), F.col("ended")).otherwise(F.col("ts")).alias("ts"), F.coalesce("used", "tokens").alias("tokens"), F.when(F.coalesce(late, F.lit(False)), 0).otherwise(1).alias("requests"))


def expand_references(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """Line ranges that ``{{file:path:a:b}}`` names: doc_id, ref_no, body; a join of ranges to lines by path."""
    m = r"\{\{file:([^:}]+):(\d+):(\d+)\}\}"
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(m), F.lit(i)).alias(n) for i, n in ((1, "path"), (2, "a"), (3, "b"))])
    refs = texts.select("doc_id", F.posexplode(parts).alias("ref_no", "r")).select("doc_id", "ref_no", "r.path", F.col("r.a").cast("int").alias("a"), F.col("r.b").cast("int").alias("b"))
    met = refs.join(lines, "path").where("line_no between a and b")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return met.groupBy("doc_id", "ref_no").agg(body.alias("body"))


def hint(columns: dict[str, Column]) -> Column:
    """Where a hit is from: file, section and number, those that are there."""
    return F.array_join(F.filter(F.array(*[F.when(c != "", F.concat(F.lit(f"{n}="), c)) for n, c in columns.items()]), lambda x: x.isNotNull()), "; ")
