"""Filtered top-k search, rank fusion, literal find and paged reading over record tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.session import checkpointed

# Constant of the rank fusion, the channels' weights, the widest pool.
RANK_CONSTANT, WEIGHTS, WIDEST = 60, {"exact": 4.0, "dense": 1.2, "sparse": 1.0}, 30


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def dense_top(vectors: DataFrame, query: Sequence[float], k: int, ids: Sequence[str] = ("data_id", "chunk_index"), vector: str = "embedding") -> DataFrame:
    """The k rows of least cosine distance to query, ties by id: one narrow scan and a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(dot(F.col(vector), F.col(vector))) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return vectors.select(*ids, (1 - dot(F.col(vector), q) / norm).alias("distance")).orderBy("distance", *ids).limit(k)


def sparse_top(terms: DataFrame, query: dict[str, float], k: int, ids: Sequence[str] = ("data_id", "chunk_index")) -> DataFrame:
    """The k rows of greatest inner product; terms: ids, term, weight.  Only the query's terms are read and summed."""
    weight = F.create_map(*[F.lit(x) for t, w in query.items() if w > 0 for x in (t, float(w))])
    hit = terms.where(F.col("term").isin(*[t for t, w in query.items() if w > 0]) & (F.col("weight") > 0))
    return hit.groupBy(*ids).agg(F.sum(F.col("weight") * weight[F.col("term")]).alias("similarity")).orderBy(F.desc("similarity"), *ids).limit(k)


def first_hits(hits: DataFrame, score: str, ascending: bool = True) -> DataFrame:
    """Parts of one structure collapse onto its first part; the best hit of each stays.  Run on a pool of top hits."""
    part = (F.col("structure_id") != "") & (F.col("content_type") != "prose")
    shown = F.when(part, F.col("chunk_index") - F.col("structure_part_index")).otherwise(F.col("chunk_index"))
    w = Window.partitionBy("data_id", "public_chunk").orderBy(F.asc(score) if ascending else F.desc(score), "chunk_index")
    return hits.withColumn("public_chunk", shown).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def ranked(pool: DataFrame, channel: str, score: str | None = None, ascending: bool = True, ids: Sequence[str] = ("data_id", "chunk_index")) -> DataFrame:
    """Ranks of a bounded pool over all knowledge bases; without a score (exact references) all tie at 1."""
    if score is None:
        rank = F.lit(1)
    else:
        rank = F.row_number().over(Window.orderBy(F.asc(score) if ascending else F.desc(score), *ids))
    return pool.select(*ids, F.lit(channel).alias("channel"), rank.alias("rank"))


def fuse(channels: Sequence[DataFrame], k: int, ids: Sequence[str] = ("data_id", "chunk_index"), weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted reciprocal ranks summed over channels, best k, numbered."""
    weight = F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))])
    every = reduce(DataFrame.unionByName, channels)
    own = every.groupBy(*ids).agg(F.round(F.sum(weight[F.col("channel")] / (RANK_CONSTANT + F.col("rank"))), 6).alias("score"), F.array_join(F.sort_array(F.collect_set("channel")), "+").alias("score_type"))
    best = own.orderBy(F.desc("score"), *ids).limit(k)
    return best.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("score"), *ids)))


def pool_size(k: int, mode: str = "rrf", factor: int = 4) -> int:
    k = max(1, min(WIDEST, k))
    return min(WIDEST, max(k, k * factor)) if mode == "rrf" else k


def exact_references(images: DataFrame, query: str, k: int) -> DataFrame:
    """Image rows whose ref_key is one of the figure or table numbers in the query: one for each data_id, k of them."""
    import re

    keys = sorted({m[1] + re.sub(r"\s+", "", m[2]) for m in re.finditer(T.REF, query)})
    if not keys:
        return images.limit(0)
    found = images.where((F.col("kind") == "image") & F.col("ref_key").isin(*keys)).orderBy("data_id", "chunk_index").limit(max(4 * k, k))
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("data_id").orderBy("chunk_index"))).where("_k = 1").drop("_k").orderBy("data_id").limit(k)


def reference_status(requested: DataFrame, hits: DataFrame) -> DataFrame:
    """matched, missing or ambiguous for each requested ref_key, by the number of distinct hits."""
    n = hits.groupBy("ref_key").agg(F.countDistinct("data_id", "chunk_index").alias("n"))
    return requested.join(n, "ref_key", "left").select("ref_key", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("status"))


def find_terms(records: DataFrame, terms: Sequence[str], match: str = "any", case_sensitive: bool = False, max_documents: int | None = 50, folded=F.lower) -> DataFrame:
    """document, terms found, matched: literal search of whole documents, every one of which is judged.

    Blank terms are ignored.  folded is the comparison's fold (functions.unicode.fold for all of Unicode).  More
    documents than max_documents are an error, as the answer would not be complete.
    """
    terms = [t for t in terms if t.strip()]
    if not terms:
        raise ValueError("at least one term that isn't blank is needed")
    body = F.col("searchable") if case_sensitive else folded(F.col("searchable"))
    wanted = [t if case_sensitive else t.casefold() for t in terms]
    hit = [F.max(F.contains(body, F.lit(w)).cast("int")).alias(f"_{i}") for i, w in enumerate(wanted)]
    per = records.groupBy("document").agg(*hit)
    if max_documents is not None and records.select("document").distinct().limit(max_documents + 1).count() > max_documents:
        raise ValueError(f"more than {max_documents} documents are in scope")
    found = F.filter(F.array(*[F.when(F.col(f"_{i}") == 1, F.lit(t)) for i, t in enumerate(terms)]), lambda x: x.isNotNull())
    size = F.size("found")
    return per.select("document", found.alias("found")).withColumn("matched", size == len(terms) if match == "all" else size > 0)


def pages(chunks: DataFrame, budget: int = 4000) -> DataFrame:
    """Chunks dealt to their document's first page: those that fit the budget (two characters between chunks), at
    least one; data_id, n_chunks, n_chars, next_chunk (null at the end)."""
    w = Window.partitionBy("data_id").orderBy("chunk_index")
    run = chunks.select("data_id", "chunk_index", F.length("body").alias("n")).withColumn("sum", F.sum(F.col("n") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 2).withColumn("k", F.row_number().over(w))
    on = (F.col("sum") <= budget) | (F.col("k") == 1)
    return run.groupBy("data_id").agg(F.count_if(on).alias("n_chunks"), F.max(F.when(on, F.least("sum", F.lit(budget)))).alias("n_chars"), F.min(F.when(~on, F.col("chunk_index"))).alias("next_chunk"))


def chunk_page(chunks: DataFrame, data_id: str, offset: int, limit: int = 20) -> DataFrame:
    """Contiguous chunks from an offset with previews of 80 characters; has_more is seen by one row more."""
    got = chunks.where((F.col("data_id") == data_id) & F.col("chunk_index").between(offset, offset + limit))
    more = F.max("chunk_index").over(Window.partitionBy("data_id")) == offset + limit
    numbered = got.withColumn("has_more", more).withColumn("_k", F.row_number().over(Window.partitionBy("data_id").orderBy("chunk_index")))
    whole = (F.col("chunk_index") - F.col("_k") == offset - 1) & (F.col("_k") <= limit)
    return numbered.where(whole).select("data_id", "chunk_index", F.left("body", F.lit(80)).alias("preview"), "has_more")


def public_hit(hits: DataFrame, limit: int = 1600) -> DataFrame:
    """Bodies short enough are shown; others, and empty ones, must be read."""
    body = T.text(F.col("body"))
    shown = (body != "") & (F.length(body) <= limit)
    return hits.select("data_id", "chunk_index", F.when(shown, body).alias("body"), (~shown).alias("requires_read"))


def fuzzy_rank(files: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Paths that hold the query's letters in order, best first, then short ones; without a query shallow ones first."""
    if not query:
        return files.select("path", F.lit(0).alias("score")).orderBy(F.size(F.split("path", "/")), "path").limit(limit)
    return files.select("path", T.path_score(F.col("path"), query).alias("score")).where("score is not null").orderBy(F.desc("score"), F.length("path"), "path").limit(limit)


def complete_paths(paths: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """Paths with a prefix, folders first."""
    return paths.where(F.startswith("path", F.lit(prefix))).orderBy(F.desc("is_dir"), "path").limit(limit)


def matched_length(pairs: DataFrame) -> DataFrame:
    """id and matched: characters in the matching blocks of two texts (id, a, b).

    The longest common block (the first in a, then in b) is taken, then the longest in what stands before both and
    behind both, and so on.  Each round handles the open segments of all pairs: equal places on one diagonal are runs,
    the longest run is the block.  Rounds end when no segment has a common character, after as many as a has blocks.
    """
    open_ = pairs.select("id", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b")).select("*", F.lit(1).alias("alo"), F.length("a").alias("ahi"), F.lit(1).alias("blo"), F.length("b").alias("bhi"))
    found = open_.select("id", F.lit(0).alias("k"))
    segment = ["id", "alo", "ahi", "blo", "bhi"]
    while True:
        places = open_.where("alo <= ahi and blo <= bhi").select("*", F.explode(F.sequence("alo", "ahi")).alias("i")).select("*", F.explode(F.sequence("blo", "bhi")).alias("j"))
        equal = places.where(F.substring("a", F.col("i"), F.lit(1)) == F.substring("b", F.col("j"), F.lit(1)))
        diagonal = Window.partitionBy(*segment, F.col("i") - F.col("j")).orderBy("i")
        runs = equal.withColumn("run", F.col("i") - F.row_number().over(diagonal)).groupBy(*segment, "a", "b", (F.col("i") - F.col("j")).alias("diagonal"), "run").agg(F.count("*").cast("int").alias("k"), F.min("i").alias("i"), F.min("j").alias("j"))
        best = runs.groupBy(*segment, "a", "b").agg(F.max(F.struct("k", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("m"))
        best = checkpointed(best.select(*segment, "a", "b", "m.k", (-F.col("m.i")).alias("i"), (-F.col("m.j")).alias("j")))
        if not best.limit(1).count():
            return found.groupBy("id").agg(F.sum("k").alias("matched"))
        found = found.unionByName(best.select("id", "k"))
        before = best.select("id", "a", "b", "alo", (F.col("i") - 1).alias("ahi"), "blo", (F.col("j") - 1).alias("bhi"))
        behind = best.select("id", "a", "b", (F.col("i") + F.col("k")).alias("alo"), "ahi", (F.col("j") + F.col("k")).alias("blo"), "bhi")
        open_ = before.unionByName(behind)


def did_you_mean(files: DataFrame, name: str, most: int = 2000, k: int = 5) -> DataFrame:
    """The k nearest base names of the first so many paths (a feature's own bounds): twice the characters in matching
    blocks over those of both names, over 0.3."""
    pool = files.select("path").distinct().orderBy("path").limit(most).select(F.col("path").alias("id"), F.lit(name.lower()).alias("a"), F.lower(F.element_at(F.split("path", "/"), -1)).alias("b"))
    pool = checkpointed(pool)
    ratio = 2 * F.col("matched") / F.greatest(F.length("a") + F.length("b"), F.lit(1))
    return pool.join(matched_length(pool), "id").select(F.col("id").alias("path"), ratio.alias("ratio")).where("ratio > 0.3").orderBy(F.desc("ratio"), "path").limit(k)


def filter_choices(choices: DataFrame, query: str) -> DataFrame:
    """Choices (label, value, head: the first MiB of a file, or null) all of whose terms stand in label and value, else
    in the head; all of them without a term."""
    terms = query.lower().split()
    places = F.lower(F.concat_ws("\n", "label", "value")), F.lower(F.coalesce("head", F.lit("")))
    met = [reduce(lambda a, b: a & b, [F.contains(c, F.lit(t)) for t in terms], F.lit(True)) for c in places]
    return choices.where(met[0] | met[1])


def search_sessions(sessions: DataFrame, words: str) -> DataFrame:
    """Sessions all of whose terms stand in name and preview, else in the first MiB of the log."""
    terms = words.lower().split()
    short = F.lower(F.concat_ws(" ", "name", "preview"))
    log = F.lower(F.left("log", F.lit(1 << 20)))
    both = [reduce(lambda a, b: a & b, [F.contains(c, F.lit(t)) for t in terms], F.lit(True)) for c in (short, log)]
    return sessions.where(both[0] | both[1])
