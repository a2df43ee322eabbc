"""Session logs: pairing, grouping, folding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

# Fixed value: the summary that says that an agent answered without a tool.
DIRECT_ANSWER = "直接回答了用户问题"


def parse_log(logs: DataFrame) -> DataFrame:
    """name, pos, kind, body of the marked sections of whole-text logs."""
    marker = r"(?m)^=== (?:Prompt|Response|USER|ASSISTANT) ===.*$"
    kinds = F.regexp_extract_all("value", F.lit(r"(?m)^=== (Prompt|Response|USER|ASSISTANT) ===.*$"), F.lit(1))
    bodies = F.slice(F.split("value", marker), 2, F.greatest(F.size(kinds), F.lit(1)))
    return logs.select("name", F.posexplode(F.arrays_zip(kinds.alias("kind"), bodies.alias("body"))).alias("pos", "s")).select("name", "pos", "s.kind", T.strip(F.col("s.body")).alias("body"))


def pairs(sections: DataFrame) -> DataFrame:
    """Each response behind a prompt; a later prompt replaces a waiting one, what has no partner is left out."""
    w = Window.partitionBy("name").orderBy("pos")
    both = sections.where(F.col("kind").isin("Prompt", "Response")).withColumns({"before": F.lag("kind").over(w), "prompt": F.lag("body").over(w)})
    return both.where("kind = 'Response' and before = 'Prompt'").select("name", "pos", "prompt", F.col("body").alias("response"))


def turns(messages: DataFrame) -> DataFrame:
    """Groups of messages that a user's opens: group number, first text, number of messages, texts in order."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    grouped = messages.withColumn("grp", F.sum((F.col("role") == "user").cast("int")).over(w)).where("grp > 0")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return grouped.groupBy("conv_id", "grp").agg(F.count("*").alias("n"), F.min_by("text", "turn").alias("question"), F.array_join(texts, "\n").alias("body"))


def merge_roles(messages: DataFrame) -> DataFrame:
    """Runs of one role become one message; what stands before the first user message goes."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    known = messages.where(F.col("role").isin("user", "assistant")).withColumn("new", F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True)).cast("int"))
    seen = known.withColumns({"run": F.sum("new").over(w), "users": F.sum((F.col("role") == "user").cast("int")).over(w)}).where("users > 0")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    merged = seen.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.min("turn").alias("turn"), F.count("*").alias("n"), F.array_join(texts, "\n").alias("text"))
    return merged.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("run")).alias("pos"), "role", "turn", "n", "text")


def fold_runs(lines: DataFrame, last: int = 70) -> DataFrame:
    """Runs of agent lines between a user's become their last line with the run's length; the last so many stay."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    user = F.startswith("line", F.lit("[USER]"))
    marked = lines.withColumn("user", user).withColumn("island", F.sum((F.col("user") | F.coalesce(F.lag("user").over(w), F.lit(False))).cast("int")).over(w))
    folded = marked.groupBy("conv_id", "island").agg(F.min("pos").alias("pos"), F.first("user").alias("user"), F.max_by("line", "pos").alias("line"), F.count("*").alias("n"))
    shown = F.when(F.col("user"), F.col("line")).otherwise(F.concat(F.when(F.contains("line", F.lit(DIRECT_ANSWER)), "[Agent]").otherwise(F.col("line")), F.lit("（"), F.col("n").cast("string"), F.lit(" turns）")))
    recent = Window.partitionBy("conv_id").orderBy(F.desc("pos"))
    return folded.select("conv_id", "pos", shown.alias("line"), F.row_number().over(recent).alias("k")).where(F.col("k") <= last).drop("k")


def recent(lines: DataFrame, window: int = 30) -> DataFrame:
    """Lines with a mark whether they are among the last so many of their session."""
    return lines.withColumn("recent", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("pos"))) <= window)


def previews(messages: DataFrame) -> DataFrame:
    """First and last question, last answer and number of rounds of each session, in one aggregation."""
    user, agent = F.col("role") == "user", F.col("role") == "assistant"
    return messages.groupBy("conv_id").agg(
        F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first_user"), F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("last_user"),
        F.max_by(F.when(agent, F.col("text")), F.when(agent, F.col("turn"))).alias("last_answer"), F.count_if(user).alias("questions"), F.max("turn").alias("last_turn"),
    )


def round_history(messages: DataFrame, most: int = 80) -> DataFrame:
    """A line for each message: the user's text, or the start of the agent's."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return messages.select("conv_id", F.col("turn").alias("pos"), F.when(F.col("role") == "user", F.concat(F.lit("[USER]: "), flat)).otherwise(F.concat(F.lit("[Agent] "), F.left(flat, F.lit(most)))).alias("line"))


def match_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Tool uses with their result: the first of an id counts, one that is missing reads ``(error)``."""
    first = results.groupBy("tool_use_id").agg(F.min_by("content", "pos").alias("content"))
    return uses.dropDuplicates(["id"]).join(first, F.col("id") == F.col("tool_use_id"), "left").select("id", "name", F.coalesce("content", F.lit("(error)")).alias("content"))


def orphans(results: DataFrame, uses: DataFrame) -> DataFrame:
    """Results of no known use, which become plain text."""
    return results.join(uses, F.col("tool_use_id") == F.col("id"), "left_anti").select("pos", F.col("content").alias("text"))


def drop_prompts(sections: DataFrame) -> DataFrame:
    """Without the system prompt right before a user section and without the assistant's echo."""
    after = F.lead("kind").over(Window.partitionBy("name").orderBy("pos"))
    return sections.withColumn("after", after).where(~((F.col("kind") == "Prompt") & (F.coalesce("after", F.lit("")) == "USER")) & (F.col("kind") != "ASSISTANT")).drop("after")


def archivable(sessions: DataFrame, archived: DataFrame, now, keep: int = 10, hours: int = 2, least: int = 4500) -> DataFrame:
    """Sessions to archive: not of the newest, not touched of late, large enough, not there yet; with their month."""
    newest = sessions.orderBy(F.desc("mtime"), "name").limit(keep).select(F.col("name").alias("_newest"))
    older = sessions.join(F.broadcast(newest), F.col("name").eqNullSafe(F.col("_newest")), "left_anti")
    old = (F.lit(now) - F.col("mtime")) >= F.expr(f"interval {hours} hours")
    return older.where(old & (F.col("size") >= least)).join(archived, "name", "left_anti").withColumn("month", F.date_format("mtime", "yyyy-MM"))


def turn_buffer(chunks: DataFrame, last: int = 50) -> DataFrame:
    """Chunks of a stream joined turn by turn; the last so many turns of each."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    whole = chunks.groupBy("stream", "turn").agg(F.array_join(texts, "").alias("text"), F.count("*").alias("n"))
    return whole.withColumn("k", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("turn")))).where(F.col("k") <= last).drop("k")
