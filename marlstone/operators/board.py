"""Message-board reads and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def poll(posts: DataFrame, since_id: int = 0, limit: int = 50) -> DataFrame:
    """The next posts behind a cursor: the id's filter reaches the scan, the limit is a bounded heap."""
    return posts.where(F.col("id") > since_id).orderBy("id").limit(limit)


def page(posts: DataFrame, author: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    found = posts if author is None else posts.where(F.col("author") == author)
    return found.orderBy(F.desc("id")).offset(offset).limit(limit)


def count(posts: DataFrame, author: str | None = None) -> DataFrame:
    return (posts if author is None else posts.where(F.col("author") == author)).agg(F.count("*").alias("total"))


def authors(posts: DataFrame) -> DataFrame:
    return posts.select("author").distinct().orderBy("author")


def register(users: DataFrame, names: DataFrame) -> DataFrame:
    """users and new names: a name that is known keeps its token, a new one gets one from its name."""
    new = names.select("name").distinct().join(users, "name", "left_anti").select(F.left(F.sha2("name", 256), F.lit(16)).alias("token"), "name")
    return users.select("token", "name").unionByName(new)


def pinned_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("pinned"), F.desc("updated_at"), "id")


def retain(jobs: DataFrame, now, hours: int = 24, most: int = 100) -> DataFrame:
    """Ended jobs go after so many hours; of those left the newest stay.  Running jobs stay whatever their age."""
    old = (F.lit(now) - F.col("updated_at")) > F.expr(f"interval {hours} hours")
    kept = jobs.where(~(F.col("ended") & old))
    return kept.orderBy(F.desc("updated_at"), F.desc("id")).limit(most)


def evict(files: DataFrame, quota: int, now, days: int = 30, by: str = "cache") -> DataFrame:
    """Cache files that go: those past their days, then oldest first until the rest fits the quota.

    Sums run over days first, a row for each cache and day, and then inside a day, so a large cache is many tasks.
    """
    aged = files.withColumn("expired", (F.lit(now) - F.col("mtime")) > F.expr(f"interval {days} days")).withColumn("_day", F.to_date("mtime"))
    key = [by, "expired", "_day"]
    later = Window.partitionBy(by, "expired").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days_ = aged.groupBy(*key).agg(F.sum("size").alias("_sum")).select(*key, F.coalesce(F.sum("_sum").over(later), F.lit(0)).alias("_later"))
    newer = Window.partitionBy(*key).orderBy(F.desc("mtime"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0)
    kept_with = F.sum("size").over(newer) + F.col("_later")
    return aged.join(days_, key).withColumn("_kept_with", kept_with).where(F.col("expired") | (F.col("_kept_with") > quota)).drop("_kept_with", "_later", "_day")


def new_ids(found: DataFrame, known: DataFrame) -> DataFrame:
    """id of what is found and isn't known yet, each once; null ids are left out."""
    return found.select("id").where("id is not null").distinct().join(known.select("id"), "id", "left_anti")
