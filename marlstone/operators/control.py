"""Time-based control over event tables: limiter windows, admission, bursts, schedules."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _micros(ts) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def window_load(events: DataFrame, rpm: int, tpm: int, headroom: float = 0.9) -> DataFrame:
    """Requests and tokens of the minute and the second up to each event of its bucket, and whether budgets hold.

    An event exactly one window old is out.  Times are micros, so frames are exact.
    """
    minute, second = F.col("requests_60") <= int(rpm * headroom), F.col("requests_1") <= max(1, int(rpm * headroom) // 60)
    micros = events.withColumn("_us", _micros("ts"))
    w = Window.partitionBy("bucket").orderBy("_us")
    out = micros.withColumns({f"{n}_{s}": F.sum(c).over(w.rangeBetween(-(s * 1_000_000 - 1), 0)) for s in (60, 1) for n, c in (("requests", F.lit(1)), ("tokens", F.col("tokens")))})
    fits = minute & second & (F.col("tokens_60") <= int(tpm * headroom)) & (F.col("tokens_1") <= max(1, int(tpm * headroom) // 60))
    return out.withColumn("fits", fits).drop("_us")


class _Recent:
    """Admitted events of the last micros, with their tokens added up."""

    def __init__(self, micros: int):
        self.micros, self.events, self.tokens = micros, deque(), 0

    def until(self, us: int) -> None:
        while self.events and self.events[0][0] <= us - self.micros:
            self.tokens -= self.events.popleft()[1]

    def add(self, us: int, tokens: int) -> None:
        self.events.append((us, tokens))
        self.tokens += tokens


def admit(events: DataFrame, rpm: int, tpm: int, headroom: float = 0.9, seconds: int = 60) -> DataFrame:
    """bucket, seq, admitted: only admitted events count against later ones, so each bucket is a sequential fold.

    Batches of a sorted partition stream by; a bucket's state is the admitted events of the last window with running
    sums.  One bucket is one task, as each decision hangs on those before.
    """
    requests, budget = int(rpm * headroom), int(tpm * headroom)
    per_second = max(1, requests // 60), max(1, budget // 60)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, long, short = None, _Recent(seconds * 1_000_000), _Recent(1_000_000)
        for pdf in frames:
            out = []
            for bucket, us, tokens in zip(pdf["bucket"], pdf["us"], pdf["tokens"], strict=True):
                if bucket != now:
                    now, long, short = bucket, _Recent(seconds * 1_000_000), _Recent(1_000_000)
                long.until(us)
                short.until(us)
                room = len(long.events) < requests and long.tokens + tokens <= budget
                fits = room and len(short.events) < per_second[0] and (not short.events or short.tokens + tokens <= per_second[1])
                if fits:
                    long.add(us, tokens)
                    short.add(us, tokens)
                out.append(fits)
            yield pdf[["bucket", "seq"]].assign(admitted=out)

    dealt = events.select("bucket", "seq", _micros("ts").alias("us"), F.col("tokens").cast("long").alias("tokens")).repartition("bucket").sortWithinPartitions("bucket", "us", "seq")
    return dealt.mapInPandas(run, "bucket long, seq long, admitted boolean")


def bursts(events: DataFrame, gap_ms: int = 300) -> DataFrame:
    """Events at most a gap apart form a burst, which has its first event's type and counts the others."""
    w = Window.partitionBy("bucket").orderBy("ts", "seq")
    far = F.coalesce(_micros("ts") - _micros(F.lag("ts").over(w)) > gap_ms * 1000, F.lit(True)).cast("int")
    numbered = events.withColumn("_far", far).withColumn("burst", F.sum("_far").over(w)).drop("_far")
    return numbered.groupBy("bucket", "burst").agg(F.min_by("type", F.struct("ts", "seq")).alias("type"), F.count("*").alias("n"), F.min("ts").alias("first"))


def idle(sessions: DataFrame, now, seconds: int = 3600) -> DataFrame:
    """Stopped sessions that nothing has touched for so long."""
    return sessions.where((F.col("status") == "stopped") & (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_seen") > seconds))


def cooldown(repeat):
    """Seconds between runs, a little under the period; anything unknown is 20 hours."""
    n = F.regexp_extract(repeat, r"^every_(\d+)[hdm]$", 1).try_cast("long")
    unit = F.regexp_extract(repeat, r"^every_\d+([hdm])$", 1)
    every = n * F.when(unit == "h", 3600).when(unit == "d", DAY).when(unit == "m", 60)
    return F.when(repeat == "once", 999_999 * DAY).when(repeat == "weekly", 6 * DAY).when(repeat == "monthly", 27 * DAY).when(n.isNotNull(), every).otherwise(20 * 3600)


def due(tasks: DataFrame, now, max_delay: int = 6) -> DataFrame:
    """Tasks whose gate is open at now: enabled, past their time by at most their delay, not on a weekend if they are
    for weekdays, and cooled down since last_run."""
    at = F.lit(now).cast("timestamp")
    hour, minute = F.split_part("schedule", F.lit(":"), F.lit(1)).try_cast("int"), F.split_part("schedule", F.lit(":"), F.lit(2)).try_cast("int")
    late = F.hour(at) * 60 + F.minute(at) - (hour * 60 + minute)
    weekend = (F.col("repeat") == "weekday") & (F.weekday(at) >= 5)
    cooled = F.col("last_run").isNull() | (F.unix_timestamp(at) - F.unix_timestamp("last_run") >= cooldown(F.col("repeat")))
    return tasks.where(F.col("enabled") & (late >= 0) & (late <= F.coalesce("max_delay_hours", F.lit(max_delay)) * 60) & ~weekend & cooled).orderBy("name")


def within_budget(state: DataFrame, now) -> DataFrame:
    """Which goals may go on: turns and time left."""
    used = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("started")
    return state.withColumn("go_on", (F.col("turns") < F.col("max_turns")) & (used < F.col("max_seconds")))


def transient(texts: DataFrame, least: int = 8) -> DataFrame:
    """Texts seen meanwhile that weren't there at first, nor, if they are long enough, at the end."""
    seen, first, last = (texts.where(F.col("phase") == p).select("text").distinct() for p in ("seen", "initial", "final"))
    return seen.join(first, "text", "left_anti").join(last.where(F.length("text") >= least), "text", "left_anti")


def failover(calls: DataFrame, seconds: int = 300) -> DataFrame:
    """Which backend a call goes to: the primary, or the next for so long after the last failure before it."""
    w = Window.partitionBy("client").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max(F.when(F.col("failed"), F.col("ts"))).over(w)
    return calls.withColumn("backend", F.when(F.unix_timestamp("ts") - F.unix_timestamp(failed) < seconds, 1).otherwise(0))
