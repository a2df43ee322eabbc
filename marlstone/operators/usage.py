"""Token usage: counters to deltas, roll-ups, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("input", "output", "cache_create", "cache_read")


def deltas(counters: DataFrame) -> DataFrame:
    """Growth of cumulative counters of each thread; if any falls, all were set back and count anew; no growth, no row."""
    w = Window.partitionBy("thread").orderBy("ts", "seq")
    step = counters.withColumns({f"_{k}": F.col(k) - F.coalesce(F.lag(k).over(w), F.lit(0)) for k in KINDS})
    reset = F.least(*[f"_{k}" for k in KINDS]) < 0
    out = step.withColumns({k: F.when(reset, F.col(k)).otherwise(F.col(f"_{k}")) for k in KINDS}).drop(*[f"_{k}" for k in KINDS])
    return out.where(F.greatest(*KINDS) > 0)


def hit_rate(read: Column, base: Column) -> Column:
    """Percentage, 0 of nothing."""
    return F.when(base > 0, read / base * 100.0).otherwise(0.0)


def totals(ledger: DataFrame) -> DataFrame:
    sums = ledger.agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS])
    side = F.col("input") + F.col("cache_create") + F.col("cache_read")
    return sums.withColumn("hit_rate", F.round(hit_rate(F.col("cache_read"), side), 6))


def by_session(ledger: DataFrame) -> DataFrame:
    """Sums, last time and latest title of each session."""
    return ledger.groupBy("session").agg(*[F.sum(k).alias(k) for k in KINDS], F.max("ts").alias("last_ts"), F.max_by("title", F.struct("ts", "seq")).alias("title"), F.count("*").alias("rows"))


def between(ledger: DataFrame, since, until) -> DataFrame:
    return ledger.where(F.col("ts").between(F.lit(since), F.lit(until)))


def header_totals(ledger: DataFrame, since, until, today) -> DataFrame:
    """Total of a range and of today in one pass."""
    every = sum((F.col(k) for k in KINDS), F.lit(0))
    inside = F.col("ts").between(F.lit(since), F.lit(until))
    return ledger.agg(F.coalesce(F.sum(F.when(inside, every)), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("ts") >= F.lit(today), every)), F.lit(0)).alias("today"))


def priced(ledger: DataFrame, prices, default: tuple[float, float]) -> DataFrame:
    """p_in, p_out of each row: the model's own price, else that of the first name it contains, else the default.

    prices: (name, in, out) in order of lookup.  Looked up once for each distinct model, then joined back.
    """
    spark = ledger.sparkSession
    table = F.broadcast(spark.createDataFrame([(m, float(a), float(b), i) for i, (m, a, b) in enumerate(prices)], "k string, p_in double, p_out double, i int"))
    models = ledger.select("model").distinct().withColumn("m", F.regexp_replace(F.lower("model"), r"\[.*\]", ""))
    met = models.join(table, F.contains("m", F.col("k")), "left").groupBy("model", "m").agg(F.min_by(F.struct("p_in", "p_out"), F.struct((F.col("k") != F.col("m")).alias("d"), "i")).alias("p"))
    own = met.select(F.col("model").alias("_model"), F.coalesce("p.p_in", F.lit(default[0])).alias("p_in"), F.coalesce("p.p_out", F.lit(default[1])).alias("p_out"))
    return ledger.join(own, F.col("model").eqNullSafe(F.col("_model")), "left").drop("_model")


def cost(model: Column, rate: float) -> Column:
    """Price of a priced row; cached tokens cost by the model's family."""
    family = F.lower(model).rlike("claude|deepseek")
    read, write = F.when(family, 0.1).otherwise(0.5), F.when(family, 1.25).otherwise(1.0)
    p_in, p_out = F.col("p_in"), F.col("p_out")
    return (F.col("input") * p_in + F.col("output") * p_out + F.col("cache_read") * p_in * read.cast("double") + F.col("cache_create") * p_in * write.cast("double")) / F.lit(1e6) * F.lit(rate).cast("double")


def log_lines(lines: DataFrame) -> DataFrame:
    """Usage in log lines of two formats: the older counts cached tokens as input."""
    out = F.regexp_extract("value", r"^\[Output\]\s+tokens=(\d+)", 1).try_cast("long")
    new = [F.regexp_extract("value", r"^\[Cache\]\s+input=(\d+)\s+creation=(\d+)\s+read=(\d+)", i).try_cast("long") for i in (1, 2, 3)]
    old = [F.regexp_extract("value", r"^\[Cache\]\s+input=(\d+)\s+cached=(\d+)", i).try_cast("long") for i in (1, 2)]
    zero = F.lit(0).cast("long")
    return lines.agg(
        F.count(out).alias("requests"), F.coalesce(F.sum(out), zero).alias("output"),
        F.coalesce(F.sum(F.coalesce(new[0], F.greatest(zero, old[0] - old[1]))), zero).alias("input"),
        F.coalesce(F.sum(new[1]), zero).alias("cache_create"), F.coalesce(F.sum(F.coalesce(new[2], old[1])), zero).alias("cache_read"),
    )


def carried_totals(counters: DataFrame) -> DataFrame:
    """Totals of counters that restart: what stood before each restart is carried over."""
    w = Window.partitionBy("thread").orderBy("ts", "seq")
    step = counters.withColumns({f"_{k}": F.lag(k).over(w) for k in KINDS})
    fell = F.coalesce(reduce_or([F.col(k) < F.col(f"_{k}") for k in KINDS]), F.lit(False))
    return step.groupBy("thread").agg(*[(F.sum(F.when(fell, F.col(f"_{k}")).otherwise(0)) + F.max_by(k, F.struct("ts", "seq"))).alias(k) for k in KINDS])


def reduce_or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def build_summary(parts: DataFrame) -> DataFrame:
    """Usage of builds: calls are the greater of dense and sparse, requests their sum, tokens null unless all report."""
    return parts.groupBy("build").agg(
        F.greatest(F.sum(F.when(F.col("part") == "dense", F.col("calls"))), F.sum(F.when(F.col("part") == "sparse", F.col("calls")))).alias("calls"),
        F.sum("requests").alias("requests"), F.when(F.bool_and(F.col("tokens").isNotNull()), F.sum("tokens")).alias("tokens"),
    )
