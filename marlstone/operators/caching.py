"""Batched calls of an outside model with a cache in front, as joins: only distinct texts that aren't known are sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import checkpointed


def keyed(texts: DataFrame, purpose: str) -> DataFrame:
    """texts with cache_key, a digest of purpose and text."""
    return texts.withColumn("cache_key", F.sha2(F.concat(F.lit(purpose + "\0"), "text"), 256))


def misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """cache_key and text of what the cache doesn't have, each once.  Equal texts are one before the join."""
    once = texts.groupBy("cache_key").agg(F.first("text").alias("text"))
    return once.join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def call(unknown: DataFrame, model: Callable[[list[str]], list], kind: str, size: int) -> DataFrame:
    """cache_key and value of each text, asked of the model in lists of at most size inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                yield pd.DataFrame({"cache_key": part["cache_key"], "value": model(part["text"].tolist())})

    key = unknown.schema["cache_key"].dataType.simpleString()
    return unknown.select("cache_key", "text").mapInPandas(run, f"cache_key {key}, value {kind}")


def answered(texts: DataFrame, cache: DataFrame, model: Callable[[list[str]], list], kind: str, size: int = 256) -> DataFrame:
    """texts (keyed) with value and hit, whether it came from the cache (cache_key, value).  New answers are written
    before they are used, so that no task asks twice."""
    known = cache.groupBy("cache_key").agg(F.first("value").alias("value")).withColumn("hit", F.lit(True))
    new = checkpointed(call(misses(texts, cache), model, kind, size)).withColumn("hit", F.lit(False))
    return texts.join(known.unionByName(new), "cache_key", "left")
