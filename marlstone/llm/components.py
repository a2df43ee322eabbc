"""Connected components of links between ids, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Workspace


def _state(edges: DataFrame) -> tuple:
    """Number of edges and two 64-bit digests of all of them."""
    whole = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), whole, F.bit_xor(F.xxhash64("b", "a"))).first())


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id of links (a long, b long; any order, repeats allowed).

    Large-star and small-star steps alternate until nothing changes: each hangs ids on the least one that they see.
    Sums are partial before they are shuffled and the joins' skew can be split, so an id with many links is no hot spot.
    """
    edges = ws.save(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, edges = edges, ws.save(small, "edges")
        ws.drop(old)
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
