"""Checkpoint trees as tables of nodes and parents.

Nothing makes a row for each node and ancestor.  Pointers double in length with each round of one join, and what a
node gathers on its way up doubles with them, so a chain of a million nodes takes twenty joins of a million rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import checkpointed


def _pointers(nodes: DataFrame) -> DataFrame:
    """id, to: the parent, null where it isn't there."""
    known = nodes.select(F.col("id").alias("parent"), F.col("id").alias("to"))
    return nodes.select("id", "parent").join(known, "parent", "left").select("id", "to")


def _rounds(nodes: DataFrame) -> int:
    """Doublings that reach the root of any tree of so many nodes."""
    return max(1, nodes.count()).bit_length()


def _no_cycle(open_: DataFrame) -> None:
    left = [r["id"] for r in open_.select("id").limit(5).collect()]
    if left:
        raise ValueError(f"nodes in or below a cycle of parents, among them {left}")


def fold_up(nodes: DataFrame, own: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """id, value: own values of a node and all its ancestors, merged; merge(near, far) is associative.

    nodes: id, parent (null at a root) and what own needs.  Parents that aren't there count as null.  A cycle of
    parents is an error.
    """
    state = checkpointed(_pointers(nodes).join(nodes.select("id", own.alias("value")), "id"))
    for _ in range(_rounds(nodes)):
        open_ = state.where("to is not null")
        if not open_.limit(1).count():
            break
        far = state.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("value").alias("far"))
        moved = open_.join(far, "to").select("id", F.col("beyond").alias("to"), merge(F.col("value"), F.col("far")).alias("value"))
        state = checkpointed(state.where("to is null").unionByName(moved))
    _no_cycle(state.where("to is not null"))
    return state.select("id", "value")


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """id, to: the ancestor 1, 2, 4, ... steps up, of nodes that have one; a row a node at most."""
    out = [checkpointed(_pointers(nodes).where("to is not null"))]
    rounds = _rounds(nodes)
    while out[-1].limit(1).count():
        if len(out) > rounds:
            _no_cycle(out[-1])
        half = out[-1]
        out.append(checkpointed(half.join(half.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", F.col("beyond").alias("to"))))
    return out[:-1]


def depths(nodes: DataFrame) -> DataFrame:
    """id, depth: ancestors above."""
    rooted = _pointers(nodes).withColumnRenamed("to", "parent")
    return fold_up(rooted, F.col("parent").isNotNull().cast("int"), lambda near, far: near + far).select("id", F.col("value").alias("depth"))


def path_to(nodes: DataFrame, node) -> DataFrame:
    """depth, id: root to node.  Ancestors at multiples of a long jump come first, then those between, by shorter ones."""
    found = nodes.where(F.col("id") == node).select("id", F.lit(0).alias("up"))
    for k, jump in reversed(list(enumerate(_jumps(nodes)))):
        more = found.join(jump, "id").select(F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        found = checkpointed(found.unionByName(more))
    most = found.agg(F.max("up")).first()[0] or 0
    return found.select((F.lit(most) - F.col("up")).alias("depth"), "id")


def subtree(nodes: DataFrame, top) -> DataFrame:
    """id: top and all below it.  What is up to 2, 4, 8, ... steps below comes by jumps into what is nearer."""
    found = nodes.where(F.col("id") == top).select("id").distinct()
    for jump in _jumps(nodes):
        found = checkpointed(found.unionByName(jump.join(found.select(F.col("id").alias("to")), "to", "left_semi").select("id")).distinct())
    return found


def rebuild(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """id, history, note: the deltas (id, delta array, note) on the path from the root in order, and the last note on it
    that isn't null."""
    every = nodes.select("id", "parent").join(deltas.select("id", "delta", "note"), "id", "left")
    own = F.struct(F.coalesce("delta", F.array().cast(deltas.schema["delta"].dataType)).alias("history"), F.col("note").alias("note"))

    def merge(near: Column, far: Column) -> Column:
        return F.struct(F.concat(far["history"], near["history"]).alias("history"), F.coalesce(near["note"], far["note"]).alias("note"))

    return fold_up(every, own, merge).select("id", "value.history", "value.note")


def delete_subtree(nodes: DataFrame, top) -> DataFrame:
    return nodes.join(subtree(nodes, top), "id", "left_anti")


def garbage(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """Blobs that nothing refers to."""
    return blobs.join(references.select("hash").where("hash is not null").distinct(), "hash", "left_anti")


def chains(nodes: DataFrame) -> DataFrame:
    """id, head, steps: the nearest ancestor, or itself, that isn't the only child of its parent, and how far up it is."""
    only = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children"))
    every = nodes.select("id", "parent").join(only, "parent", "left")
    heads = F.col("children").isNull() | (F.col("children") > 1)
    own = F.struct(F.when(heads, F.col("id")).alias("head"), F.when(heads, 0).otherwise(1).alias("steps"))

    def merge(near: Column, far: Column) -> Column:
        return F.when(near["head"].isNotNull(), near).otherwise(F.struct(far["head"].alias("head"), (near["steps"] + far["steps"]).alias("steps")))

    return fold_up(every, own, merge).select("id", "value.head", "value.steps").where("head is not null")


def file_state(nodes: DataFrame, writes: DataFrame) -> DataFrame:
    """id, path, hash: state of each file at each node, the nearest write (id, path, hash) on its path; a null hash is a
    file that is gone.  A node carries a map of its files, one write of each."""
    own = writes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("hash")))).alias("files"))
    every = nodes.select("id", "parent").join(own, "id", "left")
    kind = own.schema["files"].dataType

    def merge(near: Column, far: Column) -> Column:
        return F.map_concat(near, F.map_filter(far, lambda k, _: ~F.map_contains_key(near, k)))

    states = fold_up(every, F.coalesce("files", F.create_map().cast(kind)), merge)
    return states.select("id", F.explode("value").alias("path", "s")).select("id", "path", "s.hash").where("hash is not null")


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent isn't there."""
    return nodes.join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id")


def same_depth(nodes: DataFrame) -> DataFrame:
    """Each node with the next of its depth, around the end."""
    from marlstone.operators.maintenance import next_in_cycle

    return next_in_cycle(depths(nodes), "depth")


def tail_behind(pairs: DataFrame) -> DataFrame:
    """Of two question lists, whether the first continues the second, and with what."""
    n = F.size("known")
    starts = F.slice("log", F.lit(1), F.greatest(n, F.lit(1))) == F.col("known")
    return pairs.withColumn("continues", (n == 0) | starts).withColumn("tail", F.when(F.col("continues"), F.slice("log", n + 1, F.size("log"))))
