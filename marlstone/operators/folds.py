"""Ordered folds with a carry, which no window expresses: batches of sorted partitions stream through small functions.

Keys are dealt by hash and sorted inside their partition, so a task holds one key's running state, not its rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _streamed(df: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """step(state, row) -> (state, output) for each row of each key in order; start() is a key's first state."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                if k != now:
                    now, state = k, start()
                state, got = step(state, row)
                out.append(got)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def batches(items: DataFrame, size: int, budget: int) -> DataFrame:
    """bucket, pos, batch: items fill a batch up to its size and its budget of tokens; one item always fits."""

    def step(state, row):
        batch, n, tokens = state
        own = min(int(row.tokens), budget)
        if n and (n >= size or tokens + int(row.tokens) > budget):
            batch, n, tokens = batch + 1, 0, 0
        return (batch, n + 1, tokens + own), (row.bucket, row.pos, batch)

    return _streamed(items.select("bucket", "pos", "tokens"), "bucket", ["pos"], lambda: (0, 0, 0), step, "bucket long, pos long, batch int")


def pack_lines(lines: DataFrame, budget: int) -> DataFrame:
    """doc_id, line_no, part: whole lines fill a part up to its budget of characters (a line end between lines)."""

    def step(state, row):
        part, used = state
        n = int(row.n)
        if used and used + 1 + n > budget:
            part, used = part + 1, 0
        return (part, used + n + (1 if used else 0)), (row.doc_id, row.line_no, part)

    return _streamed(lines.select("doc_id", "line_no", F.length("line").alias("n")), "doc_id", ["line_no"], lambda: (0, 0), step, "doc_id long, line_no long, part int")


def trim_history(messages: DataFrame, cap: int, keep_rate: float = 0.6, least: int = 9) -> DataFrame:
    """Messages that stay of each history: over the cap the oldest turns go, turn by turn, until the rest fits the
    target, more than least messages are never cut below, and a user's message is first.

    The rest's size from each message on is a window; the cut is then the first user's message whose rest fits, so
    the loop becomes an aggregation and nothing is folded.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    sized = messages.withColumns({"rest": F.sum(F.length("text")).over(w), "left": F.count("*").over(w)})
    fits = (F.col("rest") <= int(cap * keep_rate)) | (F.col("left") <= least)
    # the loop stops at the first user message whose rest fits; without one nothing is left
    cut = sized.groupBy("conv_id").agg(F.max("rest").alias("whole"), F.min(F.when(fits & (F.col("role") == "user"), F.col("turn"))).alias("from"), F.count("*").alias("all"))
    keep = (F.col("whole") <= cap) | (F.col("all") <= least) | (F.col("turn") >= F.col("from"))
    return messages.join(cut, "conv_id").where(keep).select(*messages.columns)


class MergedHistory:
    """Sliding windows over one history put together, block by block: by the longest overlap of end and start, else where
    the block's first line was last seen, else one behind the other."""

    def __init__(self):
        self.lines: list[str] = []
        self.last: dict[str, int] = {}  # where each line was last seen

    def add(self, block: list[str]) -> None:
        whole = self.lines
        if not block:
            return
        overlap = next((k for k in range(min(len(whole), len(block)), 0, -1) if whole[-k:] == block[:k]), 0)
        if not overlap and block[0] in self.last:
            at = self.last[block[0]]
            while overlap < len(block) and at + overlap < len(whole) and whole[at + overlap] == block[overlap]:
                overlap += 1
        for line in block[overlap:]:
            self.last[line] = len(whole)
            whole.append(line)


def merge_blocks(blocks: list[list[str]]) -> list[str]:
    merged = MergedHistory()
    for block in blocks:
        merged.add(block)
    return merged.lines


def merge_histories(blocks: DataFrame) -> DataFrame:
    """session, lines: the blocks of each session in order of pos.  Sorted partitions stream by; a task holds one
    session's merged lines, which are its row of the result, and not its blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, merged = None, None
        for pdf in frames:
            for session, lines in zip(pdf["session"], pdf["lines"], strict=True):  # null lines are an empty block
                if merged is None or session != now:
                    if merged is not None:
                        yield pd.DataFrame({"session": [now], "lines": [merged.lines]})
                    now, merged = session, MergedHistory()
                merged.add([] if lines is None else list(lines))
        if merged is not None:
            yield pd.DataFrame({"session": [now], "lines": [merged.lines]})

    dealt = blocks.select("session", "pos", "lines").repartition("session").sortWithinPartitions("session", "pos")
    return dealt.select("session", "lines").mapInPandas(run, "session long, lines array<string>")


def drop_overlapping(candidates: DataFrame, share: float = 0.5) -> DataFrame:
    """page_id, cand: candidates by falling score, without those more than a share of whose items a kept one has.

    Sorted partitions stream by; a page's state is an index from items to the kept candidates that have them, so a
    candidate meets only those that it shares an item with.
    """

    def start():
        return defaultdict(list), [0]

    def step(state, row):
        index, count = state
        items = set() if row.items is None else set(row.items)
        common = Counter(k for x in items for k in index.get(x, ()))
        keep = max(common.values(), default=0) <= share * len(items)
        if keep:
            for x in items:
                index[x].append(count[0])
            count[0] += 1
        return state, (row.page_id, row.cand, keep)

    ranked = candidates.select("page_id", "cand", (-F.col("score")).alias("_rank"), F.col("items").alias("items"))
    return _streamed(ranked, "page_id", ["_rank", "cand"], start, step, "page_id long, cand long, keep boolean").where("keep").drop("keep")


def compress_tags(messages: DataFrame, keep_recent: int = 10, most: int = 800) -> DataFrame:
    """Old messages with the bodies of thinking and tool tags cut in the middle and generated context left out."""
    from pyspark.sql import Window

    old = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) > keep_recent
    return messages.withColumn("text", F.when(old, shorten_tags(F.col("text"), most)).otherwise(F.col("text")))


def shorten_tags(c, most: int = 800):
    """Each match by itself: both ends of a long body are groups of one pattern, so no function in Python is needed."""
    t = F.regexp_replace(c, r"(?s)<(history|key_info|earlier_context)>.*?</\1>", "<$1>[...]</$1>")
    h = most // 2
    for tag in ("thinking", "think", "tool_use", "tool_result"):
        part = rf"(?:(?!</{tag}>)[\s\S])"
        t = F.regexp_replace(t, rf"(<{tag}>)({part}{{{h}}}){part}+({part}{{{most - h}}})(</{tag}>)", "$1$2\n...[Truncated]...\n$3$4")
    return t
