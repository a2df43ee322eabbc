"""Operator 10: URL rules as a sort-merge range join.

A rule's host, labels reversed (``com.example.``), is a prefix of the reversed host of every page it can fit, so it is
an interval of the sorted order.  Pages are range-partitioned and sorted by that key; one sweep over a partition keeps
a stack of the rules whose intervals hold the current page.  Host intervals are nested or apart, so a stack suffices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import partitions

#: Rules up to this number go to every task whole; more are dealt out with the pages' ranges.
BROADCAST_RULES = 50_000


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #``, A-Z lower-cased, and the path up to ``? #``; both empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    after = F.when(F.locate("://", u) > 0, F.expr(f"substring(coalesce(`{url}`, ''), locate('://', coalesce(`{url}`, '')) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host: Column) -> Column:
    """Labels reversed, each with a dot behind it: every subdomain's key begins with its parent's."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class Sweep:
    """Pages come in ascending order of key; rules too, each key with its rules longest first."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        """rules: (host key, path, rule, verdict)."""
        by_key: dict[str, list] = {}
        for key, path, rule, verdict in rules:
            by_key.setdefault(key, []).append((len(rule), path, rule, verdict))
        self.keys = sorted(by_key)
        self.rules = [sorted(by_key[k], key=lambda r: (-r[0], r[2], r[3] != "block")) for k in self.keys]
        self.next, self.stack = 0, []

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        while self.next < len(self.keys) and self.keys[self.next] <= key:
            opened = self.keys[self.next]
            while self.stack and not opened.startswith(self.stack[-1][0]):
                self.stack.pop()
            self.stack.append((opened, self.rules[self.next]))
            self.next += 1
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        best = None
        for _, rules in self.stack:
            for n, p, rule, verdict in rules:
                if path.startswith(p):
                    if best is None or n >= best[0]:  # an equally long one further up the stack has the longer host
                        best = (n, rule, verdict)
                    break
        return best and best[1:]


def judge(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    rules: (host, path, verdict) rows.  A rule fits its host and all subdomains if the page's path starts with the
    rule's; the longest wins (of equal length the longer host, then block); without one rule is null and verdict is
    default.  Null and odd urls have empty host and path, which no rule fits.  Rules without a host are left out.
    """
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = rules.select(F.lower(F.trim("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''").distinct()
    host, path = host_and_path()
    keyed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    n = partitions(spark)
    few = rules.limit(broadcast_rules + 1).collect()
    schema = "page_id long, host string, path string, rule string, verdict string"

    def out(pdf: pd.DataFrame, sweep: Sweep) -> pd.DataFrame:
        found = [sweep.judge(k, p) for k, p in zip(pdf["key"], pdf["path"], strict=True)]
        columns = {"page_id": pdf["page_id"], "host": pdf["host"], "path": pdf["path"], "rule": [f and f[0] for f in found], "verdict": [f[1] if f else default for f in found]}
        return pd.DataFrame({k: pd.Series(list(v), dtype=object) for k, v in columns.items()})

    if len(few) <= broadcast_rules:
        known = [(_key(r.host), r.path, r.host + r.path, r.verdict) for r in few]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sweep = Sweep(known)
            for pdf in batches:
                yield out(pdf, sweep)

        # page_id as the second key cuts a host that holds many pages into several ranges
        return keyed.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key").mapInPandas(run, schema)

    # Many rules: ranges with fixed bounds; a rule goes to each range that its interval touches.
    bounds = _bounds(keyed, n)
    edges = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).cast("long").alias("page_id")) for k, i in bounds]) if bounds else F.array().cast("array<struct<key:string,page_id:bigint>>")
    at = lambda key, page: F.size(F.filter(edges, lambda e: e <= F.struct(key.alias("key"), page.alias("page_id"))))
    dealt = keyed.withColumn("range", at(F.col("key"), F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))))
    ruled = rules.select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    ruled = ruled.withColumn("range", F.explode(F.sequence(at(F.col("key"), F.lit(-(1 << 63))), at(F.concat("key", F.lit("\U0010ffff")), F.lit((1 << 63) - 1)))))

    def join(pages_pdf: pd.DataFrame, rules_pdf: pd.DataFrame) -> pd.DataFrame:
        return out(pages_pdf.sort_values("key", kind="stable"), Sweep(list(rules_pdf[["key", "path", "rule", "verdict"]].itertuples(index=False, name=None))))

    return dealt.groupBy("range").cogroup(ruled.groupBy("range")).applyInPandas(join, schema)


def _bounds(keyed: DataFrame, n: int) -> list[tuple[str, int]]:
    """n-1 (key, page_id) bounds of about even ranges from a bounded sample of 100 keys a range; only balance depends on it."""
    rows = keyed.where("page_id is not null").select("key", "page_id").orderBy(F.xxhash64("page_id", "key")).limit(100 * n).collect()
    rows = sorted((r.key, r.page_id) for r in rows)
    return sorted({rows[len(rows) * i // n] for i in range(1, n)}) if rows else []
