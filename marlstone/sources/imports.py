"""Imports that go on where they were broken off, and an index that takes a batch once however often it is sent."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import caching
from marlstone.sources.files import Snapshots


class _Folder:
    """Small files of a folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> dict[str, float]:
        """What lies in the folder, and the age of each in seconds."""
        if not self._fs.exists(self._path(self.root)):
            return {}
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in self._fs.listStatus(self._path(self.root))}

    def put(self, name: str, text: str, over: bool = False) -> None:
        """A whole file at once: written beside its place, then renamed."""
        new = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray(text.encode()))
        out.close()
        to = self._path(f"{self.root}/{name}")
        if over:
            self._fs.delete(to, False)
        if not self._fs.rename(new, to):
            self._fs.delete(new, False)
            raise FileExistsError(f"{name} is there already")

    def get(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def drop(self, name: str = "") -> None:
        self._fs.delete(self._path(f"{self.root}/{name}" if name else self.root), True)


class Import:
    """A long import in parts, each of which is done once.

    Inputs (key and fingerprint among their columns) are dealt to parts by a hash of their key.  A finished part is a
    row of the ledger: its number, how many inputs it had and a digest of their keys and fingerprints, and where its
    result lies.  A rerun skips parts whose inputs are still the same, does the others, and publishes all of them as one
    version.  The ledger belongs to one contract (what is done to inputs, and how); one of another contract is refused.
    """

    def __init__(self, spark: SparkSession, root: str, contract: str, parts: int = 16):
        self.spark, self.contract, self.parts = spark, contract, parts
        self.staging = _Folder(spark, f"{root.rstrip('/')}/staging")
        self.published = Snapshots(spark, f"{root.rstrip('/')}/published")

    def _ledger(self) -> dict[int, dict]:
        names = self.staging.names()
        if "CONTRACT" in names and (found := self.staging.get("CONTRACT")) != self._own():
            raise ValueError(f"the checkpoint is of another contract: {found}")
        rows = [json.loads(self.staging.get(n)) for n in sorted(names) if n.startswith("done-")]
        return {r["part"]: r for r in rows}

    def _own(self) -> str:
        return json.dumps({"contract": self.contract, "parts": self.parts}, sort_keys=True)

    def run(self, inputs: DataFrame, convert: Callable[[DataFrame], DataFrame]) -> str:
        """Do what isn't done, publish, forget the staging; returns the version's name."""
        done = self._ledger()
        if "CONTRACT" not in self.staging.names():
            self.staging.put("CONTRACT", self._own())
        dealt = inputs.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int"))
        asked = self._asked(dealt)
        for part in sorted(asked):
            if (old := done.get(part)) and old["n"] == asked[part][0] and old["digest"] == asked[part][1]:
                continue
            self._renew()
            path = f"{self.staging.root}/part-{part:05d}-{uuid.uuid4().hex}"
            convert(dealt.where(F.col("_part") == part).drop("_part")).write.parquet(path)
            if part in done:
                self.staging.drop(f"done-{part:05d}")
            self.staging.put(f"done-{part:05d}", json.dumps({"part": part, "n": asked[part][0], "digest": asked[part][1], "path": path}))
            done[part] = {"path": path}
        paths = [done[p]["path"] for p in sorted(asked)]
        result = self.spark.read.parquet(*paths) if paths else convert(inputs)
        name = self.published.publish(result, expected=result.count())
        self.staging.drop()
        return name

    def _asked(self, dealt: DataFrame) -> dict[int, tuple[int, str]]:
        """Inputs and their digest of each part: the sums of four pieces of each input's hash, in any order of rows."""
        h = F.sha2(F.concat_ws("\0", F.col("key").cast("string"), F.col("fingerprint").cast("string")), 256)
        pieces = [F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{at}") for at in (1, 13, 25, 37)]
        rows = dealt.groupBy("_part").agg(F.count("*").alias("n"), *pieces).collect()  # a row for each part
        return {r["_part"]: (r["n"], ",".join(r[c] for c in r.asDict() if c.startswith("s"))) for r in rows}

    def _renew(self) -> None:
        self.staging.put("LEASE", "", over=True)

    def cleanup(self, lease_seconds: int = 86_400) -> list[str]:
        """Delete results of parts that the ledger doesn't name, and a staging without a ledger; not while a lease, which
        each part renews, is younger than lease_seconds.  What the ledger names stays for a rerun."""
        names = self.staging.names()
        if not names or min(names.values()) < lease_seconds:
            return []
        named = {json.loads(self.staging.get(n))["path"].rsplit("/", 1)[-1] for n in names if n.startswith("done-")}
        if not named:
            self.staging.drop()
            return sorted(names)
        gone = [n for n in names if (n.startswith("part-") and n not in named) or n.startswith(".")]
        for n in gone:
            self.staging.drop(n)
        return sorted(gone)


class Index:
    """Rows by id that can be searched, in buckets; a version is a list of buckets' files and of batches taken.

    A batch rewrites the buckets that its ids fall into and leaves the others' files as they are.  Readers see the list
    that is published last, so always whole batches; a batch that was taken before changes nothing.
    """

    #: So many ids may be sent to all tasks.
    SMALL = 100_000

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.lists = Snapshots(spark, f"{self.root}/lists", "json")
        self.data = _Folder(spark, f"{self.root}/data")

    def _list(self) -> tuple[dict[int, str], set[str]]:
        if self.lists.current() is None:
            return {}, set()
        rows = self.spark.read.schema("bucket int, path string, batch string").json(self.lists.where()).collect()  # buckets and batches, not rows
        return {r["bucket"]: r["path"] for r in rows if r["path"]}, {r["batch"] for r in rows if r["batch"]}

    def _load(self, paths) -> DataFrame | None:
        paths = sorted(set(paths))
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        found = self._load(self._list()[0].values())
        if found is None:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        return found

    def _saved(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _winners(self, rows: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
        """bucket, id, cache_key of the record that stays for each id, and cache_key, text of these (equal ones may come
        several times).  Only texts of ids that have several are compared; the others are known by their keys."""
        keys = rows.groupBy("bucket", "id").agg(F.min("cache_key").alias("cache_key"), F.max("cache_key").alias("other"))
        keys = self._saved(keys.withColumn("several", F.col("cache_key") != F.col("other")).drop("other"), f"{root}/keys")
        one, texts = keys.where("not several").drop("several"), rows.select("cache_key", "text")
        several = keys.where("several").select("bucket", "id")
        n = several.count()
        if not n:
            return one, texts
        several = F.broadcast(several) if n <= self.SMALL else several
        most = rows.join(several, ["bucket", "id"], "left_semi").groupBy("bucket", "id").agg(F.max("text").alias("text"))
        most = self._saved(caching.keyed(most, "index").withColumn("cache_key", F.unhex("cache_key")), f"{root}/most")
        texts = rows.join(several, ["bucket", "id"], "left_anti").select("cache_key", "text").unionByName(most.select("cache_key", "text"))
        return one.unionByName(most.select("bucket", "id", "cache_key")), texts

    def upsert(self, records: DataFrame, batch: str, model: Callable[[list[str]], list], kind: str, size: int = 256) -> bool:
        """Take records (id, text and more) with the model's values for their texts; False if the batch was taken before.

        Texts whose value the index or the batch itself has are not asked again; the others go to the model in lists of
        at most size.  Of several records of one id in a batch the one of the greatest text stays; null ids and empty
        texts are left out.
        """
        paths, batches = self._list()
        if batch in batches:
            return False
        own = [c for c in records.columns if c not in ("cache_key", "value", "bucket")]
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        rows = caching.keyed(records.select(*own).where("id is not null and text <> ''"), "index").withColumns({"bucket": bucket, "cache_key": F.unhex("cache_key")})
        folder, work = f"{self.data.root}/{uuid.uuid4().hex}", _Folder(self.spark, f"{self.root}/work-{uuid.uuid4().hex}")
        try:
            keys, texts = self._winners(rows, work.root)
            before = self._load(paths.values())
            known = (before.select(F.unhex("cache_key").alias("cache_key"), "value") if before is not None else self.spark.createDataFrame([], f"cache_key binary, value {kind}")).groupBy("cache_key").agg(F.first("value").alias("value"))
            new = self._saved(caching.call(caching.misses(texts, known), model, kind, size), f"{work.root}/values")
            touched = [r[0] for r in keys.select("bucket").distinct().collect()]  # at most buckets
            # texts are dealt to buckets once, and with them each id's value; the value comes first, behind it the greatest text
            found = keys.join(known.unionByName(new), "cache_key").withColumn("of", F.lit(2))
            old = self._load([paths[b] for b in touched if b in paths])
            dealt = found.unionByName(rows.withColumn("of", F.lit(1)), allowMissingColumns=True)
            if old is not None:
                dealt = dealt.unionByName(old.select(*own, "bucket", F.unhex("cache_key").alias("cache_key"), "value").withColumn("of", F.lit(0)), allowMissingColumns=True)
            first = Window.partitionBy("bucket", "id").orderBy(F.desc("of"), F.desc("text"))
            ranked = dealt.repartition(max(1, len(touched)), "bucket").withColumns({"n": F.row_number().over(first), "taken": F.first("of").over(first) == 2, "value": F.first("value").over(first)})
            both = ranked.where("n = if(taken, 2, 1)").withColumns({"cache_key": F.lower(F.hex("cache_key")), "of": F.col("bucket")})
            both.select(*own, "bucket", "cache_key", "value", "of").write.partitionBy("of").parquet(folder)
        finally:
            work.drop()
        paths |= {b: f"{folder}/of={b}" for b in touched}
        listed = [(b, p, None) for b, p in paths.items()] + [(None, None, x) for x in sorted(batches | {batch})]
        self.lists.publish(self.spark.createDataFrame(listed, "bucket int, path string, batch string").coalesce(1))
        return True
