"""What the operators of this subpackage share: the shared folder, saved intermediate tables, names of inputs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.batches import give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is missing (tests on one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark's setting by which the files of a query's shuffles go when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _tidied_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Workspace:
    """Intermediate tables written as Parquet in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        where = self.path(f"{name}-{self._n}")
        with _tidied_shuffles(self.spark):
            df.write.mode("overwrite").parquet(where)
        saved = self.spark.read.schema(df.schema).parquet(where)
        saved._marlstone_path = where
        return saved

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables of save() that no later plan reads."""
        for s in saved:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(s._marlstone_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; all others, whatever their names, stay out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MEMOS: weakref.WeakSet = weakref.WeakSet()


def forget_all() -> None:
    """Empty the memos of this process and give back what is free."""
    for m in list(_MEMOS):
        m.forget()
    give_back()


def tidied(run: Callable) -> Callable:
    """run, a function for mapInArrow, after which the process is left small: Python workers live on beside the stages
    that come after."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        forget_all()

    return tidy


class Memo:
    """A bounded memory of computed values for tasks: two generations, so frequent keys stay when it is full.

    Only speed depends on it: what it forgets is computed again.
    """

    def __init__(self, compute, limit: int = 250_000):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}
        _MEMOS.add(self)

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def known(self, keys: set) -> dict:
        """A table with the values of keys (and others), to be read before the next call; compute(list of new keys) gives
        those not known."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = keys.difference(young)
        new = missing.difference(old)
        for k in missing.difference(new):
            young[k] = old[k]
        if new:
            new = list(new)
            young.update(zip(new, self.compute(new), strict=True))
        return young


def bounded(texts: Iterable, most: int = 1 << 20) -> Iterator[list]:
    """Texts in lists of about so many characters at most, long ones alone."""
    own, n = [], 0
    for t in texts:
        if own and n + len(t) > most:
            yield own
            own, n = [], 0
        own.append(t)
        n += len(t)
    if own:
        yield own
