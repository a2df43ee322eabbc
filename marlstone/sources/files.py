"""Sources and sinks over folders: scans, fingerprints, record files, logs, snapshots."""

from __future__ import annotations

import json
import re
import time
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.schema import RECORD, normalize


def _relative(root: str):
    return F.regexp_replace(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(root.rstrip("/") + "/"), F.lit("")), "^/+", "")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """rel, size, mtime of the files below root, without hidden ones; contents aren't read unless asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = found.select(_relative(root).alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", "path")
    return rows.where(~F.col("rel").rlike(r"(?:^|/)\."))


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files in order of their path."""
    return listing(spark, root, "*.{md,markdown}").select("rel", "path", "size", F.floor(F.unix_timestamp("mtime")).alias("mtime")).orderBy("rel")


def scan_sources(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).select("rel", "path", "size").orderBy(F.lower("rel"), "rel")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """What a poll for changes needs: no content is read."""
    return listing(spark, root).select(F.col("rel").alias("path"), "size", F.unix_micros("mtime").alias("mtime"))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).select(F.col("rel").alias("path"), "size", F.unix_micros("mtime").alias("mtime"), F.sha2("content", 256).alias("sha256"))


def read_texts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """rel and text: UTF-8 in the JVM; only other files go through the decoding function."""
    from marlstone.functions.unicode import decode_text

    rows = listing(spark, root, pattern)
    good = rows.where(F.is_valid_utf8("content")).select("rel", F.decode("content", "UTF-8").alias("text"))
    return good.unionByName(rows.where(~F.is_valid_utf8("content")).select("rel", decode_text("content").alias("text")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; a line that isn't an object, or no line at all, is an error."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    if not raw.limit(1).count():
        raise ValueError(f"{path} has no records")
    bad = raw.where(F.try_parse_json("value").isNull() | ~F.col("value").rlike(r"^\s*\{"))
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"not a record: {first[0][0][:80]}")
    return normalize(raw.select(F.from_json("value", RECORD).alias("r")).select("r.*"))


def write_records(records: DataFrame, path: str) -> str:
    """Normalised records as JSON lines in a new version of the folder; readers see the old records until it is whole."""
    return Snapshots(records.sparkSession, path, "json").publish(normalize(records))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The records that write_records published last, checked as by read_records."""
    return read_records(spark, Snapshots(spark, path, "json").where())


def write_index(records: DataFrame, path: str) -> None:
    """Rows that can be searched, in folders by knowledge base, which scans prune by."""
    records.where("body <> '' and data_id <> ''").write.mode("overwrite").partitionBy("kb_id").parquet(path)


def read_logs(spark: SparkSession, root: str, pattern: str = "*.txt", least: int = 32) -> DataFrame:
    """name, value, size, mtime of whole logs that aren't too short."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root)
    return rows.select(F.col("_metadata.file_name").alias("name"), "value", F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime")).where(F.col("size") >= least)


def log_lines(spark: SparkSession, root: str, since=None) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).text(root)
    return (rows if since is None else rows.where(F.col("_metadata.file_modification_time") >= F.lit(since))).select("value")


def _deltas(body: Column) -> Column:
    """What one event adds, in any of three wire formats: structs of kind, index, part, name, call and whole.

    Blocks with indexes and typed deltas; choices with a delta; responses with typed events.  whole: the part is all of
    the block, not a piece of it.
    """
    j = lambda p: F.get_json_object(body, p)
    kind = j("$.type")

    def delta(kind_, index, part, name=F.lit(None), call=F.lit(None), whole=False):
        return F.struct(F.lit(kind_).alias("kind"), F.coalesce(index.cast("int"), F.lit(0)).alias("index"), part.cast("string").alias("part"), name.cast("string").alias("name"), call.cast("string").alias("call"), F.lit(whole).alias("whole"))

    zero, typed = F.lit(0), j("$.delta.type")
    calls = F.from_json(j("$.choices[0].delta.tool_calls"), "array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>")
    one = F.transform(calls, lambda x: F.struct(F.lit("tool_use").alias("kind"), F.coalesce(x["index"], zero).alias("index"), x["function"]["arguments"].alias("part"), x["function"]["name"].alias("name"), x["id"].alias("call"), F.lit(False).alias("whole")))
    item = F.lit("function_call") == j("$.item.type")
    many = F.array(
        F.when(typed == "text_delta", delta("text", j("$.index"), j("$.delta.text"))), F.when(typed == "thinking_delta", delta("thinking", j("$.index"), j("$.delta.thinking"))),
        F.when(typed == "input_json_delta", delta("tool_use", j("$.index"), j("$.delta.partial_json"))),
        F.when(j("$.content_block.type") == "tool_use", delta("tool_use", j("$.index"), F.lit(None), j("$.content_block.name"), j("$.content_block.id"))),
        F.when(j("$.choices[0].delta.content") != "", delta("text", zero, j("$.choices[0].delta.content"))),
        F.when(F.coalesce(j("$.choices[0].delta.reasoning_content"), j("$.choices[0].delta.reasoning")) != "", delta("thinking", zero, F.coalesce(j("$.choices[0].delta.reasoning_content"), j("$.choices[0].delta.reasoning")))),
        F.when(kind == "response.output_text.delta", delta("text", zero, j("$.delta"))), F.when(kind == "response.output_text.done", delta("text", zero, j("$.text"), whole=True)),
        F.when(kind.isin("response.reasoning_summary_text.delta", "response.reasoning_text.delta"), delta("thinking", zero, j("$.delta"))), F.when(kind == "response.reasoning_text.done", delta("thinking", zero, j("$.text"), whole=True)),
        F.when((kind == "response.output_item.added") & item, delta("tool_use", j("$.output_index"), F.lit(None), j("$.item.name"), F.coalesce(j("$.item.call_id"), j("$.item.id")))),
        F.when(kind == "response.function_call_arguments.delta", delta("tool_use", j("$.output_index"), j("$.delta"))),
        F.when(kind == "response.function_call_arguments.done", delta("tool_use", j("$.output_index"), j("$.arguments"), whole=True)),
    )
    return F.filter(F.concat(many, F.coalesce(one, F.slice(many, 1, 0))), lambda x: x.isNotNull())


def token_stream(lines: DataFrame) -> DataFrame:
    """stream, kind (thinking, text or tool_use), index, name, call, text of each block of event-stream lines.

    lines: stream, seq, value with ``data: {json}`` in any of three wire formats.  Pieces are joined in order; the
    whole of a text counts where no piece came, of a tool's arguments or of a thought always.  What stands behind a
    stream's end, and what isn't an object, doesn't count.
    """
    body = F.regexp_extract("value", r"^data:\s*(\{.*\})\s*$", 1)
    ended = F.col("value").rlike(r"^data:\s*\[DONE\]") | F.get_json_object(body, "$.type").isin("response.completed", "response.incomplete", "response.failed", "message_stop")
    rows = lines.where(ended).groupBy("stream").agg(F.min("seq").alias("_end"))
    rows = lines.join(rows, "stream", "left").where("_end is null or seq < _end").select("stream", "seq", F.posexplode(_deltas(body)).alias("pos", "d")).select("stream", "seq", "pos", "d.*")
    pieces = F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("seq", "pos", "part", "whole")), lambda x: ~x["whole"])), lambda x: x["part"]), "")
    whole = F.max_by("part", F.when(F.col("whole"), F.col("seq")))
    blocks = rows.groupBy("stream", "kind", "index").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"), F.min_by("call", F.when(F.col("call").isNotNull(), F.col("seq"))).alias("call"), pieces.alias("pieces"), whole.alias("whole"))
    text = F.when(F.col("kind") == "text", F.coalesce(F.nullif("pieces", F.lit("")), "whole")).otherwise(F.coalesce("whole", "pieces"))
    return blocks.select("stream", "kind", "index", "name", "call", text.alias("text")).where("text is not null or name is not null")


def scalar(value: str):
    """A registry's value: quoted text, true or false, nothing, a whole number, a decimal, else the text."""
    v = value.strip()
    if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
        return v[1:-1]
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    if v.lower() in ("", "null", "none", "~"):
        return None
    return int(v) if re.fullmatch(r"[+-]?\d+", v) else float(v) if re.fullmatch(r"[+-]?\d+\.\d+", v) else v


def parse_registry(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a small registry: JSON, or two levels of ``name:`` and ``key: value``."""
    try:
        data = json.loads(text)
    except ValueError:
        data, now = {}, None
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            m = re.match(r"^(\s*)([^:]+):\s*(.*)$", line)
            if m and not m[1]:
                now = data.setdefault(m[2].strip(), {})
            elif m and isinstance(now, dict):
                now[m[2].strip()] = scalar(m[3])
    rows = [(k, *("" if v.get(c) is None else str(v[c]) for c in ("name", "path"))) for k, v in data.items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, "id string, name string, path string")


def write_registry(registry: DataFrame, root: str) -> str:
    """id, name, path of a registry as a new version; readers see the old one until it is whole."""
    return Snapshots(registry.sparkSession, root, "json").publish(registry.select("id", "name", "path").coalesce(1))


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("id string, name string, path string").json(Snapshots(spark, root, "json").where())


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of zip files, one task for each; a member whose path leaves its archive is an error."""
    import io
    import posixpath
    import zipfile

    def run(frames):
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    for m in z.infolist():
                        where = posixpath.normpath(m.filename.replace("\\", "/"))
                        if where.startswith(("/", "../")) or where == ".." or re.match(r"^[A-Za-z]:", where):
                            raise ValueError(f"{name}: {m.filename} leaves the archive")
                        if not m.is_dir():
                            yield pd.DataFrame({"archive": [name], "member": [where], "content": [z.read(m)]})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return found.select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def write_monthly(rows: DataFrame, path: str, time: str = "mtime") -> None:
    """Rows added to compressed files in folders by month, which scans prune by."""
    rows.withColumn("year_month", F.date_format(time, "yyyy-MM")).write.mode("append").partitionBy("year_month").option("compression", "zstd").parquet(path)


class Snapshots:
    """Versions of a table in one folder; readers see the one that a pointer names, which is replaced at once."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "parquet"):
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def current(self) -> str | None:
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("CURRENT-"))
        return found[-1].split("-", 2)[2] if found else None

    def where(self) -> str:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        return f"{self.root}/{name}"

    def read(self) -> DataFrame:
        return self.spark.read.format(self.kind).load(self.where())

    def publish(self, df: DataFrame, expected: int | None = None) -> str:
        """Write a new version, check its number of rows, then name it; a failed write is never seen."""
        name = f"v{uuid.uuid4().hex}"
        lease = self._path(f"{self.root}/LEASE-{name}")
        self._fs.create(lease, False).close()
        df.write.format(self.kind).save(f"{self.root}/{name}")
        if expected is not None and (n := self.spark.read.format(self.kind).load(f"{self.root}/{name}").count()) != expected:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            self._fs.delete(lease, False)
            raise ValueError(f"{n} rows were written, {expected} expected")
        pointers = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("CURRENT-")]
        number = 1 + max((int(p.split("-")[1]) for p in pointers), default=0)
        self._fs.create(self._path(f"{self.root}/CURRENT-{number:08d}-{name}"), False).close()
        self._fs.delete(lease, False)
        return name

    def cleanup(self, lease_seconds: int = 86_400) -> list[str]:
        """Delete versions but the newest named one, and older pointers.

        A version that is still being written has a lease, a file beside it, and stays as long as that is younger than
        lease_seconds (longer than any write takes); what a writer that died has left goes with its lease after that.
        """
        listed = {s.getPath().getName(): s for s in self._fs.listStatus(self._path(self.root))}  # before the pointer is read
        held = {n.removeprefix("LEASE-") for n, s in listed.items() if n.startswith("LEASE-") and time.time() - s.getModificationTime() / 1000 < lease_seconds}
        keep, gone = {self.current(), *held}, []
        pointers = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("CURRENT-"))
        for name, s in listed.items():
            if (name.startswith("v") and name not in keep) or name in pointers[:-1] or (name.startswith("LEASE-") and name.removeprefix("LEASE-") not in held):
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone
