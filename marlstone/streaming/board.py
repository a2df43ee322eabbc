"""The message board as a stream: an append-only folder is the table, the checkpoint's offset the cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POST = "id long, author string, content string, created_at timestamp"


def posts(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(POST).option("maxFilesPerTrigger", files).parquet(folder)


def counts(stream: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Posts by author and window; late ones count as long as the watermark holds their window open."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", every).alias("w"), "author").agg(F.count("*").alias("n")).select("w.start", "author", "n")


def sessions(stream: DataFrame, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of an author, closed by a gap: state ends with the watermark."""
    return stream.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("w"), "author").agg(F.count("*").alias("n")).select("w.start", "w.end", "author", "n")


def debounced(stream: DataFrame, handle, checkpoint: str, seconds: float = 0.3):
    """Micro-batches handed on whole: handle(batch, number)."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
