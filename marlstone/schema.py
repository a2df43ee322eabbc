"""Types of the record table and its normaliser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a record.
STRINGS = (
    "data_id", "kb_id", "file_name", "title", "kind", "image_path", "source_data_id", "header_path", "body", "search_text", "content_type", "structure_id", "structure_title",
    "image_id", "ref_key", "display_label", "caption", "description", "table_markdown", "source_file_name", "uncertain", "analysis_error", "related_text", "near_text",
)
INTEGERS = ("chunk_index", "source_chunk_index", "structure_part_index", "structure_part_count")

RECORD = T.StructType([*[T.StructField(c, T.StringType(), False) for c in STRINGS], *[T.StructField(c, T.LongType(), False) for c in INTEGERS]])


def normalize(df: DataFrame) -> DataFrame:
    """A record table from any of its columns: no nulls, kind and content type by default, at least one part."""
    got = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in STRINGS}
    df = df.select(*[got[c].alias(c) for c in STRINGS], *[F.coalesce(F.col(c).cast("long"), F.lit(-1 if c == "source_chunk_index" else 0)) .alias(c) if c in df.columns else F.lit(-1 if c == "source_chunk_index" else 0).cast("long").alias(c) for c in INTEGERS])
    df = df.withColumn("kind", F.when(F.col("kind") == "", "text").otherwise(F.col("kind")))
    own = F.when(F.col("kind") == "image", F.when(F.trim("table_markdown") != "", "table").otherwise("figure")).otherwise("prose")
    return df.withColumns({"content_type": F.when(F.col("content_type") == "", own).otherwise(F.col("content_type")), "search_text": F.when(F.col("search_text") == "", F.col("body")).otherwise(F.col("search_text")), "structure_part_count": F.greatest("structure_part_count", F.lit(1).cast("long"))})
