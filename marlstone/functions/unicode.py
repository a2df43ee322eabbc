"""The few text operators that Spark has no function for, as Arrow UDFs that hold a piece of a batch at a time."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.batches import mapped


@F.arrow_udf(T.StringType())
def fold(s: pa.Array) -> pa.Array:
    """Compatibility composition and case folding, for literal comparison."""
    return mapped(s, lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold(), pa.string())


@F.arrow_udf(T.StringType())
def name_key(s: pa.Array) -> pa.Array:
    """Names that differ in width or white space only."""
    return mapped(s, lambda x: None if x is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", x)), pa.string())


@F.arrow_udf(T.StringType())
def label(s: pa.Array) -> pa.Array:
    """Text of a label: entities and tags resolved, marks stripped."""
    return mapped(s, lambda x: re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", html.unescape((x or "").strip()))).strip(" *_`"), pa.string())


@F.arrow_udf(T.StringType())
def decode_text(s: pa.Array) -> pa.Array:
    """Bytes as UTF-8, else GB 18030, else UTF-8 with replacement marks."""

    def one(raw):
        if raw is None:
            return None
        for code in ("utf-8", "gb18030"):
            try:
                return bytes(raw).decode(code)
            except UnicodeDecodeError:
                pass
        return bytes(raw).decode("utf-8", "replace")

    return mapped(s, one, pa.string())
