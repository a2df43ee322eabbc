"""Operator 12: fill-in-the-middle forms of texts, cut between units whose places come from run lengths.

A text is stored as its maximal runs of one character class (white space or not): where each ends and how many units
end in it or before it.  A cut after so many units is found by binary search for its run; what remains is arithmetic,
so neither units nor their texts are ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import documents

MARKS = ("<P>", "<S>", "<M>")


class Runs:
    """The run-length class encoding of a text.

    Units are ``token`` (a run of other characters with the white space before it, or white space at the end) or
    ``char`` (a code point).  ``units[i]`` of them end up to ``ends[i]``, the end of run i.
    """

    def __init__(self, text: str, unit: str = "token"):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
        self.each = unit == "char"
        self.ends = np.append(np.flatnonzero(blank[1:] != blank[:-1]) + 1, len(points)) if len(points) else np.zeros(0, np.int64)
        if self.each:
            self.units = self.ends
        else:
            closes = ~blank[self.ends - 1]
            closes[-1:] = True  # white space at the end is a unit of its own
            self.units = np.cumsum(closes)

    @property
    def n(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def end(self, count: int) -> int:
        """Code points before the end of the first count units (0 to n)."""
        if count == 0:
            return 0
        run = int(np.searchsorted(self.units, count))
        # a token ends where its run does; characters go back from the run's end one by one
        return int(self.ends[run]) - (int(self.units[run]) - count if self.each else 0)


def _hashes(seed: str, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def arrange(text: str, numbers: list[int], unit: str = "token", plain_percent: int = 50, spm_percent: int = 80) -> tuple:
    """n, form, characters of prefix and middle (null if plain), output of a text."""
    runs = Runs(text, unit)
    h1, h2, h3, h4 = numbers
    if not text or any(m in text for m in MARKS) or h3 % 100 >= plain_percent:
        return runs.n, "plain", None, None, text
    a, z = (runs.end(c) for c in sorted((h1 % (runs.n + 1), h2 % (runs.n + 1))))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    p, s, m = MARKS
    form, out = ("spm", f"{s}{suffix}{p}{prefix}{m}{middle}") if h4 % 100 < spm_percent else ("psm", f"{p}{prefix}{s}{suffix}{m}{middle}")
    return runs.n, form, a, z - a, out


_KINDS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def transform(docs: DataFrame, seed: str = "42", unit: str = "token", plain_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n (units), form (plain, spm or psm), prefix_chars, middle_chars (null if plain), output of every document.

    Null texts are empty; empty texts and those that hold a mark stay plain.  Numbers come from the hash of seed and
    doc_id alone (a null id: the empty string), so repeated rows get one result.  plain_percent: at so many hundredths
    of the numbers and above texts stay plain; spm_percent: below so many, suffixes come first.  Other columns are left
    out.  Rows are independent: nothing is shuffled, and a text is one task's for the time of its row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, size = [], 0
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                made.append((doc_id, *arrange(text.as_py(), _hashes(seed, doc_id), unit, plain_percent, spm_percent)))
                size += len(made[-1][-1])
                if size > 1 << 22:  # long texts go out a few at a time
                    yield _batch(made)
                    made, size = [], 0
            if made:
                yield _batch(made)

    return documents(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], list(_KINDS))


def restore(made: DataFrame) -> DataFrame:
    """Adds restored, the exact text rebuilt from output and form alone.

    A mark can't arise across the parts' borders (it begins with the only character that begins one), so the first of
    each kind is the one that was put there.
    """
    p, s, m = MARKS
    after = lambda mark: F.expr(f"substring(output, instr(output, '{mark}') + 3)")
    between = lambda a, z: F.expr(f"substring(output, instr(output, '{a}') + 3, instr(output, '{z}') - instr(output, '{a}') - 3)")
    spm, psm = F.concat(between(p, m), after(m), between(s, p)), F.concat(between(p, s), after(m), between(s, m))
    return made.withColumn("restored", F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("output")))
