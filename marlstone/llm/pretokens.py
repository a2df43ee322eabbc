"""Cutting texts into units that a byte-level tokenizer encodes independently of each other.

The public pre-token pattern starts a match at every single white-space character that stands between two others, so
a text cut in front of such spaces, and around such line ends, gives the same matches piece by piece.  Words repeat,
so a task encodes a distinct unit once.
"""

from __future__ import annotations

import re

import numpy as np

_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def units(text: str) -> list[str]:
    """Units whose concatenation is the text; words after a space keep it in front."""
    if not text:
        return []
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0].isspace() or text[-1].isspace() or (not text.isascii() or "\t" in text or "\r" in text) and _RUN.search(text):
        first, *rest = _CUT.split(text)  # runs of white space stay inside a unit
        return [first, *[" " + x for x in rest]]
    out = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        out.append(first)
        out += [" " + x for x in rest]
        out.append("\n")
    out.pop()
    return out


def _classes() -> np.ndarray:
    """0: ASCII white space, 1: letters and digits, 2: other ASCII, 3: bytes of other characters."""
    t = np.full(256, 3, np.uint8)
    t[:128] = 2
    t[[0x20, *range(0x09, 0x0E)]] = 0
    t[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
    return t


_CLASS = _classes()
_ODD_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3, *range(0x1C, 0x20)])
_ODD = re.compile(r"[\x1c-\x1f]|[^\S\x00-\x7f]")


def cuts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, all of which ByteLevel's pattern matches independently of each other.

    raw: UTF-8 bytes of the texts one behind the other, begins: where they begin (ascending, those of empty ones too).
    A match ends where white space begins; of a run of white space inside a text the last character stands alone, or
    before a word if it is a space.  Letters and digits end before other characters, and those before letters and
    digits, but for an apostrophe, which can begin a match with letters.  Other than ASCII characters are left where
    they stand.  Texts with other white space than ASCII are cut by units().
    """
    n = len(raw)
    kind = _CLASS[raw]
    cut = np.zeros(n + 1, bool)
    if n > 1:
        before, own = kind[:-1], kind[1:]
        blank = own == 0
        edge = blank & (before != 0)  # white space after a word
        last = blank & (before == 0)  # the last of a run
        last[:-1] &= own[1:] != 0
        ends = begins[(begins > 1) & (begins <= n)] - 2
        last[ends] = False  # at a text's end the run is one match
        last[-1] = False
        word = ~blank & (before == 0) & (raw[:-1] != 0x20)
        marks = (before == 1) & (own == 2) | (before == 2) & (own == 1) & (raw[:-1] != 0x27)
        cut[1:n] = edge | last | word | marks
    cut[begins] = True
    odd = np.flatnonzero(_ODD_LEAD[raw])
    for k in np.unique(np.searchsorted(begins, odd, "right") - 1).tolist():
        a, z = int(begins[k]), int(begins[k + 1]) if k + 1 < len(begins) else n
        text = raw[a:z].tobytes().decode("utf-8", "surrogatepass")
        if _ODD.search(text):
            cut[a + 1 : z] = False
            cut[a + np.cumsum([0, *(len(u.encode("utf-8", "surrogatepass")) for u in units(text))])[:-1]] = True
    return np.flatnonzero(cut[:n])
