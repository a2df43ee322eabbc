"""Operator 3: counts of greedy longest-match word pieces, in time linear in the text, without building the pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.common import Memo, bounded, documents

_WORD = re.compile(r"\w+|[^\w\s]")


class LongestMatch:
    """Trie of the vocabulary with failure links; a failure link carries how many pieces it pops.

    Word-initial pieces start at the root, later ones at a second root.  When a node has no edge for the next
    character, the longest match so far is given out and the rest of what was read is matched again; where that ends
    and how many pieces it gives depends on the node alone, so both are computed once.  A node without a failure link
    can't be completed: the word is unknown and counts as one.
    """

    def __init__(self, first: list[str], later: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        self.fail, self.popped = [-1, -1], [0, 0]
        ends = [False, False]
        parent: list[tuple[int, str, int]] = [(-1, "", 0), (-1, "", 1)]
        for root, words in ((0, first), (1, later)):
            for w in words:
                at = root
                for c in w:
                    to = self.edges[at].get(c)
                    if to is None:
                        to = self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                        ends.append(False)
                        parent.append((at, c, root))
                    at = to
                if w:
                    ends[at] = True
        queue = [x for root in (0, 1) for x in self.edges[root].values()]
        while queue:  # breadth first: failure links lead to shallower nodes
            after = []
            for v in queue:
                after.extend(self.edges[v].values())
                up, c, _ = parent[v]
                if ends[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[up], self.popped[up]
                while z != -1 and c not in self.edges[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z != -1:
                    self.fail[v], self.popped[v] = self.edges[z][c], n
            queue = after

    def count(self, word: str) -> int:
        at = pieces = 0
        edges, fail, popped = self.edges, self.fail, self.popped
        for c in word:
            while True:
                to = edges[at].get(c)
                if to is not None:
                    at = to
                    break
                pieces += popped[at]
                at = fail[at]
                if at == -1:
                    return 1
        while at != 1:  # the end: give out what was read
            pieces += popped[at]
            at = fail[at]
            if at == -1:
                return 1
        return pieces


def vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    """Word-initial and later pieces of a sentencepiece model; control and byte pieces stay out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    every = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return [p[1:] for p in every if p[0] == "▁" and len(p) > 1], [p for p in every if p[0] != "▁"]


@lru_cache(maxsize=2)
def _counter(model_path: str) -> tuple[LongestMatch, Memo]:
    automaton = LongestMatch(*vocabulary(model_path))

    def compute(new: list[str]) -> list[int]:
        """Of strings without white space, which may hold several words and punctuation marks."""
        return [sum(automaton.count(w) for w in _WORD.findall(x)) for x in new]

    return automaton, Memo(compute, 400_000)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words (strings between white space), n_tokens of each whole text.

    Such a string is cut into runs of word characters and single other characters, which are segmented one by one; one
    with no segmentation counts as one.  Null and empty texts: 0 and 0.  One row for each row; narrow, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _counter(model_path)
        for b in batches:
            words, tokens = [], []
            for texts in bounded(x.as_py() for x in b["text"]):
                own = [t.split() for t in texts]
                known = memo.known(set().union(*own))
                words += map(len, own)
                tokens += (sum(map(known.__getitem__, x)) for x in own)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
