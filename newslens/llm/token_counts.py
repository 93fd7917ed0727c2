"""Token counts: a linear longest-match automaton gives greedy word-piece lengths without pieces.

The vocabulary's trie has a failure link and a popped-token count at every node: where the text
leaves the trie, the count says how many tokens the longest matches before the failure node make.
Each character is read once and no piece is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_letters, default_path
from .common import bounded_batches, table

#: Counts of words that one Python worker remembers, at most, and the longest word remembered.
MEMORY, MEMORY_WORD = 500_000, 64


class LongestMatch:
    """Greedy longest-match counts over bytes: a word's first token is one of ``starts``, the others of
    ``parts``. A word that they can't cover is one unknown token."""

    def __init__(self, starts: set[bytes], parts: set[bytes]):
        # node 0: before a word; node 1: inside a word, where its next token begins
        self.next: list[dict[int, int]] = [{}, {}]
        token: list[bool] = [False, False]
        for root, words in ((0, starts), (1, parts)):
            for w in words:
                at = root
                for byte in w:
                    if byte not in self.next[at]:
                        self.next[at][byte] = len(self.next)
                        self.next.append({})
                        token.append(False)
                    at = self.next[at][byte]
                if w:
                    token[at] = True
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for byte, child in self.next[node].items():
                    below.append(child)
                    if token[child]:
                        self.fail[child], self.pops[child] = 1, 1
                        continue
                    at, n = self.fail[node], self.pops[node]
                    while at >= 0 and byte not in self.next[at]:
                        n += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = self.next[at][byte], n
            level = below
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of one word, negative for one that has no cover (one unknown token)."""
        next_, fail, pops = self.next, self.fail, self.pops
        at, n = 0, 0
        for byte in word:
            while byte not in next_[at]:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = next_[at][byte]
        while at > 1:
            n += pops[at]
            at = fail[at]
        return n if at == 1 else -1

    def counts(self, words: list[bytes]) -> tuple[int, int]:
        """Tokens and unknown words of a text's words."""
        known, total, unknown = self.known, 0, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= MEMORY_WORD:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[w] = n
            if n < 0:
                unknown += 1
                total += 1
            else:
                total += n
        return total, unknown


def word_pieces(path: str) -> tuple[set[bytes], set[bytes]]:
    """Word starts and word parts of a byte-level vocabulary file: tokens with and without a leading blank."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"]}
    raw = [bytes(letters[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    return {t[1:] for t in raw if t[:1] == b" " and len(t) > 1}, {t for t in raw if b" " not in t}


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(*word_pieces(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Adds n_words, n_tokens and n_unknown (long) to every document.

    Words are the runs outside ASCII white space; n_tokens is the number of greedy longest-match pieces,
    a word without a cover being one (unknown) token. Null and empty texts have 0 of each; texts and
    words of any length are read whole; repeated rows are counted one by one; an empty table gives an
    empty result; further columns pass through (those with an added one's name are replaced).
    """
    where = path or default_path()
    bounded_batches(docs.sparkSession)
    added = ["n_words", "n_tokens", "n_unknown"]
    kept = docs.drop(*added)
    names = kept.columns
    spec = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{c} bigint" for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = automaton(where)
        for batch in batches:
            rows = []
            for text in batch.column(names.index("text")):
                words = (text.as_py() or "").encode().split()
                rows.append((len(words), *m.counts(words)))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*names, *added])

    return kept.mapInArrow(run, spec)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: one row per document."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
