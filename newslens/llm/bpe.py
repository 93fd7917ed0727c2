"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can end its encoding. An automaton over the
vocabulary yields the tokens that are suffixes of a prefix, longest first; the first one that is
compatible with the stored last token of the prefix before it is the last token of this prefix.
Following the stored tokens back from the end gives the exact ids, in time linear in the piece.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table

#: The pre-tokenizer's pieces of a text (fixed value of byte-level BPE).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank that follows no white space, and one that does.
BLANK, SPACE_BLANK = re.compile(r"(?<!\s) "), re.compile(r"\s ")
#: Encoded pieces (and chunks of pieces) that one Python worker remembers, at most, the longest, and tested pairs.
MEMORY, MEMORY_PIECE, PAIRS = 250_000, 64, 250_000
#: Rows of an output batch.
BATCH_ROWS = 512


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, byte strings and merge ranks of a byte-level BPE file, and the automaton over its tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.text_of |= {i: t.encode() for t, i in self.special.items()}
        ids = {b: i for i, b in self.text_of.items() if i not in self.special.values()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left id, right id) → rank of the merge
        self.rank: dict[tuple[int, int], int] = {}
        #: token id → the pair it is merged from
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = ids[raw(a)], ids[raw(b)]
            self.rank.setdefault(pair, r)
            self.halves.setdefault(ids[raw(a) + raw(b)], pair)
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            if len(b) == 1 or i in self.halves:
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.split = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        texts = [self.text_of.get(i, b"") for i in range(max(self.text_of) + 1)]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(texts), np.uint8)
        self.pairs: dict[int, bool] = {}
        self.memory = MEMORY

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at the token's right (1) or left (0) edge while it is built, with the rank of
        the merge that ends each; the token itself is never merged."""
        out, end = [], math.inf
        while True:
            out.append((token, end))
            if token not in self.halves:
                return out
            end = self.rank[self.halves[token]]
            token = self.halves[token][side]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side: no merge across their border comes before the
        merges that build them. Of equal ranks the left one is first: it wins against one in ``b`` and loses
        against one in ``a``."""
        right = self._edge(b, 0)
        for x, x_end in self._edge(a, 1):
            for y, y_end in right:
                r = self.rank.get((x, y))
                if r is not None and r < x_end and r <= y_end:
                    return False
        return True

    def _tested(self, a: int, b: int) -> bool:
        """:meth:`_compatible`, remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fits = self.pairs[a << 32 | b] = self._compatible(a, b)
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        last, size, done = [-1] * (len(piece) + 1), [0] * (len(piece) + 1), -1
        known = self.pairs.get
        for end, (token, n) in self.automaton.iter(piece.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - n
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = known(before << 32 | token)
                if not (self._tested(before, token) if fits is None else fits):
                    continue
            last[end + 1], size[end + 1], done = token, n, end
        ids, at = [], len(piece)
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary doesn't cover every byte")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _piece(self, piece: str) -> bytes:
        got = self.encode_piece(piece.encode())
        out = struct.pack(f"<{len(got)}I", *got)
        if len(piece) <= MEMORY_PIECE:
            if len(self.pieces) >= self.memory:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def _chunk(self, chunk: str) -> bytes:
        known, new = self.pieces.get, self._piece
        pieces = self.split(chunk)
        if len(pieces) == 1:  # most words; remembered once, as a chunk
            got = self.encode_piece(chunk.encode())
            out = struct.pack(f"<{len(got)}I", *got)
        else:
            out = b"".join([known(p) or new(p) for p in pieces])
        if len(chunk) <= MEMORY_PIECE:
            if len(self.chunks) >= self.memory:
                self.chunks.clear()
            self.chunks[chunk] = out
        return out

    def _plain(self, text: str) -> list[bytes]:
        """A blank that follows no white space starts a piece, whatever comes before it: what lies between
        such blanks is encoded by itself and remembered."""
        known, new = self.chunks.get, self._chunk
        first, *rest = BLANK.split(text) if SPACE_BLANK.search(text) else text.split(" ")
        if not first and rest:  # the text starts with a blank
            out = []
        else:
            out = [known(first) or new(first)]
        return out + [known(c) or new(c) for c in [" " + r for r in rest]]

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.cut(text) if self.cut else (text,):
            out += [struct.pack("<I", self.special[part])] if part in self.special else self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        i = np.frombuffer(ids, "<u4")
        n = self.lengths[i]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int64) + np.repeat(self.starts[i] - (ends - n), n)
        return self.letters[at].tobytes().decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = False, text: bool = True, remembered: int = MEMORY) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to every document; with ``ids`` also ``ids``, the
    packed ids (little-endian unsigned 32-bit); without ``text`` the text itself is left out. ``remembered`` bounds the
    pieces (and chunks of pieces) that a worker keeps: fewer take less memory and more time.

    ``path`` names the tokenizer file on every executor. Null and empty texts give no ids. Texts and
    pieces of any length are encoded whole; repeated rows are encoded one by one; an empty table gives
    an empty result; further columns pass through (those with an added one's name are replaced).
    """
    where = path or default_path()
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*added)
    names = kept.columns
    passed = [k for k, name in enumerate(names) if text or name != "text"]
    out = [*(names[k] for k in passed), *added]
    spec = ", ".join([*(f"`{kept.schema[k].name}` {kept.schema[k].dataType.simpleString()}" for k in passed), SCHEMA, *["ids binary"] * ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(where)
        v.memory = remembered
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                n, h, d, raw = [], [], [], []
                for x in batch.column(names.index("text")):
                    packed = v.encode(x.as_py() or "")
                    n.append(len(packed) // 4)
                    h.append(hashlib.sha256(packed).hexdigest())
                    d.append(hashlib.sha256(v.decode(packed).encode()).hexdigest())
                    raw.append(packed if ids else None)
                cols = [pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string()), *[pa.array(raw, pa.binary())] * ids]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed), *cols], names=out)

    return kept.mapInArrow(run, spec)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: one row per document."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False)
