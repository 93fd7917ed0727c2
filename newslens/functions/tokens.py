"""The bilingual tokeniser in Python, for texts that :mod:`words` can't take; canonical forms are kept by word, which repeat."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex

from .. import schema

# Word borders are ASCII ones.
_NO_WORD_AFTER = "(?![0-9A-Za-z_])"
_SPACE = r"[ \t\n\x0B\f\r]"
#: Patterns and what replaces them, in order; Java and Python read them alike. Each begins with the characters it takes, not with
#: what must stand before them, so that a search passes over other ones quickly.
STEPS = (
    (r"\.(?<=\p{L}\.)(?=\p{L})", ""),
    ("[\\u2019'](?:s" + _NO_WORD_AFTER + r"|(?<=[sS][’'])(?=" + _SPACE + "|$))", ""),
    (r"[0-9]+(?:\.[0-9]+)?" + _SPACE + r"*(?:%|percent(?:age(?:" + _SPACE + r"+points?)?)?)", "NUM_PCT"),
    (r"[12](?<![0-9A-Za-z_][12])(?:(?<=1)9|(?<=2)0)[0-9]{2}" + _NO_WORD_AFTER, "NUM_YEAR"),
    (r"[0-9](?<![0-9A-Za-z_][0-9])[0-9]*(?:[,.][0-9]+)*" + _NO_WORD_AFTER, "NUM"),
    (r"[^\p{L}0-9_]+", " "),
)
_STEPS = tuple((regex.compile(p), r) for p, r in STEPS)
_KOREAN = regex.compile("[\\uAC00-\\uD7A3\\u1100-\\u11FF\\u3130-\\u318F]")
_DOUBLED = regex.compile(r"([b-df-hj-np-tv-z])\1$")
_PARTICLES = tuple(dict.fromkeys(schema.PARTICLES))
_HEADS: dict[str, set[str]] = {}
for _first, _second in schema.BIGRAMS:
    _HEADS.setdefault(_first, set()).add(_second)


def _cut(t: str, n: int) -> str:
    base = _DOUBLED.sub(r"\1", t[:-n])
    return base if len(base) >= 2 else t


def stem_of(t: str) -> str:
    """The first rule that fits."""
    n = len(t)
    if n > 7 and t.endswith("ations"):
        return t[:-6]
    if n > 5 and t.endswith("ings"):
        return _cut(t, 4)
    if n > 4 and t.endswith("ing"):
        return _cut(t, 3)
    if n > 4 and t.endswith("ed"):
        return _cut(t, 2)
    if n > 4 and t.endswith("es"):
        return t[:-2]
    return t[:-1] if n > 3 and t.endswith("s") and not t.endswith("ss") else t


@lru_cache(maxsize=200_000)
def canonical(t: str) -> str:
    """A word's alias, or its form without particle or ending."""
    if "_" in t:
        return t
    t = unicodedata.normalize("NFC", t)
    if _KOREAN.search(t):
        bare = next((t[: -len(p)] for p in _PARTICLES if t.endswith(p) and len(t) > len(p)), t)
        return schema.KOREAN_ALIAS.get(bare, bare)
    stemmed = stem_of(t)
    return schema.ENGLISH_ALIAS.get(t) or schema.POST_STEM.get(stemmed, stemmed)


def tokens_of(text: str | None) -> list[str]:
    """Canonical tokens of a lower-cased text in order, with repeats; none for null or blank text."""
    if not text or not text.strip():
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))
    for pattern, by in _STEPS:
        text = pattern.sub(by, text)
    words = [t for t in text.split(" ") if len(t) > 1 or t > "￿"]  # a letter beyond U+FFFF has two UTF-16 units
    out, i = [], 0
    while i < len(words):
        t = words[i]
        if t in _HEADS and i + 1 < len(words) and words[i + 1] in _HEADS[t]:
            out.append(f"{t}_{words[i + 1]}")
            i += 2
        else:
            out.append(canonical(t))
            i += 1
    return out


def tokens_of_series(x: pd.Series) -> pd.Series:
    return x.map(tokens_of)
