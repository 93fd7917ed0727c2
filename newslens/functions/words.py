"""The bilingual tokeniser as column expressions.

ASCII texts need no normal form, and of other characters most decompose to one base character, which a table from
the Unicode data translates; Hangul syllables stay composed. Only a text with a character that decomposes to several
(a ligature, a fraction) or with single jamo goes to Python.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from .tokens import STEPS

_HANGUL = (0xAC00, 0xD7A3)
_JAMO = ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF))
_KOREAN = r"[\x{AC00}-\x{D7A3}]"
#: One-letter words that have two UTF-16 units, or two jamo.
_LONG_LETTER = r"^[\x{AC00}-\x{D7A3}\x{10000}-\x{10FFFF}]$"
_CONSONANTS = "bcdfghjklmnpqrstvwxyz"
_ELLIPSIS = ("…", "...")


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))


@lru_cache(maxsize=1)
def decomposition() -> tuple[str, str, str]:
    """Characters, what they decompose to (one character each; the last ones to none), and a class of the other ones."""
    one, gone, odd = [], [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or _HANGUL[0] <= code <= _HANGUL[1]:
            continue
        c = chr(code)
        bare = _bare(c)
        if any(a <= ord(x) <= b for x in bare for a, b in _JAMO):
            odd.append(code)
        elif bare == c or c == _ELLIPSIS[0]:
            continue
        elif not bare:
            gone.append(c)
        elif len(bare) == 1:
            one.append((c, bare))
        else:
            odd.append(code)
    ranges: list[list[int]] = []
    for code in odd:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(c for c, _ in one) + "".join(gone), "".join(b for _, b in one), "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def is_ascii(x: Column) -> Column:
    return F.length(x) == F.octet_length(x)


def needs_python(x: Column) -> Column:
    # the first class keeps ASCII characters from the many ranges of the second
    return ~is_ascii(x) & x.rlike(rf"[^\x00-\x7F](?<={decomposition()[2]})")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stem(t: Column) -> Column:
    """The first ending that fits, as :func:`tokens.stem_of`."""
    n = F.length(t)

    def cut(k: int) -> Column:
        last = F.substring(t, -k - 1, 1)
        doubled = (n > k + 1) & last.isin(*_CONSONANTS) & (last == F.substring(t, -k - 2, 1))
        left = n - k - F.when(doubled, 1).otherwise(0)
        return F.when(left >= 2, F.left(t, left)).otherwise(t)

    return (
        F.when((n > 7) & t.endswith("ations"), F.left(t, n - 6))
        .when((n > 5) & t.endswith("ings"), cut(4))
        .when((n > 4) & t.endswith("ing"), cut(3))
        .when((n > 4) & t.endswith("ed"), cut(2))
        .when((n > 4) & t.endswith("es"), F.left(t, n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.left(t, n - 1))
        .otherwise(t)
    )


def _looked_up(t: Column, names: dict[str, str], otherwise: Column) -> Column:
    by_value: dict[str, list[str]] = {}
    for k, v in names.items():
        by_value.setdefault(v, []).append(k)
    found = reduce(lambda w, kv: w.when(t.isin(*kv[1]), kv[0]), by_value.items(), F.when(F.lit(False), t))
    return F.when(t.isin(*names), found).otherwise(otherwise)


def _english(t: Column) -> Column:
    ends = F.substring(t, -1, 1).isin("s", "g", "d")
    stemmed = F.when(ends, _let(_stem(t), lambda s: _looked_up(s, schema.POST_STEM, s))).otherwise(_looked_up(t, schema.POST_STEM, t))
    return _looked_up(t, schema.ENGLISH_ALIAS, stemmed)


def _korean(t: Column) -> Column:
    bare = t
    for p in reversed(list(dict.fromkeys(schema.PARTICLES))):
        bare = F.when(t.endswith(p) & (F.length(t) > len(p)), F.left(t, F.length(t) - len(p))).otherwise(bare)
    return _let(bare, lambda b: _looked_up(b, schema.KOREAN_ALIAS, b))


def _stepped(text: Column) -> Column:
    """The text with single blanks between its words, after the tokeniser's patterns."""
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    return text


def _tokens(text: Column, long_word, canonical) -> Column:
    """Tokens of a text, word by word."""
    pairs = "|".join(f"{a} {b}" for a, b in schema.BIGRAMS)
    pair = rf"(?<![^ ])(?=(?:{pairs})(?![^ ]))([^ ]+) ([^ ]+)"
    words = F.filter(F.split(_stepped(text), " "), long_word)
    merged = _let(F.array_join(words, " "), lambda j: F.when(j == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(j, pair, "$1_$2"), " ")))
    return F.transform(merged, canonical)


#: Marks a word that keeps its form; no text holds it once its other characters are blanks.
_KEPT = "\x01"
_END = "(?![^ ])"


def _named(x: Column) -> Column:
    """Pairs as one word, with words of one letter between them left out, and aliases."""
    between = f"(?: [^ ]{_END})*"
    for a, b in schema.BIGRAMS:
        x = F.regexp_replace(x, f"{a}(?<![^ ]{a}){between} {b}{_END}", f"{a}_{b}")
    by_value: dict[str, list[str]] = {}
    for k, v in schema.ENGLISH_ALIAS.items():
        by_value.setdefault(v, []).append(k)
    for v, names in by_value.items():
        x = F.regexp_replace(x, f"(?<![^ ])(?:{'|'.join(names)}){_END}", v)
    return x


def _endings() -> str:
    """What :func:`_stem` cuts from the words of a text with single blanks between them; group 1 stays.

    Each ending begins with its own letters, followed by what must stand before it: a doubled consonant loses one, and
    no word is cut to one letter.
    """
    doubled = "|".join(2 * c for c in _CONSONANTS)
    return "|".join((
        rf"([{_CONSONANTS}])\1(?<=[^ ]..)(?:ings?|ed){_END}", rf"ations(?<=[^ ]{{2}}ations){_END}", rf"ing(?<=[^ ]{{2}}ing)(?<!(?:{doubled})ing)s?{_END}",
        rf"e[ds](?<=[^ ]{{3}}e[ds]){_END}", rf"s(?<=[^ ]{{3}}s)(?<!ss)(?<!(?<![^ ])(?:{doubled})ings){_END}",
    ))


def _ascii_tokens(text: Column) -> Column:
    """:func:`_tokens` with :func:`_english` by patterns over the whole text; words with an underscore are marked meanwhile."""
    names = "|".join(dict.fromkeys([*(a for a, _ in schema.BIGRAMS), *schema.ENGLISH_ALIAS]))
    x = _let(_stepped(text), lambda t: F.when(t.rlike(f"(?<![^ ])(?:{names}){_END}"), _named(t)).otherwise(t))
    x = F.regexp_replace(F.regexp_replace(x, "_[^ ]*", f"$0{_KEPT}"), _endings(), "$1")
    for k, v in schema.POST_STEM.items():
        x = F.regexp_replace(x, f"{k}(?<![^ ]{k}){_END}", v)
    return F.filter(F.split(F.replace(x, F.lit(_KEPT), F.lit("")), " "), lambda t: F.length(t) > 1)


def _decomposed(t: Column) -> Column:
    """The word with its Hangul syllables as jamo, by their arithmetic."""
    utf16 = lambda code: F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE")
    place = lambda c: F.ascii(c) - _HANGUL[0]
    lead, vowel, tail = (lambda c: F.floor(place(c) / 588) + 0x1100), (lambda c: F.floor(place(c) % 588 / 28) + 0x1161), (lambda c: place(c) % 28 + 0x11A7)
    jamo = lambda c: F.concat(utf16(lead(c)), utf16(vowel(c)), F.when(place(c) % 28 == 0, "").otherwise(utf16(tail(c))))
    return F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike(_KOREAN), jamo(c)).otherwise(c)), "")


def native_tokens(x: Column) -> Column:
    """Tokens of a lower-cased text without characters that need Python; words with an underscore are canonical as they are."""
    joined = lambda t: F.contains(t, F.lit("_"))
    ascii_ = _ascii_tokens(x)
    chars, bare, _ = decomposition()
    plain = F.translate(F.replace(x, F.lit(_ELLIPSIS[0]), F.lit(_ELLIPSIS[1])), chars, bare)
    korean = lambda t: F.when(joined(t), _decomposed(t)).otherwise(_korean(t))
    other = _tokens(
        plain, lambda t: (F.length(t) > 1) | t.rlike(_LONG_LETTER),
        lambda t: F.when(~is_ascii(t) & t.rlike(_KOREAN), korean(t)).when(joined(t), t).otherwise(_english(t)),
    )
    return F.when(is_ascii(x), ascii_).otherwise(other)
