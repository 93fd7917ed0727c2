"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from .tokens import tokens_of_series
from .words import native_tokens, needs_python

# Replaced in this order.
ENTITIES = (("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
PUNCTUATION = r"[!-/:-@\[-`{-~]"
_SPACE = r"[ \t\n\x0B\f\r]"


def trim_control(x: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(x: Column) -> Column:
    """Null, empty or white space only."""
    return x.isNull() | ~x.rlike(r"[^\s\x1C-\x1F]")


def normalize_headline(x: Column) -> Column:
    """Lower case, ASCII punctuation as blanks, runs of two or more white-space characters as one blank; null → ''."""
    bare = F.regexp_replace(F.lower(x), PUNCTUATION, " ")
    return F.coalesce(trim_control(F.regexp_replace(bare, _SPACE + "{2,}", " ")), F.lit(""))


def _decoded(x: Column) -> Column:
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return trim_control(F.regexp_replace(x, _SPACE + "{2,}", " "))


def sanitize_text(x: Column) -> Column:
    """Decodes the six entities (``&amp;lt;`` becomes ``<``), joins white space, trims; tags stay."""
    return _decoded(x)


def sanitize_html(x: Column) -> Column:
    """Like :func:`sanitize_text` without tags; blank results are null."""
    out = _decoded(F.replace(F.regexp_replace(x, "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")))
    return F.when(is_blank(x) | is_blank(out), F.lit(None)).otherwise(out)


def dedupe_key(publisher: Column, normalized_headline: Column, published_at: Column) -> Column:
    """sha256 of lower-case publisher, headline and ISO date or ``unknown``, joined by ``|``."""
    day = F.coalesce(F.date_format(published_at, "yyyy-MM-dd"), F.lit("unknown"))
    return F.sha2(F.concat(F.lower(publisher), F.lit("|"), normalized_headline, F.lit("|"), day), 256)


def strip_particle(x: Column) -> Column:
    """Without the first listed particle that is a proper suffix."""
    out = x
    for p in reversed(list(dict.fromkeys(schema.PARTICLES))):
        out = F.when(x.endswith(p) & (F.length(x) > len(p)), F.left(x, F.length(x) - len(p))).otherwise(out)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(x: pd.Series) -> pd.Series:
    return tokens_of_series(x)


@F.pandas_udf(T.ArrayType(T.StringType()))
def sql_tokenize(x: pd.Series) -> pd.Series:
    """:func:`tokenize` for SQL."""
    return tokens_of_series(x.str.lower())


def tokenize(x: Column) -> Column:
    """Canonical tokens in order, with repeats; none for null or blank text. Only texts whose characters need it leave the JVM."""
    text = F.lower(x)
    odd = needs_python(text)
    return F.when(is_blank(x), F.array().cast("array<string>")).when(odd, _tokens(F.when(odd, text))).otherwise(native_tokens(text))


def anchor_tokens(tokens: Column) -> Column:
    """Distinct tokens that anchor a story."""
    return F.array_intersect(F.array_distinct(tokens), F.array(*[F.lit(a) for a in schema.ANCHORS]))


def ascii_tokens(x: Column) -> Column:
    """Plain variant for ASCII text: lower-case runs of letters and digits of two or more characters."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)
