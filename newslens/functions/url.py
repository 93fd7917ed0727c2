"""Address normalisation: plain addresses by expressions, others by an Arrow UDF with the rules of RFC 2396."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from .text import trim_control

#: Addresses whose parts need no decoding or quoting and whose host is an ordinary name.
PLAIN = r"^https?://[A-Za-z](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?:/[A-Za-z0-9._~/-]*)?(?:\?[A-Za-z0-9._~=&-]*)?(?:#[A-Za-z0-9._~/-]*)?$"

_UNRESERVED = "A-Za-z0-9_.!~*'()-"
_LEGAL = re.compile(rf"(?:[{_UNRESERVED};/?:@&=+$,\[\]]|%[0-9A-Fa-f]{{2}}|[^\x00-\x7f\x80-\x9f\s])*")
_QUERY = r";/?:@&=+$,\[\]"
_PARTS = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", re.S)
_HOST = re.compile(r"(?:(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[0-9A-Fa-f:.]+(?:%\w+)?\])")
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _decode(s: str) -> str:
    return _ESCAPED.sub(lambda m: bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace"), s)


def _quote(s: str, legal: str) -> str:
    """Characters outside the legal ones as escapes; ``%`` always."""
    ok = re.compile(rf"[{_UNRESERVED}{legal}]|[^\x00-\x9f\s]")
    return "".join(c if ok.match(c) else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s)


def clean_query(query: str | None) -> str:
    """Parameters that are neither blank nor tracking keys, in order; an argument without a key is an error."""
    kept = []
    for p in (query or "").split("&"):
        if not p.strip():
            continue
        if not p.strip("="):
            raise ValueError("no key")
        if p.split("=")[0].lower() not in schema.TRACKING_KEYS:
            kept.append(p)
    return "&".join(kept)


def normalize_one(raw: str | None) -> str | None:
    """https, host, path without one trailing slash, query without tracking keys, in lower case; the trimmed
    lower-case text where the address has no such form."""
    if raw is None:
        return None
    strip = "".join(map(chr, range(33)))
    text = raw.strip(strip)
    try:
        body, hash_, fragment = text.partition("#")
        if not text or not _LEGAL.fullmatch(body) or hash_ and not _LEGAL.fullmatch(fragment):
            raise ValueError("illegal character")
        scheme, rest = _PARTS.fullmatch(body).groups()
        if scheme is None and ":" in re.split(r"[/?]", rest)[0]:
            raise ValueError("no scheme name")
        if scheme is not None and not rest:
            raise ValueError("nothing after the scheme")
        host, path, query = None, None, None
        if not (scheme and not rest.startswith("/")):  # else opaque: no host, path or query
            location, mark, query_text = rest.partition("?")
            query = _decode(query_text) if mark else None
            if location.startswith("//"):
                authority, slash, tail = location[2:].partition("/")
                path = slash + tail
                if not authority and not path:
                    raise ValueError("no authority")
                name = re.sub(r":[0-9]*$", "", authority.rpartition("@")[2])
                host = name if _HOST.fullmatch(name) else None
            else:
                path = location
            path = _decode(path)
        path = "" if path in (None, "/") else path[:-1] if path.endswith("/") else path
        query = clean_query(query)
        path = path or "/"
        if not path.startswith("/"):
            raise ValueError("a relative path")
        out = "https:" + (f"//{host}" if host is not None else "") + _quote(path, "/:@&=+$,;") + (f"?{_quote(query, _QUERY)}" if query else "")
        return out.lower()
    except ValueError:
        return raw.lower().strip(strip)


@F.pandas_udf(T.StringType())
def _normalized(x: pd.Series) -> pd.Series:
    return x.map(normalize_one)


@F.pandas_udf(T.StringType())
def sql_normalize_url(x: pd.Series) -> pd.Series:
    """:func:`normalize_url` for SQL."""
    return x.map(normalize_one)


def plain_url(x: Column) -> Column:
    """:func:`normalize_one` of an address that fits PLAIN."""
    path = F.regexp_replace(F.regexp_extract(x, r"^https?://[^/?#]*([^?#]*)", 1), "/$", "")
    query = F.split(F.regexp_extract(x, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.filter(query, lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*schema.TRACKING_KEYS)), "&")
    host = F.regexp_extract(x, "^https?://([^/?#]*)", 1)
    return F.lower(F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def normalize_url(x: Column) -> Column:
    """Normalised address. Plain ones stay in the JVM; the UDF gets null for them."""
    t = trim_control(x)
    # a parameter of '=' only has no key and takes the exact path
    plain = t.rlike(PLAIN) & ~t.rlike(r"[?&]=+(?:&|#|$)")
    return F.when(plain, plain_url(t)).otherwise(_normalized(F.when(~plain, x)))
