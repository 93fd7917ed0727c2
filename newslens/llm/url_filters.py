"""URL filters: a Bloom filter cascade gives exact rule membership for every page without joins.

The corpus's complete key universe (every rule-shaped key of every URL) is known, so level 1
encodes the listed keys, level 2 the universe's keys that pass level 1 wrongly, level 3 the listed
keys that pass level 2 wrongly, and so on until no false positive is left. A key's first failing
level then tells exactly whether it is listed. Only DataFrame functions run on the executors.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, long_array, stash, table

#: (verdict, host, path prefix): fixed values of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of a host's name that block it where no rule fits: kinds of sites that no corpus wants. A parameter.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "gambling", "malware", "phishing", "pills", "porn", "spam", "torrents", "warez", "xxx")
#: Listed keys of one cascade that is part of the plan as a constant, and of one part of a cascade that is a table: a list
#: of any length is cut into parts by a hash.
MAX_LISTED = 1_000_000


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]

    def passes(self, key: Column, seed: int) -> Column:
        return _passes(long_array(list(self.words)), key, seed, self.bits, self.hashes)


_POWERS = [1 << i if i < 63 else -(1 << 63) for i in range(64)]


def _position(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits).cast("long"))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter for ``keys`` (n rows, bounded by MAX_LISTED in expectation)."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    spots = F.explode(F.array(*[_position(F.col("key"), seed, i, bits) for i in range(hashes)]))
    bit = F.get(long_array(_POWERS), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    got = keys.select(spots.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("x")).collect()
    words = [0] * (bits // 64 + 1)
    for r in got:
        words[r["w"]] = r["x"]
    return Level(bits, hashes, tuple(words))


def _listed(spark: SparkSession, keys: list[str]) -> DataFrame:
    array = F.from_json(F.lit(json.dumps(keys)), "array<string>")
    return spark.range(1).select(F.explode(array).alias("key"))


def build_cascade(universe: DataFrame, keys: list[str]) -> list[Level]:
    """Levels for ``keys`` (a list of at most MAX_LISTED; longer ones go to :func:`listed_by_table`) over ``universe``
    (distinct column key)."""
    keys = sorted(set(keys))
    if not keys:
        return []
    listed = _listed(universe.sparkSession, keys)
    others = universe.join(F.broadcast(listed), "key", "left_anti")
    n_others = others.count()
    levels: list[Level] = []
    inside, outside, n = listed, others, len(keys)
    rate = _first_rate(n, n_others)
    while n:
        level = _level(inside, n, rate, len(levels))
        passing = outside.where(level.passes(F.col("key"), len(levels)))
        levels.append(level)
        inside, outside = passing, inside
        n, rate = passing.count(), 0.5
    return levels


def _first_rate(n: int, n_others: int) -> float:
    """About as many false positives of level 1 as listed keys, then halves: the levels shrink geometrically."""
    return min(0.5, n / (math.sqrt(2) * max(n_others, 1)))


def listed_by_table(universe: DataFrame, listed: DataFrame, per_part: int = MAX_LISTED) -> DataFrame:
    """``universe`` (key) with ``listed``, whether its key is one of ``listed`` (key), for lists of any length.

    Keys are cut into parts by a hash, with a cascade for each part; the cascades are a table of a row for each part,
    which goes to the keys by the number of the part.
    """
    keys = listed.select("key").where("key IS NOT NULL").distinct()
    n = keys.count()
    parts = max(1, -(-n // per_part))
    part = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts)).cast("int").alias("part")
    all_keys = stash(universe.select("key", part))
    inside = stash(keys.select("key", part))
    outside = stash(all_keys.join(inside, ["key", "part"], "left_anti").distinct())
    table_of, shapes = None, []
    rate = _first_rate(n, outside.count())
    while True:
        most = inside.groupBy("part").count().agg(F.max("count").alias("n")).first()["n"]
        if not most:
            break
        i, hashes = len(shapes), max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(most * hashes / math.log(2)))
        spots = F.explode(F.array(*[_position(F.col("key"), i, k, bits) for k in range(hashes)]))
        bit = F.get(long_array(_POWERS), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
        set_ = inside.select("part", spots.alias("p")).groupBy("part", F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("x"))
        every = universe.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bits // 64).cast("long"))).alias("w"))
        dense = every.join(set_, ["part", "w"], "left").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("x", F.lit(0)).alias("x")))).alias("l"))
        level = stash(dense.select("part", F.col("l.x").alias(f"level{i}")))
        shapes.append((bits, hashes))
        table_of = level if table_of is None else table_of.join(level, "part")
        passing = stash(outside.join(level, "part").where(_passes(F.col(f"level{i}"), F.col("key"), i, bits, hashes)).select("key", "part"))
        inside, outside, rate = passing, inside, 0.5
    if table_of is None:
        return all_keys.select("key", F.lit(False).alias("listed"))
    out = F.lit(len(shapes) % 2 == 1)
    for i in range(len(shapes) - 1, -1, -1):
        out = F.when(_passes(F.col(f"level{i}"), F.col("key"), i, *shapes[i]), out).otherwise(F.lit(i % 2 == 1))
    return all_keys.join(stash(table_of), "part").select("key", out.alias("listed"))


def _passes(array: Column, key: Column, seed: int, bits: int, hashes: int) -> Column:
    ok = F.lit(True)
    for k in range(hashes):
        p = _position(key, seed, k, bits)
        word = F.get(array, F.shiftright(p, 6).cast("int"))
        ok = ok & (word.bitwiseAND(F.get(long_array(_POWERS), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return ok


def member(key: Column, levels: list[Level]) -> Column:
    """Exact membership for keys of the universe: decided by the first level that the key fails."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].passes(key, i), out).otherwise(F.lit(i % 2 == 1))
    return out


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased; empty for null or a text without ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    """The path, without query and fragment; empty where the host is."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host and path of ``url`` (columns of these names are replaced)."""
    return pages.select(*[c for c in pages.columns if c not in ("host", "path")], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))


def _suffixes(host: Column, labels: int) -> Column:
    """The host's last 1..labels labels: the hosts that a rule of so many labels can name."""
    return F.array_distinct(F.array(*[F.substring_index(host, ".", -i) for i in range(labels, 0, -1)]))


def _rule_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every host suffix with every path prefix of a rule's length; longest first."""
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(_suffixes(host, labels), lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    order = F.sort_array(F.transform(pairs, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.transform(order, lambda x: x["key"])


def _words_of(host: Column) -> Column:
    return F.array_distinct(F.filter(F.split(host, "[.-]"), lambda w: w != ""))


def url_filters(pages: DataFrame, rules: tuple | DataFrame = RULES, blocked_words: tuple = BLOCKED_WORDS) -> DataFrame:
    """Adds host, path, rule (host + path prefix of the longest fitting rule, else null) and verdict.

    ``rules`` are (verdict, host, path prefix), as a tuple or, however many, as a table of these columns. Without a
    fitting rule the verdict is block if a word of the host is one of ``blocked_words``, else allow. Null or odd URLs
    have empty host and path, no rule, and are allowed. Repeated rows are judged alike; an empty table gives an empty
    result; other columns pass through (those named host, path, rule, verdict are replaced). If two rules of one
    length fit, the smaller string wins; a key that is in both lists is blocked.
    """
    if isinstance(rules, DataFrame) or len(rules) > MAX_LISTED:
        given = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
        return _by_table(pages, given, blocked_words)
    labels = max([len(h.split(".")) for _, h, _ in rules], default=1)
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    rows = with_host_path(pages)
    places = stash(rows.select("host", "path").distinct())
    keys = stash(places.select(F.explode(_rule_keys(F.col("host"), F.col("path"), labels, lengths)).alias("key")).distinct())
    allow = build_cascade(keys, [h + p for v, h, p in rules if v == "allow"])
    block = build_cascade(keys, [h + p for v, h, p in rules if v == "block"])

    def judged(all_keys: Column) -> Column:
        hit = F.transform(all_keys, lambda k: F.struct(k.alias("rule"), F.when(member(k, block), F.lit("block")).when(member(k, allow), F.lit("allow")).alias("verdict")))
        return F.get(F.filter(hit, lambda x: x["verdict"].isNotNull()), F.lit(0))

    hit = let(_rule_keys(F.col("host"), F.col("path"), labels, lengths), judged)
    held = [c for c in rows.columns if c not in ("rule", "verdict")]
    judged = rows.select(F.struct(*held).alias("page"), hit.alias("hit"), _by_words(places, blocked_words).alias("other"))
    return judged.select("page.*", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "other").alias("verdict"))


def _by_words(places: DataFrame, blocked_words: tuple) -> Column:
    """The verdict on a host by its words."""
    host_words = stash(places.select(F.explode(_words_of(F.col("host"))).alias("key")).distinct())
    bad = build_cascade(host_words, list(blocked_words))
    return F.when(F.exists(_words_of(F.col("host")), lambda w: member(w, bad)), "block").otherwise("allow")


def _by_table(pages: DataFrame, rules: DataFrame, blocked_words: tuple) -> DataFrame:
    """:func:`url_filters` for rules in a table: each place of the corpus is judged once, by its keys."""
    known = stash(rules.select("verdict", "host", "path", F.concat("host", "path").alias("key")).where("key IS NOT NULL"))
    shape = known.agg(F.max(F.size(F.split("host", "[.]"))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 1, sorted(shape["lengths"] or [0], reverse=True)
    rows = with_host_path(pages)
    places = stash(rows.select("host", "path").distinct())
    of_place = stash(places.select("host", "path", F.explode(_rule_keys(F.col("host"), F.col("path"), labels, lengths)).alias("key")))
    keys = stash(of_place.select("key").distinct())
    found = None
    for verdict in ("block", "allow"):
        flags = listed_by_table(keys, known.where(F.col("verdict") == verdict)).withColumnRenamed("listed", verdict)
        found = flags if found is None else found.join(flags, "key")
    hits = stash(found.where("block OR allow").select("key", F.when(F.col("block"), "block").otherwise("allow").alias("verdict")))
    best = F.min(F.struct((-F.length("key")).alias("n"), F.col("key").alias("rule"), "verdict"))
    judged = of_place.join(hits, "key").groupBy("host", "path").agg(best.alias("hit"))
    judged = judged.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "hit")
    held = [c for c in rows.columns if c not in ("rule", "verdict")]
    packed = rows.select("host", "path", F.struct(*held).alias("page"))
    joined = packed.join(judged, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    return joined.select("page.*", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", _by_words(places, blocked_words)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: one row per page."""
    return url_filters(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _oracle() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    bad = "list_has_any(regexp_split_to_array(host, '[.-]'), [" + ", ".join(f"'{w}'" for w in BLOCKED_WORDS) + "])"
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url,
  translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT b.page_id, b.url, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS v
  FROM b JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY b.page_id, b.url)
SELECT b.page_id, host, path, c.rule AS rule,
  coalesce(c.v, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN c ON b.page_id IS NOT DISTINCT FROM c.page_id AND b.url IS NOT DISTINCT FROM c.url"""


ORACLE = _oracle()
