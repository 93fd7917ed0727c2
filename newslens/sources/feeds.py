"""Feeds: the dimension, XML feeds, JSON batches, error classes and the JSON sink."""

from __future__ import annotations

import json
import os
import socket
import urllib.request
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.text import is_blank
from ..operators.numbering import with_running

_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "link", "pubDate", "updated", "content")] + [
    T.StructField("guid", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_isPermaLink", T.StringType())])),
    T.StructField("encoded", T.StringType()),
])
_CHANNEL = T.StructType([T.StructField("title", T.StringType()), T.StructField("lastBuildDate", T.StringType()), T.StructField("pubDate", T.StringType()), T.StructField("item", T.ArrayType(_ITEM))])
_TEXT = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_type", T.StringType())])
_LINK = T.StructType([T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())])
_ENTRY = T.StructType([
    T.StructField("title", _TEXT), T.StructField("link", T.ArrayType(_LINK)), T.StructField("id", T.StringType()), T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()), T.StructField("summary", _TEXT), T.StructField("content", _TEXT),
])
_FEED = T.StructType([T.StructField("updated", T.StringType()), T.StructField("entry", T.ArrayType(_ENTRY))])
RFC822 = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")


def feed_dimension(spark: SparkSession) -> DataFrame:
    """The feeds in order: place, publisherCode, publisherName, country, politicalLeaning, category, feed_url."""
    names = "place int, publisherCode string, publisherName string, country string, politicalLeaning string, category string, feed_url string"
    return spark.createDataFrame([(i, *f) for i, f in enumerate(schema.FEEDS)], names)


def select_feeds(spark: SparkSession, codes: list[str] | None = None) -> DataFrame:
    """All feeds, or those asked for in the asked order with repeats; unknown codes are dropped."""
    dim = feed_dimension(spark)
    if codes is None:
        return dim.orderBy("place")
    asked = spark.createDataFrame(list(enumerate(codes)), "asked int, publisherCode string")
    return F.broadcast(asked).join(F.broadcast(dim), "publisherCode").orderBy("asked")


def parse_date(x: Column, zone: str) -> Column:
    """RFC 822 or ISO date as local time of the zone."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"^[A-Za-z]+,\s*", ""), r"\s(?:GMT|UTC?|Z)$", " +0000")
    at = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in RFC822], F.try_to_timestamp(x))
    return F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz"))


def read_xml_feed(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Entries with a link: headline, url, description, rssGuid, publishedAt, and their place in the feed.

    RSS channels and Atom feeds. Date: published, else updated, else the channel's. Description: the description
    (the summary), else the content. Guid: the guid (the id), else the link; an Atom entry's link is its alternate
    one, else its first.
    """
    read = lambda tag, kinds: spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(kinds).load(path)
    channel = read("channel", _CHANNEL)
    items = channel.select(F.coalesce("pubDate", "lastBuildDate").alias("channel_date"), F.posexplode("item").alias("item_pos", "item"))
    rss = items.select("item_pos", "channel_date", "item.*").select(
        "item_pos", "title", "link", "description", F.coalesce("encoded", "content").alias("content"), F.col("guid._VALUE").alias("guid"),
        F.coalesce("pubDate", "updated", "channel_date").alias("date"),
    )
    entries = read("feed", _FEED).select(F.col("updated").alias("channel_date"), F.posexplode("entry").alias("item_pos", "item"))
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    atom = entries.select("item_pos", "channel_date", "item.*").select(
        "item_pos", F.col("title._VALUE").alias("title"), F.coalesce(F.get(alternate, F.lit(0)), F.get("link", F.lit(0)))["_href"].alias("link"),
        F.col("summary._VALUE").alias("description"), F.col("content._VALUE").alias("content"), F.col("id").alias("guid"),
        F.coalesce("published", "updated", "channel_date").alias("date"),
    )
    return entry_columns(rss.unionByName(atom), zone, ["item_pos"])


def entry_columns(e: DataFrame, zone: str, keep: list[str]) -> DataFrame:
    """Entries (title, link, description, content, guid, date) with a link as candidates' columns, after ``keep``."""
    return e.where(~is_blank(F.col("link"))).select(
        *keep, F.trim("title").alias("headline"), F.trim("link").alias("url"),
        F.when(~is_blank(F.col("description")), F.col("description")).otherwise(F.col("content")).alias("description"),
        F.coalesce("guid", F.trim("link")).alias("rssGuid"), parse_date(F.col("date"), zone).alias("publishedAt"),
    )


# Words of an error's text and its class, in the order in which they are looked for.
CAUSE_RULES = (("RSS_FORBIDDEN", ("403", "forbidden")), ("RSS_PARSE_ERROR", ("parse", "xml")))
MESSAGE_RULES = (("RSS_TIMEOUT", ("timeout", "timed out")), *CAUSE_RULES)


def error_class(cause: Column, message: Column, timeout: Column | None = None) -> Column:
    """Class of a collection error: the cause's type and text first, then the message's."""
    out = F.when(F.lit(False) if timeout is None else F.coalesce(timeout, F.lit(False)), "RSS_TIMEOUT")
    for text, rules in ((cause, CAUSE_RULES), (message, MESSAGE_RULES)):
        said = F.lower(F.coalesce(text, F.lit("")))
        for name, words in rules:
            out = out.when(reduce(or_, (F.contains(said, F.lit(w)) for w in words)), name)
    return out.otherwise("RSS_FEED_ERROR")


def _class_of(text: str, rules: tuple) -> str | None:
    return next((name for name, words in rules if any(w in text.lower() for w in words)), None)


def classify(error: Exception) -> str:
    """:func:`error_class` of a Python exception and its chain of causes."""
    cause = error.__cause__
    while cause is not None:
        if isinstance(cause, (socket.timeout, TimeoutError)):
            return "RSS_TIMEOUT"
        if found := _class_of(str(cause), CAUSE_RULES):
            return found
        cause = cause.__cause__
    return _class_of(str(error), MESSAGE_RULES) or "RSS_FEED_ERROR"


def fixture_fetcher(folder: str) -> Callable[[SparkSession, str, str], DataFrame]:
    """Reads ``folder/CODE.xml``; a missing file is a failed feed."""
    return lambda spark, code, url: read_xml_feed(spark, f"{folder}/{code}.xml")


def network_fetcher(folder: str, timeout: float = 10.0) -> Callable[[SparkSession, str, str], DataFrame]:
    """Downloads each feed into ``folder`` (a shared one on a cluster) and reads it there."""

    def fetch(spark: SparkSession, code: str, url: str) -> DataFrame:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            data = r.read()
        spark.createDataFrame([(data.decode("utf-8", "replace"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{code}.xml", lineSep="\n")
        return read_xml_feed(spark, f"{folder}/{code}.xml")

    return fetch


def feed_fetcher(folder: str, use_fixture: bool) -> Callable[[SparkSession, str, str], DataFrame]:
    """The switch between the fixtures in ``folder`` and the network, which downloads into it."""
    return fixture_fetcher(folder) if use_fixture else network_fetcher(folder)


def collect(spark: SparkSession, fetch: Callable[[SparkSession, str, str], DataFrame], codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates with pos, feed status). A feed that fails gives a status row and the others go on.

    ``fetch`` is a fetcher, which reads feed by feed, or a :class:`feed_source.FeedSource`, which reads them side by side.
    """
    if hasattr(fetch, "collect"):
        return fetch.collect(spark, codes)
    found, status = [], []
    for i, f in enumerate(select_feeds(spark, codes).collect()):
        base = (f["publisherCode"], f["publisherName"])
        try:
            rows = fetch(spark, f["publisherCode"], f["feed_url"])
            n = rows.count()  # reads the feed, so that what is wrong with it shows here
        except Exception as e:
            wrapped = RuntimeError(f"RSS feed {f['feed_url']} failed: {e}")
            status.append((*base, False, classify(wrapped), str(wrapped).splitlines()[0]))
            continue
        status.append((*base, True, None, None))
        if n:
            fixed = {k: F.lit(f[k]) for k in ("publisherCode", "publisherName", "country", "politicalLeaning", "category")}
            found.append(rows.withColumns(fixed | {"pos": F.lit(i).cast("long") * (1 << 32) + F.col("item_pos")}).drop("item_pos"))
    names = [f.name for f in schema.CANDIDATE.fields]
    empty = spark.createDataFrame([], schema.CANDIDATE).withColumn("pos", F.lit(0).cast("long"))
    for rows in found:
        empty = empty.unionByName(rows.select(*names, "pos"))
    return empty, spark.createDataFrame(status, "publisherCode string, publisherName string, success boolean, errorType string, errorMessage string")


def batch_date(file_name: Column) -> Column:
    """The ISO date that a file is named for, else null."""
    return F.try_to_date(F.regexp_extract(file_name, r"^(\d{4}-\d{2}-\d{2})\.json$", 1), "yyyy-MM-dd")


def read_json_batches(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, batch_date, articles, feedErrors of every readable ``*.json`` file, in the order of the names.

    The root is an array of articles or an object with articles and feedErrors. Unknown fields are ignored; a
    corrupt file, or one with an unknown country, leaning or category, is left out as a whole.
    """
    raw = spark.read.option("wholetext", True).text(f"{folder}/*.json").select(F.col("_metadata.file_name").alias("file_name"), "value")
    is_array = F.col("value").rlike(r"^\s*\[")
    valid = F.try_parse_json("value").isNotNull()
    as_array = F.from_json("value", T.ArrayType(schema.CANDIDATE))
    as_object = F.from_json("value", schema.BATCH)
    parsed = raw.where(valid & F.col("value").rlike(r"^\s*[\[{]")).select(
        "file_name", batch_date(F.col("file_name")).alias("batch_date"),
        F.when(is_array, as_array).otherwise(as_object["articles"]).alias("articles"), F.when(~is_array, as_object["feedErrors"]).alias("feedErrors"),
    )
    wrong = lambda a, c, known: a[c].isNotNull() & ~a[c].isin(*known)
    odd = F.exists("articles", lambda a: wrong(a, "country", schema.COUNTRIES) | wrong(a, "politicalLeaning", schema.LEANINGS) | wrong(a, "category", schema.CATEGORIES))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(parsed.schema[c].dataType))
    return parsed.where(~F.coalesce(odd, F.lit(False))).withColumns({"articles": none("articles"), "feedErrors": none("feedErrors")}).orderBy("file_name")


def _feed_place() -> Column:
    codes = sorted(f[0] for f in schema.FEEDS)
    return F.array_position(F.array(*[F.lit(c) for c in codes]), F.col("publisherCode"))


def batch_candidates(batch: DataFrame) -> DataFrame:
    """Candidates with pos: feeds in the order of their codes, articles in the file's order."""
    a = batch.select(F.posexplode("articles").alias("item_pos", "a")).select("item_pos", "a.*")
    return a.withColumn("pos", _feed_place() * (1 << 32) + F.col("item_pos")).drop("item_pos")


def row_candidates(rows: DataFrame, batch: str, order: list[str]) -> DataFrame:
    """The same for batches of any size whose articles are rows: in a batch they stand by code, then by ``order``.

    Rows are numbered in ranges, so that no task holds a whole batch; rows without a batch are one.
    """
    items = with_running(rows, [F.asc_nulls_last(c) for c in (batch, "publisherCode", *order)], item_pos=F.lit(1))
    first = items.groupBy(F.col(batch).alias("_batch")).agg(F.min("item_pos").alias("_first"))
    placed = items.join(first, F.col(batch).eqNullSafe(F.col("_batch")))
    return placed.withColumn("pos", _feed_place() * (1 << 32) + F.col("item_pos") - F.col("_first")).drop("item_pos", "_batch", "_first")


def batch_feed_status(batch: DataFrame, candidates: DataFrame) -> DataFrame:
    """Recorded errors as failed feeds (unknown codes dropped, blanks defaulted) and the feeds with articles."""
    dim = feed_dimension(batch.sparkSession).select("publisherCode", "publisherName")
    e = batch.select(F.explode("feedErrors").alias("e")).select(F.col("e.feedSourceCode").alias("publisherCode"), "e.errorType", "e.errorMessage")
    default = lambda c, v: F.when(is_blank(F.col(c)), v).otherwise(F.col(c)).alias(c)
    failed = e.join(F.broadcast(dim), "publisherCode").select("publisherCode", "publisherName", F.lit(False).alias("success"), default("errorType", "RSS_FEED_ERROR"), default("errorMessage", "RSS 피드 수집 실패"))
    none = F.lit(None).cast("string")
    good = candidates.select("publisherCode").distinct().join(F.broadcast(dim), "publisherCode").select("publisherCode", "publisherName", F.lit(True).alias("success"), none.alias("errorType"), none.alias("errorMessage"))
    return failed.unionByName(good)


def write_json_lines(candidates: DataFrame, path: str) -> None:
    candidates.select([f.name for f in schema.CANDIDATE.fields]).write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def write_json_array(candidates: DataFrame, folder: str, name: str) -> dict[str, int]:
    """One pretty JSON array ``folder/name.json`` for a snapshot of a few feeds; returns the counts by feed.

    The file is written by the driver, row by row, in the order of pos.
    """
    counts: dict[str, int] = {}
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(candidates.orderBy("pos").toLocalIterator()):
            row = {k.name: r[k.name] for k in schema.CANDIDATE.fields}
            row["publishedAt"] = row["publishedAt"].isoformat() if row["publishedAt"] else None
            f.write((",\n" if i else "\n") + json.dumps(row, ensure_ascii=False, indent=2))
            counts[r["publisherCode"]] = counts.get(r["publisherCode"], 0) + 1
        f.write("\n]\n")
    return counts


def export_snapshot(spark: SparkSession, fetch: Callable[[SparkSession, str, str], DataFrame], folder: str, day: str, codes: list[str] | None = None) -> dict:
    """Collects the feeds and writes their articles to ``folder/day.json``: date, path, total and each feed's outcome."""
    candidates, status = collect(spark, fetch, codes)
    counts = write_json_array(candidates, folder, day)
    feeds = [
        {"feedSourceCode": f["publisherCode"], "publisherName": f["publisherName"], "success": f["success"],
         "count": counts.get(f["publisherCode"], 0) if f["success"] else 0, "errorMessage": f["errorMessage"]}
        for f in status.collect()  # a row for each feed
    ]
    return {"date": day, "path": f"{folder}/{day}.json", "total": sum(counts.values()), "feeds": feeds}
