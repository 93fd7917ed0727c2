"""The feeds as a data source: ``spark.read.format("newsfeed")``, a partition for each feed.

Each partition fetches and cuts its own feed, so that feeds load side by side. What goes wrong is a row: a feed that
can't be fetched or read gives one with its error, an item that can't be parsed gives one with its text, and all other
items stay. Options: ``mode`` (fixture or network), ``folder`` (of fixtures, ``CODE.xml``; any address that pyarrow's
file systems open), ``codes`` (comma-separated, in the asked order, with repeats; all feeds without it), ``urls`` (JSON
of other addresses by code) and ``timeout`` (seconds).
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import on_workers, schema
from .feeds import classify, entry_columns
from .shared import stash

SCHEMA = T.StructType([
    *[T.StructField(n, k) for n, k in (("kind", T.StringType()), ("place", T.IntegerType()), ("item_pos", T.IntegerType()))],
    *[T.StructField(n, T.StringType()) for n in (
        "publisherCode", "publisherName", "country", "politicalLeaning", "category", "title", "link", "description", "content", "guid", "date", "errorType", "errorMessage", "corrupt",
    )],
])
_ITEM = re.compile(r"<(item|entry)[\s>].*?</\1\s*>", re.DOTALL)
_ROOT = re.compile(r"<(?:\w+:)?(rss|RDF|feed)[\s>]")
_NAMESPACE = re.compile(r"""\sxmlns:([\w.-]+)\s*=\s*["'][^"']*["']""")
_DECLARED = re.compile(rb"""^[^>]*encoding\s*=\s*["']([\w.-]+)["']""")


@dataclass
class FeedPartition(InputPartition):
    place: int
    feed: tuple


def _child(item: ElementTree.Element, *names: str) -> str | None:
    """Text of the first child of the first of these local names."""
    for name in names:
        for x in item:
            if x.tag.rpartition("}")[2] == name:
                return "".join(x.itertext())
    return None


def _link(item: ElementTree.Element) -> str | None:
    """The alternate link of an Atom entry, else its first one; the text of an RSS link."""
    links = [x for x in item if x.tag.rpartition("}")[2] == "link"]
    if any(x.get("href") for x in links):
        return next((x for x in links if x.get("rel", "alternate") == "alternate"), links[0]).get("href")
    return "".join(links[0].itertext()) if links else None


def items_of(data: bytes) -> Iterator[tuple[str, dict[str, str | None]]]:
    """(item or bad_item, its fields) for every item of an RSS or Atom feed, each parsed by itself."""
    declared = _DECLARED.match(data[:200])
    text = data.decode(declared[1].decode() if declared else "utf-8-sig", "replace")
    if not _ROOT.search(text):
        raise ValueError("parse: no RSS or Atom feed")
    head = _ITEM.sub("", text)
    dated = {k: v.strip() for k, v in re.findall(r"<(pubDate|lastBuildDate|updated)>([^<]*)<", head)[::-1]}
    date = dated.get("pubDate") or dated.get("lastBuildDate") or dated.get("updated")
    spaces = " ".join(f'xmlns:{p}="{p}"' for p in dict.fromkeys(_NAMESPACE.findall(text)))
    for found in _ITEM.finditer(text):
        try:
            item = ElementTree.fromstring(f"<x {spaces}>{found[0]}</x>")[0]
        except ElementTree.ParseError as e:
            yield "bad_item", {"corrupt": found[0], "errorType": "RSS_PARSE_ERROR", "errorMessage": f"item can't be parsed: {e}"}
            continue
        if found[1] == "entry":
            fields = {"guid": _child(item, "id"), "description": _child(item, "summary"), "content": _child(item, "content"), "date": _child(item, "published", "updated")}
        else:
            fields = {"guid": _child(item, "guid"), "description": _child(item, "description"), "content": _child(item, "encoded", "content"), "date": _child(item, "pubDate", "updated")}
        yield "item", fields | {"title": _child(item, "title"), "link": _link(item), "date": fields["date"] or date}


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.mode, self.folder, self.timeout = options.get("mode", "fixture"), options.get("folder", ""), float(options.get("timeout", "10"))
        self.urls = json.loads(options.get("urls", "{}"))
        codes = options.get("codes")
        known = {f[0]: f for f in schema.FEEDS}
        self.feeds = [known[c] for c in codes.split(",") if c in known] if codes is not None else list(schema.FEEDS)
        if self.mode not in ("fixture", "network"):
            raise ValueError(f"mode is fixture or network, not {self.mode}")

    def partitions(self) -> list[InputPartition]:
        return [FeedPartition(i, f) for i, f in enumerate(self.feeds)]

    def _fetch(self, code: str, url: str) -> bytes:
        if self.mode == "network":
            with urllib.request.urlopen(url, timeout=self.timeout) as r:
                return r.read()
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(f"{self.folder}/{code}.xml")
        with files.open_input_stream(path) as f:
            return f.read()

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        code, *rest = partition.feed
        fixed = dict(zip(("publisherCode", "publisherName", "country", "politicalLeaning", "category"), (code, *rest[:4]), strict=True))
        url = self.urls.get(code, rest[4])
        row = lambda kind, pos, **more: tuple(({"kind": kind, "place": partition.place, "item_pos": pos} | fixed | more).get(n) for n in SCHEMA.names)
        try:
            found = list(items_of(self._fetch(code, url)))  # one feed's items
        except Exception as e:  # the feed's row tells it, the other feeds go on
            wrapped = RuntimeError(f"RSS feed {url} failed: {e}")
            wrapped.__cause__ = e
            yield row("feed", None, errorType=classify(wrapped), errorMessage=str(wrapped).splitlines()[0])
            return
        yield row("feed", None)
        for i, (kind, fields) in enumerate(found):
            yield row(kind, i, **fields)


class FeedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "newsfeed"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FeedReader:  # noqa: ARG002
        return FeedReader(dict(self.options))


@dataclass(frozen=True)
class FeedSource:
    """Where feeds come from, in place of a fetcher: see the options above."""

    mode: str = "fixture"
    folder: str = ""
    urls: dict[str, str] | None = None
    timeout: float = 10.0

    def load(self, spark: SparkSession, codes: list[str] | None = None) -> DataFrame:
        on_workers(spark)
        spark.dataSource.register(FeedDataSource)
        read = spark.read.format("newsfeed").option("mode", self.mode).option("folder", self.folder).option("timeout", str(self.timeout)).option("urls", json.dumps(self.urls or {}))
        return (read if codes is None else read.option("codes", ",".join(codes))).load()

    def collect(self, spark: SparkSession, codes: list[str] | None = None, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
        """(candidates with pos, feed status), from one pass over the feeds. An item that can't be parsed is a
        candidate without headline and address, which fails as such."""
        rows = stash(self.load(spark, codes))
        fixed = ["publisherCode", "publisherName", "country", "politicalLeaning", "category"]
        pos = (F.col("place").cast("long") * (1 << 32) + F.col("item_pos")).alias("pos")
        good = entry_columns(rows.where("kind = 'item'").select("*", pos), zone, [*fixed, "pos"])
        none = F.lit(None).cast("string")
        bad = rows.where("kind = 'bad_item'").select(*fixed, pos, *[none.alias(c) for c in ("headline", "url", "description", "rssGuid")], F.lit(None).cast("timestamp_ntz").alias("publishedAt"))
        names = [*schema.CANDIDATE.names, "pos"]
        status = rows.where("kind = 'feed'").orderBy("place").select("publisherCode", "publisherName", F.col("errorType").isNull().alias("success"), "errorType", "errorMessage")
        return good.select(*names).unionByName(bad.select(*names)), status
