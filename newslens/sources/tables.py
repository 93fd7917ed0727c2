"""The store: one Parquet folder for each table, appended to in whole versions."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..errors import Conflict, NotFound
from .shared import stash

__all__ = ["Conflict", "NotFound", "Store", "seed"]
#: Tables in which later rows of an id replace earlier ones.
LOGGED = ("pipeline_run", "topic")
#: Folders into which a part of such a table is dealt by id, so that the latest row of each id is found without a shuffle.
BUCKETS = 8
#: Versions of a table that are kept when it is replaced.
KEPT_VERSIONS = 2
#: Seconds after which a writer that publishes is taken for lost.
LOCK_SECONDS = 600.0

#: Tables and columns that refer to a table.
REFERENCES = {"publisher": (("article", "publisher_id"), ("publisher_feed", "publisher_id")), "article": (("topic_article", "article_id"),), "topic": (("topic_article", "topic_id"),)}


class Store:
    """Tables under ``path``. A table's version is a folder of parts; each append is a part, written at once, and
    counts when it is whole. Replacing a table writes a new version, so that a broken write leaves the old one in
    place; older versions than the last KEPT_VERSIONS are removed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self, folder: str, letter: str) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(folder)):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path(folder))]
        return sorted(int(v[1:]) for v in found if v[:1] == letter and v[1:].isdigit())

    def _parts(self, name: str, version: int) -> list[int]:
        """The whole parts of a version."""
        fs, path = self._fs()
        folder = f"{self.path}/{name}/v{version}"
        return [n for n in self._numbers(folder, "p") if fs.exists(path(f"{folder}/p{n}/_SUCCESS"))]

    def _version(self, name: str) -> int:
        """The newest version whose first part is whole; 0 without any."""
        return next((v for v in reversed(self._numbers(f"{self.path}/{name}", "v")) if 0 in self._parts(name, v)), 0)

    def _claim(self, folder: str, letter: str, first: int) -> int:
        """The least number from ``first`` on that no other writer has claimed; creating a file is what claims it."""
        fs, path = self._fs()
        n = first
        while True:
            try:
                if fs.createNewFile(path(f"{folder}/claim-{letter}{n}")):
                    return n
            except Exception:
                if not fs.exists(path(f"{folder}/claim-{letter}{n}")):
                    raise
            n += 1

    @contextmanager
    def _publishing(self, name: str) -> Iterator[None]:
        """One writer of a table at a time; a lock that is LOCK_SECONDS old is removed."""
        fs, path = self._fs()
        lock = path(f"{self.path}/{name}/publishing")
        until = time.monotonic() + 2 * LOCK_SECONDS
        while not fs.createNewFile(lock):
            try:
                age = time.time() - fs.getFileStatus(lock).getModificationTime() / 1000
            except Exception:  # just released
                continue
            if age > LOCK_SECONDS:
                fs.delete(lock, False)
            elif time.monotonic() > until:
                raise Conflict(f"{name} is being written")
            else:
                time.sleep(0.1)
        try:
            yield
        finally:
            fs.delete(lock, False)

    def _write(self, name: str, version: int, part: int, rows: DataFrame) -> None:
        typed = rows.select([F.col(f.name).cast(f.dataType) for f in schema.TABLES[name].fields])
        out = typed.write
        if name in LOGGED:
            dealt = typed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
            out = dealt.repartition(BUCKETS, "bucket").write.partitionBy("bucket")
        out.mode("overwrite").parquet(f"{self.path}/{name}/v{version}/p{part}")

    def read(self, name: str) -> DataFrame:
        kinds, version = schema.TABLES[name], self._version(name)
        parts = self._parts(name, version)
        if not parts:
            return self.spark.createDataFrame([], kinds)
        paths = [f"{self.path}/{name}/v{version}/p{n}" for n in parts]
        if name not in LOGGED:
            return self.spark.read.schema(kinds).parquet(*paths)
        fs, path = self._fs()
        part = F.regexp_extract(F.col("_metadata.file_path"), "/p([0-9]+)/[^/]*/[^/]*$", 1).cast("int")
        latest = [self.spark.createDataFrame([], kinds)]
        for b in range(BUCKETS):
            held = [f"{p}/bucket={b}" for p in paths if fs.exists(path(f"{p}/bucket={b}"))]
            if held:  # one task reads a bucket and so sees all rows of its ids
                rows = self.spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(*held).select(part.alias("part"), F.struct(*kinds.fieldNames()).alias("row"))
                latest.append(rows.coalesce(1).groupBy("row.id").agg(F.max_by("row", "part").alias("row")).select("row.*"))
        return reduce(DataFrame.unionByName, latest)

    def append(self, name: str, rows: DataFrame) -> tuple[int, int]:
        """Writes a part; returns its version and number."""
        version = self._version(name)
        folder = f"{self.path}/{name}/v{version}"
        part = self._claim(folder, "p", 1 + max(self._numbers(folder, "p"), default=-1))
        self._write(name, version, part, rows)
        return version, part

    def append_unique(self, name: str, rows: DataFrame, *columns: str) -> DataFrame:
        """Appends the rows of which no stored row has one of the columns' values, and of equal ones among them that of
        the least id; returns those left out. Nulls equal nothing. Other writers wait meanwhile, so that of equal
        rows of two writers one is stored."""
        staged = stash(rows)
        with self._publishing(name):
            stored, clash = self.read(name), None
            for c in columns:
                first = F.row_number().over(Window.partitionBy(c).orderBy("id"))
                again = staged.where(F.col(c).isNotNull()).select("id", first.alias("n")).where("n > 1").select("id")
                seen = staged.join(stored.select(c).distinct(), c, "left_semi").select("id")
                clash = again.union(seen) if clash is None else clash.union(again).union(seen)
            left = stash(staged.join(clash.distinct(), "id", "left_semi")) if clash is not None else staged.limit(0)
            if left.isEmpty():
                self.append(name, staged)
            else:
                self.append(name, staged.join(left.select("id"), "id", "left_anti"))
        return left

    def replace(self, name: str, rows: DataFrame) -> tuple[int, int]:
        """Writes a new version of one part; returns their numbers."""
        versions = self._numbers(f"{self.path}/{name}", "v")
        version = self._claim(f"{self.path}/{name}", "v", 1 + max(versions, default=0))
        self._write(name, version, 0, rows)
        fs, path = self._fs()
        for old in versions[: 1 - KEPT_VERSIONS or None]:
            fs.delete(path(f"{self.path}/{name}/v{old}"), True)
        return version, 0

    def update_latest(self, name: str, rows: DataFrame) -> None:
        """Rows of the same id replace the stored ones: an append where later rows count, else a new version."""
        if name in LOGGED:
            self.append(name, rows)
            return
        with self._publishing(name):
            old = self.read(name)
            self.replace(name, old.join(rows.select("id"), "id", "left_anti").unionByName(rows.select(old.columns)))

    def delete(self, name: str, id_: int) -> None:
        """Removes one row; NotFound without it, Conflict while another table refers to it."""
        rows = self.read(name)
        if rows.where(F.col("id") == id_).isEmpty():
            raise NotFound(f"{name} {id_}")
        for child, column in REFERENCES.get(name, ()):
            if not self.read(child).where(F.col(column) == id_).isEmpty():
                raise Conflict(f"{name} {id_} is used by {child}")
        self.replace(name, rows.where(F.col("id") != id_))

    def check_unique(self, name: str, *columns: str, among: DataFrame | None = None) -> None:
        """Conflict if two rows have the same columns; with ``among`` only of rows that have those of one of them."""
        rows = self.read(name).select(*columns)
        if among is not None:
            rows = rows.join(among.select(*columns).distinct(), list(columns), "left_semi")
        if not rows.groupBy(*columns).count().where("count > 1").limit(1).isEmpty():
            raise Conflict(f"{name} has {columns} twice")


def seed(store: Store, as_of: str) -> None:
    """Publishers and feeds of the dimension that the store lacks."""
    from .feeds import feed_dimension

    dim = feed_dimension(store.spark)
    now = F.lit(as_of).cast("timestamp_ntz")
    p = dim.select(F.xxhash64("publisherName").alias("id"), F.col("publisherName").alias("name"), "country", F.col("politicalLeaning").alias("political_leaning"), F.col("feed_url").alias("rss_url"), now.alias("created_at"))
    store.append("publisher", p.join(store.read("publisher").select("name"), "name", "left_anti"))
    names = store.read("publisher").select(F.col("id").alias("publisher_id"), F.col("name").alias("publisherName"))
    f = dim.join(names, "publisherName").select(F.xxhash64("publisher_id", "category").alias("id"), "publisher_id", F.col("category").alias("article_category"), F.col("feed_url").alias("rss_url"), F.lit(True).alias("active"))
    store.append("publisher_feed", f.join(store.read("publisher_feed").select("publisher_id", "article_category"), ["publisher_id", "article_category"], "left_anti"))
