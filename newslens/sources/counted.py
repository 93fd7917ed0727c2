"""A store that keeps daily counts and search grams with each part it writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators.read import contains_ignoring_case
from ..operators.rollup import COUNTED, partial_counts, retracted
from ..operators.search import grams_of, search, trigram_index
from .shared import stash
from .tables import LOGGED, Store


class CountedStore(Store):
    """Every part of a counted table has its counts in ``daily_count``, under its version and number, and every part of
    the articles before that its headlines' grams in ``search_gram``. Parts without (a writer was lost between) are
    counted or searched themselves when they are asked for, so that both always equal a scan."""

    def _keep(self, name: str, at: tuple[int, int], rows: DataFrame, counts: DataFrame) -> None:
        if name == "article":
            grams = trigram_index(rows).select(F.lit(at[0]).alias("version"), F.lit(at[1]).alias("part"), "gram", "block", "bits")
            super().append("search_gram", grams)
        super().append("daily_count", counts.select("source", F.lit(at[0]).alias("version"), F.lit(at[1]).alias("part"), "day", "name", "n", "at_midnight").coalesce(1))

    def append(self, name: str, rows: DataFrame) -> tuple[int, int]:
        if name not in COUNTED:
            return super().append(name, rows)
        rows = stash(rows)
        counts = partial_counts(name, rows)
        if name in LOGGED:  # later rows of an id replace earlier ones
            counts = stash(counts.unionByName(retracted(partial_counts(name, self.read(name).join(rows.select("id"), "id", "left_semi")))))
        at = super().append(name, rows)
        self._keep(name, at, rows, counts)
        return at

    def replace(self, name: str, rows: DataFrame) -> tuple[int, int]:
        if name not in COUNTED:
            return super().replace(name, rows)
        rows = stash(rows)
        at = super().replace(name, rows)
        self._keep(name, at, rows, partial_counts(name, rows))
        return at

    def _kept_parts(self, kept: DataFrame, name: str, version: int, parts: list[int]) -> tuple[DataFrame, list[int]]:
        """The counts of a version's parts, and the parts that have none."""
        own = kept.where((F.col("source") == name) & (F.col("version") == version) & F.col("part").isin(parts))
        known = {r["part"] for r in own.select("part").distinct().collect()}  # a row for each part
        return own, [p for p in parts if p not in known]

    def search(self, needle: str) -> DataFrame:
        """Articles whose headline holds the needle (see :func:`search.search`), by the kept grams."""
        version = self._version("article")
        parts = self._parts("article", version)
        _, missing = self._kept_parts(self.read("daily_count"), "article", version, parts)
        index = self.read("search_gram").where((F.col("version") == version) & F.col("part").isin([p for p in parts if p not in missing]))
        found = search(self.read("article"), index, needle)
        if missing and grams_of(self.spark, needle):
            rest = self.spark.read.schema(schema.TABLES["article"]).parquet(*[f"{self.path}/article/v{version}/p{p}" for p in missing])
            found = found.unionByName(rest.where(contains_ignoring_case(F.col("headline"), needle))).dropDuplicates(["id"])
        return found

    def counts(self, *names: str) -> DataFrame:
        """source, day, name, n and at_midnight, to be summed, of the counted tables."""
        kept, out = self.read("daily_count"), []
        for name in names or COUNTED:
            version = self._version(name)
            parts = self._parts(name, version)
            own, missing = self._kept_parts(kept, name, version, parts)
            if missing and name in LOGGED:
                out.append(partial_counts(name, self.read(name)))
                continue
            out.append(own.select("source", "day", "name", "n", "at_midnight"))
            if missing:
                rows = self.spark.read.schema(schema.TABLES[name]).parquet(*[f"{self.path}/{name}/v{version}/p{p}" for p in missing])
                out.append(partial_counts(name, rows))
        return reduce(DataFrame.unionByName, out)
