"""De-duplication by guid, address and key, in the order of arrival.

A row is dropped only if a stored or an earlier *kept* row shares its key, so rows can't be judged by
windows: a dropped row suppresses nothing. Rows that share no key with another row are kept at once;
the others are judged in rounds, which end at the sequential result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import is_blank
from ..sources.shared import stash
from .graph import connected_components

_KEYS = ("k1", "k2", "k3")
#: Rounds after which long chains of rows are judged one after the other.
ROUNDS = 12


def _with_keys(rows: DataFrame) -> DataFrame:
    """k1 (publisher and guid, null for a blank guid), k2 (address), k3 (dedupe key)."""
    guid = F.when(~is_blank(F.col("rss_guid")), F.concat_ws("\x00", F.lit("g"), F.col("publisher_id").cast("string"), F.col("rss_guid")))
    return rows.withColumns({"k1": guid, "k2": F.concat(F.lit("u"), "normalized_url"), "k3": F.concat(F.lit("k"), "dedupe_key")})


def _in_store(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Adds s1, s2, s3: whether a stored row has the key."""
    held = _with_keys(store)
    for i, k in enumerate(_KEYS, 1):
        known = held.select(k).where(F.col(k).isNotNull()).distinct().withColumn(f"s{i}", F.lit(True))
        rows = rows.join(known, k, "left").withColumn(f"s{i}", F.coalesce(f"s{i}", F.lit(False)))
    return rows


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """The kept rows of a component, judged one after the other."""
    seen: set[str] = set()
    out = []
    for r in rows.sort_values("pos").itertuples():
        keys = {k for k in (r.k1, r.k2, r.k3) if isinstance(k, str)}
        if not keys & seen:
            seen |= keys
            out.append(r.pos)
    return pd.DataFrame({"pos": pd.Series(out, dtype="int64")})


def store_hits(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Adds ``reason``: the first of guid, address and key that a stored row has, else null."""
    hit = F.when(F.col("s1"), schema.DUPLICATE_REASONS[0]).when(F.col("s2"), schema.DUPLICATE_REASONS[1]).when(F.col("s3"), schema.DUPLICATE_REASONS[2])
    return _in_store(_with_keys(rows), store).withColumn("reason", hit).drop(*_KEYS, "s1", "s2", "s3")


def earlier_hits(rows: DataFrame) -> DataFrame:
    """Adds ``reason``: the first of guid, address and key that any earlier row has, kept or not, else null.

    That is :func:`store_hits` for every row against the store of all rows before it.
    """
    out = _with_keys(rows)
    for i, k in enumerate(_KEYS, 1):
        first = out.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("pos").alias("_first"))
        out = out.join(first, k, "left").withColumn(f"s{i}", F.coalesce(F.col("_first") < F.col("pos"), F.lit(False))).drop("_first")
    hit = F.when(F.col("s1"), schema.DUPLICATE_REASONS[0]).when(F.col("s2"), schema.DUPLICATE_REASONS[1]).when(F.col("s3"), schema.DUPLICATE_REASONS[2])
    return out.withColumn("reason", hit).drop(*_KEYS, "s1", "s2", "s3")


def _one_key_each(rows: DataFrame) -> DataFrame:
    """(pos, i, k): the keys of every row, without nulls."""
    return rows.select("pos", F.posexplode(F.array(*_KEYS)).alias("i", "k")).where("k IS NOT NULL")


def _judged_in_rounds(open_: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pos of the kept rows among those that share keys.

    A row that is the first of the open ones on all of its keys is kept, and the others with one of its keys
    are not; the rest goes into the next round. Where that takes more than ROUNDS, what is left are chains
    in which each row hangs on the one before; their components are judged row by row.
    """
    kept: list[DataFrame] = []
    for _ in range(ROUNDS):
        ends = _one_key_each(open_)
        first = ends.groupBy("k").agg(F.min("pos").alias("first"))
        tied = keep(ends.join(first, "k").select("pos", "first"))
        winners = keep(tied.groupBy("pos").agg(F.bool_and(F.col("pos") == F.col("first")).alias("wins")).where("wins").select("pos"))
        kept.append(winners)
        done = winners.union(tied.join(winners.toDF("first"), "first", "left_semi").select("pos")).distinct()
        open_ = keep(open_.join(done, "pos", "left_anti"))
        if open_.isEmpty():
            break
    else:
        ends = _one_key_each(open_)
        first = ends.groupBy("k").agg(F.min("pos").alias("v"))
        parts = connected_components(ends.join(first, "k").select(F.col("pos").alias("u"), "v"), keep).withColumnRenamed("node", "pos")
        rooted = open_.join(parts, "pos", "left").withColumn("root", F.coalesce("root", "pos"))
        kept.append(rooted.groupBy("root").applyInPandas(_greedy, "pos long"))
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return out


def dedupe(rows: DataFrame, store: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = stash) -> DataFrame:
    """Adds ``reason`` (null: kept) to rows (pos, publisher_id, rss_guid, normalized_url, dedupe_key, ...).

    ``pos`` is the unique place of arrival. Of several shared keys the first of guid, address, key names
    the reason. Null keys match nothing.
    """
    keyed = _with_keys(rows)
    if store is None:
        keyed = keyed.withColumns({f"s{i}": F.lit(False) for i in (1, 2, 3)})
    else:
        keyed = _in_store(keyed, store)
    keyed = keep(keyed.select("pos", *_KEYS, "s1", "s2", "s3"))
    fresh = keyed.where("NOT (s1 OR s2 OR s3)").select("pos", *_KEYS)
    ends = _one_key_each(fresh)
    twice = ends.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    shared = keep(ends.join(twice, "k", "left_semi").select("pos").distinct())
    kept = keep(fresh.join(shared, "pos", "left_anti").select("pos").union(_judged_in_rounds(keep(fresh.join(shared, "pos", "left_semi")), keep)))
    # a key has one kept row at most, which is the first with it
    owners = _one_key_each(fresh.join(kept, "pos", "left_semi")).select("k", F.col("pos").alias("owner"))
    stored = F.filter(F.array(*[F.when(F.col(f"s{i + 1}"), F.lit(i)) for i in range(3)]), lambda x: x.isNotNull())
    dropped = keyed.join(kept, "pos", "left_anti")
    by_owner = _one_key_each(dropped).join(owners, "k").where("owner < pos").select("pos", "i")
    by_store = dropped.select("pos", F.explode(stored).alias("i"))
    reason = F.get(F.array(*map(F.lit, schema.DUPLICATE_REASONS)), F.min("i").cast("int")).alias("reason")
    return rows.join(by_owner.union(by_store).groupBy("pos").agg(reason), "pos", "left")


def dedupe_window(rows: DataFrame) -> DataFrame:
    """Fast variant that is *not* equivalent: a dropped row also suppresses later ones with its keys."""
    from pyspark.sql import Window

    keyed = _with_keys(rows)
    later = [F.col(k).isNotNull() & (F.row_number().over(Window.partitionBy(k).orderBy("pos")) > 1) for k in _KEYS]
    reason = F.when(later[0], schema.DUPLICATE_REASONS[0]).when(later[1], schema.DUPLICATE_REASONS[1]).when(later[2], schema.DUPLICATE_REASONS[2])
    return keyed.withColumn("reason", reason).drop(*_KEYS)
