"""Row numbers and running sums over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash


def with_running(rows: DataFrame, order: list[Column | str], **values: Column) -> DataFrame:
    """Adds for every name the sum of its value over all rows that come before in ``order``, as a long.

    A value of 1 numbers the rows from 0. Rows are sorted into ranges, each range sums its own rows, and the
    ranges' totals (one row each) are summed on top. Equal places in the order are summed in any order; null
    values count 0; an empty table stays empty; a column of the name of an added one is replaced.
    """
    kept = rows.drop(*values)
    own = {f"_value_{name}": F.coalesce(v, F.lit(0)).cast("long") for name, v in values.items()}
    ranges = stash(kept.withColumns(own).orderBy(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy("_range").agg(*[F.sum(v).alias(f"_of{v}") for v in own])
    above = Window.orderBy("_range")  # as many rows as there are ranges
    before = totals.select("_range", *[(F.sum(f"_of{v}").over(above) - F.col(f"_of{v}")).alias(f"_before{v}") for v in own])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = ranges.withColumns({f"_within{v}": F.sum(v).over(inside) - F.col(v) for v in own})
    joined = within.join(F.broadcast(before), "_range")
    return joined.select(*kept.columns, *[(F.col(f"_before_value_{n}") + F.col(f"_within_value_{n}")).alias(n) for n in values])
