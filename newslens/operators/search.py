"""Literal substring search by an index of trigrams, each with the blocks of ids that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .read import contains_ignoring_case

#: Characters of a gram; shorter needles are looked for by a scan.
GRAM = 3
#: Ids of a block, one bit each.
BLOCK = 64


def grams_of(spark: SparkSession, needle: str) -> list[str]:
    """The needle's grams in the upper case that Spark gives texts; none for a shorter one."""
    up = spark.sql("SELECT upper(:needle) AS up", args={"needle": needle}).first()["up"]
    return sorted({up[i : i + GRAM] for i in range(len(up) - GRAM + 1)})


def trigram_index(rows: DataFrame, column: str = "headline") -> DataFrame:
    """gram, block and bits (of the block's ids that hold it), sorted by gram so that a reader passes over other ones.

    rows (id, column): ids are numbers; null texts have no grams. Indexes of several appends are read together: their
    bits are joined by :func:`candidates`.
    """
    upper = rows.select("id", F.upper(column).alias("up")).where(F.length("up") >= GRAM)
    upper = upper.select("id", F.length("up").alias("n"), F.split("up", "").alias("chars"))  # a gram's place is found at once in an array
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - GRAM), lambda i: F.concat(*[F.get(F.col("chars"), i + k) for k in range(GRAM)]))
    each = upper.select("id", F.explode(F.array_distinct(grams)).alias("gram"))
    block = F.call_function("shiftright", F.col("id").cast("long"), F.lit(BLOCK.bit_length() - 1))  # ids may be hashes, too long for doubles
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(BLOCK)).cast("int"))
    made = each.groupBy("gram", block.alias("block")).agg(F.bit_or(bit).alias("bits"))
    return made.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")


def candidates(index: DataFrame, grams: list[str]) -> DataFrame:
    """id of the rows that hold every one of the grams."""
    held = index.where(F.col("gram").isin(grams)).groupBy("gram", "block").agg(F.bit_or("bits").alias("bits"))
    blocks = held.groupBy("block").agg(F.count("*").alias("n"), F.bit_and("bits").alias("bits")).where((F.col("n") == len(grams)) & (F.col("bits") != 0))
    places = blocks.select("block", "bits", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("i"))
    return places.where(F.call_function("shiftright", F.col("bits"), F.col("i")).bitwiseAND(F.lit(1).cast("long")) == 1).select((F.col("block") * BLOCK + F.col("i")).alias("id"))


def search(rows: DataFrame, index: DataFrame, needle: str, column: str = "headline") -> DataFrame:
    """Rows whose text holds the needle, whatever the case of its letters; ``%`` and ``_`` mean themselves.

    A needle of three or more characters is looked up in the index and checked on the rows found; a shorter one is
    looked for in all rows.
    """
    exact, grams = rows.where(contains_ignoring_case(F.col(column), needle)), grams_of(rows.sparkSession, needle)
    return exact.join(candidates(index, grams), "id", "left_semi") if grams else exact
