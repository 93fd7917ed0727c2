"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, in the order of a hash, form one stream of words that is cut into equal
blocks. The sources' numbers of slots follow each other as stretches of the cumulative weights; the
slot of a point in a stretch is the one at which the van der Corput sequence comes to it, so that each
source gets exactly its slots, evenly spread. A source's r-th slot takes its block r modulo its
number of blocks, and a document is taken as often as the blocks that hold its words, first at the
first slot of any of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import with_running
from .common import let, stash, table, words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is used more than so many times.
CAP = 3
#: Blocks of the whole corpus, at least, and words of a block, at most: larger corpora have more blocks.
BLOCKS, BLOCK_WORDS = 1 << 18, 1 << 16
#: Blocks of a source, at least (or one for each of its words).
MIN_BLOCKS = 64
#: Documents that one running sum orders, about; the square root of a source's documents if that is more.
RUN = 2048
#: Slots that one ranking orders, about.
CHUNK = 4096
#: Rows (of about a hundred bytes) up to which a table of sources or of taken documents is broadcast.
BROADCAST_ROWS = 400_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds cap times a size is shared again among the rest."""
    total = sum(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    fixed: dict[int, float] = {}
    while True:
        rest, open_ = total - sum(fixed.values()), [i for i in range(len(sizes)) if i not in fixed]
        whole = sum(w[i] for i in open_)
        shares = {i: rest * w[i] / whole for i in open_}
        over = [i for i in open_ if shares[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, shares.get(i, 0.0)) if total else 0.0 for i in range(len(sizes))]
        fixed |= {i: float(cap * sizes[i]) for i in over}


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hash ``_h`` that orders a source's documents."""
    size = F.size(words(F.col("text"))).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _hash().alias("_h"))


def _hash() -> Column:
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.encode(F.concat(named, F.lit("\x1f"), F.coalesce(F.col("text"), F.lit(""))), "UTF-8"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def plan_sources(rows: DataFrame) -> DataFrame:
    """src (number), source, source_size, target, blocks, first (slot), slots and bits (of runs) of each source.

    Shares are by weight; what exceeds CAP times a size is shared again among the rest, in rounds over the table of
    sources until none is above (:func:`targets` is the same for a list). Only sums reach the driver.
    """
    by_name = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    numbered = with_running(by_name, [F.col("source").asc_nulls_last()], src=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int"))
    weighted = stash(numbered.withColumn("weight", weight))
    total = weighted.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    rest, whole, n_over = total, None, 0
    most = CAP * F.col("source_size")
    over = F.lit(False)
    while True:
        got = weighted.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most)).alias("most"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if whole is not None and got["n"] == n_over:
            break
        n_over, rest, whole = got["n"], total - (got["most"] or 0), got["w"] or 1
        share = F.lit(float(rest)) * F.col("weight") / F.lit(float(whole))
        over = share > most
    words_each = max(1, min(BLOCK_WORDS, total // BLOCKS))
    per_run = F.greatest(F.lit(float(RUN)), F.sqrt("n"))
    planned = weighted.select(
        "src", "source", "source_size", F.when(over, most.cast("double")).otherwise(share).alias("target"),
        F.greatest(F.least(F.col("source_size"), F.lit(MIN_BLOCKS)), F.expr(f"(source_size + {words_each - 1}) div {words_each}")).cast("long").alias("blocks"),
        F.ceil(F.log2(F.greatest(F.lit(2.0), F.col("n") / per_run))).cast("int").alias("bits"),
    )
    used = F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + 0.5).cast("long")
    slots = F.when(F.col("source_size") > 0, F.least(CAP * F.col("blocks"), used)).otherwise(F.lit(0).cast("long"))
    counted = with_running(planned.withColumn("slots", slots), ["src"], first=F.col("slots"))
    return stash(counted.select("src", "source", "source_size", "target", "blocks", "first", "slots", "bits"))


def van_der_corput(point: Column, bits: int) -> Column:
    """The place of point / 2^bits in the van der Corput sequence: the bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(point), bits, "0")), 2, 10).cast("long")


def schedule(plan: DataFrame, slot_of: Callable[[Column, int], Column] = van_der_corput) -> DataFrame:
    """slot, src, rank (from 0, per source) and block for every used slot.

    ``slot_of`` gives the place of a point in a sequence of 2^bits points, one to one.
    """
    used = plan.agg(F.sum("slots").alias("n")).first()["n"] or 0
    bits = max(1, (used - 1).bit_length())
    stretches = plan.where("slots > 0").select("src", "blocks", "first", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("piece"))
    point = F.explode(F.expr(f"sequence(first + piece * {CHUNK}, least(first + slots, first + (piece + 1) * {CHUNK}) - 1)"))
    points = stretches.repartition("src", "piece").select("src", "blocks", "slots", point.alias("point"))
    slots = points.select("src", "blocks", "slots", slot_of(F.col("point"), bits).alias("slot"))
    # a source's slots are spread evenly, so stretches of slots of equal width hold about CHUNK of them each
    slots = stash(slots.withColumn("chunk", F.shiftright(F.col("slot") * F.expr(f"(slots + {CHUNK - 1}) div {CHUNK}"), bits)))
    counts = slots.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("src", "chunk", (F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(before, ["src", "chunk"]).withColumn("rank", F.col("before") + F.col("inside"))
    return ranked.select("slot", "src", "rank", F.pmod("rank", "blocks").alias("block"))


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan and ``start``, the words before them in their source's order.

    The order is cut into runs by the hash's leading bits, so that no task orders a whole source.
    """
    sources = _small(plan)
    r = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    r = r.withColumn("run", F.expr("shiftright(cast(conv(substr(_h, 1, 8), 16, 10) as long), 32 - bits)"))
    runs = r.groupBy("src", "run").agg(F.sum("size").alias("n"))
    before = runs.select("src", "run", (F.sum("n").over(Window.partitionBy("src").orderBy("run")) - F.col("n")).alias("before"))
    order = Window.partitionBy("src", "run").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = r.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    return inside.join(before, ["src", "run"]).withColumn("start", F.col("before") + F.col("inside"))


def _block_of(word: str) -> Column:
    """The block, from 0, of its source's stream that holds a word; in decimals, as the products outgrow 64 bits."""
    return F.expr(f"cast((cast({word} + 1 as decimal(19, 0)) * cast(blocks as decimal(19, 0)) - 1) div source_size as long)")


def _first_word(block: str) -> Column:
    """The first word of a block: block * source_size div blocks without the large product."""
    return F.expr(f"({block}) * (source_size div blocks) + ({block}) * (source_size % blocks) div blocks")


def _pieces(at: DataFrame) -> DataFrame:
    """The stretches ``from`` to ``to`` (words of the source's stream) of each document of ``at`` in each block."""
    return (
        at.where("size > 0")
        .withColumn("block", F.explode(F.sequence(_block_of("start"), _block_of("start + size - 1"))))
        .withColumn("from", F.greatest("start", _first_word("block")))
        .withColumn("to", F.least(F.col("start") + F.col("size"), _first_word("block + 1")))
    )


def mix(docs: DataFrame, slot_of: Callable[[Column, int], Column] = van_der_corput) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and first_slot of every document.

    taken counts the document's words in all blocks that the schedule takes, repeats included, and first_slot is the
    first slot that takes any of them (-1 where none does). Null text has size 0 and taken 0; null sources form one
    source, the last; null ids take part; documents without words get their source's figures; an empty table gives an
    empty result; of wholly equal rows any may come first, with the same multiset of results; other columns are left
    out. The result depends on the rows alone, so reruns agree.
    """
    rows = stash(sized(docs))
    plan = plan_sources(rows)
    at = stash(placed(rows, plan).select("_h", "doc_id", "source", "size", "source_size", "target", "src", "start", "blocks"))
    times = schedule(plan, slot_of).groupBy("src", "block").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    cols = ["doc_id", "source", "size", "source_size", "target"]
    words_taken = F.sum((F.col("to") - F.col("from")) * F.coalesce("times", F.lit(0))).alias("taken")
    taken = _pieces(at).join(times, ["src", "block"], "left").groupBy("_h", *cols, "src", "start").agg(words_taken, F.coalesce(F.min("slot"), F.lit(-1)).alias("first_slot"))
    none = at.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(-1).cast("long"))
    return taken.select(*cols, "taken", "first_slot").unionByName(none.select(*cols, "taken", "first_slot"))


def mixed_pieces(docs: DataFrame) -> DataFrame:
    """The mix itself: for every used slot the pieces of documents that make up its block, in slot order.

    Adds slot, start (of the piece in its source's stream) and n_words, and cuts ``text`` to the piece: its words with
    the white space after each, before the first word too where the piece begins its document. A slot's pieces in
    the order of start are its block, and each source has as many words as :func:`mix` takes of it. Further columns
    pass through (those named slot, start or n_words are replaced); documents without words have no piece.
    """
    rows = stash(sized(docs))
    plan = plan_sources(rows)
    at = stash(placed(rows, plan).select("_h", "source", "size", "source_size", "src", "start", "blocks"))
    taken = _pieces(at).join(schedule(plan).select("slot", "src", "block"), ["src", "block"])
    # of each document at once, so that a text is split once however many pieces it has
    part = F.struct("slot", F.col("from").alias("start"), (F.col("from") - F.col("start")).cast("int").alias("first"), (F.col("to") - F.col("from")).alias("n_words"))
    parts = taken.groupBy("_h", "source").agg(F.collect_list(part).alias("_parts"))
    kept = docs.drop("slot", "start", "n_words")
    keyed = kept.select(_hash().alias("h"), F.col("source").alias("of"), F.struct(*kept.columns).alias("row"))
    if not at.groupBy("_h", "source").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["h", "of"])  # equal rows' pieces are together in parts
    on = (keyed["h"] == parts["_h"]) & keyed["of"].eqNullSafe(parts["source"])
    blank = r"[\x20\x09-\x0D]"

    def cut(chunks: Column) -> Column:
        def piece(x: Column) -> Column:
            indent = F.when(x["first"] == 0, F.regexp_extract("row.text", rf"^{blank}*", 0)).otherwise("")
            words_of = F.array_join(F.slice(chunks, x["first"] + 1, x["n_words"].cast("int")), "")
            return F.struct(x["slot"].alias("slot"), x["start"].alias("start"), x["n_words"].alias("n_words"), F.concat(indent, words_of).alias("text"))

        return F.transform("_parts", piece)

    chunks = F.regexp_extract_all("row.text", F.lit(rf"[^\x20\x09-\x0D]+{blank}*"), F.lit(0))
    pieces = keyed.join(parts, on).select("row", F.explode(let(chunks, cut)).alias("piece"))
    others = [F.col("piece.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept.columns]
    return pieces.select(*others, "piece.slot", "piece.start", "piece.n_words").orderBy("slot", "start")


def mixture(docs: DataFrame) -> DataFrame:
    """The mixed corpus of whole documents, in slot order: a document comes at every slot of the block that holds its
    middle word.

    Columns stay as they are. Documents without words never come. Equal rows are taken alike: each comes as often
    as the first of them. For later stages that need whole documents; a source is off target by what the border of its
    taken blocks cuts off, less than one document. :func:`mixed_pieces` is exact.
    """
    rows = stash(sized(docs))
    plan = plan_sources(rows)
    at = placed(rows, plan).where("size > 0").groupBy("_h", "source", "src", "size", "blocks", "source_size").agg(F.min("start").alias("start"))
    middle = at.withColumn("block", _block_of("start + (size - 1) div 2"))
    taken = stash(middle.join(schedule(plan), ["src", "block"]).select("_h", "source", "slot", "start"))
    keyed = docs.select(_hash().alias("h"), F.col("source").alias("of"), F.struct(*docs.columns).alias("row"))
    joined = keyed.join(_small(taken), (F.col("h") == F.col("_h")) & F.col("of").eqNullSafe(F.col("source")))
    return joined.orderBy("slot", "start").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: one row per document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source")


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9, the mix: one row per piece of a document in a slot."""
    return mixed_pieces(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _oracle() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    # the sources that reach the cap are those of least size for their weight; the share per weight that is left
    # when the first k of them are capped is the right one for the first k that leaves no other above
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source),
w AS (SELECT *, [{weights}][src % {len(WEIGHTS)} + 1] AS weight, (SELECT CAST(sum(size) AS BIGINT) FROM d) AS total FROM s),
o AS (SELECT *, row_number() OVER r AS k, CAST(sum({CAP} * source_size) OVER (r ROWS UNBOUNDED PRECEDING) AS BIGINT) - {CAP} * source_size AS capped,
  CAST(sum(weight) OVER () - sum(weight) OVER (r ROWS UNBOUNDED PRECEDING) AS BIGINT) + weight AS open_weight FROM w WINDOW r AS (ORDER BY source_size / weight, src)),
f AS (SELECT min_by(CAST(total - capped AS DOUBLE), k) AS rest, min_by(CAST(open_weight AS DOUBLE), k) AS whole FROM o
  WHERE CAST(total - capped AS DOUBLE) * weight / open_weight <= {CAP} * source_size),
p AS (SELECT src, source, source_size, CASE WHEN rest * weight / whole > {CAP} * source_size THEN CAST({CAP} * source_size AS DOUBLE) ELSE rest * weight / whole END AS target,
  greatest(1, least({BLOCK_WORDS}, total // {BLOCKS})) AS each_words FROM w, f),
b AS (SELECT *, greatest(least(source_size, {MIN_BLOCKS}), (source_size + each_words - 1) // each_words) AS blocks FROM p),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least({CAP} * blocks, CAST(floor(target / source_size * blocks + 0.5) AS BIGINT)) ELSE 0 END AS slots FROM b),
n AS (SELECT *, CAST(sum(slots) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS BIGINT) - slots AS first,
  greatest(1, length(bin(greatest(CAST(sum(slots) OVER () AS BIGINT), 2) - 1))) AS bits FROM q),
pt AS (SELECT src, blocks, bits, unnest(range(first, first + slots)) AS point FROM n WHERE slots > 0),
sl AS (SELECT src, blocks, list_sum(list_transform(range(bits), lambda i: ((point >> CAST(i AS INTEGER)) & 1) << CAST(bits - 1 - i AS INTEGER))) AS slot FROM pt),
rk AS (SELECT src, slot, (row_number() OVER (PARTITION BY src ORDER BY slot) - 1) % blocks AS block FROM sl),
t AS (SELECT src, block, count(*) AS times, min(slot) AS slot FROM rk GROUP BY src, block),
pl AS (SELECT d.doc_id, d.h, d.size, n.src, n.source_size, n.target, n.blocks,
  CAST(sum(d.size) OVER (PARTITION BY n.src ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
pc AS (SELECT *, unnest(range(((start + 1) * blocks - 1) // source_size, ((start + size) * blocks - 1) // source_size + 1)) AS block FROM pl WHERE size > 0),
x AS (SELECT pc.doc_id, pc.h, pc.src, pc.start, CAST(sum((least(start + size, (pc.block + 1) * source_size // blocks)
  - greatest(start, pc.block * source_size // blocks)) * coalesce(times, 0)) AS BIGINT) AS taken, CAST(min(t.slot) AS BIGINT) AS first_slot
  FROM pc LEFT JOIN t ON pc.src = t.src AND pc.block = t.block GROUP BY pc.doc_id, pc.h, pc.src, pc.start)
SELECT pl.doc_id, pl.size, pl.source_size, pl.target, coalesce(x.taken, 0) AS taken, coalesce(x.first_slot, -1) AS first_slot
FROM pl LEFT JOIN x ON pl.size > 0 AND pl.doc_id IS NOT DISTINCT FROM x.doc_id AND pl.h = x.h AND pl.src = x.src AND pl.start = x.start"""


ORACLE = _oracle()
