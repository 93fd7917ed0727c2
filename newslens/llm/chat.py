"""Chat formatting by quotation linking: reply-ordered conversations without quotes.

Quoted passages (runs of lines of one quote level) are normalised and hashed and joined to the
messages of the same conversation that hold the same passage; the reply's parent is the original of
its outermost quote. Parents give threads, and threads an order in which each message comes after the
one that it answers. Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, let, stash, table

#: Leading quote marks of a line.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
#: A line that names whom the next, quoted lines come from (fixed values: English, German, French, Spanish).
CREDIT = r"(?i)^(?:on\b.*\bwrote|.*\b(?:schrieb|escribió)|.*\ba écrit)[ \t]*:[ \t]*$"
#: Turns that one ranking orders.
CHUNK = 256


def _normal(x: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.btrim(F.regexp_replace(F.lower(x), "[ \\t\\n\\x0B\\f\\r]+", " "), F.lit(WS))


def _lines(text: Column) -> Column:
    """array<struct<level, body>> of the text's lines; level is the number of leading quote marks."""
    one = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]+", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"),
    )
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), one)


def _own(lines: Column) -> Column:
    """Bodies of the unquoted lines, without those that credit a following quote."""
    credit = lambda x, i: x["body"].rlike(CREDIT) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~credit(x, i))
    return F.transform(kept, lambda x: x["body"])


def _passages(lines: Column) -> Column:
    """array<struct<level, text>>: runs of lines of one level of one or more."""
    starts = F.filter(
        F.transform(lines, lambda x, i: F.when((x["level"] > 0) & ((i == 0) | (F.coalesce(F.get(lines, i - 1)["level"], F.lit(0)) != x["level"])), i)),
        lambda i: i.isNotNull(),
    )

    def run(i: Column, k: Column, s: Column) -> Column:
        level = F.get(lines, i)["level"]
        part = F.slice(lines, i + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - i)
        return F.struct(level.alias("level"), F.array_join(F.transform(F.filter(part, lambda y: y["level"] == level), lambda y: y["body"]), "\n").alias("text"))

    return let(starts, lambda s: F.transform(s, lambda i, k: run(i, k, s)))


def _keys(text: Column) -> Column:
    """Hashes of a text as a whole, of its paragraphs and of its lines."""
    parts = F.concat(F.array(text), F.split(text, "\\n[ \\t]*\\n"), F.split(text, "\\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, _normal), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _with_roots(links: DataFrame) -> DataFrame:
    """(c, t, p) with p < t → (c, t, root, depth): each step doubles the way that a message looks back."""
    now = stash(links.select("c", "t", F.col("p").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("c", F.col("t").alias("root"), F.col("root").alias("over"), F.col("depth").alias("more"))
        both = stash(now.join(up, ["c", "root"], "left"))
        now = both.select("c", "t", F.coalesce("over", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if not both.where("over IS NOT NULL").limit(1).count():
            return now


def _before(rows: DataFrame, keys: list[str], by: str, weight: Column) -> DataFrame:
    """Adds ``before``: the weights of the rows of the same keys with a smaller ``by``; in chunks, so that no
    task ranks a whole group. ``by`` is unique within the keys."""
    r = rows.withColumn("chunk", F.floor(F.col(by) / CHUNK)).withColumn("w", weight)
    chunks = r.groupBy(*keys, "chunk").agg(F.sum("w").alias("n"))
    earlier = chunks.select(*keys, "chunk", (F.sum("n").over(Window.partitionBy(*keys).orderBy("chunk")) - F.col("n")).alias("earlier"))
    inside = r.withColumn("inside", F.sum("w").over(Window.partitionBy(*keys, "chunk").orderBy(by)) - F.col("w"))
    return inside.join(earlier, [*keys, "chunk"]).withColumn("before", F.col("earlier") + F.col("inside")).drop("chunk", "w", "earlier", "inside")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quotes, parent_turn, thread_turn, depth and position of every message.

    text is the message without quoted lines and their credit line, trimmed if it had any, else unchanged.
    parent_turn is the earliest turn of the conversation, before the message's own, that holds the message's
    quoted passage (else one of its lines); of several quotes the one of least level, then the first, counts.
    thread_turn is the first message of the chain of parents (the own turn without one), depth the chain's
    length, position the place from 0 when threads follow each other by their first turns and the messages of
    a thread by turn. Rows of one conversation and turn share these. A message without conv_id or turn has no
    parent and a null position. Null text stays null with no quotes; an empty table gives an empty result;
    other columns are left out.
    """
    lines = _lines(F.col("text"))
    m = messages.select("conv_id", "turn", "role", "text")
    quoted = F.coalesce(F.col("text").rlike("(?m)^[ \\t]*>"), F.lit(False))
    parsed = stash(
        m.withColumn("own", F.when(quoted, F.btrim(F.array_join(let(lines, _own), "\n"), F.lit(WS))).otherwise(F.col("text")))
        .withColumn("quotes", F.when(quoted, let(lines, _passages)))
    )
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    whole = F.array(F.xxhash64(_normal(F.col("q.text"))))  # the passage first, then its parts
    asked = stash(
        placed.where("quotes IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.posexplode("quotes").alias("at", "q"))
        .select("c", "t", "at", "q.level", F.posexplode(F.concat(whole, F.array_except(_keys(F.col("q.text")), whole))).alias("k", "key"))
    )
    turns = stash(placed.select(F.col("conv_id").alias("c"), F.col("turn").alias("t")).distinct())
    if asked.limit(1).count():
        sought = stash(asked.select("c").distinct())
        held = (
            placed.select(F.col("conv_id").alias("c"), F.col("turn").alias("p"), "own").join(sought, "c", "left_semi")
            .select("c", "p", F.explode(_keys(F.coalesce("own", F.lit("")))).alias("key")).groupBy("c", "key").agg(F.min("p").alias("p"))
        )
        best = F.min(F.struct("level", F.least("k", F.lit(1)).alias("k"), "at", "p"))
        links = asked.join(stash(held), ["c", "key"]).where("p < t").groupBy("c", "t").agg(best.alias("b")).select("c", "t", F.col("b.p").alias("p"))
        links = stash(links)
        roots = _with_roots(links).join(links, ["c", "t"])
        turns = turns.join(roots, ["c", "t"], "left")
    else:
        nothing = F.lit(None).cast("long")
        turns = turns.withColumns({"root": nothing, "depth": nothing, "p": nothing})
    turns = stash(turns.select("c", "t", "p", F.coalesce("root", "t").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")))
    threads = _before(turns.groupBy("c", "root").agg(F.count("*").alias("n")), ["c"], "root", F.col("n")).select("c", "root", F.col("before").alias("threads"))
    order = _before(turns, ["c", "root"], "t", F.lit(1).cast("long"))
    where = stash(order.join(stash(threads), ["c", "root"]).select("c", "t", "p", "root", "depth", (F.col("threads") + F.col("before")).alias("position")))
    return parsed.join(where, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.when(F.col("quotes").isNull(), F.lit(0)).otherwise(F.size("quotes")).cast("long").alias("n_quotes"),
        F.col("p").alias("parent_turn"), F.coalesce("root", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "position",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: one row per message; parent_turn is -1 for a message without one."""
    return link_quotes(table(spark, sf_dir, "conversations")).withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1).cast("long")))


_NORMAL = r"trim(regexp_replace(lower({0}), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"

ORACLE = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text, coalesce(regexp_matches(text, '(?m)^[ \t]*>'), false) AS quoted FROM conversations),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m WHERE quoted),
v AS (SELECT id, i, length(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]+', '', 'g')) AS level, regexp_replace(line, '{MARKS}', '') AS body FROM l),
n AS (SELECT *, lag(level) OVER w AS last_level, lead(level) OVER w AS next_level FROM v WINDOW w AS (PARTITION BY id ORDER BY i)),
o AS (SELECT id, string_agg(body, chr(10) ORDER BY i) AS own FROM n WHERE level = 0 AND NOT (regexp_matches(body, '{CREDIT}') AND coalesce(next_level > 0, false)) GROUP BY id),
p AS (SELECT m.*, CASE WHEN quoted THEN trim(coalesce(own, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE text END AS own FROM m LEFT JOIN o USING (id)),
r AS (SELECT *, sum(CASE WHEN last_level IS DISTINCT FROM level THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run FROM n),
q AS (SELECT id, level, run, string_agg(body, chr(10) ORDER BY i) AS passage, row_number() OVER (PARTITION BY id ORDER BY run) AS place FROM r WHERE level > 0 GROUP BY id, level, run),
c AS (SELECT id, count(*) AS n_quotes FROM q GROUP BY id),
a AS (SELECT conv_id AS c, turn AS t, place, level, k, {_NORMAL.format("part")} AS key FROM (SELECT p.conv_id, p.turn, place, level,
  unnest(list_concat([passage], regexp_split_to_array(passage, '\n[ \t]*\n'), string_split(passage, chr(10)))) AS part,
  unnest(list_concat([0], list_transform(regexp_split_to_array(passage, '\n[ \t]*\n'), lambda x: 1), list_transform(string_split(passage, chr(10)), lambda x: 1))) AS k
  FROM q JOIN p USING (id) WHERE p.conv_id IS NOT NULL AND p.turn IS NOT NULL)),
h AS (SELECT c, key, min(t) AS p FROM (SELECT conv_id AS c, turn AS t, {_NORMAL.format("part")} AS key FROM (SELECT conv_id, turn,
  unnest(list_concat([own], regexp_split_to_array(own, '\n[ \t]*\n'), string_split(own, chr(10)))) AS part FROM p WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND own IS NOT NULL)) WHERE key <> '' GROUP BY c, key),
b AS (SELECT a.c, a.t, min(struct_pack(level := level, k := k, place := place, p := h.p)) AS b FROM a JOIN h ON a.c = h.c AND a.key = h.key WHERE h.p < a.t GROUP BY a.c, a.t),
u AS (SELECT DISTINCT conv_id AS c, turn AS t FROM p WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
g(c, t, root, depth) AS (SELECT c, t, t, 0 FROM u UNION ALL SELECT g.c, g.t, b.b.p, depth + 1 FROM g JOIN b ON b.c = g.c AND b.t = g.root),
z AS (SELECT c, t, min(root) AS root, CAST(max(depth) AS BIGINT) AS depth FROM g GROUP BY c, t),
y AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY root, t) - 1 AS position FROM z)
SELECT p.conv_id AS conv_id, p.turn AS turn, role, own AS text, coalesce(n_quotes, 0) AS n_quotes, coalesce(b.b.p, -1) AS parent_turn, coalesce(root, p.turn) AS thread_turn, coalesce(depth, 0) AS depth, position
FROM p LEFT JOIN c USING (id) LEFT JOIN y ON y.c = p.conv_id AND y.t = p.turn LEFT JOIN b ON b.c = p.conv_id AND b.t = p.turn"""


def quoted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over conversations in which each message quotes the one before it (of an even turn, the one before that)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = c.groupBy("conv_id", "turn").agg(F.min("text").alias("said")).withColumnRenamed("turn", "of")
    replies = c.withColumn("of", F.col("turn") - 1 - F.when(F.col("turn") % 2 == 0, 1).otherwise(0)).join(said, ["conv_id", "of"], "left")
    quote = F.concat(F.lit("> "), F.replace("said", F.lit("\n"), F.lit("\n> ")), F.lit("\n"), "text")
    told = replies.select("conv_id", "turn", "role", F.when(F.col("said").isNull(), F.col("text")).otherwise(quote).alias("text"))
    return link_quotes(told).withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1).cast("long")))


QUOTED_ORACLE = ORACLE.replace("FROM conversations)", "FROM told)").replace("WITH RECURSIVE m AS", """WITH RECURSIVE told AS (SELECT c.conv_id AS conv_id, c.turn AS turn, role,
  CASE WHEN said IS NULL THEN c.text ELSE '> ' || replace(said, chr(10), chr(10) || '> ') || chr(10) || c.text END AS text FROM conversations c
  LEFT JOIN (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL) s ON s.conv_id = c.conv_id AND s.turn = c.turn - 1 - CASE WHEN c.turn % 2 = 0 THEN 1 ELSE 0 END),
m AS""")
