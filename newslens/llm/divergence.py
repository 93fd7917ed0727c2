"""Source divergence audit: how far the sources of a language differ in their use of its terms.

Every (language, source) group and every language as a whole gives each kept term of the language a smoothed share
of its occurrences, in integers. Most terms have the same counts in the same sources, so the terms' sparse
source-count vectors are grouped first and each distinct vector is evaluated once, times its number of terms. A
vector is evaluated only for the pairs of sources that both hold it; what a pair has where one of them or both
count nothing depends on one count alone and comes from a table of the groups' counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stash, table

#: Documents of its language that hold a kept term, at least.
MIN_DOCS = 3
#: Scale of the shares.
SCALE = 1_000_000_000
#: Terms that a group's report lists, at most.
TOP_TERMS = 200
#: (group, term) counts that a task gathers before it sends them on.
HELD = 400_000
#: Parts of a language's sources, so that no task joins all pairs of a language.
SALTS = 16

# A-Z become small letters, other ASCII letters and all bytes beyond ASCII stay, the rest separates terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents, summed over what the task holds at a time."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).view(pa.string()),
                    pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = text.as_py().translate(_TERMS).split()
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if held >= HELD:
                yield from sent()
                held = 0
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = texts.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); decimals, as the product outgrows 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0))) div cast({total} + {terms} as decimal(19, 0))")


def _far(p: str, q: str) -> str:
    """floor((p - q)^2 / q) as SQL; shares are at most SCALE + 1, so that the square fits 64 bits."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def _times(m: str, value: str) -> Column:
    return F.expr(f"cast({m} as decimal(19, 0)) * cast({value} as decimal(19, 0))")


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, term and vector, the (source, n) of the sources that hold the term in code point order."""
    entry = F.struct("source", "n")
    terms = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(entry)).alias("vector"))
    return terms.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "vector")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), terms (kept ones of the language) and zero (the share of none)."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.select("lang", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    none = F.lit(0).cast("long")
    full = named.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    full = full.select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("terms", none).alias("terms"))
    return full.withColumn("zero", F.when(F.col("terms") > 0, _share("0L", "total", "terms")).otherwise(F.lit(1)).cast("long"))


def _with_others(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row of a (lang, source) with every other source of the language as ``b`` and its zero share ``zero_b``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    others = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("_salt"))
    return salted.join(others, ["lang", "_salt"]).where("source <> b").drop("_salt")


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value, f summed over all kept terms.

    With f(x, y) for the counts x of the source and y of the other, the sum is that of f(0, 0) over all terms, of
    f(x, 0) - f(0, 0) and f(0, y) - f(0, 0) over the counts above 0 of either, and of f(x, y) - f(x, 0) - f(0, y)
    + f(0, 0) over the terms that both hold.
    """
    vectors = stash(kept.groupBy("lang", "vector").agg(F.count("*").alias("m")))
    pairs = _with_others(groups.select("lang", "source", "terms", "zero"), groups)
    base = pairs.select("lang", "source", F.col("b").alias("item"), _times("terms", _far("zero", "zero_b")).alias("value"))

    counts = vectors.select("lang", "m", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(F.sum("m").alias("m"))
    own = counts.join(groups, ["lang", "source"]).select("lang", "source", "m", "zero", _share("n", "total", "terms").alias("p"))
    one = _with_others(own, groups)
    as_source = F.struct(F.col("source").alias("source"), F.col("b").alias("item"), _times("m", f"{_far('p', 'zero_b')} - {_far('zero', 'zero_b')}").alias("value"))
    as_other = F.struct(F.col("b").alias("source"), F.col("source").alias("item"), _times("m", f"{_far('zero_b', 'p')} - {_far('zero_b', 'zero')}").alias("value"))
    single = one.select("lang", F.explode(F.array(as_source, as_other)).alias("x")).select("lang", "x.*")

    # each pair of a vector's entries once, in the order of the sources; both directions follow from its counts
    first = vectors.where("size(vector) > 1").select("lang", "m", "vector", F.posexplode("vector").alias("i", "x"))
    met = first.select("lang", "m", "x", F.explode(F.expr("slice(vector, i + 2, size(vector))")).alias("y"))
    met = met.groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n"), F.col("y.source").alias("item"), F.col("y.n").alias("n_b")).agg(F.sum("m").alias("m"))
    other = groups.select("lang", F.col("source").alias("item"), *[F.col(c).alias(f"{c}_b") for c in ("total", "zero")])
    met = met.join(groups, ["lang", "source"]).join(other, ["lang", "item"])
    met = met.withColumn("p", _share("n", "total", "terms")).withColumn("q", _share("n_b", "total_b", "terms"))
    over = lambda p, zero, q, zero_b: f"{_far(p, q)} - {_far(p, zero_b)} - {_far(zero, q)} + {_far(zero, zero_b)}"
    there = F.struct("source", "item", _times("m", over("p", "zero", "q", "zero_b")).alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), _times("m", over("q", "zero_b", "p", "zero")).alias("value"))
    both = met.select("lang", F.explode(F.array(there, back)).alias("x")).select("lang", "x.*")

    return base.unionByName(single).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that the source holds more than its language does) and value f."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    n_lang = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    each = kept.select("lang", F.col("term").alias("item"), n_lang.alias("n_lang"), F.explode("vector").alias("x")).select("lang", "item", "n_lang", "x.source", "x.n")
    full = each.join(groups.join(whole, "lang"), ["lang", "source"])
    shared = full.select("lang", "source", "item", _share("n", "total", "terms").alias("p"), _share("n_lang", "total_lang", "terms").alias("q"))
    return shared.where("p > q").select("lang", "source", "item", F.expr(_far("p", "q")).alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank.

    Null text, lang and source count as ''; documents without terms still make their group, which then differs from
    the others by what these have; a language without kept terms has pairs of value 0 and no terms; repeated rows
    are documents of their own; very long texts are counted whole; equal values rank by the item's UTF-8; other columns
    are left out; an empty table gives an empty result.
    """
    kept = stash(kept_terms(docs))
    groups = stash(groups_of(docs, kept))
    out = []
    for part, rows in (("pair", pair_values(kept, groups)), ("term", term_values(kept, groups))):
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        ranked = rows.withColumn("rank", F.row_number().over(order))
        ranked = ranked.where(F.col("rank") <= TOP_TERMS) if part == "term" else ranked
        out.append(ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank"))
    return out[0].unionByName(out[1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the whole audit of documents."""
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), o AS (SELECT doc_id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang AS lang, g.source AS source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang AS lang, s.source AS source, k.term AS term, coalesce(n, 0) AS n, 1 + (CAST({SCALE} AS HUGEINT) * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
w AS (SELECT lang, term, 1 + (CAST({SCALE} AS HUGEINT) * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q FROM c JOIN v USING (lang)
  JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang AS lang, a.source AS source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
x AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN w ON w.lang = p.lang AND w.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
