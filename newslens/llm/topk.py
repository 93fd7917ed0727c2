"""Exact top-k search by pivot-table elimination.

Vectors are lifted by one coordinate to equal length; then the largest inner products with a query are
the smallest distances to it, and distances obey the triangle inequality. Every vector's distances to
the pivots are a row of a table that is computed once and written; the largest difference to the query's
row is a lower bound of its distance. Vectors are kept in shards by their nearest pivot. A query first
searches its own shard, which gives it a first k-th best score; then it goes to those shards whose ranges
of pivot distances can hold a better one. Candidates are evaluated exactly, in parts in the order of their
bounds, until the next bound exceeds the k-th best distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, stash, table

#: Components become floor(SCALE * x).
SCALE = 1024
K = 10
#: Pivots, and the rows (least hashes of the id) from which they are chosen.
PIVOTS, SAMPLE = 32, 1024
#: Bytes of a shard's vectors with their rows of the table, about, and queries that search a shard together.
SHARD_BYTES, BLOCK = 4 << 20, 4096
#: Shards, at most: their ranges go to all tasks. Beyond, shards are larger.
MAX_SHARDS = 50_000
#: Candidates that are evaluated first; then twice as many each time.
STEP = 256
#: Below this bound products are exact in 64-bit floats.
EXACT = 2.0**53


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, is_query and x, the integer components as doubles; without vectors that are null or hold null or
    non-finite components."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull()).select("vec_id", x.alias("x"), "is_query")


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other: each next one is farthest from its nearest chosen one."""
    if not len(sample):
        return sample
    chosen, near = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _padded(rows: pd.Series | list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _lifted(x: np.ndarray, square: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0.0))]


def _table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots."""
    return np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 1))


def _products(x: np.ndarray, q: np.ndarray, big: bool) -> np.ndarray:
    if not big:
        return (x @ q).astype(np.int64)
    ints = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in x], dtype=object)


def _reach(square: float, score: float) -> float:
    """The distance of two vectors of length sqrt(square) with this product, and a little for rounding in the bounds."""
    return math.sqrt(max(0.0, 2 * square - 2 * score)) + 1e-9 * (math.sqrt(square) + 1) + 1e-6


def search_shard(
    rows: np.ndarray, ids: np.ndarray, x: np.ndarray, distances: np.ndarray, square: float, q_row: int, q: np.ndarray, q_distances: np.ndarray,
    k: int, big: bool, known: float | None = None,
) -> tuple[list[tuple[int, int]], int]:
    """The shard's (score, id) that can be among the k best of one query, best first, k at most, and how many were
    evaluated. ``distances`` is the shard's pivot table; ``known`` a score that k others reach."""
    bounds = np.abs(distances - q_distances).max(axis=1)
    reach = math.inf if known is None else _reach(square, known)
    order = np.flatnonzero((bounds <= reach) & (rows != q_row))
    order = order[np.argsort(bounds[order], kind="stable")]
    best: list[tuple[int, int]] = []
    start, step = 0, STEP
    while start < len(order) and bounds[order[start]] <= reach:
        part = order[start : start + step]
        got, of = _products(x[part], q, big), ids[part]
        if len(part) > 4 * k and not big:  # most can't be among the best
            least = np.partition(got, len(got) - k)[len(got) - k]
            got, of = got[got >= least], of[got >= least]
        best += zip(got.tolist(), of.tolist(), strict=True)
        best.sort(key=lambda t: (-t[0], t[1]))
        del best[k:]
        start, step = start + len(part), 2 * step
        if len(best) == k:
            reach = min(reach, _reach(square, float(best[-1][0])))
    return [b for b in best if known is None or b[0] >= known], min(start, len(order))


_TABLE = "row long, vec_id long, is_query boolean, x binary, d binary, cell int"
_FOUND = "kind int, row long, query_id long, vec_id long, score long, low binary, high binary, shard int, evaluated long"
_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def pivot_table(base: DataFrame, pivots: np.ndarray, square: float, width: int) -> DataFrame:
    """row, vec_id, is_query, x, the distances d to the pivots, and the nearest pivot as cell, of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column("x").to_pylist(), width)
            d = _table(_lifted(x, square), pivots)
            held = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, d)]
            cells = pa.array(d.argmin(axis=1).astype(np.int32) if len(d) else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "is_query")), *held, cells], names=["row", "vec_id", "is_query", "x", "d", "cell"])

    return base.mapInArrow(run, _TABLE)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in column])


def _rows(kind: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES[1:])
    out.insert(0, "kind", kind)
    return out


def exact_topk(vectors: DataFrame, is_query: Column, k: int = K, report: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows, ties to smaller ids.

    Queries are the rows of ``vectors`` (vec_id, embedding) for which ``is_query`` holds; candidates are all
    other rows. Null vectors, vectors with null or non-finite components and rows without an id take no part.
    Shorter vectors count as padded with zeros. A query without candidates gives no rows. Repeated rows are
    queries and candidates each: a copy of a query is a candidate of it, and the answers to copies of one id are
    rows of that id, k for each. Scores beyond 64 bits are cut to the range. Other columns are left out. With
    ``report`` the result has one row instead: ``evaluated``, the share of pairs whose product was computed.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = stash(scaled(vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False)))).withColumn("row", F.monotonically_increasing_id()))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    facts = base.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("nq"), F.max(norm).alias("square"), F.max(F.size("x")).alias("width")).first()
    out = "evaluated double" if report else "query_id long, rank int, vec_id long, score long"
    if not facts["n"] or not facts["nq"]:
        return spark.createDataFrame([], out)
    square, width = facts["square"], facts["width"] or 0
    big = square >= EXACT
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    pivots = choose_pivots(_lifted(_padded(sample["x"], width), square), PIVOTS)

    per_shard = max(256, SHARD_BYTES // (8 * (width + PIVOTS)), facts["n"] // MAX_SHARDS)
    measured = stash(pivot_table(base, pivots, square, width))
    cells, shard, first = measured.groupBy("cell").count().orderBy("cell").collect(), F.lit(0), 0  # a row for each pivot
    for c in cells:
        many = -(-c["count"] // per_shard)
        shard = F.when(F.col("cell") == c["cell"], first + F.pmod(F.xxhash64("row"), F.lit(many))).otherwise(shard)
        first += many
    data = measured.withColumn("shard", shard.cast("int")).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(max(1, facts["nq"] // BLOCK))).cast("int"))
    queries = data.where("is_query").select("row", F.col("vec_id").alias("query_id"), F.col("x").alias("y"), F.col("d").alias("dy"), "shard", "block")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        ids, rows = left["vec_id"].to_numpy(np.int64), left["row"].to_numpy(np.int64)
        x, d = _matrix(left["x"]), _matrix(left["d"])
        found = []
        known = right["known"].tolist() if "known" in right else [None] * len(right)
        for q_row, q_id, y, dy, bound in zip(right["row"].tolist(), right["query_id"].tolist(), right["y"], right["dy"], known, strict=True):
            bound = None if bound is None or bound != bound else bound
            got, n = search_shard(rows, ids, x, d, square, q_row, np.frombuffer(y, np.float64), np.frombuffer(dy, np.float64), k, big, bound)
            found.append((q_row, q_id, None, None, None, None, None, n))
            found += [(q_row, q_id, i, max(-(2**63), min(2**63 - 1, s)), None, None, None, 0) for s, i in got]
        return found

    def own_shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        d = _matrix(left["d"])
        here = [(None, None, None, None, d.min(axis=0).tobytes(), d.max(axis=0).tobytes(), int(left["shard"].iloc[0]), 0)]
        return pd.concat([_rows(0, here), _rows(1, search(left, right))]) if len(right) else _rows(0, here)

    def other_shard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _rows(1, search(left, right) if len(left) and len(right) else [])

    # queries of one shard are together in a block, as many as they are; a shard's vectors bound them
    near = stash(data.groupBy("shard").cogroup(queries.groupBy("shard")).applyInPandas(own_shard, _FOUND))
    hits = near.where("kind = 1 AND vec_id IS NOT NULL").select("row", "query_id", "vec_id", "score")
    ranges = near.where("kind = 0").select("shard", "low", "high").toPandas()
    numbers = ranges["shard"].to_numpy(np.int32)
    shared = spark.sparkContext.broadcast((numbers, _matrix(ranges["low"]), _matrix(ranges["high"])))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, low, high = shared.value
        for batch in batches:
            to = []
            for dy, own, known in zip(batch.column("dy"), batch.column("shard"), batch.column("known"), strict=True):
                y = np.frombuffer(dy.as_py(), np.float64)
                reach = math.inf if known.as_py() is None else _reach(square, float(known.as_py()))
                least = np.maximum(np.maximum(y - high, low - y), 0).max(axis=1)
                to.append(numbers[(least <= reach) & (numbers != own.as_py())])
            ends = pa.array(np.cumsum([0, *map(len, to)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(to) if to else np.zeros(0, np.int32)))
            kept = ["row", "query_id", "y", "dy", "block", "known"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "to"])

    order = F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), F.col("vec_id").alias("vec_id"), F.col("score").alias("score"))
    best = lambda lists: F.slice(F.sort_array(lists), 1, k).alias("l")
    firsts = hits.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("known"))  # k rows for each at most
    asked = queries.join(firsts, "row", "left").mapInArrow(visits, "row long, query_id long, y binary, dy binary, block int, known long, to array<int>")
    asked = asked.select("row", "query_id", "y", "dy", "block", "known", F.explode("to").alias("shard"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(1, facts["nq"] // BLOCK) - 1)))
    held = data.select("row", "vec_id", "x", "d", "shard", blocks.alias("block"))
    far = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(other_shard, _FOUND)
    if report:
        pairs = float(facts["nq"] * (facts["n"] - 1)) or 1.0
        return near.unionByName(far).agg((F.sum("evaluated") / pairs).alias("evaluated"))
    drop(base)
    every = hits.union(far.where("vec_id IS NOT NULL").select("row", "query_id", "vec_id", "score"))
    # shards are merged in two steps, so that no task gets all of a query's lists
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.isqrt(first))))
    parts = every.groupBy("row", "query_id", part.alias("p")).agg(best(F.collect_list(order)))
    last = parts.groupBy("row", "query_id").agg(best(F.flatten(F.collect_list("l"))))
    ranked = last.select("query_id", F.posexplode("l").alias("rank", "e"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: queries are the rows with an id divisible by 100."""
    return exact_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""
