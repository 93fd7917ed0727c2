"""N-gram Jaccard join, size-aware: subsets of fixed size for small sets, inverted lists for large ones.

Two sets of n and m shingles link when they share at least c(n, m) = ceil(4 (n + m) / 9) of them
(Jaccard 0.8). Sets up to a boundary size meet through their subsets of c shingles; for larger ones
the lists of their first shingles are scanned, in an order that puts frequent shingles last, since
two linked sets share one of their first n - ceil(0.8 n) + 1. The boundary is the one of least cost
by the counts of sets and list lengths. Equal sets form one class, and only classes are joined. A
frequent shingle's list is joined to a leader in rounds first, so that of a large group of near
copies only members that are still apart are compared. Every candidate is checked on its whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import bounded_batches, drop, release, stash, table
from .shingles import SHINGLE, mix, sets_of_batches

#: A shingle in more documents than this is frequent; no list of more classes is scanned pair by pair in one task.
FREQUENT = 8
#: Shingles (five bytes each) that every task knows to be frequent: those in the most documents. Lists that turn out
#: long beyond these are treated as the frequent ones are.
KNOWN_FREQUENT = 1_000_000
#: Largest boundary between subsets and lists that is tried.
MAX_BOUNDARY = 12
#: Shingles that one group of the counting and scanning steps gets, about, and the least number of groups.
GROUP, MIN_GROUPS = 1_000_000, 64
#: Shingles that a task holds before it hands on its groups.
HELD = 500_000
#: Rounds of leaders for the frequent shingles' lists, leaders of a list, and the pairs for each entry of these lists
#: from which on rounds cost less than comparing all members at once.
ROUNDS, LEADERS, LEADER_PAIRS = 3, 4, 16
#: Sets to check up to which their ids are broadcast.
BROADCAST_IDS = 300_000
#: Shingles of all sets that one group of candidates holds, about.
CHECKED = 1_000_000
#: 64-bit words of the short parity sketch, and of the longest full one (which has two bits for each shingle, at least).
SKETCH, MAX_SKETCH = 8, 1 << 20

_LOW = np.uint64(0xFFFFFFFF)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def overlap(n: int, m: int) -> int:
    """Least number of shared shingles at which sets of n and m link."""
    return -(-4 * (n + m) // 9)


def prefix_size(n):
    """Shingles of which one is shared with every linked set."""
    return n - (4 * n + 4) // 5 + 1


def class_id(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over the set."""
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ _OTHER).sum(dtype=np.uint64).astype(np.int64))


def parity_sketch(s: np.ndarray, words: int) -> np.ndarray:
    """Bit i is the parity of the shingles that fall on i: sketches of two sets differ in at most as many
    bits as the sets differ in shingles. Halves of a sketch, one xor the other, are the sketch of half the words."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def sketch_words(n: int) -> int:
    """Words of a set's full sketch: a power of two with two bits for each shingle."""
    return max(SKETCH, min(MAX_SKETCH, 1 << max(0, (n - 1).bit_length() - 5)))


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets by which a set of n meets its partners up to the boundary."""
    if n > boundary:
        return []
    partners = range((4 * n + 4) // 5, min(boundary, 5 * n // 4) + 1)
    return sorted({overlap(n, m) for m in partners if m != n or overlap(n, n) < n})


def uses_lists(n: int, boundary: int) -> bool:
    return n > boundary or 5 * n // 4 > boundary


def best_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The boundary with the fewest subsets and list entries together."""

    def cost(b: int) -> float:
        subsets = sum(c * math.comb(n, k) for n, c in sizes.items() for k in subset_sizes(n, b))
        return subsets + sum(c * prefix_size(n) * (1 + list_length) for n, c in sizes.items() if uses_lists(n, b))

    return min(range(4, MAX_BOUNDARY + 1), key=cost)


# ---- how frequent shingles are


def _group_of(low: np.ndarray, groups: int) -> np.ndarray:
    """The group, of so many, of shingles by their low halves; rising with them."""
    return (low.astype(np.uint64) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal numbers begin and end."""
    cuts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
    return cuts, np.r_[cuts[1:], len(x)] if len(x) else cuts


def _gaps(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as 16-bit gaps; a gap that doesn't fit is 65535 and follows at the end in full."""
    d = np.diff(x, prepend=np.uint32(0))
    wide = d >= 65535
    return np.uint32(len(x)).tobytes() + np.where(wide, 65535, d).astype("<u2").tobytes() + d[wide].astype("<u4").tobytes()


def _ungap(p: bytes) -> np.ndarray:
    n = int(np.frombuffer(p, "<u4", 1)[0])
    d = np.frombuffer(p, "<u2", n, 4).astype(np.uint32)
    d[d == 65535] = np.frombuffer(p, "<u4", -1, 4 + 2 * n)
    return np.cumsum(d, dtype=np.uint32)


def _frequencies(docs: DataFrame, groups: int) -> DataFrame:
    """kind 0: (shingle's low half, its document count) above FREQUENT; 1: (set size, sets) of small sizes;
    2: (sum of counts, sum of their squares up to FREQUENT) of a group.

    A task counts what it holds first, so that a shingle of a third of all documents reaches its group as
    one number and its count for every HELD shingles read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        small = np.zeros(2 * MAX_BOUNDARY, np.int64)
        n = 0

        def packed() -> pa.RecordBatch:
            x, count = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint32), return_counts=True)
            g, many, cuts, ends, payloads = _group_of(x, groups), np.flatnonzero(count > 1), *_runs(_group_of(x, groups)), []
            lows = np.searchsorted(many, cuts)
            highs = np.searchsorted(many, ends)
            for a, b, i, j in zip(cuts.tolist(), ends.tolist(), lows.tolist(), highs.tolist(), strict=True):
                at = many[i:j]
                payloads.append(np.uint32(j - i).tobytes() + (at - a).astype("<u4").tobytes() + count[at].astype("<u4").tobytes() + _gaps(x[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(g[cuts], pa.int32()), pa.array(payloads, pa.binary())], names=["g", "payload"])

        for _, sets in sets_of_batches(batches):
            for s in sets:
                if len(s):
                    held.append((s & _LOW).astype(np.uint32))
                    n += len(s)
                    if len(s) < len(small):
                        small[len(s)] += 1
                if n >= HELD:
                    yield packed()
                    held.clear()
                    n = 0
        yield packed()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([small.tobytes()], pa.binary())], names=["g", "payload"])

    def opened(p: bytes) -> tuple[np.ndarray, np.ndarray]:
        k = int(np.frombuffer(p, "<u4", 1)[0])
        at, count = np.frombuffer(p, "<u4", 2 * k, 4).reshape(2, k)
        x = _ungap(p[4 + 8 * k :])
        n = np.ones(len(x), np.int64)
        n[at] = count
        return x, n

    def count(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            total = sum(np.frombuffer(p, np.int64) for p in rows["payload"])
            return pd.DataFrame({"kind": 1, "a": np.arange(len(total)), "b": total})[total > 0]
        parts = [opened(p) for p in rows["payload"]]
        x, each = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(x, kind="stable")
        x = x[order]
        cuts, _ = _runs(x)
        n = np.add.reduceat(each[order], cuts)
        many, usual = n > FREQUENT, n[n <= FREQUENT]
        return pd.DataFrame({
            "kind": [2] + [0] * int(many.sum()),
            "a": [int(usual.sum()), *x[cuts][many].tolist()],
            "b": [int((usual * usual).sum()), *n[many].tolist()],
        })

    return docs.mapInArrow(pack, "g int, payload binary").groupBy("g").applyInPandas(count, "kind int, a long, b long")


def _known(found: DataFrame) -> bytes:
    """The frequent shingles' low halves in order, and the logarithms of their counts."""
    many = found.where("kind = 0").select("a", F.least(F.log2("b").cast("int"), F.lit(255)).alias("b"))
    per_level = {r["b"]: r["count"] for r in many.groupBy("b").count().collect()}  # 64 rows at most
    total, least = 0, 256
    for level in sorted(per_level, reverse=True):
        total += per_level[level]
        if total > KNOWN_FREQUENT:
            break
        least = level
    top = many.where(F.col("b") >= least).orderBy("a").toPandas()
    return top["a"].to_numpy(np.uint32).tobytes() + top["b"].to_numpy(np.uint8).tobytes()


@lru_cache(maxsize=1)
def _unpacked(key: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(key) // 5
    return np.frombuffer(key, np.uint32, n), np.frombuffer(key, np.uint8, n, 4 * n)


# ---- entries of lists and subsets

_SCHEMA = pa.schema([
    ("kind", pa.int8()), ("g", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()),
    ("f2", pa.int64()), ("token", pa.int64()), ("pos", pa.int32()), ("sketch", pa.list_(pa.int64())), ("full", pa.list_(pa.int64())),
])
_ROWS = "kind byte, g int, payload binary, doc_id long, n int, f1 long, f2 long, token long, pos int, sketch array<long>, full array<long>"


def _batch(kind: int, **columns: list | np.ndarray | pa.Array) -> pa.RecordBatch:
    """Rows of one kind; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    made = {k: v if isinstance(v, pa.Array) else pa.array(v, _SCHEMA.field(k).type) for k, v in columns.items()}
    made["kind"] = pa.array(np.full(n, kind, np.int8))
    return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _subset_key(s: np.ndarray, sub: tuple[int, ...]) -> int:
    return int(mix(np.array([mix(s[list(sub)]).sum(dtype=np.uint64)]))[0].astype(np.int64))


def _entries(docs: DataFrame, groups: int, frequent: bytes, boundary: int) -> DataFrame:
    """kind 0: a document; 1: a group of list entries (shingles, sizes, class ids); 2: an entry of a frequent
    shingle's list; 3: a subset (token) of size pos. Of equal sets that a task reads only one has entries."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def lists_of(found: list[np.ndarray | None]) -> pa.ListArray:
        """Arrays of numbers, null where there are none."""
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in found)])
        values = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int64)])
        missing = np.array([x is None for x in found] + [False])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=missing), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, levels = _unpacked(shared.value)
        seen: set[tuple[int, int]] = set()
        lists: list[tuple[np.ndarray, int, int]] = []
        n_held = 0

        def packed() -> pa.RecordBatch:
            each = [len(t) for t, _, _ in lists]
            t = np.concatenate([t for t, _, _ in lists]) if lists else np.zeros(0, np.uint32)
            n = np.repeat(np.array([min(n, 65535) for _, n, _ in lists], np.uint16), each)
            o = np.repeat(np.array([f for _, _, f in lists], np.int64), each)
            order = np.argsort(t)
            t, n, o = t[order], n[order], o[order]
            g = _group_of(t, groups)
            cuts, ends = _runs(g)
            payloads = [t[a:b].tobytes() + n[a:b].tobytes() + o[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
            return _batch(1, g=g[cuts], payload=payloads)

        for part, sets in sets_of_batches(batches):
            marks: list[tuple] = []
            short: list[np.ndarray | None] = []
            full: list[np.ndarray | None] = []
            heavy: list[tuple] = []
            subsets: list[tuple] = []
            for i, s in zip(part.column("doc_id").to_pylist(), sets, strict=True):
                n = len(s)
                f1, f2 = class_id(s)
                marks.append((i, n, f1, f2))
                if not n or i is None or (f1, f2) in seen:
                    short.append(None)
                    full.append(None)
                    continue
                seen.add((f1, f2))
                short.append(parity_sketch(s, SKETCH))
                full.append(parity_sketch(s, sketch_words(n)))
                for c in subset_sizes(n, boundary):
                    subsets += [(n, f1, f2, _subset_key(s, sub), c) for sub in combinations(range(n), c)]
                if not uses_lists(n, boundary):
                    continue
                low = (s & _LOW).astype(np.uint32)
                at = np.minimum(np.searchsorted(known, low), max(0, len(known) - 1))
                level = np.where(known[at] == low, levels[at], 0) if len(known) else np.zeros(n, np.uint8)
                p = prefix_size(n)
                first = np.lexsort((s, low, level))[:p]
                usual = first[level[first] == 0]
                lists.append((low[usual], n, f1))
                n_held += len(usual)
                heavy += [(n, f1, f2, int(low[first[k]]), k) for k in range(len(usual), p)]
            ids, n, f1, f2 = zip(*marks, strict=True)
            yield _batch(0, doc_id=list(ids), n=list(n), f1=list(f1), f2=list(f2), sketch=lists_of(short), full=lists_of(full))
            for kind, rows in ((2, heavy), (3, subsets)):
                if rows:
                    n, f1, f2, token, pos = zip(*rows, strict=True)
                    yield _batch(kind, n=list(n), f1=list(f1), f2=list(f2), token=list(token), pos=list(pos))
            if n_held >= HELD:
                yield packed()
                lists.clear()
                n_held = 0
        yield packed()

    return docs.mapInArrow(run, _ROWS)


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs a, b of class ids of fitting sizes that share a list, with the list k; entries (b null) of the lists
    of more than FREQUENT classes."""
    parts = []
    for p in rows["payload"]:
        n = len(p) // 14
        parts.append((np.frombuffer(p, np.uint32, n), np.frombuffer(p, np.uint16, n, 4 * n), np.frombuffer(p, np.int64, n, 6 * n)))
    t, n, o = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((o, t))
    t, n, o = t[order], n[order].astype(np.int64), o[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (o[1:] != o[:-1])]
    t, n, o = t[new], n[new], o[new]
    cuts, ends = _runs(t)
    each = np.repeat(ends - cuts, ends - cuts)
    long = each > FREQUENT
    held = each > 1
    found = [(o[long], np.zeros(int(long.sum()), np.int64), t[long], np.ones(int(long.sum()), bool))]
    t, n, o = t[held & ~long], n[held & ~long], o[held & ~long]
    for d in range(1, FREQUENT):
        same = np.flatnonzero(t[d:] == t[:-d])
        same = same[5 * np.minimum(n[same], n[same + d]) >= 4 * np.maximum(n[same], n[same + d])]
        found.append((o[same], o[same + d], t[same], np.zeros(len(same), bool)))
    a, b, k, alone = (np.concatenate(x) for x in zip(*found, strict=True))
    # of the lists that a pair shares in this group one is enough
    order = np.lexsort((k, b, a, alone))
    a, b, k, alone = a[order], b[order], k[order].astype(np.int64), alone[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] | alone if len(a) else alone
    return pd.DataFrame({"a": a[new], "b": pd.array(b[new], dtype="Int64").copy(), "k": k[new], "alone": alone[new]})


# ---- candidates and links


def _fits(n: Column, m: Column, ps: Column | None = None, pt: Column | None = None) -> Column:
    """Sizes (and places in the order of the first shared shingle) allow a link."""
    ok = (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (F.least(n, m) > 0)
    if ps is not None:
        ok = ok & (9 * (F.least(n - ps, m - pt)) >= 4 * (n + m))
    return ok


def _bits(s: Column, t: Column) -> Column:
    """Bits in which two short sketches differ."""
    return sum((F.bit_count(s[i].bitwiseXOR(t[i])) for i in range(1, SKETCH)), F.bit_count(s[0].bitwiseXOR(t[0])))


def _near(s: Column, t: Column, n: Column, m: Column) -> Column:
    """The full sketches differ in no more bits than linked sets may differ in shingles."""

    def halved(x: Column, other: Column) -> Column:
        half = F.size(x).bitwiseAND(-2) / 2
        both = F.zip_with(F.slice(x, 1, half.cast("int")), F.slice(x, half.cast("int") + 1, half.cast("int")), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), both).otherwise(x)

    unlike = F.zip_with(halved(s, t), halved(t, s), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return 9 * F.aggregate(unlike, F.lit(0), lambda a, x: a + x) <= n + m


def _links(s: np.ndarray, t: np.ndarray) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= 80 * (len(s) + len(t) - both)


def _near_pairs(pairs: DataFrame, classes: DataFrame, key: str = "c") -> DataFrame:
    """The pairs (a, b, k) of classes, named by ``key``, whose sizes and full sketches allow a link: a, b (as c), k
    and their sizes na and nb. Few pairs go to the classes, else both are dealt by the key."""
    pairs = stash(pairs)
    few = pairs.count() <= BROADCAST_IDS // 8
    hint = F.broadcast if few else (lambda df: df)
    info = classes.select(F.col(key).alias("key"), "c", "n", "full")
    side = lambda p: info.select(*[F.col(x).alias(f"{x}_{p}") for x in info.columns])
    half = side("a").join(hint(pairs), F.col("a") == F.col("key_a"))
    met = side("b").join(hint(half), F.col("b") == F.col("key_b"))
    met = met.where(_fits(F.col("n_a"), F.col("n_b")) & _near(F.col("full_a"), F.col("full_b"), F.col("n_a"), F.col("n_b")))
    return met.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"), "k", F.col("n_a").alias("na"), F.col("n_b").alias("nb"))


def _checked(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, as u, v, decided on the whole sets.

    Pairs go to groups by ``k``, as many as their sizes (na, nb) ask for, and every set goes once to each group
    that asks for it; pairs of one short list or one member of a long one share a group.
    """
    asked = pairs.agg(F.sum(F.col("na").cast("long") + F.col("nb")).alias("n"), F.count("*").alias("c")).first()
    if not asked["c"]:
        return docs.sparkSession.createDataFrame([], "u long, v long")
    groups = math.ceil(asked["n"] / CHECKED) + 12
    placed = pairs.select("a", "b", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int").alias("group"))
    ends = placed.select("group", F.col("a").alias("c")).union(placed.select("group", "b")).distinct()
    needed = stash(ends.join(classes.select("c", "doc_id", "f1", "f2"), "c"))
    few = needed.count() <= BROADCAST_IDS
    columns = ["text", "group", "c", "f1", "f2"]
    owners = docs.join(F.broadcast(needed) if few else needed, "doc_id").select(columns)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in sets_of_batches(batches):
            f1, f2 = part.column("f1").to_pylist(), part.column("f2").to_pylist()
            # rows of one id may have unlike texts
            own = pa.array([class_id(s) == f for s, f in zip(sets, zip(f1, f2, strict=True), strict=True)], pa.bool_())
            held = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("group").filter(own), part.column("c").filter(own), held.filter(own)], names=["group", "c", "s"])

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = {c: np.frombuffer(x, np.uint64) for c, x in zip(left["c"], left["s"], strict=True)}
        found = [(a, b) for a, b in zip(right["a"], right["b"], strict=True) if _links(held[a], held[b])]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    sets = owners.mapInArrow(sets_of, "group int, c long, s binary")
    return stash(sets.groupBy("group").cogroup(placed.groupBy("group")).applyInPandas(check, "u long, v long"))


def _of_lists(found: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among the pairs of class ids that share a short list, and among classes of one first sum."""
    pairs = found.where("NOT alone").groupBy("a", "b").agg(F.min("k").alias("k"))
    near = _near_pairs(pairs, classes, "f1")
    twins = classes.groupBy("f1").agg(F.collect_list("c").alias("l")).where(F.size("l") > 1)
    twins = twins.select("f1", F.explode("l").alias("x"), "l").select(F.col("x").alias("a"), F.explode("l").alias("b"), F.col("f1").alias("k")).where("a < b")
    twins = stash(twins)
    if not twins.isEmpty():
        near = near.union(_near_pairs(twins, classes))
    return _checked(stash(near), classes, docs)


def _of_subsets(subsets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links through subsets of one size: the smallest set of each is within the overlap of all that link through it."""
    rows = subsets.join(classes.select("f1", "f2", "c"), ["f1", "f2"]).select("token", "pos", "n", "c")
    least = rows.groupBy("token", "pos").agg(F.min(F.struct("n", "c")).alias("m"))
    met = rows.join(least, ["token", "pos"]).where(F.ceil(4 * (F.col("n") + F.col("m")["n"]) / 9) <= F.col("pos"))
    return stash(met.select(F.col("m")["c"].alias("u"), F.col("c").alias("v")).where("u != v").distinct())


def _of_frequent(heavy: DataFrame, links: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """All links with those through frequent shingles (token, c, n, pos, sketch).

    In each round every list has leaders of its own, and each class meets the nearest of its lists' leaders, by the
    short sketch, that are of another component than its own, as long as that links any; then all members of like
    size that are still apart meet, past the filters.
    """
    columns = ("c", "n", "pos", "sketch", "root")
    side = lambda x, p: x.select("token", *[F.col(c).alias(f"{p}_{c}") for c in columns], *(["band"] if "band" in x.columns else []))
    fit = _fits(F.col("x_n"), F.col("y_n"), F.col("x_pos"), F.col("y_pos"))
    bits = _bits(F.col("x_sketch"), F.col("y_sketch"))
    fit = (F.col("x_root") != F.col("y_root")) & fit & (9 * bits <= F.col("x_n") + F.col("y_n"))
    of_token = heavy.groupBy("token").agg(F.count("*").alias("n"))
    cost = of_token.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n") / 2).alias("pairs")).first()
    h, r = None, 0 if cost["pairs"] > LEADER_PAIRS * cost["n"] else ROUNDS
    while r <= ROUNDS:
        release(docs.sparkSession)
        if h is None:
            parts = connected_components(links, stash)
            h = stash(heavy.join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")))
        if r < ROUNDS:
            # by hashes of list and class, or lists of the same members would have the same leaders
            own = F.struct(*columns).alias("x")
            least = [F.min(F.struct(F.xxhash64("c", "token", F.lit(r), F.lit(i)).alias("o"), own))["x"] for i in range(LEADERS)]
            lead = h.groupBy("token").agg(F.array_distinct(F.array(*least)).alias("l")).select("token", F.explode("l").alias("m"))
            met = side(h, "x").join(side(lead.select("token", "m.*"), "y"), "token").where(fit)
            met = met.groupBy("x_c").agg(F.min(F.struct(bits.alias("d"), F.col("y_c"))).alias("m")).select("x_c", "m.y_c")
        else:
            # sizes of linked sets are in one band or in neighbours; the smaller set looks into both
            band = F.floor(F.log("n") / math.log(1.25) + 1e-9).cast("int")
            small = side(h.withColumn("band", F.explode(F.array(band, band + 1))), "x")
            met = small.join(side(h.withColumn("band", band), "y"), ["token", "band"]).where(fit)
            met = met.where(F.struct("x_n", "x_c") < F.struct("y_n", "y_c")).select("x_c", "y_c").distinct()
        pairs = _near_pairs(met.select(F.col("x_c").alias("a"), F.col("y_c").alias("b"), F.col("x_c").alias("k")), classes)
        new = _checked(stash(pairs), classes, docs)
        if new.isEmpty():
            r = max(r + 1, ROUNDS)
        else:
            links, h, r = links.union(new), None, r + 1
    return links


def _groups_for(docs: DataFrame) -> int:
    """Groups of the counting and scanning steps by the length of all texts."""
    chars = docs.agg(F.sum(F.octet_length("text")).alias("c")).first()["c"] or 0
    return max(MIN_GROUPS, chars // 6 // GROUP)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and link with nothing. A document without an id takes
    no part and has a null component. Repeated rows are equal sets and share a component; an empty table
    gives an empty result; other columns are left out. Texts are read whole.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    groups = _groups_for(docs)
    counted = stash(_frequencies(docs, groups))
    sizes = {r["a"]: r["b"] for r in counted.where("kind = 1").collect()}  # sizes up to 24
    scan = counted.where("kind = 2").agg(F.sum("a").alias("n"), F.sum("b").alias("n2")).first()
    boundary = best_boundary(sizes, (scan["n2"] or 0) / max(1, scan["n"] or 0))
    frequent = _known(counted)
    drop(counted)
    release(docs.sparkSession)

    rows = stash(_entries(docs, groups, frequent, boundary))
    marks = rows.where("kind = 0").select("doc_id", "n", "f1", "f2", "sketch", "full")
    linkable = marks.where("n > 0 AND doc_id IS NOT NULL")
    one = lambda c: F.first(c, ignorenulls=True).alias(c)  # noqa: E731  equal sets have equal sketches
    grouped = linkable.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc_id"), one("sketch"), one("full"))
    classes = stash(grouped.withColumn("c", F.monotonically_increasing_id()))
    scanned = rows.where("kind = 1").select("g", "payload").groupBy("g").applyInPandas(_scan, "a long, b long, k long, alone boolean")
    found = stash(scanned)
    release(docs.sparkSession)
    links = _of_lists(found, classes, docs)
    subsets = rows.where("kind = 3").select("token", "pos", "n", "f1", "f2").distinct()
    links = links.union(_of_subsets(subsets, classes))

    entries = rows.where("kind = 2").select("token", "f1", "f2", "pos").dropDuplicates(["token", "f1", "f2"])
    heavy = entries.join(classes, ["f1", "f2"]).select("token", "c", "n", "pos", "sketch")
    if not found.where("alone").isEmpty():
        long = found.where("alone").select(F.col("k").alias("token"), F.col("a").alias("f1"))
        heavy = heavy.union(long.join(classes, "f1").select("token", "c", "n", F.lit(0).alias("pos"), "sketch"))
    release(docs.sparkSession)
    heavy = stash(heavy)
    drop(found)
    if not heavy.isEmpty():
        links = _of_frequent(heavy, links, classes, docs)

    release(docs.sparkSession)
    parts = stash(connected_components(links, stash))
    release(docs.sparkSession)
    rooted = classes.join(parts.withColumnRenamed("node", "c"), "c", "left").select("f1", "f2", "n", "doc_id", F.coalesce("root", "c").alias("root"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = rooted.join(first, "root").select("f1", "f2", "n", "component_id")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    named = marks.where(~alone).join(of_class, ["f1", "f2", "n"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return named.union(marks.where(alone).select("doc_id", F.col("n").cast("long"), "doc_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of least id.

    Documents without an id or without words stay; of equal rows (id and text) one stays. Rows that share an id but
    not their text are documents of their own. Columns stay as they are.
    """
    ids = docs.where("doc_id IS NOT NULL")
    if not ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        # rows get numbers in the order of their ids
        rows = stash(ids.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()))
        one = _one_of_each(rows.withColumnRenamed("doc_id", "_id").withColumnRenamed("_row", "doc_id"))
        return one.drop("doc_id").withColumnRenamed("_id", "doc_id").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
    return _one_of_each(docs)


def _one_of_each(docs: DataFrame) -> DataFrame:
    """:func:`one_of_each` of rows with unlike ids."""
    parts = stash(jaccard_components(docs))
    away = stash(parts.where("doc_id != component_id").select("doc_id").distinct())
    return docs.join(F.broadcast(away) if away.count() <= BROADCAST_IDS else away, "doc_id", "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: one row per document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM d),
g AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, max(x.n) AS n, max(y.n) AS m, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n + m - c)),
r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY id) ON id = doc_id"""
