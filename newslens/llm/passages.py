"""Removal of passages that an earlier document holds, by automata over recurring phrases.

A window is 50 consecutive words. Every window has an anchor, the shingle of least hash among its shingles of eight
words, so that equal windows have equal anchors, and neighbouring windows mostly share one: a document is cut into
runs of windows of one anchor. Only runs whose anchor stands in two documents can recur; their words (stretches) meet
by anchor. There the recurring passages are confirmed word by word: maximal chains of windows that occur in several
documents and always follow each other. The passages of some thousand stretches make one shard, compiled into one
Aho-Corasick automaton over word numbers; every stretch of every document is streamed through its shard's automaton,
which locates each occurrence of each passage, and what an earlier document holds is removed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, stash, table
from .shingles import BLOCK_BYTES, mix

#: Words of a window, and of the shingle that anchors it.
WINDOW, ANCHOR = 50, 8
#: Runs of an anchor, at most; the windows of more frequent ones meet by themselves and only where they recur.
HOT = 5_000
#: Words of the passages of one automaton, about, and bytes of distinct stretches that a task gathers before it sends them.
SHARD_WORDS, HELD_BYTES = 200_000, 32 << 20

ADDED = ("n_words", "n_removed", "kept_sha256")
RUNS = "array<struct<key:bigint,lo:int,hi:int>>"

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: A number for every byte.
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[1])
_BASE = 0x5851F42D4C957F2D
#: Bytes whose words are hashed together.
_HASHED = 1 << 16


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word as it stands, by sums of powers over _HASHED bytes (or one longer word) at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + _HASHED, "right")))
        n = int(ends[j - 1]) - first
        up, down = _powers(max(n, _HASHED))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[raw[first : first + n]] * up[:n], out=sums[1:], dtype=np.uint64)
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _ODD[0]
        i = j
    return mix(out)


def _shingles(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - ANCHOR + 1)
    out = np.full(n, ANCHOR, np.uint64)
    for j in range(ANCHOR):
        out = (out ^ (out >> np.uint64(29))) * _ODD[0] + words[j : j + n]
    return mix(out)


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every ``width`` values in a row, the first of equals, by doubling."""
    at, least, w = np.arange(len(values)), values, 1
    while w < width:
        step = min(w, width - w)
        keep = least[:-step] <= least[step:]
        at, least, w = np.where(keep, at[:-step], at[step:]), np.where(keep, least[:-step], least[step:]), w + step
    return at


def window_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, key (its anchor's hash), lo and hi (first and last window, by first word) of every run of every text."""
    none = np.zeros(0, np.int64)
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
    if at[-1] == at[0]:
        return none, none, none, none
    raw = np.frombuffer(col.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0]))
    at = at - at[0]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    word = ~_SPACE[raw]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    if len(first) < WINDOW:
        return none, none, none, none
    hashes = _shingles(_word_hashes(raw, first, np.flatnonzero(ends) + 1))
    cut = np.searchsorted(first, at)
    row = np.repeat(np.arange(len(col)), np.diff(cut))[: len(first) - WINDOW + 1]
    anchors = _first_least(hashes, WINDOW - ANCHOR + 1)
    whole = np.flatnonzero(np.arange(len(row)) + WINDOW <= cut[row + 1])  # windows inside one text
    row, anchors = row[whole], anchors[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(whole))[: len(begin)] - 1
    of = row[begin]
    return of, hashes[anchors[begin]].view(np.int64), whole[begin] - cut[of], whole[last] - cut[of]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of BLOCK_BYTES of texts (their column ``text``), or of one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and key, with all of its runs: a repetitive text has many of one key."""
    for batch in _blocks(batches):
        row, key, lo, hi = window_runs(batch.column("text"))
        order = np.lexsort((lo, key, row))
        row, key, lo, hi = row[order], key[order], lo[order], hi[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        at = pa.array(np.append(begin, len(row)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (lo, hi)]
        ids = [batch.column(c).take(pa.array(row[begin])) for c in ("id", "th")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(key[begin]), *lists], names=["id", "th", "key", "los", "his"])


def _digest(stretch: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(stretch, digest_size=size).digest()


def _key(window: bytes) -> int:
    return int.from_bytes(_digest(window, 8), "little", signed=True)


def _marker(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Splits a document's recurring runs into the ordinary and the hot ones, with the distinct windows of these; a
    document without any is done, and its text is its words, or is left out."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("found", "text")]
            texts, n, sha, runs, hot, windows = [], [], [], [], [], []
            for x, found in zip(batch.column("text").cast(pa.large_binary()), batch.column("found").to_pylist(), strict=True):
                text = x.as_py()
                words = text.split()
                n.append(len(words))
                left = b" ".join(words)
                sha.append(None if found else hashlib.sha256(left).hexdigest())
                texts.append(text if found else left if with_text else None)
                parts: tuple[list, list] = [], []
                for r in found or ():
                    parts[r["hot"]].extend({"key": r["key"], "lo": lo, "hi": hi} for lo, hi in zip(r["los"], r["his"], strict=True))
                runs.append(parts[0])
                hot.append(parts[1])
                windows.append(list({_key(b" ".join(words[i : i + WINDOW])) for r in parts[1] for i in range(r["lo"], r["hi"] + 1)}))
            added = [pa.array(texts, pa.binary()).view(pa.string()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(runs, kind), pa.array(hot, kind), pa.array(windows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *added], names=[*names, "text", "n_words", "kept_sha256", "runs", "hot", "windows"])

    return marked


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[tuple[int, bytes], list[int]]]]:
    """id, th and the distinct stretches of every document: (key, words) → the words where they begin. Of hot runs only
    the windows that recur are stretches, each keyed by itself."""
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("id", "th", "runs", "hot", "good"))
        for text, id_, th, runs, hot, good in zip(batch.column("text").cast(pa.large_binary()), *columns, strict=True):
            words = text.as_py().split()
            found: dict[tuple[int, bytes], list[int]] = defaultdict(list)
            for r in runs:
                found[r["key"], b" ".join(words[r["lo"] : r["hi"] + WINDOW])].append(r["lo"])
            recur = set(good or ())
            for i in (i for r in hot if recur for i in range(r["lo"], r["hi"] + 1)):
                window = b" ".join(words[i : i + WINDOW])
                if (key := _key(window)) in recur:
                    found[key, window].append(i)
            yield id_, th, found


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, stretch, first and last id that has it, of the distinct stretches that the task holds at a time."""
    held: dict[tuple[int, bytes], list[int]] = {}
    size = 0

    def sent() -> pa.RecordBatch:
        keys, ids = list(held), list(held.values())
        stretch = pa.array([k[1] for k in keys], pa.binary())
        out = [pa.array([k[0] for k in keys], pa.int64()), stretch, pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(out, names=["key", "stretch", "first", "last"])

    for id_, _, found in _stretches(batches):
        for one in found:
            known = held.get(one)
            if known is None:
                held[one] = [id_, id_]
                size += len(one[1]) + 200
            else:
                known[0], known[1] = min(known[0], id_), max(known[1], id_)
        if size >= HELD_BYTES:
            yield sent()
            size = 0
    yield sent()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, th, digest and los (where it begins) of every distinct stretch of a document."""
    rows: list[tuple] = []

    def sent() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())), strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(out, names=["id", "th", "digest", "los"])

    for id_, th, found in _stretches(batches):
        rows += [(id_, th, _digest(stretch), los) for (_, stretch), los in found.items()]
        if len(rows) >= 10_000:
            yield sent()
    yield sent()


def confirmed(stretches: dict[bytes, tuple[int, int]]) -> list[tuple[list[bytes], int]]:
    """Words and first document of the recurring passages of the stretches of one key.

    A passage is a maximal chain of windows that documents of different ids hold and of which each is always followed
    by the next: where one of its windows occurs, all of it does.
    """
    if len(stretches) == 1:
        (only, (first, last)), = stretches.items()
        return [(only.split(b" "), first)] if first != last else []
    number: dict[bytes, int] = {}
    times, least, most = [], [], []
    links: dict[tuple[int, int], int] = defaultdict(int)
    all_words, chains = [], []
    for stretch, (first, last) in stretches.items():
        words = stretch.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        chain, at = [], 0
        for i in range(len(words) - WINDOW + 1):
            k = number.setdefault(stretch[at : ends[i + WINDOW - 1] - 1], len(times))
            at = ends[i]
            if k == len(times):
                times.append(0)
                least.append(first)
                most.append(last)
            times[k] += 1
            least[k], most[k] = min(least[k], first), max(most[k], last)
            if chain:
                links[chain[-1], k] += 1
            chain.append(k)
        all_words.append(words)
        chains.append(chain)
    out, told = [], set()
    for words, chain in zip(all_words, chains, strict=True):
        begin = 0
        for i, k in enumerate(chain):
            follows = i + 1 < len(chain) and times[k] == times[chain[i + 1]] == links[k, chain[i + 1]]
            if not follows:
                start = chain[begin]
                if least[start] != most[start] and start not in told:
                    told.add(start)
                    out.append((words[begin : i + WINDOW], least[start]))
                begin = i + 1
    return out


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: compiles a shard's passages and streams its stretches; digest, begin, end and first document of each occurrence."""
    shard: list[dict[bytes, tuple[int, int]]] = []
    size, current = 0, None

    def sent() -> pa.RecordBatch:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        numbers: dict[bytes, int] = {}
        for stretches in shard:
            for words, first in confirmed(stretches):
                key = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words])
                known = automaton.get(key, None)
                automaton.add_word(key, (len(key), first if known is None else min(first, known[1])))
        rows: list[tuple] = []
        if numbers:
            automaton.make_automaton()
            get = numbers.get
            for stretches in shard:
                for stretch, (_, last) in stretches.items():
                    found = [(end + 1 - n, end + 1, first) for end, (n, first) in automaton.iter(tuple([get(w, 0) for w in stretch.split(b" ")])) if first < last]
                    if found:
                        d = _digest(stretch)
                        rows += [(d, *f) for f in found]
        shard.clear()
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        out = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(out, names=["digest", "begin", "end", "first"])

    for batch in batches:
        for key, stretch, first, last in zip(*(batch.column(c).to_pylist() for c in ("key", "stretch", "first", "last")), strict=True):
            if key != current:
                if size >= SHARD_WORDS:
                    yield sent()
                    size = 0
                shard.append({})
                current = key
            known = shard[-1].get(stretch)
            if known is None:
                size += stretch.count(b" ") + 1
            else:
                first, last = min(first, known[0]), max(last, known[1])
            shard[-1][stretch] = (first, last)
    if shard:
        yield sent()


def _recurring(runs: DataFrame, n: Column) -> DataFrame:
    """The keys that documents of different ids hold, with the sum of n."""
    keys = runs.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.sum(n).alias("n"))
    return keys.where("a <> z").select("key", "n")


def without_passages(docs: DataFrame, text: bool = True) -> DataFrame:
    """Every document without the words of windows that a document of a smaller doc_id holds too.

    Adds n_words, n_removed and kept_sha256, the digest of the kept words joined by one blank; ``text`` becomes these
    words, or is left out with ``text=False``. Windows are judged on the input. Null and empty texts have no words and
    texts under 50 words no windows; windows that only rows of one doc_id hold stay; equal rows lose the same words;
    rows without doc_id keep all words and count as no earlier document; an empty table gives an empty result;
    further columns pass through (those of an added one's name are replaced).
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(*ADDED)
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [c for c in kept.columns if c != "text"]
    keyed = kept.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole).alias("th"), whole.alias("text"))
    ids = "id bigint, th bigint"

    runs = stash(keyed.where("id IS NOT NULL").select("id", "th", "text").mapInArrow(_runs, f"{ids}, key bigint, los array<int>, his array<int>"))
    recurring = _recurring(runs, F.size("los")).select("key", (F.col("n") > HOT).alias("hot"))
    found = runs.join(recurring, "key").groupBy("id", "th").agg(F.collect_set(F.struct("key", "los", "his", "hot")).alias("found"))
    joined = keyed.join(found, ["id", "th"], "left").select("row", "id", "th", "text", "found")
    spec = f"row {joined.schema['row'].dataType.simpleString()}, {ids}, text string, n_words bigint, kept_sha256 string, runs {RUNS}, hot {RUNS}, windows array<bigint>"
    marked = stash(joined.mapInArrow(_marker(text), spec))
    done, rest = marked.where("kept_sha256 IS NOT NULL"), marked.where("kept_sha256 IS NULL")

    windows = rest.where("size(windows) > 0")
    if windows.isEmpty():
        rest = rest.drop("windows").withColumn("good", F.lit(None).cast("array<bigint>"))
    else:  # what recurs of frequent anchors is told by hashes of windows first, so that no task meets them all
        each = windows.select("id", "th", F.explode("windows").alias("key"))
        good = each.join(_recurring(each, F.lit(1)).select("key"), "key").groupBy("id", "th").agg(F.collect_set("key").alias("good"))
        rest = stash(rest.drop("windows").join(good, ["id", "th"], "left"))

    cut = rest.select("id", "th", "text", "runs", "hot", "good")
    distinct = cut.mapInArrow(_distinct, "key bigint, stretch binary, first bigint, last bigint")
    located = distinct.repartition("key").sortWithinPartitions("key").mapInArrow(_located, "digest binary, begin int, `end` int, first bigint")
    met = cut.mapInArrow(_places, f"{ids}, digest binary, los array<int>").join(located, "digest").where("first < id")
    spans = met.groupBy("id", "th").agg(F.flatten(F.collect_list(F.expr("transform(los, lo -> struct(lo + begin AS begin, lo + `end` AS end))"))).alias("spans"))
    ended = rest.select("row", "id", "th", "text", "n_words").join(spans, ["id", "th"], "left").select("row", "text", "n_words", "spans")
    last = ended.mapInArrow(_kept, f"row {joined.schema['row'].dataType.simpleString()}, text string, n_words bigint, n_removed bigint, kept_sha256 string")
    out = done.select("row", "text", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256").unionByName(last)
    return out.select(*[F.col(f"row.`{c}`") for c in names], *["text"] * text, *ADDED)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, sha, texts = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("spans").to_pylist(), strict=True):
            words = text.as_py().split()
            edges = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                edges[s["begin"]] += 1
                edges[s["end"]] -= 1
            stay = np.cumsum(edges[:-1]) == 0
            left = b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])
            removed.append(len(words) - int(stay.sum()))
            sha.append(hashlib.sha256(left).hexdigest())
            texts.append(left)
        added = [pa.array(texts, pa.binary()).view(pa.string()), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *added], names=["row", "text", "n_words", "n_removed", "kept_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: one row per document."""
    return without_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False)


ORACLE = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM x JOIN f USING (h) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
