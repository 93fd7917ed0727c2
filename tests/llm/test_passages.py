"""Passages of earlier documents against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from newslens.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(n_words, n_removed, kept digest) of every (doc_id, text), in order."""
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in cut:
        for k in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = lambda n: [r.choice("abcdefgh") + r.choice("xyzé") + str(r.randint(0, 30)) for _ in range(n)]
    shared = [words(n) for n in (49, 50, 51, 60, 90, 200)]
    texts = [None, "", " \n\t ", "one", " ".join(words(49)), "x y z " * 70, "x y z " * 40, "long" + "q" * 70_000 + " tail " * 60]
    for k in range(60):
        parts = [words(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(shared))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "changed"
            if r.random() < 0.3:
                p = p[r.randrange(len(p) // 2) :]
            parts += [p, words(r.randint(0, 30))]
        texts.append(r.choice([" ", "\n", " \t"]).join(w for p in parts for w in p))
    texts += texts[20:30] + [texts[12]] * 15  # copies
    out = list(enumerate(texts))
    out += [(None, texts[12]), (None, texts[40]), (3, texts[41]), (70, texts[70]), (70, texts[70]), (70, texts[44]), (-5, texts[45])]
    r.shuffle(out)
    return out


def got(spark, rows, **kw):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = passages.without_passages(d, **kw).collect()
    return sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out), key=str), out


@pytest.mark.parametrize("hot", [passages.HOT, 3])
def test_equal_to_brute_force(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(passages, "HOT", hot)
    found, out = got(spark, rows)
    assert found == brute(rows) and sum(x[2] for x in found) > 1000
    assert all(hashlib.sha256(x["text"].encode()).hexdigest() == x["kept_sha256"] for x in out)


def test_columns_and_empty(spark, rows):
    d = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows[:40]], "doc_id long, text string, found string, `row` string, n_words int")
    out = passages.without_passages(d, text=False)
    assert out.columns == ["doc_id", "found", "row", "n_words", "n_removed", "kept_sha256"]
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out.collect()), key=str) == brute(rows[:40])
    assert passages.without_passages(d.limit(0)).count() == 0


def test_small_shards_give_the_same(rows, monkeypatch):
    """The places that the automata find don't depend on how keys are cut into shards."""
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows if i is not None]), pa.array([0] * sum(i is not None for i, _ in rows)), pa.array([t or "" for i, t in rows if i is not None])], names=["id", "th", "text"])
    row, key, lo, hi = passages.window_runs(batch.column("text"))
    runs = [[] for _ in range(batch.num_rows)]
    for r, k, a, b in zip(row.tolist(), key.tolist(), lo.tolist(), hi.tolist(), strict=True):
        runs[r].append({"key": k, "lo": a, "hi": b})
    none = [[] for _ in runs]
    sent = pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(none), pa.array(none)], names=["id", "th", "text", "runs", "hot", "good"])
    distinct = pa.Table.from_batches(passages._distinct(iter([sent]))).sort_by("key").combine_chunks().to_batches()
    whole = {tuple(x.values()) for b in passages._located(iter(distinct)) for x in b.to_pylist()}
    monkeypatch.setattr(passages, "SHARD_WORDS", 100)
    parts = {tuple(x.values()) for b in passages._located(iter(distinct)) for x in b.to_pylist()}
    spans = lambda x: {(d, k, f) for d, a, b, f in x for k in range(a, b - 49)}
    assert whole and spans(parts) <= spans(whole)  # a passage of another key may be met as well where both share a shard


def test_runs_cut_all_windows():
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 150))) for _ in range(30)]
    row, _, lo, hi = passages.window_runs(pa.array(texts))
    windows = sorted((x, k) for x, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True) for k in range(a, b + 1))
    assert windows == [(i, k) for i, t in enumerate(texts) for k in range(len(t.split()) - 49)]
