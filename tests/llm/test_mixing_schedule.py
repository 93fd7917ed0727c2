"""The mix against a plain version of it, and what the sequence of points decides."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newslens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = []
    for i in range(160):
        n = r.choice([0, 1, 3, 20, 60, 400 if i % 40 == 0 else 30])
        out.append((i if i % 50 else None, r.choice(["a", "a", "a", "b", "ü", None]) if n < 400 else "c", " ".join(f"w{r.randint(0, 99)}" for _ in range(n)) if n or i % 2 else None))
    return [*out, (7, "b", "tiny"), (300, "lone", "x y"), (301, "empty", " ")]


def plain(rows):
    """(doc_id, source, size, target, taken, first slot) and the slots' blocks, from the definition."""
    docs = [(i, s, len(WORD.findall(t or "")), hashlib.md5(f"{'' if i is None else i}\x1f{t or ''}".encode()).hexdigest()) for i, s, t in rows]
    names = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(d[2] for d in docs if d[1] == s) for s in names]
    goals, words_each = mixing.targets(sizes), max(1, sum(sizes) // mixing.BLOCKS)
    blocks = [max(min(n, mixing.MIN_BLOCKS), math.ceil(n / words_each)) for n in sizes]
    slots = [min(3 * b, math.floor(g / n * b + 0.5)) if n else 0 for n, g, b in zip(sizes, goals, blocks, strict=True)]
    owner = [k for k, n in enumerate(slots) for _ in range(n)]
    bits = max(1, (len(owner) - 1).bit_length())
    taken_at, rank = defaultdict(list), Counter()
    for slot in range(1 << bits):
        point = int(f"{slot:0{bits}b}"[::-1], 2)
        if point < len(owner):
            k = owner[point]
            taken_at[k, rank[k] % blocks[k]].append(slot)
            rank[k] += 1
    out = []
    for k, s in enumerate(names):
        stream = [(d, w) for d in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[0] or -1, d[2])) for w in range(d[2])]
        words = defaultdict(list)
        for at, (d, _) in enumerate(stream):
            words[d].append(taken_at[k, ((at + 1) * blocks[k] - 1) // sizes[k]])
        for d in (d for d in docs if d[1] == s):
            hit = [x for x in words[d] if x]
            out.append((d[0], s, d[2], sizes[k], goals[k], sum(map(len, hit)), min((x[0] for x in hit), default=-1)))
    return out


def test_mix_is_the_plain_one(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_h", F.lit("clash"))
    got = [tuple(r) for r in mixing.mix(d).collect()]
    key = lambda t: tuple(str(x) for x in t)
    for g, w in zip(sorted(got, key=key), sorted(plain(rows), key=key), strict=True):
        assert g[:4] == w[:4] and g[5:] == w[5:] and math.isclose(g[4], w[4], rel_tol=1e-12)


def test_targets_by_rounds_over_the_table(spark):
    sizes = [1, 2, 5, 9, 1000, 3, 40, 0, 700, 2]
    d = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r["target"] for r in mixing.plan_sources(d).orderBy("src").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(got, mixing.targets(sizes), strict=True)) and math.isclose(sum(got), sum(sizes))


def test_another_sequence_moves_slots_not_totals(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")

    def got(slot_of):
        out = mixing.mix(d, slot_of).collect()
        return {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in out}, [r["first_slot"] for r in sorted(out, key=str)]

    taken, first = got(mixing.van_der_corput)
    one_after_the_other = got(lambda point, bits: point)
    assert one_after_the_other[0] == taken and one_after_the_other[1] != first


def test_sources_are_spread_evenly(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.plan_sources(mixing.sized(d))
    slots = sorted((r["slot"], r["src"]) for r in mixing.schedule(plan).collect())
    share = {r["src"]: r["slots"] / len(slots) for r in plan.collect()}
    for n in (len(slots) // 8, len(slots) // 3, len(slots) // 2):  # each beginning of the schedule has the mix's shares
        seen = Counter(s for _, s in slots[:n])
        assert all(abs(seen[s] - share[s] * n) <= 2 + math.log2(len(slots)) for s in share)


def test_mixture_keeps_whole_documents_in_slot_order(spark, rows):
    d = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, source string, text string").withColumn("_slot", F.lit(1)).withColumn("n", F.lit(2))
    got = mixing.mixture(d).collect()
    texts = {(i, s): t for i, s, t in rows}
    assert got and all(r["text"] == texts[r["doc_id"], r["source"]] or r["doc_id"] == 7 for r in got) and got[0].__fields__ == d.columns
    words, want = Counter(), {}
    for r in got:
        words[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixing.mix(d).collect():
        want.setdefault(r["source"], [r["target"], 0])
        want[r["source"]][1] = max(want[r["source"]][1], r["size"])
    assert all(abs(words[s] - t) <= longest + 0.02 * t + 2 for s, (t, longest) in want.items())
    assert mixing.mixture(d.where("false")).count() == 0
