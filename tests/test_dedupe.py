import random

from newslens.operators.dedupe import dedupe
from newslens.sources.shared import stash

SPEC = "pos long, publisher_id long, rss_guid string, normalized_url string, dedupe_key string"


def model(rows, store=()):
    """The sequential rule, one row after the other."""
    kept = list(store)
    out = {}
    for r in sorted(rows):
        _, p, g, u, k = r
        if g and g.strip() and any(x[1] == p and x[2] == g for x in kept):
            out[r[0]] = "RSS_GUID"
        elif u is not None and any(x[3] == u for x in kept):
            out[r[0]] = "NORMALIZED_URL"
        elif k is not None and any(x[4] == k for x in kept):
            out[r[0]] = "DEDUPE_KEY"
        else:
            out[r[0]] = None
            kept.append(r)
    return out


def run(spark, rows, store=None):
    s = spark.createDataFrame(store, SPEC) if store is not None else None
    return {r["pos"]: r["reason"] for r in dedupe(spark.createDataFrame(rows, SPEC), s, stash).collect()}


GOLDEN = [(1, 1, "g1", "u1", "k1"), (2, 1, "g1", "u2", "k2"), (3, 1, "g3", "u2", "k3"), (4, 1, " ", "u2", "k1"), (5, 1, "g9", "u9", "k1"), (6, 2, "g1", "u6", "k6")]


def test_golden(spark):
    want = {1: None, 2: "RSS_GUID", 3: None, 4: "NORMALIZED_URL", 5: "DEDUPE_KEY", 6: None}
    assert run(spark, GOLDEN) == want == model(GOLDEN)


def test_against_the_sequential_model(spark):
    r = random.Random(4)
    make = lambda start: [(start + i, r.randint(1, 2), r.choice(["", None, *"abcdef"]), f"u{r.randint(0, 40)}", f"k{r.randint(0, 40)}") for i in range(80)]
    store, rows = make(1000), make(0)
    store = [x for x in store if model(store)[x[0]] is None]
    assert run(spark, rows, store) == model(rows, store)
    again = [x for x in rows if model(rows, store)[x[0]] is None]
    assert all(run(spark, rows, store + again).values())


def test_empty(spark):
    assert run(spark, []) == {}


def test_chains_and_hot_keys(spark):
    chain = [(i, 1, f"g{i}", f"u{i // 2}", f"k{(i + 1) // 2}") for i in range(60)]  # each row shares a key with the next
    hot = [(100 + i, 1, f"h{i}", "same", f"h{i}") for i in range(50)] + [(200, 2, None, None, None), (201, 2, None, None, None)]
    assert run(spark, chain + hot) == model(chain + hot)
