"""The source divergence audit against plain loops."""

import random
import re
from collections import Counter

from newslens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    langs = {}
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]
        langs.setdefault(lang or "", []).append((source or "", terms))
    out = []
    for lang, docs in langs.items():
        df = Counter(t for _, terms in docs for t in set(terms))
        kept = {t for t, n in df.items() if n >= 3}
        counts = {s: Counter() for s, _ in docs}
        for s, terms in docs:
            counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))

        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in counts.items():
            pair = [(-sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in counts.items() if x != s]
            term = [(-f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:200])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def got(spark, rows):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    return sorted(tuple(x) for x in divergence.divergence(d).select("lang", "source", "part", "item", "value", "rank").collect())


def test_equal_to_brute_force(spark):
    r = random.Random(3)
    vocab = [r.choice(["Ab", "cé", "日本", "zz", "Q"]) + "".join(r.choice("abcXYé") for _ in range(r.randint(0, 3))) for _ in range(400)]
    rows = [(" ".join(r.choice(vocab) + r.choice(["", ".", "1", "_x"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", None, "é", "Z"])) for _ in range(150)]
    rows += [(None, "en", "s1"), ("", "en", "only empty"), ("alone here", "xx", "a"), ("other words", "xx", "b"), ("one", "yy", "a"), *[("same same Words", "en", "hot")] * 40, ("w" * 50_000 + " ab" * 30_000, "de", "s1")]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
