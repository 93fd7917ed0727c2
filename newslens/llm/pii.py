"""Personal data: high-recall generators propose spans, boosted trees select those to redact.

The base kinds (email, ip, card, phone) are found by exact patterns and checks and always stay. Wider
generators propose overlapping candidates of further kinds (secrets, national numbers, account
numbers, phones without a country code, spelled-out emails); boosted trees score them by format and
context, and a threshold calibrated on held-out examples selects the spans. Only DataFrame functions
run on the executors.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import let, table

#: Kinds in the order of the digests; the first four are the base ones.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "account", "national", "localphone", "spelled")

#: Matches of these patterns are the base matches that can pass their checks, at the same places. Each
#: starts where a base match starts (at the end of the last match or where its first run of characters
#: begins) and gives nothing back, so that a text is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
    "value": r"(?<==)[A-Za-z0-9_/+-]{20,}+={0,2}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}+(?:[\x20]?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "national": r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9.-])",
    "localphone": r"(?<![A-Za-z0-9+.(-])(?:\([0-9]{2,4}\)[\x20]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![A-Za-z0-9.-])",
    "spelled": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}[\x20]?[\[(]at[\])][\x20]?[a-z0-9-]{1,63}(?:[\x20]?[\[(]dot[\])][\x20]?[a-z0-9-]{1,63}){1,5}+",
}
#: A text without this can't match; a cheap test before the pattern.
NEEDS = {"value": "=[A-Za-z0-9_/+-]{20}", "email": "@", "ip": r"[0-9]\.[0-9]", "phone": r"\+[0-9]", "spelled": r"(?i)[\[(]at[\])]"}
#: Patterns that propose candidates of a kind, where there are more than its own: NAME=VALUE as a whole and its value.
ALSO = {"secret": ("value",)}
#: Characters before and after a candidate that give its context.
CONTEXT = 32
CONTEXT_WORDS = {
    "key": "token|secret|passw|api|key|auth|credential|bearer",
    "person": "ssn|social|tax|passport|national|iban|account|konto|compte|cuenta",
    "call": "phone|tel|call|mobile|fax|contact",
}
FEATURES = [*(f"is_{k}" for k in EXTRA), "length", "digits", "letters", "cases", "hex", *CONTEXT_WORDS, "quoted"]
#: Generated examples for the trees, the half that calibrates the threshold, and the precision asked of it.
EXAMPLES, PRECISION, SEED = 1200, 0.99, 7


def _features(kind: str, span: str, before: str, after: str) -> list[float]:
    low = before.lower()
    return [
        *(float(kind == k) for k in EXTRA), float(len(span)), float(sum(c in "0123456789" for c in span)),
        float(len(re.findall("[A-Za-z]", span))), float(bool(re.search("[a-z]", span)) and bool(re.search("[A-Z]", span))),
        float(bool(re.fullmatch("[0-9a-f]+", span))), *(float(bool(re.search(w, low))) for w in CONTEXT_WORDS.values()),
        float(before[-1:] in ('"', "'", "=", ":") and after[:1] in ('"', "'", "")),
    ]


def _feature_columns(kind: str, span: Column, before: Column, after: Column) -> list[Column]:
    low, yes = F.lower(before), lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [
        *(F.lit(float(kind == k)) for k in EXTRA), F.length(span).cast("double"), F.length(F.regexp_replace(span, "[^0-9]+", "")).cast("double"),
        F.length(F.regexp_replace(span, "[^A-Za-z]+", "")).cast("double"), yes(span.rlike("[a-z]") & span.rlike("[A-Z]")),
        yes(span.rlike("^[0-9a-f]+$")), *(yes(low.rlike(w)) for w in CONTEXT_WORDS.values()),
        yes(F.right(before, F.lit(1)).isin('"', "'", "=", ":") & F.left(after, F.lit(1)).isin('"', "'", "")),
    ]


def _example(r: random.Random) -> tuple[str, str, str, str, int]:
    """A candidate (kind, span, before, after) that the patterns propose in a generated text, and whether it is
    personal data or a secret. What overlaps a planted span without being it is not."""
    while True:
        kind, span, before, after, good = _planted(r)
        whole, at = before + span + after, (len(before), len(before) + len(span))
        found = {m.span() for k in (kind, *ALSO.get(kind, ())) for m in re.finditer(PATTERNS[k], whole)}
        if at not in found:
            continue
        others = sorted(x for x in found if x != at and x[0] < at[1] and at[0] < x[1])
        if good and others and r.random() < 0.3:
            at, good = others[0], 0
        return kind, whole[at[0] : at[1]], whole[max(0, at[0] - CONTEXT) : at[0]], whole[at[1] : at[1] + 2], good


def _planted(r: random.Random) -> tuple[str, str, str, str, int]:
    """A span of a kind with the text around it, and whether it is personal data or a secret."""
    pick = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    hexes, mixed, lows = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: pick(r.randint(2, 9), lows)
    plain = " ".join(word() for _ in range(4)) + " "
    cue = lambda words: plain[: r.randint(0, 12)] + r.choice(words) + r.choice([" ", ": ", " = ", "=", ' = "', ' "'])
    kind, good = r.choice(EXTRA), r.random() < 0.5
    if kind == "secret":
        if good:
            before = cue(["token", "api_key", "secret", "password", "Authorization: Bearer", "key", "?token", "access_token"])
            return kind, r.choice([pick(40, hexes), pick(32, hexes), pick(r.randint(20, 64), mixed)]), before, '"' if before.endswith('"') else r.choice([" ", "&", "\n", ""]), 1
        plain += r.choice(["", f"{word()}=", r.choice(["sha=", "id=", "commit=", "?page="])])
        return kind, r.choice([pick(r.randint(20, 40), lows), "-" * r.randint(20, 60), "=" * r.randint(20, 60), "/".join(word() for _ in range(6)), pick(20, lows) + pick(3, "0123456789"), pick(40, hexes)]), plain, r.choice([" ", ".", ","]), 0
    if kind == "account":
        span = pick(2, "DEFRGBES") + pick(2, "0123456789") + "".join(" " + pick(4, "0123456789") for _ in range(r.randint(3, 5)))
        if good:
            return kind, span, cue(["IBAN", "account", "Konto"]), r.choice([" ", "."]), 1
        return kind, pick(2, "ABCXYZ") + pick(2, "0123456789") + "".join(pick(4, "ABCDEFXYZ") for _ in range(r.randint(2, 4))), plain, " ", 0
    if kind == "national":
        span = f"{r.randint(100, 899)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        return (kind, span, cue(["SSN", "social security", "tax id"]), " ", 1) if good else (kind, span, plain + r.choice(["part ", "no. ", "", ""]), " ", 0)
    if kind == "localphone":
        span = f"({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}" if good else f"{r.randint(10, 2020)} {r.randint(100, 999)} {r.randint(100, 999)}"
        return (kind, span, cue(["phone", "tel", "call", "mobile"]), " ", 1) if good else (kind, span, plain, " ", 0)
    if good:
        return kind, f"{word()} [at] {word()} [dot] com", r.choice([plain, cue(["mail", "contact"])]), " ", 1
    return kind, f"{word()} (at) {word()} (dot) {word()}{word()}", plain, " ", int(r.random() < 0.5)


@lru_cache(maxsize=1)
def model() -> tuple[list, float]:
    """Trees and threshold, fitted once on EXAMPLES generated candidates."""
    r = random.Random(SEED)
    rows = [_example(r) for _ in range(EXAMPLES)]
    x = np.array([_features(*row[:4]) for row in rows])
    y = np.array([row[4] for row in rows], float)
    half = EXAMPLES // 2
    trees = boosting.fit(x[:half], y[:half])
    return trees, boosting.calibrate(boosting.scores(trees, x[half:]), y[half:], PRECISION)


def _spans(text: Column, kind: str) -> Column:
    """array<struct<s, e, t>> of the kind's matches: start and end in code points and the text between."""
    pattern = PATTERNS[kind]

    def placed(gaps: Column) -> Column:
        def at(found: Column) -> Column:
            # what lies before match i: the gaps up to i and the matches before i
            ends = F.aggregate(
                F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")),
                F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out")),
                lambda a, x: F.struct(
                    (a["p"] + F.length(x["g"]) + F.length(x["m"])).alias("p"),
                    F.array_append(a["out"], F.struct((a["p"] + F.length(x["g"])).alias("s"), (a["p"] + F.length(x["g"]) + F.length(x["m"])).alias("e"), x["m"].alias("t"))).alias("out"),
                ),
                lambda a: a["out"],
            )
            return ends

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), at)

    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    possible = text.rlike(pattern)
    if kind in NEEDS:
        possible = text.rlike(NEEDS[kind]) & possible
    return F.when(possible, let(F.split(text, pattern, -1), placed)).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]+", "")


def _luhn(t: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(t)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(t, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (p == "") | ((F.length(p) <= 3) & (F.coalesce(F.left(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)))
    n = F.length(_digits(t))
    if kind == "card":
        return n.between(13, 19) & _luhn(t)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _checks(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["t"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _selected(text: Column, kind: str, pattern: str | None = None) -> Column:
    """The kind's candidates by its own or another pattern that the trees select."""
    trees, threshold = model()

    def keep(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
        after = F.substring(text, x["e"] + 1, F.lit(2))
        # bound once: each split of each tree would repeat its feature's whole expression in the plan
        score = lambda f: boosting.expression(trees, [F.get(f, F.lit(i)) for i in range(len(FEATURES))])
        return let(F.array(*_feature_columns(kind, x["t"], before, after)), score) >= F.lit(threshold)

    return F.filter(_spans(text, pattern or kind), keep)


def find_pii(docs: DataFrame) -> DataFrame:
    """Adds ``spans_found``, array<struct<kind, s, e>>: base kinds in their order, then selected further ones.

    Places are code points, the end exclusive; matches of one kind don't overlap, those of different kinds may.
    Null text counts as empty and has no spans. Texts of any length are searched whole; repeated rows are
    searched one by one; an empty table gives an empty result; further columns pass through (one named
    spans_found is replaced, those that begin with __pii_ are dropped).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs
    for k in BASE:
        out = out.withColumn(f"__pii_{k}", F.filter(_spans(text, k), _checks(k)))
    for k in EXTRA:
        out = out.withColumn(f"__pii_{k}", _selected(text, k))
        for p in ALSO.get(k, ()):
            # the value without its name, where both are selected
            out = out.withColumn("__pii_also", _selected(text, k, p))
            apart = lambda x: ~F.exists("__pii_also", lambda v: (v["s"] < x["e"]) & (x["s"] < v["e"]))
            out = out.withColumn(f"__pii_{k}", F.array_sort(F.concat(F.filter(f"__pii_{k}", apart), "__pii_also"))).drop("__pii_also")
    named = lambda k: F.transform(F.col(f"__pii_{k}"), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return out.withColumn("spans_found", F.concat(*[named(k) for k in (*BASE, *EXTRA)])).drop(*[f"__pii_{k}" for k in (*BASE, *EXTRA)])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """Replaces every found span of ``text`` by its kind in capitals and brackets; overlapping spans are
    merged into the first one. Null stays null; other columns stay."""
    found = find_pii(docs)
    order = F.sort_array(F.transform(F.col("spans_found"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    step = lambda a, x: F.when(-x["e"] <= a["p"], a).otherwise(F.struct(
        (-x["e"]).alias("p"),
        F.when(x["s"] < a["p"], a["out"]).otherwise(
            F.array_append(F.array_append(a["out"], F.substring(F.col("text"), a["p"] + 1, x["s"] - a["p"])), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        ).alias("out"),
    ))
    done = F.aggregate(order, F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("out")), step,
                       lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["p"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans_found") == 0, F.col("text")).otherwise(done)).drop("spans_found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row per document."""
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans_found", lambda x: x["kind"].isin(*BASE))
    return docs.select(
        "doc_id",
        *[F.size(F.filter("spans_found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans_found")).alias("spans"),
        (F.size("spans_found") > 0).alias("has_pii"),
    )
