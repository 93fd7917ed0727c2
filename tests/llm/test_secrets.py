"""Secrets written NAME=VALUE."""

import random

from newslens.llm import pii

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_values_after_names(spark):
    rows = [f"set token={HEX} now", f"api_key={HEX}", f"see https://x.org/a?token={HEX}&b=1", f"secret: {HEX}", f'token = "{HEX}"', f"password:{HEX} x", "a " + "=" * 60 + " b", f"page={'abcdefgh' * 4} x"]
    got = pii.redact(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [g["text"] for g in got] == ["set token=[SECRET] now", "api_key=[SECRET]", "see https://x.org/a?token=[SECRET]&b=1", "secret: [SECRET]", 'token = "[SECRET]"', "password:[SECRET] x", *rows[6:]]


def test_examples_are_candidates_of_the_patterns():
    r = random.Random(3)
    kinds = [pii._example(r) for _ in range(600)]
    named = [x for x in kinds if x[0] == "secret" and x[2].endswith("=")]
    assert {x[4] for x in named} == {0, 1}
    assert any(x[0] == "secret" and "=" in x[1].strip("=") and not x[4] for x in kinds)
