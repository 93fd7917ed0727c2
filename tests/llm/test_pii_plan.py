"""The plan of the personal-data search holds each feature once for each pattern, however many splits ask for it."""

from newslens.llm import pii


def test_features_stand_in_the_plan_once(spark):
    docs = spark.createDataFrame([(1, "token = 0123456789abcdef0123456789abcdef mail a@example.org"), (2, None)], "doc_id long, text string")
    found = pii.find_pii(docs)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count(pii.CONTEXT_WORDS["key"]) == len(pii.EXTRA) + sum(map(len, pii.ALSO.values()))
    kinds = {x["doc_id"]: {s["kind"] for s in x["spans_found"]} for x in found.collect()}
    assert kinds == {1: {"email", "secret"}, 2: set()}
