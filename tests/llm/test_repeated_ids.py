"""Near duplicates among rows that share an id."""

from newslens.llm import jaccard


def test_rows_of_one_id_are_documents_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, b + " tail"), (None, a), (6, ""), (5, a), (7, a)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, a), (3, b + " tail"), (None, a), (6, "")], key=str)
