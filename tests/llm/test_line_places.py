"""Rows that share a doc_id lose only lines that their own text repeats."""

from wardline.llm import line_edits


def test_texts_with_one_doc_id(spark):
    rows = [(1, "the first line of all"), (2, "the first line of all\nsomething else"), (2, "found nowhere else at all\n\nanother"), (2, None)]
    got = line_edits.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "the first line of all"), (2, "something else"), (2, "found nowhere else at all\n\nanother"), (2, None)], key=repr)
