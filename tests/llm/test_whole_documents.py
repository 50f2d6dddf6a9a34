"""Operators that once took only part of a document, or of its rows."""

from pyspark.sql import functions as F

CLEAN = "all is well here. "


def test_toxicity_learns_from_whole_texts(spark):
    from tidewire.llm.toxicity import score_documents, train

    late = CLEAN * 12_000  # more than 200,000 characters
    rows = [(i, late + "you are awful scum. ", 1) for i in range(8)] + [(i, late, 0) for i in range(8, 16)] + [(16, "good morning to you. " * 100_000, 0)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    more = spark.createDataFrame([(20, "you are awful scum."), (21, CLEAN)], "doc_id long, text string")
    got = dict(score_documents(labelled.select("doc_id", "text").union(more), model).select("doc_id", "score").collect())
    assert [got[i] > 0.5 for i in range(17)] == [True] * 8 + [False] * 9
    assert got[20] > 0.5 > got[21]
