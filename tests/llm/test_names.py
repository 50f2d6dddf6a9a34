"""Extra columns with the names that operators use themselves, through the stages of the pipeline."""

from pyspark.sql import functions as F

from tidewire.llm.common import written

NAMES = ["kept", "cut", "kept_sha256", "documents", "score", "n_removed", "row", "link", "a b"]
WORDS = " ".join(f"w{i}" for i in range(60))


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline as pipeline

    rows = [(1, WORDS + " end", "en"), (2, WORDS + " other end of it", "en"), (3, None, "en"), (4, "", None), (None, "no id at all", "en"), (5, "x " * 30, "b"), (5, "x " * 30, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})
    docs = written(docs)
    for name in ("minhash_near_dedup", "substring_dedup"):
        out = written(dict(pipeline.STAGES)[name](spark, docs, sf_dir))
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == n + str("-" if r.doc_id is None else r.doc_id) for n in NAMES)
        docs = out
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 3, 4, 5, None} or set(got) == {1, 2, 3, 4, 5, None}
    assert got[5].lang == "a" and got[3].text is None and got[None].text == "no id at all"
    empty = docs.limit(0)
    for name in ("minhash_near_dedup", "substring_dedup"):
        assert dict(pipeline.STAGES)[name](spark, empty, sf_dir).count() == 0
