"""The corpus pipeline: toxicity filter, near-duplicate removal, substring removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next one. The
first three return the columns of documents, whatever else these are named; the last returns the packed pieces.

Null texts count as empty: they are clean, near duplicates of nothing, lose no words, and are packed as their end id.
Texts of any length are taken whole. Rows without doc_id are kept by the first three stages. Of rows that repeat a doc_id
the second stage keeps that of smallest text, then of smallest other columns. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import restored, table, written
from tidewire.llm.minhash import near_duplicates
from tidewire.llm.packing import pack_documents
from tidewire.llm.queries import tokenizer_path
from tidewire.llm.substring import remove_duplicates
from tidewire.llm.toxicity import score_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model is trained on the labelled documents among docs."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return restored(score_documents(docs, model, docs.columns).filter("score < 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of smallest doc_id; of rows that repeat a doc_id, the
    one of smallest text, and of smallest other columns (as JSON) among these. Rows without doc_id stay."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct("text", F.to_json(F.struct(*others))) if others else F.struct("text")
    one = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by(row, order).alias("documents"))
    kept = one.join(gone, "doc_id", "left_anti").select("documents.*")
    return kept.union(docs.filter("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows go; a text that changes has its words joined by one space, others stay as
    they are. Texts may become empty; their rows stay."""
    cut = remove_duplicates(docs, ["cut"], [c for c in docs.columns if c not in ("doc_id", "text")])
    changed = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        length = F.length("cut").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("documents").getField("n_chars"))
    return restored(cut, docs.columns, **changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 2)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]

#: Classifier, near duplicates and packing are not for SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
