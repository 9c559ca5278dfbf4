"""A training corpus from documents: toxic ones go, one of each group of near copies stays, secrets are
cut out, sources are mixed to their weights, and what is left is packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import stored, table
from tallymark.llm.mixing import mixed
from tallymark.llm.neardup import near_duplicates
from tallymark.llm.packing import packed
from tallymark.llm.secrets import redacted
from tallymark.llm.toxicity import CUT, toxicity, train


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cut."""
    # the classifier learns from the documents that labels is about, whatever came before
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, "text", "__toxicity_score").where(F.col("__toxicity_score") < CUT).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, once. Shingles are of five words.
    Documents without an id belong to no group and stay."""
    keep = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.union(docs.where("doc_id is null"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced by a mark."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_copies_out),
    ("secrets", secrets_out),
    ("mixing", sources_mixed),
    ("packing", sequences),
]

#: learned scores, signatures and tokenizers have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
