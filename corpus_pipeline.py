"""From raw documents to tokens, in five stages: toxicity, language, near duplicates, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import with_tokens
from tidemark.llm.common import small_batches, table, written
from tidemark.llm.language import UNKNOWN
from tidemark.llm.language import train as train_language
from tidemark.llm.language import with_language
from tidemark.llm.mix import mixed
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.toxicity import train as train_toxicity
from tidemark.llm.toxicity import with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic, by a model of the labels of those that are not held out.

    Null and empty texts stay, as do all without labels of both kinds; equal texts share their fate; long ones
    count whole.  An empty table stays empty; other columns are kept as they are, whatever their names.
    """
    small_batches(spark)
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not those without any letter, nor those between two languages.

    Null and empty texts go; equal texts share their fate; without any row to learn from all stay.  An empty
    table stays empty; other columns are kept as they are, whatever their names.
    """
    small_batches(spark)
    model = train_language(docs)
    if model is None:  # nothing to learn from, so nothing to reject by
        return docs
    return with_language(docs, model).where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 80 percent): that with the smallest id.

    Rows with one id are one document: the row with the least hash of all columns stays.  Rows without id, and
    documents with null or empty texts, are in no group and stay.  An empty table stays empty; other columns
    are kept as they are.
    """
    small_batches(spark)
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    # of rows with one doc_id, the one with the least hash of all its columns, whatever the order they come in
    one = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return one.unionByName(kept.where("doc_id is null")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to the target weights, as documents.

    A null source is one of its own; texts without words are never taken, so they go; repeated rows take part
    one by one.  An empty table stays empty; other columns come from the document.
    """
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with digests of them and of what they decode to; a null text counts as empty.

    Every row is kept, repeated ones as well; columns that are named like new ones are replaced.
    """
    small_batches(spark)
    import public_tokenizers

    return with_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).drop("text")


STAGES = [("toxicity", toxicity), ("language", language), ("near_dup", near_dup), ("mix", mix), ("tokens", tokens)]
#: Learned models and signatures are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
