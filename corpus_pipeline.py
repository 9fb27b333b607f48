"""A corpus from raw documents to token ids: quality, line dedup, near dedup, mixing, BPE.

Every stage takes all that the one before it kept. All but the last return the columns of documents. Rows with nulls in
any column, repeated rows, empty and very long texts and empty tables go through every stage; what becomes of them is said
at each. Other columns than those of documents go along unchanged through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import bpe, cotraining, line_dedup, mixing, near_dedup
from framewise.llm.common import WORD, n_words, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    A null text is scored as an empty one, null metadata as a value of its own; equal rows have equal scores, ties with
    the threshold stay. Without labels of both classes, or without documents, all stay.
    """
    views = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return cotraining.score(docs, views).where(F.col("probability") >= cotraining.KEEP_FROM).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which that leaves no word; n_chars follows the text.

    Null and empty texts have no lines and stay. Of equal lines the one of the smallest doc_id and place stays, null ids
    first; rows equal in id and text stay together. Lines of any number and length are compared.
    """
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_exact") + F.col("n_near") > 0
    out = out.where(~changed | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id.

    Texts without words are no duplicates; of rows equal in id and text one stays. Rows without a doc_id stay.
    """
    return near_dedup.keep_first(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document stands as often as the mix takes it.

    A null source is one, last in order; null texts and texts without words have size 0. Equal rows, and rows that tie in
    their key, are taken or left together.
    """
    text = F.col("text")
    return mixing.epochs(mixing.mix(docs, n_words(text), F.coalesce(mixing.quality_weight(text), F.lit(0.05)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with a check that they decode to the text: a null text is an empty one, without ids. Equal rows have equal ids."""
    return bpe.encode(docs.select("doc_id", "source", "text"), bpe.default_path()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing", mix), ("BPE", encode)]
#: The trained classifier and the tokenizer can't be written in SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
