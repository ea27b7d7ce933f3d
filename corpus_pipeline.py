"""From raw documents to packed training sequences, as five stages of the training-data operators.

Each stage takes any table with (doc_id, text), and for mixing source, and looks at whole texts. Every stage gives an
empty result for an empty table. All but the last return the columns of their input, of any name and type.

As an application of its own, the pipeline bounds the rows that its session hands to a Python worker at a time, so that
whole texts take little memory there; operators don't touch the session beyond their own writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm import common, exact_dedup, minhash_dedup, mixing, packing, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, rejects go.

    A null or empty text is scored by its shape alone; rows with equal texts go or stay together, whatever their ids;
    without labels all stay. A very long text is counted in parts, whole.
    """
    common.set_small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the one with the smallest id.

    Texts are compared without white space; null, empty and blank texts are one group. Of rows equal in id and length one
    stays; a row without id stays only where its group has no row with one that is as long.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 on five-word shingles) stays: the one with the smallest id.

    A text without words links with nothing and stays, however often it is there. Rows go by their own text, so of rows that
    repeat an id only those go that are near copies; a group without any id keeps one row.
    """
    return minhash_dedup.keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out towards the target weights of their sources, and shuffled.

    A null source is a source of its own; one whose texts are all null or empty has no bytes and gives no copies. Rows that
    repeat an id are repeated alike, and rows without id too.
    """
    return mixing.replicate(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens.

    A null or empty text is its end token alone; a text of more than 1023 tokens is cut; every row is packed, repeated ones
    each. Other columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Tokenization, nearest neighbours and MinHash are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
