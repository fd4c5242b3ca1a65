"""A corpus from raw documents to packed training sequences, in five stages.

Every stage works on all rows that the one before it kept, is written as Parquet and read again. All
but the last return the columns of `documents`. The classifiers judge every row by its own text, with an id
or without; null texts are empty. A row without an id is nobody's copy. A table without rows passes all stages as such.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import jaccard, packing, quality, substrings, toxicity
from causeway.llm.common import keep, table

# The later stages are no SQL: classifiers, byte-pair ids and the packing itself.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the toxicity classifier rejects go (operator 6); rows that share an id are judged one by one."""
    return toxicity.harmless(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the quality classifier rejects go (operator 8); rows that share an id are judged one by one."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by near-equal shingle sets the one of smallest id stays (operator 2)."""
    grouped = jaccard.jaccard_components(docs)
    return docs.join(grouped.where("component_id != doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id has too are cut out (operator 3).

    A document that loses words keeps the others, joined by one space; one that loses all of them goes.
    `n_chars` follows the text.
    """
    changed = (substrings.remove_repeats(docs, with_text=True).where("n_removed > 0")
               .select(F.struct("doc_id", "whole_sha256").alias("key"), "kept").dropDuplicates(["key"]))
    # Rows that share an id but not their words are told apart by the digest of the words. The row travels as one
    # column, so names of other columns cannot clash.
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), substrings.words_sha256("text").alias("whole_sha256")).alias("key"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(changed, "key", "left").where("kept is null or kept != ''")
    new = {"text": F.coalesce("kept", F.col("row.text")),
           "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("row.n_chars")).cast("long")}
    return joined.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left as pieces of training sequences (operator 4)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
