"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes all that its predecessor kept, read back from Parquet.  What a stage
staged on its way, and the stage before it, are deleted once the stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qanat.llm import common, decontamination, langid, mixing, near_dup, sharding


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts among them) or of no clear language.

    Learns from the documents themselves.  Every row is judged by its own whole text, so
    repeated rows and ids, missing ids and ties do not matter; an empty table stays empty.
    All columns pass through.
    """
    model = langid.train(docs, common.fold_of("doc_id", 3) != 1)
    return langid.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every class of equal or near-equal texts, the one of least id.

    Null text is empty, and empty texts are one class.  Rows without id stay; of rows that
    repeat an id the least text stays.  Texts of any length are compared whole; an empty
    table stays empty.  All columns pass through.
    """
    return near_dup.survivors(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    Null and empty texts stay, as do all rows where the benchmark is empty.  Rows are judged
    by their whole text alone: ids, ties and repeats do not matter.  All columns pass through.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources to their target weights; a document may come out twice.

    A null source is a source of its own.  Documents without words go.  Rows that repeat an
    id are drawn apart, ties by a hash of the row; an empty table stays empty.  All columns
    pass through.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot (and size, text_crc32, law, grown_shard).

    A null id is a key like any other, a null text has size 1.  Rows that repeat a key share
    a shard and have a slot each; an empty table stays empty.  Columns of the added names are
    replaced, all others pass through.
    """
    return sharding.shard(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages are learned, hashed or aligned: SQL cannot express them; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages=None) -> DataFrame:
    """The documents through ``stages`` (all by default)."""
    stages = STAGES if stages is None else stages
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.Run(spark) as staged:
        for name, stage in stages[:-1]:
            docs = common.staged(stage(spark, docs, sf_dir), name)
            staged.drop(keep=1)
            common.release(spark)
    return stages[-1][1](spark, docs, sf_dir)
