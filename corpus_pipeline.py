"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding (``qanat.llm.pipeline``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qanat.llm import pipeline

#: (name, function) in order; each function takes (spark, docs, sf_dir).
STAGES = list(pipeline.STAGES)

#: The stages are learned, hashed or aligned: SQL cannot express them; tests/llm compares with brute force.
ORACLE_SQL = pipeline.ORACLE_SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(spark, sf_dir, STAGES)
