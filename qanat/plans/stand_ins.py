"""The driver's tables as the engine's entities: documents are articles, benchmark
items are questions, embeddings are document vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.functions import text
from qanat.plans import index as search_index
from qanat.session import shared_dir
from qanat.sources.tables import spread, table

NOW = "2025-01-01"
CHUNKS = 1000  # units of a document are doc_id * CHUNKS + chunk number


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pub_day():
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")


def articles(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = documents(spark, sf_dir) if docs is None else docs
    return docs.select("doc_id", "text", F.col("lang").alias("league"), F.col("source").alias("article_type"), pub_day().alias("pub_date"))


def doc_units(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Whole documents as units."""
    return articles(spark, sf_dir, docs).select(
        F.col("doc_id").alias("unit"), F.col("doc_id").alias("doc"), text.plain_tokens(F.col("text")).alias("tokens"), "pub_date", "league", "article_type"
    )


def chunk_units(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Word windows as units."""
    a = articles(spark, sf_dir, docs).withColumn("text", F.lower("text"))
    c = text.windows(a, "text", "w", joined=False).select("doc_id", "pub_date", "league", "article_type", F.posexplode_outer("w").alias("i", "part"))
    return c.select(
        (F.col("doc_id") * CHUNKS + F.col("i")).alias("unit"), F.col("doc_id").alias("doc"), F.filter("part", lambda t: F.length(t) >= 2).alias("tokens"), "pub_date", "league", "article_type"
    )


def questions(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """The whole text of every benchmark item; with the vector of the same number."""
    b = table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("qid"), F.col("text").alias("query"), text.plain_tokens(F.col("text")).alias("tokens"))
    if vectors:
        v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
        q = q.join(v, "qid", "left")
    return q


_built: dict[tuple, str] = {}


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and latest change of a table's files: another content under the same path is another state."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(f.getLen(), f.getModificationTime()) for f in ([fs.getFileStatus(at)] if fs.getFileStatus(at).isFile() else fs.listStatus(at))]
    return sum(n for n, _ in found), max((t for _, t in found), default=0)


def index(spark: SparkSession, sf_dir: str, kind: str) -> search_index.Index:
    """The index of whole documents (``doc``) or their windows (``chunk``): built in the shared
    folder where the application first asks for it, then loaded."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, _state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _built:
        path = f"{shared_dir(spark)}/qanat/index-{kind}-{uuid.uuid4().hex}"
        # texts are dealt by number, not their tokens: these are made once, in order
        docs = table(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        search_index.build((doc_units if kind == "doc" else chunk_units)(spark, sf_dir, docs), path, ordered=True)
        _built[key] = path
    return search_index.load(spark, _built[key])


def vectors(spark: SparkSession, sf_dir: str, scale: int = 1) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") * scale).alias("unit"), F.col("embedding").alias("vector"))
