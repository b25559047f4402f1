"""Sources and sinks: Parquet tables, permissive JSON lines, stores and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qanat.session import ship

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

ARTICLE = T.StructType(
    [
        T.StructField("article_id", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("title", "body", "section")],
        T.StructField("tags", T.ArrayType(T.StringType())),
        *[T.StructField(n, T.StringType()) for n in ("article_type", "pub_date", "image", "source_url", "language", "scraped_at")],
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where the source is fewer splits than that (a small file
    of one row group); larger sources keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    """JSON lines with an order column (``file``, ``line``).  Blank and malformed lines go,
    as do rows whose first field is null or 0.  Lines of a file keep their order."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value"),
    )
    parsed = raw.where(F.trim("value") != "").withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    key = F.col(f"row.{schema.fields[0].name}")
    return parsed.where(key.isNotNull() & (key != 0)).select("row.*", "file", "block", F.col("at").alias("line"))


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key in the given order (never an arbitrary one).  Rows are
    compared under a digest of the key with partial aggregation: a hot key is one row a task
    before anything moves."""
    digest = F.sha2(F.col(key).cast("string"), 256)  # a null key is a key of its own
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(f"`{c}`") for c in order]))
    return df.groupBy(digest.alias("__digest")).agg(first.alias("__row")).select("__row.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row, replacing what was there."""
    df.write.mode("overwrite").json(path)


def not_done(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: the candidates whose key no finished row has."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


#: Ids below the least seed that a scan also visits.
SCAN_MARGIN = 500


def scan_range(seeds: DataFrame, start: int | None = None, end: int | None = None, margin: int = SCAN_MARGIN) -> tuple[int, int]:
    """First and last id of a scan: as given, else ``margin`` below the least seed and the greatest seed."""
    low, high = seeds.agg(F.min(F.col("id").cast("long")), F.max(F.col("id").cast("long"))).first()
    if low is None:
        return (start or 0, end if end is not None else (start or 0) - 1)
    return (low - margin if start is None else start, high if end is None else end)


def scan_plan(
    seeds: DataFrame, start: int | None = None, end: int | None = None, done: DataFrame | None = None, margin: int = SCAN_MARGIN, limit: int | None = None
) -> DataFrame:
    """Ids to visit: known seeds (priority 0), then the rest of [start, end] (1), each
    descending, without those done; with ``limit`` the first so many."""
    spark = seeds.sparkSession
    start, end = scan_range(seeds, start, end, margin)
    known = seeds.select(F.col("id").cast("long")).distinct().where(F.col("id").between(start, end))
    rest = spark.range(start, end + 1).select("id").join(known, "id", "left_anti")
    plan = known.withColumn("priority", F.lit(0)).unionByName(rest.withColumn("priority", F.lit(1)))
    if done is not None:
        plan = not_done(plan, done, "id")
    plan = plan.orderBy("priority", F.col("id").desc())
    return plan if limit is None else plan.limit(limit)
