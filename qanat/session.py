"""Makes this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the checkpoint folder the
    application has set.  Where there is neither, a temporary one on a local master only: on a
    cluster, files of one machine would be lost to the others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="qanat-shared-")
        found = _local[app]
    return found.rstrip("/")


def local(spark: SparkSession, columns: dict[str, list], schema: pa.Schema | None = None) -> DataFrame:
    """A few rows as a local relation: expressions over it are evaluated while planning, without a job."""
    return spark.createDataFrame(pa.table(columns, schema=schema))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: whatever reads it
    later does not compute it again."""
    path = f"{shared_dir(df.sparkSession)}/qanat/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def guard(spark: SparkSession) -> None:
    """A union of equally partitioned sides must not count as partitioned itself: adaptive
    execution may coalesce the sides differently, and an aggregate above then sees a key twice
    (observed with Spark 4.1.2: fused ranks came out as two rows)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, unless their PYTHONPATH already has it."""
    guard(spark)
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    name = os.path.join(tempfile.mkdtemp(prefix="qanat-ship-"), "qanat.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((root / "qanat").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
