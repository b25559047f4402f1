"""A keyed store on the shared file system: an append log of segments, the latest row of a key wins.

A segment is a Parquet table bucketed and sorted by key, written by one append into a folder of
its own, so writers never touch each other's files; a segment counts once its ``_SUCCESS`` is there.  A probe
deals the asked keys to the buckets and joins every segment in place: the store is never shuffled, and a probe for
one key reads one bucket a segment.  Compaction writes the latest rows of the segments it has listed
as one segment and then deletes just those; a segment that appears meanwhile stays.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """Rows (key string, ts double, ``columns``) under ``path``.  All who open a path use the same ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, columns: str = "answer string", buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = f"key string, ts double, {columns}"
        self.fields = [f.name for f in spark.createDataFrame([], self.schema).schema.fields]
        self._known: set[str] = set()

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _table(self, name: str) -> str:
        return f"qanat_store_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{name}"

    def segments(self) -> list[str]:
        """Names of the complete segments, in order of name."""
        fs, top = self._fs(), self._at("")
        found = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in found if fs.exists(self._at(f"{n}/_SUCCESS")))

    def _segment(self, name: str) -> DataFrame:
        if name not in self._known:  # written by another session
            at = f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({self.schema}) USING parquet {at}")
            self._known.add(name)
        return self.spark.table(self._table(name))

    def append(self, rows: DataFrame) -> str:
        """Writes the rows as a segment of their own and returns its name; rows without key are left out."""
        name = uuid.uuid4().hex
        kept = rows.select(*self.fields).where("key is not null")
        # a task a bucket: one file a bucket and segment
        writer = kept.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key")
        writer.option("path", f"{self.path}/{name}").saveAsTable(self._table(name))
        self._known.add(name)
        return name

    def _latest(self, found: DataFrame, keep: list[str]) -> DataFrame:
        rest = [c for c in self.fields if c not in ("key", "ts")]
        best = F.max(F.struct("ts", *rest)).alias("__best")  # equal times: the greater row
        return found.groupBy("key", *keep).agg(best).select("key", *keep, "__best.*")

    def all(self) -> DataFrame:
        """The latest row of every key."""
        out = self.spark.createDataFrame([], self.schema)
        for name in self.segments():
            out = out.unionByName(self._segment(name).select(*self.fields))
        return self._latest(out, [])

    def probe(self, keys: DataFrame) -> DataFrame:
        """The latest rows of the asked keys (column ``key``; repeated keys count once); absent keys give none."""
        asked = keys.select("key").where("key is not null").distinct()
        found = self.spark.createDataFrame([], self.schema)
        for name in self.segments():
            found = found.unionByName(self._segment(name).join(asked, "key", "left_semi").select(*self.fields))
        return self._latest(found, [])

    def get(self, key: str) -> dict | None:
        """The latest row of one key: a bucket of every segment is read."""
        rows = []
        for name in self.segments():
            rows += self._segment(name).where(F.col("key") == key).collect()  # a key's own rows
        best = max(rows, key=lambda r: tuple((r[c] is not None, r[c]) for c in self.fields[1:]), default=None)
        return best.asDict() if best else None

    def compact(self, expired: Column | None = None) -> None:
        """Merges the segments there are now into one, without rows for which ``expired`` holds
        (over the store's columns).  Readers that have planned on the old segments must have finished."""
        old = self.segments()
        if not old:
            return
        out = self.spark.createDataFrame([], self.schema)
        for name in old:
            out = out.unionByName(self._segment(name).select(*self.fields))
        rows = self._latest(out, [])
        self.append(rows if expired is None else rows.where(~F.coalesce(expired, F.lit(False))))
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
            self._fs().delete(self._at(name), True)
            self._known.discard(name)
