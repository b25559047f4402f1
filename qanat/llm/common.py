"""Shared plumbing of the training-data operators.

Python operators here work on Arrow batches (``mapInArrow``) and look at the
UTF-8 buffer of a whole block of documents at once, so no Python string is
built per document.  Everything that is written between stages goes to the
folder named by ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import gc
import time
import uuid
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.session import shared_dir, ship

#: Text bytes that one vectorised step looks at; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20

#: Records per Arrow batch: bounds what a Python worker holds besides its block.
ARROW_ROWS = 2000

M64 = (1 << 64) - 1


def tune(spark: SparkSession) -> None:
    """Ships the package, and settings the Python operators rely on for bounded memory."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_run: ContextVar[Run | None] = ContextVar("qanat_run", default=None)


class Run:
    """Knows the folders and catalog tables that are staged inside its ``with`` block, by this
    thread alone: other operators of the application, in other threads, have their own.  What is left
    at the end belongs to the run around it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __enter__(self) -> Run:
        self.token = _run.set(self)
        return self

    def __exit__(self, *error) -> None:
        _run.reset(self.token)
        if (outer := _run.get()) is not None:
            outer.made += self.made

    def drop(self, keep: int = 0) -> None:
        """Deletes all but the last ``keep`` folders.  Only for finished work: nothing may still read them."""
        gone = self.made[: len(self.made) - keep]
        self.made = self.made[len(gone) :]
        for path, table in gone:
            if table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    path = f"{shared_dir(spark)}/qanat/{name}-{uuid.uuid4().hex}"
    if (run := _run.get()) is not None:
        run.made.append((path, table))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as a Parquet table in the shared folder and reads it back:
    lineage ends there, and a lost executor loses no finished stage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``staged``, as a table bucketed by ``key``: later joins on it do not shuffle it again."""
    spark = df.sparkSession
    table = "qanat_" + uuid.uuid4().hex
    path = new_path(spark, name, table)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished stages now, rather
    than when the driver next happens to collect its garbage.  The first pass frees
    what only Python still held, the second what that held in the JVM."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ... in order, so that no name an operator adds can
    clash with them, and what each (exact or lower-case) name has become."""
    names: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        names.setdefault(c.lower(), f"c{i}")
    names |= {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), names


def row_hash(df: DataFrame, *columns: str) -> Column:
    """A 64-bit hash of the columns (all: none given), maps by their JSON."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = lambda c: "map<" in kinds[c] or "variant" in kinds[c]
    return F.xxhash64(*[F.to_json(F.struct(F.col(c))) if odd(c) else F.col(c) for c in columns or df.columns])


def id_text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def fold_of(doc_id: str | Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_text(doc_id), F.lit("")).cast("binary")) % mod


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null reads as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    elif pa.types.is_string(arr.type) or pa.types.is_binary(arr.type):
        kind = np.int32
    else:
        arr, kind = pc.cast(arr, pa.large_string()), np.int64
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    _, offs, data = arr.buffers()
    if offs is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """Yields (batch slice, bytes, offsets): runs of documents of about ``limit`` bytes."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        data, offs = utf8(rb.column(rb.schema.get_field_index(column)))
        a = 0
        while a < rb.num_rows:
            b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
            b = min(max(b, a + 1), rb.num_rows)
            yield rb.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of texts and the documents' offsets in them.  Bytes that are
    not UTF-8 become U+FFFD, document by document."""
    raw = data.tobytes()
    try:
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        inside = offs[:-1][offs[:-1] < len(data)]
        if not ((data[inside] & 0xC0) == 0x80).any():
            return codes, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    except UnicodeDecodeError:
        pass
    parts = [raw[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return np.frombuffer(b"".join(parts), np.uint32), np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype(np.int64)


#: Bytes that end a word: space and 0x09 to 0x0D.
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True


def spans(data: np.ndarray, offs: np.ndarray, is_gap: np.ndarray = WS):
    """Maximal runs of non-gap bytes inside documents: starts, ends, and per document
    the range of its runs (``first[i]:first[i + 1]``)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    gap = is_gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    solid = ~gap
    before = edge[:n].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}
_BYTE = np.random.default_rng(0x51EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            step = np.full(size, base & M64, np.uint64)
            step[0] = 1
            have = np.cumprod(step, dtype=np.uint64)
        _pow[base] = have
    return have[:n]


def mix64(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & M64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of ``values[start:end]`` for every span."""
    n = len(values)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(values * powers(_BASE, n), dtype=np.uint64, out=total[1:])
        part = (total[ends] - total[starts]) * powers(_INV, n)[starts]
        part += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix64(part)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans; ``fold`` maps bytes first (lower case, say)."""
    return run_hashes((_BYTE if fold is None else _BYTE[fold])[data], starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive items (one for each possible start)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(m)
    return run_hashes(words, at, at + n)


def repeats(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
