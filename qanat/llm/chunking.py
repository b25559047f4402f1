"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has its low
bits at zero, between a least and a most chunk size; a cut depends on content
alone, so equal passages give equal chunks.  Chunks are named by their SHA-256,
stored once (Spark deduplicates the names), and each distinct payload is an
ordered list of names.  Reading back joins the lists with the store, checks
every chunk against its name and rebuilds the payload and its media form.

The media form of a payload is what the store holds of it: the zstd frames of its
chunks (8-bit samples), one after another in the order of its list.  That is one
zstd stream of several frames; decompressed it is the payload.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm import common

#: Payloads are padded with this byte to a positive multiple of UNIT bytes.
PAD, UNIT = 255, 576
LEAST, MASK_BITS, MOST = 2048, 12, 65536
LEVEL = 9
#: A chunk that more payloads list is read by several tasks, each for so many of them.
HOT_LISTS = 4096
GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at every byte: sum of GEAR[byte] << age over the last 32 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))  # the right side is made before it is stored
    return h


def payloads(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded payloads of a block of texts, one after the other, and their offsets."""
    size = np.diff(offs)
    padded = np.maximum(-(-size // UNIT), 1) * UNIT
    at = np.concatenate([[0], np.cumsum(padded)])
    out = np.full(int(at[-1]), PAD, np.uint8)
    out[np.repeat(at[:-1] - offs[:-1], size) + np.arange(len(data))] = data
    return out, at


def cuts(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Chunk ends of every payload."""
    marks = np.flatnonzero((gear(data) & np.uint32((1 << MASK_BITS) - 1)) == 0) + 1
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        ends = []
        if b - a > LEAST:
            own = marks[np.searchsorted(marks, a + LEAST) : np.searchsorted(marks, b)].tolist()
            pos, i = a, 0
            while b - pos > LEAST:
                while i < len(own) and own[i] < pos + LEAST:
                    i += 1
                pos = min(own[i] if i < len(own) else b, pos + MOST, b)
                ends.append(pos)
            if pos < b:
                ends.append(b)
        else:
            ends.append(b)
        out.append(ends)
    return out


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, recipe (names of the chunks, 32 bytes each, in order), recipe_id."""

    def task(batches):
        for rb, data, offs in common.blocks(batches):
            pay, at = payloads(data, offs)
            raw = memoryview(pay)
            names = []
            for a, ends in zip(at[:-1].tolist(), cuts(pay, at)):
                own = []
                for e in ends:
                    own.append(hashlib.sha256(raw[a:e]).digest())
                    a = e
                names.append(b"".join(own))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(np.diff(offs)), pa.array(names, pa.binary()), pa.array([hashlib.sha256(n).digest() for n in names], pa.binary())],
                ["doc_id", "n_bytes", "recipe", "recipe_id"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        task, "doc_id long, n_bytes long, recipe binary, recipe_id binary"
    )


def chunks(docs: DataFrame) -> DataFrame:
    """(name, blob) of every chunk, once a task; the blob is compressed."""

    def task(batches):
        seen: set[bytes] = set()
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for _, data, offs in common.blocks(batches):
            pay, at = payloads(data, offs)
            raw = memoryview(pay)
            names, blobs = [], []
            for a, ends in zip(at[:-1].tolist(), cuts(pay, at)):
                for e in ends:
                    name = hashlib.sha256(raw[a:e]).digest()
                    if name not in seen:
                        seen.add(name)
                        names.append(name)
                        blobs.append(pack.compress(raw[a:e]))
                    a = e
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(blobs, pa.binary())], ["name", "blob"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "name binary, blob binary")


FEATURES = (
    "recipe_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_chunks int"
)


def rebuild(lists: DataFrame, store: DataFrame) -> DataFrame:
    """One row per recipe: its payload is rebuilt from the store and verified."""
    n = (F.octet_length("recipe") / 32).cast("int")
    name = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("recipe"), i * 32 + F.lit(1), F.lit(32)))
    entries = common.staged(lists.select("recipe_id", n.alias("n"), F.posexplode(name).alias("seq", "name")), "entries")
    hot = common.staged(entries.groupBy("name").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > HOT_LISTS), "hot")
    if hot.limit(1).count():
        parts = F.ceil(F.col("__c") / HOT_LISTS).cast("int")
        salted = entries.join(hot, "name").withColumn("__salt", F.pmod(F.hash("recipe_id", "seq"), parts)).drop("__c")
        copies = store.join(hot, "name").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__c")
        found = entries.join(hot, "name", "left_anti").join(store, "name")
        found = found.unionByName(salted.join(copies, ["name", "__salt"]).drop("__salt"))
    else:
        found = entries.join(store, "name")
    found = found.select("recipe_id", "n", F.struct("seq", "name", "blob").alias("chunk"))
    single = found.where("n = 1").select("recipe_id", "n", F.array("chunk").alias("chunks"))
    several = found.where("n > 1").groupBy("recipe_id", "n").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))

    def task(batches):
        unpack = zstandard.ZstdDecompressor()
        for rb in batches:
            rows = []
            for key, n, got in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2)):
                parts, stored, media = [], 0, hashlib.sha256()
                for c in got.as_py():
                    piece = unpack.decompress(c["blob"])
                    media.update(c["blob"])
                    stored += len(c["blob"])
                    if hashlib.sha256(piece).digest() != c["name"]:
                        raise ValueError(f"chunk {c['name'].hex()} differs from its name")
                    parts.append(piece)
                if len(parts) != n:
                    raise ValueError(f"{n - len(parts)} chunks of {key.hex()} are missing")
                payload = b"".join(parts)
                hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                feature = f"chunks={n};sum={int(hist @ np.arange(256))};distinct={np.count_nonzero(hist)};mode={int(hist.argmax())}"
                rows.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), stored, media.hexdigest(), feature, n))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()))],
                    ["recipe_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"],
                )

    return single.unionByName(several).select("recipe_id", "n", "chunks").mapInArrow(task, FEATURES)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Stores every text's payload as chunks, reads it back and describes it.

    ``payload_*``, ``tail_crc32`` and ``feature`` are computed from the payload as read
    back; ``media_bytes`` and ``media_sha256`` are those of the stored frames.  Null
    text is empty (one unit of padding).  Equal texts share one recipe and are rebuilt
    once; rows that repeat an id keep their own.  A text of any length is cut whole.
    An empty table gives no rows.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    named = common.staged(recipes(docs), "recipes")
    store = common.bucketed(chunks(docs).dropDuplicates(["name"]), "chunks", "name")
    common.release(spark)
    lists = named.groupBy("recipe_id").agg(F.first("recipe").alias("recipe"))
    return named.select("doc_id", "n_bytes", "recipe_id").join(rebuild(lists, store), "recipe_id").drop("recipe_id")


def op1_chunked_media(spark, sf_dir: str) -> DataFrame:
    out = store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
