"""Sharding by weighted rendezvous hashing.

Every (key, shard) pair gets a pseudo-random draw u in (0, 1) from a 64-bit
hash; the key goes to the shard with the least ``-ln(u) / weight``.  A shard
receives keys in proportion to its weight, and adding a shard only moves the
keys that the new shard wins.  The draw depends on nothing but key and shard,
so no state is kept and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.llm import common

LAW = "key"
#: Rows that share one numbering bin, on average.
BIN_ROWS = 16384


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) that wins ``key``.  A null key is the empty text.
    Shards of weight 0 win nothing; ties (equal draws) go to the lower shard."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")
    name = F.coalesce(key.cast("string"), F.lit(""))
    bids = []
    for i, w in enumerate(weights):
        if w > 0:
            draw = (F.shiftrightunsigned(F.xxhash64(name, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
            bids.append(F.struct((-F.log(draw) / float(w)).alias("bid"), F.lit(i).alias("shard")))
    return F.least(*bids)["shard"] if len(bids) > 1 else bids[0]["shard"]


def shard(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 16,
    key: str = "doc_id",
    text: str = "text",
    grown_weight: float = 1.0,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to every row.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1; its crc is that of
    the empty text).  ``slot`` numbers the rows of a shard from 0 without gaps:
    rows are numbered inside hash bins of a shard and the bins' bases come from
    prefix sums of their counts.  A bin is drawn from key, size and checksum, so
    rows that repeat a key (or have none) spread over the bins; only rows equal in
    all three share one, and their order among themselves is open.  Rows that repeat
    a key share a shard and get a slot each.  Texts of any length are read once and
    not sorted.  Columns of the input that carry one of the added names are replaced,
    all others pass through whatever their name.  An empty table gives none.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in added])
    d, name = common.masked(base)
    raw = F.coalesce(F.col(name[text]).cast("string"), F.lit("")).cast("binary")
    key_of = F.col(name[key])
    out = d.select(
        "*",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("crc"),
        shard_of(key_of, weights).cast("int").alias("shard"),
        shard_of(key_of, [*weights, grown_weight]).cast("int").alias("grown"),
    )
    n_bins = max(1, -(-docs.select(key).count() // (bin_rows * len(weights))))
    out = out.withColumn("bin", F.pmod(F.xxhash64(F.lit("slot"), key_of, "size", "crc"), F.lit(n_bins)))
    filled = out.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = filled.select("shard", "bin", (F.sum("n").over(upto) - F.col("n")).alias("base"))
    inside = Window.partitionBy("shard", "bin").orderBy(key_of, "size", "crc")
    numbered = out.withColumn("at", F.row_number().over(inside)).join(bases, ["shard", "bin"])
    slot = F.col("base") + F.col("at") - 1
    return numbered.select(*d.columns, "size", "crc", F.lit(LAW), "shard", slot, "grown").toDF(*base.columns, *added)


def op2_rendezvous_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
