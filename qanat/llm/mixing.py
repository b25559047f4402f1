"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in equal blocks.  The mix's blocks are apportioned to sources
by highest quotients ``target / (2 j + 1)``, each source's blocks again to its
shards by the shards' sizes, and every shard fills its quota from documents in
a seeded random order: whole passes over the shard, then the first blocks of
the order.  Native DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.llm import common

#: Weights of the sources in code-point order, repeating; null source last.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the input.
SHARE = 1.5
#: Passes that one document may be used for.
PASSES = 2
#: Words in a block.
BLOCK_WORDS = 64
#: Documents in a shard, on average.
SHARD_ROWS = 1024
SEED = "mix-1"
#: Rows of the source table that are broadcast at most (about 50 bytes each).
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES
) -> DataFrame:
    """Adds ``__w`` and ``target`` to (source, source_size): water-filling.

    With sources sorted by cap / weight, the level after capping the first j is
    (total - their caps) / (the others' weights); the first j whose own share
    at that level stays under its cap fixes the level for all the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * passes).cast("double")
    t = sources.withColumn("__w", w).withColumn("__cap", cap)
    order = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn(
        "__level",
        (F.sum("source_size").over(every) * share - (F.sum("__cap").over(upto) - F.col("__cap"))) / F.sum("__w").over(rest),
    )
    t = t.withColumn("__fits", F.col("__level") * F.col("__w") <= F.col("__cap"))
    t = t.withColumn("__at", F.row_number().over(order))
    first = F.min(F.when(F.col("__fits"), F.struct("__at", "__level"))).over(every)["__level"]
    return t.withColumn("target", F.least(F.coalesce(first, F.col("__level")) * F.col("__w"), F.col("__cap"))).drop(
        "__cap", "__level", "__fits", "__at"
    )


def sainte_lague(parties: DataFrame, group: list[str], name: str, weight: str, seats: str, out: str) -> DataFrame:
    """Seats for the parties of each group by highest quotients weight / (2 j + 1).

    Sainte-Lague seats differ from the ideal share p * seats by at most
    p * k / 2 + 1/2 for k parties, so only the quotients inside that range are
    made and ranked (about 3 k for a group); those below it are given.
    Ties go to the lesser name.
    """
    every = Window.partitionBy(*group)
    total, k = F.sum(weight).over(every), F.count(F.lit(1)).over(every)
    part = F.when(total > 0, F.col(weight) / total).otherwise(0.0)
    slack = part * k / 2 + 0.5
    t = parties.withColumn("__lo", F.greatest(F.lit(0), F.floor(part * F.col(seats) - slack - 1e-6)).cast("long"))
    t = t.withColumn("__hi", (F.ceil(part * F.col(seats) + slack + 1e-6) + 1).cast("long"))
    t = t.withColumn("__left", F.col(seats) - F.sum("__lo").over(every))
    keys = [*group, name]
    q = t.select(*keys, "__left", F.col(weight).alias("__wt"), F.explode(F.sequence("__lo", "__hi")).alias("__j"))
    ranked = q.withColumn(
        "__rank",
        F.row_number().over(Window.partitionBy(*group).orderBy((F.col("__wt") / (2 * F.col("__j") + 1)).desc(), F.col(name).asc_nulls_last(), "__j")),
    )
    won = ranked.groupBy(*keys).agg(F.count(F.when(F.col("__rank") <= F.col("__left"), 1)).alias("__won"))
    won = won.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__won")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return t.join(won, cond).withColumn(out, F.col("__lo") + F.col("__won")).drop(
        "__lo", "__hi", "__left", "__won", *[f"__k{i}" for i in range(len(keys))]
    )


def _described(docs: DataFrame, seed: str) -> DataFrame:
    """The masked table with source, size and the place ``mark`` of every row in the seeded order."""
    d, name = common.masked(docs)
    text = F.coalesce(F.col(name["text"]).cast("string"), F.lit(""))
    key = F.coalesce(F.col(name["doc_id"]).cast("string"), F.lit(""))
    mark = F.md5(F.concat(F.lit(seed + ":"), key, F.lit(":"), F.md5(text)))
    return d.select("*", F.col(name["source"]).alias("source"), word_count(F.col(name["text"])).alias("size"), mark.alias("mark"))


def _place(shards: str) -> Column:
    return F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % F.col(shards)


def _plan(slim: DataFrame, weights: Sequence[float], share: float, passes: int, block: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """Sources (source, source_size, target, shards) and shards (source, shard, m blocks, q of them dealt) from (source, size, mark)."""
    src = targets(
        slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, passes
    )
    src = src.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("long"))
    src = src.withColumn("all", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    src = sainte_lague(src.withColumn("g", F.lit(0)), ["g"], "source", "target", "all", "blocks")
    src = common.staged(src.select(F.col("source").alias("s0"), "source_size", "target", "shards", "blocks"), "sources")
    placed = slim.join(src, F.col("source").eqNullSafe(F.col("s0"))).withColumn("shard", _place("shards"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("seats"))
    shards = sainte_lague(shards, ["source"], "shard", "words", "seats", "quota")
    full = F.ceil(F.col("words") / block).cast("long")
    q = F.least(F.col("quota"), passes * full).cast("long")
    return src, common.staged(shards.select(F.col("source").alias("s1"), F.col("shard").alias("s2"), full.alias("m"), q.alias("q")), "shards")


def _dealt(rows: DataFrame, src: DataFrame, shards: DataFrame, block: int, *ties: Column) -> DataFrame:
    """Adds source_size, target and taken to (source, size, mark) rows of any other columns."""
    placed = rows.join(F.broadcast(src), F.col("source").eqNullSafe(F.col("s0"))) if src.count() <= BROADCAST_SOURCES else rows.join(src, F.col("source").eqNullSafe(F.col("s0")))
    placed = placed.withColumn("shard", _place("shards"))
    upto = Window.partitionBy("source", "shard").orderBy("mark", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("fin", F.sum("size").over(upto))
    dealt = placed.join(shards, F.col("source").eqNullSafe(F.col("s1")) & (F.col("shard") == F.col("s2")))
    whole = F.when(F.col("m") > 0, F.floor(F.col("q") / F.greatest(F.col("m"), F.lit(1)))).otherwise(0).cast("long")
    rest = (F.col("q") - whole * F.col("m")) * block
    piece = F.greatest(F.lit(0), F.least(F.col("fin"), rest) - (F.col("fin") - F.col("size")))
    return dealt.withColumn("taken", (whole * F.col("size") + piece).cast("long"))


def shares(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    block: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document: ``mix`` without the
    other columns.  Every text is read once; what follows works on its number of words."""
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    slim = common.staged(_described(slim, seed).select(F.col("c0").alias("doc_id"), "source", "size", "mark"), "sizes")
    src, shards = _plan(slim, weights, share, passes, block, shard_rows)
    return _dealt(slim, src, shards, block).select("doc_id", "size", "source_size", "target", "taken")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    block: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: str = SEED,
) -> DataFrame:
    """Adds size, source_size, target and taken to every document.

    ``taken`` counts the words of the document in the mix, repeats counted; it
    is at most ``passes * size``.  Null text has no words; a null source is a
    source of its own, last in order.  Texts of any length count whole.  Rows that
    repeat an id are mixed apart, in an order that a hash of their text and then of
    all their columns decides; rows equal in everything are interchangeable.  Input
    columns with an added name are replaced, all others pass through whatever their
    name.  An empty table gives no rows.  A source's shards hold about
    ``shard_rows`` documents each however large the source is, so a hot source is
    many window partitions.
    """
    added = ["size", "source_size", "target", "taken"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in added])
    rows = _described(base, seed)
    slim = common.staged(rows.select("source", "size", "mark"), "sizes")
    src, shards = _plan(slim, weights, share, passes, block, shard_rows)
    payload = [f"c{i}" for i in range(len(base.columns))]
    return _dealt(rows, src, shards, block, common.row_hash(rows, *payload)).select(*payload, *added).toDF(*base.columns, *added)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows, all columns unchanged: every document as often as its taken words
    are its size, rounded (0 to ``passes`` times); documents without words go.  Repeats,
    nulls, ties, clashing names and empty tables as in ``mix``."""
    d, name = common.masked(docs)
    inner = d.select("*", *[F.col(name[c]).alias(c) for c in ("doc_id", "source", "text")])
    m = mix(inner, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).otherwise(0).cast("int")
    m = m.withColumn("times", times).where("times > 0")
    return m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*d.columns).toDF(*docs.columns)


def op8_sainte_lague_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shares(docs)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS body, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER o AS pos,
  ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap))
   / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
s3 AS (SELECT *, (SELECT arg_min(lev, pos) FROM s2 WHERE lev * w <= cap) AS lvl FROM s2),
s4 AS (SELECT source, source_size, n, least(lvl * w, cap) AS target FROM s3),
s5 AS (SELECT *, ceil(n / 1024.0)::BIGINT AS shards, round(sum(target) OVER () / 64)::BIGINT AS seats FROM s4),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, source NULLS LAST, j) AS r, seats
  FROM s5, LATERAL (SELECT unnest(range(0, (target / 64)::BIGINT + 64)) AS j)),
b AS (SELECT source, count(*) FILTER (r <= seats) AS blocks FROM q GROUP BY source),
p AS (SELECT d.*, s5.source_size, s5.target, b.blocks, md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.body) AS mark, s5.shards
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source JOIN b ON d.source IS NOT DISTINCT FROM b.source),
p2 AS (SELECT *, ('0x' || substr(mark, 1, 8))::BIGINT % shards AS shard FROM p),
h AS (SELECT source, shard, sum(size)::BIGINT AS words, any_value(blocks) AS seats FROM p2 GROUP BY source, shard),
hq AS (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY words / (2 * j + 1) DESC, shard, j) AS r
  FROM h, LATERAL (SELECT unnest(range(0, seats + 1)) AS j)),
hb AS (SELECT source, shard, count(*) FILTER (r <= seats) AS quota FROM hq GROUP BY source, shard),
hh AS (SELECT h.source, h.shard, ceil(h.words / 64.0)::BIGINT AS m, least(hb.quota, 2 * ceil(h.words / 64.0)::BIGINT) AS q
  FROM h JOIN hb ON h.source IS NOT DISTINCT FROM hb.source AND h.shard = hb.shard),
r AS (SELECT p2.*, sum(size) OVER (PARTITION BY source, shard ORDER BY mark, size ROWS UNBOUNDED PRECEDING)::BIGINT AS fin FROM p2)
SELECT r.doc_id, r.size, r.source_size, r.target,
 (CASE WHEN m > 0 THEN (q // m) * r.size + greatest(0, least(fin, (q % m) * 64) - (fin - r.size)) ELSE 0 END)::BIGINT AS taken
FROM r JOIN hh ON r.source IS NOT DISTINCT FROM hh.source AND r.shard = hh.shard
"""
