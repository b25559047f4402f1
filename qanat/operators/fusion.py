"""Rank fusion, recency, filters, one hit a document, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.config import RetrievalConfig
from qanat.session import guard


def fuse(sparse: DataFrame | None, dense: DataFrame | None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(qid, unit, rrf): sum over the lists of weight / (k_rrf + rank).  A missing list counts nothing."""
    sides = []
    for hits, w in ((sparse, config.w_sparse), (dense, config.w_dense)):
        if hits is not None:
            sides.append(hits.select("qid", "unit", (F.lit(w) / (config.k_rrf + F.col("rank"))).alias("part")))
    if not sides:
        raise ValueError("at least one ranked list is needed")
    guard(sides[0].sparkSession)
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return both.groupBy("qid", "unit").agg(F.sum("part").alias("rrf"))


def age_days(pub_date: Column, now: Column) -> Column:
    """Whole days since the date in the first ten characters; null if there is none, 0 if it is ahead."""
    day = F.try_to_timestamp(F.substring(pub_date.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.datediff(now.cast("date"), day)))


def recency(pub_date: Column, now: Column, config: RetrievalConfig = RetrievalConfig()) -> Column:
    """1 + max_boost * exp(-age / tau); 1 without a date."""
    return F.coalesce(1 + config.max_boost * F.exp(-age_days(pub_date, now) / config.tau_days), F.lit(1.0))


def keep(filters: dict) -> Column:
    """All given filters: equality on ``article_type`` and ``league``, membership for ``team``."""
    cond = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            cond = cond & F.coalesce(F.array_contains("teams", value) if name == "team" else F.col(name) == value, F.lit(False))
    return cond


WANTED = {"article_type": "wanted_type", "league": "wanted_league", "team": "wanted_team"}


def keep_each() -> Column:
    """The same by the filters of each row's own query (columns of ``WANTED``); a null filter lets all pass."""
    cond = F.lit(True)
    for name, want in WANTED.items():
        same = F.array_contains("teams", F.col(want)) if name == "team" else F.col(name) == F.col(want)
        cond = cond & (F.col(want).isNull() | F.coalesce(same, F.lit(False)))
    return cond


def finish(fused: DataFrame, meta: DataFrame, now: Column, filters: dict | Column, config: RetrievalConfig = RetrievalConfig(), collapse: bool = True) -> DataFrame:
    """Boost by recency, filter, keep the best unit of a document, cut to k.

    ``meta`` has unit, doc, pub_date and the filter columns.  The order of these
    steps is part of the result: filters come after both ranked pools.
    """
    hits = fused.join(meta, "unit").withColumn("score", F.round(F.col("rrf") * recency(F.col("pub_date"), now, config), config.digits))
    hits = hits.where(keep(filters) if isinstance(filters, dict) else filters)
    by = [F.col("score").desc(), F.col("unit")]
    if collapse:
        hits = hits.withColumn("__best", F.row_number().over(Window.partitionBy("qid", "doc").orderBy(*by))).where("__best = 1").drop("__best")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*by))).where(F.col("rank") <= config.k_final)
