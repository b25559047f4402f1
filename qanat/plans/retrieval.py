"""Hybrid retrieval for any number of queries.  Term statistics are looked up when it is called, the rest is one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.config import Bm25Config, RetrievalConfig
from qanat.operators import bm25, dense, fusion, vector_index
from qanat.operators.vector_index import VectorIndex
from qanat.plans import index as search_index


#: Hits that are sent to the rows of units at most; more are shuffled with them.
FEW = 1 << 19


def sent(hits: DataFrame, most: int) -> DataFrame:
    """``hits`` for a join with rows of units: broadcast where there are few, so that the units, which grow
    with the corpus, stay where they are read."""
    return F.broadcast(hits) if most <= FEW else hits


def _near(vectors: DataFrame | VectorIndex | None, queries: DataFrame, pool: int) -> DataFrame | None:
    """The dense side: every vector, or those of the cells that an index reads."""
    if vectors is None:
        return None
    return vector_index.search(vectors, queries, pool) if isinstance(vectors, VectorIndex) else dense.search(vectors, queries, pool)


def retrieve(
    units: DataFrame,
    queries: DataFrame,
    now: Column,
    vectors: DataFrame | VectorIndex | None = None,
    filters: dict | None = None,
    use_sparse: bool = True,
    config: RetrievalConfig = RetrievalConfig(),
    bm: Bm25Config = Bm25Config(),
    collapse: bool = True,
    index: search_index.Index | None = None,
) -> DataFrame:
    """Ranked hits (qid, unit, doc, score, rank) of queries (qid, tokens[, vector]).

    ``units`` has unit, doc, tokens, pub_date and the filter columns.  Order: each
    side's pool, fusion, recency boost, filters, best unit of a document, top k.
    With filters the pools are widened; ``filter_mode="pre"`` filters units first.
    With an ``index`` of the units their tokens are not read (save for "pre", whose
    statistics are those of the filtered units).
    """
    filters = {k: v for k, v in (filters or {}).items() if v is not None}
    pool = config.pool * (config.pool_mult if filters else 1)
    searched = units.where(fusion.keep(filters)) if config.filter_mode == "pre" else units
    sparse = None
    if use_sparse and index is not None and not config.pad_zero_scores and not (filters and config.filter_mode == "pre"):
        sparse = search_index.search(index, queries, pool, bm)
    elif use_sparse:
        sparse = bm25.search(searched, queries, pool, bm, config.pad_zero_scores)
    near = _near(vectors, queries, pool)
    fused = sent(fusion.fuse(sparse, near, config), queries.count() * pool * 2)
    return fusion.finish(fused, units.drop("tokens"), now, filters, config, collapse)


def retrieve_each(
    units: DataFrame, queries: DataFrame, now: Column, vectors: DataFrame | VectorIndex | None = None, config: RetrievalConfig = RetrievalConfig(),
    bm: Bm25Config = Bm25Config(), index: search_index.Index | None = None,
) -> DataFrame:
    """``retrieve`` where every query (qid, tokens[, vector], article_type, league, team) has filters of
    its own, applied after ranking; null: none.  Both sides rank the wide pool once, and a query without filters takes
    its first places.  Units' other columns are joined to the final hits only."""
    wide = config.pool * config.pool_mult
    names = [c for c in fusion.WANTED if c in queries.columns]
    some = F.lit(False)
    for c in names:
        some = some | F.col(c).isNotNull()
    wants = queries.select(
        "qid", F.when(some, wide).otherwise(config.pool).alias("pool"),
        *[(F.col(c) if c in names else F.lit(None)).cast("string").alias(w) for c, w in fusion.WANTED.items()],
    )
    cut = lambda hits: hits.join(wants.select("qid", "pool"), "qid").where("rank <= pool")
    sparse = search_index.search(index, queries, wide, bm) if index is not None else bm25.search(units, queries, wide, bm, config.pad_zero_scores)
    near = _near(vectors, queries, wide)
    near = cut(near) if near is not None else None
    slim = units.select("unit", "doc", "pub_date", *[c for c in ("article_type", "league", "teams") if c in units.columns])
    if "teams" not in slim.columns:
        slim = slim.withColumn("teams", F.array().cast("array<string>"))
    n = queries.count()
    fused = sent(fusion.fuse(cut(sparse), near, config).join(wants.drop("pool"), "qid"), n * wide * 2)
    best = fusion.finish(fused, slim, now, fusion.keep_each(), config).select("qid", "unit", "score", "rank")
    return sent(best, n * config.k_final).join(units.drop("tokens"), "unit")
