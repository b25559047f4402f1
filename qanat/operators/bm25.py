"""BM25 as DataFrame algebra, for any number of queries at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qanat.config import Bm25Config


def vocabulary(units: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """(term, df, idf): idf = ln(N - df + 1/2) - ln(df + 1/2); negatives become
    epsilon times the mean over the whole vocabulary, negatives included."""
    df = units.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = units.agg(F.count(F.lit(1)).alias("n_units"))
    raw = df.crossJoin(n).withColumn("raw", F.log(F.col("n_units") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # one row: the mean comes from the few distinct document frequencies
    mean = raw.groupBy("df").agg(F.count(F.lit(1)).alias("c"), F.first("raw").alias("r")).agg(
        (F.sum(F.col("c") * F.col("r")) / F.sum("c")).alias("mean_idf")
    )
    floor = config.epsilon * F.col("mean_idf")
    return raw.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


#: Queries that are scored in one pass over the units: what is sent to tasks is bounded.
BLOCK = 1024
#: Units of one scoring step.
STEP = 512


def search(
    units: DataFrame, queries: DataFrame, k: int, config: Bm25Config = Bm25Config(), pad: bool = False, block: int = BLOCK
) -> DataFrame:
    """(qid, unit, score, rank) of the k best units of every query (qid, tokens).

    Repeated query tokens count as often as they occur.  Units without a query
    token are left out unless ``pad`` (they then fill up to k, least unit first).
    Ties go to the lesser unit.

    A block of queries travels to the units: each step scores its units against
    all of them by one matrix product and keeps k a query, so neither postings
    nor (query, unit) pairs of common terms are ever shuffled.
    """
    known, mean = statistics(units, queries.select(F.explode("tokens").alias("term")).distinct(), config)
    scored = None
    for asked in blocks(queries.select("qid", "tokens"), block):
        got = _scored(units, asked, known, mean, k, config)
        scored = got if scored is None else scored.unionByName(got)
    if scored is None:
        scored = _scored(units, [], known, mean, k, config)
    if pad:
        least = units.select(F.col("unit").cast("long")).orderBy("unit").limit(k)
        fill = queries.select(F.col("qid").cast("long")).distinct().crossJoin(least).join(scored, ["qid", "unit"], "left_anti")
        scored = scored.unionByName(fill.withColumn("score", F.lit(0.0)))
    return ranked(scored, k)


#: Tokens of the queries of one block at most (a longer query is a block of its own).
BLOCK_TOKENS = 1 << 18


def blocks(queries: DataFrame, most: int, size: int = BLOCK_TOKENS):
    """Lists of queries (qid, tokens or vector) in order, of ``most`` rows and about ``size`` items; the
    driver holds one of them at a time."""
    held, total = [], 0
    for r in queries.orderBy(queries.columns[0]).toLocalIterator():
        n = len(r[1] or [])
        if held and (len(held) == most or total + n > size):
            yield held
            held, total = [], 0
        held.append((r[0], r[1]))
        total += n
    if held:
        yield held


def statistics(units: DataFrame, terms: DataFrame, config: Bm25Config) -> tuple[dict[str, float], float]:
    """idf of the given terms and the mean length of a unit, from one pass over the units: a
    null term stands for the unit itself and carries its length."""
    marked = F.array_append(F.array_distinct("tokens"), F.lit(None).cast("string"))
    seen = units.select(F.size("tokens").alias("dl"), F.explode_outer(marked).alias("term")).groupBy("term")
    seen = seen.agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl")).persist()
    try:
        whole = seen.where("term is null").first()
        if whole is None:
            return {}, 1.0
        raw = lambda df: math.log(whole["df"] - df + 0.5) - math.log(df + 0.5)
        hist = seen.where("term is not null").groupBy("df").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()
        parts = [(r["n"], r["n"] * raw(r["df"])) for r in hist]
        floor = config.epsilon * sum(x for _, x in parts) / max(1, sum(n for n, _ in parts))
        found = {r["term"]: raw(r["df"]) for r in seen.join(terms, "term").select("term", "df").toLocalIterator()}
        return {t: floor if x < 0 else x for t, x in found.items()}, (whole["dl"] or 0) / whole["df"] or 1.0
    finally:
        seen.unpersist()


def _scored(units: DataFrame, asked: list, known: dict, mean: float, k: int, config: Bm25Config) -> DataFrame:
    words = sorted({w for _, t in asked for w in t or [] if w in known})
    place = {w: i for i, w in enumerate(words)}
    # for every term its queries and how often they ask for it: as large as the block's tokens
    asks: list[dict[int, int]] = [{} for _ in words]
    for j, (_, t) in enumerate(asked):
        for w in t or []:
            if w in place:
                own = asks[place[w]]
                own[j] = own.get(j, 0) + 1
    first = np.concatenate([[0], np.cumsum([len(x) for x in asks])]).astype(np.int64)
    query, times = np.array([j for x in asks for j in x], np.int64), np.array([n for x in asks for n in x.values()], float)
    qid, idf = np.array([q for q, _ in asked], np.int64), np.array([known[w] for w in words])
    names = pa.array(words, pa.string())

    def task(batches):
        for rb in batches:
            for a in range(0, rb.num_rows if len(words) else 0, STEP):
                part = rb.slice(a, STEP)
                unit, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                size = np.diff(np.asarray(lists.offsets))
                at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(unit)), size)
                hit = at >= 0
                key, tf = np.unique(row[hit] * len(words) + at[hit], return_counts=True)
                row, term = key // len(words), key % len(words)
                norm = config.k1 * (1 - config.b + config.b * size[row] / mean)
                weight = idf[term] * tf * (config.k1 + 1) / (tf + norm)
                # every posting meets the queries of its term
                n = first[term + 1] - first[term]
                own = np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                pair, shape = np.repeat(row, n) * len(qid) + query[own], (len(unit), len(qid))
                s = np.bincount(pair, np.repeat(weight, n) * times[own], shape[0] * shape[1]).reshape(shape)
                s = np.round(s, config.digits) + 0.0
                s[np.bincount(pair, minlength=s.size).reshape(shape) == 0] = -np.inf
                m = min(k, len(unit))
                edge = np.partition(s, len(unit) - m, axis=0)[len(unit) - m]  # whole ties at the edge stay
                i, j = np.nonzero((s >= edge) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(qid[j]), pa.array(unit[i]), pa.array(s[i, j])], ["qid", "unit", "score"])

    full = units.select(F.col("unit").cast("long"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    return full.mapInArrow(task, "qid long, unit long, score double")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("unit"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
