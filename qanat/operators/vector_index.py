"""A clustered index of vectors: k-means cells, written once, searched by reading few of them.

Cells are fitted on a bounded sample (``SAMPLE`` rows drawn by a hash of the unit); every vector is then
written to the cell of its nearest centroid.  Layout of an index folder: ``cells`` (centroid, size and radius of
each, at most ``CELLS`` rows), ``vectors`` partitioned by cell, ``facts`` (one row).

A search reads the cells that are nearest to a query (as many as gave ``RECALL`` on the sample), scores their
vectors exactly and keeps k a query and batch.  ``exact=True`` goes on: no vector of a cell scores more than the
query's product with the centroid plus its norm times the cell's radius, so the cells whose bound reaches the
k-th score so far are read too, and the result is that of a full search.  Nothing is sampled but the fit, so
all vectors are found wherever their cell is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.memo import Memo
from qanat.operators.bm25 import ranked
from qanat.session import ship

#: Rows that the centroids are fitted on at most, and cells at most.
SAMPLE, CELLS = 1 << 16, 1 << 12
#: Vectors of a cell, about, in small tables (larger ones have the square root of their size in cells).
LEAST = 32
#: Share of the ten nearest of a sampled vector that its probes must hold in the sample.
RECALL, NEAREST, TRIED = 0.97, 10, 512
#: Vectors that one question brings to the driver at most, and bytes of cells that are remembered there.
READ, CELL_BYTES = 1 << 17, 256 << 20
STORED = "unit long, vector array<double>, far double, cell int"
#: Queries of one pass.
BLOCK = 2048


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    probes: int
    n: int
    sizes: np.ndarray
    #: Cells that single questions have read lately: units and vectors.
    cells: Memo = field(default_factory=lambda: Memo(CELL_BYTES), compare=False, repr=False)

    def __len__(self) -> int:
        return len(self.centroids)


def _rows(column) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _usual(vectors: DataFrame) -> DataFrame:
    return vectors.where("vector is not null").select(F.col("unit").cast("long").alias("unit"), F.col("vector").cast("array<double>").alias("vector"))


def _cell_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid (ties: smaller number)."""
    return np.argmin((centroids**2).sum(1) - 2 * (x @ centroids.T), axis=1)


def fit(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of a sample: Lloyd rounds from rows drawn by a seed; a cell that empties takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        at = _cell_of(x, c)
        n = np.bincount(at, minlength=cells)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        far = np.argsort(-((x - c[at]) ** 2).sum(1), kind="stable")
        for j, row in zip(np.flatnonzero(n == 0), far):
            c[j] = x[row]
    return c


def enough_probes(x: np.ndarray, centroids: np.ndarray, recall: float = RECALL, k: int = NEAREST) -> int:
    """How many of its best cells a sampled vector must read so that they hold ``recall`` of its k nearest in the sample."""
    asked = x[: TRIED]
    at = _cell_of(x, centroids)
    scores = asked @ x.T
    near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, at[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> None:
    """Writes the index of vectors (unit, vector) to ``path``.  Null vectors are left out; equal vectors lie in one cell,
    whose rows are dealt to several files where there are many."""
    spark = vectors.sparkSession
    ship(spark)
    v = _usual(vectors)
    n = v.count()
    if cells is None:
        cells = max(1, min(CELLS, -(-n // LEAST), max(16, int(np.sqrt(n)))))
    drawn = v if n <= sample else v.where(F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    got = drawn.orderBy(F.xxhash64(F.lit(seed), "unit"), "unit").limit(sample).toArrow()  # at most ``sample`` rows
    x = _rows(got["vector"].combine_chunks()) if got.num_rows else np.zeros((0, 1))
    centroids = fit(x, min(cells, len(x)), seed=seed) if len(x) else np.zeros((1, 1))
    probes = enough_probes(x, centroids) if len(x) else 1
    sent = spark.sparkContext.broadcast(centroids)

    def task(batches):
        c = sent.value
        for rb in batches:
            if rb.num_rows:
                x = _rows(rb.column(1))
                at = _cell_of(x, c)
                far = np.sqrt(((x - c[at]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(far), pa.array(at.astype(np.int32))], ["unit", "vector", "far", "cell"])

    dealt = v.mapInArrow(task, STORED)
    dealt.hint("rebalance", "cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    written = spark.read.schema(STORED).parquet(f"{path}/vectors")
    size = {r["cell"]: (r["n"], r["far"]) for r in written.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    rows = [(i, c.tolist(), *size.get(i, (0, 0.0))) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>, n long, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(n, probes)], "n long, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load(spark: SparkSession, path: str) -> VectorIndex:
    facts = spark.read.parquet(f"{path}/facts").first()
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most ``CELLS`` rows
    vectors = spark.read.schema(STORED).parquet(f"{path}/vectors")
    return VectorIndex(vectors, np.array([r["centroid"] for r in cells]), np.array([r["radius"] for r in cells]), facts["probes"], facts["n"], np.array([r["n"] for r in cells]))


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(qid, unit, score, rank) of the k vectors of largest inner product among the cells read for each query (qid, vector).
    Scores are rounded; ties go to the lesser unit.  Queries are taken in blocks, by their best cell, so that a block reads
    few cells.  Null vectors have no hits."""
    spark = queries.sparkSession
    ship(spark)
    if not index.n:
        return ranked(spark.createDataFrame([], "qid long, unit long, score double"), k)
    p = min(len(index), index.probes if probes is None else probes)
    sent = spark.sparkContext.broadcast(index.centroids)

    def best(batches):
        for rb in batches:
            if rb.num_rows:
                yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(np.argmax(_rows(rb.column(1)) @ sent.value.T, axis=1))], ["qid", "vector", "cell"])

    q = queries.where("vector is not null").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    out = None
    for ids, m in _blocks(q.mapInArrow(best, "qid long, vector array<double>, cell long").orderBy("cell", "qid"), block):
        products = m @ index.centroids.T
        wanted = np.zeros(products.shape, bool)
        np.put_along_axis(wanted, np.argsort(-products, axis=1, kind="stable")[:, :p], True, axis=1)
        got = _scored(index, ids, m, wanted, k, digits)
        if exact:
            # the first places a query has so far bound what other cells could add
            first = ranked(got, k).groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).collect()  # a row a query of the block
            least = {r["qid"]: r["least"] for r in first if r["n"] >= k}
            floor = np.array([least.get(i, -np.inf) for i in ids.tolist()])
            bound = products + np.linalg.norm(m, axis=1)[:, None] * index.radius
            wanted |= bound >= floor[:, None] - 10.0**-digits
            got = _scored(index, ids, m, wanted, k, digits)
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "qid long, unit long, score double")
    return ranked(out, k)


def _blocks(queries: DataFrame, block: int):
    """Blocks of queries (ids, matrix), never more than one of them at the driver."""
    ids, rows = [], []
    for r in queries.select("qid", "vector").toLocalIterator():
        ids.append(r["qid"])
        rows.append(r["vector"])
        if len(ids) == block:
            yield np.array(ids), np.array(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows)


def _scored(index: VectorIndex, ids: np.ndarray, m: np.ndarray, wanted: np.ndarray, k: int, digits: int) -> DataFrame:
    cells = [int(c) for c in np.flatnonzero(wanted.any(0))]

    def task(batches):
        for rb in batches:
            at = rb.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(at).tolist():
                asked = np.flatnonzero(wanted[:, c])
                rows = np.flatnonzero(at == c)
                part = rb.take(pa.array(rows)) if len(rows) < rb.num_rows else rb
                unit, x = part.column(0).to_numpy(zero_copy_only=False), _rows(part.column(1))
                s = np.round(m[asked] @ x.T, digits) + 0.0
                few = min(k, len(unit))
                edge = -np.partition(-s, few - 1, axis=1)[:, few - 1]  # whole ties at the edge stay
                i, j = np.nonzero(s >= edge[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[asked[i]]), pa.array(unit[j]), pa.array(s[i, j])], ["qid", "unit", "score"])

    return index.vectors.where(F.col("cell").isin(cells)).select("unit", "vector", "cell").mapInArrow(task, "qid long, unit long, score double")


def nearest(index: VectorIndex, vector: np.ndarray, k: int, digits: int = 6) -> list[tuple[int, float]]:
    """(unit, score) of the k best vectors for one query among the cells it reads.  Cells that are not in memory are read
    by one job of one stage and scored here, if they hold at most ``READ`` vectors; else in the cluster."""
    if not index.n:
        return []
    m = np.asarray(vector, float)[None, :]
    wanted = np.zeros((1, len(index)), bool)
    wanted[0, np.argsort(-(m @ index.centroids.T)[0], kind="stable")[: index.probes]] = True
    cells = [int(c) for c in np.flatnonzero(wanted[0]) if index.sizes[c]]
    if index.sizes[cells].sum() > READ:
        got = _scored(index, np.zeros(1, np.int64), m, wanted, k, digits).orderBy(F.col("score").desc(), "unit").limit(k)
        return [(r["unit"], r["score"]) for r in got.select("unit", "score").collect()]
    held = index.cells.found(cells)
    missing = [c for c in cells if c not in held]
    if missing:
        t = index.vectors.where(F.col("cell").isin(missing)).select("unit", "vector", "cell").toArrow()
        unit, x, cell = t["unit"].to_numpy(), _rows(t["vector"].combine_chunks()), t["cell"].to_numpy()
        for c in missing:
            own = np.flatnonzero(cell == c)
            held[c] = (unit[own], x[own])
            index.cells.put(c, held[c], x[own].nbytes + 8 * len(own) + 200)
    if not cells:
        return []
    unit, x = (np.concatenate([held[c][j] for c in cells]) for j in range(2))
    score = np.round(x @ m[0], digits) + 0.0
    first = np.lexsort((unit, -score))[:k]
    return list(zip(unit[first].tolist(), score[first].tolist()))
