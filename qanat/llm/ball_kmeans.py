"""Ball k-means over integer vectors, exact in every comparison.

A cluster is a ball: its centroid, and a radius that holds all its members.  After a round the
centroid moves, so the new ball has the old radius and the way moved.  Only centroids nearer than
twice the radius are neighbours.  Members nearer to their centroid than half the way to the nearest
neighbour are the stable core and stay without a comparison; the rest lies in annuli between
half the ways to the neighbours, sorted by distance, and a member of the j-th annulus is compared exactly with
the first j neighbours only.

Each round is one pass over the vectors, written with their clusters to the shared folder; sums are
added up in the tasks, so a round sends k rows a task and brings k rows to the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm import common

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Least magnitude of a component for which squared distances no longer fit 64 bits.
TOO_LARGE = 1 << 27


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(key, v) of the vectors with ``dims`` components, none null or non-finite: v holds
    floor(scale * component) as little-endian 32-bit integers.  Components of 2 ** 27 or more are an error: their distances
    do not fit."""
    common.tune(vectors.sparkSession)

    def task(batches):
        for rb in batches:
            lists = rb.column(1)
            flat, size = lists.flatten(), pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            whole = size == dims
            own = np.repeat(np.arange(rb.num_rows), np.maximum(size, 0))
            x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            whole[own[~np.isfinite(x)]] = False
            x = x[whole[own]].reshape(-1, dims)
            with np.errstate(over="ignore"):
                y = np.floor(scale * x)
            if y.size and np.abs(y).max() >= TOO_LARGE:
                raise ValueError(f"a component of {np.abs(y).max():.3g} after scaling: squared distances do not fit 64 bits")
            y = np.ascontiguousarray(y.astype("<i4"))
            buf = pa.py_buffer(y.tobytes())
            offs = pa.py_buffer(np.arange(len(y) + 1, dtype=np.int32) * (4 * dims))
            v = pa.Array.from_buffers(pa.binary(), len(y), [None, offs, buf])
            yield pa.RecordBatch.from_arrays([rb.column(0).filter(pa.array(whole)), v], ["key", "v"])

    return vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("x")).mapInArrow(task, "key long, v binary")


def starts(rows: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors of least SHA-256 of ``seed:key``, in that order (ties: least vector; a null
    key counts as the empty text).  Fewer vectors than k give fewer centroids."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    got = rows.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in got], np.int64)


def _matrix(column) -> np.ndarray:
    data, offs = common.utf8(column)
    return np.frombuffer(data.tobytes(), "<i4").astype(np.int64).reshape(len(offs) - 1, -1)


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of every vector, compared with all centroids (ties: smaller number)."""
    best, cluster = _squared(v, centroids[0]), np.zeros(len(v), np.int32)
    for j in range(1, len(centroids)):
        d = _squared(v, centroids[j])
        less = d < best
        best[less], cluster[less] = d[less], j
    return cluster, best


def neighbours(centroids: np.ndarray, radii: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per ball: the centroids that may be as near to a member as its own, and their squared
    distances from it, nearest first."""
    out = []
    for i, c in enumerate(centroids):
        way = _squared(centroids, c)
        order = np.argsort(way, kind="stable")
        order = order[(order != i) & (way[order] <= 4 * radii[i] * radii[i])]
        out.append((order, way[order]))
    return out


def reassigned(v: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, balls: list) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroids of vectors that were in ``cluster``, by balls and annuli, and the number of distances computed."""
    out, best = cluster.copy(), np.zeros(len(v), np.int64)
    compared = len(v)
    for i in np.unique(cluster):
        rows = np.flatnonzero(cluster == i)
        own = _squared(v[rows], centroids[i])
        best[rows] = own
        near, way = balls[i]
        if not len(near):
            continue
        # a centroid farther than twice the member's own distance cannot be as near
        annulus = np.searchsorted(way, 4 * own, side="right")
        for j in range(int(annulus.max(initial=0))):
            some = rows[annulus > j]
            d = _squared(v[some], centroids[near[j]])
            compared += len(some)
            less = (d < best[some]) | ((d == best[some]) & (near[j] < out[some]))
            best[some[less]], out[some[less]] = d[less], near[j]
    return out, best, compared


def _assigned(rows: DataFrame, centroids: np.ndarray, balls: list | None) -> DataFrame:
    """(key, v, cluster, distance); the rows have a cluster of the round before if there are balls."""
    sent = rows.sparkSession.sparkContext.broadcast((centroids, balls))

    def task(batches):
        c, b = sent.value
        for rb in batches:
            if not rb.num_rows:
                continue
            v = _matrix(rb.column(1))
            if b is None:
                cluster, d = nearest(v, c)
            else:
                cluster, d, _ = reassigned(v, rb.column(2).to_numpy(), c, b)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(cluster, pa.int32()), pa.array(d)], ["key", "v", "cluster", "distance"])

    return rows.select("key", "v", *(["cluster"] if balls is not None else [])).mapInArrow(task, "key long, v binary, cluster int, distance long")


def _sums(rows: DataFrame, k: int) -> list:
    """Per cluster: members, farthest one, summed distance and summed components, added up in the tasks first."""

    def task(batches):
        total: dict[int, list] = {}
        for rb in batches:
            v, cluster, d = _matrix(rb.column(1)), rb.column(2).to_numpy(), rb.column(3).to_numpy()
            for i in np.unique(cluster).tolist():
                m = cluster == i
                t = total.setdefault(i, [0, 0, 0, np.zeros(v.shape[1], object)])
                t[0] += int(m.sum())
                t[1] = max(t[1], int(d[m].max()))
                t[2] += sum(d[m].tolist())
                t[3] += v[m].sum(0).astype(object)
        if total:
            ids = sorted(total)
            big = lambda f: pa.array([[str(x) for x in f(total[i])] for i in ids], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int32()), pa.array([total[i][0] for i in ids], pa.int64()), pa.array([total[i][1] for i in ids], pa.int64()), big(lambda t: [t[2], *t[3]])],
                ["cluster", "n", "far", "sums"],
            )

    parts = rows.select("key", "v", "cluster", "distance").mapInArrow(task, "cluster int, n long, far long, sums array<string>")
    parts = parts.select("cluster", "n", "far", F.posexplode("sums").alias("i", "s"))
    whole = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [[0, 0, 0, []] for _ in range(k)]
    for r in sorted(whole.collect(), key=lambda r: (r["cluster"], r["i"])):  # clusters x (components + 1) rows
        t = out[r["cluster"]]
        t[0], t[1] = r["n"], r["far"]
        if r["i"] == 0:
            t[2] = int(r["s"])
        else:
            t[3].append(int(r["s"]))
    return out


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> tuple[DataFrame, np.ndarray, list]:
    """Assignments (key, v, cluster, distance) after ``rounds`` rounds, the centroids and, per
    cluster, [members, farthest, summed distance, summed components].

    A round assigns every vector to the nearest centroid (ties: smaller number) and replaces centroids of
    non-empty clusters by the floor of the mean.  Assignments of finished rounds are deleted.
    Repeated rows are clustered one by one; an empty table gives no rows and no centroids.
    """
    with common.Run(rows.sparkSession) as run:
        now = common.staged(rows, "vectors")
        centroids = starts(now, k, seed)
        if not len(centroids):
            return _assigned(now, np.zeros((1, DIMS), np.int64), None), centroids, []
        balls = None
        for step in range(rounds + 1):
            now = common.staged(_assigned(now, centroids, balls), "assigned")
            run.drop(keep=1)
            total = _sums(now, len(centroids))
            if step < rounds:
                moved = np.array([[s // t[0] for s in t[3]] if t[0] else c.tolist() for t, c in zip(total, centroids)], np.int64)
                # whole numbers not less than the radius about the centroid moved
                up = lambda x: math.isqrt(int(x)) + 1
                radii = [up(t[1]) + up(_squared(c[None], m[None])[0]) if t[0] else 0 for t, c, m in zip(total, centroids, moved)]
                balls, centroids = neighbours(moved, radii), moved
    return now, centroids, total


def op12_ball_kmeans(spark, sf_dir: str) -> DataFrame:
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found, centroids, total = cluster(rows)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    return found.select(
        F.col("key").alias("vec_id"), "cluster", "distance", of([t[2] for t in total], "long").alias("cluster_inertia"),
        F.lit(sum(t[2] for t in total)).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"),
    )


_ASSIGN = """
a{n} AS (SELECT vec_id, rid, v, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM (
    SELECT k.vec_id, k.rid, k.v, c.cid, list_sum(list_transform(list_zip(k.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k CROSS JOIN c{n} c
) GROUP BY vec_id, rid, v)"""
_UPDATE = """
c{m} AS (SELECT c.cid, coalesce(u.c, c.c) AS c FROM c{n} c LEFT JOIN (
    SELECT cid, list(m ORDER BY i) AS c FROM (
        SELECT cid, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
        FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY cid, i
    ) GROUP BY cid
) u USING (cid))"""

#: The same by comparing every vector with every centroid.
OP12_SQL = (
    """
WITH kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cid, v AS c FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT 16)),"""
    + ",".join(_ASSIGN.format(n=n).replace(" AS (", " AS MATERIALIZED (", 1) + "," + _UPDATE.format(n=n, m=n + 1).replace(" AS (", " AS MATERIALIZED (", 1) for n in range(ROUNDS))
    + ","
    + _ASSIGN.format(n=ROUNDS).replace(" AS (", " AS MATERIALIZED (", 1)
    + f"""
SELECT a.vec_id, a.cid::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cid))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(list_aggregate(list_transform(c.c, lambda x: x::VARCHAR), 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cid)
"""
)
