"""Time joins, sessions, frames, lifetimes, cubes, dictionaries and the vector index against brute force."""

import datetime as dt
import math
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from qanat.operators import dense, dictionary, rollup, temporal, vector_index
from qanat.streaming import lifetimes

T0 = dt.datetime(2024, 1, 1)


def events(spark, n=300, seed=1, hot=0.4):
    """(id, k, t, v): one key has much of all rows; ties, null keys and null times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        t = None if rng.random() < 0.03 else T0 + dt.timedelta(minutes=rng.choice([rng.randint(0, 9000), rng.randint(0, 60)]))
        rows.append((i, k, t, rng.randint(0, 500)))
    return rows, spark.createDataFrame(rows, "id long, k string, t timestamp, v long")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seconds", [600, 86_400, 10**7])
def test_asof_join(spark, strict, seconds):
    left, l = events(spark, seed=1)
    right, r = events(spark, 120, seed=2)
    got = temporal.asof_join(l, r, ["k"], "t", "t", {"id": "rid", "v": "rv"}, seconds, strict)
    assert got.columns == ["id", "k", "t", "v", "rid", "rv"]
    want = []
    for i, k, t, v in left:
        best = max(((u, j, w) for j, q, u, w in right if k is not None and q == k and t is not None and u is not None and (u < t if strict else u <= t)), default=(None, None, None))
        want.append((i, best[1], best[2]))
    assert sorted((x["id"], x["rid"], x["rv"]) for x in got.collect()) == sorted(want)


def test_asof_deals_rows_once(spark):
    _, l = events(spark)
    _, r = events(spark, 100, seed=2)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = temporal.asof_join(l, r, ["k"], "t", "t", {"id": "rid"})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # by key and slice: the rows, and one row a key and slice (its partial sums, then back from the carry)
    assert len(re.findall(r"Exchange hashpartitioning\(__k0#\d+, __slice", plan)) == 3 and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("bin_seconds", [60, 3_600, 10**6])
def test_interval_join(spark, bin_seconds):
    pts, p = events(spark, 200, seed=3)
    rng = random.Random(4)
    spans = []
    for i in range(80):
        a = T0 + dt.timedelta(minutes=rng.randint(0, 9000))
        spans.append((i, rng.choice(["hot", "a", "b", None]), rng.choice([a, a, a, None]), a + dt.timedelta(minutes=rng.choice([0, -5, 1, 30, 900, 8000]))))
    s = spark.createDataFrame(spans, "sid long, k string, a timestamp, b timestamp")
    got = temporal.interval_join(p, s, ["k"], "t", "a", "b", bin_seconds)
    assert set(got.columns) == {"k", "id", "t", "v", "sid", "a", "b"}
    want = sorted((i, j) for i, k, t, _ in pts for j, q, a, b in spans if k is not None and k == q and t is not None and a is not None and a <= t < b)
    assert sorted((x["id"], x["sid"]) for x in got.collect()) == want and want
    assert temporal.interval_join(p, s.where("sid < 0"), ["k"], "t", "a", "b").count() == 0


@pytest.mark.parametrize("seconds", [900, 86_400])
def test_range_sums(spark, seconds):
    rows, e = events(spark, 200, seed=5)
    got = temporal.range_sums(e, ["k"], "t", 7_200, {"n": F.lit(1).cast("long"), "s": F.col("v").cast("decimal(18,2)")}, seconds)
    want = sorted(
        (i, sum(q == k and u is not None and t - dt.timedelta(hours=2) <= u <= t for _, q, u, _ in rows), Decimal(sum(w for _, q, u, w in rows if q == k and u is not None and t - dt.timedelta(hours=2) <= u <= t)))
        for i, k, t, v in rows if k is not None and t is not None
    )
    assert sorted((x["id"], x["n"], x["s"]) for x in got.collect()) == want


@pytest.mark.parametrize("tau", [3_600.0, 10**6])
def test_decayed_sums(spark, tau):
    rows, e = events(spark, 150, seed=6)
    got = {x["id"]: x["popularity"] for x in temporal.decayed_sums(e, ["k"], "t", F.col("v"), tau).collect()}
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    assert set(got) == {r[0] for r in known}
    for i, k, t, _ in known:
        want = sum(v * math.exp(-(t - u).total_seconds() / tau) for _, q, u, v in known if q == k and u <= t)
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-9)
    with pytest.raises(ValueError):
        temporal.decayed_sums(e, ["k"], "t", F.col("v"), 1.0)


def test_sessions_stream_equals_batch(spark, tmp_path):
    rows, e = events(spark, 160, seed=7)
    e = e.where("t is not null and k is not null")
    # arrival differs from time by at most two hours
    rng = random.Random(8)
    order = sorted((r for r in rows if r[1] and r[2]), key=lambda r: r[2] + dt.timedelta(minutes=rng.randint(0, 110)))
    src = str(tmp_path / "src")
    n = len(order)
    end = (10**6, "end", T0 + dt.timedelta(days=90), 0)
    late = (10**6 + 1, "hot", T0, 7)
    parts = [order[: n // 2], order[n // 2 :] + [end], [late, late]]
    names = ["id long, k string, t timestamp, v long"]

    def run():
        stream = temporal.sessions(spark.readStream.schema(e.schema).parquet(src), ["k"], "t", "30 minutes", "2 hours", "v")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return temporal.late_rows(q)

    dropped = 0
    for part in parts:  # each run goes on from the checkpoint of the one before
        spark.createDataFrame(part, names[0]).coalesce(1).write.mode("append").parquet(src)
        dropped += run()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = temporal.sessions(e, ["k"], "t", "30 minutes", value="v")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    # both copies of the late row are dropped: they are merged to one row before the watermark sees them
    assert key(got) == key(want) and dropped >= 1


def test_lifetimes_stream(spark, tmp_path):
    """Puts and probes out of order, over a restart, against every probe judged by itself."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        at = T0 + dt.timedelta(minutes=rng.randint(0, 3000))
        put = rng.random() < 0.2
        rows.append((rng.choice("abc"), at, None if put else i, rng.choice([600, 7200, 86_400]), f"p{i}" if put else None))
    schema = "key string, t timestamp, probe_id long, seconds long, payload string"
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randint(0, 50)))
    end = ("end", T0 + dt.timedelta(days=400), None, 1, "x")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part in (order[:70], [*order[70:], end]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        made = lifetimes.lifetimes(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(src), "t", "1 hour", 86_400)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    want = []
    for key, at, probe, seconds, _ in rows:
        if probe is not None:
            put = min(((u, p) for k, u, i, _, p in rows if k == key and i is None), default=None)
            hit = put is not None and 0 <= (at - put[0]).total_seconds() < seconds
            want.append((probe, hit, put[1] if hit else None))
    got = [(r["probe_id"], r["hit"], r["payload"]) for r in spark.read.parquet(out).collect()]
    ties = len({(k, u) for k, u, i, _, _ in rows if i is None}) == sum(i is None for _, _, i, _, _ in rows)
    assert ties and sorted(got, key=str) == sorted(want, key=str)


def test_cube_from_cells(spark):
    rng = random.Random(10)
    rows = [(i % 3, f"d{i % 4}", rng.randint(0, 900), round(rng.expovariate(0.05), 2)) for i in range(4000)] + [(0, None, None, None)]
    e = spark.createDataFrame(rows, "a long, d string, u long, v double")
    # cells of two halves, as of two days, are one table
    dims = {"a": F.col("a"), "d": F.col("d")}
    half = lambda odd: rollup.cells(e.where(F.coalesce(F.col("u"), F.lit(0)) % 2 == odd), dims, "u", "v")
    got = {(r["a"], r["d"], r["level"]): r for r in rollup.cube(half(0).unionByName(half(1)), ["a", "d"]).collect()}
    assert len(got) == (3 * 4 + 1) + 3 + 5 + 1
    for (a, d, level), r in got.items():
        mine = [x for x in rows if (level & 2 or x[0] == a) and (level & 1 or x[1] == d)]
        values = sorted(x[3] for x in mine if x[3] is not None)
        assert r["n"] == len(mine)
        if values:
            assert abs(float(r["total"]) - sum(values)) < 1e-6 and (r["low"], r["high"]) == (values[0], values[-1])
            keys = len({x[2] for x in mine})
            assert abs(r["n_keys"] - keys) <= max(2, 0.06 * keys)
            for name, q in (("p50", 0.5), ("p95", 0.95)):
                at = np.searchsorted(values, r[name]) / len(values)
                assert abs(at - q) < 0.03


@pytest.mark.parametrize("most", [1 << 20, 12])
@pytest.mark.parametrize("whole", [False, True])
def test_dictionary(spark, most, whole):
    names = ["he", "she", "his", "hers", "مباراة", "ana", "a.b", "hers", "", None]
    texts = ["ushers", "banana ana", None, "", "مباراةمباراة و مباراة", "xa.b a.b a.b.", "she_he he", "nothing"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = sorted(tuple(r) for r in dictionary.contained(t, "text", n, whole_words=whole, most=most).collect())
    want = []
    for i, text in enumerate(texts):
        for name in sorted({x for x in names if x}):
            hits = re.findall(f"(?=({re.escape(name)}))" if not whole else rf"(?<!\w)(?=({re.escape(name)})(?!\w))", text or "")
            if hits:
                want.append((i, name, len(hits)))
    assert got == sorted(want)
    assert dictionary.contained(t, "text", n.where("name = ''")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    heaps = rng.normal(size=(20, 16))
    x = heaps[rng.integers(0, 20, 1500)] + rng.normal(scale=0.25, size=(1500, 16))
    x[:500] = x[0]  # one common vector
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, None)], "unit long, vector array<double>")


def hits(df):
    return sorted((r["qid"], r["rank"], r["unit"], r["score"]) for r in df.collect())


def test_vector_index(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/v"
    vector_index.build(vectors, path)
    index = vector_index.load(spark, path)
    assert index.vectors.count() == index.n == 1500 and index.vectors.select("unit").distinct().count() == 1500
    q = vectors.where("unit % 50 = 7 or unit = 5000").withColumnRenamed("unit", "qid")
    want = hits(dense.search(vectors, q, 10))
    assert hits(vector_index.search(index, q, 10, exact=True)) == want
    assert hits(vector_index.search(index, q, 10, exact=True, probes=1, block=7)) == want
    assert hits(vector_index.search(index, q, 10, probes=len(index))) == want
    few = hits(vector_index.search(index, q, 10))
    found = len({x[:1] + x[2:3] for x in few} & {x[:1] + x[2:3] for x in want})
    assert index.probes < len(index) // 2 and found >= 0.9 * len(want)
    scan = vector_index.search(index, q.where("qid = 57"), 3, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", scan), scan


def test_vector_index_of_nothing(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/v"
    vector_index.build(vectors.where("unit = 5000"), path)
    index = vector_index.load(spark, path)
    assert vector_index.search(index, vectors.where("unit < 3").withColumnRenamed("unit", "qid"), 5, exact=True).count() == 0
    vector_index.build(vectors.where("unit in (3, 700)"), path)
    got = vector_index.search(vector_index.load(spark, path), vectors.where("unit = 700").withColumnRenamed("unit", "qid"), 5)
    assert [r["unit"] for r in got.orderBy("rank").collect()] == [700, 3][: got.count()]
