"""A persisted search index: built once, loaded by name, searched by reading the query's terms.

Layout of an index folder:

* ``units``: the units as they were given, tokens included (read only where units are filtered first);
* ``postings``: bucket, segment, term, the number n of units of the segment that have the term, and their numbers,
  tf and lengths as three arrays, sorted by term in each bucket's files.  A unit lies in one segment, a segment
  holds ``SEGMENT`` units or about ``STEP`` tokens at most, so no list is longer;
* ``terms``: bucket, term, df, raw (the idf before the floor of negative ones);
* ``facts``: one row, number of units, their mean length, number of buckets and terms, and that floor;
* ``vectors`` (if given): unit, vector.

A single question (``best``) brings the postings of its terms to the driver where they are few, and keeps them there for
the next ones.  A search for many reads the partitions of its terms' buckets, filters by term in the scan, and scores
segment by segment; each gives its k best of every query, so no (query, unit) pairs are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.config import Bm25Config
from qanat.memo import Memo
from qanat.operators.bm25 import blocks, ranked
from qanat.session import local, ship

SEGMENT = 1 << 14
#: Units that a segment holds at least, about, where there are fewer segments than cores.
LEAST = 1 << 10
#: Buckets of terms at most, and units for each of them in a small index: a question has terms in nearly all buckets, so
#: few files are read where few are enough, and pages of terms are skipped inside them.
BUCKETS, BUCKET_UNITS = 32, 1 << 14
#: Tokens of a segment at most (a longer unit is one of its own).
STEP = 1 << 21
#: Rows of postings that a task gives at once.
ROWS = 1 << 14
#: Sizes of row groups and pages: rows are sorted by what is looked up, and small pages let a scan skip all others.
UNIT_PAGES = {"parquet.block.size": str(8 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "64"}
TERM_PAGES = {"parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "256"}
#: Queries of one pass over the postings, and terms that are named in the scan's filter (more are joined).
BLOCK = 1024
NAMED = 256
#: Terms whose idf an open index remembers.
KNOWN = 1 << 20
#: Postings that one question brings to the driver at most, and bytes of postings that are remembered there.
READ, LISTS_BYTES = 1 << 21, 256 << 20


@dataclass(frozen=True)
class Index:
    units: DataFrame
    postings: DataFrame
    terms: DataFrame
    n_units: int
    mean: float
    vectors: DataFrame | None = None
    #: (idf, df) of terms that questions have asked for, at most ``KNOWN`` of them (None: the index lacks the term).
    known: dict[str, tuple[float, int] | None] = field(default_factory=dict, compare=False, repr=False)
    #: Postings that single questions have read lately.
    lists: Memo = field(default_factory=lambda: Memo(LISTS_BYTES), compare=False, repr=False)
    n_buckets: int = BUCKETS
    n_terms: int = 0

    def facts(self, words: list[str]) -> dict[str, tuple[float, int]]:
        """(idf, df) of the words that the index has; only those not asked for before are read."""
        new = sorted({w for w in words if w not in self.known})
        if new and 2 * self.n_terms <= KNOWN:  # a small vocabulary is read whole, once
            if not self.known:
                t = self.terms.select("term", "idf", "df").toArrow()
                self.known.update(zip(t["term"].to_pylist(), zip(t["idf"].to_pylist(), t["df"].to_pylist())))
        elif new:
            found = {r["term"]: (r["idf"], r["df"]) for r in _of(self, self.terms, new).select("term", "idf", "df").collect()}
            while self.known and len(self.known) + len(new) > KNOWN:
                del self.known[next(iter(self.known))]
            self.known.update({w: found.get(w) for w in new})
        return {w: self.known[w] for w in words if self.known.get(w) is not None}


def bucket(term, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


POSTINGS = "segment long, term string, n int, unit array<bigint>, tf array<int>, dl array<int>"


def _counted(table: pa.Table, segment: int):
    """The postings of a segment from its (part, unit, tokens), term by term."""
    lists, units = table.column(2).combine_chunks(), table.column(1).combine_chunks()
    size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    words, n = lists.flatten().dictionary_encode(), len(units)
    at = np.repeat(np.arange(n), size)
    key, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + at, return_counts=True)
    group, at = key // max(1, n), key % max(1, n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(group))
    columns = [units.take(pa.array(at)), pa.array(tf.astype(np.int32)), pa.array(size[at].astype(np.int32))]
    terms = words.dictionary.take(pa.array(group[first]))
    for a in range(0, len(first), ROWS):
        b = min(a + ROWS, len(first))
        low, high = int(first[a]), int(last[b - 1])
        offsets = pa.array(np.append(first[a:b], high).astype(np.int32) - np.int32(low))
        lists_of = [pa.ListArray.from_arrays(offsets, c.slice(low, high - low)) for c in columns]
        head = [pa.array(np.full(b - a, segment, np.int64)), terms.slice(a, b - a), pa.array((last[a:b] - first[a:b]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*head, *lists_of], ["segment", "term", "n", "unit", "tf", "dl"])


def _segments(size: int, most: int):
    """(part, unit, tokens) -> ``POSTINGS``: every ``size`` units of a task (or ``most`` tokens) in turn are a segment,
    so that the lists of a segment are whole where they are made and nothing is merged."""

    def task(batches):
        held, n, tokens, run = [], 0, 0, 0

        def done():
            nonlocal held, n, tokens, run
            table = pa.Table.from_batches(held)
            segment = (table.column(0)[0].as_py() << 32) | run
            held, n, tokens, run = [], 0, 0, run + 1
            return _counted(table, segment)

        for rb in batches:
            at = np.asarray(rb.column(2).offsets).astype(np.int64)
            a = 0
            while a < rb.num_rows:
                b = min(rb.num_rows, a + size - n, int(np.searchsorted(at, at[a] + most - tokens, side="right")) - 1)
                if b <= a and held:
                    yield from done()
                    continue
                b = max(b, a + 1)
                held.append(rb.slice(a, b - a))
                n, tokens, a = n + b - a, tokens + int(at[b] - at[a]), b
                if n >= size or tokens >= most:
                    yield from done()
        if held:
            yield from done()

    return task


def build(units: DataFrame, path: str, vectors: DataFrame | None = None, config: Bm25Config = Bm25Config(), ordered: bool = False) -> None:
    """Writes the index of units (unit, tokens, any other columns) to ``path``.  ``ordered``: their partitions are
    sorted ranges of units already."""
    spark = units.sparkSession
    ship(spark)
    # by unit, so that looking up a few of them reads the row groups that hold them
    rows = units if ordered else units.repartitionByRange("unit").sortWithinPartitions("unit")
    rows.write.mode("overwrite").options(**UNIT_PAGES).parquet(f"{path}/units")
    if vectors is not None:
        vectors.select("unit", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    u = spark.read.parquet(f"{path}/units").select(F.col("unit").cast("long").alias("unit"), tokens.alias("tokens"))
    facts = u.agg(F.count(F.lit(1)).alias("n_units"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("mean"))
    n, mean = facts.first()
    n_buckets = max(1, min(BUCKETS, n // BUCKET_UNITS))
    n_segments = max(1, -(-n // SEGMENT), min(spark.sparkContext.defaultParallelism, -(-n // LEAST)))
    part = F.spark_partition_id().cast("long").alias("part")
    lists = u.select(part, "unit", "tokens").mapInArrow(_segments(max(1, -(-n // n_segments)), STEP), POSTINGS)
    # no shuffle: the lists are whole, and each task writes its own segments by bucket
    lists = lists.withColumn("bucket", bucket("term", n_buckets)).sortWithinPartitions("bucket", "term")
    lists.write.mode("overwrite").options(**TERM_PAGES).partitionBy("bucket").parquet(f"{path}/postings")
    df = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum("n").cast("long").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    # the mean comes from the few distinct document frequencies
    hist = spark.read.schema("df long, raw double").parquet(f"{path}/terms").groupBy("df").agg(F.count(F.lit(1)).alias("c"), F.first("raw").alias("r"))
    total, n_terms = hist.agg(F.sum(F.col("c") * F.col("r")) / F.sum("c"), F.coalesce(F.sum("c"), F.lit(0))).first()
    floor = config.epsilon * (total or 0.0)
    local(spark, {"n_units": [n], "mean": [float(mean)], "n_buckets": [n_buckets], "n_terms": [n_terms], "floor": [float(floor)]}).write.mode("overwrite").parquet(f"{path}/facts")


def load(spark: SparkSession, path: str) -> Index:
    from pyspark.errors import AnalysisException

    # so many units or terms are looked up by the statistics of row groups
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    facts = read("facts").first()
    try:
        vectors = read("vectors")
    except AnalysisException:
        vectors = None
    idf = F.when(F.col("raw") < 0, F.lit(facts["floor"])).otherwise(F.col("raw")).alias("idf")
    return Index(read("units"), read("postings"), read("terms").select("bucket", "term", "df", idf), facts["n_units"], facts["mean"] or 1.0, vectors, n_buckets=facts["n_buckets"], n_terms=facts["n_terms"])


def serving(spark: SparkSession) -> SparkSession:
    """A session of the same application for single questions: their plans are small, so stages are not planned anew while
    they run, and few tasks are enough."""
    own = spark.newSession()
    cores = max(1, min(8, spark.sparkContext.defaultParallelism))
    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(cores), "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone")}.items():
        own.conf.set(k, v)
    return own


def _buckets(spark: SparkSession, words: list[str], n: int) -> list[int]:
    """The buckets of these terms; a local relation, which needs no job."""
    return sorted({r[0] for r in local(spark, {"term": words}).select(bucket("term", n)).collect()}) if words and n > 1 else [0]


def best(index: Index, tokens: list[str], k: int, config: Bm25Config = Bm25Config()) -> list[tuple[int, float]]:
    """(unit, score) of the k best units for one query's tokens: what ``search`` gives for it.

    Postings of its terms that are not in memory are read by one job of one stage and scored here, if their document
    frequencies say that they are at most ``READ``; else they are scored in the cluster."""
    facts = index.facts(tokens)
    if not facts:
        return []
    weight = {w: facts[w][0] * tokens.count(w) for w in sorted(facts)}
    held = index.lists.found(weight)
    missing = [w for w in weight if w not in held]
    if sum(facts[w][1] for w in weight) > READ:
        return _best_there(index, weight, k, config)
    if missing:
        got = _of(index, index.postings, missing).select("term", "unit", "tf", "dl").toArrow()  # at most ``READ`` postings
        lists = [got[c].combine_chunks() if got.num_rows else [] for c in ("unit", "tf", "dl")]
        parts: dict[str, list] = {}
        for i, w in enumerate(got["term"].to_pylist()):
            parts.setdefault(w, []).append([c[i].values.to_numpy(zero_copy_only=False) for c in lists])
        for w, several in parts.items():
            held[w] = tuple(np.concatenate([p[j] for p in several]) for j in range(3))
            index.lists.put(w, held[w], sum(a.nbytes for a in held[w]) + 200)
    unit, tf, dl = (np.concatenate([held[w][j] for w in weight]) for j in range(3))
    part = np.repeat([weight[w] for w in weight], [len(held[w][0]) for w in weight]) * tf * (config.k1 + 1)
    part /= tf + config.k1 * (1 - config.b + config.b * dl / index.mean)
    ids, at = np.unique(unit, return_inverse=True)
    score = np.round(np.bincount(at, part), config.digits) + 0.0
    first = np.lexsort((ids, -score))[:k]
    return list(zip(ids[first].tolist(), score[first].tolist()))


def _best_there(index: Index, weight: dict[str, float], k: int, config: Bm25Config) -> list[tuple[int, float]]:
    """The same as one native plan; the terms and their weights are a broadcast row each, so every question runs the same compiled code."""
    terms = local(index.postings.sparkSession, {"term": list(weight), "weight": list(weight.values())})
    rows = _of(index, index.postings, list(weight)).join(F.broadcast(terms), "term")
    part = f"weight * p.tf * {config.k1 + 1}D / (p.tf + {config.k1}D * ({1 - config.b}D + {config.b}D * p.dl / {index.mean}D))"
    scored = rows.selectExpr("weight", "explode(arrays_zip(unit, tf, dl)) AS p").groupBy(F.col("p.unit").alias("unit")).agg(F.expr(f"round(sum({part}), {config.digits})").alias("score"))
    top = scored.orderBy(F.col("score").desc(), "unit").limit(k)
    return [(r["unit"], r["score"]) for r in top.collect()]


def _quoted(word: str) -> str:
    """A SQL string literal: one text for the parser is much quicker than a call for each literal.  A dollar sign could
    start a variable of the parser's."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def _of(index: Index, table: DataFrame, words: list[str]) -> DataFrame:
    """The rows of these terms: pruned to their buckets, filtered in the scan or joined."""
    spark = table.sparkSession
    if not words:
        return table.where("false")
    if len(words) <= NAMED:
        return table.where(f"bucket in ({', '.join(map(str, _buckets(spark, words, index.n_buckets)))}) and term in ({', '.join(map(_quoted, words))})")
    names = spark.createDataFrame([(w,) for w in words], "term string")
    return table.join(F.broadcast(names.withColumn("bucket", bucket("term", index.n_buckets))), ["bucket", "term"])


def search(index: Index, queries: DataFrame, k: int, config: Bm25Config = Bm25Config(), block: int = BLOCK) -> DataFrame:
    """What ``bm25.search`` gives for (qid, tokens), read from the index."""
    out = None
    for asked in blocks(queries.select("qid", "tokens"), block):
        got = _scored(index, asked, k, config)
        out = got if out is None else out.unionByName(got)
    return ranked(out if out is not None else _scored(index, [], k, config), k)


def _scored(index: Index, asked: list, k: int, config: Bm25Config) -> DataFrame:
    words = sorted({w for _, t in asked for w in t or []})
    idf = {r["term"]: r["idf"] for r in _of(index, index.terms, words).select("term", "idf").collect()} if words else {}  # at most the block's terms
    place = {w: i for i, w in enumerate(sorted(idf))}
    counts = []
    for q, t in asked:
        c: dict[int, int] = {}
        for w in t or []:
            if w in place:
                c[place[w]] = c.get(place[w], 0) + 1
        counts.append((q, np.array(sorted(c), np.int64), np.array([c[i] for i in sorted(c)], float)))
    weight_of, mean = np.array([idf[w] for w in sorted(idf)]), index.mean

    def task(table):
        size = table["n"].to_numpy()
        unit, tf, dl = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("unit", "tf", "dl"))
        term = np.array([place[w] for w in table["term"].to_pylist()], np.int64)
        of = np.repeat(term, size)
        ids, at = np.unique(unit, return_inverse=True)
        norm = config.k1 * (1 - config.b + config.b * dl / mean)
        weight = weight_of[of] * tf * (config.k1 + 1) / (tf + norm)
        order = np.argsort(of, kind="stable")
        at, weight = at[order], weight[order]
        cut = np.searchsorted(of[order], np.arange(len(weight_of) + 1))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for q, words, n in counts:
            parts = [slice(cut[w], cut[w + 1]) for w in words.tolist()]
            where = np.concatenate([at[p] for p in parts]) if parts else np.zeros(0, np.int64)
            if not len(where):
                continue
            s = np.bincount(where, np.concatenate([weight[p] * c for p, c in zip(parts, n)]), len(ids))
            seen = np.flatnonzero(np.bincount(where, minlength=len(ids)))
            s = np.round(s[seen], config.digits) + 0.0
            if len(s) > k:  # whole ties at the edge stay
                top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                seen, s = seen[top], s[top]
            out.append((np.full(len(s), q), ids[seen], s))
        qid, unit, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"qid": pa.array(qid, pa.int64()), "unit": pa.array(unit, pa.int64()), "score": pa.array(score)})

    rows = _of(index, index.postings, sorted(idf)).select("segment", "term", "n", "unit", "tf", "dl")
    return rows.groupBy("segment").applyInArrow(task, "qid long, unit long, score double")
