"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A token is a run of ASCII letters, digits or bytes from 128 on, ASCII letters
lower-cased.  Features of a text are the distinct hashes of its tokens, its
pairs of neighbours and its pairs with one token between.  The learner sees a
bounded sample of labelled rows (``SAMPLE_ROWS``); scoring covers every whole
text.  L1 leaves a few hundred weights, sent to the tasks as one small table of
``2 ** BITS`` floats whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.llm import common
from qanat.llm.ftrl import Ftrl

BITS = 18
#: Labelled rows that the learner sees, about; more are thinned by a hash of the id.
SAMPLE_ROWS = 12_000
EPOCHS = 6
THRESHOLD = 0.7
LEARNER = {"alpha": 2.0, "beta": 1.0, "l1": 4.0, "l2": 0.001}

GAP = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    GAP[_a:_b] = False
LOWER = np.arange(256)
LOWER[65:91] += 32


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, feature) of every occurrence in the block."""
    starts, ends, first = common.spans(data, offs, GAP)
    h = common.word_hashes(data, starts, ends, LOWER)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    feats, docs = [h], [doc]
    with np.errstate(over="ignore"):
        for gap, seed in ((1, 3), (2, 5)):
            if len(h) > gap:
                same = doc[:-gap] == doc[gap:]
                feats.append(common.mix64(h[:-gap] * np.uint64(seed) + h[gap:], gap)[same])
                docs.append(doc[gap:][same])
    return np.concatenate(docs), (np.concatenate(feats) >> shift).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, rows: int) -> DataFrame:
    """A bounded sample (doc_id, text, y) of the rows that may be learned from.

    An id with several labels counts as toxic if any of them says so; null
    labels and ids are left out.  Of several documents of one id the least text is
    learned from.  The sample is thinned by a hash of the id, so it does not depend on
    partitions; its ids are few enough to broadcast.
    """
    y = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("y"))
    )
    n = y.count()
    if n > rows:
        y = y.where(F.pmod(F.xxhash64(F.lit("toxicity"), "__id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(y), F.col("doc_id") == F.col("__id"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, **learner):
    """Weights (2 ** BITS float32) and bias.  Without labelled rows all are 0 (score 0.5)."""
    common.tune(docs.sparkSession)

    def task(batches):
        for rb, data, offs in common.blocks(batches):
            doc, f = features(data, offs)
            both = np.unique((doc << BITS) | f)
            cut = np.searchsorted(both, np.arange(rb.num_rows + 1) << BITS)
            f32 = (both & ((1 << BITS) - 1)).astype("<i4")
            sets = pa.array([f32[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), sets], ["doc_id", "y", "f"])

    sample = labelled(docs, labels, learn, rows)
    sample = sample.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(task, "doc_id long, y int, f binary")
    got = sorted(((r.doc_id, r.y, bytes(r.f)) for r in sample.collect()))
    model = Ftrl(1 << BITS, 1, **(LEARNER | learner))
    if got:
        sets = [(np.frombuffer(f, "<i4"), float(y)) for _, y, f in got]
        model.fit([(f, np.ones(len(f)), np.array([y])) for f, y in sets], epochs)
    w, b = model.weights()
    return w[:, 0].astype(np.float32), float(b[0])


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row.

    Null and empty texts get the bias alone.  Rows that repeat an id, or have none, are
    scored one by one; texts of any length are read whole; a score equal to the
    threshold is predicted 1; an empty table gives no rows; other columns are ignored.
    """
    common.tune(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(weights), weights[weights != 0], bias))

    def task(batches):
        at, val, b = table.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = val
        live = w != 0
        for rb, data, offs in common.blocks(batches):
            doc, f = features(data, offs)
            hit = np.flatnonzero(live[f])
            both = np.unique((doc[hit] << BITS) | f[hit])
            s = np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)].astype(float), minlength=rb.num_rows) + b
            p = 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        task, "doc_id long, score double, predicted int"
    )


def op9_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = train(docs, labels, common.fold_of("doc_id", 3) != 1)
    out = score(docs, weights, bias)
    return out.select("doc_id", (common.fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
