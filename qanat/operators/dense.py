"""Exact nearest vectors by inner product, for blocks of queries."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.operators.bm25 import blocks, ranked

#: Queries of one pass over the vectors: what is sent to tasks is bounded.
BLOCK, BLOCK_VALUES = 2048, 1 << 22


def search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(qid, unit, score, rank): the k vectors (unit, vector) of largest inner product
    with each query (qid, vector).  Each task keeps k a query and batch, so only
    those travel; ties go to the lesser unit.  Null vectors are left out."""
    out = None
    for q in chain(blocks(queries.where("vector is not null").select("qid", "vector"), block, BLOCK_VALUES), [[]]):
        if not q and out is not None:
            break
        ids = np.array([x for x, _ in q], np.int64)
        m = np.array([v for _, v in q], float).reshape(len(ids), -1)

        def task(batches, ids=ids, m=m):
            for rb in batches:
                if not rb.num_rows or not len(ids):
                    continue
                unit = rb.column(0).to_numpy(zero_copy_only=False)
                v = np.asarray(rb.column(1).flatten(), float).reshape(rb.num_rows, -1)
                s = np.round(m @ v.T, digits) + 0.0
                # whole ties at the edge stay: the final ranking decides among them
                edge = -np.partition(-s, min(k, rb.num_rows) - 1, axis=1)[:, min(k, rb.num_rows) - 1]
                i, j = np.nonzero(s >= edge[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(unit[j]), pa.array(s[i, j])], ["qid", "unit", "score"])

        got = vectors.where("vector is not null").select(F.col("unit").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(
            task, "qid long, unit long, score double"
        )
        out = got if out is None else out.unionByName(got)
    return ranked(out, k)


def encoder(embed: Callable[[list[str]], np.ndarray]) -> Callable:
    """A pandas UDF text -> unit vector around any batch encoder (queries take the prefix ``query: ``)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def encode(text: pd.Series) -> pd.Series:
        v = np.asarray(embed([x or "" for x in text]), float)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series((v / np.where(n > 0, n, 1)).tolist())

    return encode


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a sentence encoder: signed hashed words."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x10000 else -1
        return out

    return embed
