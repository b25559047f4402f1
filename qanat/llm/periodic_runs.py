"""Periodic runs of words, found by harmonic grid probing.

A run is a stretch of words with smallest period q and at least max(``LEAST``, ``TIMES`` * q)
words that no neighbour extends.  Where word i equals word i + p for all i of an interval, the words
have period p there.  A run of four periods holds three consecutive multiples of p in that
interval, wherever it starts, so for each p only the grid 0, p, 2p, ... is probed: N / p tests, N log N
for all p.  Survivors of three consecutive probes are compared over the next two periods in growing chunks, all at
once; those left are merged along the grid and extended at both ends.  Grid points inside a run already
found whose period divides p are skipped: they would find the same run again.

Many documents are probed together, a block of text as one array; words that are equal to no other
stand between them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm import common

LEAST = 6
TIMES = 4
#: Words whose text is gathered in one step.
GATHER = 1 << 17


def _holds(words: np.ndarray, at: np.ndarray, p: int, low: int, high: int, stop: bool = True) -> np.ndarray:
    """For each ``at``: how many of the offsets low, low + 1, ... below high follow one another with
    word equal to the word p later.  Chunks grow; a row leaves at its first difference.  A negative
    direction is walked by ``low`` > ``high``."""
    step = 1 if high >= low else -1
    n, last = abs(high - low), len(words) - 1
    length = np.zeros(len(at), np.int64)
    live, done, width = np.arange(len(at)), 0, 8
    while len(live) and done < n:
        width = max(1, min(width, n - done, (1 << 20) // len(live)))
        offsets = low + step * (done + np.arange(width))
        i = at[live][:, None] + offsets
        inside = (i >= 0) & (i + p <= last)
        i = np.where(inside, i, 0)
        same = inside & (words[i] == words[np.minimum(i + p, last)])
        all_same = same.all(1)
        length[live] += np.where(all_same, width, np.argmin(same, 1))
        live = live[all_same]
        done += width
        width = min(width * 4, 1 << 14)
    return length


def runs(words: np.ndarray, most: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs of an array of words, by period; ``most`` is the longest period looked for."""
    found = np.zeros((0, 3), np.int64)
    for p in range(1, most + 1):
        grid = words[::p]
        eq = grid[1:] == grid[:-1]
        at = np.flatnonzero(eq[:-2] & eq[1:-1] & eq[2:]) * p
        if len(at) and len(found):
            known = found[(p % found[:, 2] == 0) & (found[:, 1] > p)]
            if len(known):  # the intervals of one p are apart from each other
                known = known[np.argsort(known[:, 0])]
                k = np.searchsorted(known[:, 0], at, side="right") - 1
                at = at[(k < 0) | (at >= known[k, 0] + known[k, 1] - p)]
        if not len(at):
            continue
        at = at[_holds(words, at, p, 0, 2 * p + 1) == 2 * p + 1]
        if not len(at):
            continue
        head = np.append(True, np.diff(at) > p)
        tail = np.append(head[1:], True)
        first, last = at[head], at[tail] + 2 * p
        first = first - _holds(words, first, p, -1, -1 - p)
        last = last + _holds(words, last, p, 1, 1 + p)
        size = last - first + 1 + p
        long = size >= max(least, times * p)
        if long.any():
            found = np.concatenate([found, np.stack([first[long], size[long], np.full(long.sum(), p)], 1)])
    return found


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each word becomes in the documents whose text is made periodic; None where it stays.
    A null id counts as the empty text."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or n == 0:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def joined_sha256(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """SHA-256 of the words joined by one space; words are gathered in steps."""
    h = hashlib.sha256()
    for a in range(0, len(starts), GATHER):
        s, e = starts[a : a + GATHER], ends[a : a + GATHER]
        size = e - s + 1
        at = np.repeat(s - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        edge = np.cumsum(size) - 1
        at[edge] = 0
        text = data[at]
        text[edge] = 32
        h.update(text.tobytes() if a + GATHER < len(starts) else text[:-1].tobytes())
    return h.hexdigest()


def _documents(ids: list, data: np.ndarray, offs: np.ndarray, rewrite: bool):
    """Rows of the result for a block of documents."""
    starts, ends, first = common.spans(data, offs)
    size = np.diff(first)
    order = np.arange(len(starts))
    if rewrite:
        for d, (i, n) in enumerate(zip(ids, size.tolist())):
            moved = rewritten(i, n)
            if moved is not None:
                order[first[d] : first[d + 1]] = first[d] + moved
    starts, ends = starts[order], ends[order]
    # a word of its own before each document and at the end
    base = first[:-1] + np.arange(len(size)) + 1
    words = np.zeros(len(starts) + len(size) + 1, np.uint64)
    words[np.append(base - 1, len(words) - 1)] = np.arange(len(size) + 1)
    place = np.repeat(base - first[:-1], size) + np.arange(len(starts))
    # word hashes of 63 bits above the numbers of the separators
    words[place] = common.word_hashes(data, starts, ends) | np.uint64(1 << 63)
    found = runs(words, int(size.max(initial=0)) // TIMES)
    doc = np.searchsorted(base, found[:, 0], side="right") - 1
    begin = found[:, 0] - base[doc]
    by = np.lexsort((found[:, 2], begin, doc))
    found, doc, begin = found[by], doc[by], begin[by]
    edge = np.zeros(len(starts) + 1, np.int64)
    at = first[:-1][doc] + begin
    np.add.at(edge, at + found[:, 2], 1)
    np.add.at(edge, at + found[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    cut = np.searchsorted(doc, np.arange(len(size) + 1))
    for d in range(len(size)):
        mine = [(s, length, p) for s, (_, length, p) in zip(begin[cut[d] : cut[d + 1]].tolist(), found[cut[d] : cut[d + 1]].tolist())]
        best = None
        for r in mine:  # by start, then period: a later one must be greater
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        a, b = first[d], first[d + 1]
        k = kept[a:b]
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in mine)
        yield (len(mine), *(best or (None, None, None)), best and best[1] * 1000 // best[2], hashlib.sha256(listed.encode()).hexdigest(), joined_sha256(data, starts[a:b][k], ends[a:b][k])), mine


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect(docs: DataFrame, rewrite: bool = False, listed: bool = False) -> DataFrame:
    """Runs of every row: their number, the one of greatest exponent (ties: smallest start, then
    period; nulls where there is none), and digests of all runs and of the words left when repetitions go.

    ``rewrite`` first makes one in ten documents (by a checksum of the id) periodic.  ``listed`` adds all runs
    (start, length, period) as a list.  Null and empty texts have no words; a null id counts as the empty
    text; rows that repeat an id are handled one by one; texts of any length are read whole; an empty table
    gives no rows; other columns are ignored.  Words are compared by 63-bit hashes.
    """
    common.tune(docs.sparkSession)

    def task(batches):
        for rb, data, offs in common.blocks(batches):
            ids = rb.column(0).to_pylist()
            rows = list(_documents(ids, data, offs, rewrite))
            cols = list(zip(*[r for r, _ in rows]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            out = [rb.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            if listed:
                entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                out.append(pa.array([[dict(zip(("start", "length", "period"), r)) for r in mine] for _, mine in rows], pa.list_(entry)))
                names.append("runs")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = SCHEMA + (", runs array<struct<start:bigint,length:bigint,period:bigint>>" if listed else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, schema)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=True)
