"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments of ``SEGMENT`` folded
characters (letters and digits in lower case, all else one space).  A place in
a document that matches a segment of m characters with at most k edits shares
at least ``m - q + 1 - k q`` q-grams with it, all on diagonals at most k apart.
So a document's q-gram hits are counted in diagonal bands 2 k + 2 wide that
overlap by half, bands that reach the bound are retained, and each retained region is
verified by alignment in its band.  The segments on a grid of ``STRIDE`` are looked
for first.  Where none of them is found, the q-gram hits of whole items are counted
in the same bands over windows of ``SEGMENT`` characters from every start, and the
windows that reach the bound are aligned.  So a document is contaminated if any
``SEGMENT`` characters of an item (a short item whole) are found with at most
``ERROR`` edits a character.

Short items take a shorter q, so that the lemma holds for their full edit budget.
Items of fewer than ``Q`` folded characters have no budget: they are looked for as
they are, as whole words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm import common

Q = 10
SEGMENT = 120
STRIDE = 60
#: Text bytes whose q-grams are made at once; a task holds about 50 times as much meanwhile.
BLOCK_BYTES = 1 << 20
ERROR = 0.085
#: Folded benchmark characters that one pass over the documents looks for (about 50
#: bytes each in a task); a larger benchmark takes several passes, so what is sent to
#: tasks is bounded.
PASS_CHARS = 4 << 20
#: Pairs of a document's q-gram and an equal one of the benchmark that are held at once.
HITS = 1 << 21
BITS = 22

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    if not _fold:
        table = np.full(0x110000, 0x20, np.uint32)
        for i in range(0x30, 0x110000):
            c = chr(i)
            if c.isalnum():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _fold.append(table)
    return _fold[0]


def folded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a block and the documents' offsets in them."""
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    if (data < 128).all():
        codes, at = data, offs
    else:
        codes, at = common.code_points(data, offs)
    c = fold_table()[codes]
    keep = c != 0x20
    solid = keep.copy()
    keep[1:] |= solid[:-1]  # the first gap character after a solid one stays
    return c[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from every position on, put together from hashes of 1, 2, 4 ..."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        part, size, out, done = c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, None, 0
        while True:
            if q & size:
                out = part if out is None else part[: len(part) - done] * np.uint64(pow(base, done, 1 << 64)) + out[size:]
                done += size
            if done == q:
                break
            part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
        out = out[: len(c) - q + 1]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Index(NamedTuple):
    """Distinct segments that take one q, where their q-grams lie, and the items they are of."""

    q: int
    length: np.ndarray  # of every segment
    budget: np.ndarray  # edits allowed
    least: np.ndarray  # q-grams to share
    codes: list[np.ndarray]
    owned: np.ndarray  # range of every segment's owners
    item: np.ndarray  # owners: a distinct folded item
    start: np.ndarray  # owners: where the segment starts in it
    gram: np.ndarray  # sorted hashes
    gram_seg: np.ndarray
    gram_pos: np.ndarray  # in the segment
    seen: np.ndarray  # bitmap over the leading bits
    whole: list[np.ndarray]  # items longer than a segment
    whole_item: np.ndarray
    whole_gram: np.ndarray  # sorted hashes
    whole_of: np.ndarray
    whole_pos: np.ndarray  # in the item


class Benchmark(NamedTuple):
    """Indexes of the distinct folded items, one for each q, and the ids of each item."""

    parts: list[Index]
    ids: list[list]


def _sorted_grams(codes: list[np.ndarray], q: int):
    """Hashes of all q-grams in order, with the sequence and the place of each."""
    g = [grams(c, q) for c in codes]
    gram = np.concatenate(g) if g else np.zeros(0, np.uint64)
    size = np.array([len(x) for x in g], np.int64)
    order = np.argsort(gram, kind="stable")
    return gram[order], np.repeat(np.arange(len(g)), size)[order].astype(np.int32), common.repeats(size)[order].astype(np.int32)


def _index(q: int, found: dict[bytes, list[tuple[int, int]]], error: float, whole: list[tuple[int, np.ndarray]]) -> Index:
    codes = [np.frombuffer(x, np.uint32) for x in found]
    m = np.array([len(c) for c in codes], np.int64)
    k = (error * m).astype(np.int64)
    k[m < Q] = 0
    owners = list(found.values())
    gram, seg, pos = _sorted_grams(codes, q)
    seen = np.zeros(1 << BITS, bool)
    wide = _sorted_grams([c for _, c in whole], q)
    for x in (gram, wide[0]):
        seen[(x >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return Index(
        q, m, k, m - q + 1 - k * q, codes, np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64),
        *(np.array([x[i] for own in owners for x in own], np.int64) for i in (0, 1)), gram, seg, pos, seen,
        [c for _, c in whole], np.array([i for i, _ in whole], np.int64), *wide,
    )


def build(items: list[tuple[int | None, str]], segment: int = SEGMENT, stride: int = STRIDE, error: float = ERROR) -> Benchmark:
    """Items that are null or have no letter or digit cannot be looked for and are left out.
    Items that fold to the same text are one; so are equal segments of several items."""
    distinct: dict[bytes, list] = {}
    for key, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        c, _ = folded(data, np.array([0, len(data)]))
        if len(c) and c[-1] == 0x20:
            c = c[:-1]
        if len(c):
            distinct.setdefault(c.astype(np.uint32).tobytes(), []).append(key)
    groups: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    whole: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, raw in enumerate(distinct):
        c = np.frombuffer(raw, np.uint32)
        starts = list(range(0, max(len(c) - segment, 0) + 1, stride))
        if len(c) > segment and starts[-1] + segment < len(c):
            starts.append(len(c) - segment)
        m = min(len(c), segment)
        k = int(error * m) if m >= Q else 0
        q = min(Q, m // (k + 1))
        for s in starts:
            groups.setdefault(q, {}).setdefault(c[s : s + segment].tobytes(), []).append((i, s))
        if len(c) > segment:
            whole.setdefault(q, []).append((i, c))
    return Benchmark([_index(q, groups[q], error, whole.get(q, [])) for q in sorted(groups)], list(distinct.values()))


def align(index: Index, seg: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, diag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each segment against its document within the band of diagonals
    from ``diag - k`` to ``diag + 3 k + 1`` (ends in the document free), and where it ends.

    All regions advance row by row together; a row's insertions are a running minimum.
    """
    m, k = index.length[seg], index.budget[seg]
    width = int(4 * k.max() + 2)
    j = np.arange(width)
    base = diag - k
    inside = j < (4 * k + 2)[:, None]
    far = 1 << 20
    row = np.where(inside, 0, far)
    pattern = np.zeros((len(seg), int(m.max())), np.uint32)
    for i, s in enumerate(seg.tolist()):
        pattern[i, : m[i]] = index.codes[s]
    best, end = np.full(len(seg), far), np.zeros(len(seg), np.int64)
    top = max(len(c) - 1, 0)
    for i in range(int(m.max())):
        at = base[:, None] + i + j  # the document character on diagonal j for pattern character i
        ok = inside & (at >= low[:, None]) & (at < high[:, None])
        same = (c[np.clip(at, 0, top)] == pattern[:, i : i + 1]) & ok
        step = row + np.where(same, 0, np.where(ok, 1, far))
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        step = np.where(inside, step, far)
        step = np.minimum.accumulate(step - j, axis=1) + j
        last = np.flatnonzero(m == i + 1)
        row = step
        if len(last):
            at_best = step[last].argmin(1)
            best[last] = step[last, at_best]
            end[last] = base[last] + i + at_best + 1
    return best, end


def hits(keys: np.ndarray, owner: np.ndarray, n_owners: int, q: int, h: np.ndarray, hit: np.ndarray, at: np.ndarray):
    """Yields (document number, place, entry of ``keys``) of the q-grams at ``hit`` that lie whole
    in a document, at most about ``HITS`` at once, all of a document and owner together."""
    doc = np.searchsorted(at, hit, "right") - 1
    whole = hit + q <= at[doc + 1]
    hit, doc = hit[whole], doc[whole]
    lo = np.searchsorted(keys, h[hit], "left")
    n = np.searchsorted(keys, h[hit], "right") - lo
    hit, lo, n, doc = hit[n > 0], lo[n > 0], n[n > 0], doc[n > 0]
    total = np.concatenate([[0], np.cumsum(n)])
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)) if len(doc) else np.zeros(0, np.int64)
    a = 0
    while a < len(doc):
        fit = ends[(total[ends] <= total[a] + HITS) & (ends > a)]
        b = int(fit[-1]) if len(fit) else int(ends[ends > a][0])
        size = int(total[b] - total[a])
        rounds = -(-size // HITS)
        for r in range(rounds):  # one document with more: some owners at a time
            low, high = n_owners * r // rounds, n_owners * (r + 1) // rounds
            parts = []
            i = a
            while i < b:
                j = min(max(int(np.searchsorted(total, total[i] + HITS, "right")) - 1, i + 1), b)
                entry = np.repeat(lo[i:j], n[i:j]) + common.repeats(n[i:j])
                d, p = np.repeat(doc[i:j], n[i:j]), np.repeat(hit[i:j], n[i:j])
                if rounds > 1:
                    own = (owner[entry] >= low) & (owner[entry] < high)
                    d, p, entry = d[own], p[own], entry[own]
                parts.append((d, p, entry))
                i = j
            yield tuple(np.concatenate(x) for x in zip(*parts))
        a = b


def banded(doc: np.ndarray, seg: np.ndarray, j: np.ndarray, diag: np.ndarray, w: np.ndarray | int):
    """The hits in their two diagonal bands each, sorted, and where a (document, segment, band) or a place in it is new.

    Band b holds diagonals from b * w to b * w + 2 w - 1 (w = k + 1): each diagonal lies in two.
    """
    b = diag // w
    doc, seg, j, b = (np.concatenate([x, x]) for x in (doc, seg, j, b))
    b[len(b) // 2 :] -= 1
    order = np.lexsort((j, b, seg, doc))
    doc, seg, j, b = doc[order], seg[order], j[order], b[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1]) | (b[1:] != b[:-1])
    unique = fresh.copy()
    unique[1:] |= j[1:] != j[:-1]
    return doc, seg, j, b, fresh, unique


def aligned(index: Index, seg: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, diag: np.ndarray):
    """``align`` in steps of bounded size."""
    steps = [slice(a, a + 4096) for a in range(0, len(seg), 4096)]
    found = [align(index, seg[s], c, low[s], high[s], diag[s]) for s in steps]
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2


NONE = np.zeros(0, np.int64)


def _joined(found: list) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found)] if found else [NONE] * 5


def scan(bench: Benchmark, data: np.ndarray, offs: np.ndarray):
    """(document number, item, edits, end in the folded text) of the verified regions of a block."""
    c, at = folded(data, offs)
    out = [(NONE, NONE, NONE, NONE)]
    for index in bench.parts:
        h = grams(c, index.q)
        hit = np.flatnonzero(index.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        groups = hits(index.gram, index.gram_seg, len(index.codes), index.q, h, hit, at)
        doc, seg, edits, end, diag = _joined([segments(index, c, at, *g) for g in groups])
        n = np.diff(index.owned)[seg]
        own = np.repeat(index.owned[seg], n) + common.repeats(n)
        doc, edits, end, diag = (np.repeat(x, n) for x in (doc, edits, end, diag))
        item, start = index.item[own], index.start[own]
        out.append((doc, item, edits, end))
        if index.whole:
            known: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for d, i, s, x in zip(doc.tolist(), item.tolist(), start.tolist(), diag.tolist()):
                known.setdefault((d, i), []).append((s, x - s))
            groups = hits(index.whole_gram, index.whole_of, len(index.whole), index.q, h, hit, at)
            out += [windows(index, c, at, known, *g) for g in groups]
    return tuple(np.concatenate(x) for x in zip(*out))


def segments(index: Index, c: np.ndarray, at: np.ndarray, doc: np.ndarray, p: np.ndarray, entry: np.ndarray):
    """(document, segment, edits, end in it, least diagonal of the band) of the segments that are verified."""
    if not len(doc):
        return [NONE] * 5
    seg, j = index.gram_seg[entry].astype(np.int64), index.gram_pos[entry].astype(np.int64)
    doc, seg, j, b, fresh, unique = banded(doc, seg, j, p - j, index.budget[seg] + 1)
    first = np.flatnonzero(fresh)
    shared = np.add.reduceat(unique.astype(np.int64), first)
    first = first[shared >= index.least[seg[first]]]
    doc, seg, b = doc[first], seg[first], b[first]
    diag = b * (index.budget[seg] + 1)
    edits, end = aligned(index, seg, c, at[doc], at[doc + 1], diag)
    good = edits <= index.budget[seg]
    if index.q < Q and len(good):  # items shorter than Q are whole words
        left, right, gap = end - index.length[seg], end, np.append(c, 0x20) == 0x20
        words = (index.length[seg] >= Q) | (((left == at[doc]) | gap[left - 1]) & ((right == at[doc + 1]) | gap[right]))
        good &= words
    return doc[good], seg[good], edits[good], end[good] - at[doc[good]], diag[good]


def windows(index: Index, c: np.ndarray, at: np.ndarray, known: dict, doc: np.ndarray, p: np.ndarray, entry: np.ndarray):
    """What ``scan`` gives, for windows from every start of the long items, save where a
    verified segment lies over them (``known``: start and least diagonal of those of a
    document and item).

    A window that is found with k edits is found from a start ``k`` further with at
    most 2 k.  So every ``2 k + 1``-th window is aligned with that budget, and those
    near one that is found with their own.  The best window of a run is the region.
    """
    none = NONE, NONE, NONE, NONE
    if not len(doc):
        return none
    of, j = index.whole_of[entry].astype(np.int64), index.whole_pos[entry].astype(np.int64)
    some, q = int(index.length.argmax()), index.q  # the segments of long items are the longest
    m, k, least = (int(x[some]) for x in (index.length, index.budget, index.least))
    doc, of, j, b, fresh, unique = banded(doc, of, j, p - j, k + 1)
    group = (np.cumsum(fresh) - 1)[unique]
    doc, of, j, b = doc[unique], of[unique], j[unique], b[unique]
    i = np.arange(max(len(j) - least + 1, 0))
    last = i + least - 1
    i = i[(group[last] == group[i]) & (j[last] - j[i] <= m - q)]
    if not len(i):
        return none
    top = np.array([len(x) - m for x in index.whole])
    lo, hi = np.maximum(j[i + least - 1] - (m - q), 0), np.minimum(j[i], top[of[i]])
    # both bounds rise within a group: runs of starts that touch are one
    new = np.ones(len(i), bool)
    new[1:] = (group[i[1:]] != group[i[:-1]]) | (lo[1:] > hi[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = lo[first], hi[np.append(first[1:], len(i)) - 1]
    doc, of, diag = doc[i[first]], of[i[first]], b[i[first]] * (k + 1)

    item = index.whole_item[of]
    bare = [
        not any(abs(y - x) <= 4 * k + 2 and a - m < s < z + m for s, y in known.get((d, t), ()))
        for d, t, a, z, x in zip(doc.tolist(), item.tolist(), lo.tolist(), hi.tolist(), diag.tolist())
    ]
    doc, of, diag, lo, hi = (x[np.array(bare)] for x in (doc, of, diag, lo, hi))

    def tried(run, start, budget):
        parts = [index.whole[w][s : s + m] for w, s in zip(of[run].tolist(), start.tolist())]
        of_run = index._replace(codes=parts, length=np.full(len(run), m), budget=np.full(len(run), budget))
        return aligned(of_run, np.arange(len(run)), c, at[doc[run]], at[doc[run] + 1], diag[run] + start)

    n = (hi - lo) // (2 * k + 1) + 1
    run = np.repeat(np.arange(len(n)), n)
    start = np.minimum(lo[run] + common.repeats(n) * (2 * k + 1) + k, hi[run])
    near = tried(run, start, 2 * k)[0] <= 2 * k
    run, start = run[near], start[near]
    a, z = np.maximum(start - k, lo[run]), np.minimum(start + k, hi[run])
    run, start = np.repeat(run, z - a + 1), np.repeat(a, z - a + 1) + common.repeats(z - a + 1)
    run, start = np.unique(np.stack([run, start], 1), axis=0).T if len(run) else (run, start)
    edits, end = tried(run, start, k)
    order = np.lexsort((end, edits, run))
    order = order[edits[order] <= k]
    order = order[np.unique(run[order], return_index=True)[1]]
    run = run[order]
    return doc[run], index.whole_item[of[run]], edits[order], end[order] - at[doc[run]]


PAIRS = "doc_id long, item_id long, n_regions int, edits int, doc_end long"


def passes(items: DataFrame, limit: int = PASS_CHARS):
    """The benchmark in runs of items of at most ``limit`` characters together (a longer
    item is a run of its own), streamed to the driver one run at a time."""
    run, size = [], 0
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().sort("item_id", "text")
    for r in rows.toLocalIterator():
        if run and size + len(r[1]) > limit:
            yield run
            run, size = [], 0
        run.append((r[0], r[1]))
        size += len(r[1])
    if run:
        yield run


def matches(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Contaminated (doc_id, item_id) pairs with the number of verified regions, the
    least edits and where in the folded document the first of those ends.

    Null and empty texts match nothing; a document of any length is searched whole; an
    empty benchmark or table gives no rows.  Rows that repeat a pair are merged, those
    without id too (as one document); an item without id is looked for like any other.
    Items of equal text are found together, one row each.  Of equally good regions the
    first counts.  Other columns are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for run in passes(items):
        shared = spark.sparkContext.broadcast(build(run, **options))

        def task(batches, shared=shared):
            bench = shared.value
            for rb, data, offs in common.blocks(batches, limit=BLOCK_BYTES):
                doc, item, edits, end = scan(bench, data, offs)
                ids = [bench.ids[i] for i in item.tolist()]
                n = np.array([len(x) for x in ids], np.int64)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [rb.column(0).take(pa.array(np.repeat(doc, n))), pa.array([x for own in ids for x in own], pa.int64()), pa.array(np.repeat(edits, n)), pa.array(np.repeat(end, n))],
                        ["doc_id", "item_id", "edits", "doc_end"],
                    )

        got = d.mapInArrow(task, "doc_id long, item_id long, edits long, doc_end long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], PAIRS)
    best = F.min(F.struct("edits", "doc_end"))
    return out.groupBy("doc_id", "item_id").agg(
        F.count_distinct("doc_end").cast("int").alias("n_regions"), best["edits"].cast("int").alias("edits"), best["doc_end"].alias("doc_end")
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows, all columns unchanged, in which no benchmark item is found (as in
    ``matches``, items without id included).  Null and empty texts, rows without id and
    repeated rows stay or go by their text alone."""
    spark = docs.sparkSession
    common.tune(spark)
    out = docs
    for run in passes(items):
        shared = spark.sparkContext.broadcast(build(run, **options))

        def task(batches, shared=shared):
            bench = shared.value
            for rb, data, offs in common.blocks(batches, limit=BLOCK_BYTES):
                good = np.ones(rb.num_rows, bool)
                good[scan(bench, data, offs)[0]] = False
                yield rb.filter(pa.array(good))

        out = out.mapInArrow(task, docs.schema)
    return out


def op6_qgram_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return matches(docs, items)
