"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a set of five-word shingles weighted by how often they occur.
Every shingle is a Poisson process of rate weight: its arrivals fall on
signature slots at random, and a slot keeps the shingle of its first arrival.
A shingle stops arriving once its clock passes the last slot to be filled.
Two slots agree with the probability Jaccard similarity of the weighted sets.
Slots are cut into bands; documents that share a band are candidates, and the
similarity of a candidate pair is then computed exactly.

No bucket is expanded into rows of pairs beyond a small size.  Equal texts are one
node.  In a bucket of at most ``SMALL`` nodes all pairs are candidates.  In a larger
one every node is first compared with the bucket's most central node (the one that
shares most buckets with others).  What then is not of one class is dealt into groups
of about ``CELL`` nodes, and a task holds two groups at a time and compares all their
pairs that are not of one class yet, through the shingles they share.  So every pair
of a bucket has been compared or is of one class already, and a task gives at most as
many links as it has nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm import common
from qanat.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
#: Text bytes whose shingles are made at once; a task holds about 50 times as much meanwhile.
BLOCK_BYTES = 1 << 20
#: Buckets up to this size have all their pairs compared.
SMALL = 16
#: Nodes of a large bucket that make a group, and bytes of their shingles; a task compares two groups.
CELL = 512
CELL_BYTES = 24 << 20
_LOW = (1 << 44) - 1


def shingles(data: np.ndarray, offs: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle, weight) of a block, sorted, distinct in a document.

    A document of fewer than ``n`` words has one shingle of all its words; one
    without words has none.  A shingle is a 44-bit hash.
    """
    starts, ends, first = common.spans(data, offs)
    words = common.word_hashes(data, starts, ends)
    size = np.diff(first)
    h = common.gram_hashes(words, n)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - n + 1, 0))
    at = np.repeat(first[:-1], np.maximum(size - n + 1, 0)) + common.repeats(np.maximum(size - n + 1, 0))
    h = h[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, common.run_hashes(words, first[short], first[short + 1])])
    both = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(both)))
    both = both[at]
    return (both >> np.uint64(44)).astype(np.int64), both & np.uint64(_LOW), weight


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signatures [n_docs x slots]; rows of documents without items are 0."""
    first = np.full(n_docs * slots, np.inf)
    sig = np.zeros(n_docs * slots, np.uint64)
    clock, rate = np.zeros(len(item)), 1.0 / weight
    turn = 0
    while len(item):
        draw = common.mix64(item, 2 * turn + 1)
        clock = clock - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) * rate
        cell = doc * slots + (common.mix64(item, 2 * turn + 2) % np.uint64(slots)).astype(np.int64)
        early = np.flatnonzero(clock < first[cell])
        np.minimum.at(first, cell[early], clock[early])
        won = early[clock[early] == first[cell[early]]]
        sig[cell[won]] = item[won]
        if turn % 4 == 0 or len(item) > 4096:
            new = np.ones(len(doc), bool)
            new[1:] = doc[1:] != doc[:-1]
            rank = np.cumsum(new) - 1
            live = doc[new]
            last = first.reshape(n_docs, slots)[live].max(1)
            on = np.flatnonzero(clock < last[rank])
            doc, item, clock, rate = doc[on], item[on], clock[on], rate[on]
        turn += 1
    return sig.reshape(n_docs, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sig), b + 1, np.uint64)
            for r in range(rows):
                h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r], b)
            out[:, b] = h
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets (sorted distinct items, weights).

    Sum over shared d of 1 / sum over e of max(x_e / x_d, y_e / y_d).  With items
    sorted by x / y, the inner sum is x's tail over x_d plus y's head over y_d.
    """
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    xs, ys = x[i].astype(float), y[j].astype(float)
    if (x == 1).all() and (y == 1).all():
        return len(both) / (len(a) + len(b) - len(both))
    order = np.argsort(xs / ys, kind="stable")
    xs, ys = xs[order], ys[order]
    x_tail = x.sum() - np.cumsum(xs)  # items whose ratio is larger (those only in a included)
    y_head = y.sum() - ys.sum() + np.cumsum(ys)
    return float((1.0 / (x_tail / xs + y_head / ys)).sum())


def described(docs: DataFrame) -> DataFrame:
    """doc_id, key (MD5 of the text), bands of every row with an id."""

    def task(batches):
        for rb, data, offs in common.blocks(batches, limit=BLOCK_BYTES):
            doc, item, weight = shingles(data, offs)
            keys = band_keys(signatures(doc, item, weight, rb.num_rows))
            has = np.bincount(doc, minlength=rb.num_rows) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(keys[has].ravel()))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), bands], ["doc_id", "key", "bands"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    return d.mapInArrow(task, "doc_id long, key binary, bands array<long>")


def weighted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, bag, bytes) of the documents in ``ids``: their weighted shingles, packed."""

    def task(batches):
        for rb, data, offs in common.blocks(batches, limit=BLOCK_BYTES):
            doc, item, weight = shingles(data, offs)
            cut = np.searchsorted(doc, np.arange(rb.num_rows + 1))
            bags = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                flat = weight[a:b].max(initial=0) <= 1
                bags.append(np.int64(b - a).tobytes() + item[a:b].tobytes() + (b"" if flat else weight[a:b].astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(bags, pa.binary()), pa.array([len(x) for x in bags], pa.int64())], ["id", "bag", "bytes"])

    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    return d.join(ids.hint("shuffle_hash"), "id", "left_semi").mapInArrow(task, "id long, bag binary, bytes long")


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    item = np.frombuffer(raw, np.uint64, n, 8)
    return item, np.frombuffer(raw, "<i4", n, 8 + 8 * n) if len(raw) > 8 + 8 * n else np.ones(n, np.int64)


def verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least ``least``."""

    def task(batches):
        for rb in batches:
            a, b, x, y = (rb.column(i).to_pylist() for i in range(4))
            sim = np.array([probability_jaccard(*_unpack(p), *_unpack(q)) for p, q in zip(x, y)])
            ok = pa.array(sim >= least)
            yield pa.RecordBatch.from_arrays([rb.column(0).filter(ok), rb.column(1).filter(ok), pa.array(sim).filter(ok)], ["a", "b", "similarity"])

    left = bags.select(F.col("id").alias("a"), F.col("bag").alias("x"))
    right = bags.select(F.col("id").alias("b"), F.col("bag").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(task, "a long, b long, similarity double")


def _heads(rows: DataFrame) -> DataFrame:
    """(band, head): the most central node of every bucket, the lesser id of equals."""
    best = F.max(F.struct("weight", (-F.col("id")).alias("minus")))
    return common.staged(rows.groupBy("band").agg(best.alias("best")).select("band", (-F.col("best.minus")).alias("head")), "heads")


def _star(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs (a < b) of every node with its bucket's head."""
    got = rows.join(heads, "band").where("id <> head")
    return got.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))


def _cells(rows: DataFrame) -> DataFrame:
    """(band, i, j, id, part, comp): the nodes (band, id, bytes, comp) of every bucket in groups
    ``part``, once for each group (i <= j) that they meet.  Buckets of one class are left out."""
    size = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    groups = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("bytes") / CELL_BYTES))
    size = size.where("lo < hi").select("band", groups.cast("int").alias("g"))
    part = F.pmod(F.xxhash64(F.lit("cell"), "id"), F.col("g")).cast("int")
    met = rows.select("band", "id", "comp").join(size, "band").withColumn("part", part)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return met.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "part", "comp")


def cell_links(left: list[int], right: list[int], label: np.ndarray, bags: list[bytes], least: float) -> list[tuple[int, int]]:
    """Positions (a, b) of enough links to join all nodes of ``left`` and ``right`` that
    similar pairs (one of each side) join.  Pairs of one ``label`` are of one class."""
    label = label.copy()
    some = [_unpack(x) for x in bags]
    total = np.array([w.sum() for _, w in some])
    flat = np.array([bool((w == 1).all()) for _, w in some])
    right_at = np.array(right)
    size = np.array([len(some[b][0]) for b in right])
    item = np.concatenate([some[b][0] for b in right])
    order = np.argsort(item, kind="stable")
    keys, first = np.unique(item[order], return_index=True)
    first = np.append(first, len(item))
    owner = np.repeat(np.arange(len(right)), size)[order]
    mass = np.concatenate([some[b][1] for b in right])[order]
    out = []
    for a in left:
        if (label[right_at] == label[a]).all():
            continue
        mine, x = some[a]
        at = np.searchsorted(keys, mine)
        at[at == len(keys)] = 0
        same = keys[at] == mine
        n = (first[at + 1] - first[at])[same]
        met = np.repeat(first[at[same]], n) + common.repeats(n)
        who = owner[met]
        if flat[a] and flat[right_at].all():
            shared = np.bincount(who, minlength=len(right))
            good = shared / (len(mine) + size - shared) >= least
        else:  # the shared mass of either side bounds the similarity
            ours = np.bincount(who, np.repeat(x[same], n), len(right))
            theirs = np.bincount(who, mass[met], len(right))
            good = np.minimum(ours / total[a], theirs / total[right_at]) >= least - 1e-9
        for k in np.flatnonzero(good & (label[right_at] != label[a])).tolist():
            b = right[k]
            if label[a] != label[b] and probability_jaccard(mine, x, *some[b]) >= least:
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out


def compared(cells: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of the nodes that meet in a cell."""

    def task(table):
        table = table.sort_by("id")
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        part, ids = table["part"].to_numpy(), table["id"].to_numpy()
        left, right = np.flatnonzero(part == i).tolist(), np.flatnonzero(part == j).tolist()
        got = cell_links(left, right, table["comp"].to_numpy(), table["bag"].to_pylist(), least) if left and right else []
        a, b = (np.array([x[k] for x in got], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(ids[a], ids[b])), "b": pa.array(np.maximum(ids[a], ids[b]))})

    return cells.join(bags.select("id", "bag"), "id").groupBy("band", "i", "j").applyInArrow(task, "a long, b long").distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row: equal and near-equal texts share a class,
    whose id is its least doc_id.

    Null text is empty; texts without words are near nothing but equal texts.
    Texts of any length are taken whole.  Rows that repeat an id count as one
    document (their texts are of one class).  A row without id gets a null class.
    Ties do not matter: a class is a connected set and its least id names it.  Other
    columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.tune(spark)
    seen = common.staged(described(docs), "signatures")
    reps = common.staged(seen.groupBy("key").agg(F.min("doc_id").alias("rep")), "texts")
    doc_rep = common.staged(seen.select("doc_id", "key").join(reps, "key").groupBy("doc_id").agg(F.min("rep").alias("rep")), "representatives")

    nodes = doc_rep.select("rep").distinct()
    buckets = seen.join(nodes, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    full = common.staged(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "full")
    shared = common.staged(buckets.join(full, "band"), "buckets")
    central = common.staged(shared.groupBy("id").agg(F.sum("n").alias("weight")), "central")
    shared = common.staged(shared.join(central, "id"), "buckets")
    bags = common.staged(weighted(docs, central.select("id")), "bags")
    common.release(spark)

    few = shared.where(F.col("n") <= SMALL).select("band", "id")
    pairs = few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), "band").where("a < b").select("a", "b")
    large = shared.where(F.col("n") > SMALL)
    heads = _heads(large)
    tried = common.staged(pairs.unionByName(_star(large, heads)).distinct(), "tried")
    links = common.staged(verified(tried, bags, least).select("a", "b"), "links")
    comp = components(links)
    if heads.limit(1).count():
        rest = large.join(comp, "id", "left").join(bags.select("id", "bytes"), "id").select("band", "id", "bytes", F.coalesce("comp", "id").alias("comp"))
        more = common.staged(compared(_cells(common.staged(rest, "rest")), bags, least), "links")
        if more.limit(1).count():
            comp = components(links.unionByName(more))

    known = doc_rep.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("class_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(known, "doc_id", "left")


def survivors(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of every class, all columns unchanged: the document whose id names the
    class.  Of rows that repeat this id the one of least text stays, then of least JSON
    form.  Rows without id stay.  Columns of any name pass through."""
    d, name = common.masked(docs)
    key = F.col(name["doc_id"]).cast("long")
    found = classes(docs.select("doc_id", "text"), least)
    ids = found.where("doc_id = class_id").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    ids = common.staged(ids, "survivors")
    once, often = (ids.where(x).select("id").hint("shuffle_hash") for x in ("n = 1", "n > 1"))
    out = d.join(once, key == F.col("id"), "left_semi")
    if ids.where("n > 1").limit(1).count():
        order = F.struct(F.col(name["text"]).cast("string"), F.to_json(F.struct(*d.columns)))
        one = d.join(often, key == F.col("id"), "left_semi").groupBy(key.alias("id")).agg(F.min_by(F.struct(*d.columns), order).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out.unionByName(d.where(F.col(name["doc_id"]).isNull())).toDF(*docs.columns)


def op4_probminhash_near_dup(spark, sf_dir: str) -> DataFrame:
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
