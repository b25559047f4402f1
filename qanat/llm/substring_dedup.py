"""Substring deduplication with one FM-index a shard.

A window is ``WINDOW`` consecutive words of a document; a word goes if a window
that covers it also starts in a document with a lesser id.

Every window has an anchor: its four-word gram of least hash, the leftmost of
equals.  Equal windows have equal anchors, so passages are routed to shards by
anchor and no window is compared across shards.  Only anchors that occur in
more than one text are routed.  The windows of a document that share an anchor
form a passage; equal passages are merged first, keeping the least id.  Windows
of an anchor that is very frequent have a longer anchor (ten words) instead, and
those of a long anchor with more than ``ROUTE_BYTES`` of passages are routed window
by window, where equal ones merge into one.  So no anchor is more than a small part of
a shard, and there are as many shards as passages of ``SHARD_BYTES`` need.  Each
shard builds an FM-index over its passages and streams them through it:
backward search gives the matching statistics, the intervals at the threshold of a
window are reported, and the least document of an interval decides.  Texts equal to
one with a lesser id are not searched: each of their windows is in that one.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm import common
from qanat.llm.fm_index import FmIndex

WINDOW = 13
GRAM = 4
#: Windows whose anchor occurs more often have a longer anchor instead, of ``LONG`` words.
HOT = 2048
LONG = 10
#: Passages of a long anchor that make it be split into its windows, in bytes (8 a word).
ROUTE_BYTES = 4 << 20
#: Passages of a shard before equal ones are merged, about.
SHARD_BYTES = 96 << 20
#: Windows of one step of a search.
STEP = 1 << 19
#: Bits of a position in a block of words.
_POS = 26


def least_gram(words: np.ndarray, at: np.ndarray, gram: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of the gram of least hash, the leftmost of equals, in the windows that start at
    ``at``.  Positions fill the low bits of a hash, so more words than those count go in pieces."""
    most = (1 << _POS) - window
    if len(words) > most + window:
        pos, h = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
        for a in range(0, len(words), most):
            mine = np.flatnonzero((at >= a) & (at < a + most))
            if len(mine):
                p, h[mine] = least_gram(words[a : a + most + window], at[mine] - a, gram, window)
                pos[mine] = p + a
        return pos, h
    v = common.mix64(common.gram_hashes(words, gram), 70 + gram)
    low = ((v >> np.uint64(_POS)) << np.uint64(_POS)) | np.arange(len(v), dtype=np.uint64)
    span, width = window - gram + 1, 1
    while width < span:
        k = min(width, span - width)
        low = np.minimum(low[:-k], low[k:])
        width += k
    pos = (low[at] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    return pos, v[pos]


def anchored(data: np.ndarray, offs: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Words (hashes), document ranges, and for every window its start, document, anchor position and hash."""
    starts, ends, first = common.spans(data, offs)
    words = common.word_hashes(data, starts, ends)
    size = np.diff(first)
    n_win = np.maximum(size - window + 1, 0)
    at = np.repeat(first[:-1], n_win) + common.repeats(n_win)
    doc = np.repeat(np.arange(len(size)), n_win)
    if not len(at):
        z = np.zeros(0, np.int64)
        return words, first, z, z, z, np.zeros(0, np.uint64)
    return words, first, at, doc, *least_gram(words, at, gram, window)


def names(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every run of words: the name of a passage."""
    return common.run_hashes(words, a, b).view(np.int64), common.run_hashes(common.mix64(words, 9), a, b).view(np.int64)


def runs(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Starts of the runs of windows with one anchor, in one document."""
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(new)


def anchors(docs: DataFrame) -> DataFrame:
    """(anchor, text) of every run of windows; ``text`` names the text."""

    def task(batches):
        for rb, data, offs in common.blocks(batches):
            _, _, _, doc, pos, v = anchored(data, offs)
            r = runs(doc, pos)
            yield pa.RecordBatch.from_arrays([pa.array(v[r].view(np.int64)), rb.column(0).take(pa.array(doc[r]))], ["anchor", "name"])

    return docs.select("name", "text").mapInArrow(task, "anchor long, name long")


def passages(docs: DataFrame) -> DataFrame:
    """(route, long, words, h1, h2, doc_id, start) of the passages around the listed anchors of
    every document; ``long`` marks those of long anchors."""

    def task(batches):
        for rb, data, offs in common.blocks(batches):
            words, first, at, doc, pos, v = anchored(data, offs)
            lists = rb.column(2)
            flat = lists.flatten()
            if not len(at) or not len(flat):
                continue
            own = np.repeat(np.arange(rb.num_rows), np.diff(np.asarray(lists.offsets)))
            code = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64)
            hot = flat.field(1).to_numpy(zero_copy_only=False).astype(bool)
            # windows whose anchor is listed for their document
            mixed = common.mix64(code ^ common.mix64(own.astype(np.uint64), 5), 6)
            back = np.argsort(mixed)
            r = runs(doc, pos)
            want = common.mix64(v[r] ^ common.mix64(doc[r].astype(np.uint64), 5), 6)
            f = back[np.minimum(np.searchsorted(mixed, want, sorter=back), len(mixed) - 1)]
            hit = mixed[f] == want
            n = np.diff(np.append(r, len(at)))
            listed, is_hot = np.repeat(hit, n), np.repeat(hit & hot[f], n)
            if is_hot.any():
                again = np.flatnonzero(is_hot)
                long_pos, long_v = least_gram(words, at[again], LONG)
                pos[again], v[again] = -1 - long_pos, long_v
            use = np.flatnonzero(listed)
            at, doc, pos, v = at[use], doc[use], pos[use], v[use]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)
            r = np.flatnonzero(new)
            a, b, d = at[r], at[np.append(r[1:], len(at)) - 1] + WINDOW, doc[r]
            h1, h2 = names(words, a, b)
            raw = words.tobytes()
            body = pa.array([raw[8 * x : 8 * y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[r].view(np.int64)), pa.array(pos[r] < 0), body, pa.array(h1), pa.array(h2), rb.column(0).take(pa.array(d)), pa.array(a - first[d])],
                ["route", "long", "words", "h1", "h2", "doc_id", "start"],
            )

    return docs.select("doc_id", "text", "anchors").mapInArrow(task, PASSAGES)


PASSAGES = "route long, long boolean, words binary, h1 long, h2 long, doc_id long, start long"


def single_windows(parts: DataFrame) -> DataFrame:
    """Every window of the passages as a passage of its own, routed by all its words."""

    def task(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            raw, offs = common.utf8(rb.column(0))
            words, cut = np.frombuffer(raw.tobytes(), np.uint64), offs // 8
            n = np.diff(cut) - WINDOW + 1
            row = np.repeat(np.arange(rb.num_rows), n)
            inside = common.repeats(n)
            a = cut[row] + inside
            h1, h2 = names(words, a, a + WINDOW)
            data = words.tobytes()
            body = pa.array([data[8 * x : 8 * (x + WINDOW)] for x in a.tolist()], pa.binary())
            doc, start = (rb.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(np.ones(len(a), bool)), body, pa.array(h1), pa.array(h2), pa.array(doc[row]), pa.array(start[row] + inside)],
                ["route", "long", "words", "h1", "h2", "doc_id", "start"],
            )

    return parts.select("words", "doc_id", "start").mapInArrow(task, PASSAGES)


def routed(parts: DataFrame, limit: int = ROUTE_BYTES) -> DataFrame:
    """``parts`` with the passages of overlarge long anchors split into windows."""
    size = parts.where("long").groupBy("route").agg(F.sum(F.octet_length("words")).alias("n"))
    heavy = common.staged(size.where(F.col("n") > limit).select("route"), "heavy")
    if not heavy.limit(1).count():
        return parts
    is_heavy = parts.where("long").join(heavy, "route", "left_semi")
    return parts.where("not long").unionByName(parts.where("long").join(heavy, "route", "left_anti")).unionByName(single_windows(is_heavy))


def search(words: np.ndarray, size: np.ndarray, doc: np.ndarray, window: int = WINDOW):
    """Least document id of every window of every passage of a shard, where the window occurs
    more than once; else the passage's own.  Passages lie one after the other in ``words``."""
    _, code = np.unique(words, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(at[-1], np.int64)
    text[np.repeat(at[:-1], size) + common.repeats(size)] = code + 1
    ids, rank = np.unique(doc, return_inverse=True)
    index = FmIndex(text, int(code.max()) + 2, np.repeat(rank, size + 1))
    n_win = size - window + 1
    ends = np.repeat(at[:-1], n_win) + common.repeats(n_win) + window
    least = np.repeat(doc, n_win)
    for i in range(0, len(ends), STEP):
        found, lo, hi = index.matching(text, ends[i : i + STEP], window)
        hit = np.flatnonzero(found == window)
        if len(hit):
            least[i + hit] = ids[index.least_owner(lo[hit], hi[hit])]
    return least, np.concatenate([[0], np.cumsum(n_win)])


def searched(distinct: DataFrame, shards: int) -> DataFrame:
    """(h1, h2, least) of the passages that several documents have or with a window found
    elsewhere; one shard a task.  A shard holds about ``SHARD_BYTES`` at most, of anchors that
    are each a small part of it."""

    def task(batches):
        raw, size, docs, many = [], [], [], []
        for rb in batches:
            data, offs = common.utf8(rb.column(1))
            raw.append(np.frombuffer(data.tobytes(), np.uint64))
            size.append(np.diff(offs) // 8)
            docs.append(rb.column(2).to_numpy(zero_copy_only=False))
            many.append(rb.column(3).to_numpy(zero_copy_only=False))
        if not raw or not sum(map(len, size)):
            return
        words, size, docs, many = (np.concatenate(x) for x in (raw, size, docs, many))
        cut = np.concatenate([[0], np.cumsum(size)])
        least, ends = search(words, size, docs)
        h1, h2 = names(words, cut[:-1], cut[1:])
        lower = np.concatenate([[0], np.cumsum(least != np.repeat(docs, np.diff(ends)))])
        keep = np.flatnonzero((many > docs) | (lower[ends[1:]] > lower[ends[:-1]]))
        body = least.astype("<i8").tobytes()
        for i in range(0, len(keep), 8192):
            k = keep[i : i + 8192]
            parts = [body[8 * x : 8 * y] for x, y in zip(ends[k].tolist(), ends[k + 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h1[k]), pa.array(h2[k]), pa.array(parts, pa.binary())], ["h1", "h2", "least"])

    return distinct.select("route", "words", "doc_id", "last").repartition(shards, "route").mapInArrow(task, "h1 long, h2 long, least binary")


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, a, b): word ranges that go."""

    def task(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            data, offs = common.utf8(rb.column(2))
            least, cut = np.frombuffer(data.tobytes(), "<i8"), offs // 8
            doc, start = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row = np.repeat(np.arange(rb.num_rows), np.diff(cut))
            bad = least < doc[row]
            edge = np.ones(len(bad) + 1, bool)
            edge[1:-1] = row[1:] != row[:-1]
            opens = np.flatnonzero(bad & (edge[:-1] | ~np.concatenate([[False], bad[:-1]])))
            closes = np.flatnonzero(bad & (edge[1:] | ~np.concatenate([bad[1:], [False]])))
            at = lambda i: start[row[i]] + i - cut[row[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[row[opens]]), pa.array(at(opens)), pa.array(at(closes) + WINDOW)], ["doc_id", "a", "b"]
            )

    return found.select("doc_id", "start", "least").mapInArrow(task, "doc_id long, a long, b long")


def cut_out(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) from text, copy and cuts."""

    def task(batches):
        for rb, data, offs in common.blocks(batches):
            raw = data.tobytes()
            ids, copies, lists = rb.column(0), rb.column(2).to_pylist(), rb.column(3).to_pylist()
            n_words, n_gone, kept = [], [], []
            for a, b, copy, cuts in zip(offs[:-1].tolist(), offs[1:].tolist(), copies, lists):
                words = raw[a:b].split()
                n = len(words)
                if copy and n >= WINDOW:
                    words = []
                elif cuts:
                    stay = np.ones(n, bool)
                    for c in cuts:
                        stay[c["a"] : c["b"]] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_words.append(n)
                n_gone.append(n - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_gone), pa.array(kept)], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "copy", "cuts").mapInArrow(task, "doc_id long, n_words long, n_removed long, kept string")


def dedup(docs: DataFrame, hot: int = HOT, route_bytes: int = ROUTE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row.

    Null text has no words.  Rows that repeat an id are one document: none of
    them counts as lesser than another.  A row without id loses nothing and
    takes nothing from others.  A text of any length is one document, its passages
    lie in many shards.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.tune(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    known = common.staged(d.where("doc_id is not null").select("doc_id", "key").distinct(), "ids")
    texts = common.staged(known.groupBy("key").agg(F.min("doc_id").alias("rep")), "texts")

    named = anchors(d.where("doc_id is not null").select(F.xxhash64("key").alias("name"), "text"))
    seen = named.groupBy("anchor").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = common.staged(seen.where("lo <> hi").select("anchor", (F.col("n") > hot).alias("hot")), "anchors")
    common.release(spark)
    listed = named.join(several, "anchor").groupBy("name").agg(F.collect_set(F.struct("anchor", "hot")).alias("anchors"))
    todo = texts.select(F.xxhash64("key").alias("name"), "key", F.col("rep").alias("doc_id")).join(listed, "name").drop("name")
    todo = common.staged(todo, "todo")
    common.release(spark)
    parts = common.staged(passages(d.join(todo.hint("shuffle_hash"), ["doc_id", "key"])), "passages")
    common.release(spark)
    parts = routed(parts, route_bytes)
    size = parts.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    distinct = parts.groupBy("route", "words").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    found = common.staged(searched(distinct, shards), "least")
    ranges = covered(parts.select("h1", "h2", "doc_id", "start").join(found, ["h1", "h2"]))
    cuts = common.staged(ranges.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("cuts")), "cuts")

    fate = known.join(texts, "key").select("doc_id", "key", (F.col("rep") < F.col("doc_id")).alias("copy"))
    fate = fate.join(cuts, "doc_id", "left").select("doc_id", "key", "copy", F.when(~F.col("copy"), F.col("cuts")).alias("cuts"))
    fate = common.staged(fate, "fate")
    common.release(spark)
    return cut_out(d.join(fate.hint("shuffle_hash"), ["doc_id", "key"], "left"))


def op5_fm_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
mn AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM win JOIN mn USING (h) WHERE m < doc_id),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT pos.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY pos.p) FILTER (gone.p IS NULL) AS kept
  FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
