"""Quality rules: an isolation forest on rule statistics.

One pass over the texts counts what rules are made of (``facts``).  The forest sees
rates of these counts: each tree is grown in a task of its own on about
``SAMPLE`` rows of a pool that is drawn by a hash from all documents, by random splits.  The fewer
splits set a document apart, the more anomalous it is: score 2 ** (-mean path /
expected path).  Labelled rows, all of them, only set the threshold: the one of greatest share of bad rows found
less ``PRICE`` times the share of good rows lost.  Scoring covers every row; what
is broadcast is the forest, of a size fixed by ``TREES`` and ``SAMPLE``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qanat.llm import common
from qanat.session import local

TREES = 128
#: Rows that a tree is grown on, about.
SAMPLE = 256
#: Slices of the scores, in each of which labelled rows are counted on their own.
SLICES = 1 << 16
#: A share of good rows rejected weighs as much as this many times that share of bad rows found.
PRICE = 20
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5

#: Per word: symbols, exclamation and question marks, words of one byte, words equal to the one before; capitals
#: per ASCII letter.  Numbers and repeated lines are no sign of a bad text here, and would blur the forest.
RATES = ("symbols", "marks", "shouting", "lone", "echo")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FACTS = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], *[f"{r} double" for r in RATES]])


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SYMBOL, MARK, UPPER = _table(b"#*$%&|<>"), _table(b"!?"), _table(bytes(range(65, 91)))
LETTER = UPPER | _table(bytes(range(97, 123)))


def _per(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of true values in each range."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offs])


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only inside one document."""
    return common.mix64(h ^ common.mix64(doc.astype(np.uint64), 21), 22)


def equal_lines(data: np.ndarray, offs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per document: lines with a word (``words``: their starts) that are equal to an earlier line."""
    n_docs = len(offs) - 1
    starts, ends, first = common.spans(data, offs, _table(b"\n"))
    worded = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    doc = np.repeat(np.arange(n_docs), np.diff(first))[worded]
    _, at = np.unique(_own(common.word_hashes(data, starts[worded], ends[worded]), doc), return_index=True)
    return np.bincount(doc, minlength=n_docs) - np.bincount(doc[at], minlength=n_docs)


def repeated_words(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per document: words inside windows of ``window`` words that the document has twice or more."""
    size = np.diff(first)
    n_win = np.maximum(size - window + 1, 0)
    at = np.repeat(first[:-1], n_win) + common.repeats(n_win)
    if not len(at):
        return np.zeros(len(size), np.int64)
    key = _own(common.gram_hashes(words, window)[at], np.repeat(np.arange(len(size)), n_win))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return _per(np.cumsum(edge[:-1]) > 0, first)


def _block(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = common.spans(data, offs)
    n_docs, n_words = len(offs) - 1, np.diff(first)
    h = common.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n_docs), n_words)
    many = lambda mask: np.bincount(doc[mask], minlength=n_docs)
    out = {
        "n_words": n_words, "word_chars": _per(((data & 0xC0) != 0x80) & ~common.WS[data], offs), "n_symbols": _per(SYMBOL[data], offs),
        "n_dup_lines": equal_lines(data, offs, starts), "n_repeat_words": repeated_words(h, first),
    }
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    some = np.maximum(n_words, 1)
    letters = np.maximum(_per(LETTER[data], offs), 1)
    return out | {
        "symbols": out["n_symbols"] / some, "marks": _per(MARK[data], offs) / some, "shouting": _per(UPPER[data], offs) / letters,
        "lone": many(ends - starts == 1) / some, "echo": many(echo) / some,
    }


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the rates of every row (null text: none; null id stays null).

    Texts of any length are read whole; rows that repeat an id are counted one by one; an
    empty table gives no rows; other columns are ignored.
    """
    common.tune(docs.sparkSession)

    def task(batches):
        for rb, data, offs in common.blocks(batches):
            cols = _block(data, offs)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), *[pa.array(cols[c].astype(np.int64)) for c in COUNTS], *[pa.array(cols[r].astype(float)) for r in RATES]], ["doc_id", *COUNTS, *RATES]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, _FACTS)


def expected_path(n):
    """Mean depth of an unsuccessful search among n values (0 for one value)."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int, depth: int) -> list[tuple[int, float, int, float]]:
    """Nodes (rate or -1, split, left child, path): the right child follows the left one.  A leaf's
    path is its depth and what its rows would need on average; a split takes a rate that varies."""
    rng = np.random.default_rng(seed)
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, level = todo.pop()
        part = x[rows]
        low, high = (part.min(0), part.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        varied = np.flatnonzero(high > low)
        if level >= depth or not len(varied):
            nodes[at] = (-1, 0.0, at, level + float(expected_path(len(rows))))
            continue
        f = int(rng.choice(varied))
        split = float(rng.uniform(low[f], high[f]))
        split = split if low[f] < split <= high[f] else float(high[f])
        left = len(nodes)
        nodes[at] = (f, split, left, 0.0)
        nodes += [None, None]
        less = part[:, f] < split
        todo += [(left, rows[less], level + 1), (left + 1, rows[~less], level + 1)]
    return nodes


def pool(rows: DataFrame, trees: int, sample: int) -> DataFrame:
    """Up to trees x sample rows of the table, drawn by a hash of all their values.  Rows equal in
    all of them are drawn together, so never more than that many."""
    n, most = rows.count(), trees * sample
    key = F.xxhash64(F.lit("forest"), "doc_id", *COUNTS, *RATES)
    drawn = rows.withColumn("key", key)
    if n > 2 * most:
        drawn = drawn.where(F.pmod("key", F.lit(1 << 30)) < int(2 * most / n * (1 << 30)))
    return drawn.orderBy(F.pmod("key", F.lit(1 << 30)), "key").limit(most)


def forest(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 1) -> dict[str, np.ndarray]:
    """The trees of a table of facts as flat arrays, one tree after the other.  A tree is grown on
    the rows of the pool that its own hash draws, at most twice the sample; without rows there is no tree."""
    drawn = common.staged(pool(rows, trees, sample).select("key", F.array(*RATES).alias("x")), "forest")
    n = drawn.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.lit(seed), "key", t), F.lit(1 << 20)) < share).cast("array<long>")
    depth = int(np.ceil(np.log2(max(2, sample))))

    def task(table):
        tree = table["tree"][0].as_py()
        x = np.asarray(table["x"].combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        x = x[np.lexsort(x.T)][: 2 * sample] if table.num_rows <= 2 * sample else x[np.argsort(table["key"].to_numpy(), kind="stable")[: 2 * sample]]
        nodes = grow(x, seed * 1_000_003 + tree, depth)
        f, split, left, path = zip(*nodes)
        return pa.table({"tree": [tree], "n": [len(x)], "f": [list(f)], "split": [list(split)], "left": [list(left)], "path": [list(path)]})

    grown = drawn.select("key", "x", F.explode(mine).alias("tree")).groupBy("tree").applyInArrow(
        task, "tree long, n long, f array<long>, split array<double>, left array<long>, path array<double>"
    )
    got = sorted(grown.collect(), key=lambda r: r["tree"])  # at most ``trees`` rows of about 2 x sample nodes
    base = np.cumsum([0, *[len(r["f"]) for r in got]])
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *[np.array(r[name], kind) for r in got]])
    left = join("left", np.int64) + np.repeat(base[:-1], np.diff(base))
    mean = float(np.mean([expected_path(r["n"]) for r in got])) if got else 1.0
    return {"root": base[:-1], "f": join("f", np.int64), "split": join("split", float), "left": left, "path": join("path", float), "mean": mean or 1.0, "depth": depth}


def isolation(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores in (0, 1] of rows of rates: above a half more anomalous than the average row."""
    if not len(model["root"]):
        return np.full(len(x), 0.5)
    at = np.tile(model["root"], (len(x), 1))
    row = np.arange(len(x))[:, None]
    for _ in range(model["depth"]):
        f = model["f"][at]
        right = x[row, np.maximum(f, 0)] >= model["split"][at]
        at = np.where(f >= 0, model["left"][at] + right, at)
    return 2.0 ** (-model["path"][at].mean(1) / model["mean"])


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """doc_id, the counts, and the score of every row of a table of facts."""
    names = ["doc_id", *COUNTS]
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for rb in batches:
            x = np.stack([rb.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(len(RATES))], 1)
            yield pa.RecordBatch.from_arrays([*rb.columns[: len(names)], pa.array(isolation(sent.value, x))], [*names, "score"])

    return rows.select(*names, *RATES).mapInArrow(task, ", ".join([f"{c} long" for c in names] + ["score double"]))


def threshold(scores: DataFrame, labels: DataFrame, learn: Column, price: float = PRICE) -> float:
    """The score from which a document is rejected, from every labelled row of a table of scores.  Labels count
    where ``learn`` holds; an id with several counts as bad if one says so; null labels and ids are left
    out.  Without rows of both kinds nothing is rejected (infinity).

    Rows at or above a score are those of the slices above, whose sums the driver has (one
    a slice, however many rows there are), and those of the own slice, counted in its task."""
    y = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn)
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("good"))
    some = scores.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {REPEAT_PERCENT} * n_words").groupBy("doc_id").agg(F.max("score").alias("score")).join(y, "doc_id")
    cuts = some.groupBy("score").agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
    cuts = common.staged(cuts.withColumn("slice", F.least(F.floor(F.col("score") * SLICES), F.lit(SLICES)).cast("int")), "rule-cuts")
    sums = cuts.groupBy("slice").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy(F.col("slice").desc()).toArrow()
    if not sums.num_rows:
        return float("inf")
    good, bad = (sums[c].to_numpy().astype(np.int64) for c in ("good", "bad"))
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return float("inf")
    above = local(scores.sparkSession, {"slice": sums["slice"].to_pylist(), "good_above": (np.cumsum(good) - good).tolist(), "bad_above": (np.cumsum(bad) - bad).tolist()})
    down = Window.partitionBy("slice").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    some = cuts.withColumn("n_good", F.sum("good").over(down)).withColumn("n_bad", F.sum("bad").over(down)).where("bad > 0").join(F.broadcast(above), "slice")
    lost = 1 - (n_good - F.col("good_above") - F.col("n_good")) / F.lit(n_good)
    found = 1 - (n_bad - F.col("bad_above") - F.col("n_bad")) / F.lit(n_bad)
    best = some.select((found - price * lost).alias("worth"), (-F.col("score")).alias("at")).agg(F.max(F.struct("worth", "at")).alias("best")).first()["best"]
    if best["worth"] <= 0:
        return float("inf")
    cut = -best["at"]
    below = cuts.where((F.col("good") > 0) & (F.col("score") < cut)).agg(F.max("score")).first()[0]
    return cut if below is None else (cut + below) / 2


def judge(docs: DataFrame, labels: DataFrame, learn: Column | None = None, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every row.

    Null and empty texts have no words and fail the base rules; repeated rows get the same
    verdict; a score equal to the threshold rejects; an empty table gives no rows.  The facts and the
    scores are written once to the shared folder, so texts are read once and rows scored once.
    """
    rows = common.staged(facts(docs), "rule-facts")
    model = forest(rows, trees, sample)
    scores = common.staged(scored(rows, model), "rule-scores")
    limit = threshold(scores, labels, F.lit(True) if learn is None else learn)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scores.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") < limit)).alias("kept"), "score")


def op11_isolation_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels, common.fold_of("doc_id", 3) != 1)
