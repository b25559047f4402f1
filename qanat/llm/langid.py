"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are folded to lower case, everything else to a space; features are
hashed bigrams and trigrams of the result, weighted tf * idf and scaled to unit
length.  Document frequencies count every learnable document.  The weights come
from follow-the-regularised-leader with elastic-net penalties on a bounded
sample (``SAMPLE_ROWS`` a language), and a temperature fitted on a part of that
sample kept from training calibrates the probabilities.

A probability says which of the learned languages fits best, not whether any does.
For that ``accepted`` asks how many documents of the predicted language have the
text's n-grams, whatever the number of languages.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.llm import common
from qanat.llm.ftrl import Ftrl

BITS = 15
DIMS = 1 << BITS
#: Text bytes whose n-grams are made at once; a task holds about 50 times as much meanwhile.
BLOCK_BYTES = 512 << 10
#: Documents of each language that the learner sees, about; thinned by a hash of the id.
SAMPLE_ROWS = 600
#: Values of lang that are learned at most.
LANGUAGES = 256
EPOCHS = 4
LEARNER = {"alpha": 2.0, "beta": 1.0, "l1": 0.05, "l2": 0.001}
UNKNOWN = "und"
#: Pipeline: documents are rejected whose n-grams occur, in the geometric mean, in a lesser
#: share than this of the documents of the language predicted.
MIN_SHARE = 0.02
#: n-grams of share 1 that every text is given on top: a few odd letters are no evidence.
PRIOR = 10

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> its lower case if a letter, else 0x20."""
    if not _fold:
        table = np.full(0x110000, 0x20, np.uint32)
        for i in range(0x80, 0x110000):
            if chr(i).isalpha():
                low = chr(i).lower()
                table[i] = ord(low) if len(low) == 1 else i
        table[97:123] = np.arange(97, 123)
        table[65:91] = np.arange(97, 123)
        _fold.append(table)
    return _fold[0]


def counts(data: np.ndarray, offs: np.ndarray, docs: int = 64):
    """Yields (first document, float32 counts [documents x DIMS], has a letter [documents])."""
    codes, at = common.code_points(data, offs)
    c = fold_table()[codes]
    letter = np.concatenate([[0], np.cumsum(c != 0x20)])
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F) if len(c) > 2 else np.zeros(0, np.uint32)
        two = ((two ^ (two >> np.uint32(13))) * np.uint32(0x165667B1)) >> np.uint32(32 - BITS)
        three = ((three ^ (three >> np.uint32(13))) * np.uint32(0x165667B1)) >> np.uint32(32 - BITS)
    n = len(offs) - 1
    for a in range(0, n, docs):
        b = min(a + docs, n)
        m = np.zeros((b - a, DIMS), np.float32)
        for i in range(a, b):
            s, e = at[i], at[i + 1]
            if e - s >= 2:
                m[i - a] = np.bincount(two[s : e - 1], minlength=DIMS)
                if e - s >= 3:
                    m[i - a] += np.bincount(three[s : e - 2], minlength=DIMS)
            elif e - s == 1:
                m[i - a, int(c[s]) % DIMS] = 1
        yield a, m, (letter[at[a + 1 : b + 1]] - letter[at[a:b]]) > 0


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    known: np.ndarray


def document_frequencies(docs: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """In how many documents of each language each feature occurs [languages x DIMS], and
    their numbers [languages]."""
    wide = DIMS + 1

    def task(batches):
        df = np.zeros((len(langs), wide), np.int64)
        names = pa.array(langs, pa.string())
        for rb, data, offs in common.blocks(batches, limit=BLOCK_BYTES):
            of = pc.index_in(rb.column(1).cast(pa.string()), names).to_numpy(zero_copy_only=False)
            for a, m, _ in counts(data, offs):
                own = of[a : a + len(m)]
                for k in np.unique(own):
                    df[k, :DIMS] += np.count_nonzero(m[own == k], 0)
                    df[k, DIMS] += int((own == k).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df.reshape(-1)[at])], ["f", "df"])

    d = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = d.mapInArrow(task, "f long, df long").groupBy("f").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(len(langs) * wide, np.int64)
    out[rows["f"].to_numpy()] = rows["df"].to_numpy()
    out = out.reshape(len(langs), wide)
    return out[:, :DIMS], out[:, DIMS]


def knowledge(df: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[DIMS x (languages + 1)]: log10 of the share of a language's documents that have the
    feature, and 1 for a feature that is evidence (n-grams without a letter are none)."""
    out = np.log10((df.T + 0.5) / (n + 1.0))
    ((_, gap, _),) = counts(np.full(3, 0x20, np.uint8), np.array([0, 3]))
    out = np.column_stack([out, np.ones(DIMS)])
    out[gap[0] > 0] = 0
    return out.astype(np.float32)


def _probabilities(logits: np.ndarray, temperature: float) -> np.ndarray:
    s = logits / temperature
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on a grid; 1 without rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 93))
    loss = [-np.log(_probabilities(logits, t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, learn: Column, per_language: int = SAMPLE_ROWS, epochs: int = EPOCHS, **learner) -> Model | None:
    """Learns from text and lang of the rows where ``learn`` holds and lang is not
    null; None if there is none (an empty table, say).

    Of more than ``LANGUAGES`` values of lang those of most rows are learned (a bound on what a task and the
    driver count; the others are no classes).  A null text is not learned from.  The sample is thinned by a hash of id and text,
    so rows without id are drawn like all others; of drawn rows equal in id, text and
    lang one is learned from.  Texts of any length are taken whole; other columns are
    ignored.
    """
    common.tune(docs.sparkSession)
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    )
    n = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
    size = {r["lang"]: r["n"] for r in n.collect()}
    if not size:
        return None
    langs = sorted(size)
    if len(langs) == LANGUAGES:
        known = known.where(F.col("lang").isin(langs))
    df, n = document_frequencies(known, langs)
    idf = (np.log((1 + n.sum()) / (1 + df.sum(0))) + 1).astype(np.float32)

    def task(batches):
        for rb, data, offs in common.blocks(batches, limit=BLOCK_BYTES):
            got = []
            for _, m, has in counts(data, offs):
                for row, ok in zip(m, has):
                    at = np.flatnonzero(row)
                    got.append(at.astype("<i4").tobytes() + row[at].astype("<f4").tobytes() if ok else b"")
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array(got, pa.binary())], ["doc_id", "lang", "f"])

    drawn = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")), F.lit(1 << 30))
    quota = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / size[k]) * (1 << 30)))])
    sample = known.where(drawn < quota[F.col("lang")]).distinct().mapInArrow(task, "doc_id long, lang string, f binary")
    rows = []
    for r in sorted(sample.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["f"]))):
        if r["f"]:
            half = len(r["f"]) // 8
            at, val = np.frombuffer(bytes(r["f"]), "<i4", half), np.frombuffer(bytes(r["f"]), "<f4", half, half * 4)
            x = val * idf[at]
            rows.append((at, x / np.linalg.norm(x), langs.index(r["lang"]), (r["doc_id"] or 0) % 5 == 0))
    model = Ftrl(DIMS, max(2, len(langs)), **(LEARNER | learner))
    eye = np.eye(max(2, len(langs)))
    kept = [(a, x, y) for a, x, y, held in rows if held]
    fit = [(a, x, eye[y]) for a, x, y, held in rows if not held] or [(a, x, eye[y]) for a, x, y, _ in rows]
    model.fit(fit, epochs)
    w, b = model.weights()
    logits = np.array([x @ w[a] + b for a, x, _ in kept]).reshape(len(kept), -1)[:, : len(langs)]
    t = calibrate(logits, np.array([y for *_, y in kept], np.int64))
    return Model(langs, idf, w[:, : len(langs)].astype(np.float32), b[: len(langs)], t, knowledge(df, n))


def predict(docs: DataFrame, model: Model | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score (calibrated probability) of every row, with the
    ``extra`` columns (simple types) unchanged.

    Text that is null or has no letter: ``und``, score 0; without a model every row is.
    Equal probabilities: the lesser language.  Rows that repeat an id, or have none,
    are judged one by one; texts of any length are judged whole; an empty table gives
    no rows; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)
    cols = [F.col("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in extra]]
    d = docs.select(*cols)

    def task(batches):
        model = shared.value
        for rb, data, offs in common.blocks(batches, limit=BLOCK_BYTES):
            best, prob = np.zeros(rb.num_rows, np.int64) - 1, np.zeros(rb.num_rows)
            if model is not None:
                v = model.idf[:, None] * model.weights
                sq = (model.idf**2)[:, None]
                for a, m, has in counts(data, offs):
                    norm = np.sqrt((m * m) @ sq)
                    p = _probabilities((m @ v) / np.maximum(norm, 1e-9) + model.bias, model.temperature)
                    best[a : a + len(m)] = np.where(has, p.argmax(1), -1)
                    prob[a : a + len(m)] = np.where(has, p.max(1), 0.0)
            names = pa.array([*(model.langs if model else []), UNKNOWN])
            lang = names.take(pa.array(np.where(best < 0, len(names) - 1, best)))
            keep = [rb.column(i) for i in range(rb.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*keep, lang, pa.array(prob)], ["doc_id", *extra, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields if f.name != "text")
    return d.mapInArrow(task, f"{kinds}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, least: float = MIN_SHARE) -> DataFrame:
    """The rows, all columns unchanged, whose language is one of those learned: its documents
    have the text's n-grams in a share of ``least`` or more (geometric mean over all n-grams
    with a letter and ``PRIOR`` known ones).

    Null text and text without a letter are rejected, and without a model nothing else is.
    A language of few documents gives little evidence, so few texts are rejected then.
    Equal probabilities: the lesser language.  Every row is judged by its own text, read
    whole, so repeated and missing ids do not matter; an empty table gives no rows."""
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)
    floor = np.log10(least) if least > 0 else -np.inf

    def task(batches):
        model = shared.value
        for rb, data, offs in common.blocks(batches, limit=BLOCK_BYTES):
            good = np.zeros(rb.num_rows, bool)
            if model is not None:
                v, sq = model.idf[:, None] * model.weights, (model.idf**2)[:, None]
            for a, m, has in counts(data, offs):
                good[a : a + len(m)] = has
                if model is not None:
                    logits = (m @ v) / np.maximum(np.sqrt((m * m) @ sq), 1e-9) + model.bias
                    seen = m @ model.known
                    logs = seen[np.arange(len(m)), logits.argmax(1)]
                    good[a : a + len(m)] &= logs / (seen[:, -1] + PRIOR) >= floor
            yield rb.filter(pa.array(good))

    return docs.mapInArrow(task, docs.schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, common.fold_of("doc_id", 3) != 1)
    return predict(docs, model).select("doc_id", (common.fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
