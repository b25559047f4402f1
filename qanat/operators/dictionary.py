"""Which names of a large dictionary a text contains: one Aho-Corasick pass over the text.

Names are sorted and cut into pieces of at most ``PIECE`` characters; a piece is small enough to be sent to the tasks,
whatever the dictionary's size, and each piece is one pass over the texts.  A worker builds the automaton of a
piece once.  Names longer than a piece are a piece of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.session import ship

#: Characters of names in one automaton: about 60 bytes each in a worker.
PIECE = 2 << 20
_automata: dict[int, object] = {}


def pieces(names: DataFrame, column: str, most: int = PIECE) -> Iterator[list[str]]:
    """Distinct names in order, in lists of at most ``most`` characters; never more than one list at the driver.
    Nulls and empty names are left out."""
    held, size = [], 0
    for r in names.select(F.col(column).cast("string").alias("name")).where("name <> ''").distinct().orderBy("name").toLocalIterator():
        if held and size + len(r["name"]) > most:
            yield held
            held, size = [], 0
        held.append(r["name"])
        size += len(r["name"])
    if held:
        yield held


def _automaton(key: int, names: list[str]):
    if key not in _automata:
        import ahocorasick

        _automata.clear()  # a worker holds one piece
        a = ahocorasick.Automaton()
        for i, n in enumerate(names):
            a.add_word(n, i)
        a.make_automaton()
        _automata[key] = a
    return _automata[key]


def _letter(c: str) -> bool:
    return c.isalnum() or c == "_"


def contained(texts: DataFrame, column: str, names: DataFrame, name: str = "name", keep: list[str] | None = None, whole_words: bool = False, most: int = PIECE) -> DataFrame:
    """Rows (``keep`` columns, name, n): how often each contained name occurs in a text, overlaps included.  ``whole_words``: only
    where no letter, digit or underscore touches it.  Null and empty texts contain nothing."""
    spark = texts.sparkSession
    ship(spark)
    keep = keep if keep is not None else [c for c in texts.columns if c != column]
    rows = texts.select(*keep, F.col(column).cast("string").alias("__text")).where("__text is not null")
    schema = rows.select(*keep).withColumn("name", F.lit("")).withColumn("n", F.lit(0).cast("long")).schema
    out = spark.createDataFrame([], schema)
    for held in pieces(names, name, most):
        sent = spark.sparkContext.broadcast(held)
        key = hash((held[0], held[-1], len(held)))

        def task(batches, sent=sent, key=key):
            held = sent.value
            a = _automaton(key, held)
            for rb in batches:
                row, which, times = [], [], []
                for i, text in enumerate(rb.column(rb.num_columns - 1).to_pylist()):
                    seen: dict[int, int] = {}
                    for end, j in a.iter(text):
                        if whole_words:
                            start = end - len(held[j]) + 1
                            if (start and _letter(text[start - 1])) or (end + 1 < len(text) and _letter(text[end + 1])):
                                continue
                        seen[j] = seen.get(j, 0) + 1
                    row += [i] * len(seen)
                    which += [held[j] for j in seen]
                    times += seen.values()
                if row:
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*[c.take(at) for c in rb.columns[:-1]], pa.array(which, pa.string()), pa.array(times, pa.int64())], [*keep, "name", "n"])

        out = out.unionByName(rows.mapInArrow(task, schema))
    return out
