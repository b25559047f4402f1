"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Format of one partition ``NNNNN``, little-endian throughout:

* ``NNNNN.ids``: the token ids of its documents, one after the other, as
  unsigned 16-bit integers where every id of the vocabulary fits, else 32-bit;
* ``NNNNN.idx``: magic ``QTOKIDX1``, int64 width in bytes, int64 n, then n + 1
  int64 offsets (in ids, from 0 in this file), then n int64 document ids.

Partitions are ranges of ascending document id (of the text among equal ids), small in rows and in bytes of text.  Each task streams its ids to a file of its
own name and renames it when whole, so a retried task replaces equal files.
Prefix sums of the partitions' counts give the base of each partition in the
whole id sequence.  Readers map the files into memory.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import chain, repeat
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qanat.llm import common

MAGIC = b"QTOKIDX2"
END_ID = 1
#: Distinct words whose ids one Python worker remembers.
MEMO_WORDS = 3 << 19
#: Rows and bytes of text of one partition, about.
PART_ROWS, PART_BYTES = 1 << 14, 64 << 20
#: Characters of a text that range bounds hold: all that a sort by text needs to divide it.
HEAD = 64
# Steps before the model under which a text's ids are those of its words.
WORDWISE_NORMALIZERS = ("NFC", "Replace", "Lowercase")
WORDWISE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PARTS = "pid int, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(uri: str):
    """(file system, path): the local one by plain files, others through Arrow."""
    if urlparse(uri).scheme in ("", "file"):
        return None, urlparse(uri).path if "://" in uri or uri.startswith("file:") else uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, chunks) -> None:
    store, path = _store(uri)
    temp = f"{path}.{uuid.uuid4().hex}.part"
    if store is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temp, "wb") as f:
            for c in chunks:
                f.write(c)
        os.replace(temp, path)
    else:
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(temp) as f:
            for c in chunks:
                f.write(c)
        store.move(temp, path)


def _get(uri: str, dtype) -> np.ndarray:
    """The file as an array: mapped where the file system is local."""
    store, path = _store(uri)
    if store is None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def wordwise(config: dict) -> bool:
    """Whether the ids of a text are those of its words: the tokenizer lower-cases, its
    pre-tokens are the matches of the known pattern (none holds white space, a letter never
    joins a comma or full stop) and white space between them is dropped."""
    steps = (config.get("normalizer") or {}).get("normalizers") or []
    cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    spaces = [x for x in steps if x["type"] == "Replace"]
    return (
        sorted(x["type"] for x in steps) == sorted(WORDWISE_NORMALIZERS)
        and all(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in spaces)
        and cuts[0].get("type") == "Split"
        and cuts[0].get("pattern") == {"Regex": WORDWISE_PATTERN}
        and (cuts[0].get("behavior"), cuts[0].get("invert")) == ("Removed", True)
        and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in cuts[1:])
    )


class Encoder:
    """The tokenizer behind a memo of words.

    Where its configuration says that the ids of a text are those of its words, one
    after the other (``wordwise``), each distinct word goes through the library once.
    Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            self.wordwise = wordwise(json.load(f))
        self.limit = memo
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids, self.ofs = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.n_ids = self.n = 0

    def learn(self, words: list[bytes]) -> None:
        found = [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        more = int(size.sum())
        while self.n_ids + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(words) + 1 > len(self.ofs):
            self.ofs = np.concatenate([self.ofs, np.zeros_like(self.ofs)])
        self.ids[self.n_ids : self.n_ids + more] = np.fromiter(chain.from_iterable(found), np.uint32, more)
        self.ofs[self.n + 1 : self.n + len(words) + 1] = self.n_ids + np.cumsum(size)
        self.memo.update(zip(words, range(self.n, self.n + len(words))))
        self.n_ids += more
        self.n += len(words)

    @staticmethod
    def split(data: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The words of all documents, and how many lie before each document's end.

        To have fewer distinct ones, words are also cut between an ASCII letter
        and a comma or full stop (always an edge of pre-tokens), and an ASCII
        capital that starts a word before an ASCII small letter is made small
        (the tokenizer does so to all).  Both leave every id as it was.
        """
        if len(data) > 1:
            first = np.ones(len(data), bool)
            first[1:] = common.WS[data[:-1]]
            first[offs[:-1][offs[:-1] < len(data)]] = True
            low = np.flatnonzero(first[:-1] & (data[:-1] - 65 < 26) & (data[1:] - 97 < 26))
            data = data.copy()
            data[low] += 32
            cut = ((data[1:] == 0x2C) | (data[1:] == 0x2E)) & ((data[:-1] | 32) - 97 < 26)
            cut[offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))] - 1] = False
            pos = np.flatnonzero(cut) + 1
            data, offs = np.insert(data, pos, 0x20), offs + np.searchsorted(pos, offs)
        raw, words, count = data.tobytes(), [], []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            words += raw[a:b].split()
            count.append(len(words))
        return words, np.array(count)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if self.n > self.limit:
            self.clear()
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(at < 0).tolist()
        if miss:
            fresh = list({words[i] for i in miss})
            for i in range(0, len(fresh), 4096):
                self.learn(fresh[i : i + 4096])
            at[miss] = [self.memo[words[i]] for i in miss]
        size = self.ofs[at + 1] - self.ofs[at]
        return self.ids[np.repeat(self.ofs[at], size) + common.repeats(size)], size


    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and how many lie before each document's end."""
        if self.wordwise:
            words, count = self.split(data, offs)
            got, size = self.encode(words)
            return got, np.concatenate([[0], np.cumsum(size)])[count]
        raw = data.tobytes()
        whole = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        found = [e.ids for e in self.tok.encode_batch_fast(whole, add_special_tokens=False)]
        upto = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(upto[-1]) if len(upto) else 0), upto


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, rows_per_part: int = PART_ROWS, bytes_per_part: int = PART_BYTES) -> DataFrame:
    """Writes the files and returns one row per partition: pid, path, n_docs, n_ids, base.

    Null text is empty: its ids are the end id alone.  Rows without id come first;
    rows that repeat an id (or have none) are ordered by their text and may lie in several
    files, divided by the first characters of it.  A text of any length is encoded whole.  Other
    columns are ignored.  An empty table writes no file.
    """
    spark = docs.sparkSession
    common.tune(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n, size = d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = max(-(-n // rows_per_part), -(-size // bytes_per_part))
    parts = max(1, min(least, 1 << 20), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    d = d.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")

    def task(batches):
        pid = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        kind = np.dtype(np.uint16 if max(enc.size, end_id + 1) <= 1 << 16 else np.uint32).newbyteorder("<")
        sizes, names, nulls = [], [], []

        def encoded():
            for rb, data, offs in common.blocks(batches):
                got, upto = enc.texts(data, offs)
                sizes.append(np.diff(upto, prepend=0) + 1)
                names.append(pc.fill_null(rb.column(0), 0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(rb.column(0).null_count)
                yield np.insert(got.astype(kind), upto, end_id).tobytes()

        stream = encoded()
        first = next(stream, None)
        if first is None:
            return
        base = f"{folder}/{pid:05d}"
        _put(f"{base}.ids", chain([first], stream))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
        n = len(offsets) - 1
        head = np.array([kind.itemsize, n, sum(nulls)], "<i8")  # rows without id are the first
        _put(f"{base}.idx", [MAGIC, head.tobytes(), offsets.tobytes(), np.concatenate(names).tobytes()])
        yield pa.RecordBatch.from_pydict(
            {"pid": pa.array([pid], pa.int32()), "path": [base], "n_docs": [n], "n_ids": [int(offsets[-1])]}
        )

    done = common.staged(d.select("doc_id", "text").mapInArrow(task, PARTS), "token-parts")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return done.withColumn("base", F.sum("n_ids").over(before) - F.col("n_ids"))


def read(parts: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start in the whole sequence, n_tokens, ids_crc32."""

    def task(batches):
        for rb in batches:
            for path, base in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                idx = _get(f"{path}.idx", np.uint8)
                if idx[:8].tobytes() != MAGIC:
                    raise ValueError(f"not a token index: {path}.idx")
                nums = idx[8:].view("<i8")
                width, n, n_null = nums[:3].tolist()
                offs, names = nums[3 : n + 4], nums[n + 4 : 2 * n + 4]
                ids = _get(f"{path}.ids", f"<u{width}")
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(names), mask=np.arange(n) < n_null), pa.array(base + offs[:-1]), pa.array(np.diff(offs)), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.select("path", "base").repartition(n).mapInArrow(task, ROWS)


def op7_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token files of ``documents``: start, count and checksum of each document's ids, read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, tokenizer, common.new_path(spark, "tokens")))
