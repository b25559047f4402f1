"""Hidden Markov language model with Baum-Welch training and exact scoring.

Tokens are words (runs of bytes outside space and 0x09-0x0D, A-Z in lower case)
and one end token a document.  Counts of all training tokens are aggregated in
Spark.  The ``VOCAB`` most frequent tokens (seen ``LEAST`` times or more) are symbols whose emissions travel to
the tasks (a proven bound); all others are one class there.  Baum-Welch starts from a fit on a bounded
sample (``INIT_ROWS`` documents), then every pass sums expected counts over all
training documents, partition by partition, and re-estimates, until a pass gains less
than ``GAIN`` a token (``PASSES`` at most).

Inside the class every token seen ``LEAST`` times or more has emissions of its own, however many there
are: one more pass sums the expected counts of each by its states in a shuffle and writes them as a table,
which neither the driver nor a task holds whole.  Tokens seen less often share the split of all of them, inside which each
has its smoothed share, so the model is a proper distribution over tokens.  Scores come from the scaled forward
recursion over the whole text, in double precision; a document's tokens of the class meet the table in a join.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.llm import common

STATES = 6
VOCAB = 1 << 17
#: Tokens seen less often have no symbol of their own: their split over states would be chance.
LEAST = 3
#: Tokens from which the most frequent ones are picked at the driver.
TABLE = 1 << 19
PASSES = 4
#: Natural log likelihood a token that a pass must gain for another one to follow.
GAIN = 0.002
INIT_ROWS = 1000
INIT_PASSES = 12
PRIOR = 200.0
#: Tokens' worth of the class's own split over the states that a token of the class starts from.
LEAN = 1.0
#: Steps of 1 in which expected counts of tokens of the class are summed: whole numbers, whose sums do not
#: depend on the order and whose bytes are few.
GRAIN = 1 << 12
SMOOTH = 0.1
#: Tokens of a piece of a long document; its pieces run side by side.
CUT = 1 << 15
#: Symbols whose expected counts make one row of the exchange between tasks.
SLICE = 1 << 13
#: Text bytes whose sequences run in step.
STEP_BYTES = 6 << 20
LOWER = np.arange(256)
LOWER[65:91] += 32
#: The end token's name among the 64-bit hashes of words.
END = np.uint64(0x00E4D00E4D00E4D0)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block and the documents' offsets in them (ends included)."""
    starts, ends, first = common.spans(data, offs)
    h = common.word_hashes(data, starts, ends, LOWER)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in ``docs``."""

    def task(batches):
        have: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, c = np.concatenate([x for x, _ in have]), np.concatenate([x for _, x in have])
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, c, len(u)).astype(np.int64)

        for _, data, offs in common.blocks(batches):
            u, c = np.unique(tokens(data, offs)[0], return_counts=True)
            have.append((u, c))
            size += len(u)
            if size > 1 << 21:
                have = [merged()]
                size = len(have[0][0])
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(have[0][0].view(np.int64)), pa.array(have[0][1])], ["h", "c"])
                    have, size = [], 0
        if have:
            u, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.select(F.col("text").cast("string")).mapInArrow(task, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Counted(NamedTuple):
    """Training totals and the counts of the most frequent tokens (sorted by hash)."""

    h: np.ndarray
    c: np.ndarray
    total: int
    distinct: int

    def base(self, c):
        return np.log10((c + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))


def most_frequent(table: DataFrame, limit: int) -> Counted:
    """At most ``limit`` tokens, by a count threshold read off a histogram of log counts."""
    grade = F.floor(F.log2("c") * 8).cast("int")
    hist = sorted(((r["g"], r["n"], r["s"]) for r in table.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s")).collect()), reverse=True)
    room, least = limit, None
    for g, n, _ in hist:
        if n > room:
            break
        room, least = room - n, g
    top = table.where(grade >= least) if least is not None else table.limit(0)
    got = top.toArrow()
    h = got["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Counted(h[order], got["c"].to_numpy().astype(np.int64)[order], sum(s for *_, s in hist), sum(n for _, n, _ in hist))


def find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of every hash in the sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, at, -1)


class Codes(NamedTuple):
    """Which tokens have symbols of their own: symbol i is ``h[i]``, the last symbol is the class of all others."""

    h: np.ndarray
    c: np.ndarray
    share: np.ndarray  # smoothed share of every symbol among training tokens
    rare_total: int
    rare_distinct: int

    @property
    def weight(self) -> float:
        """What the smoothed counts of the class add up to, a token never seen among them."""
        return self.rare_total + SMOOTH * (self.rare_distinct + 1)

    def inside(self, c):
        """log10 smoothed share of a token of count ``c`` inside the class."""
        return np.log10((c + SMOOTH) / self.weight)


def coded(known: Counted, vocab: int) -> Codes:
    order = np.lexsort((known.h, -known.c))[:vocab]
    order = order[known.c[order] >= LEAST]
    end = np.flatnonzero(known.h == END)
    if len(end) and end[0] not in order:
        order = np.append(order[: vocab - 1], end)
    order = order[np.argsort(known.h[order])]
    c = known.c[order]
    rare = known.total - int(c.sum())
    share = np.append(c, rare) + SMOOTH
    return Codes(known.h[order], c, share / share.sum(), rare, known.distinct - len(order))


class Hmm(NamedTuple):
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


def in_step(at: np.ndarray, size: np.ndarray):
    """Sequences side by side, longest first: token order by time, and how many run at each time."""
    rank = np.argsort(-size, kind="stable")
    s = size[rank]
    n = np.searchsorted(-s, -np.arange(1, (s[0] if len(s) else 0) + 1), side="right")
    base = np.concatenate([[0], np.cumsum(n)])
    t = common.repeats(s)
    order = np.empty(len(t), np.int64)
    order[base[t] + np.repeat(np.arange(len(s)), s)] = np.repeat(at[rank], s) + t
    return order, base, rank


def transfers(model: Hmm, symbols: np.ndarray, at: np.ndarray, size: np.ndarray):
    """What the tokens of each piece do to a distribution over the states at its first token:
    rows (scaled to sum 1) and the logarithms of their scales."""
    order, base, rank = in_step(at, size)
    k = len(model.start)
    out, logs = np.empty((len(at), k, k)), np.zeros((len(at), k))
    x = None
    for t in range(len(base) - 1):
        n = base[t + 1] - base[t]
        e = model.emit[symbols[order[base[t] : base[t + 1]]]][:, None, :]
        x = np.eye(k) * e if x is None else (x[:n] @ model.move) * e
        s = x.sum(2)
        x /= s[:, :, None]
        logs[:n] += np.log(s)
        done = base[t + 2] - base[t + 1] if t + 2 < len(base) else 0
        out[rank[done:n]] = x[done:]
    back = np.empty_like(logs)
    back[rank] = logs
    return out, back


class Pieces(NamedTuple):
    """Sequences cut into pieces of at most ``CUT`` tokens that can run side by side: a piece
    starts from ``init``, which its predecessors give exactly, and ends with ``tail``."""

    at: np.ndarray
    size: np.ndarray
    of: np.ndarray  # the sequence
    init: np.ndarray  # distribution over the states at the first token
    before: np.ndarray  # at the token before it (zero for the first piece)
    tail: np.ndarray  # what follows the last token, up to a factor


def pieces(model: Hmm, symbols: np.ndarray, offs: np.ndarray) -> Pieces:
    size = np.diff(offs)
    n = np.maximum(-(-size // CUT), 1)
    of = np.repeat(np.arange(len(size)), n)
    nth = common.repeats(n)
    at = offs[:-1][of] + nth * CUT
    own = np.minimum(size[of] - nth * CUT, CUT)
    k = len(model.start)
    init, before, tail = np.tile(model.start, (len(of), 1)), np.zeros((len(of), k)), np.ones((len(of), k))
    long = np.flatnonzero(n[of] > 1)
    if len(long):
        out, logs = transfers(model, symbols, at[long], own[long])
        gain = np.exp(logs - logs.max(1, keepdims=True))
        ends = np.append(np.flatnonzero(of[long][1:] != of[long][:-1]) + 1, len(long)).tolist()
        for a, b in zip([0, *ends], ends):
            for i in range(a + 1, b):
                v = (init[long[i - 1]] * gain[i - 1]) @ out[i - 1]
                before[long[i]] = v / v.sum()
                init[long[i]] = before[long[i]] @ model.move
            for i in range(b - 1, a, -1):
                w = model.move @ (gain[i] * (out[i] @ tail[long[i]]))
                tail[long[i - 1]] = w / w.sum()
    return Pieces(at, own, of, init, before, tail)


def forward(model: Hmm, symbols: np.ndarray, offs: np.ndarray, keep: bool = False):
    """Natural log likelihood of every sequence; with ``keep`` also what backward needs."""
    cut = pieces(model, symbols, offs)
    order, base, rank = in_step(cut.at, cut.size)
    sym = symbols[order]
    e = model.emit[sym]
    kept = e.copy() if keep else None
    scale, ones = np.empty(len(order), e.dtype), np.ones(e.shape[1], e.dtype)
    a = None
    for t in range(len(base) - 1):
        x = e[base[t] : base[t + 1]]
        x *= cut.init[rank[: len(x)]] if a is None else a[: len(x)] @ model.move
        s = x @ ones
        x /= s[:, None]
        scale[base[t] : base[t + 1]] = s
        a = x
    seq = cut.of[rank[common.repeats(np.diff(base))]] if len(order) else np.zeros(0, np.int64)
    loglik = np.bincount(seq, np.log(scale, dtype=float), minlength=len(offs) - 1)
    return (loglik, cut, rank, sym, base, e, kept, scale) if keep else loglik


def expected(model: Hmm, symbols: np.ndarray, offs: np.ndarray, emit: np.ndarray):
    """Baum-Welch expected counts of a block: start and moves, and its log likelihood; those of
    emissions are added to ``emit`` (states x symbols)."""
    loglik, cut, rank, sym, base, alpha, seen, scale = forward(model, symbols, offs, True)
    k = len(model.start)
    moves = np.zeros((k, k))
    seen /= scale[:, None]
    tail = cut.tail[rank].astype(alpha.dtype)
    later = np.zeros((0, k), alpha.dtype)
    for t in range(len(base) - 2, -1, -1):
        x = alpha[base[t] : base[t + 1]]
        n = len(later)
        # later: emission * beta / scale of the next step, for the sequences that have one
        moves += x[:n].T @ later
        beta = np.empty_like(x)
        beta[:n] = later @ model.move.T
        if n < len(x):
            beta[n:] = tail[n : len(x)] / (x[n:] * tail[n : len(x)]).sum(1, keepdims=True)
        later = seen[base[t] : base[t + 1]]
        later *= beta
        x *= beta  # alpha becomes the posterior
    for i in range(k):
        emit[i] += np.bincount(sym, alpha[:, i], emit.shape[1])
    head = np.zeros(0, np.int64)
    if len(base) > 1:
        moves += cut.before[rank[: len(later)]].T @ later  # from piece to piece
        head = np.flatnonzero(~cut.before[rank[: len(later)]].any(1))
    return alpha[head].sum(0) if len(head) else np.zeros(k), moves * model.move, float(loglik.sum())


def estimate(first: np.ndarray, moves: np.ndarray, emit: np.ndarray, share: np.ndarray, prior: float = PRIOR) -> Hmm:
    """Parameters from expected counts; emissions lean on the unigram shares with ``prior`` tokens."""
    first, moves = first + 0.1, moves + 0.1
    e = emit + prior * share[:, None]
    return Hmm(first / first.sum(), moves / moves.sum(1, keepdims=True), e / e.sum(0))


def initial(share: np.ndarray, states: int, sample: list[np.ndarray], passes: int) -> Hmm:
    """A seeded perturbation of the unigram shares, improved on the sample."""
    rng = np.random.default_rng(11)
    emit = share[:, None] * rng.gamma(2.0, size=(len(share), states))
    move = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * 0.8
    model = Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    if sample:
        symbols, offs = np.concatenate(sample), np.concatenate([[0], np.cumsum([len(x) for x in sample])])
        for _ in range(passes):
            emit = np.zeros((states, len(share)))
            first, moves, _ = expected(model, symbols, offs, emit)
            model = estimate(first, moves, emit.T, share)
    return model


def encoded(docs: DataFrame, held_out, known: Counted, codes: Codes) -> DataFrame:
    """Every document as symbols, what they add to its base score, and the hashes of its tokens of
    the class in their order (``rare``).  ``uid`` names the row."""
    shared = docs.sparkSession.sparkContext.broadcast((codes.h, known.base(codes.c)))

    def task(batches):
        keys, base = shared.value
        rare = len(keys)
        uid = TaskContext.get().partitionId() << 36
        kind = np.uint16 if rare < 1 << 16 else np.uint32
        for rb, data, offs in common.blocks(batches):
            h, at = tokens(data, offs)
            f = find(keys, h)
            seq = np.repeat(np.arange(rb.num_rows), np.diff(at))
            own = np.bincount(seq, np.append(base, 0.0)[f], rb.num_rows)
            f[f < 0] = rare
            raw, w = f.astype(kind).tobytes(), np.dtype(kind).itemsize
            lost = np.flatnonzero(f == rare)
            cut = np.searchsorted(lost, at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(rb.num_rows)), rb.column(0), rb.column(2), pa.array(np.diff(at)), pa.array(own),
                    pa.array([raw[a * w : b * w] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[lost].view(np.int64))),
                ],
                ["uid", "doc_id", "held_out", "n_tokens", "base", "symbols", "rare"],
            )
            uid += rb.num_rows

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), held_out.alias("held_out"))
    return d.mapInArrow(task, "uid long, doc_id long, held_out boolean, n_tokens long, base double, symbols binary, rare array<long>")


def sequences(batches, column: str, kind, limit: int = STEP_BYTES // 3):
    """Yields (batch slice, symbols, offsets) of many sequences at once, about ``limit`` bytes of
    symbols (a longer sequence is a step of its own)."""
    held, size = [], 0
    for rb in batches:
        _, offs = common.utf8(rb.column(rb.schema.get_field_index(column)))
        a = 0
        while a < rb.num_rows:
            b = int(np.searchsorted(offs, offs[a] + limit - size, side="right")) - 1
            b = min(max(b, a if held else a + 1), rb.num_rows)
            if b > a:
                held.append(rb.slice(a, b - a))
                size += int(offs[b] - offs[a])
            if b < rb.num_rows:
                yield from _joined(held, column, kind)
                held, size = [], 0
            a = b
    if held:
        yield from _joined(held, column, kind)


def _joined(held, column, kind):
    rb = pa.Table.from_batches(held).combine_chunks().to_batches()
    for b in rb:
        raw, offs = common.utf8(b.column(b.schema.get_field_index(column)))
        w = np.dtype(kind).itemsize
        yield b, np.frombuffer(raw.tobytes(), kind).astype(np.int64), offs // w


def fit(rows: DataFrame, codes: Codes, states: int = STATES, passes: int = PASSES, init_rows: int = INIT_ROWS, init_passes: int = INIT_PASSES) -> Hmm:
    """Trains on the rows that are not held out.  The starting point comes from texts drawn
    by a hash of id and text (equal ones once); every pass after it sees all training rows."""
    spark = rows.sparkSession
    # a task a core: what a task sums up is as large as the model, however little it reads
    train = rows.where("not held_out").select("uid", "symbols").coalesce(max(1, spark.sparkContext.defaultParallelism))
    kind = np.uint16 if len(codes.h) < 1 << 16 else np.uint32
    n, n_tokens = rows.where("not held_out").agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    part = int(min(1.0, init_rows / max(n, 1)) * (1 << 30))
    drawn = rows.where("not held_out").where(F.pmod(F.xxhash64(F.lit("hmm"), "doc_id", "symbols"), F.lit(1 << 30)) < part)
    sample = sorted(bytes(r["symbols"]) for r in drawn.select("symbols").distinct().toLocalIterator())
    model = initial(codes.share, states, [np.frombuffer(x, kind).astype(np.int64) for x in sample], init_passes)
    size = len(codes.share)

    def added(table):
        sums = sum(np.frombuffer(x, "<f4").astype(float) for x in table["sums"].to_pylist())
        return pa.table({"at": table["at"][:1], "sums": pa.array([sums.astype("<f4").tobytes()], pa.binary())})

    before = None
    for _ in range(passes if n else 0):
        # training runs in single precision, scores do not
        shared = spark.sparkContext.broadcast(Hmm(*(x.astype(np.float32) for x in model)))

        def task(batches, shared=shared):
            model = shared.value
            total = np.zeros((states, size + 2 + states))  # emissions, starts, moves, likelihood
            for _, symbols, offs in sequences(batches, "symbols", kind):
                first, moves, loglik = expected(model, symbols, offs, total[:, :size])
                total[:, size] += first
                total[:, size + 1 : -1] += moves.T
                total[0, -1] += loglik
            for i in range(0, total.shape[1], SLICE):
                part = total[:, i : i + SLICE]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.astype("<f4").tobytes()], pa.binary())], ["at", "sums"])

        got = train.mapInArrow(task, "at long, sums binary").groupBy("at").applyInArrow(added, "at long, sums binary").toLocalIterator()
        total = np.zeros((states, size + 2 + states))
        for r in got:
            part = np.frombuffer(bytes(r["sums"]), "<f4").reshape(states, -1)
            total[:, r["at"] : r["at"] + part.shape[1]] = part
        total = total.T
        shared.unpersist()
        common.release(spark)  # the shuffle of this pass, which is as large as the model times the cores
        model = estimate(total[size], total[size + 1 : -1], total[:size], codes.share)
        loglik = float(total[-1, 0]) / max(1, n_tokens)
        if before is not None and loglik - before < GAIN:
            break
        before = loglik
    return model


def listed(rb: pa.RecordBatch, column: str) -> pa.Array:
    """The items of a list column, all rows in a line."""
    return rb.column(rb.schema.get_field_index(column)).flatten()


def apart(symbols: np.ndarray, rare: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of the class in a step (hashes ``h`` in text order), and the symbols with
    each of them as one more symbol after ``rare``."""
    u, at = np.unique(h, return_inverse=True)
    out = symbols.copy()
    out[symbols == rare] = rare + 1 + at
    return u, out


def split(rows: DataFrame, model: Hmm, codes: Codes) -> DataFrame:
    """(h, c, n0, n1, ...): how often each token of the class occurs in training, and its expected
    counts by state in steps of 1 / ``GRAIN``."""
    shared = rows.sparkSession.sparkContext.broadcast(Hmm(*(x.astype(np.float32) for x in model)))
    rare, states = len(codes.h), len(model.start)
    kind = np.uint16 if rare < 1 << 16 else np.uint32
    names = [f"n{i}" for i in range(states)]

    def batches_of(u, n):
        for a in range(0, len(u), 1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 15)]) for x in (u.view(np.int64), *n.T)], ["h", "c", *names])

    def task(batches):
        held, size = [], 0

        def merged():
            u, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.concatenate([x for _, x in held])
            return u, np.stack([np.bincount(at, x, len(u)) for x in n.T], 1).astype(np.int64)

        for rb, symbols, offs in sequences(batches, "symbols", kind):
            h = listed(rb, "rare").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(h):
                continue
            model = shared.value
            u, own = apart(symbols, rare, h)
            emit = np.concatenate([model.emit, np.repeat(model.emit[rare:], len(u), 0)])
            sums = np.zeros((states, len(emit)))
            expected(model._replace(emit=emit), own, offs, sums)
            n = np.rint(sums[:, rare + 1 :].T * GRAIN).astype(np.int64)
            held.append((u, np.column_stack([np.bincount(own, minlength=len(emit))[rare + 1 :], n])))
            size += len(u)
            if size > 1 << 18:
                yield from batches_of(*merged())
                held, size = [], 0
        if held:
            yield from batches_of(*merged())

    train = rows.where("not held_out").select("uid", "symbols", "rare")
    sums = train.mapInArrow(task, ", ".join(f"{x} long" for x in ["h", "c", *names])).groupBy("h")
    return sums.agg(*(F.sum(x).alias(x) for x in ["c", *names]))


class Leanings(NamedTuple):
    """How the states' shares of a token inside the class differ from its smoothed share."""

    usual: np.ndarray  # the class's own split over the states
    rest: np.ndarray  # factors of all tokens seen less than LEAST times, or never
    mass: np.ndarray  # what the shares of every state add up to before they are divided by it

    def factors(self, c, n):
        """One row a token; ``n`` is not a number where the token has no split of its own."""
        own = (n / GRAIN / self.usual + LEAN) / (c[:, None] + LEAN)
        return np.where(np.isnan(own), self.rest, own) / self.mass


def leanings(counted: DataFrame, codes: Codes, states: int) -> Leanings:
    own = F.col("c") >= LEAST
    names = [f"n{i}" for i in range(states)]
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("double")
    got = counted.agg(*(total(x) for x in names), *(total(F.when(~own, F.col(x))) for x in names)).first()
    everywhere, others = np.array(got[:states]) / GRAIN + 1e-3, np.array(got[states:]) / GRAIN
    usual = everywhere / everywhere.sum()
    rest = (others + LEAN * usual) / (others.sum() + LEAN) / usual
    share = (F.col("c") + F.lit(SMOOTH)) / F.lit(codes.weight)
    factor = [(F.col(x) / F.lit(float(u * GRAIN)) + F.lit(LEAN)) / (F.col("c") + F.lit(LEAN)) for x, u in zip(names, usual)]
    got = counted.where(own).agg(total(share), *(total(share * f) for f in factor)).first()
    return Leanings(usual, rest, np.array(got[1:]) + (1 - got[0]) * rest)


def score(docs: DataFrame, held_out, states: int = STATES, passes: int = PASSES, vocab: int = VOCAB, table: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows where ``held_out`` is false.  Null text is empty: its
    one token is the end.  Rows that repeat an id, or have none, are scored apart.
    Without training rows every token is unknown.  A text of any length is scored
    whole.  Tokens of equal count are ranked by their hash.  Other columns, whatever
    their names, are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.tune(spark)
    known = most_frequent(common.staged(counts(docs.where(~held_out)), "counts"), table)
    codes = coded(known, vocab)
    # by length, so that the sequences of a step end together
    rows = common.staged(encoded(docs, held_out, known, codes).sortWithinPartitions("n_tokens"), "symbols")
    common.release(spark)
    model = fit(rows, codes, states, passes)
    counted = common.staged(split(rows, model, codes), "split")
    lean = leanings(counted, codes, states)
    common.release(spark)
    rare = len(codes.h)
    kind = np.uint16 if rare < 1 << 16 else np.uint32
    names = [f"n{i}" for i in range(states)]
    shared = spark.sparkContext.broadcast(model)
    weight, train, unseen = codes.weight, known.total, known.total + SMOOTH * (known.distinct + 1)

    def task(batches):
        for rb, symbols, offs in sequences(batches, "symbols", kind):
            h = listed(rb, "rare").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            met = listed(rb, "met")
            keys, first = np.unique(met.field("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_index=True)
            u, own = apart(symbols, rare, h)
            at = find(keys, u)
            column = lambda x: np.append(met.field(x).to_numpy(zero_copy_only=False).astype(float)[first], np.nan)[at]  # noqa: E731, B023
            c = np.nan_to_num(column("c"))
            factors = lean.factors(c, np.stack([column(x) for x in names], 1))
            emit = np.concatenate([shared.value.emit, shared.value.emit[rare:] * factors])
            log = forward(shared.value._replace(emit=emit), own, offs) / np.log(10.0)
            lost = own > rare
            seq = np.repeat(np.arange(rb.num_rows), np.diff(offs))[lost]
            total = lambda v: np.bincount(seq, v[own[lost] - rare - 1], rb.num_rows)  # noqa: E731, B023
            unknown = total((c == 0).astype(float)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(rb.column(rb.schema.get_field_index(x)) for x in ("doc_id", "held_out", "n_tokens")),
                    pa.array(np.diff(offs) - unknown), pa.array(np.full(rb.num_rows, train)), pc.add(rb.column(rb.schema.get_field_index("base")), pa.array(total(np.log10((c + SMOOTH) / unseen)))),
                    pa.array(log + total(np.log10((c + SMOOTH) / weight))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    words = counted.select("h", "c", *(F.when(F.col("c") >= LEAST, F.col(x)).alias(x) for x in names))
    met = rows.select("uid", F.explode(F.array_distinct("rare")).alias("h")).join(words, "h").groupBy("uid").agg(F.collect_list(F.struct("h", "c", *names)).alias("met"))
    whole = rows.join(met, "uid", "left").sortWithinPartitions("n_tokens")
    return whole.mapInArrow(
        task, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op10_hmm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, common.fold_of("doc_id", 10) == 0)
