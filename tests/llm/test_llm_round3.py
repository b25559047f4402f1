"""Isolation forest, ball k-means and periodic runs against brute force, and on awkward tables."""

import collections
import hashlib
import itertools
import random
import re
import threading
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_ops import VOCAB, awkward, empty, sentence

from qanat.llm import ball_kmeans, common, decontamination, ftrl, hmm, langid, near_dup, periodic_runs, quality_rules, substring_dedup, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = collections.defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def junk(rng, kind, n):
    words = sentence(rng, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["###", "***", "%%%", "&&&"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " | ".join(words)


def test_rule_counts_one_by_one(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 30) + "\n" + sentence(rng, 3) for _ in range(20)]
    texts += ["a b c d e f a b c d e", "x\nx\r\nx\n\n \nx", "é|ü <b> 100% naïve\n\n", "w " * 40, "\n".join(["same line"] * 7), texts[0] + "\n" + texts[0], "\x0b\x0c one\x1cword"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(awkward(spark).select("doc_id", "text"))
    got = collections.Counter((r["doc_id"], *[r[c] for c in quality_rules.COUNTS]) for r in quality_rules.facts(df).collect())
    assert got == collections.Counter((r["doc_id"], *brute_counts(r["text"])) for r in df.collect())


def test_counts_do_not_cross_documents(spark, monkeypatch):
    monkeypatch.setattr(common, "BLOCK_BYTES", 1 << 20)
    df = spark.createDataFrame([(i, "a b c d e") for i in range(9)], "doc_id long, text string").coalesce(1)
    assert {(r["n_repeat_words"], r["n_dup_lines"]) for r in quality_rules.facts(df).collect()} == {(0, 0)}


def brute_path(model, x, root):
    at = root
    while model["f"][at] >= 0:
        at = model["left"][at] + (x[model["f"][at]] >= model["split"][at])
    return model["path"][at]


def test_forest_paths(spark):
    rng = np.random.default_rng(4)
    x = rng.random((60, len(quality_rules.RATES)))
    rows = [(i, 20, 80, 0, 0, 0, *map(float, v)) for i, v in enumerate(x)]
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in quality_rules.COUNTS], *[f"{r} double" for r in quality_rules.RATES]])
    df = spark.createDataFrame(rows, schema)
    model = quality_rules.forest(df, trees=16, sample=32)
    assert len(model["root"]) == 16
    want = [2 ** (-np.mean([brute_path(model, v, r) for r in model["root"]]) / model["mean"]) for v in x]
    assert np.allclose(quality_rules.isolation(model, x), want)
    again = quality_rules.forest(df.repartition(5), trees=16, sample=32)
    assert all(np.array_equal(model[k], again[k]) for k in model)
    # a leaf at the depth limit counts what its rows would need on average
    assert quality_rules.expected_path(2) == 1 and quality_rules.expected_path(1) == 0
    h = sum(1 / i for i in range(1, 256))
    assert abs(float(quality_rules.expected_path(256)) - (2 * h - 2 * 255 / 256)) < 0.01


def test_grow_isolates():
    x = np.concatenate([np.random.default_rng(1).normal(0, 0.1, (60, 2)), [[9.0, 9.0]]])
    depth = []
    for seed in range(40):
        nodes = quality_rules.grow(x, seed, 8)
        f, split, left, path = (np.array(v) for v in zip(*nodes))
        model = {"f": f, "split": split, "left": left, "path": path}
        depth.append((brute_path(model, x[-1], 0), brute_path(model, x[0], 0)))
        rows = [brute_path(model, v, 0) for v in x]
        assert len(rows) == 61 and min(rows) >= 1
    assert np.mean([a for a, _ in depth]) + 2 < np.mean([b for _, b in depth])


def prose(rng, n):
    """Words of which no two neighbours are equal."""
    words = [rng.choice(VOCAB)]
    while len(words) < n:
        words.append(rng.choice([w for w in VOCAB if w != words[-1]]))
    return " ".join(words) + "."


def test_verdicts(spark):
    rng = random.Random(8)
    rows = [(i, junk(rng, i % 3, rng.randint(30, 90)) if i % 8 == 0 else prose(rng, rng.randint(12, 120))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 != 0)) for i in range(0, 900, 2)] + [(None, 0), (4, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    bad = [i for i in range(1, 900) if i % 8 == 0]
    assert sum(not got[i]["kept"] for i in bad) >= 0.95 * len(bad)
    assert sum(got[i]["kept"] for i in range(900) if i % 8) >= 0.985 * 787
    again = {r["doc_id"]: r for r in quality_rules.judge(docs.repartition(7), labels).collect()}
    assert {i: (r["kept"], r["score"]) for i, r in got.items()} == {i: (r["kept"], r["score"]) for i, r in again.items()}


def test_threshold_is_of_all_labelled_rows(spark):
    """More labelled rows than were once kept: the verdicts follow the threshold that all of them give."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("Ab", "cd", "EF", "g!", "h", "ij#", "kl", "mn")) for _ in range(rng.randint(10, 40))) for _ in range(16_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    good = {i: int(rng.random() > 0.02 + 0.6 * (t.count("!") + t.count("#") > 0.36 * len(t.split()))) for i, t in enumerate(texts) if i % 20}
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    got = [r for r in quality_rules.judge(docs, labels).collect() if not r["base_failed"]]
    yes, no = (np.sort([r["score"] for r in got if good.get(r["doc_id"]) == k]) for k in (1, 0))
    cuts = np.unique(no)
    worth = (1 - np.searchsorted(no, cuts) / len(no)) - quality_rules.PRICE * (1 - np.searchsorted(yes, cuts) / len(yes))
    assert len(yes) + len(no) > 12_000 and worth.max() > 0
    cut = cuts[np.argmax(worth)]
    limit = (cut + yes[yes < cut][-1]) / 2
    assert [r["doc_id"] for r in got if r["kept"] != (r["score"] < limit)] == []


def test_quality_awkward(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, None, 0), (None, 1, 1), (8, 1, 0)], none.schema)):
        got = quality_rules.judge(docs, labels).collect()
        assert len(got) == docs.count()
        for r in got:
            want = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            assert r["base_failed"] == want and not (want and r["kept"])
        assert quality_rules.judge(empty(spark), labels).count() == 0
    assert all(r["kept"] or r["base_failed"] for r in quality_rules.judge(docs, none).collect())


def brute_means(rows, k, rounds):
    """rows: (key, vector) of integers."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    c = [list(v) for _, v in order[:k]]
    dist = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    assign = lambda: [min(range(len(c)), key=lambda j: (dist(v, c[j]), j)) for _, v in rows]
    for _ in range(rounds):
        a = assign()
        for j in range(len(c)):
            mine = [v for (_, v), x in zip(rows, a) if x == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    a = assign()
    return sorted((str(key), j, dist(v, c[j])) for (key, v), j in zip(rows, a)), c


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "few"])
def test_ball_k_means(spark, kind):
    rng = np.random.default_rng({"spread": 1, "grid": 2, "copies": 3, "few": 4}[kind])
    n = 5 if kind == "few" else 400
    x = rng.normal(0, 1.5, (n, 64)) + rng.integers(0, 3, (n, 1)) * 4.0
    if kind == "grid":  # many equal distances
        x = rng.integers(0, 2, (n, 64)) / 64.0
        x[:, 3:] = 0
    if kind == "copies":
        x[::3] = x[0]
    ids = [None if i == 7 else i // 2 if i < 20 else i for i in range(n)]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    rows = ball_kmeans.integers(df)
    found, centroids, total = ball_kmeans.cluster(rows, 8 if kind != "few" else 16, 3)
    whole = [(i, [int(c) for c in np.floor(64 * v)]) for i, v in zip(ids, x)]
    want, c = brute_means(whole, 8 if kind != "few" else 16, 3)
    assert sorted((str(r["key"]), r["cluster"], r["distance"]) for r in found.collect()) == want
    assert centroids.tolist() == c
    assert [t[2] for t in total] == [sum(d for _, j, d in want if j == i) for i in range(len(c))]


def test_balls_spare_comparisons():
    rng = np.random.default_rng(5)
    c = np.concatenate([rng.integers(0, 50, (4, 64)) + far for far in (0, 1000, 2000)])
    v = np.repeat(c, 50, 0) + rng.integers(-20, 20, (600, 64))
    cluster, d = ball_kmeans.nearest(v, c)
    radius = [int(np.sqrt(d[cluster == i].max(initial=0))) + 1 for i in range(len(c))]
    balls = ball_kmeans.neighbours(c, radius)
    assert all(set(near // 4) <= {i // 4} for i, (near, _) in enumerate(balls))  # no centroid of another heap
    start = np.repeat(np.arange(12, dtype=np.int32), 50)
    out, best, compared = ball_kmeans.reassigned(v, start, c, ball_kmeans.neighbours(c, [10**6] * 12))
    assert np.array_equal(out, cluster) and np.array_equal(best, d) and compared < 12 * 600
    out, best, fewer = ball_kmeans.reassigned(v, cluster, c, balls)
    assert np.array_equal(out, cluster) and np.array_equal(best, d) and fewer <= compared


def test_vectors_that_do_not_count(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, good[:63]), (4, [*good, 1.0]), (5, [*good[:63], None]), (6, [float("nan"), *good[:63]]), (7, [float("-inf"), *good[:63]]), (8, []), (9, [-0.001, *good[:63]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["key"]: np.frombuffer(bytes(r["v"]), "<i4").tolist() for r in ball_kmeans.integers(df).collect()}
    assert got == {1: [32] * 64, 9: [-1] + [32] * 63}
    none, centroids, _ = ball_kmeans.cluster(ball_kmeans.integers(df.where("vec_id = 2")))
    assert none.count() == 0 and not len(centroids)
    with pytest.raises(Exception, match="do not fit"):
        ball_kmeans.integers(spark.createDataFrame([(1, [1e9] * 64)], df.schema)).collect()


def brute_runs(words):
    """Every maximal stretch of every period, smallest period only."""
    n, out = len(words), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(6, 4 * p):
                part = words[i : i + length]
                if not any(all(part[x] == part[x + q] for x in range(length - q)) for q in range(1, p)):
                    out.add((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_periodic(doc_id, text, rewrite=True):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if rewrite and h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2])) if found else None
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept))


def periodic_texts():
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("ab cd ef".split()) for _ in range(rng.randint(1, 9))]
            parts += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))]
            parts += [rng.choice(VOCAB_SMALL) for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return texts + ["a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "x" + " x" * 999, "a b c d " * 200, ("a " * 40 + "b ") * 30, sentence(rng, 900), "- - - - x " * 50]


VOCAB_SMALL = ["ab", "cd", "ef", "gh", "ij"]


@pytest.mark.parametrize("block", [1 << 22, 1 << 10])
def test_periodic_runs(spark, monkeypatch, block):
    texts = periodic_texts()
    rows = list(enumerate(texts))
    for rewrite in (True, False):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        monkeypatch.setattr(common, "BLOCK_BYTES", block)
        got = sorted(tuple(r) for r in periodic_runs.detect(df, rewrite).collect())
        assert got == sorted(brute_periodic(i, t, rewrite) for i, t in rows)


def test_runs_of_arrays():
    rng = np.random.default_rng(6)
    for _ in range(300):
        w = rng.integers(0, rng.integers(2, 4), rng.integers(0, 80)).astype(np.uint64)
        got = sorted(map(tuple, periodic_runs.runs(w, len(w) // 4).tolist()))
        assert got == sorted(brute_runs(w.tolist()))


def test_long_runs_do_not_take_square_time():
    w = np.ones(200_000, np.uint64)
    assert periodic_runs.runs(w, 50_000).tolist() == [[0, 200_000, 1]]


def test_periodic_awkward(spark):
    docs = awkward(spark)
    key = lambda r: tuple(str(x) for x in r)
    small = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 10_000]
    got = [tuple(r) for r in periodic_runs.detect(docs, rewrite=True).collect()]
    assert len(got) == docs.count()
    want = [brute_periodic(r["doc_id"], r["text"]) for r in small]
    assert sorted((g for g in got if g[0] != 7), key=key) == sorted(want, key=key)
    assert periodic_runs.detect(empty(spark)).count() == 0
    runs = periodic_runs.detect(spark.createDataFrame([(1, "z " + "a b " * 4)], "doc_id long, text string"), listed=True).first()["runs"]
    assert [tuple(r) for r in runs] == [(1, 8, 2)]


def test_runs_of_staging_are_apart(spark):
    """A finished run deletes what it staged, not what another thread stages meanwhile."""
    seen, other = {}, threading.Event()
    began = threading.Event()

    def beside():
        began.wait(60)
        seen["df"] = common.staged(spark.range(5), "beside")
        other.set()

    t = threading.Thread(target=beside)
    t.start()
    with common.Run(spark) as run:
        mine = common.staged(spark.range(3), "mine")
        began.set()
        assert other.wait(60)
        kept = common.staged(mine, "kept")
        run.drop(keep=1)
    t.join()
    assert seen["df"].count() == 5 and kept.count() == 3
    with pytest.raises(Exception):
        mine.count()


def test_nested_runs(spark):
    with common.Run(spark) as outer:
        with common.Run(spark):
            inner = common.staged(spark.range(4), "inner")
        assert inner.count() == 4 and len(outer.made) == 1
        outer.drop()
    with pytest.raises(Exception):
        inner.count()


def test_anchors_of_long_blocks(monkeypatch):
    words = common.mix64(np.random.default_rng(2).integers(0, 50, 500).astype(np.uint64))
    at = np.arange(500 - substring_dedup.WINDOW + 1)
    whole = substring_dedup.least_gram(words, at, substring_dedup.GRAM)
    v = common.mix64(common.gram_hashes(words, substring_dedup.GRAM), 70 + substring_dedup.GRAM)
    monkeypatch.setattr(substring_dedup, "_POS", 6)  # pieces of 51 windows
    pos, h = substring_dedup.least_gram(words, at, substring_dedup.GRAM)
    assert np.array_equal(h >> np.uint64(6), whole[1] >> np.uint64(6)) and np.array_equal(v[pos], h)
    assert ((pos >= at) & (pos <= at + substring_dedup.WINDOW - substring_dedup.GRAM)).all()


def test_languages_learned_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(9)] + [(i + 20, "der hund und die katze " * 3, "de") for i in range(8)] + [(40 + i, "dirty", f"x{i}") for i in range(5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["de", "en"]


def test_least_id_is_not_null(spark, tmp_path):
    import public_tokenizers

    least = -(1 << 63)
    docs = spark.createDataFrame([(least, "one two"), (None, "three"), (None, None), (5, "four")], "doc_id long, text string")
    got = token_files.read(token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/t")).collect()
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == [None, None, least, 5]


def test_ftrl_steps_by_hand():
    """Two steps of one coordinate and the bias, from the published update rule."""
    alpha, beta, l1, l2 = 0.5, 1.0, 0.1, 0.2
    model = ftrl.Ftrl(3, 1, alpha, beta, l1, l2)
    z, n = {1: 0.0, "b": 0.0}, {1: 0.0, "b": 0.0}

    def weight(k):
        free = 0.0 if k == "b" else l1
        return 0.0 if abs(z[k]) <= free else -(z[k] - np.sign(z[k]) * free) / ((beta + np.sqrt(n[k])) / alpha + l2)

    for value, y in ((2.0, 1.0), (-1.0, 0.0), (0.5, 1.0)):
        w = {k: weight(k) for k in z}
        p = 1 / (1 + np.exp(-(w[1] * value + w["b"])))
        for k, x in ((1, value), ("b", 1.0)):
            g = (p - y) * x
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - sigma * w[k]
            n[k] += g * g
        model.step(np.array([1]), np.array([value]), np.array([y]))
        w, b = model.weights()
        assert np.isclose(w[1, 0], weight(1)) and np.isclose(b[0], weight("b")) and w[0, 0] == w[2, 0] == 0


def test_expected_counts_by_enumeration():
    """Baum-Welch counts of short sequences against all paths of states."""
    rng = np.random.default_rng(9)
    start, move, emit = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1, 1, 1], 2).T
    model = hmm.Hmm(start, move, emit)
    seqs = [[0, 2, 1, 1], [2], [1, 0, 0]]
    first, moves, seen, total = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3)), 0.0
    for s in seqs:
        paths = {}
        for path in itertools.product(range(2), repeat=len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= move[path[t - 1], path[t]] * emit[s[t], path[t]]
            paths[path] = p
        whole = sum(paths.values())
        total += np.log(whole)
        for path, p in paths.items():
            first[path[0]] += p / whole
            for t, k in enumerate(path):
                seen[k, s[t]] += p / whole
                if t:
                    moves[path[t - 1], k] += p / whole
    got_emit = np.zeros((2, 3))
    got_first, got_moves, loglik = hmm.expected(model, np.array(sum(seqs, [])), np.cumsum([0, *map(len, seqs)]), got_emit)
    assert np.allclose(got_first, first) and np.allclose(got_moves, moves) and np.allclose(got_emit, seen) and np.isclose(loglik, total)
    again = hmm.estimate(first, moves, seen.T, np.full(3, 1 / 3), prior=0.0)
    assert np.allclose(again.move, (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True)) and np.allclose(again.emit, seen.T / seen.T.sum(0))


def test_memory_of_the_pipelines_tasks_does_not_follow_the_batch(spark, monkeypatch):
    rng = random.Random(23)
    docs = spark.createDataFrame([(i, sentence(rng, 40), "xy"[i % 2] * 2) for i in range(30)], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(i, sentence(rng, 60)) for i in range(3)], "item_id long, text string")
    tasks, real = [], type(docs).mapInArrow

    def seen(self, task, *a, **b):
        tasks.append((task, self.columns))
        return real(self, task, *a, **b)

    monkeypatch.setattr(type(docs), "mapInArrow", seen)
    model = langid.train(docs, F.lit(True))
    langid.predict(docs, model), langid.accepted(docs, model)
    near_dup.described(docs), near_dup.weighted(docs, docs.select(F.col("doc_id").alias("id")))
    decontamination.clean(docs, items), decontamination.matches(docs, items)
    assert len(tasks) == 8

    words = sentence(rng, 900)
    texts = [f"{i} {words[i % 500 :]}" for i in range(2000)]
    whole = {"doc_id": list(range(2000)), "id": list(range(2000)), "text": texts, "lang": ["xx", "yy"] * 1000, "key": [b"k"] * 2000}
    assert sum(map(len, texts)) > 2 * common.BLOCK_BYTES
    for task, columns in tasks:
        few, many = (pa.RecordBatch.from_pydict({c: whole[c][:n] for c in columns}) for n in (2, 2000))
        list(task(iter([few])))
        tracemalloc.start()
        for _ in task(iter([many])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6, (task.__qualname__, peak)
