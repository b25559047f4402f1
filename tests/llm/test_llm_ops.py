"""The training-data operators against brute force, and on awkward tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qanat.llm import (
    chunking, common, components, decontamination, fm_index, ftrl, hmm, langid, mixing, near_dup, sharding, substring_dedup, token_files, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [a + b for a in "ba ke lo mi ru sta the".split() for b in "ba ke lo mi ru sta the".split()]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def awkward(spark, extra=True):
    """Nulls, empties, blanks, a very long text, repeated rows, copies, and clashing column names."""
    rng = random.Random(7)
    base = sentence(rng, 60)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "b"), (4, "?!... 12", "en", None), (5, base, "en", "a"), (6, base, "en", "a"), (6, base, "en", "a"),
        (7, sentence(rng, 40_000), "en", "a"), (8, "naïve Ünïcode ñandú — «œuvre» 🎉 " + sentence(rng, 30), "fr", "c"), (None, base, "en", "a"), (None, None, None, None), (9, "x", "es", "b"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    if extra:
        for c in ("size", "shard", "SLOT", "taken", "target", "key", "rep", "band", "score", "name", "held_out"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def synthetic(spark, n=160, seed=1):
    """Prose with exact copies, edited copies and passages shared across documents."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 160)) for _ in range(n)]
    passage = sentence(rng, 55)
    for i in range(0, n, 9):
        texts[i] = texts[i] + "  " + passage + "\n" + sentence(rng, 5)
    for i in range(5, n, 11):
        texts[i] = texts[i - 5]
    for i in range(7, n, 13):
        w = texts[i - 7].split()
        if len(w) > 60:
            w[len(w) // 2] = "edited"
        texts[i] = " ".join(w)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


# ---- chunk store


def test_gear_is_the_rolling_hash():
    data = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    x, want = 0, []
    for b in data:
        x = ((x << 1) + int(chunking.GEAR[b])) & 0xFFFFFFFF
        want.append(x)
    assert chunking.gear(data).tolist() == want


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 256, 200_000).astype(np.uint8)
    shifted = np.concatenate([rng.integers(0, 256, 777).astype(np.uint8), body])
    pieces = []
    for d in (body, shifted):
        ends = chunking.cuts(d, np.array([0, len(d)]))[0]
        assert ends[-1] == len(d) and all(b - a <= chunking.MOST for a, b in zip([0, *ends], ends))
        assert all(b - a >= chunking.LEAST for a, b in zip([0, *ends], ends[:-1]))
        pieces.append({hashlib.sha256(d[a:b]).digest() for a, b in zip([0, *ends], ends)})
    assert len(pieces[0] & pieces[1]) >= len(pieces[0]) - 2


def media(text):
    raw = (text or "").encode()
    n = max(1, -(-len(raw) // 576)) * 576
    return len(raw), raw + b"\xff" * (n - len(raw))


@pytest.mark.parametrize("hot", [chunking.HOT_LISTS, 1])
def test_chunk_round_trip(spark, monkeypatch, hot):
    monkeypatch.setattr(chunking, "HOT_LISTS", hot)
    docs = awkward(spark)
    texts = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    got = chunking.store_and_read(docs).collect()
    want = collections.Counter()
    for (i, t), c in texts.items():
        n, p = media(t)
        want[i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += c
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert max(r.n_chunks for r in got) > 3
    assert chunking.store_and_read(empty(spark)).count() == 0


def test_media_is_what_the_store_holds(spark):
    """The media columns against frames made here, chunk by chunk; the stream decompresses to the payload."""
    import zstandard

    rng = random.Random(13)
    texts = [sentence(rng, n) for n in (0, 5, 3000, 30_000)] + [None, "naïve 🎉"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in chunking.store_and_read(docs).collect()}
    pack = zstandard.ZstdCompressor(level=chunking.LEVEL)
    for i, t in enumerate(texts):
        _, p = media(t)
        ends = chunking.cuts(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0]
        frames = b"".join(pack.compress(p[a:b]) for a, b in zip([0, *ends], ends))
        r = got[i]
        assert (r.media_bytes, r.media_sha256, r.n_chunks) == (len(frames), hashlib.sha256(frames).hexdigest(), len(ends))
        assert b"".join(zstandard.ZstdDecompressor().stream_reader(frames, read_across_frames=True).readall() for _ in [0]) == p
        c = collections.Counter(p)
        top = min(b for b in c if c[b] == max(c.values()))
        assert r.feature == f"chunks={len(ends)};sum={sum(p)};distinct={len(c)};mode={top}"


def test_text_beyond_a_block(spark):
    """A document longer than a block of its own goes through every reader whole."""
    rng = random.Random(14)
    long = " ".join([sentence(rng, 1000)] * (common.BLOCK_BYTES // 4000))
    assert len(long) > common.BLOCK_BYTES
    item = sentence(rng, 50)
    docs = spark.createDataFrame([(1, long + " " + item, "en", "s", 0), (2, long + " " + item, "en", "s", 0), (3, item, "en", "s", 0)], SCHEMA)
    n, p = media(long + " " + item)
    got = {r.doc_id: r for r in chunking.store_and_read(docs).collect()}
    assert (got[1].n_bytes, got[1].payload_sha256) == (n, hashlib.sha256(p).hexdigest())
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matches(docs, b).collect()} == {1, 2, 3}
    assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == {1: 1, 2: 1, 3: 3}
    cut = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    assert cut[1].n_words == len(long.split()) + 50 and cut[1].n_removed == 0 and cut[2].n_removed == cut[2].n_words and cut[3].n_removed == 50
    lang = {r.doc_id: r for r in langid.predict(docs, None).collect()}
    assert len(lang) == 3 and len(toxicity.score(docs, np.zeros(1 << toxicity.BITS, np.float32), 0.0).collect()) == 3
    size = {r.doc_id: r["size"] for r in mixing.shares(docs).collect()}
    assert size == {1: cut[1].n_words, 2: cut[2].n_words, 3: 50}


INNER = ["__s", "__b", "__bin", "__source", "__shard", "__mark", "__end", "__id", "__at", "__w", "c0", "c1", "bin", "base", "at", "n", "fin", "mark", "m", "q", "times", "copy", "id", "row"]


@pytest.mark.parametrize("stage", [sharding.shard, mixing.mix, mixing.mixed, near_dup.survivors])
def test_names_cannot_clash(spark, stage):
    """Input columns named like inner ones, and a map column, come out as they went in."""
    docs = awkward(spark, extra=False)
    for c in INNER:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    docs = docs.withColumn("facts", F.create_map(F.lit("k"), F.col("doc_id")))
    out = stage(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == c + str("-" if r.doc_id is None else r.doc_id) for r in rows for c in INNER) and all(r.facts == {"k": r.doc_id} for r in rows)


# ---- sharding


def test_shard_moves_only_to_the_new_one(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard(docs, bin_rows=16).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    n = collections.Counter(r.shard for r in rows)
    assert set(n) == set(range(16)) and max(n.values()) < 1.35 * 250
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    moved = sum(r.grown_shard == 16 for r in rows)
    assert 0.7 * 4000 / 17 < moved < 1.3 * 4000 / 17
    heavy = collections.Counter(r.shard for r in sharding.shard(docs, weights=(1.0, 3.0, 0.0)).collect())
    assert heavy[2] == 0 and 2.6 < heavy[1] / heavy[0] < 3.5
    with pytest.raises(ValueError):
        sharding.shard(docs, weights=(0.0,))


def test_shard_is_the_least_bid(spark):
    """Shards and grown shards from draws made here with another implementation of the hash."""
    import struct

    import xxhash

    weights = (1.0, 2.0, 0.5, 0.0, 3.0)
    keys = [*range(300), None]
    docs = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")

    def bid(key, i, w):
        h = xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(b"" if key is None else str(key).encode(), 42))
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / w

    for r in sharding.shard(docs, weights, grown_weight=1.5).collect():
        for got, ws in ((r.shard, weights), (r.grown_shard, (*weights, 1.5))):
            assert got == min((bid(r.doc_id, i, w), i) for i, w in enumerate(ws) if w > 0)[1]


def test_hot_key_is_spread(spark):
    """Rows that share a key, and rows without one, have slots without gaps and many bins."""
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    rows = sharding.shard(docs, bin_rows=16).collect()
    for n in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == n)
        assert slots == list(range(len(slots)))


def test_shard_awkward(spark):
    docs = awkward(spark)
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert len({r.shard for r in got if r.doc_id == 6}) == 1 and len({r.slot for r in got if r.doc_id == 6}) == 2
    assert sharding.shard(empty(spark)).count() == 0


# ---- language identification


def languages(spark, n=240):
    rng = random.Random(3)
    stems = {"aa": "ba be bi bo".split(), "bb": "ksch tz pfe ung".split(), "cc": "ción ñe lla rr".split()}
    rows = []
    for i in range(n):
        lang = list(stems)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_language_held_out(spark):
    docs = languages(spark)
    model = langid.train(docs, common.fold_of("doc_id", 3) != 1)
    got = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(common.fold_of("doc_id", 3) == 1).collect()
    assert len(got) > 50 and all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in got)
    # more rows, other ids and other labels of unseen rows change no prediction
    again = langid.predict(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"), model)
    a = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.predict(docs, model).collect()}
    assert a == {r.doc_id - 1000: (r.lang_pred, round(r.score, 6)) for r in again.collect()}


def test_document_frequencies(spark):
    docs = languages(spark, 40)
    langs = ["aa", "bb", "cc", "none"]
    df, n = langid.document_frequencies(docs, langs)
    want = np.zeros((4, langid.DIMS), int)
    for r in docs.collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        (_, m, _), = langid.counts(raw, np.array([0, len(raw)]))
        want[langs.index(r.lang)] += m[0] > 0
    assert n.tolist() == [14, 13, 13, 0] and (df == want).all()


def test_language_unknown_is_rejected(spark):
    """What no learned language knows goes, whatever their number; short and numeric texts stay."""
    unknown = {
        "ru": "Быстрая лиса прыгает через ленивую собаку", "zh": "快速的棕色狐狸跳过了懒狗然后跑进森林", "el": "η γρήγορη αλεπού πηδάει πάνω από το σκυλί",
        "junk": "xqv jzzk wpqx vvqx kqzx jjwq zxvk qqxj", "none": "12 345 !!",
    }
    clean = {"short": "Ba.", "name": "Kschtz", "number": "ba 12 345 678 2,00 (9)", "own": "kschtzpfe ungungtz babobi", "odd": "Zq."}
    learned = languages(spark, 600)
    for langs in (["aa", "bb", "cc"], ["bb", "aa"], ["aa", "cc"]):
        few = learned.where(F.col("lang").isin(*langs))
        # a language of few documents keeps its own, however many the others have
        few = few.where((F.col("lang") != langs[0]) | (F.col("doc_id") < 60))
        model = langid.train(few, F.lit(True))
        texts = spark.createDataFrame([(k, t) for k, t in (unknown | clean).items()], "doc_id string, text string")
        want = set(clean) - ({"name", "own"} if "bb" not in langs else set()) - ({"short", "number"} if "aa" not in langs else set())
        got = {r.doc_id for r in langid.accepted(texts, model).collect()}
        assert want <= got and not got & set(unknown)
        assert langid.accepted(few, model).count() == few.count()
        # the rule recomputed from the plain definition
        df, n = langid.document_frequencies(few, model.langs)
        pred = {r.doc_id: r.lang_pred for r in langid.predict(texts, model).collect()}
        for r in texts.collect():
            ok, grams = plain_grams(r.text)
            if ok:
                k = model.langs.index(pred[r.doc_id])
                held = [(c, (df[k, f] + 0.5) / (n[k] + 1)) for f, c in grams.items() if f not in plain_grams("   ")[1]]
                share = 10 ** (sum(c * np.log10(x) for c, x in held) / (sum(c for c, _ in held) + langid.PRIOR))
                assert (share >= langid.MIN_SHARE) == (r.doc_id in got)


def test_language_awkward(spark):
    docs = awkward(spark)
    model = langid.train(docs, F.lit(True))
    rows = langid.predict(docs, model, ("source",)).collect()
    assert len(rows) == docs.count() and rows[0].source is None
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3, 4))
    assert all(r.lang_pred != "und" and 0 <= r.score <= 1 for r in rows if r.doc_id in (5, 6, 7, 8))
    assert langid.train(empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = langid.accepted(docs, model, 0.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, 8, 9, None}


def plain_grams(text):
    """Folded characters of a text and its hashed bigrams and trigrams, one by one."""
    c = [ord(x.lower()) if x.isalpha() and len(x.lower()) == 1 else ord(x) if x.isalpha() else 0x20 for x in text]
    u, out = 0xFFFFFFFF, collections.Counter()
    two = [(a * 0x9E3779B1 + b * 0x85EBCA6B) & u for a, b in zip(c, c[1:])]
    three = [(((x ^ (x >> 15)) * 0xC2B2AE35) + z * 0x27D4EB2F) & u for x, z in zip(two, c[2:])]
    for x in two + three:
        out[(((x ^ (x >> 13)) * 0x165667B1) & u) >> (32 - langid.BITS)] += 1
    if len(c) == 1:
        out[c[0] % langid.DIMS] = 1
    return any(x != 0x20 for x in c), out


def test_language_predictions_one_by_one(spark):
    """Every prediction of a trained model recomputed feature by feature, ties included."""
    rng = random.Random(15)
    words = {k: [k + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(30)] for k in ("de", "en", "fr")}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 60))), k, "s", 0) for i in range(240) for k in [rng.choice(list(words))]]
    rows += [(900, "ÄÖ é 12", "de", "s", 0), (901, "x", None, "s", 0), (902, "", None, "s", 0), (903, None, None, "s", 0), (904, "123", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, common.fold_of("doc_id", 3) != 1)
    assert model.langs == ["de", "en", "fr"]
    flat = model._replace(weights=np.zeros_like(model.weights), bias=np.zeros(3, np.float32))  # all equal: the lesser language
    for m in (model, flat):
        got = {r.doc_id: r for r in langid.predict(docs, m).collect()}
        for i, t, *_ in rows:
            letter, grams = plain_grams(t or "")
            if not letter:
                assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
                continue
            x = {f: n * float(m.idf[f]) for f, n in grams.items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            z = [(sum(v * float(m.weights[f, k]) for f, v in x.items()) / norm + float(m.bias[k])) / m.temperature for k in range(3)]
            e = [math.exp(v - max(z)) for v in z]
            assert got[i].score == pytest.approx(max(e) / sum(e), rel=1e-3)
            assert got[i].lang_pred == m.langs[e.index(max(e))] or max(e) - sorted(e)[-2] < 1e-4


def test_calibration():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 4000)
    logits = 6.0 * np.eye(3)[np.where(rng.random(4000) < 0.8, y, rng.integers(0, 3, 4000))]
    t = langid.calibrate(logits, y)
    p = langid._probabilities(logits, t).max(1).mean()
    assert t > 1.5 and abs(p - (logits.argmax(1) == y).mean()) < 0.03
    assert langid.calibrate(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_ftrl_l1_is_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 500, 20)), None, None) for _ in range(400)]
    rows = [(x, np.ones(len(x)), np.array([float(7 in x or 8 in x)])) for x, *_ in rows]
    fits = [ftrl.Ftrl(500, l1=x, alpha=1.0).fit(rows, 4).weights()[0][:, 0] for x in (0.5, 3.0, 6.0)]
    assert all(set(np.argsort(w)[-2:]) == {7, 8} for w in fits)
    assert np.count_nonzero(fits[0]) > 2 * np.count_nonzero(fits[1]) > 4 * np.count_nonzero(fits[2])


# ---- near duplicates


def bag(text):
    w = (text or "").encode().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(x, y):
    return sum(1 / sum(max(x[e] / x[k], y[e] / y[k]) for e in x.keys() | y.keys()) for k in x.keys() & y.keys())


def brute_classes(rows):
    ids = sorted({i for i, *_ in rows if i is not None})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    known = [(i, t or "", bag(t)) for i, t, *_ in rows if i is not None]
    for a, (i, t, x) in enumerate(known):
        for j, u, y in known[:a]:
            if top(i) != top(j) and (t == u or (x.keys() & y.keys() and similarity(x, y) >= 0.8)):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return {i: top(i) for i in ids}


def test_probability_jaccard():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 40, 25)).astype(np.uint64) for _ in range(2))
        x, y = rng.integers(1, 6, len(a)), rng.integers(1, 6, len(b))
        want = similarity(collections.Counter(dict(zip(a.tolist(), x.tolist()))), collections.Counter(dict(zip(b.tolist(), y.tolist()))))
        assert near_dup.probability_jaccard(a, x, b, y) == pytest.approx(want)
        sig = near_dup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.concatenate([x, y]), 2, 3000)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.05


@pytest.mark.parametrize("small", [near_dup.SMALL, 1])
def test_near_dup(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    rows, docs = synthetic(spark)
    assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == brute_classes(rows)


def test_near_dup_large_group(spark):
    """Edited copies of one text: more than a small bucket holds."""
    rng = random.Random(2)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("cell", [512, 7])
def test_near_dup_families_in_a_bucket(spark, monkeypatch, cell):
    """One large bucket of several families, of which the central nodes show two at most:
    every pair of the bucket is compared or is of one class already."""
    monkeypatch.setattr(near_dup, "CELL", cell, raising=False)
    monkeypatch.setattr(near_dup, "band_keys", lambda sig: np.tile(np.arange(near_dup.BANDS), (len(sig), 1)))
    rng = random.Random(3)
    rows = []
    for f in range(5):
        base = sentence(rng, 60).split()
        for i in range(12 if f % 2 else 7):
            w = list(base)
            w[rng.randrange(60)] = f"e{rng.random()}"
            if i > 8:
                w[5:15] = w[:10]  # repeated shingles
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_classes(rows)


def test_near_dup_awkward(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dup.classes(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute_classes(rows)
    assert all(r.class_id is None for r in got if r.doc_id is None)
    assert near_dup.classes(empty(spark)).count() == 0
    kept = near_dup.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 7, 8, 9]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    got = {r.id: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: top(i) for a, b in links if a != b for i in (a, b)}


# ---- substring dedup


def brute_removed(rows, n=13):
    first = {}
    words = [((t or "").encode().split(), i) for i, t, *_ in rows]
    for w, i in words:
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                first[key] = min(first.get(key, i), i)
    out = collections.Counter()
    for w, i in words:
        stay = [True] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                stay[k : k + n] = [False] * n
        out[i, len(w), stay.count(False), b" ".join(x for x, s in zip(w, stay) if s).decode()] += 1
    return out


@pytest.mark.parametrize("hot, route, shard", [(substring_dedup.HOT, substring_dedup.ROUTE_BYTES, substring_dedup.SHARD_BYTES), (1, substring_dedup.ROUTE_BYTES, 500), (1, 1, 5000)])
def test_substring_dedup(spark, hot, route, shard):
    for rows, docs in (synthetic(spark), ([(r.doc_id, r.text) for r in awkward(spark).collect()], awkward(spark))):
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs, hot, route, shard).collect())
        assert got == brute_removed(rows)
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_substring_shards_are_bounded(spark, monkeypatch):
    """One passage in every document, each time in another context: its anchor is split until
    no anchor holds more than the bound, and no shard is much larger than its own."""
    rng = random.Random(12)
    line = sentence(rng, 13)
    rows = [(i, " ".join([f"a{i}b{rng.random()}", line, f"c{i}d{rng.random()}", *(f"u{rng.random()}" for _ in range(8))])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = {}

    def spy(distinct, shards):
        own = distinct.groupBy("route").agg(F.sum(F.octet_length("words")).alias("n")).agg(F.max("n"), F.sum("n")).first()
        seen.update(route=own[0], total=own[1], shards=shards)
        return real(distinct, shards)

    real = substring_dedup.searched
    monkeypatch.setattr(substring_dedup, "searched", spy)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs, 16, 4000, 20_000).collect())
    assert got == brute_removed(rows)
    assert 0 < seen["route"] <= 4000 and seen["total"] <= 20_000 * seen["shards"]


def test_fm_index():
    """Matching statistics of the indexed text and of a streamed one against brute force."""
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 5, 400), 0)
    owner = rng.integers(0, 50, 401)
    index = fm_index.FmIndex(text, 6, owner)
    s = text.tolist()
    other = np.concatenate([text[50:90], rng.integers(1, 5, 60), [-1], text[200:230]])
    for stream, least in ((text[:-1], 2), (other, 1)):
        for limit in (1, 2, 5, 13):
            ends = np.arange(limit, len(stream) + 1)
            size, lo, hi = index.matching(stream, ends, limit, least)
            q = stream.tolist()
            places = lambda e, n: [j for j in range(len(s) - n + 1) if s[j : j + n] == q[e - n : e]]
            for e, n, a, b in zip(ends.tolist(), size.tolist(), lo.tolist(), hi.tolist()):
                found = places(e, n) if n else []
                assert n == 0 or len(found) >= least and sorted(index.owner[a:b].tolist()) == sorted(owner[found].tolist())
                assert n == limit or len(places(e, n + 1)) < least
            hit = size > 0
            if hit.any():
                assert index.least_owner(lo[hit], hi[hit]).tolist() == [index.owner[a:b].min() for a, b in zip(lo[hit], hi[hit])] or limit > 1


def test_wavelet_rank():
    v = np.random.default_rng(0).integers(0, 11, 777)
    w = fm_index.Wavelet(v, 11)
    i = np.arange(0, 778, 7)
    for s in range(11):
        sym = np.full(len(i), s)
        assert (w.ends(sym, i) - w.ends(sym, np.zeros(len(i), int))).tolist() == [int((v[:k] == s).sum()) for k in i]


# ---- decontamination


def edits(a, b):
    """Least edits of ``a`` against any part of ``b``."""
    row = list(range(len(a) + 1))
    best = row[-1]
    for c in b:
        new = [0]
        for k, d in enumerate(a):
            new.append(min(row[k] + (c != d), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_is_the_alignment(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnop"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 60)))) for i in range(8)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(5, 60))]
        t = list(items[i % 8][1][rng.randint(0, 40) if i % 5 == 0 else 0 :])
        for _ in range(i % 13 if i % 3 else 0):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        docs.append((i, " ".join(w[:10]) + (" " + "".join(t) + ", " if i % 4 else " ") + " ".join(w[10:]), "en", "s", 0))
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(d, b).collect()}
    want = set()
    fold = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    for i, t, *_ in docs:
        for j, u in items:
            x = fold(u)
            starts = sorted({*range(0, max(len(x) - 120, 0) + 1, 60), max(len(x) - 120, 0)})
            for s in starts:
                part = x[s : s + 120]
                if edits(part, fold(t)) <= int(decontamination.ERROR * len(part)):
                    want.add((i, j))
    assert got == want and 20 < len(want) < 60
    clean = {r.doc_id for r in decontamination.clean(d, b).collect()}
    assert clean == set(range(60)) - {i for i, _ in want}


def test_decontamination_from_every_start(spark):
    """Excerpts off the grid of segments, whole and with edits, are found; shorter ones are not."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, text(400)) for i in range(3)]
    docs, want = [], set()
    for i in range(120):
        a, size, edited = rng.randrange(260), rng.choice([100, 120, 121, 130, 140]), rng.choice([0, 0, 5, 10, 14])
        t = list(items[i % 3][1][a : a + size])
        for k in rng.sample(range(len(t)), edited):
            t[k] = rng.choice(["Z", "", t[k] + "y"])
        docs.append((i, text(50) + "".join(t) + text(60), "en", "s", 0))
        x, low = items[i % 3][1], docs[-1][1].lower()
        if min(edits(x[s : s + 120], low) for s in range(max(a - 20, 0), min(a + size - 90, 281))) <= 10:
            want.add((i, i % 3))
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.matches(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and 40 < len(want) < 110
    assert all(r.edits <= 10 and r.n_regions >= 1 for r in rows)
    assert {r.doc_id for r in decontamination.clean(d, b).collect()} == set(range(120)) - {i for i, _ in want}


@pytest.mark.parametrize("held", [decontamination.HITS, 7])
def test_decontamination_short_items(spark, monkeypatch, held):
    """Items of every length with their whole edit budget are found, those with one edit more are not."""
    monkeypatch.setattr(decontamination, "HITS", held)
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    sizes = [10, 11, 12, 14, 18, 25, 38, 49, 59, 80, 100, 119, 120, 150]
    items = [(i, text(n)) for i, n in enumerate(sizes)]
    docs = []
    for i, n in enumerate(sizes):
        for more in (0, 1):
            m = min(n, 120)
            t = list(items[i][1])
            part = rng.sample(range(len(t)), int(decontamination.ERROR * m) + more) if n <= 120 else []
            for k in part:
                t[k] = "7"
            docs.append((2 * i + more, text(40) + "".join(t) + text(30), "en", "s", 0))
    bench = decontamination.build(items)
    raw = [d[1].encode() for d in docs]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    doc, item, e, _ = decontamination.scan(bench, data, offs)
    got = {(d, bench.ids[i][0]) for d, i in zip(doc.tolist(), item.tolist())}
    fold = lambda t: t.lower()
    want = {(d, i) for d, t, *_ in docs for i, x in items if min(edits(x[s : s + 120], fold(t)) for s in range(max(1, len(x) - 119))) <= int(decontamination.ERROR * min(len(x), 120))}
    assert got == want and {(2 * i, i) for i in range(len(sizes))} <= want and len(want) < 2 * len(sizes)


def test_decontamination_tiny_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "Cat!"), (2, "a b"), (3, "...")], "item_id long, text string")
    docs = [(1, "category"), (2, "the cat."), (3, "CAT"), (4, "concat"), (5, "cat-fish"), (6, "a, b"), (7, "xa b"), (8, "x a b")]
    d = spark.createDataFrame([(*x, "en", "s", 0) for x in docs], SCHEMA)
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(d, items).collect()}
    assert got == {(2, 1), (3, 1), (5, 1), (6, 2), (8, 2)}


def test_decontamination_shared_stem(spark, monkeypatch):
    """A stem that all items begin with is one segment; all its items are found with it."""
    monkeypatch.setattr(decontamination, "HITS", 64)
    rng = random.Random(8)
    stem = sentence(rng, 40)
    items = [(i, stem + " " + sentence(rng, 20)) for i in range(30)]
    bench = decontamination.build(items)
    assert max(np.diff(x.owned).max() for x in bench.parts) == 30
    d = spark.createDataFrame([(1, "x " + stem, "en", "s", 0), (2, sentence(rng, 80), "en", "s", 0)], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(d, b).collect()} == {(1, i) for i in range(30)}


def test_bytes_that_are_not_text():
    raw = [b"ab\xff\xfecd", "naïve".encode(), b"\xc3", b"\xa9x", b""]
    codes, at = common.code_points(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(at[:-1], at[1:])] == [x.decode("utf-8", "replace") for x in raw]


def test_gram_hashes():
    c = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint32)
    for q in (1, 2, 3, 7, 8, 10, 12):
        h = decontamination.grams(c, q)
        names = {}
        assert len(h) == 301 - q
        assert all(names.setdefault(tuple(c[i : i + q].tolist()), x) == x for i, x in enumerate(h.tolist()))
        assert len(set(names.values())) == len(names)


def test_decontamination_awkward(spark):
    docs = awkward(spark)
    rng = random.Random(7)
    base = sentence(rng, 60)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, base), (4, base), (None, base)], "item_id long, text string")
    got = decontamination.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, k) for i in (5, 6, None) for k in (4, None)} and all(r.edits == 0 for r in got)
    only = items.where("item_id is null")
    assert {r.doc_id for r in decontamination.clean(docs, only).collect()}.isdisjoint({5, 6})
    assert decontamination.matches(empty(spark), items).count() == 0
    assert decontamination.matches(docs, items.limit(0)).count() == 0
    assert decontamination.clean(docs, items).columns == docs.columns
    assert decontamination.clean(docs, items.limit(0)).count() == docs.count()


def test_benchmark_in_passes(spark):
    rng = random.Random(1)
    items = [(i, sentence(rng, 40)) for i in range(9)]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert [[k for k, _ in run] for run in decontamination.passes(b, 500)] == [[0, 1], [2, 3], [4, 5], [6, 7], [8]] or sum(len(r) for r in decontamination.passes(b, 500)) == 9


# ---- token files


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_token_files(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    docs = awkward(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    parts = token_files.write(docs, tokenizer, str(tmp_path / "t"), rows_per_part=4)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(parts).collect()), key=lambda r: r[0])
    at, want = 0, []
    for i, t in rows:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.read(token_files.write(empty(spark), tokenizer, str(tmp_path / "e"))).count() == 0


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    """A byte-level tokenizer, whose tokens hold white space, and more than one file of few bytes."""
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    enc, tok = token_files.Encoder(path), Tokenizer.from_file(path)
    assert not enc.wordwise and token_files.Encoder(public.path("word_bpe_49k.json")).wordwise
    docs = awkward(spark)
    parts = token_files.write(docs, path, str(tmp_path / "b"), bytes_per_part=20_000)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(parts).collect())
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert got == want and parts.count() > 1


def test_words_encode_like_texts(tokenizer):
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer), token_files.Encoder(tokenizer, memo=500)
    rng = np.random.default_rng(2)
    odd = ["It's,a.b <|endoftext|>,x. J̌a.,É. a,,b ..c İx. ΑΣ. Áb,̈ T.h,E.", "", ",", "x.̸y", "<|STARTOFTEXT|>.", " Abc d.,e"]
    odd += ["".join(rng.choice(list("aAzZ,. \n'éÉİ<|1%́"), 40)) for _ in range(800)]
    for a in range(0, len(odd), 100):
        data, offs = common.utf8(pa.array(odd[a : a + 100]))
        words, count = enc.split(data, offs)
        ids, size = enc.encode(words)
        cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], count])]
        for k, t in enumerate(odd[a : a + 100]):
            assert ids[cut[k] : cut[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


# ---- mixing


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randint(0, 90)), "en", ["a", "a", "a", "b", None, "B"][i % 6], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, block=8, shard_rows=64).collect()
    size = collections.Counter()
    for r in got:
        assert r["size"] == len(r.text.split()) and 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, list(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            free.remove(s)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) < 0.01 * target[s] + 8 * 12
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7), block=8, shard_rows=64).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_sainte_lague(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.choice([0, rng.randint(1, 10_000)]), [0, 1, 7, 100, 1001][g]) for g in range(5) for k in range(1 + 6 * g)]
    got = {(r.g, r.k): r.got for r in mixing.sainte_lague(spark.createDataFrame(rows, "g int, k int, w long, seats long"), ["g"], "k", "w", "seats", "got").collect()}
    for g in range(5):
        parties = [(k, w, n) for h, k, w, n in rows if h == g]
        won = collections.Counter()
        for _ in range(parties[0][2] if any(w for _, w, _ in parties) else 0):
            k = max(parties, key=lambda p: (p[1] / (2 * won[p[0]] + 1), -p[0]))[0]
            won[k] += 1
        if any(w for _, w, _ in parties):
            assert {k: got[g, k] for k, *_ in parties} == {k: won[k] for k, *_ in parties}


def test_mix_ties_do_not_depend_on_row_order(spark):
    """Many rows of one id and one size in two orders: the same rows are taken."""
    rng = random.Random(17)
    rows = [(5, f"{sentence(rng, 29)} u{i}", "en", "s", i) for i in range(40)] + [(i, sentence(rng, 50), "en", "t", 0) for i in range(9)]
    seen = []
    for _ in range(2):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        seen.append(sorted((r.doc_id, r.text, r.taken) for r in mixing.mix(docs, block=8, shard_rows=16).collect()))
        again = collections.Counter((r.doc_id, r["size"], r.taken) for r in mixing.shares(docs, block=8, shard_rows=16).collect())
        assert again == collections.Counter((i, len(t.split()), n) for i, t, n in seen[-1])
    assert seen[0] == seen[1] and len({n for i, _, n in seen[0] if i == 5}) > 1


def test_mix_awkward(spark):
    docs = awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r["size"] for r in got)
    assert all(r["size"] == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert mixing.mix(empty(spark)).count() == 0
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and not rows.where("text is null or trim(text) = ''").count()


# ---- toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        w = sentence(rng, rng.randint(5, 80)).split()
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Vile", "vile", "rotten,"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    w, b = toxicity.train(docs, marks, common.fold_of("doc_id", 3) != 1)
    assert 0 < np.count_nonzero(w) < 200
    got = toxicity.score(docs, w, b).where(common.fold_of("doc_id", 3) == 1).collect()
    hit = [r.predicted == int(r.doc_id % 6 == 0) for r in got]
    assert len(hit) > 250 and sum(hit) / len(hit) > 0.98
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in got)


def plain_hash(values):
    """The polynomial hash of a run, in integers of any size."""
    h, p = 0, 1
    for v in values:
        h, p = (h + v * p) & common.M64, p * common._BASE & common.M64
    h = (h + len(values) * 0xA24BAED4963EE407) & common.M64
    return plain_mix(h)


def plain_mix(h, seed=0):
    h ^= (seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & common.M64
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & common.M64
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & common.M64
    return h ^ (h >> 31)


def test_toxicity_scores_one_by_one(spark):
    """Every score from features made here: words, neighbours and pairs with one word between."""
    import re

    rng = np.random.default_rng(16)
    weights = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    weights[rng.random(len(weights)) < 0.5] = 0
    texts = ["You are SO so so bad, really-bad!", "", None, "x", "naïve ÜBER 9lives", "a b", sentence(random.Random(1), 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    for r in toxicity.score(docs, weights, -0.25).collect():
        raw = (texts[r.doc_id] or "").encode()
        h = [plain_hash([int(common._BYTE[b]) for b in w.lower()]) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        f = set(h) | {plain_mix((a * 3 + b) & common.M64, 1) for a, b in zip(h, h[1:])} | {plain_mix((a * 5 + b) & common.M64, 2) for a, b in zip(h, h[2:])}
        z = -0.25 + sum(float(weights[k]) for k in {x >> (64 - toxicity.BITS) for x in f})
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5) and r.predicted == (r.score >= toxicity.THRESHOLD)


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    marks = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (7, 1, 0), (8, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    w, b = toxicity.train(docs, marks, F.lit(True))
    got = toxicity.score(docs, w, b).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    w, b = toxicity.train(docs, marks.limit(0), F.lit(True))
    assert not w.any() and {r.score for r in toxicity.score(docs, w, b).collect()} == {0.5}
    assert toxicity.score(empty(spark), w, b).count() == 0


# ---- language model


@pytest.mark.parametrize("cut", [hmm.CUT, 1, 3])
def test_forward_is_exact(monkeypatch, cut):
    monkeypatch.setattr(hmm, "CUT", cut)
    rng = np.random.default_rng(3)
    k, v = 3, 7
    m = hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T)
    size = [5, 1, 9, 3, 1, 12]
    offs = np.concatenate([[0], np.cumsum(size)])
    sym = rng.integers(0, v, offs[-1])

    def by_paths(s):
        a = m.start * m.emit[s[0]]
        for x in s[1:]:
            a = a @ m.move * m.emit[x]
        return math.log(a.sum())

    want = [by_paths(sym[a:b]) for a, b in zip(offs[:-1], offs[1:])]
    assert np.allclose(hmm.forward(m, sym, offs), want)
    emit = np.zeros(m.emit.shape[::-1])
    first, moves, total = hmm.expected(m, sym, offs, emit)
    assert np.allclose([first.sum(), moves.sum(), emit.sum(), total], [6, sum(n - 1 for n in size), offs[-1], sum(want)])
    seen = []
    for _ in range(6):
        emit = np.zeros(m.emit.shape[::-1])
        first, moves, total = hmm.expected(m, sym, offs, emit)
        seen.append(total)
        m = hmm.estimate(first - 0.1, moves - 0.1, emit.T, np.full(v, 1 / v), 1e-9)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))


@pytest.mark.parametrize("table", [hmm.TABLE, 8])
def test_base_scores(spark, table):
    rows, docs = synthetic(spark, 120)
    rows += [(r.doc_id, r.text) for r in awkward(spark).collect()]
    docs = docs.select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    got = collections.Counter()
    for r in hmm.score(docs, common.fold_of("doc_id", 10) == 0, states=2, passes=1, vocab=min(table, 64), table=table).collect():
        assert r.score <= 0 and math.isfinite(r.score)
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)] += 1
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    toks = [(i, [*(t or "").encode().translate(lower).split(), None], zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0) for i, t, *_ in rows]
    c = collections.Counter(w for _, ws, held in toks if not held for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, ws, held in toks:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want[i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(base, 5)] += 1
    assert got == want


def test_score_column_is_the_forward_recursion(spark, monkeypatch):
    """``score`` of the whole operator, recomputed token by token from the model it trained."""
    kept = {}
    real_fit, real_coded = hmm.fit, hmm.coded
    monkeypatch.setattr(hmm, "fit", lambda *a, **k: kept.setdefault("model", real_fit(*a, **k)))
    monkeypatch.setattr(hmm, "coded", lambda *a, **k: kept.setdefault("codes", real_coded(*a, **k)))
    rows = [(i, f"{t} odd{i % 20}") for i, t, *_ in synthetic(spark, 60)[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in hmm.score(docs, common.fold_of("doc_id", 10) == 0, states=3, passes=2, vocab=20, table=30).collect()}
    model, codes = kept["model"], kept["codes"]
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    name = lambda w: int(hmm.END) if w is None else plain_hash([int(common._BYTE[b]) for b in w])
    toks = {i: [*t.encode().translate(lower).split(), None] for i, t, *_ in rows}
    c = collections.Counter(name(w) for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    symbol = {int(h): k for k, h in enumerate(codes.h)}
    rare = [n for h, n in c.items() if h not in symbol]
    assert (codes.rare_total, codes.rare_distinct) == (sum(rare), len(rare)) and len(rare) > 5
    # expected counts by state of every token of the class, token by token
    emission = lambda w: model.emit[symbol.get(name(w), len(symbol))]
    counted = collections.defaultdict(lambda: np.zeros(3))
    for i, ws in toks.items():
        if zlib.crc32(str(i).encode()) % 10:
            ahead, back = [model.start * emission(ws[0])], [np.ones(3)]
            for w in ws[1:]:
                x = (ahead[-1] / ahead[-1].sum()) @ model.move * emission(w)
                ahead.append(x)
            for w in ws[:0:-1]:
                x = model.move @ (emission(w) * back[-1])
                back.append(x / x.sum())
            for w, x, y in zip(ws, ahead, back[::-1]):
                if name(w) not in symbol:
                    counted[name(w)] += x * y / (x * y).sum()
    own = {h for h in counted if c[h] >= hmm.LEAST}
    assert own and len(own) < len(counted)
    usual = sum(counted.values()) / sum(sum(counted.values()))
    others = sum((counted[h] for h in counted if h not in own), np.zeros(3))
    weight = sum(rare) + 0.1 * (len(rare) + 1)
    lean = lambda n: (n + hmm.LEAN * usual) / (n.sum() + hmm.LEAN) * (usual.sum() / usual)
    inside = {h: (c[h] + 0.1) / weight * lean(counted[h] if h in own else others) for h in counted}
    unseen = 0.1 / weight * lean(others)
    mass = sum(inside.values()) + unseen
    for i, ws in toks.items():
        a, total = None, 0.0
        for w in ws:
            e = emission(w) if name(w) in symbol else emission(w) * inside.get(name(w), unseen) / mass
            a = (model.start if a is None else a @ model.move) * e
            total += math.log10(a.sum())
            a = a / a.sum()
        assert got[i].score == pytest.approx(total, rel=1e-4)


def test_extra_columns_do_not_reach_the_model(spark):
    docs = awkward(spark)
    plain = hmm.score(docs.select("doc_id", "text"), common.fold_of("doc_id", 10) == 0, states=2, passes=1).collect()
    clash = hmm.score(docs.withColumn("uid", F.lit(1)).withColumn("symbols", F.lit("x")).withColumn("h", F.lit(2)), common.fold_of("doc_id", 10) == 0, states=2, passes=1).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    assert [tuple(r) for r in sorted(plain, key=key)] == [tuple(r) for r in sorted(clash, key=key)]


def test_model_is_a_distribution():
    """Symbols add up to 1, and so do all tokens of the rare class with one unknown."""
    counts = [9, 7, 5, 4, 3, 2, 1, 1, 2, 2, 2, 2]
    known = hmm.Counted(np.arange(1, 9, dtype=np.uint64), np.array(counts[:8]), sum(counts), len(counts))
    codes = hmm.coded(known, 4)
    assert codes.share.sum() == pytest.approx(1) and codes.rare_distinct == 8
    rare = [c for h, c in enumerate(counts, 1) if h not in codes.h.tolist()]
    assert sum(10 ** codes.inside(c) for c in [*rare, 0]) == pytest.approx(1)


def test_language_model_beats_unigrams(spark):
    docs = languages(spark, 300)
    got = hmm.score(docs, common.fold_of("doc_id", 10) == 0, states=4).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    assert hmm.score(empty(spark), F.lit(False)).count() == 0
    assert all(r.n_known == 0 for r in hmm.score(docs.limit(5), F.lit(True)).collect())


# ---- pipeline


def test_pipeline(spark, tmp_path):
    rows, docs = synthetic(spark, 120)
    rng = random.Random(11)
    leak = sentence(rng, 60)
    more = spark.createDataFrame([(500, leak + " " + sentence(rng, 30), "en", "s0", 0), (501, "12 34 ... ??", "en", "s1", 0), (502, None, None, None, None)], SCHEMA)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    alive = {r.doc_id for r in got}
    classes = brute_classes(rows)
    assert alive <= set(classes.values()) and not alive & {500, 501, 502}
    kept = [r for r in rows if classes[r[0]] == r[0]]
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(kept, SCHEMA)).collect()}
    size = {i: len(t.split()) for i, t, *_ in kept}
    want = {i: int(taken[i] / size[i] + 0.5) for i in taken}
    assert collections.Counter(r.doc_id for r in got) == collections.Counter({i: n for i, n in want.items() if n})
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@pytest.mark.parametrize("stage", range(5))
def test_stages_awkward(spark, tmp_path, stage):
    spark.createDataFrame([(1, "some item that is long enough to be looked for"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, f = corpus_pipeline.STAGES[stage]
    for docs in (awkward(spark), awkward(spark, extra=False), empty(spark)):
        got = f(spark, docs, str(tmp_path))
        if stage < 4:
            assert got.columns == docs.columns
        assert set(docs.columns) - {"size", "shard", "SLOT"} <= set(got.columns)
        n = got.count()
        assert n <= 2 * docs.count()
