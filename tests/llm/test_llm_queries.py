"""The registered queries over the smallest tables, whole, against SQL or brute force."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_llm_ops import brute_classes
from test_llm_round3 import brute_counts, brute_periodic

import __spark_entry__ as entry
from qanat.llm import quality_rules, registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DIR}/documents.parquet").to_pandas()


@pytest.fixture(scope="module")
def run(spark):
    found = {}

    def get(name):
        if name not in found:
            found[name] = registry.queries()[name](spark, DIR).toPandas()
        return found[name]

    return get


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in registry.queries()} and set(registry.queries()) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(run, docs, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    key = "vec_id" if name.startswith("op12") else "doc_id"
    got = run(name).sort_values(key).reset_index(drop=True)
    want = c.sql(registry.oracle_sql()[name]).df().sort_values(key).reset_index(drop=True)[got.columns]
    assert got.equals(want)


def test_op1(run, docs):
    got = run("op1_chunked_media").set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        raw, r = t.encode(), got.loc[i]
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_op2(run, docs):
    got = run("op2_rendezvous_sharding").set_index("doc_id")
    assert set(got.law) == {"key"} and set(got.shard) <= set(range(16)) and ((got.grown_shard == got.shard) | (got.grown_shard == 16)).all()
    for i, t in zip(docs.doc_id, docs.text):
        assert (got.loc[i]["size"], got.loc[i].text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_op3(run, docs):
    got = run("op3_language_id").merge(docs, on="doc_id")
    assert (got.held_out == [fold(i, 3) == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.93


def test_op4(run, docs):
    got = run("op4_probminhash_near_dup")
    assert dict(zip(got.doc_id, got.class_id)) == brute_classes(list(zip(docs.doc_id, docs.text)))


def test_op6(run, docs):
    items = pq.read_table(f"{DIR}/benchmark.parquet").to_pandas()
    inside = {(i, k) for i, t in zip(docs.doc_id, docs.text) for k, b in zip(items.item_id, items.text) if b in t}
    got = run("op6_qgram_decontamination")
    assert inside and inside <= set(zip(got.doc_id, got.item_id)) and len(got) <= len(inside) + 2


def test_op7(run, docs):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got, at = run("op7_token_files").set_index("doc_id"), 0
    for i, t in sorted(zip(docs.doc_id, docs.text)):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        r = got.loc[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op9(run, docs):
    got = run("op9_ftrl_toxicity")
    assert len(got) == len(docs) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [fold(i, 3) == 1 for i in got.doc_id]).all()


def test_op10(run, docs):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    toks = {i: [*t.encode().translate(lower).split(), None] for i, t in zip(docs.doc_id, docs.text)}
    c = collections.Counter(w for i, ws in toks.items() if fold(i, 10) for w in ws)
    n, v = sum(c.values()), len(c)
    got = run("op10_hmm_scores").set_index("doc_id")
    for i, ws in toks.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_op11(run, docs):
    got = run("op11_isolation_quality").set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        r = got.loc[i]
        assert tuple(r[list(quality_rules.COUNTS)]) == brute_counts(t)
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    y = pq.read_table(f"{DIR}/labels.parquet").to_pandas().set_index("doc_id").quality
    good = [i for i in y[y == 1].index if not got.loc[i]["base_failed"]]
    assert got.loc[good].kept.mean() > 0.98


def test_op13(run, docs):
    got = run("op13_periodic_runs")
    assert sorted(tuple(None if x != x else x for x in r) for r in got.itertuples(index=False)) == sorted(brute_periodic(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text))


def test_pipeline_query(spark, docs):
    got = entry.queries()["pipeline"](spark, DIR).toPandas()
    classes = brute_classes(list(zip(docs.doc_id, docs.text)))
    assert set(got.doc_id) <= set(classes.values()) and got.doc_id.value_counts().max() <= 2
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
