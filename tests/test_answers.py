"""Batch answering against one question at a time, and the keyed store."""

import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from qanat.config import AnswerConfig
from qanat.engine import AnswerCache, Limiter, RateLimited, StoreCache
from qanat.functions import arabic_rules as ar
from qanat.functions import text
from qanat.memo import Memo
from qanat.operators import vector_index
from qanat.plans import answer_queries, answers
from qanat.plans import index as search_index
from qanat.plans import stand_ins as si
from qanat.plans.retrieval import retrieve
from qanat.sources.keyed_store import KeyedStore

DIR = "/root/testdata/sf0.001"
FACTS = ("answer", "intent", "model", "model_fallback", "cached", "cache_reason", "n_chunks")


@pytest.fixture(scope="module")
def engine(spark):
    return answer_queries.demo_engine(spark, DIR)


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/store", answers.STORE, buckets=4)


def facts(r):
    sources = r["sources"]
    return tuple(r[c] for c in FACTS) + (tuple(s["chunk_id"] for s in sources), tuple(s["rrf_score"] for s in sources))


def test_batch_is_ask_row_by_row(spark, engine, store):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").limit(10).collect()]
    asked = items + [(1000, items[0][1]), (1001, "   "), (1002, "wea"), (1003, items[3][1] + "\t"), (1004, "zzzz qqqq")]
    e = replace(engine, cache=AnswerCache(clock=lambda: 100.0))
    one = {qid: e.ask(q) for qid, q in asked}
    df = spark.createDataFrame(asked, "qid long, query string")
    got = {r["qid"]: r for r in answers.answer_batch(engine, df, store, now=100.0).collect()}
    assert len(got) == len(asked)
    assert {q: facts(r) for q, r in got.items()} == {q: facts(r) for q, r in one.items()}
    assert {r["cache_reason"] for r in got.values()} >= {"blank", "out_of_scope", "hit", "miss", "no_chunks"}
    # once more: what was answered is now in the store
    again = {r["qid"]: r for r in answers.answer_batch(engine, df, store, now=200.0).collect()}
    assert {q: facts(r) for q, r in again.items()} == {q: facts(e.ask(t)) for q, t in asked}
    stale = answers.answer_batch(engine, df.where("qid = 1000"), store, now=100.0 + 10**8).first()
    assert not stale["cached"]


def test_filters_of_each_question(spark, engine):
    body = spark.read.parquet(f"{DIR}/documents.parquet").where("lang = 'es' and length(text) > 300").orderBy("doc_id").first()["text"]
    query = " ".join(body.split()[:12])
    rows = [(1, query, None, None), (2, query, None, "es"), (3, query, "src0", None), (4, query, "none", "es")]
    df = spark.createDataFrame(rows, "qid long, query string, article_type string, league string")
    got = {r["qid"]: r for r in answers.answer_batch(engine, df).collect()}
    e = replace(engine, cache=AnswerCache())
    for qid, q, kind, league in rows:
        want = e.ask(q, article_type=kind, league=league)
        assert [s["chunk_id"] for s in got[qid]["sources"]] == [s["chunk_id"] for s in want["sources"]], qid
    assert got[4]["cache_reason"] == "no_chunks" and got[4]["answer"] == ar.REFUSAL_ANSWER


def test_queries_out_of_bounds(spark, engine):
    e = replace(engine, config=AnswerConfig())
    df = spark.createDataFrame([(1, "x"), (2, "y" * 501), (3, None)], "qid long, query string")
    assert {r["qid"]: (r["answer"], r["cache_reason"]) for r in answers.answer_batch(e, df).collect()} == {1: ("", "invalid"), 2: ("", "invalid"), 3: ("", "blank")}
    assert answers.answer_batch(e, df.where("qid > 9")).count() == 0


def test_generator_outcomes():
    def generate(model, system, user):
        if user == "limit":
            raise RateLimited
        if user == "bad":
            raise OSError
        return user

    got = list(answers.one_by_one(generate)("m", [("s", "a"), ("s", "limit"), ("s", "bad")]))
    assert got == [("a", "ok"), (None, "rate_limit"), (None, "error")]


def test_words_as_literals(spark):
    for w in ("a'b", "a\\b", "\\'", "%_", '"x"', "مباراة", "a\\nb", "${x}", "$", "`", "a\nb"):
        assert spark.sql(f"SELECT {search_index._quoted(w)} AS x").first()[0] == w


def test_single_question_is_the_batch_search(spark, engine, monkeypatch):
    """From memory, read for the question, and scored in the cluster: the same hits as a search for many."""
    q = spark.read.parquet(f"{DIR}/benchmark.parquet").limit(6).select(F.col("item_id").alias("qid"), text.plain_tokens(F.col("text")).alias("tokens")).persist()
    index = search_index.load(spark, engine.index.postings.inputFiles()[0].split("/postings/")[0])
    want: dict = {}
    for r in search_index.search(index, q, 30).orderBy("qid", "rank").collect():
        want.setdefault(r["qid"], []).append((r["unit"], r["score"]))
    for read in (1 << 21, 0):
        monkeypatch.setattr(search_index, "READ", read)
        for r in q.collect():
            got = search_index.best(index, r["tokens"], 30)
            assert [s for _, s in got] == pytest.approx([s for _, s in want[r["qid"]]], abs=2e-6) and len({u for u, _ in got} & {u for u, _ in want[r["qid"]]}) >= 29
            assert search_index.best(index, r["tokens"], 30) == got
    assert search_index.best(index, ["not-a-term"], 3) == [] and search_index.best(index, [], 3) == []


def test_memory_is_bounded():
    m = Memo(100)
    for i in range(10):
        m.put(i, str(i), 30)
    assert m.found(range(10)) == {7: "7", 8: "8", 9: "9"} and m.size == 90
    m.found([7])
    m.put(10, "10", 30)
    assert set(m.found(range(11))) == {7, 9, 10}
    m.put(11, "x", 101)
    assert 11 not in m.found([11])


def rows_of(df):
    return sorted((r["key"], r["ts"], r["answer"]) for r in df.collect())


def put(spark, store, rows):
    store.append(spark.createDataFrame([(k, t, a, "q", "i", "m", 3) for k, t, a in rows], store.schema))


def test_store_latest_wins(spark, store):
    assert rows_of(store.all()) == [] and store.get("a") is None
    put(spark, store, [("a", 1.0, "old"), ("b", 5.0, "b5"), (None, 1.0, "lost")])
    put(spark, store, [("a", 2.0, "new"), ("b", 4.0, "b4"), ("c", 1.0, "c")])
    assert rows_of(store.all()) == [("a", 2.0, "new"), ("b", 5.0, "b5"), ("c", 1.0, "c")]
    asked = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "key string")
    assert rows_of(store.probe(asked)) == [("a", 2.0, "new")]
    assert store.get("b")["answer"] == "b5" and store.get("zz") is None
    store.compact(F.col("ts") < 2)
    assert len(store.segments()) == 1 and rows_of(store.all()) == [("a", 2.0, "new"), ("b", 5.0, "b5")]
    # another session of the same path
    other = KeyedStore(spark, store.path, answers.STORE, buckets=4)
    spark.sql(f"DROP TABLE {store._table(store.segments()[0])}")
    assert rows_of(other.all()) == [("a", 2.0, "new"), ("b", 5.0, "b5")] and other.get("a")["answer"] == "new"


def test_store_as_the_cache_of_an_engine(spark, store):
    now = [100.0]
    c = StoreCache(store, lambda: now[0], every=2, most=2)
    c.put("a", "1", query="q", intent="i", prompt_v=3)
    assert c.get("a", 10) == "1" and store.segments() == []
    c.put("b", "2")
    assert len(store.segments()) == 1 and StoreCache(store, lambda: now[0]).get("a", 10) == "1" and c.get("zz", 10) is None
    now[0] = 110.0
    assert c.get("a", 10) is None
    for x in "cdef":
        c.put(x, x)
    c.flush()
    assert len(store.segments()) <= 2 and c.get("b", 99) == "2" and c.get("f", 99) == "f"


def test_callers_are_limited(engine):
    e = replace(engine, limiter=Limiter(1, 60, lambda: 0.0))
    assert e.ask("wea", caller="x")["cache_reason"] == "out_of_scope"
    assert e.ask("wea", caller="x")["cache_reason"] == "rate_limited" and e.ask("wea", caller="y")["cache_reason"] == "out_of_scope" and e.ask("wea")["cache_reason"] == "out_of_scope"


def test_store_two_writers(spark, store):
    def write(n):
        for i in range(3):
            put(spark, store, [(f"{n}-{i}-{j}", float(i), str(j)) for j in range(20)])

    threads = [threading.Thread(target=write, args=(n,)) for n in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.all().count() == 120 and len(store.segments()) == 6


def test_compaction_keeps_what_appears_meanwhile(spark, store, monkeypatch):
    put(spark, store, [("a", 1.0, "1")])
    append = store.append

    def beside(rows):
        monkeypatch.setattr(store, "append", append)
        put(spark, store, [("b", 9.0, "late")])
        return append(rows)

    monkeypatch.setattr(store, "append", beside)
    store.compact()
    assert rows_of(store.all()) == [("a", 1.0, "1"), ("b", 9.0, "late")]


def test_probe_does_not_shuffle_the_store(spark, store):
    put(spark, store, [(str(i), float(i), "x") for i in range(200)])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.probe(spark.range(50).select(F.col("id").cast("string").alias("key")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "Scan parquet" in x and "qanat_store" in x)
    join = next(i for i in range(scan, -1, -1) if "Join" in lines[i])
    assert not any("Exchange" in x for x in lines[join:scan]), plan


def test_hybrid_question_is_the_batch_plan(spark, engine, tmp_path):
    """One question over the clustered index, with and without filters, against ``retrieve`` for it."""
    vector_index.build(si.vectors(spark, DIR), f"file://{tmp_path}/v")
    e = replace(engine, vectors=vector_index.load(spark, f"file://{tmp_path}/v"))
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").limit(3).collect():
        tokens = e._read(r["text"])["tokens"]
        for filters in ({}, {"league": "en"}):
            q = spark.createDataFrame([(0, tokens, e._encoded(r["text"]).tolist())], "qid long, tokens array<string>, vector array<double>")
            want = retrieve(e.chunks, q, F.lit(e.now).cast("date"), e.vectors, filters, config=e.retrieval, index=e.index)
            got = e._hits(r["text"], tokens, filters, e.retrieval)
            assert [(x["rank"], x["unit"], x["score"]) for x in got] == [(x["rank"], x["unit"], x["score"]) for x in want.orderBy("rank").collect()]
