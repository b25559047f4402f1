"""Operators and plans against small brute-force versions."""

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from qanat.config import RetrievalConfig
from qanat.engine import AnswerCache, Engine, RateLimited, log_line
from qanat.functions import arabic_rules as ar
from qanat.functions import text
from qanat.operators import bm25, dense, fusion
from qanat.plans import articles, evaluation
from qanat.sources import html
from qanat.sources.tables import append_jsonl, first_wins, not_done, read_jsonl, scan_plan
from qanat.streaming import incremental


def brute_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for d, t in docs.items():
        s = sum(idf[w] * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avg)) for w in query if w in t)
        if any(w in t for w in query):
            out[d] = round(s, 6)
    return out


def test_bm25(spark):
    rng = random.Random(4)
    docs = {i: [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 12))] for i in range(30)}
    queries = {0: ["aa", "bb", "aa"], 1: ["zz"], 2: ["hh"]}
    units = spark.createDataFrame(list(docs.items()), "unit long, tokens array<string>")
    q = spark.createDataFrame(list(queries.items()), "qid long, tokens array<string>")
    got = {(r.qid, r.unit): (r.score, r["rank"]) for r in bm25.search(units, q, 5).collect()}
    want = {}
    for i, t in queries.items():
        best = sorted(brute_bm25(docs, t).items(), key=lambda x: (-x[1], x[0]))[:5]
        want |= {(i, d): (s, k + 1) for k, (d, s) in enumerate(best)}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)
    padded = bm25.search(units, q, 5, pad=True).where("qid = 1").collect()
    assert [r.unit for r in padded] == [0, 1, 2, 3, 4] and all(r.score == 0 for r in padded)


def test_dense(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 8)).astype(np.float32)
    v[7] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "unit long, vector array<float>")
    q = rows.where("unit < 5").withColumnRenamed("unit", "qid")
    s = np.round(v[:5].astype(float) @ v.astype(float).T, 6)
    for block in (2, 100):
        got = {(r.qid, r["rank"]): r.unit for r in dense.search(rows, q, 4, block=block).collect()}
        for i in range(5):
            assert [got[i, k] for k in (1, 2, 3, 4)] == sorted(range(50), key=lambda j: (-s[i, j], j))[:4]


def test_fusion_and_filters(spark):
    sparse = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, unit long, rank int")
    near = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "qid long, unit long, rank int")
    meta = spark.createDataFrame(
        [(1, 10, "2025-01-01", "a", "x", ["t"]), (2, 10, "bad", "b", "x", None), (3, 11, None, "a", "y", ["u"])],
        "unit long, doc long, pub_date string, league string, article_type string, teams array<string>",
    )
    cfg = RetrievalConfig()
    got = {r.unit: r.rrf for r in fusion.fuse(sparse, near).collect()}
    assert got == pytest.approx({1: 0.3 / 61, 2: 0.3 / 62 + 0.7 / 61, 3: 0.7 / 62})
    now = F.lit("2025-01-01")
    hits = fusion.finish(fusion.fuse(sparse, near), meta, now, {}, cfg).orderBy("rank").collect()
    assert [(r.unit, r.doc) for r in hits] == [(2, 10), (3, 11)]  # unit 1 shares a document with 2
    hits = fusion.finish(fusion.fuse(sparse, near), meta, now, {"league": "a", "team": "t"}, cfg).collect()
    assert [r.unit for r in hits] == [1]
    assert hits[0].score == pytest.approx(0.3 / 61 * 1.1, abs=1e-8)


@pytest.mark.parametrize("day, want", [("2025-01-01", 1.1), ("2025-03-01T10:00", 1.1), ("2024-12-02", 1 + 0.1 * math.exp(-1)), ("2021-01-01", 1.0), ("", 1.0), ("junk", 1.0), (None, 1.0)])
def test_recency(spark, day, want):
    r = spark.createDataFrame([(day,)], "d string").select(fusion.recency(F.col("d"), F.lit(date(2025, 1, 1)))).first()[0]
    assert r == pytest.approx(want, abs=1e-6)


def test_jsonl_first_wins_and_resume(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"article_id": 1, "title": "first"}\n\nnot json\n{"article_id": 1, "title": "second"}\n{"article_id": 0}\n{"article_id": 2, "title": "x"}\n')
    rows = read_jsonl(spark, str(tmp_path / "a.jsonl"))
    got = {r.article_id: r.title for r in first_wins(rows, "article_id", "file", "block", "line").collect()}
    assert got == {1: "first", 2: "x"}
    out = str(tmp_path / "out")
    done = spark.createDataFrame([(1,)], "article_id long")
    append_jsonl(not_done(rows.select("article_id"), done, "article_id"), out)
    append_jsonl(done, out)
    assert spark.read.json(out).distinct().count() == 2


def test_scan_plan(spark):
    seeds = spark.createDataFrame([(3,), (9,), (3,), (50,)], "id long")
    done = spark.createDataFrame([(4,)], "id long")
    plan = scan_plan(seeds, 1, 10, done).orderBy("priority", F.col("id").desc()).collect()
    assert [r.id for r in plan] == [9, 3, 10, 8, 7, 6, 5, 2, 1]


def test_article_pipeline(spark):
    body = " ".join(f"كلمة{i}" for i in range(400))
    raw = spark.createDataFrame(
        [(1, "عنوان أول", body, "x", 1), (1, "بديل", body, "x", 2), (2, "قصير", "نص", "x", 3), (3, "يد", body, " كرة يد ", 4)],
        "article_id long, title string, body string, section string, n int",
    ).withColumn("article_type", F.lit("article")).withColumn("pub_date", F.lit("2024-05-06T00:00"))
    chunks, stats = articles.run(raw, ("n",))
    s = stats.first()
    assert (s.total_articles, s.articles_processed, s.skipped_short_body, s.skipped_by_section, s.total_chunks) == (3, 1, 1, 1, 2)
    c = chunks.orderBy("chunk_index").collect()
    assert [r.chunk_id for r in c] == ["1_0", "1_1"]
    assert c[0].text.startswith("عنوان: عنوان اول | قسم: x | تاريخ: 2024-05-06\n\n[جزء 1/2]\nكلمه0 ")
    empty = articles.run(raw.limit(0), ("n",))[1].first()
    assert (empty.total_articles, empty.avg_body_length, empty.max_body_length) == (0, 0, 0)


PAGE = """<html><head><meta property="og:title" content="  A headline of some length "><meta property="article:tag" content="t1"><meta property="article:tag" content="t2">
<meta name="datePublished" content="2024-01-02"></head><body><p>outside paragraph that is long enough</p><div class="x Article-Body"><p>First paragraph, long enough to stay. <b>bold</b>
<p>Second one, also long enough to stay.<script>var x = "<p>not this</p>";</script><ul><li>An item of more than ten.</ul><aside><p>Aside that is long enough to show.</p></aside><p>short</p></div></body></html>"""


def test_html(spark):
    a = html.article("http://s/articles/12345", PAGE)
    assert a["title"] == "A headline of some length" and a["tags"] == ["t1", "t2"] and a["pub_date"] == "2024-01-02"
    assert a["body"] == "First paragraph, long enough to stay. bold Second one, also long enough to stay. An item of more than ten."
    assert html.article("http://s/other", PAGE) is None
    assert html.article("http://s/articles/1", "<h1>t</h1><p>tiny</p>") is None
    pages = spark.createDataFrame([(1, "http://s/articles/12345", PAGE), (2, None, None), (3, "x", "<<<>")], "page_id long, url string, html string")
    assert [r.page_id for r in html.parse_pages(pages).collect()] == [1]
    links = spark.createDataFrame([('<a href="/articles/1234"><a href="/articles/99999"><a href="/articles/1234"><a href="/articles/12">',)], "h string")
    assert links.select(html.link_ids(F.col("h"))).first()[0] == [99999, 1234]


def test_evaluation(spark):
    hits = spark.createDataFrame([("a", 0, 1, "the cat"), ("a", 0, 2, "a dog"), ("b", 0, 1, "a dog")], "experiment string, qid long, rank int, text string")
    cases = spark.createDataFrame(
        [(0, "i", "the cat", ["cat", "dog"], "i", False), (1, "general_football", "x", ["y"], "out_of_scope", True)],
        "qid long, intent string, reference string, keywords array<string>, predicted string, refusal boolean",
    )
    scored = evaluation.case_metrics(hits, cases, experiments=["a", "b"])
    m = {(r.experiment, r.qid): r for r in scored.collect()}
    # the reference's two words are both in the two texts' four
    assert m["a", 0].keyword_hit == 1.0 and m["a", 0].rouge1 == pytest.approx(2 * (2 / 4) / (2 / 4 + 1)) and m["b", 0].keyword_hit == 0.5 and m["b", 1].mrr == 0.0
    assert all(r.intent_accuracy == 1.0 for r in m.values())
    assert [(r.experiment, r.intent, r.rouge1, r.n_cases) for r in evaluation.per_intent(scored).collect()][1] == ("a", "i", 0.667, 1)
    s = evaluation.summary(scored, "experiment")
    assert evaluation.winner(s).first().experiment == "a" and "| a |" in evaluation.report(s.orderBy("experiment"))
    rows = spark.createDataFrame(
        [(True, False, 0.0, 0.0, 0.0, 0, 0, 1.0), (False, False, 0.25, 0.5, 1.0, 1, 0, 3.0)],
        "failed boolean, refusal boolean, rouge1 double, similarity double, keyword_hit double, intent_ok int, refused int, latency_ms double",
    )
    r = evaluation.answers_summary(rows).first()
    assert (r.n_scored, r.n_failed, r.rouge1, r.similarity, r.refusal_accuracy, r.latency_ms) == (1, 1, 0.25, 0.5, None, 3.0)
    # keyword hits and ROUGE count refusal cases, similarity does not
    more = rows.unionByName(spark.createDataFrame([(False, True, 0.75, None, 0.0, 1, 1, 5.0)], rows.schema))
    r = evaluation.answers_summary(more).first()
    assert (r.rouge1, r.similarity, r.n_similarity, r.keyword_hit, r.refusal_accuracy, r.n_refusal) == (0.5, 0.5, 1, 0.5, 1.0, 1)


def engine(spark, **more):
    rows = [(1, 1, "1_0", "تشكيل الزمالك اليوم", "خبر التشكيل", "lineup"), (2, 2, "2_0", "صفقة لاعب جديد", "خبر الصفقة", "transfer"), (3, 3, "3_0", "ترتيب الدوري", "خبر الترتيب", "article")]
    df = spark.createDataFrame(rows, "unit long, doc long, chunk_id string, title string, body_clean string, article_type string")
    df = df.select("*", text.tokens(F.col("title")).alias("tokens"), F.col("body_clean").alias("text"), F.lit("2024-01-01").alias("pub_date"), F.lit("other").alias("league"), F.array(F.lit("zamalek")).alias("teams"), F.lit("u").alias("source_url"))
    return Engine(df, now="2024-01-02", **more)


def test_ask(spark):
    calls = []

    def generate(model, system, user):
        calls.append(model)
        return "جواب [N]"

    e = engine(spark, generate=generate)
    a = e.ask("ما هو تشكيل الزمالك")
    assert (a["answer"], a["intent"], a["model"], a["cached"], a["n_chunks"], a["cache_reason"]) == ("جواب", "lineup", "small", False, 1, "miss")
    assert a["sources"][0]["chunk_id"] == "1_0"
    again = e.ask("  ما هو تشكيل الزمالك ")
    assert again["cached"] and again["cache_reason"] == "hit" and len(calls) == 1
    assert e.ask("كيف الطقس اليوم")["answer"] == ar.OUT_OF_SCOPE_ANSWER
    assert e.ask("كلمات غريبة")["cache_reason"] == "no_chunks"
    with pytest.raises(ValueError):
        e.ask("x")
    assert e.health("تشكيل الزمالك") == {"status": "ok", "chunks": 3} and e.health("qqqq")["status"] == "error"
    assert e.ask("   ")["cache_reason"] == "blank" and e.ask("كيف الطقس اليوم", request_id="r1")["request_id"] == "r1"


def test_fallback(spark):
    def limited(*models):
        def generate(model, system, user):
            if model in models:
                raise RateLimited
            return "ok"

        return generate

    a = engine(spark, generate=limited("big")).ask("ترتيب الدوري")
    assert a["model"] == "small" and a["model_fallback"] and a["answer"] == "ok"
    e = engine(spark, generate=limited("big", "small"))
    assert e.ask("ترتيب الدوري")["cache_reason"] == "skipped_rate_limit" and not e.cache.rows
    calls = []

    def broken(model, system, user):
        calls.append(model)
        raise RuntimeError

    assert engine(spark, generate=broken).ask("ترتيب الدوري")["cache_reason"] == "skipped_error" and calls == ["big"]


def test_cache_ttl():
    now = [0.0]
    c = AnswerCache(lambda: now[0])
    c.put("k", "a")
    assert c.get("k", 10) == "a" and c.get("k", 0) is None and c.get("other", 10) is None
    now[0] = 10.0
    assert c.get("k", 10) is None
    assert '"model": "m"' in log_line("INFO", "x", "y", model="m", secret="no") and "secret" not in log_line("INFO", "x", "y", secret="no")


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:01", "a"), (1, "2024-01-01 00:00:30", "b"), (2, "2024-01-01 00:01:05", "c")], "article_id long, ts string, title string")
    append_jsonl(rows, src)
    stream = incremental.json_stream(spark, src, rows.schema).withColumn("at", F.to_timestamp("ts"))
    incremental.ingest(incremental.first_seen(stream, "article_id", "at", "1 hour"), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    append_jsonl(rows.limit(1), src)  # only the new file is read on resume, and its key was seen
    incremental.ingest(incremental.first_seen(stream, "article_id", "at", "1 hour"), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    batch = rows.withColumn("at", F.to_timestamp("ts"))
    n = incremental.over_limit(incremental.request_counts(batch, "article_id", "at"), 1).orderBy("article_id", "window_start").collect()
    assert [(r.article_id, r.n, r.rejected) for r in n] == [(1, 2, 1), (2, 1, 0)]


def test_cli_and_answer_evaluation(spark, tmp_path):
    import json

    from qanat import cli
    from qanat.engine import source_cards
    from qanat.functions import answering

    body = " ".join(f"تشكيل الزمالك الكامل{i}" for i in range(40))
    raw = [{"article_id": 7, "title": "تشكيل الزمالك", "body": body, "section": "x", "tags": [], "article_type": "lineup", "pub_date": "2024-05-05", "source_url": "u"}]
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in raw))
    out = str(tmp_path / "out")
    assert cli.run_articles(spark, str(tmp_path / "none.jsonl"), out) is None
    assert cli.run_articles(spark, str(tmp_path / "raw.jsonl"), out)["articles_processed"] == 1
    a = cli.ask(spark, out + "/chunks", "ما هو تشكيل الزمالك")
    assert a["n_chunks"] == 1 and a["sources"][0]["chunk_id"] == "7_0"
    assert source_cards(a["sources"]).count("<a href=") == 1
    pages = spark.createDataFrame([(12345, "http://s/articles/12345", PAGE)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    for _ in range(2):
        cli.parse_pages(spark, str(tmp_path / "pages"), str(tmp_path / "parsed"), "/articles/", str(tmp_path / "parsed"))
    assert spark.read.json(str(tmp_path / "parsed")).count() == 1
    rows = [("ما هو تشكيل الزمالك", "خبر", "lineup", "easy", ["التشكيل"], None), ("كيف الطقس اليوم", "", "general_football", "easy", [], True)]
    cases = evaluation.load_cases(spark, str(tmp_path / "cases"), spark.createDataFrame(rows, evaluation.CASES))
    s = evaluation.answers_summary(evaluation.evaluate_answers(engine(spark), cases, ar.REFUSAL_STEM, ar.ERROR_ANSWER)).first()
    assert (s.n_cases, s.n_refusal, s.keyword_hit, s.intent_accuracy, s.refusal_accuracy, s.n_similarity) == (2, 1, 1.0, 1.0, 1.0, 1)
    prompt = spark.range(1).select(answering.user_prompt(F.lit("ctx"), F.lit("<|q")), answering.plain_entry(F.lit(1), F.lit("t"), F.lit("2024-01-02T"), F.lit("l"), F.lit("b"))).first()
    assert prompt[0] == engine(spark).prompt("ctx", "q") and prompt[1] == "[1] t (2024-01-02) — l\nb"


def test_index_gives_what_the_scan_gives(spark, tmp_path, monkeypatch):
    import random

    from qanat.plans import index as search_index

    monkeypatch.setattr(search_index, "SEGMENT", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, [rng.choice(words[: rng.randint(1, 40)]) for _ in range(rng.randint(0, 30))]) for i in range(90)] + [(99, None)]
    units = spark.createDataFrame(rows, "unit long, tokens array<string>")
    asked = spark.createDataFrame([(q, [rng.choice(words) for _ in range(q)] + ["none"]) for q in range(8)], "qid long, tokens array<string>")
    search_index.build(units, str(tmp_path / "i"), units.select("unit", F.array(F.lit(1.0)).alias("vector")))
    found = search_index.load(spark, str(tmp_path / "i"))
    assert found.n_units == 91 and found.vectors.count() == 91 and found.postings.select("segment").distinct().count() == 6
    key = lambda df: sorted((r.qid, r.unit, r.score, r["rank"]) for r in df.collect())
    want = key(bm25.search(units, asked, 7))
    assert want and key(search_index.search(found, asked, 7)) == want and key(search_index.search(found, asked, 7, block=3)) == want
    monkeypatch.setattr(search_index, "NAMED", 2)
    assert key(search_index.search(found, asked, 7)) == want
    assert search_index.search(found, asked.limit(0), 7).count() == 0


def test_lists_of_a_segment_are_whole_and_bounded(spark, tmp_path, monkeypatch):
    """A segment is made by one task: no more than ``STEP`` tokens save for one long unit, every term once, and nothing shuffled."""
    from qanat.plans import index as search_index

    monkeypatch.setattr(search_index, "STEP", 64)
    rows = [(i, [f"w{(i * j) % 31}" for j in range(200 if i == 40 else i % 23)]) for i in range(120)] + [(500, [])]
    units = spark.createDataFrame(rows, "unit long, tokens array<string>").repartition(3)
    search_index.build(units, str(tmp_path / "i"))
    found = search_index.load(spark, str(tmp_path / "i"))
    size = {i: len(t) for i, t in rows}
    seen: dict = {}
    for r in found.postings.collect():
        assert r["n"] == len(r["unit"]) == len(r["tf"]) == len(r["dl"]) and [size[u] for u in r["unit"]] == r["dl"]
        seen.setdefault(r["segment"], []).append(r)
    for lists in seen.values():
        assert len({r["term"] for r in lists}) == len(lists)
        own = {u for r in lists for u in r["unit"]}
        assert sum(size[u] for u in own) <= 64 or len(own) == 1
        assert sum(sum(r["tf"]) for r in lists) == sum(size[u] for u in own)
    assert sum(r["n"] for lists in seen.values() for r in lists) == sum(len(set(t)) for _, t in rows)
    asked = spark.createDataFrame([(1, ["w1", "w30", "w7"]), (2, ["w0"])], "qid long, tokens array<string>")
    key = lambda df: sorted((r.qid, r.unit, r.score, r["rank"]) for r in df.collect())
    assert key(search_index.search(found, asked, 9)) == key(bm25.search(units, asked, 9))


def test_evaluate_command(spark, tmp_path):
    import json

    from qanat import cli

    body = " ".join(f"تشكيل الأهلي أمام الزمالك في مباراة القمة رقم{i}" for i in range(20))
    raw = [{"article_id": 7 + i, "title": t, "body": body, "section": "x", "tags": [], "article_type": "lineup", "pub_date": "2024-05-05", "source_url": "u"} for i, t in enumerate(["تشكيل الأهلي", "تشكيل الزمالك"])]
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in raw))
    stats = cli.run_articles(spark, str(tmp_path / "raw.jsonl"), str(tmp_path / "out"))
    assert stats["article_types"] == {"lineup": 2} and stats["league_coverage"] == {"other": 2}
    cli.run_index(spark, str(tmp_path / "out/chunks"), str(tmp_path / "index"))
    found = cli.evaluate(spark, str(tmp_path / "index"), str(tmp_path / "cases"), True, str(tmp_path / "report"), "2024-06-01")
    assert [r["experiment"] for r in found["ablation"]] == evaluation.EXPERIMENTS and all(r["n_cases"] == 60 for r in found["ablation"])
    assert len(found["ablation"][0]["per_intent"]) == 6 and found["rag"]["n_cases"] == 60 and set(found["rag"]["per_intent"]) == set(found["ablation"][0]["per_intent"])
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0]) == json.loads(json.dumps(found))
    assert "Best by mrr" in evaluation.tables_of(found)
    a = cli.ask(spark, None, "ما هو تشكيل الزمالك", str(tmp_path / "index"), str(tmp_path / "cache"))
    again = cli.ask(spark, None, "ما هو تشكيل الزمالك", str(tmp_path / "index"), str(tmp_path / "cache"))
    assert not a["cached"] and again["cached"] and again["answer"] == a["answer"]
    spark.createDataFrame([(30,), (20,)], "id long").write.parquet(str(tmp_path / "seeds"))
    cli.plan(spark, str(tmp_path / "seeds"), str(tmp_path / "plan"), None, 18, None, 5)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "plan")).collect()) == [20, 27, 28, 29, 30]


def test_limiter_and_caches(tmp_path):
    from qanat.engine import FolderCache, Limiter

    now = [0.0]
    lim = Limiter(2, 60, lambda: now[0])
    assert [lim.allow("a"), lim.allow("a"), lim.allow("a"), lim.allow("b")] == [True, True, False, True]
    now[0] = 60.0
    assert lim.allow("a")
    c = FolderCache(str(tmp_path / "c"), lambda: now[0])
    c.put("k", "جواب", query="q")
    assert c.get("k", 10) == "جواب" and c.get("k", 0) is None and c.get("x", 10) is None
    (tmp_path / "c" / "bad.json").write_text("{")
    assert c.get("bad", 10) is None
    small = AnswerCache(lambda: now[0], limit=2)
    for k in "abc":
        small.put(k, k)
    assert list(small.rows) == ["b", "c"]


def test_scan_range_from_seeds(spark):
    seeds = spark.createDataFrame([(700,), (900,), (900,)], "id long")
    rows = [r.id for r in scan_plan(seeds).collect()]
    assert rows[:2] == [900, 700] and rows[2:] == [i for i in range(899, 199, -1) if i != 700]
    assert [r.id for r in scan_plan(seeds, 699, 701, limit=2).collect()] == [700, 701]
    assert scan_plan(seeds.limit(0)).count() == 0


def test_deep_markers_go(spark):
    from qanat.functions import answering

    q = "<|"
    for _ in range(9):
        q = "<" + q + "|"
    deep = "<us" * 7 + "<user>" + "er>" * 7
    rows = spark.createDataFrame([(q + "hello",), (deep + "x",), ("plain",), (None,)], "q string")
    assert [r[0] for r in rows.select(answering.sanitize(F.col("q"))).collect()] == ["hello", "x", "plain", ""]
    assert rows.limit(1).select(answering.sanitize(F.col("q"), 1)).first()[0] != "hello"
