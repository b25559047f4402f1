"""Answers to any number of questions as one plan.

The steps of ``Engine.ask`` over a table: route, retrieve, assemble the prompt, probe the
store of answers by a join, ask the model for what is missing, ask the small model again for what hit
a rate limit, append new answers to the store.  What a model is asked is written to the shared
folder first and its replies are written before anything reads them, so a lost executor repeats
requests of its own task at most and no later step asks again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qanat.config import AnswerConfig
from qanat.functions import answering, rules
from qanat.functions import arabic_rules as ar
from qanat.functions.clean import trimmed
from qanat.operators import dense
from qanat.plans.retrieval import retrieve_each
from qanat.session import staged
from qanat.sources.keyed_store import KeyedStore

STORE = "answer string, query string, intent string, model string, prompt_v int"
FILTERS = ("article_type", "league", "team")


class Generator(Protocol):
    """Runs in the tasks: replies (text, outcome) to requests (system, user), in order.  The outcome is
    ``ok``, ``rate_limit`` or ``error``; a failed request has no text."""

    def __call__(self, model: str, requests: list[tuple[str, str]]) -> Iterable[tuple[str | None, str]]: ...


def one_by_one(generate: Callable[[str, str, str], str]) -> Generator:
    """A generator of single requests as one of batches: ``RateLimited`` is a rate limit, any other exception an error."""
    from qanat.engine import RateLimited

    def replies(model, requests):
        for system, user in requests:
            try:
                yield generate(model, system, user), "ok"
            except RateLimited:
                yield None, "rate_limit"
            except Exception:  # whatever a model's client raises
                yield None, "error"

    return replies


def prepared(engine, questions: DataFrame) -> DataFrame:
    """Questions (qid, query and, if given, article_type, league, team) with intent, state and filters.
    State: blank, invalid (length out of bounds), out_of_scope or ask."""
    given = {c: F.col(c) if c in questions.columns else F.lit(None).cast("string") for c in FILTERS}
    query = F.coalesce("query", F.lit(""))
    size = F.length(query)
    intent = rules.route(query, engine.rules)
    low, high = engine.config.query_chars
    state = (
        F.when(trimmed(query) == "", "blank").when((size < low) | (size > high), "invalid")
        .when(intent == "out_of_scope", "out_of_scope").otherwise("ask")
    )
    types = [F.lit(x) for kv in engine.rules.filter_type.items() for x in kv]
    default = F.try_element_at(F.create_map(*types), intent) if types else F.lit(None)
    return questions.select(
        F.col("qid").cast("long").alias("qid"), query.alias("query"), intent.alias("intent"), state.alias("state"),
        F.coalesce(given["article_type"], default).alias("article_type"), given["league"].alias("league"), given["team"].alias("team"),
    )


def requests(engine, asked: DataFrame) -> DataFrame:
    """One row a question with hits: what the model is to be asked, under which key, from which sources."""
    config: AnswerConfig = engine.config
    q = asked.select("qid", "query", *FILTERS, engine.tokens(F.col("query")).alias("tokens"))
    if engine.vectors is not None:
        encode = dense.encoder(engine.embed or dense.hashing_embedder())
        q = q.withColumn("vector", encode(F.concat(F.lit("query: "), F.col("query"))))
    now = F.lit(engine.now).cast("date") if engine.now else F.current_date()
    hits = retrieve_each(engine.chunks, staged(q, "questions"), now, engine.vectors, engine.retrieval, index=engine.index)
    body = F.when(F.coalesce("body_clean", F.lit("")) != "", F.col("body_clean")).otherwise(F.col("text"))
    entry = answering.context_entry(F.col("rank"), F.col("title"), F.col("pub_date"), body, F.coalesce(F.col("article_type") == "lineup", F.lit(False)), config)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = F.struct(
        blank("title").alias("title"), blank("source_url").alias("url"), F.substring(blank("pub_date"), 1, 10).alias("pub_date"),
        blank("article_type").alias("article_type"), blank("league").alias("league"), "chunk_id", F.round("score", 6).alias("rrf_score"),
    )
    found = hits.groupBy("qid").agg(  # at most k_final hits a question
        answering.joined(F.col("rank"), entry).alias("context"), F.count(F.lit(1)).alias("n_chunks"), F.collect_list("chunk_id").alias("ids"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", source.alias("s")))), 1, config.max_sources), lambda x: x["s"]).alias("sources"),
    )
    rows = asked.select("qid", "query", "intent").join(found, "qid")
    texts = [F.lit(x) for intent, more in engine.prompts.items() for x in (intent, engine.system + more)]
    system = F.coalesce(F.try_element_at(F.create_map(*texts), F.col("intent")), F.lit(engine.system)) if texts else F.lit(engine.system)
    wanted = answering.model_for(F.col("intent"), engine.rules, engine.small, engine.big)
    rows = rows.withColumn("system", system).withColumn("wanted", wanted)
    whole = answering.user_prompt(F.col("context"), F.col("query"))
    cut = answering.within_budget(F.col("context"), F.col("system"), whole, config)
    key = lambda model: answering.cache_key(model, F.col("intent"), F.col("ids"), trimmed(F.col("query")), config)
    return rows.select(
        "qid", "query", "intent", "wanted", "n_chunks", "sources", "system", answering.user_prompt(cut, F.col("query")).alias("user"),
        key(F.col("wanted")).alias("key"), key(F.lit(engine.small)).alias("small_key"),
    )


REPLY = "key string, reply string, outcome string, model string, llm_ms long"


def generated(rows: DataFrame, model: str, generate: Generator, batch: int = 32) -> DataFrame:
    """Replies to requests (key, system, user); a reply that is empty once its placeholder is gone is an error."""
    from qanat.engine import strip_placeholder

    def task(batches):
        for rb in batches:
            for a in range(0, rb.num_rows, batch):
                keys, systems, users = (c.slice(a, batch).to_pylist() for c in rb.columns)
                out, t0 = [], time.monotonic()
                for k, (reply, outcome) in zip(keys, generate(model, list(zip(systems, users)))):
                    reply = strip_placeholder((reply or "").strip())
                    now = time.monotonic()
                    out.append({"key": k, "reply": reply, "outcome": outcome if reply or outcome != "ok" else "error", "model": model, "llm_ms": int((now - t0) * 1000)})
                    t0 = now
                if len(out) != len(keys):
                    raise ValueError(f"{len(keys)} requests, {len(out)} replies")
                yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("reply", pa.string()), ("outcome", pa.string()), ("model", pa.string()), ("llm_ms", pa.int64())]))

    return rows.select("key", "system", "user").mapInArrow(task, REPLY)


def answer_batch(engine, questions: DataFrame, store: KeyedStore | None = None, generate: Generator | None = None, now: float | None = None, parallel: int | None = None) -> DataFrame:
    """What ``Engine.ask`` answers, one row a question: qid, answer, intent, sources, model, model_fallback,
    cached, cache_reason, retrieval_ms, llm_ms, n_chunks.

    ``store`` is probed and written; ``now`` is the time of both (seconds).  Questions with one key are asked once, by the
    least qid, and the others take its answer as a hit, as they would one after the other; an answer of the fallback model
    is stored under that model and is no hit for them.  ``parallel`` is the number of tasks that talk to the model.
    A null query is blank; a query out of bounds gets no answer (``invalid``); repeated qids are told apart by their text only.
    """
    now = time.time() if now is None else now
    generate = generate or one_by_one(engine.generate)
    t0 = time.monotonic()
    q = staged(prepared(engine, questions), "prepared")
    wanted = staged(requests(engine, q.where("state = 'ask'")), "requests")
    n = max(1, wanted.count())
    retrieval_ms = int((time.monotonic() - t0) * 1000 / n)
    life = answering.ttl(F.col("intent"), None, engine.config)
    first = Window.partitionBy("key").orderBy("qid")
    leaders = wanted.groupBy("key").agg(F.min_by(F.struct("wanted", "intent", "system", "user", "query", "small_key"), "qid").alias("r")).select("key", "r.*")
    if store is not None:
        old = store.probe(leaders).select("key", F.col("answer").alias("old"), "ts")
        leaders = leaders.join(old, "key", "left")
        hit = F.coalesce(answering.fresh(F.lit(now), F.col("ts"), life), F.lit(False))
        leaders = leaders.withColumn("old", F.when(hit, F.col("old"))).drop("ts")
    else:
        leaders = leaders.withColumn("old", F.lit(None).cast("string"))
    leaders = staged(leaders, "leaders")
    todo = leaders.where("old is null")
    spread = lambda rows: rows.repartition(parallel) if parallel else rows
    replies = None
    for model in dict.fromkeys([engine.big, engine.small]):
        got = staged(generated(spread(todo.where(F.col("wanted") == model)), model, generate), "replies")
        replies = got if replies is None else replies.unionByName(got)
    again = replies.where((F.col("outcome") == "rate_limit") & (F.col("model") != engine.small)).select("key")
    second = staged(generated(spread(todo.join(again, "key")), engine.small, generate), "fallback")
    last = replies.join(second.select("key"), "key", "left_anti").unionByName(second)
    if store is not None:
        new = last.where("outcome = 'ok'").join(leaders, "key")
        new = new.withColumn("key", F.when(F.col("model") == F.col("wanted"), F.col("key")).otherwise(F.col("small_key")))
        store.append(new.select("key", F.lit(now).alias("ts"), F.col("reply").alias("answer"), "query", "intent", "model", F.lit(engine.config.prompt_version).alias("prompt_v")))
    done = leaders.select("key", "old").join(last, "key", "left")
    rows = wanted.withColumn("turn", F.row_number().over(first)).join(done, "key")
    ok = F.col("outcome") == "ok"
    hit = F.col("old").isNotNull() | ((F.col("turn") > 1) & ok & (F.col("model") == F.col("wanted")))
    made = rows.select(
        "qid", "query", F.when(F.col("old").isNotNull(), F.col("old")).when(ok, F.col("reply")).otherwise(ar.ERROR_ANSWER).alias("answer"), "sources",
        F.when(hit, F.col("wanted")).when(ok, F.col("model")).alias("model"), (~hit & (F.col("model") != F.col("wanted"))).alias("fallback"), hit.alias("cached"),
        F.when(hit, "hit").when(ok, "miss").when(F.col("outcome") == "rate_limit", "skipped_rate_limit").otherwise("skipped_error").alias("reason"),
        F.when(hit, 0).otherwise(F.col("llm_ms")).alias("llm_ms"), "n_chunks",
    )
    out = q.select("qid", "query", "intent", "state").join(made, ["qid", "query"], "left")
    asked, none = F.col("state") == "ask", F.col("n_chunks").isNull()
    empty = F.array().cast(wanted.schema["sources"].dataType)
    return out.select(
        "qid",
        F.when(F.col("state").isin("blank", "invalid"), "").when(~asked, ar.OUT_OF_SCOPE_ANSWER).when(none, ar.REFUSAL_ANSWER).otherwise(F.col("answer")).alias("answer"),
        F.when(~F.col("state").isin("blank", "invalid"), F.col("intent")).alias("intent"), F.coalesce("sources", empty).alias("sources"), "model",
        F.coalesce("fallback", F.lit(False)).alias("model_fallback"), F.coalesce("cached", F.lit(False)).alias("cached"),
        F.when(~asked, F.col("state")).when(none, "no_chunks").otherwise(F.col("reason")).alias("cache_reason"),
        F.when(asked, retrieval_ms).otherwise(0).cast("long").alias("retrieval_ms"), F.coalesce("llm_ms", F.lit(0)).cast("long").alias("llm_ms"),
        F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
    )
