"""Registered queries that answer the benchmark items, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.config import AnswerConfig, RetrievalConfig
from qanat.engine import Engine, RateLimited, extractive
from qanat.functions import answering, metrics, text
from qanat.functions import arabic_rules as ar
from qanat.plans import answers, evaluation
from qanat.plans import oracle as sql
from qanat.plans import stand_ins as si
from qanat.session import shared_dir
from qanat.sources.keyed_store import KeyedStore

NOW_SECONDS = 1_735_689_600.0


def moody(model: str, system: str, user: str) -> str:
    """A stand-in for a hosted model with limits: by the length of the question it fails, or its
    big variant has no quota left, or it gives the first line of the context."""
    query = user.rsplit(answering.FENCES[0] + "\n", 1)[1].rsplit("\n" + answering.FENCES[1], 1)[0]
    if len(query) % 7 == 3:
        raise ValueError("no reply")
    if model == "big" and len(query) % 5 == 0:
        raise RateLimited
    return extractive(model, system, user)


def demo_engine(spark: SparkSession, d: str) -> Engine:
    """The documents as chunks of their own, found by their words."""
    from qanat.plans.catalogue import DEMO_RULES

    index = si.index(spark, d, "doc")
    chunks = si.articles(spark, d).select(
        F.col("doc_id").alias("unit"), F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("chunk_id"), text.plain_tokens(F.col("text")).alias("tokens"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body_clean"), "text",
        "pub_date", "article_type", "league", F.array().cast("array<string>").alias("teams"), F.lit("").alias("source_url"),
    )
    return Engine(
        chunks, index=index, rules=DEMO_RULES, tokenize=text.plain_tokens, generate=moody, now=si.NOW,
        config=replace(AnswerConfig(), query_chars=(2, 100_000)), retrieval=RetrievalConfig(k_final=6),
    )


def _answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions and their answers, where items of even number have been answered before."""
    engine, q = demo_engine(spark, d), si.questions(spark, d).select("qid", "query")
    store = KeyedStore(spark, f"{shared_dir(spark)}/qanat/answers-{uuid.uuid4().hex}", answers.STORE)
    answers.answer_batch(engine, q.where("qid % 2 = 0"), store, now=NOW_SECONDS).count()
    return q, answers.answer_batch(engine, q, store, now=NOW_SECONDS + 60)


def answer_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item answered, through the store of answers and the fallback model."""
    return _answered(spark, d)[1].select(
        "qid", "intent", "model", "model_fallback", "cached", "cache_reason", "n_chunks", F.md5("answer").alias("answer_md5"),
        F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("sources"),
    )


def answer_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Those answers scored against the items themselves, by intent."""
    q, got = _answered(spark, d)
    expected = F.element_at(F.array(F.lit("gallic"), F.lit("germanic"), F.lit("general")), (F.col("qid") % 3 + 1).cast("int"))
    refusal = F.col("qid") % 4 == 0
    rows = got.join(q, "qid").select(
        F.col("intent").alias("by_intent"), (F.col("answer") == ar.ERROR_ANSWER).alias("failed"), refusal.alias("refusal"),
        metrics.rouge1_f1(F.lower("answer"), F.lower("query"), text.LATIN).alias("rouge1"), F.lit(0.0).alias("similarity"), F.col("cached").cast("double").alias("keyword_hit"),
        metrics.intent_accuracy(F.col("intent"), expected, refusal).alias("intent_ok"), F.contains("answer", F.lit(ar.REFUSAL_STEM)).cast("int").alias("refused"), F.lit(0.0).alias("latency_ms"),
    )
    return evaluation.answers_summary(rows, "by_intent").select("by_intent", "n_cases", "n_scored", "n_failed", "rouge1", F.col("keyword_hit").alias("cached_share"), "intent_accuracy", "refusal_accuracy", "n_refusal")


QUERIES = [answer_batch, answer_batch_summary]

_SEP = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in ("\n", "\n", "---", "\n", "\n"))
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def _answers() -> str:
    return f"""WITH {sql.bm25(sql.DOC_UNITS, 200)},
ri AS (SELECT qid, query, len({_TRIM.format('query')}) AS size, {sql.INTENT} AS intent FROM (SELECT *, lower(query) AS q FROM qs)),
rw AS (SELECT *, CASE intent WHEN 'legal' THEN 'src0' WHEN 'iberian' THEN 'src1' END AS want, CASE WHEN intent IN ('legal', 'counted') THEN 'small' ELSE 'big' END AS wanted FROM ri),
fu AS (SELECT qid, unit, want, 0.3 / (60 + rank) AS rrf FROM sparse JOIN rw USING (qid) WHERE intent <> 'out_of_scope' AND rank <= CASE WHEN want IS NULL THEN 50 ELSE 200 END),
z AS (SELECT qid, unit, {sql.BOOST} AS score FROM fu JOIN documents ON unit = doc_id WHERE want IS NULL OR source = want),
h AS (SELECT *, {sql.RANK} AS rank FROM z QUALIFY rank <= 6),
c AS (SELECT qid, count(*) AS n_chunks, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3) AS sources,
 string_agg('[' || rank || '] ' || left(text, 60) || ' (' || {sql.PUB} || ')' || chr(10) || left(text, 800), {_SEP} ORDER BY rank) AS ctx FROM h JOIN documents ON unit = doc_id GROUP BY qid),
l AS (SELECT qid, n_chunks, sources, list_filter(string_split(ctx, chr(10)), lambda x: x <> '' AND NOT starts_with(x, '[') AND NOT starts_with(x, '---'))[1] AS line FROM c),
a AS (SELECT qid, query, intent, wanted, coalesce(n_chunks, 0) AS n_chunks, coalesce(sources, '') AS sources, regexp_replace(regexp_replace({_TRIM.format('line')}, '\\s*\\[\\s*[Nn]\\s*\\]\\s*$', ''), '\\s+$', '') AS line,
 CASE WHEN intent = 'out_of_scope' THEN 'out_of_scope' WHEN n_chunks IS NULL THEN 'no_chunks' WHEN size % 7 = 3 THEN 'skipped_error' WHEN wanted = 'big' AND size % 5 = 0 THEN 'fallback' WHEN qid % 2 = 0 THEN 'hit' ELSE 'miss' END AS state FROM rw LEFT JOIN l USING (qid)),
res AS (SELECT qid, query, intent, CASE WHEN state IN ('hit', 'miss') THEN wanted WHEN state = 'fallback' THEN 'small' END AS model, state = 'fallback' AS model_fallback, state = 'hit' AS cached,
 CASE state WHEN 'fallback' THEN 'miss' ELSE state END AS cache_reason, n_chunks, sources,
 CASE state WHEN 'out_of_scope' THEN '{ar.OUT_OF_SCOPE_ANSWER}' WHEN 'no_chunks' THEN '{ar.REFUSAL_ANSWER}' WHEN 'skipped_error' THEN '{ar.ERROR_ANSWER}' ELSE line END AS answer FROM a)"""


def oracle_sql() -> dict[str, str]:
    p, r = (sql.MTOK.format(f"lower({c})") for c in ("answer", "query"))
    return {
        "answer_batch": _answers() + " SELECT qid, intent, model, model_fallback, cached, cache_reason, n_chunks, md5(answer) AS answer_md5, sources FROM res",
        "answer_batch_summary": _answers()
        + f""", x AS (SELECT *, {p} AS p, {r} AS r, ['gallic', 'germanic', 'general'][qid % 3 + 1] AS want, qid % 4 = 0 AS refusal, answer = '{ar.ERROR_ANSWER}' AS failed FROM res),
y AS (SELECT *, CASE WHEN len(list_intersect(p, r)) > 0 THEN 2.0 * len(list_intersect(p, r)) / (len(p) + len(r)) ELSE 0.0 END AS rouge,
 CASE WHEN intent = want OR (refusal AND intent IN ('general_football', 'out_of_scope') AND want IN ('general_football', 'out_of_scope')) THEN 1.0 ELSE 0.0 END AS ok FROM x)
SELECT intent AS by_intent, count(*) AS n_cases, count(*) FILTER (NOT failed) AS n_scored, count(*) FILTER (failed) AS n_failed, coalesce(round(avg(rouge) FILTER (NOT failed), 6), 0) AS rouge1,
 coalesce(round(avg(cached::INT) FILTER (NOT failed), 6), 0) AS cached_share, coalesce(round(avg(ok) FILTER (NOT failed), 6), 0) AS intent_accuracy,
 round(avg(contains(answer, '{ar.REFUSAL_STEM}')::INT) FILTER (NOT failed AND refusal), 6) AS refusal_accuracy, count(*) FILTER (NOT failed AND refusal) AS n_refusal FROM y GROUP BY intent""",
    }
