"""Evaluation: retriever configurations times cases, metrics, summaries, the winner."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qanat.config import RetrievalConfig
from qanat.functions import metrics as m
from qanat.functions import rules, text
from qanat.functions.text import ARABIC, Folding
from qanat.operators import bm25, dense, fusion
from qanat.plans import index as search_index
from qanat.plans.retrieval import sent
from qanat.session import staged

METRICS = ["rouge1", "keyword_hit", "hit_at_1", "recall_at_3", "mrr", "intent_accuracy"]
#: Names of the retrievers that an ablation compares.
EXPERIMENTS = ["1_sparse", "2_dense", "3_hybrid"]


def case_metrics(hits: DataFrame, cases: DataFrame, k: int = 5, folding: Folding = ARABIC, experiments: list[str] = EXPERIMENTS) -> DataFrame:
    """One row per experiment and case: ``hits`` has experiment, qid, rank, text; ``cases``
    has qid, intent, reference, keywords, predicted (intent) and refusal.  ROUGE compares the
    reference with all k texts joined.  A case without hits counts with no texts."""
    found = hits.where(F.col("rank") <= k).groupBy("experiment", "qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts")
    )
    every = F.explode(F.array(*[F.lit(x) for x in experiments])).alias("experiment")
    rows = cases.select(every, "*").join(found, ["experiment", "qid"], "left")
    texts, kw = F.coalesce("texts", F.array().cast("array<string>")), F.col("keywords")
    return rows.select(
        "experiment", "qid", "intent",
        m.rouge1_f1(F.array_join(texts, " "), F.col("reference"), folding).alias("rouge1"),
        m.keyword_hit(texts, kw).alias("keyword_hit"), m.hit_at_1(texts, kw).alias("hit_at_1"),
        m.keyword_hit(texts, kw, 3).alias("recall_at_3"), m.reciprocal_rank(texts, kw).alias("mrr"),
        m.intent_accuracy(F.col("predicted"), F.col("intent"), F.col("refusal")).alias("intent_accuracy"),
    )


def summary(scored: DataFrame, *by: str, digits: int = 6, metrics: list[str] = METRICS) -> DataFrame:
    """Means of the metrics and the number of cases by experiment (and group)."""
    return scored.groupBy(*by).agg(*[F.round(m.mean_or_zero(F.col(x)), digits).alias(x) for x in metrics], F.count(F.lit(1)).alias("n_cases"))


def per_intent(scored: DataFrame) -> DataFrame:
    """The breakdown of a report: ROUGE, keyword hits and cases of every experiment and intent."""
    return summary(scored, "experiment", "intent", digits=3, metrics=["rouge1", "keyword_hit"]).orderBy("experiment", "intent")


def winner(summaries: DataFrame) -> DataFrame:
    """The experiment of greatest mean reciprocal rank; the lesser name of equals."""
    return summaries.orderBy(F.col("mrr").desc(), "experiment").limit(1)


def ablation(units: DataFrame, vectors: DataFrame | None, cases: DataFrame, now, texts: DataFrame, k: int = 5, pool: int = 50, index=None) -> DataFrame:
    """Hits (experiment, qid, unit, rank, text) of the sparse, dense and hybrid retriever for
    every case (qid, tokens, vector).  Both ranked pools are made once and shared."""
    config = RetrievalConfig(k_final=k, pool=pool)
    sparse = bm25.search(units, cases, pool) if index is None else search_index.search(index, cases, pool)
    near = dense.search(vectors, cases, pool) if vectors is not None else None
    n_cases = cases.count()
    runs = dict(zip(EXPERIMENTS, [(sparse, None), (None, near), (sparse, near)] if near is not None else [(sparse, None)]))
    hits = None
    for name, (s, n) in runs.items():
        one = fusion.finish(sent(fusion.fuse(s, n, config), n_cases * pool * 2), units.drop("tokens"), now, {}, config).select(F.lit(name).alias("experiment"), "qid", "unit", "rank")
        hits = one if hits is None else hits.unionByName(one)
    return sent(hits, n_cases * k * len(runs)).join(texts, "unit")


CASES = "question string, reference string, intent string, difficulty string, keywords array<string>, expected_refusal boolean"


def load_cases(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    """The evaluation set at ``path``; where there is none, ``default`` is written there first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CASES).json(path).fillna({"expected_refusal": False})
    except AnalysisException:
        if default is None:
            raise
        default.write.mode("errorifexists").json(path)
        return spark.read.schema(CASES).json(path).fillna({"expected_refusal": False})


SCORED = "answer string, reference string, texts array<string>, keywords array<string>, intent string, expected string, refusal boolean, latency_ms double"


def evaluate_answers(engine, cases: DataFrame, stem: str, error: str, folding: Folding = ARABIC, store=None) -> DataFrame:
    """Answers all cases as one batch and returns one row a case for ``answers_summary``.  Keywords are looked
    for in the answer and its source titles; similarity is the cosine of the texts' vectors (both encoded as
    queries); latency is what the batch took for the question."""
    from qanat.plans.answers import answer_batch

    numbered = staged(cases.withColumn("qid", F.monotonically_increasing_id()), "cases")
    got = answer_batch(engine, numbered.select("qid", F.col("question").alias("query")), store)
    rows = got.withColumnRenamed("intent", "found").join(numbered, "qid").select(
        "answer", "reference", F.concat(F.array("answer"), F.transform("sources", lambda s: s["title"])).alias("texts"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.col("found").alias("intent"), F.coalesce("intent", F.lit(DEFAULT_INTENT)).alias("expected"),
        F.coalesce("expected_refusal", F.lit(False)).alias("refusal"), (F.col("retrieval_ms") + F.col("llm_ms")).cast("double").alias("latency_ms"),
    )
    return scored_answers(rows, stem, error, engine.embed or dense.hashing_embedder(), folding)


def scored_answers(got: DataFrame, stem: str, error: str, embed, folding: Folding = ARABIC) -> DataFrame:
    """Metrics of generated answers (columns of ``SCORED``), one row a case."""
    encode = dense.encoder(embed)
    vector = lambda c: encode(F.concat(F.lit("query: "), F.coalesce(F.col(c), F.lit(""))))
    got = got.withColumn("a", vector("answer")).withColumn("b", vector("reference"))
    return got.select(
        F.contains("answer", F.lit(error)).alias("failed"), "refusal", "expected", "latency_ms",
        m.rouge1_f1(F.col("answer"), F.col("reference"), folding).alias("rouge1"),
        F.when(~F.col("refusal"), m.text_similarity(F.col("answer"), F.col("reference"), F.col("a"), F.col("b"))).alias("similarity"),
        m.keyword_hit(F.col("texts"), F.col("keywords")).alias("keyword_hit"), m.intent_accuracy(F.col("intent"), F.col("expected"), F.col("refusal")).alias("intent_ok"),
        F.contains("answer", F.lit(stem)).cast("int").alias("refused"),
    )


def answers_summary(rows: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """Counts and means of generated answers (failed, refusal, rouge1, similarity, keyword_hit,
    intent_ok, refused, latency_ms), over all or by a group.  Failures are not scored.
    Similarity is over content cases, refusal accuracy over refusal cases (null without any),
    all other means over both."""
    ok = ~F.col("failed")
    content = ok & ~F.col("refusal")
    mean = lambda cond, x, d=digits: F.round(F.avg(F.when(cond, F.col(x).cast("double"))), d)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(ok).alias("n_scored"), F.count_if(F.col("failed")).alias("n_failed"),
        zero(mean(ok, "rouge1")).alias("rouge1"), zero(mean(content, "similarity")).alias("similarity"), F.count_if(content).alias("n_similarity"),
        zero(mean(ok, "keyword_hit")).alias("keyword_hit"), zero(mean(ok, "intent_ok")).alias("intent_accuracy"),
        mean(ok & F.col("refusal"), "refused").alias("refusal_accuracy"), F.count_if(ok & F.col("refusal")).alias("n_refusal"),
        zero(mean(ok, "latency_ms", 1)).alias("latency_ms"),
    )


DEFAULT_INTENT = "general_football"


def ask_cases(cases: DataFrame, rule_set: rules.RuleSet, folding: Folding = ARABIC, embed=None) -> DataFrame:
    """Evaluation cases (``CASES``) as queries of an ablation: qid, tokens, intent, predicted, refusal and (with an encoder) vector."""
    q = cases.select(
        F.xxhash64("question").alias("qid"), "question", "reference", F.coalesce("intent", F.lit(DEFAULT_INTENT)).alias("intent"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("expected_refusal", F.lit(False)).alias("refusal"),
        text.tokens(F.col("question"), folding).alias("tokens"), rules.route(F.col("question"), rule_set).alias("predicted"),
    )
    return q.withColumn("vector", dense.encoder(embed)(F.concat(F.lit("query: "), F.col("question")))) if embed is not None else q


def full_report(units: DataFrame, vectors: DataFrame | None, cases: DataFrame, now: Column, texts: DataFrame, answers: DataFrame | None = None, index=None) -> dict:
    """What an evaluation run reports: every retriever's means with their breakdown by intent,
    the best by mean reciprocal rank, and the summary of generated answers if there are any.
    Latency is that of the whole batch over its cases."""
    names = EXPERIMENTS if vectors is not None else EXPERIMENTS[:1]
    t0 = time.monotonic()
    scored = case_metrics(ablation(units, vectors, cases, now, texts, index=index), cases, experiments=names).persist()
    try:
        total = summary(scored, "experiment", digits=3).orderBy("experiment").collect()  # one row an experiment
        ms = (time.monotonic() - t0) * 1000
        parts = per_intent(scored).collect()
    finally:
        scored.unpersist()
    tables = []
    for r in total:
        own = {p["intent"]: {x: p[x] for x in ("rouge1", "keyword_hit", "n_cases")} for p in parts if p["experiment"] == r["experiment"]}
        tables.append(r.asDict() | {"latency_ms": round(ms / max(1, r["n_cases"] * len(total)), 1), "per_intent": own})
    best = min(tables, key=lambda r: (-r["mrr"], r["experiment"]))["experiment"] if tables else None
    rag = None
    if answers is not None:
        rag = answers_summary(answers, digits=3).first().asDict()
        rag["per_intent"] = {r["expected"]: {k: v for k, v in r.asDict().items() if k != "expected"} for r in answers_summary(answers.where("not failed"), "expected", digits=3).orderBy("expected").collect()}
    return {"ablation": tables, "best": best, "rag": rag}


def tables_of(found: dict) -> str:
    """A report as text: the ablation, the best retriever's intents, the answers."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else "-" if v is None else str(v)

    def table(head, rows):
        return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])

    head = ["experiment", "keyword_hit", "hit_at_1", "recall_at_3", "mrr", "intent_accuracy", "latency_ms"]
    out = [table(head, [[r[h] for h in head] for r in found["ablation"]])]
    best = next((r for r in found["ablation"] if r["experiment"] == found["best"]), None)
    if best:
        out.append(f"Best by mrr: {best['experiment']} ({best['mrr']:.3f})")
        out.append(table(["intent", "rouge1", "keyword_hit", "n_cases"], [[k, v["rouge1"], v["keyword_hit"], v["n_cases"]] for k, v in sorted(best["per_intent"].items())]))
    if found["rag"]:
        rag = {k: v for k, v in found["rag"].items() if k != "per_intent"}
        out.append(table(["answers", "value"], rag.items()))
        out.append(table(["intent", "rouge1", "similarity", "keyword_hit", "intent_accuracy", "n_scored"], [[k, v["rouge1"], v["similarity"], v["keyword_hit"], v["intent_accuracy"], v["n_scored"]] for k, v in sorted(found["rag"]["per_intent"].items())]))
    return "\n\n".join(out)


def report(frame: DataFrame) -> str:
    """A small summary as a Markdown table (rows are experiments or groups)."""
    head = "| " + " | ".join(frame.columns) + " |"
    rule = "|" + "---|" * len(frame.columns)
    return "\n".join([head, rule, *["| " + " | ".join(str(x) for x in r) + " |" for r in frame.toLocalIterator()]])


def last_turns(turns: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` turns of every conversation as one text (``role: text`` lines in order)
    and the number of all its turns.  A conversation of any length keeps ``n`` rows."""
    line = F.concat_ws(": ", "role", "text")
    late = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), line.desc())
    kept = turns.withColumn("at", F.row_number().over(late)).where(F.col("at") <= n)
    history = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("at")).alias("at"), line.alias("l")))), lambda x: x["l"])
    total = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return kept.groupBy("conv_id").agg(F.array_join(history, "\n").alias("history")).join(total, "conv_id")


def numbered(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
