"""Registered queries of the retrieval engine over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qanat.config import AnswerConfig, RetrievalConfig
from qanat.functions import answering, clean, metrics, rules, text
from qanat.operators import bm25, dense, fusion
from qanat.plans import answer_queries
from qanat.plans import articles as art
from qanat.plans import index as search_index
from qanat.plans import evaluation, event_queries, oracle
from qanat.plans import stand_ins as si
from qanat.plans.retrieval import retrieve
from qanat.sources import html
from qanat.sources.tables import first_wins, not_done, scan_plan, spread, table
from qanat.streaming import incremental

def _now():
    return F.lit(si.NOW)

K = 10


def _docs(spark, d):
    return si.documents(spark, d)


def doc_normalize_fold(spark, d):
    folded = text.fold(F.lower("text"), text.LATIN)
    return _docs(spark, d).select("doc_id", F.length(folded).cast("long").alias("n"), F.md5(folded).alias("folded_md5"))


def doc_tokens_count(spark, d):
    t = text.tokens(F.lower("text"), text.LATIN)
    return _docs(spark, d).select(
        "doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"),
        F.md5(F.array_join(t, " ")).alias("tokens_md5"),
    )


def term_df_idf(spark, d):
    """The whole vocabulary, a row each: term, document frequency and idf."""
    return bm25.vocabulary(si.doc_units(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def doc_chunks(spark, d):
    w = text.windows(_docs(spark, d).select("doc_id", "text"), "text", "w")
    return w.select("doc_id", F.size("w").cast("long").alias("total_chunks"), F.posexplode_outer("w").alias("chunk_index", "part")).select(
        F.concat_ws("_", "doc_id", "chunk_index").alias("chunk_id"), "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks",
        F.size(text.words(F.col("part"))).cast("long").alias("n_words"), F.md5("part").alias("part_md5"),
    )


LABELS = {"title": "title", "type": "type", "section": "section", "league": "league", "teams": "teams", "date": "date", "part": "part"}


def chunk_text_prefix(spark, d):
    w = text.windows(si.articles(spark, d), "text", "w")
    w = w.select("*", F.size("w").alias("total"), F.posexplode_outer("w").alias("i", "part"))
    title = F.substring("text", 1, 60)
    made = art.chunk_text(
        title, F.when(F.col("doc_id") % 2 == 0, F.col("article_type")).otherwise("article"), F.col("article_type"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("league")),
        F.array("league", "article_type"), F.col("pub_date"), F.col("part"), F.col("i"), F.col("total"), LABELS, {"src0": "main"},
    )
    return w.select("doc_id", F.col("i").cast("long").alias("i"), F.length(made).cast("long").alias("n"), F.md5(made).alias("text_md5"))


def index_facts(spark, d):
    """The persisted indexes of documents and of their windows: units, terms, postings, mean length."""
    both = None
    for kind in ("doc", "chunk"):
        ix = si.index(spark, d, kind)
        one = ix.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings")).select(
            F.lit(kind).alias("kind"), F.lit(ix.n_units).cast("long").alias("n_units"), "n_terms", "n_postings", F.lit(round(ix.mean, 6)).alias("mean")
        )
        both = one if both is None else both.unionByName(one)
    return both


def bm25_topk(spark, d):
    return search_index.search(si.index(spark, d, "doc"), si.questions(spark, d), 50).select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def dense_topk(spark, d):
    v = si.vectors(spark, d)
    q = v.where("unit % 100 = 0").withColumnRenamed("unit", "qid")
    return dense.search(v, q, K).select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def _sides(spark, d):
    q = si.questions(spark, d, vectors=True)
    return search_index.search(si.index(spark, d, "doc"), q, 50), dense.search(si.vectors(spark, d), q, 50)


def _meta(spark, d):
    return si.articles(spark, d).select(F.col("doc_id").alias("unit"), F.col("doc_id").alias("doc"), "pub_date", "league", "article_type")


def rrf_fused_topk(spark, d):
    fused = fusion.fuse(*_sides(spark, d)).withColumn("score", F.round("rrf", 8))
    return bm25.ranked(fused, K).select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def recency_boosted_topk(spark, d):
    out = fusion.finish(fusion.fuse(*_sides(spark, d)), _meta(spark, d), _now(), {}, collapse=False)
    return out.select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def filtered_topk_post(spark, d):
    index = si.index(spark, d, "doc")
    out = retrieve(index.units, si.questions(spark, d, vectors=True), _now(), si.vectors(spark, d), {"league": "en"}, index=index)
    return out.select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def filtered_topk_pre(spark, d):
    units = si.index(spark, d, "doc").units
    out = retrieve(units, si.questions(spark, d), _now(), None, {"league": "en"}, config=RetrievalConfig(filter_mode="pre"))
    return out.select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def collapse_best_chunk(spark, d):
    hits = search_index.search(si.index(spark, d, "chunk"), si.questions(spark, d), 50)
    best = evaluation.numbered(hits.withColumn("doc", F.floor(F.col("unit") / si.CHUNKS)).withColumn("key", F.struct("qid", "doc")), "key", F.col("score").desc(), "unit")
    return bm25.ranked(best.where("rn = 1").select("qid", "doc", "unit", "score"), K).select("qid", "doc", "unit", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    q = si.questions(spark, d, vectors=True)
    index = si.index(spark, d, "chunk")
    out = retrieve(index.units, q, _now(), si.vectors(spark, d, si.CHUNKS), index=index)
    return out.select("qid", "doc", "unit", "score", F.col("rank").cast("long").alias("rank"))


flagship = hybrid_retrieve


def clean_markup_steps(spark, d):
    steps = [(r"(?s)<script.*?</script>", ""), (r"(?s)<style.*?</style>", ""), (r"https?://\S+", ""), (r"<[^>]+>", " "), (r"&[a-z]+;", " "), (r"[ \t]{2,}", " ")]
    cleaned = F.trim(clean.replace_all(F.col("html"), steps))
    return spread(table(spark, d, "pages")).select("page_id", F.length(cleaned).cast("long").alias("n"), F.md5(cleaned).alias("clean_md5"))


def clean_adjacent_dup(spark, d):
    t = clean.collapse_repeats(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length("text").cast("long").alias("n_before"), F.length(t).cast("long").alias("n_after"))


def clean_body_full(spark, d):
    t = clean.clean_body(F.col("text"), F.substring("text", 1, 60))
    return _docs(spark, d).select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("clean_md5"))


def first_wins_dedup(spark, d):
    return first_wins(_docs(spark, d).select("text", "doc_id", "lang"), "text", "doc_id").select("doc_id", "lang")


def _enriched(spark, d):
    denied = ["src1", "src2"]
    a = _docs(spark, d)
    gone = F.trim("source").isin(*denied)
    return a.select("*", F.when(gone, "section").when(F.length(F.trim("text")) < art.MIN_BODY, "short").otherwise("kept").alias("fate"), F.trim("text").alias("body_clean"))


def short_body_filter_stats(spark, d):
    return art.stats(_enriched(spark, d))


def counts_by_facet_map(spark, d):
    both = None
    for key in ("lang", "source"):
        one = art.counts_map(_docs(spark, d).select(F.col(key).alias("k")), "k").select(F.lit(key).alias("facet"), F.to_json("counts").alias("counts"))
        both = one if both is None else both.unionByName(one)
    return both


LEXICON = [("the", "en_the"), ("ción", "es_cion"), ("sch", "de_sch"), ("eaux", "fr_eaux"), ("License", "license"), ("scum", "slur")]


def lexicon_tags(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(rules.lexicon_tags(F.col("text"), LEXICON), ",").alias("tags"))


CATEGORIES = [("legal", ["License", "rights reserved"]), ("spanish", ["ción", "ñ"]), ("german", ["sch", "ß"]), ("french", ["eaux", "ç"])]


def ordered_category(spark, d):
    t = F.concat_ws(" ", "source", F.substring("text", 1, 300))
    kind = rules.ordered_category(t, CATEGORIES, rules.ordered_category(F.col("source"), [("front", ["src0"]), ("back", ["src1"])], "other"))
    return _docs(spark, d).select("doc_id", kind.alias("category"))


DEMO_RULES = rules.RuleSet(
    ordered=[("legal", [r"licen[cs]e", r"rights\s+reserved"]), ("iberian", [r"ci[oó]n", r"ñ"]), ("germanic", [r"sch", r"ung"]), ("gallic", [r"eau", r"que\s+\S+"])],
    overrides=[("quoted", r"^the\s", r"tion"), ("counted", r"\d{3,}", "")],
    out_of_scope=[r"weather", r"wea\S*", r"recipe"],
    default="general",
    extractive=["legal", "counted"],
    filter_type={"legal": "src0", "iberian": "src1"},
)


def _turns(spark, d):
    return spread(table(spark, d, "conversations"))


def intent_route(spark, d):
    return _turns(spark, d).select("conv_id", "turn", rules.route(F.col("text"), DEMO_RULES).alias("intent"))


ARABIC_PHRASES = [
    "", "ماذا قال مدرب الأهلي بعد الفوز ", "لاعب اسمه زيزو صفقة ", "تشكيل الزمالك ", "نتيجة مباراة أمس ", "كيف الطقس ", "أخبار المران ", "سعر الذهب اليوم ", "إصابة لاعب ", "أي شيء آخر ",
]


def intent_route_arabic(spark, d):
    """The Arabic rule set over all turns, each behind a phrase chosen by its conversation (the turns themselves are not Arabic)."""
    r = rules.arabic_football()
    phrase = F.element_at(F.array(*[F.lit(p) for p in ARABIC_PHRASES]), (F.col("conv_id") % len(ARABIC_PHRASES) + 1).cast("int"))
    t = F.concat(phrase, F.col("text"))
    return _turns(spark, d).select("conv_id", "turn", rules.route(t, r).alias("intent"), rules.article_type(t).alias("article_type"))


def sanitize_query(spark, d):
    dirty = F.concat(F.lit(" <sys<system>tem>\x07<|"), F.col("text"), F.lit("|><<<USER_QUERY>>></user> "))
    s = answering.sanitize(dirty)
    return _turns(spark, d).select("conv_id", "turn", F.length(s).cast("long").alias("n"), F.md5(s).alias("safe_md5"))


def strip_trailing_placeholder(spark, d):
    tail = F.element_at(F.array(F.lit(" [N]"), F.lit("[ n ]\n"), F.lit(" [12]"), F.lit(" [N] x")), (F.col("turn") % 4 + 1).cast("int"))
    s = answering.strip_placeholder(F.concat("text", tail))
    return _turns(spark, d).select("conv_id", "turn", F.length(s).cast("long").alias("n"), F.md5(s).alias("answer_md5"))


SMALL_BUDGET = AnswerConfig(max_tokens=60, max_prompt_tokens=200)


def token_budget(spark, d):
    t = F.col("text")
    cut = answering.within_budget(t, F.col("role"), t, SMALL_BUDGET)
    return _turns(spark, d).select("conv_id", "turn", answering.estimate_tokens(t).cast("long").alias("tokens"), F.length(cut).cast("long").alias("n"), F.md5(cut).alias("context_md5"))


def cache_key(spark, d):
    key = answering.cache_key(F.lit("big"), F.col("role"), F.array(F.concat_ws("_", "conv_id", "turn"), F.lit("7_1")), F.col("text"))
    return _turns(spark, d).select("conv_id", "turn", key.alias("cache_key"))


def cache_ttl_probe(spark, d):
    """Each user's first view is a cached answer; later clicks probe it under the event type's lifetime."""
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    put = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("at").alias("put_at"))
    probe = e.where("event_type <> 'view'").join(put, "user_id", "left")
    seconds = answering.ttl(F.col("event_type"), {"click": 6 * 3600, "error": 3 * 24 * 3600})
    hit = F.coalesce((F.col("at") >= F.col("put_at")) & answering.fresh(F.col("at"), F.col("put_at"), seconds), F.lit(False))
    return probe.select("event_id", hit.alias("hit"))


def context_assembly(spark, d):
    a = si.articles(spark, d)
    rows = evaluation.numbered(a, "article_type", "doc_id").where("rn <= 6")
    entry = answering.context_entry(F.col("rn"), F.substring("text", 1, 60), F.col("pub_date"), F.col("text"), F.col("league") == "en")
    made = rows.select("article_type", "rn", entry.alias("entry"), "doc_id")
    source = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rn", "doc_id"))), 1, 3), lambda x: x["doc_id"].cast("string"))
    ctx = answering.joined(F.col("rn"), F.col("entry"))
    return made.groupBy("article_type").agg(ctx.alias("c"), F.array_join(source, ",").alias("sources")).select(
        "article_type", F.length("c").cast("long").alias("n"), F.md5("c").alias("context_md5"), "sources"
    )


def model_route(spark, d):
    intent = rules.route(F.col("text"), DEMO_RULES)
    asked = F.when(F.col("turn") % 5 == 0, "src9")
    table_ = F.create_map(*[F.lit(x) for kv in DEMO_RULES.filter_type.items() for x in kv])
    return _turns(spark, d).withColumn("intent", intent).select(
        "conv_id", "turn", answering.model_for(F.col("intent"), DEMO_RULES, "small", "big").alias("model"),
        F.coalesce(asked, F.try_element_at(table_, F.col("intent"))).alias("filter_type"),
    )


def html_title_links(spark, d):
    title = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    links = F.regexp_extract_all(F.col("html"), F.lit(r'href="/([^"]*)"'), F.lit(1))
    ids = F.sort_array(F.array_distinct(links), asc=False)
    return table(spark, d, "pages").select("page_id", F.trim(title).alias("title"), F.size(ids).cast("long").alias("n_links"), F.array_join(ids, "|").alias("links"))


def html_article_body(spark, d):
    return html.parse_pages(spread(table(spark, d, "pages")), path="").select(
        "page_id", "title", F.length("body").cast("long").alias("n"), F.md5("body").alias("body_md5"), F.size("tags").cast("long").alias("n_tags"), "source_url"
    )


def metric_rouge1(spark, d):
    """Every document against the benchmark item of its number modulo the items."""
    b = table(spark, d, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n_items"))
    pairs = _docs(spark, d).crossJoin(n).withColumn("item_id", F.col("doc_id") % F.col("n_items")).join(b.withColumnRenamed("text", "reference"), "item_id")
    return pairs.select("doc_id", "item_id", F.round(metrics.rouge1_f1(F.lower("text"), F.col("reference"), text.LATIN), 6).alias("rouge1"))


def _cases(spark, d):
    """Questions as cases: the expected intent goes by number, the keywords are the two longest query tokens."""
    got = rules.route(F.col("query"), DEMO_RULES)
    q = si.questions(spark, d, vectors=True)
    longest = F.slice(F.array_sort(F.transform(F.array_distinct("tokens"), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), 1, 2)
    return q.select(
        "qid", "tokens", "vector", F.element_at(F.array(F.lit("gallic"), F.lit("germanic"), F.lit("general_football")), (F.col("qid") % 3 + 1).cast("int")).alias("intent"),
        F.when(got == "general", "general_football").otherwise(got).alias("predicted"), (F.col("qid") % 4 == 0).alias("refusal"),
        F.transform(longest, lambda x: x["t"]).alias("keywords"), F.col("query").alias("reference"),
    )


def _experiments(spark, d):
    """Hits of three retrievers, five a case, with their texts."""
    q = _cases(spark, d)
    texts = _docs(spark, d).select(F.col("doc_id").alias("unit"), "text")
    index = si.index(spark, d, "doc")
    return evaluation.ablation(index.units, si.vectors(spark, d), q, _now(), texts, index=index), q


def metric_retrieval(spark, d):
    return evaluation.case_metrics(*_experiments(spark, d), folding=text.LATIN).select("experiment", "qid", *[F.round(x, 6).alias(x) for x in evaluation.METRICS])


def metric_intent_accuracy(spark, d):
    got = rules.route(F.col("text"), DEMO_RULES)
    t = _turns(spark, d).withColumn("predicted", F.when(got == "general", "general_football").otherwise(got))
    refusal = F.col("conv_id") % 4 == 0
    want = F.when(refusal, "out_of_scope").when(F.col("role") == "user", "gallic").otherwise("germanic")
    ok = metrics.intent_accuracy(F.col("predicted"), want, refusal)
    return t.groupBy("role").agg(F.round(F.avg(ok), 6).alias("accuracy"), F.round(F.avg(F.when(refusal, ok)), 6).alias("refusal_accuracy"), F.count(F.lit(1)).alias("n"))


def ablation_summary(spark, d):
    return evaluation.summary(evaluation.case_metrics(*_experiments(spark, d), folding=text.LATIN), "experiment")


def ablation_winner(spark, d):
    return evaluation.winner(ablation_summary(spark, d)).select("experiment", "mrr")


def per_group_summary(spark, d):
    return evaluation.summary(evaluation.case_metrics(*_experiments(spark, d), folding=text.LATIN), "experiment", "intent")


def _answers(spark, d):
    """Turns as scored answers of an evaluation; roles stand for expected intents."""
    return _turns(spark, d).select(
        F.contains("text", F.lit("scum")).alias("failed"), (F.col("conv_id") % 4 == 0).alias("refusal"), F.col("role").alias("expected"),
        (F.length("text") % 7 / 7).alias("rouge1"), (F.length("text") % 100 / 100).alias("similarity"), (F.col("turn") % 3 / 2).alias("keyword_hit"),
        (F.col("turn") > 1).cast("int").alias("intent_ok"), F.contains("text", F.lit("que")).cast("int").alias("refused"), (F.length("text") % 50).cast("double").alias("latency_ms"),
    )


def answers_summary(spark, d):
    return evaluation.answers_summary(_answers(spark, d))


def answers_by_intent(spark, d):
    return evaluation.answers_summary(_answers(spark, d), "expected")


def metric_similarity(spark, d):
    """Documents against the one of the next number: cosine of their vectors, 0 where a text is empty."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    t = _docs(spark, d).select(F.col("doc_id").alias("vec_id"), "text").join(v, "vec_id")
    other = t.select(F.col("vec_id").alias("other"), F.col("text").alias("other_text"), F.col("embedding").alias("other_vector"))
    pairs = t.withColumn("other", F.col("vec_id") + 1).join(other, "other")
    sim = metrics.text_similarity(F.col("text"), F.col("other_text"), F.col("embedding"), F.col("other_vector"))
    return pairs.select("vec_id", "other", F.round(sim, 6).alias("similarity"))


def seed_union_range_anti(spark, d):
    """Open orders and viewed events are the seeds, failed events are done; the range is the seeds' own."""
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    seeds = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")).union(e.where("event_type = 'view'").select(F.col("event_id").alias("id"))).distinct()
    done = e.where("event_type = 'error'").select(F.col("event_id").alias("id"))
    return scan_plan(seeds, done=done).select("id", F.col("priority").cast("long").alias("priority"))


def link_ids(spark, d):
    """Article ids among the links of pages, to which links made from their number are added."""
    made = F.concat(*[x for n in (1, 7, 1) for x in (F.lit('<a class="x" href="https://s/articles/'), (F.lit(10_000) + F.col("page_id") * n).cast("string"), F.lit('?a=1">'))])
    ids = html.link_ids(F.concat("html", made))
    return table(spark, d, "pages").select("page_id", F.size(ids).cast("long").alias("n"), F.array_join(ids.cast("array<string>"), ",").alias("ids"))


def article_enrich(spark, d):
    """Documents as articles through the whole batch pipeline: cleaning, filters, tags, folding."""
    a = _docs(spark, d).select(
        F.col("doc_id").alias("article_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"), F.col("source").alias("section"), F.col("lang").alias("article_type")
    )
    return art.enrich(a, ["src1", "src2"]).select(
        "article_id", "fate", F.length("body_clean").cast("long").alias("n"), F.md5("body_clean").alias("clean_md5"), F.md5("title_norm").alias("title_md5"), "league", F.array_join("teams", ",").alias("teams")
    )


def resume_anti_join(spark, d):
    t = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return not_done(_docs(spark, d).select("doc_id", "lang"), t, "doc_id")


def rate_limit_window(spark, d):
    n = incremental.request_counts(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return incremental.over_limit(n, 1).select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.col("rejected").cast("long").alias("rejected"))


def conversation_history(spark, d):
    h = evaluation.last_turns(_turns(spark, d), 4)
    return h.select("conv_id", "n_turns", F.length("history").cast("long").alias("n"), F.md5("history").alias("history_md5"))


def star_join_agg(spark, d):
    c, o, li, n, r = (table(spark, d, x) for x in ("customer", "orders", "lineitem", "nation", "region"))
    joined = (
        li.where("l_shipdate <= timestamp'1998-09-02'").join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    )
    return joined.groupBy("r_name", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    big = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    buyers = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return buyers.join(big, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def topk_per_group(spark, d):
    p = table(spark, d, "part")
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return p.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("p_brand", "p_partkey", "p_retailprice", F.col("rn").cast("long").alias("rn"))


#: Modules with queries of their own.
MORE = [answer_queries, event_queries]

ALL = [
    doc_normalize_fold, doc_tokens_count, term_df_idf, doc_chunks, chunk_text_prefix, index_facts, bm25_topk, dense_topk, rrf_fused_topk, recency_boosted_topk,
    filtered_topk_post, filtered_topk_pre, collapse_best_chunk, hybrid_retrieve, clean_markup_steps, clean_adjacent_dup, clean_body_full, first_wins_dedup,
    short_body_filter_stats, counts_by_facet_map, lexicon_tags, ordered_category, intent_route, intent_route_arabic, sanitize_query,
    strip_trailing_placeholder, token_budget, cache_key, cache_ttl_probe, context_assembly, model_route, html_title_links, html_article_body,
    metric_rouge1, metric_retrieval, metric_intent_accuracy, ablation_summary, ablation_winner, per_group_summary, answers_summary,
    answers_by_intent, metric_similarity, link_ids, article_enrich,
    seed_union_range_anti, resume_anti_join, rate_limit_window, conversation_history, star_join_agg, semi_anti, topk_per_group,
]


def queries() -> dict:
    return {f.__name__: f for f in [*ALL, *(q for m in MORE for q in m.QUERIES)]}


def oracle_sql() -> dict[str, str]:
    found = oracle.sql()
    for m in MORE:
        found |= m.oracle_sql()
    return found
