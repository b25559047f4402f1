"""DuckDB SQL for the registered queries, put together from shared table expressions."""

from __future__ import annotations

WORD = r"[^ \t\n\r\f\x0B]+"
WORDS = f"regexp_extract_all({{0}}, '{WORD}')"
TOK = f"list_filter(regexp_extract_all(lower({{0}}), '{WORD}'), lambda t: len(t) >= 2)"
PARTS = "SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 61) + 1, 240)) AS s"
LATIN_FROM, LATIN_TO = "àáâãäåçèéêëìíîïñòóôõöùúûü", "aaaaaaceeeeiiiinooooouuuu"
FOLD = f"translate(regexp_replace({{0}}, '[̀-ͯ]', '', 'g'), '{LATIN_FROM}', '{LATIN_TO}')"
FOLD_FLAT = f"trim(regexp_replace({FOLD}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
PUB = "strftime(date '2024-01-01' + (doc_id % 365)::INT, '%Y-%m-%d')"

DOC_UNITS = "units AS (SELECT doc_id AS unit, text AS body FROM documents)"
CHUNK_W = f"cw AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), cs AS ({PARTS} FROM cw)"
CHUNK_UNITS = CHUNK_W + ", units AS (SELECT doc_id * 1000 + s // 240 AS unit, array_to_string(w[s + 1 : s + 300], ' ') AS body FROM cs)"
QUESTIONS = "qs AS (SELECT item_id AS qid, text AS query FROM benchmark)"


def bm25(units: str, k: int, out: str = "sparse", where: str = "") -> str:
    return f"""{units}, {QUESTIONS},
tk AS (SELECT unit, unnest({TOK.format('body')}) AS term FROM units {where}),
tf AS (SELECT unit, term, count(*) AS tf FROM tk GROUP BY ALL),
dl AS (SELECT unit, sum(tf) AS dl FROM tf GROUP BY unit),
st AS (SELECT count(*) AS n, (SELECT sum(tf) FROM tf) / count(*) AS avgdl FROM units {where}),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT qid, unnest({TOK.format('query')}) AS term FROM qs),
sc AS (SELECT qid, unit, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (unit), st GROUP BY qid, unit),
{out} AS (SELECT qid, unit, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM sc QUALIFY rank <= {k})"""


def near(k: int, queries: str, scale: int = 1) -> str:
    return f"""qv AS ({queries}),
ns AS (SELECT qid, vec_id * {scale} AS unit,
  round(list_sum(list_transform(list_zip(qv.v, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS score FROM qv, embeddings),
dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit) AS rank FROM ns QUALIFY rank <= {k})"""


QV = "SELECT item_id AS qid, embedding AS v FROM benchmark JOIN embeddings ON item_id = vec_id"
FUSED = """fused AS (SELECT qid, unit, sum(part) AS rrf FROM (
  SELECT qid, unit, 0.3 / (60 + rank) AS part FROM sparse UNION ALL SELECT qid, unit, 0.7 / (60 + rank) AS part FROM dense) GROUP BY qid, unit)"""
AGE = f"greatest(0, date_diff('day', ({PUB})::DATE, date '2025-01-01'))"
BOOST = f"round(rrf * (1 + 0.10 * exp(-({AGE}) / 30.0)), 8)"
RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit)"
RLIKE = "regexp_matches({0}, '{1}')"

INTENT = """CASE WHEN regexp_matches(q, '^the\\s') AND NOT regexp_matches(q, 'tion') THEN 'quoted'
 WHEN regexp_matches(q, '\\d{3,}') THEN 'counted'
 WHEN regexp_matches(q, 'weather|wea\\S*|recipe') THEN 'out_of_scope'
 WHEN regexp_matches(q, 'licen[cs]e|rights\\s+reserved') THEN 'legal'
 WHEN regexp_matches(q, 'ci[oó]n|ñ') THEN 'iberian'
 WHEN regexp_matches(q, 'sch|ung') THEN 'germanic'
 WHEN regexp_matches(q, 'eau|que\\s+\\S+') THEN 'gallic' ELSE 'general' END"""
TURNS = "t AS (SELECT *, lower(text) AS q FROM conversations)"
MTOK = f"list_distinct(regexp_extract_all(lower({FOLD}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'))"


def _experiments() -> str:
    hits = ", ".join(
        f"h{i} AS (SELECT '{name}' AS experiment, * FROM (SELECT qid, unit, {BOOST} AS score FROM ({src}) f JOIN documents d ON f.unit = d.doc_id) x QUALIFY {RANK} <= 5)"
        for i, (name, src) in enumerate(
            [
                ("1_sparse", "SELECT qid, unit, 0.3 / (60 + rank) AS rrf FROM sparse"),
                ("2_dense", "SELECT qid, unit, 0.7 / (60 + rank) AS rrf FROM dense"),
                ("3_hybrid", "SELECT qid, unit, rrf FROM fused"),
            ]
        )
    )
    return f"""WITH {bm25(DOC_UNITS, 50)}, {near(50, QV)}, {FUSED}, {hits},
hits AS (SELECT *, {RANK.replace('PARTITION BY qid', 'PARTITION BY experiment, qid')} AS rank FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)),
tx AS (SELECT experiment, qid, list(text ORDER BY rank) AS texts FROM hits JOIN documents ON unit = doc_id GROUP BY ALL),
kw AS (SELECT qid, query, ['gallic', 'germanic', 'general_football'][qid % 3 + 1] AS intent, qid % 4 = 0 AS refusal, {INTENT} AS g,
  list_transform(list_sort(list_transform(list_distinct({TOK.format('query')}), lambda t: {{'l': -len(t), 't': t}}))[1:2], lambda x: x.t) AS keywords FROM (SELECT *, lower(query) AS q FROM qs)),
cs2 AS (SELECT e.experiment, kw.*, coalesce(tx.texts, []) AS texts FROM (SELECT unnest(['1_sparse', '2_dense', '3_hybrid']) AS experiment) e
  CROSS JOIN kw LEFT JOIN tx ON tx.experiment = e.experiment AND tx.qid = kw.qid),
mt AS (SELECT *, CASE WHEN g = 'general' THEN 'general_football' ELSE g END AS predicted, {MTOK.format("array_to_string(texts, ' ')")} AS p, {MTOK.format('query')} AS r FROM cs2),
m AS (SELECT experiment, qid, intent,
  CASE WHEN len(list_intersect(p, r)) > 0 THEN 2.0 * len(list_intersect(p, r)) / (len(p) + len(r)) ELSE 0.0 END AS rouge1,
  CASE WHEN len(keywords) = 0 THEN 1.0 ELSE len(list_filter(keywords, lambda w: contains(lower(array_to_string(texts, ' ')), w))) / len(keywords) END AS keyword_hit,
  CASE WHEN len(texts) > 0 AND len(list_filter(keywords, lambda w: contains(lower(texts[1]), w))) > 0 THEN 1.0 ELSE 0.0 END AS hit_at_1,
  CASE WHEN len(keywords) = 0 THEN 1.0 ELSE len(list_filter(keywords, lambda w: contains(lower(array_to_string(texts[1:3], ' ')), w))) / len(keywords) END AS recall_at_3,
  coalesce(1.0 / nullif(coalesce(list_position(list_transform(texts, lambda t: len(list_filter(keywords, lambda w: contains(lower(t), w))) > 0), true), 0), 0), 0.0) AS mrr,
  CASE WHEN predicted = intent OR (refusal AND predicted IN ('general_football', 'out_of_scope') AND intent IN ('general_football', 'out_of_scope')) THEN 1.0 ELSE 0.0 END AS intent_accuracy
  FROM mt)"""


MEANS = ", ".join(f"round(coalesce(avg({x}), 0), 6) AS {x}" for x in ("rouge1", "keyword_hit", "hit_at_1", "recall_at_3", "mrr", "intent_accuracy"))


def sql() -> dict[str, str]:
    ltok = f"list_transform(list_filter(regexp_extract_all({FOLD.format('lower(text)')}, '{WORD}'), lambda t: len(t) >= 2), lambda t: CASE WHEN len(regexp_replace(t, '^(qu|de)?(la|le)?', '')) >= 2 THEN regexp_replace(t, '^(qu|de)?(la|le)?', '') ELSE t END)"
    answers = """WITH r AS (SELECT role AS expected, contains(text, 'scum') AS failed, conv_id % 4 = 0 AS refusal, (len(text) % 7) / 7 AS rouge1, (len(text) % 100) / 100 AS similarity, (turn % 3) / 2 AS keyword_hit, turn > 1 AS intent_ok, contains(text, 'que') AS refused, len(text) % 50 AS ms FROM conversations)
SELECT {by}count(*) AS n_cases, count(*) FILTER (NOT failed) AS n_scored, count(*) FILTER (failed) AS n_failed, coalesce(round(avg(rouge1) FILTER (NOT failed), 6), 0) AS rouge1,
 coalesce(round(avg(similarity) FILTER (NOT failed AND NOT refusal), 6), 0) AS similarity, count(*) FILTER (NOT failed AND NOT refusal) AS n_similarity, coalesce(round(avg(keyword_hit) FILTER (NOT failed), 6), 0) AS keyword_hit,
 coalesce(round(avg(intent_ok::INT) FILTER (NOT failed), 6), 0) AS intent_accuracy, round(avg(refused::INT) FILTER (NOT failed AND refusal), 6) AS refusal_accuracy, count(*) FILTER (NOT failed AND refusal) AS n_refusal,
 coalesce(round(avg(ms) FILTER (NOT failed), 1), 0) AS latency_ms FROM r {group}"""
    out = {
        "doc_normalize_fold": f"SELECT doc_id, len(f)::BIGINT AS n, md5(f) AS folded_md5 FROM (SELECT doc_id, {FOLD_FLAT.format('lower(text)')} AS f FROM documents)",
        "doc_tokens_count": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {ltok} AS t FROM documents)",
        "term_df_idf": f"""WITH df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOK.format('text')})) AS term FROM documents) GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS r FROM df), floor AS (SELECT 0.25 * avg(r) AS f FROM raw)
SELECT term, df, round(CASE WHEN r < 0 THEN f ELSE r END, 6) AS idf FROM raw, floor""",
        "doc_chunks": f"WITH {CHUNK_W} SELECT doc_id || '_' || (s // 240) AS chunk_id, doc_id, (s // 240)::BIGINT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::BIGINT AS total_chunks, len(w[s + 1 : s + 300])::BIGINT AS n_words, md5(array_to_string(w[s + 1 : s + 300], ' ')) AS part_md5 FROM cs",
        "chunk_text_prefix": f"""WITH {CHUNK_W}, c AS (SELECT cs.*, s // 240 AS i, count(*) OVER (PARTITION BY doc_id) AS total FROM cs),
x AS (SELECT c.doc_id, i, concat_ws(' | ', 'title: ' || left(text, 60), CASE WHEN c.doc_id % 2 = 0 THEN 'type: ' || CASE source WHEN 'src0' THEN 'main' ELSE source END END,
 'section: ' || source, CASE WHEN c.doc_id % 3 <> 0 THEN 'league: ' || lang END, 'teams: ' || lang || ' - ' || source, 'date: ' || {PUB.replace('doc_id', 'c.doc_id')})
 || chr(10) || chr(10) || CASE WHEN total > 1 THEN '[part ' || (i + 1) || '/' || total || ']' || chr(10) ELSE '' END || array_to_string(w[s + 1 : s + 300], ' ') AS m FROM c JOIN documents USING (doc_id))
SELECT doc_id, i::BIGINT AS i, len(m)::BIGINT AS n, md5(m) AS text_md5 FROM x""",
        "index_facts": " UNION ALL ".join(
            f"""SELECT * FROM (WITH {units}, t AS (SELECT unit, {TOK.format('body')} AS w FROM units), p AS (SELECT DISTINCT unit, unnest(w) AS term FROM t)
SELECT '{kind}' AS kind, count(*) AS n_units, (SELECT count(DISTINCT term) FROM p) AS n_terms, (SELECT count(*) FROM p)::BIGINT AS n_postings, round(avg(len(w)), 6) AS mean FROM t)"""
            for kind, units in (("doc", DOC_UNITS), ("chunk", CHUNK_UNITS))
        ),
        "bm25_topk": f"WITH {bm25(DOC_UNITS, 50)} SELECT qid, unit, score, rank FROM sparse",
        "dense_topk": f"WITH {near(10, 'SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 100 = 0')} SELECT qid, unit, score, rank FROM dense",
        "rrf_fused_topk": f"WITH {bm25(DOC_UNITS, 50)}, {near(50, QV)}, {FUSED}, z AS (SELECT qid, unit, round(rrf, 8) AS score FROM fused) SELECT qid, unit, score, {RANK} AS rank FROM z QUALIFY rank <= 10",
        "recency_boosted_topk": f"WITH {bm25(DOC_UNITS, 50)}, {near(50, QV)}, {FUSED}, z AS (SELECT qid, unit, {BOOST} AS score FROM fused JOIN documents ON unit = doc_id) SELECT qid, unit, score, {RANK} AS rank FROM z QUALIFY rank <= 8",
        "filtered_topk_post": f"WITH {bm25(DOC_UNITS, 200)}, {near(200, QV)}, {FUSED}, z AS (SELECT qid, unit, {BOOST} AS score FROM fused JOIN documents ON unit = doc_id WHERE lang = 'en') SELECT qid, unit, score, {RANK} AS rank FROM z QUALIFY rank <= 8",
        "filtered_topk_pre": f"WITH {bm25(DOC_UNITS.replace('FROM documents', chr(70) + 'ROM documents WHERE lang = ' + repr('en')), 200)}, z AS (SELECT qid, unit, {BOOST.replace('rrf', '0.3 / (60 + rank)')} AS score FROM sparse JOIN documents ON unit = doc_id) SELECT qid, unit, score, {RANK} AS rank FROM z QUALIFY rank <= 8",
        "collapse_best_chunk": f"WITH {bm25(CHUNK_UNITS, 50)}, z AS (SELECT qid, unit // 1000 AS doc, unit, score FROM sparse QUALIFY row_number() OVER (PARTITION BY qid, unit // 1000 ORDER BY score DESC, unit) = 1) SELECT qid, doc, unit, score, {RANK} AS rank FROM z QUALIFY rank <= 10",
        "hybrid_retrieve": f"""WITH {bm25(CHUNK_UNITS, 50)}, {near(50, QV, 1000)}, {FUSED},
z AS (SELECT qid, doc_id AS doc, fused.unit, {BOOST} AS score FROM fused JOIN units USING (unit) JOIN documents ON doc_id = fused.unit // 1000),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, unit) = 1) SELECT qid, doc, unit, score, {RANK} AS rank FROM b QUALIFY rank <= 8""",
        "clean_markup_steps": """WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'),
 '(?s)<style.*?</style>', '', 'g'), 'https?://[^ \\t\\n\\r\\f\\x0B\\x{85}\\x{A0}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{2000}-\\x{200A}\\x{1680}]+', '', 'g'), '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[ \\t]{2,}', ' ', 'g')) AS c FROM pages)
SELECT page_id, len(c)::BIGINT AS n, md5(c) AS clean_md5 FROM c""",
        "first_wins_dedup": "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text",
        "short_body_filter_stats": f"""WITH e AS (SELECT len(trim(text)) AS n, len({WORDS.format('text')}) AS w, CASE WHEN trim(source) IN ('src1', 'src2') THEN 'section' WHEN len(trim(text)) < 80 THEN 'short' ELSE 'kept' END AS fate FROM documents)
SELECT count(*) AS total_articles, count(*) FILTER (fate = 'kept') AS articles_processed, count(*) FILTER (fate = 'short') AS skipped_short_body, count(*) FILTER (fate = 'section') AS skipped_by_section,
 coalesce(sum(greatest(0, w - 61) // 240 + 1) FILTER (fate = 'kept'), 0)::BIGINT AS total_chunks, coalesce(floor(avg(n) FILTER (fate = 'kept')), 0)::BIGINT AS avg_body_length,
 coalesce(min(n) FILTER (fate = 'kept'), 0)::BIGINT AS min_body_length, coalesce(max(n) FILTER (fate = 'kept'), 0)::BIGINT AS max_body_length FROM e""",
        "counts_by_facet_map": "SELECT facet, '{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}' AS counts FROM (SELECT 'lang' AS facet, lang AS k, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source) GROUP BY facet",
        "lexicon_tags": "SELECT doc_id, array_to_string(list_transform(list_filter([{'n': 'the', 'i': 'en_the'}, {'n': 'ción', 'i': 'es_cion'}, {'n': 'sch', 'i': 'de_sch'}, {'n': 'eaux', 'i': 'fr_eaux'}, {'n': 'License', 'i': 'license'}, {'n': 'scum', 'i': 'slur'}], lambda e: contains(text, e.n)), lambda e: e.i), ',') AS tags FROM documents",
        "ordered_category": """SELECT doc_id, CASE WHEN contains(t, 'License') OR contains(t, 'rights reserved') THEN 'legal' WHEN contains(t, 'ción') OR contains(t, 'ñ') THEN 'spanish' WHEN contains(t, 'sch') OR contains(t, 'ß') THEN 'german'
 WHEN contains(t, 'eaux') OR contains(t, 'ç') THEN 'french' WHEN contains(source, 'src0') THEN 'front' WHEN contains(source, 'src1') THEN 'back' ELSE 'other' END AS category FROM (SELECT *, source || ' ' || left(text, 300) AS t FROM documents)""",
        "intent_route": f"WITH {TURNS} SELECT conv_id, turn, {INTENT} AS intent FROM t",
        "sanitize_query": "SELECT conv_id, turn, len(s)::BIGINT AS n, md5(s) AS safe_md5 FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS s FROM conversations)",
        "strip_trailing_placeholder": r"SELECT conv_id, turn, len(s)::BIGINT AS n, md5(s) AS answer_md5 FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text || [' [N]', '[ n ]' || chr(10), ' [12]', ' [N] x'][turn % 4 + 1], '\s*\[\s*[Nn]\s*\]\s*$', ''), '\s+$', '') AS s FROM conversations)",
        "token_budget": """WITH x AS (SELECT *, greatest(1, len(text) // 3) AS tk FROM conversations), y AS (SELECT *, CASE WHEN greatest(1, len(role) // 3) + tk + 60 > 200 THEN left(text, len(text) // 2) ELSE text END AS c FROM x)
SELECT conv_id, turn, tk::BIGINT AS tokens, len(c)::BIGINT AS n, md5(c) AS context_md5 FROM y""",
        "cache_key": "SELECT conv_id, turn, left(sha256(concat_ws(chr(31), array_to_string(list_sort([conv_id || '_' || turn, '7_1']), ','), role, 'big', '3', lower(trim(text)))), 32) AS cache_key FROM conversations",
        "cache_ttl_probe": """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS sec FROM events), p AS (SELECT user_id, min(sec) AS put_at FROM e WHERE event_type = 'view' GROUP BY user_id)
SELECT event_id, coalesce(sec >= put_at AND sec - put_at < CASE event_type WHEN 'click' THEN 21600 WHEN 'error' THEN 259200 ELSE 2592000 END, false) AS hit FROM e LEFT JOIN p USING (user_id) WHERE event_type <> 'view'""",
        "context_assembly": f"""WITH a AS (SELECT source, lang, doc_id, text, {PUB} AS day, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents QUALIFY rn <= 6),
x AS (SELECT source, rn, doc_id, '[' || rn || '] ' || left(text, 60) || ' (' || day || ')' || chr(10) || left(text, CASE WHEN lang = 'en' THEN 1500 ELSE 800 END) AS e FROM a),
g AS (SELECT source AS article_type, string_agg(e, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) AS c, string_agg(doc_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 3) AS sources FROM x GROUP BY source)
SELECT article_type, len(c)::BIGINT AS n, md5(c) AS context_md5, sources FROM g""",
        "model_route": f"WITH {TURNS}, i AS (SELECT *, {INTENT} AS intent FROM t) SELECT conv_id, turn, CASE WHEN intent IN ('legal', 'counted') THEN 'small' ELSE 'big' END AS model, coalesce(CASE WHEN turn % 5 = 0 THEN 'src9' END, CASE intent WHEN 'legal' THEN 'src0' WHEN 'iberian' THEN 'src1' END) AS filter_type FROM i",
        "html_title_links": """WITH x AS (SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title, list_reverse_sort(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS l FROM pages)
SELECT page_id, title, len(l)::BIGINT AS n_links, array_to_string(l, '|') AS links FROM x""",
        "metric_rouge1": f"""WITH x AS (SELECT d.doc_id, b.item_id, {MTOK.format('lower(d.text)')} AS p, {MTOK.format('b.text')} AS r FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, item_id, round(CASE WHEN len(list_intersect(p, r)) > 0 THEN 2.0 * len(list_intersect(p, r)) / (len(p) + len(r)) ELSE 0.0 END, 6) AS rouge1 FROM x""",
        "metric_retrieval": _experiments() + " SELECT experiment, qid, round(rouge1, 6) AS rouge1, round(keyword_hit, 6) AS keyword_hit, round(hit_at_1, 6) AS hit_at_1, round(recall_at_3, 6) AS recall_at_3, round(mrr, 6) AS mrr, intent_accuracy FROM m",
        "ablation_summary": _experiments() + f" SELECT experiment, {MEANS}, count(*) AS n_cases FROM m GROUP BY experiment",
        "ablation_winner": _experiments() + ", s AS (SELECT experiment, round(avg(mrr), 6) AS mrr FROM m GROUP BY experiment) SELECT experiment, mrr FROM s ORDER BY mrr DESC, experiment LIMIT 1",
        "per_group_summary": _experiments() + f" SELECT experiment, intent, {MEANS}, count(*) AS n_cases FROM m GROUP BY experiment, intent",
        "metric_intent_accuracy": f"""WITH {TURNS}, i AS (SELECT *, {INTENT} AS g, conv_id % 4 = 0 AS refusal FROM t),
x AS (SELECT role, refusal, CASE WHEN g = 'general' THEN 'general_football' ELSE g END AS p, CASE WHEN refusal THEN 'out_of_scope' WHEN role = 'user' THEN 'gallic' ELSE 'germanic' END AS want FROM i),
y AS (SELECT *, CASE WHEN p = want OR (refusal AND p IN ('general_football', 'out_of_scope') AND want IN ('general_football', 'out_of_scope')) THEN 1.0 ELSE 0.0 END AS ok FROM x)
SELECT role, round(avg(ok), 6) AS accuracy, round(avg(ok) FILTER (refusal), 6) AS refusal_accuracy, count(*) AS n FROM y GROUP BY role""",
        "answers_summary": answers.format(by="", group=""),
        "answers_by_intent": answers.format(by="expected, ", group="GROUP BY expected"),
        "metric_similarity": """WITH t AS (SELECT vec_id, text, embedding FROM embeddings JOIN documents ON vec_id = doc_id)
SELECT a.vec_id, b.vec_id AS other, round(CASE WHEN a.text <> '' AND b.text <> '' THEN list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) ELSE 0.0 END, 6) AS similarity
FROM t a JOIN t b ON b.vec_id = a.vec_id + 1""",
        "link_ids": """WITH x AS (SELECT page_id, list_reverse_sort(list_distinct(list_transform(regexp_extract_all(html || '<a href="/articles/' || (10000 + page_id) || '"><a href="/articles/' || (10000 + page_id * 7) || '">',
 'href="[^"]*/articles/([0-9]{4,})', 1), lambda i: i::BIGINT))) AS l FROM pages) SELECT page_id, len(l)::BIGINT AS n, array_to_string(l, ',') AS ids FROM x""",
        "seed_union_range_anti": """WITH seeds AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT event_id FROM events WHERE event_type = 'view'),
r AS (SELECT unnest(range(min(id) - 500, max(id) + 1)) AS id FROM seeds),
p AS (SELECT id, 0::BIGINT AS priority FROM seeds UNION ALL SELECT id, 1 FROM r WHERE id NOT IN (SELECT id FROM seeds))
SELECT id, priority FROM p WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')""",
        "resume_anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "rate_limit_window": "SELECT user_id, strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, greatest(0, count(*) - 1)::BIGINT AS rejected FROM events GROUP BY ALL",
        "conversation_history": """WITH x AS (SELECT conv_id, role || ': ' || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role || ': ' || text DESC) AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations)
SELECT conv_id, n_turns, len(h)::BIGINT AS n, md5(h) AS history_md5 FROM (SELECT conv_id, n_turns, string_agg(line, chr(10) ORDER BY pos DESC) AS h FROM x WHERE pos <= 4 GROUP BY conv_id, n_turns)""",
        "star_join_agg": """SELECT r_name, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
        "semi_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
        "topk_per_group": "SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part QUALIFY rn <= 3",
    }
    return out
