"""Registered queries over events, vectors and dictionaries, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.operators import dense, dictionary, rollup, temporal, vector_index
from qanat.plans import oracle as sql
from qanat.plans import stand_ins as si
from qanat.session import shared_dir, staged
from qanat.sources import frontier
from qanat.sources.tables import spread, table

#: Lifetime of what a view has cached, in hours, by its number.
LIFE_HOURS = (1, 6, 24, 200)


def asof_last_view(spark: SparkSession, d: str) -> DataFrame:
    """The last view of its user before every click."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    found = temporal.asof_join(
        e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'"), ["user_id"], "ts", "ts", {"event_id": "view_id", "value": "view_value", "ts": "view_ts"},
    )
    return found.select("event_id", "user_id", "view_id", "view_value", temporal.micros("view_ts").alias("view_us"))


def interval_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Clicks inside the lifetime of what their user's views have cached."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    hours = F.element_at(F.array(*[F.lit(h) for h in LIFE_HOURS]), (F.col("event_id") % len(LIFE_HOURS) + 1).cast("int"))
    put = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("born"), F.timestamp_micros(temporal.micros("ts") + hours.cast("long") * 3_600_000_000).alias("dies"))
    probe = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ts")
    return temporal.interval_join(probe, put, ["user_id"], "ts", "born", "dies").select("user_id", "view_id", "click_id")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users: events less than six hours apart."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,2)").alias("value"))
    s = temporal.sessions(e, ["user_id"], "ts", "6 hours", value="value")
    return s.select("user_id", temporal.micros("session_start").alias("start_us"), temporal.micros("session_end").alias("end_us"), "n_events", F.col("total").cast("double").alias("total"))


def type_week_sums(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the number and value of its type's events over the seven days up to it."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    sums = {"n_week": F.lit(1).cast("long"), "value_week": F.col("value").cast("decimal(18,2)")}
    return temporal.range_sums(e, ["event_type"], "ts", 7 * 86_400, sums).select("event_id", F.col("n_week").cast("long").alias("n_week"), F.col("value_week").cast("double").alias("value_week"))


def user_popularity(spark: SparkSession, d: str) -> DataFrame:
    """Every event with its user's value so far, decayed with a time constant of thirty days."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return temporal.decayed_sums(e, ["user_id"], "ts", F.col("value"), 30 * 86_400).select("event_id", F.round("popularity", 4).alias("popularity"))


def _cube(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    dims = {"event_type": F.col("event_type"), "day": F.date_format("ts", "yyyy-MM-dd"), "bucket": F.pmod("user_id", F.lit(4))}
    return rollup.cube(staged(rollup.cells(e, dims, "user_id", "value"), "event-cells"), list(dims))


def event_cube(spark: SparkSession, d: str) -> DataFrame:
    """Counts, sums and extremes over every grouping of type, day and user bucket, merged from stored cells."""
    return _cube(spark, d).select("event_type", "day", "bucket", F.col("level").cast("long").alias("level"), F.col("n").cast("long").alias("n"), F.col("total").cast("double").alias("total"), "low", "high")


def event_cube_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Users and quantiles of the value of the same groupings, estimated by the cells' sketches."""
    return _cube(spark, d).select("event_type", "day", "bucket", "level", "n_keys", "p50", "p95")


def _vector_index(spark: SparkSession, d: str) -> vector_index.VectorIndex:
    path = f"{shared_dir(spark)}/qanat/vectors-{uuid.uuid4().hex}"
    vector_index.build(si.vectors(spark, d), path)
    return vector_index.load(spark, path)


def clustered_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every hundredth from the clustered index, exact by the bounds of its cells."""
    q = si.vectors(spark, d).where("unit % 100 = 0").withColumnRenamed("unit", "qid")
    return vector_index.search(_vector_index(spark, d), q, 10, exact=True).select("qid", "unit", "score", F.col("rank").cast("long").alias("rank"))


def clustered_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the ten nearest that the index finds with its own number of probes, and of the vectors that are read."""
    index = _vector_index(spark, d)
    q = si.vectors(spark, d).where("unit % 100 = 0").withColumnRenamed("unit", "qid")
    want = dense.search(si.vectors(spark, d), q, 10).select("qid", "unit", F.lit(1).alias("w"))
    got = vector_index.search(index, q, 10).select("qid", "unit", F.lit(1).alias("g"))
    found = want.join(got, ["qid", "unit"], "left").agg(F.count("w").alias("n_near"), F.count("g").alias("n_found"))
    return found.select(F.lit(index.n).alias("n_vectors"), F.lit(len(index)).alias("n_cells"), F.lit(index.probes).alias("n_probes"), "n_near", "n_found", F.round(F.col("n_found") / F.col("n_near"), 4).alias("recall"))


def dictionary_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which words of the benchmark (five characters or more) and names of parts the documents and turns contain."""
    b = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).where("length(name) >= 5 and name not like '%\n%'")
    names = b.unionByName(table(spark, d, "part").select(F.col("p_name").alias("name")))
    docs = si.documents(spark, d).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = spread(table(spark, d, "conversations")).select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    hits = dictionary.contained(docs.unionByName(turns), "text", names)
    return hits.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n_names"), F.md5(F.array_join(F.sort_array(F.collect_list("name")), "|")).alias("names_md5"))


ROUNDS = 4


def frontier_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Four rounds from three pages over links made from the pages' numbers; some lead nowhere, every eleventh page is done."""
    p = spread(table(spark, d, "pages")).select("page_id", "html")
    n = p.count() + 40
    made = F.concat(*[x for k, more in ((7, 2), (3, 1)) for x in (F.lit('<a href="https://s/articles/'), (F.lit(10_000) + (F.col("page_id") * k + more) % n).cast("string"), F.lit('">'))])
    pages = p.select((F.col("page_id") + 10_000).alias("id"), F.concat("html", made).alias("html"))
    seeds = pages.where("id < 10003").select("id")
    done = pages.where("id % 11 = 0").select("id")
    return frontier.crawl(seeds, frontier.stored(pages), done, ROUNDS).select("id", F.col("round").cast("long").alias("round"), "outcome")


QUERIES = [
    frontier_rounds,
    asof_last_view, interval_cache_hits, event_sessions, type_week_sums, user_popularity, event_cube, event_cube_estimates,
    clustered_topk, clustered_recall, dictionary_hits,
]


def oracle_sql() -> dict[str, str]:
    life = "[" + ", ".join(map(str, LIFE_HOURS)) + "]"
    return {
        "asof_last_view": """SELECT c.event_id, c.user_id, v.event_id AS view_id, v.value AS view_value, epoch_us(v.ts) AS view_us
FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
        "interval_cache_hits": f"""SELECT c.user_id, v.event_id AS view_id, c.event_id AS click_id FROM events v JOIN events c
ON v.user_id = c.user_id AND c.ts >= v.ts AND c.ts < v.ts + to_hours({life}[v.event_id % {len(LIFE_HOURS)} + 1]) WHERE v.event_type = 'view' AND c.event_type = 'click'""",
        "event_sessions": """WITH x AS (SELECT user_id, ts, value::DECIMAL(18,2) AS value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOURS) AS end_us, count(*) AS n_events, sum(value)::DOUBLE AS total FROM y GROUP BY user_id, s""",
        "type_week_sums": """SELECT event_id, count(*) OVER w AS n_week, (sum(value::DECIMAL(18,2)) OVER w)::DOUBLE AS value_week FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""",
        "user_popularity": """SELECT a.event_id, round(sum(b.value * exp(-(epoch_us(a.ts) - epoch_us(b.ts)) / (30 * 86400e6))), 4) AS popularity
FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id""",
        "event_cube": """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id % 4 AS bucket, grouping(event_type, strftime(ts, '%Y-%m-%d'), user_id % 4)::BIGINT AS level, count(*) AS n,
 sum(value::DECIMAL(28,6))::DOUBLE AS total, min(value) AS low, max(value) AS high FROM events GROUP BY CUBE (event_type, strftime(ts, '%Y-%m-%d'), user_id % 4)""",
        "clustered_topk": f"WITH {sql.near(10, 'SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 100 = 0')} SELECT qid, unit, score, rank FROM dense",
        "frontier_rounds": f"""WITH RECURSIVE l AS (SELECT page_id + 10000 AS src, unnest(list_transform(regexp_extract_all(html || '<a href="https://s/articles/' || (10000 + (page_id * 7 + 2) % (SELECT count(*) + 40 FROM pages)) ||
 '"><a href="https://s/articles/' || (10000 + (page_id * 3 + 1) % (SELECT count(*) + 40 FROM pages)) || '">', 'href="[^"]*/articles/([0-9]{{4,}})', 1), lambda i: i::BIGINT)) AS dst FROM pages),
done AS (SELECT page_id + 10000 AS id FROM pages WHERE (page_id + 10000) % 11 = 0),
r AS (SELECT page_id + 10000 AS id, 0::BIGINT AS round FROM pages WHERE page_id < 3 AND page_id + 10000 NOT IN (SELECT id FROM done)
 UNION SELECT dst, round + 1 FROM r JOIN l ON src = r.id WHERE round < {ROUNDS - 1} AND dst NOT IN (SELECT id FROM done))
SELECT id, min(round) AS round, CASE WHEN id - 10000 IN (SELECT page_id FROM pages) THEN 'ok' ELSE 'missing' END AS outcome FROM r GROUP BY id""",
        "dictionary_hits": """WITH n AS (SELECT name FROM (SELECT unnest(string_split(text, ' ')) AS name FROM benchmark) WHERE len(name) >= 5 AND NOT contains(name, chr(10)) UNION SELECT p_name FROM part),
t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations),
h AS (SELECT kind, id, name FROM t JOIN n ON contains(text, name))
SELECT kind, id, count(*) AS n_names, md5(string_agg(name, '|' ORDER BY name)) AS names_md5 FROM h GROUP BY kind, id""",
    }
