"""The link frontier against a plain breadth-first walk."""

from pyspark.sql import functions as F

from qanat.sources import frontier


def pages_of(spark, graph):
    rows = [(i, "".join(f'<a href="/articles/{j}">' for j in out)) for i, out in graph.items()]
    return spark.createDataFrame(rows, "id long, html string")


GRAPH = {1000: [1001, 1002, 1000], 1001: [1003, 1999], 1002: [1001, 1004], 1003: [1000], 1004: [1005], 1005: [1006], 1006: []}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rounds(spark):
    seeds = spark.createDataFrame([(1000,), (1000,), (None,)], "id long")
    asked = []

    def fetch(todo):
        asked.extend(r["id"] for r in todo.collect())
        return frontier.stored(pages_of(spark, GRAPH))(todo)

    got = rows(frontier.crawl(seeds, fetch, rounds=4))
    assert got == [(1000, 0, "ok", 1), (1001, 1, "ok", 1), (1002, 1, "ok", 1), (1003, 2, "ok", 1), (1004, 2, "ok", 1), (1005, 3, "ok", 1), (1999, 2, "missing", 1)]
    assert len(asked) == len(set(asked))
    # a restart goes on from what is done
    done = spark.createDataFrame([(i,) for i, *_ in got if i != 1005], "id long")
    assert rows(frontier.crawl(spark.createDataFrame([(1005,), (1001,)], "id long"), frontier.stored(pages_of(spark, GRAPH)), done)) == [(1005, 0, "ok", 1), (1006, 1, "ok", 1)]
    assert rows(frontier.crawl(seeds.where("id < 0"), frontier.stored(pages_of(spark, GRAPH)))) == []


def test_outcomes(spark):
    pages = pages_of(spark, GRAPH)

    def fetch(todo):
        status = F.when((F.col("id") == 1001) & (F.col("tries") < 3), 429).when(F.col("id") == 1002, 429).when(F.col("id") == 1003, 500).otherwise(200)
        return todo.join(pages, "id").select("id", status.alias("status"), "html")

    got = {r["id"]: (r["outcome"], r["tries"], r["round"]) for r in frontier.crawl(spark.createDataFrame([(1000,)], "id long"), fetch).collect()}
    assert got == {1000: ("ok", 1, 0), 1001: ("ok", 3, 3), 1002: ("throttled", 3, 3), 1003: ("failed", 1, 4), 1999: ("missing", 1, 4)}


def test_listing_pages(spark):
    assert rows(frontier.listed(pages_of(spark, GRAPH))) == [(i,) for i in sorted({j for out in GRAPH.values() for j in out})]
