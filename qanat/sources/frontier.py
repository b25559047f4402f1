"""A link frontier in rounds: fetch, read links, keep those never seen.

A round is a few joins over the whole frontier.  What a round has fetched is written before the next
one reads it, ids and outcomes only once pages are parsed, so a lost executor repeats its own part of a
round and no page is fetched again because a later round needs its links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qanat.session import staged
from qanat.sources.html import link_ids

#: Gets (id, tries) and gives (id, status, html): status 200, 404, 429 or another; an id without a row counts as 404.
Fetch = Callable[[DataFrame], DataFrame]


def stored(pages: DataFrame) -> Fetch:
    """Fetches from a table of pages (id, html)."""

    def fetch(asked: DataFrame) -> DataFrame:
        return asked.join(pages.select("id", "html"), "id").select("id", F.lit(200).alias("status"), "html")

    return fetch


def outcome(status: Column) -> Column:
    return F.when(status == 200, "ok").when(F.coalesce(status, F.lit(404)) == 404, "missing").when(status == 429, "throttled").otherwise("failed")


def crawl(seeds: DataFrame, fetch: Fetch, done: DataFrame | None = None, rounds: int = 10, tries: int = 3, links: Callable[[Column], Column] = link_ids) -> DataFrame:
    """(id, round, outcome, tries) of every id that was asked for: ``seeds`` (id) and what their pages link to, round by
    round, without the ids in ``done``.

    An id is asked for in the first round that knows it.  ``throttled`` ids are asked again in the next rounds, ``tries`` times in
    all; missing and failed ones are done like the others.  The last outcome of an id is returned; ids whose pages were
    never asked for because ``rounds`` ran out are not.  Null ids are left out.
    """
    spark = seeds.sparkSession
    fresh = lambda ids: ids.where("id is not null").distinct()
    known = fresh(done.select(F.col("id").cast("long").alias("id"))) if done is not None else spark.createDataFrame([], "id long")
    todo = fresh(seeds.select(F.col("id").cast("long").alias("id"))).join(known, "id", "left_anti").select("id", F.lit(1).alias("tries"))
    seen: DataFrame | None = None
    for n in range(rounds):
        got = fetch(todo).select(F.col("id").cast("long").alias("id"), "status", "html").groupBy("id").agg(F.max_by("html", "status").alias("html"), F.max("status").alias("status"))
        page = todo.join(got, "id", "left").select("id", "tries", outcome(F.col("status")).alias("outcome"), F.when(F.col("status") == 200, links(F.col("html"))).alias("links"))
        page = staged(page.withColumn("round", F.lit(n)), "frontier")
        seen = page if seen is None else seen.unionByName(page)
        new = fresh(page.select(F.explode("links").alias("id"))).join(known, "id", "left_anti").join(seen.select("id"), "id", "left_anti").select("id", F.lit(1).alias("tries"))
        again = page.where((F.col("outcome") == "throttled") & (F.col("tries") < tries)).select("id", (F.col("tries") + 1).alias("tries"))
        todo = staged(new.unionByName(again), "todo")
        if todo.isEmpty():
            break
    if seen is None:
        return spark.createDataFrame([], "id long, round int, outcome string, tries int")
    last = seen.groupBy("id").agg(F.max_by(F.struct("round", "outcome", "tries"), "round").alias("x"))
    return last.select("id", "x.round", "x.outcome", "x.tries")


def listed(pages: DataFrame, links: Callable[[Column], Column] = link_ids) -> DataFrame:
    """Seeds (id) from listing pages (html): the distinct ids they link to."""
    return pages.select(F.explode(links(F.col("html"))).alias("id")).where("id is not null").distinct()
