"""The batch article pipeline: dedup, filter, clean, tag, chunk, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qanat.config import ChunkConfig
from qanat.functions import arabic_rules as ar
from qanat.functions import clean, rules, text
from qanat.session import staged
from qanat.sources.tables import first_wins

MIN_BODY = 80


def enrich(articles: DataFrame, denied: list[str] = ar.DENIED_SECTIONS, folding: text.Folding = text.ARABIC, clean_rules=clean.CleanRules(), own_section: str | None = None) -> DataFrame:
    """Marks every article ``fate``: section, short or kept; adds the computed columns.

    The section filter comes before cleaning, so denied rows are not cleaned.
    Tags see cleaned but not folded text."""
    denied_row = F.trim(F.coalesce("section", F.lit(""))).isin(*denied) if denied else F.lit(False)
    a = articles.withColumn("body_clean", F.when(~denied_row, clean.clean_body(F.col("body"), F.col("title"), clean_rules)))
    fate = F.when(denied_row, "section").when(F.length("body_clean") < MIN_BODY, "short").otherwise("kept")
    return a.select(
        "*", fate.alias("fate"), text.fold(F.col("title"), folding).alias("title_norm"),
        rules.lexicon_tags(F.concat_ws(" ", "title", "body_clean")).alias("teams"),
        rules.league(F.col("title"), F.col("section"), F.col("body_clean"), own_section=own_section).alias("league"),
    )


def chunk_text(title, kind, section, league, teams, day, body, index, total, labels: dict = ar.CHUNK_LABELS, types: dict = ar.TYPE_LABELS):
    """Labelled header parts joined by " | ", a blank line, the part's number if there are several, the body."""
    part = lambda name, value: F.concat(F.lit(labels[name] + ": "), value)
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    type_map = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    header = F.concat_ws(
        " | ",
        part("title", F.coalesce(title, F.lit(""))),
        F.when(kind != "article", part("type", F.coalesce(F.try_element_at(type_map, kind), kind))),
        F.when(some(section), part("section", section)),
        F.when(F.coalesce(league, F.lit("other")) != "other", part("league", league)),
        F.when(F.size(teams) > 0, part("teams", F.array_join(F.slice(teams, 1, 3), " - "))),
        F.when(some(day), part("date", F.substring(day, 1, 10))),
    )
    number = F.when(
        total > 1, F.concat(F.lit(f"[{labels['part']} "), (index + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit("]\n"))
    ).otherwise("")
    return F.concat(header, F.lit("\n\n"), number, body)


def chunks(kept: DataFrame, folding: text.Folding = text.ARABIC, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row a word window of the folded body."""
    folded = kept.withColumn("__folded", text.fold(F.col("body_clean"), folding))
    w = text.windows(folded, "__folded", "__w", config).drop("__folded")
    c = w.select("*", F.size("__w").alias("total_chunks"), F.posexplode_outer("__w").alias("chunk_index", "__body")).drop("__w")
    body = chunk_text(
        F.coalesce("title_norm", "title"), F.col("article_type"), F.col("section"), F.col("league"), F.col("teams"),
        F.col("pub_date"), F.col("__body"), F.col("chunk_index"), F.col("total_chunks"),
    )
    return c.withColumn("chunk_id", F.concat_ws("_", "article_id", "chunk_index")).withColumn("text", body).drop("__body", "fate")


def stats(enriched: DataFrame) -> DataFrame:
    """One row of counts; lengths are those of kept bodies (0 if there is none).  With
    article_type and league columns also how often each occurs among kept rows, as maps."""
    kept = F.col("fate") == "kept"
    size = F.when(kept, F.length("body_clean"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    stride = ChunkConfig()
    n = F.size(text.words(F.col("body_clean")))
    parts = F.when(kept, F.floor(F.greatest(F.lit(0), n - stride.overlap - 1) / (stride.size - stride.overlap)) + 1)
    facets = [(k, default, out) for k, default, out in (("article_type", "article", "article_types"), ("league", "other", "league_coverage")) if k in enriched.columns]
    names = [k for k, _, _ in facets]
    some = enriched.select(kept.alias("kept"), "fate", parts.alias("parts"), size.alias("size"), *[F.when(kept, F.coalesce(k, F.lit(d))).alias(k) for k, d, _ in facets])
    total = [
        F.count(F.lit(1)).alias("total_articles"), F.count_if("kept").alias("articles_processed"), F.count_if(F.col("fate") == "short").alias("skipped_short_body"),
        F.count_if(F.col("fate") == "section").alias("skipped_by_section"), F.sum("parts").alias("total_chunks"), F.sum("size").alias("sum_body_length"),
        F.min("size").alias("min_body_length"), F.max("size").alias("max_body_length"),
    ]
    # one pass over the rows: their combinations of facets are few, and everything else is made of those
    few = some.groupBy(*names).agg(*total)
    entry = F.struct(*names, *[c for c in few.columns if c not in names])
    rows = F.collect_list(entry).alias("rows")
    row = few.agg(
        *[number(F.sum(c)).alias(c) for c in ("total_articles", "articles_processed", "skipped_short_body", "skipped_by_section", "total_chunks")],
        number(F.floor(F.sum("sum_body_length") / F.sum("articles_processed"))).alias("avg_body_length"),
        number(F.min("min_body_length")).alias("min_body_length"), number(F.max("max_body_length")).alias("max_body_length"), *([rows] if facets else []),
    )
    for key, _, out in facets:
        row = row.withColumn(out, _counted(key))
    return row.drop("rows")


def _counted(key: str):
    """Map of a facet's values, in order, to their kept articles, from the combinations listed in ``rows``."""
    own = F.filter("rows", lambda x: x[key].isNotNull())
    values = F.array_sort(F.array_distinct(F.transform(own, lambda x: x[key])))
    n = lambda v: F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + F.when(x[key] == v, x["articles_processed"]).otherwise(0))
    return F.map_from_entries(F.transform(values, lambda v: F.struct(v.alias("k"), n(v).alias("n"))))


def counts_map(rows: DataFrame, key: str) -> DataFrame:
    """One row: map of key to number of rows, keys in order."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def run(raw: DataFrame, order: tuple[str, ...], own_section: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, stats) of raw articles; the first row of an id in ``order`` wins."""
    done = staged(enrich(first_wins(raw, "article_id", *order), own_section=own_section), "articles")  # cleaned once, read by both
    return chunks(done.where("fate = 'kept'")), stats(done)
