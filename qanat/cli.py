"""Command line: ``python -m qanat.cli articles|parse|plan|index|ask|evaluate ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qanat.engine import Engine, StoreCache
from qanat.functions import arabic_rules as ar
from qanat.functions import text
from qanat.operators import dense
from qanat.plans import answers, articles, evaluation
from qanat.plans import index as search_index
from qanat.plans.default_cases import default_cases
from qanat.sources import html, tables
from qanat.sources.keyed_store import KeyedStore


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_articles(spark: SparkSession, source: str, out: str, own_section: str | None = None) -> dict | None:
    """Articles (JSON lines) to ``out``/chunks and ``out``/stats; None without input.  ``own_section``: see ``rules.league``."""
    if not exists(spark, source):
        return None
    chunks, stats = articles.run(tables.read_jsonl(spark, source), ("file", "block", "line"), own_section)
    chunks.drop("file", "block", "line").write.mode("overwrite").parquet(f"{out}/chunks")
    tables.write_json(stats.withColumn("processed_at", F.current_timestamp()), f"{out}/stats")
    return stats.first().asDict()


def parse_pages(spark: SparkSession, pages: str, out: str, path: str, done: str | None, most: int | None = None) -> None:
    """Appends the articles of new pages as JSON lines, those of the greatest ids if there are more than ``most``."""
    rows = spark.read.parquet(pages)
    if done and exists(spark, done):
        rows = tables.not_done(rows, spark.read.json(done).select(F.col("article_id").alias("page_id")), "page_id")
    found = html.parse_pages(rows, path).withColumnRenamed("page_id", "article_id")
    tables.append_jsonl(found if most is None else found.orderBy(F.col("article_id").desc()).limit(most), out)


def plan(spark: SparkSession, seeds: str, out: str, done: str | None, start: int | None, end: int | None, most: int | None) -> None:
    """Writes the ids to visit (JSON lines), from seeds (Parquet, column id)."""
    visited = spark.read.json(done).select(F.col("article_id").alias("id")) if done and exists(spark, done) else None
    tables.write_json(tables.scan_plan(spark.read.parquet(seeds), start, end, visited, limit=most), out)


def units_of(chunks: DataFrame) -> DataFrame:
    """Chunk rows as units of retrieval."""
    unit = F.col("article_id") * 100_000 + F.col("chunk_index")
    return chunks.select("*", unit.alias("unit"), F.col("article_id").alias("doc"), text.tokens(F.col("text")).alias("tokens"))


def run_index(spark: SparkSession, chunks: str, out: str, vectors: bool = True) -> None:
    """Writes the index of ``chunks`` with vectors of the stand-in encoder."""
    u = units_of(spark.read.parquet(chunks))
    encode = dense.encoder(dense.hashing_embedder())
    v = u.select("unit", encode(F.concat(F.lit("passage: "), F.col("text"))).alias("vector")) if vectors else None
    search_index.build(u, out, v)


def engine(spark: SparkSession, chunks: str | None, index: str | None, cache: str | None = None, **more) -> Engine:
    if cache:
        more["cache"] = StoreCache(KeyedStore(spark, cache, answers.STORE))
    return Engine.serve(spark, index, **more) if index else Engine(units_of(spark.read.parquet(chunks)), **more)


def ask(spark: SparkSession, chunks: str | None, query: str, index: str | None = None, cache: str | None = None, **filters) -> dict:
    return engine(spark, chunks, index, cache).ask(query, **filters)


def evaluate(spark: SparkSession, index: str, cases: str, answers: bool = False, report: str | None = None, now: str | None = None, **more) -> dict:
    """Compares the retrievers on the evaluation set at ``cases`` (the built-in one is written
    there if there is none), and generated answers with ``answers``; ``report``: a JSON file."""
    found = search_index.load(spark, index)
    e = Engine.over(found, now=now, **more)
    rows = evaluation.load_cases(spark, cases, default_cases(spark))
    asked = evaluation.ask_cases(rows, e.rules, e.folding, (e.embed or dense.hashing_embedder()) if found.vectors is not None else None)
    day = F.lit(now).cast("date") if now else F.current_date()
    scored = evaluation.evaluate_answers(e, rows, ar.REFUSAL_STEM, ar.ERROR_ANSWER) if answers else None
    out = evaluation.full_report(found.units, found.vectors, asked, day, found.units.select("unit", "text"), scored, found)
    if report:
        row = spark.createDataFrame([(json.dumps(out, ensure_ascii=False),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(report)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="qanat")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("articles", help="clean, tag and chunk raw articles")
    a.add_argument("--input", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--own-section")
    a = sub.add_parser("parse", help="articles of stored pages")
    a.add_argument("--pages", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--path", default="/articles/")
    a.add_argument("--no-resume", action="store_true")
    a.add_argument("--max", type=int)
    a = sub.add_parser("plan", help="ids to visit")
    a.add_argument("--seeds", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--done")
    a.add_argument("--start-id", type=int)
    a.add_argument("--end-id", type=int)
    a.add_argument("--max", type=int)
    a.add_argument("--no-resume", action="store_true")
    a = sub.add_parser("index", help="build the search index of chunks")
    a.add_argument("--chunks", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--no-vectors", action="store_true")
    a = sub.add_parser("evaluate", help="compare retrievers, and answers with --rag")
    a.add_argument("--index", required=True)
    a.add_argument("--cases", required=True)
    a.add_argument("--rag", action="store_true")
    a.add_argument("--save-report")
    a = sub.add_parser("ask", help="answer one question")
    a.add_argument("query")
    where = a.add_mutually_exclusive_group(required=True)
    where.add_argument("--chunks")
    where.add_argument("--index")
    a.add_argument("--cache")
    for f in ("article-type", "league", "team"):
        a.add_argument(f"--{f}")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("qanat").getOrCreate()
    if args.what == "articles":
        print(json.dumps(run_articles(spark, args.input, args.out, args.own_section), ensure_ascii=False))
    elif args.what == "parse":
        parse_pages(spark, args.pages, args.out, args.path, None if args.no_resume else args.out, args.max)
    elif args.what == "plan":
        plan(spark, args.seeds, args.out, None if args.no_resume else args.done, args.start_id, args.end_id, args.max)
    elif args.what == "index":
        run_index(spark, args.chunks, args.out, not args.no_vectors)
    elif args.what == "evaluate":
        print(evaluation.tables_of(evaluate(spark, args.index, args.cases, args.rag, args.save_report)))
    else:
        print(json.dumps(ask(spark, args.chunks, args.query, args.index, args.cache, article_type=args.article_type, league=args.league, team=args.team), ensure_ascii=False))


if __name__ == "__main__":
    main()
