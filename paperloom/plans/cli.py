"""Command line: ``python -m paperloom <job> ...``."""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import sys
from datetime import datetime
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import agents, curate, encoders, extract, retrieve, sample
from ..sources import files, sinks
from . import jobs

LOG = logging.getLogger("paperloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom")
    p.add_argument("--log-dir", help="also write what is logged to a file named by job and time")
    sub = p.add_subparsers(dest="job", required=True)
    e = sub.add_parser("extract", help="pages to datasets")
    e.add_argument("--pages", help="Parquet table of page_id, url, html; without it pages are fetched")
    e.add_argument("--base-url", default="")
    e.add_argument("--years", nargs="*", default=[])
    e.add_argument("--months", nargs="*", default=[])
    e.add_argument("--start-id", type=int, default=1)
    e.add_argument("--max-papers", type=int, help="stop when so many pages with content are written")
    e.add_argument("--kind", choices=("figures", "tables", "all"), default="all")
    e.add_argument("--feeds", help="Parquet table of paper_id, xml, for the categories")
    e.add_argument("--scheme")
    e.add_argument("--out", required=True)
    for name in ("sample-figures", "sample-tables"):
        s = sub.add_parser(name)
        s.add_argument("--data", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--n", type=int, default=200)
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--base-url", default="")
    c = sub.add_parser("candidates", help="the order in which figures are tried")
    c.add_argument("--data", required=True)
    c.add_argument("--images")
    c.add_argument("--out", required=True)
    c.add_argument("--target", type=int, default=200)
    c.add_argument("--pool-multiplier", type=int, default=4)
    c.add_argument("--seed", type=int, default=sample.SEEDS["candidates"])
    g = sub.add_parser("generate", help="search queries by an author and a reviewer model, resumed where they stopped")
    g.add_argument("--data", required=True)
    g.add_argument("--images")
    g.add_argument("--out", required=True)
    g.add_argument("--model", required=True, help="module:factory of an object with chat(messages, temperature, image)")
    g.add_argument("--model-name", help="passed to the factory")
    g.add_argument("--load-in-4bit", action="store_true", help="passed to the factory")
    g.add_argument("--target", type=int, default=200)
    g.add_argument("--max-rounds", type=int, default=agents.ROUNDS)
    g.add_argument("--pool-multiplier", type=int, default=4)
    g.add_argument("--seed", type=int, default=sample.SEEDS["candidates"])
    for name, text in (("evaluate", "recall and reciprocal rank"), ("search", "figures for each query, or for each line of the input")):
        v = sub.add_parser(name, help=text)
        v.add_argument("--kind", choices=("single", "multi"), default="single")
        v.add_argument("--vectors", required=True, help="vector cache, or index of multi-vectors")
        v.add_argument("--encoder", help="module:factory of a function from texts to vectors; by default the hashing stand-in")
        v.add_argument("--top-k", type=int, default=10 if name == "evaluate" else 3)
        if name == "evaluate":
            v.add_argument("--queries-tsv", required=True)
        else:
            v.add_argument("--query", action="append", help="may be given again; without it queries are read line by line")
    b = sub.add_parser("backfill", help="fill blank categories")
    b.add_argument("--metadata", required=True)
    b.add_argument("--feeds", required=True, help="Parquet table of paper_id, xml")
    b.add_argument("--scheme")
    b.add_argument("--out", required=True)
    return p


def named(path: str):
    """The object that ``module:name`` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def searched(spark: SparkSession, a: argparse.Namespace):
    """(vectors or index, encoder) for a search or an evaluation."""
    if a.kind == "multi":
        index = retrieve.MultiVectorIndex(spark.read.parquet(a.vectors))
        dim = index.items.select(F.size(F.col("patches")[0])).first()[0]
        return index, encoders.multi(named(a.encoder) if a.encoder else partial(encoders.hashed_words, dim), dim)
    vectors = files.read_vectors(spark, a.vectors)
    dim = vectors.select(F.size("embedding")).first()[0]
    return vectors, encoders.single(named(a.encoder) if a.encoder else partial(encoders.hashed_text, dim))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(format="%(asctime)s %(message)s")
    LOG.setLevel(logging.INFO)
    if a.log_dir:
        os.makedirs(a.log_dir, exist_ok=True)
        LOG.addHandler(logging.FileHandler(f"{a.log_dir}/{a.job}-{datetime.now():%Y%m%d-%H%M%S}.log"))
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    if a.job == "extract":
        categories = extract.categories_of(spark.read.parquet(a.feeds), a.scheme) if a.feeds else None
        if a.pages:
            files.require(spark, a.pages)
            done = spark.read.parquet(f"{a.out}/done") if files.exists(spark, f"{a.out}/done") else None
            n = jobs.extract_pages(spark.read.parquet(a.pages), a.out, done, categories, a.max_papers, kind=a.kind).count()
        else:
            n = jobs.extract_months(spark, a.base_url, a.years, a.months, a.out, a.start_id, limit=a.max_papers, categories=categories, kind=a.kind)
        LOG.info("%d pages written to %s", n, a.out)
    elif a.job == "sample-figures":
        captions, references, metadata = jobs.read_inputs(spark, a.data)
        sinks.overwrite_tsv(jobs.sample_figures(captions, references, metadata, a.n, a.seed), a.out, single_file=True)
    elif a.job == "sample-tables":
        files.require(spark, f"{a.data}/tables", f"{a.data}/metadata")
        metadata = spark.read.parquet(f"{a.data}/metadata").drop("year", "month")
        sinks.overwrite_tsv(jobs.sample_tables(files.read_tables(spark, f"{a.data}/tables"), metadata, a.base_url, a.n, a.seed), a.out, single_file=True)
    elif a.job == "candidates":
        captions, references, metadata = jobs.read_inputs(spark, a.data)
        images = files.list_images(spark, a.images) if a.images else None
        jobs.candidates(captions, references, metadata, images, a.target, a.pool_multiplier, a.seed).write.mode("overwrite").parquet(a.out)
    elif a.job == "generate":
        captions, references, metadata = jobs.read_inputs(spark, a.data)
        images = files.list_images(spark, a.images) if a.images else None
        ordered = jobs.candidates(captions, references, metadata, images, a.target, a.pool_multiplier, a.seed)
        options = ({"model_name": a.model_name} if a.model_name else {}) | ({"load_in_4bit": True} if a.load_in_4bit else {})
        n = jobs.generate_queries(ordered, partial(named(a.model), **options), a.out, a.target, a.max_rounds)
        LOG.info("%d queries in %s", n, a.out)
    elif a.job == "evaluate":
        files.require(spark, a.queries_tsv, a.vectors)
        queries = curate.evaluation_rows(files.read_tsv(spark, a.queries_tsv, schemas.EVALUATION))
        vectors, encoder = searched(spark, a)
        if a.kind == "multi":
            jobs.evaluate_multi(queries, vectors, encoder, a.top_k).show(truncate=False)
        else:
            jobs.evaluate_single(queries, vectors, encoder, (1, 5, a.top_k)).show(truncate=False)
    elif a.job == "search":
        files.require(spark, a.vectors)
        vectors, encoder = searched(spark, a)
        for texts in [a.query] if a.query else ([line] for line in map(str.strip, sys.stdin) if line):
            asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
            found = jobs.search(asked, vectors, encoder, a.top_k, a.kind)
            for r in found.orderBy("query_id", "rank").collect():
                print(f"{texts[r.query_id]}\t{r.rank}\t{r.image_id}\t{f"{100 * r.score:.1f}%" if a.kind == "single" else f"{r.score:.3f}"}")
    elif a.job == "backfill":
        jobs.backfill(spark, a.metadata, spark.read.parquet(a.feeds), a.out, a.scheme)
