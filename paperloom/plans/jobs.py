"""Jobs over tables of files; each reads explicit schemas and writes directories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agents, curate, extract, retrieve, sample
from ..sources import files, pages, sinks
from ..sources.scratch import kept


def extract_pages(found: DataFrame, out: str, done: DataFrame | None = None, categories: DataFrame | None = None, limit: int | None = None, rule: str | None = "reference", kind: str = "all") -> DataFrame:
    """Parse pages once and write the datasets of ``kind`` (figures, tables or all) below ``out``; returns the ids of the pages written.

    Finished ids are left out before parsing. The nested records are written first and read
    back, so the five projections parse nothing twice and survive lost executors. Pages
    without content are skipped and do not count towards ``limit``.
    """
    spark = found.sparkSession
    todo = found if done is None else curate.remaining(found.withColumn("paper_id", F.col("page_id").cast("string")), done, "paper_id").drop("paper_id")
    records = extract.page_records(todo, rule).filter((F.col("title") != "") | (F.col("abstract") != "") | (F.size("figures") > 0) | (F.size("tables") > 0))
    if limit is not None:
        records = records.orderBy("paper_id").limit(limit)
    batch = f"{out}/records/batch={spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"
    records.write.parquet(batch)
    records = spark.read.schema(extract.RECORD_DDL).parquet(batch)
    sinks.by_month(extract.metadata(records, categories), f"{out}/metadata")
    if kind != "figures":
        sinks.append_jsonl(extract.tables(records), f"{out}/tables")
    if kind != "tables":
        sinks.by_month(extract.captions(records), f"{out}/captions")
    own = F.lit(True) if kind == "all" else F.col("item_type") == kind.rstrip("s")
    sinks.by_month(extract.item_captions(records).filter(own), f"{out}/item_captions")
    sinks.by_month(extract.item_references(records).filter(own), f"{out}/references")
    ids = records.select("paper_id")
    ids.write.mode("append").parquet(f"{out}/done")
    return ids


def extract_months(spark: SparkSession, base_url: str, years: list[str], months: list[str], out: str, start: int = 1, end: int = 100_000, limit: int | None = None, step: int = 256, **options) -> int:
    """Fetch and extract month by month in order of id, ``step`` pages at a time; returns the pages written.

    Stops as soon as ``limit`` pages with content are written, so no more than one step is
    fetched beyond it. Without a limit a month is one step.
    """
    written = 0
    for year in years:
        for month in months:
            for at in range(start, end, step if limit is not None else end):
                if limit is not None and written >= limit:
                    return written
                done = spark.read.parquet(f"{out}/done") if files.exists(spark, f"{out}/done") else None
                ids = files.month_ids(spark, [year], [month], at, min(end, at + step) if limit is not None else end)
                ids = curate.remaining(ids, done, "paper_id") if done is not None else ids
                if not ids.isEmpty():
                    written += extract_pages(pages.fetched(ids, base_url), out, done, limit=None if limit is None else limit - written, **options).count()
    return written


def sample_figures(captions: DataFrame, references: DataFrame, metadata: DataFrame, n: int = 200, seed: int = sample.SEEDS["figures"]) -> DataFrame:
    """The figure sample under its display names; rows need url, title and abstract."""
    meta = metadata.filter("url is not null and title is not null and abstract is not null")
    frame = curate.figure_frame(captions, meta, references, separator=" | ", distinct=True).filter("url <> ''")
    return curate.figure_sample_frame(sample.one_per_category(frame, ["paper_id", "figure_id"], n, seed))


def sample_tables(tables: DataFrame, metadata: DataFrame, base_url: str, n: int = 200, seed: int = sample.SEEDS["tables"]) -> DataFrame:
    """The table sample with categories and URLs."""
    frame = curate.table_frame(tables, metadata)
    return curate.table_sample_frame(frame, sample.stratified(frame, "table_id", n, seed), base_url)


def candidates(captions: DataFrame, references: DataFrame, metadata: DataFrame, images: DataFrame | None = None, target: int = 200, multiplier: int = 4, seed: int = sample.SEEDS["candidates"]) -> DataFrame:
    """Figures in the order in which queries are tried."""
    frame = curate.figure_frame(captions, metadata, references)
    frame = frame if images is None else curate.resolved_images(frame, images)
    return sample.diverse_order(frame, target, multiplier, seed)


def generate_queries(ordered: DataFrame, factory: Callable[[], agents.ChatModel], out: str, target: int = 200, most: int = agents.ROUNDS) -> int:
    """Write accepted queries of the first candidates to ``out``; the order is computed once, before the batches."""
    return agents.generate(kept(ordered, "candidates"), factory, target, out, most=most)


def _numbered(queries: DataFrame) -> DataFrame:
    """Queries with an id that follows from their content and their place among equals, the same each time it is computed."""
    key = ["paper_id", "fig_id", "query"]
    return queries.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*key))).withColumn("query_id", F.xxhash64(*key, "__n")).drop("__n")


def evaluate_single(queries: DataFrame, vectors: DataFrame, encoder, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall and reciprocal rank of (paper_id, fig_id, query) against (paper_id, fig_id, embedding)."""
    items = vectors.withColumn("id", F.xxhash64("paper_id", "fig_id"))
    rows = retrieve.matched_targets(_numbered(queries), items)
    asked = rows.withColumn("embedding", encoder(F.col("query"))).select("query_id", "target_id", "embedding")
    ranks = retrieve.target_ranks(asked.select(F.col("query_id").alias("id"), "embedding"), items.select("id", "embedding"), asked.filter("target_id is not null").select("query_id", "target_id"))
    out = retrieve.metrics(asked.select("query_id").join(ranks, "query_id", "left"), ks)
    return out


def evaluate_multi(queries: DataFrame, index: retrieve.MultiVectorIndex, encoder, top: int = 3, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """The same for multi-vectors: (paper_id, fig_id, query) against image ids ``paper_fig``."""
    exact, plain = (F.concat_ws("_", "paper_id", f) for f in (F.col("fig_id"), T.without_letter(F.col("fig_id"))))
    rows = _numbered(queries).withColumn("a", exact).withColumn("b", plain)
    known = index.items.select(F.col("image_id").alias("__id")).distinct()
    wanted = rows.join(known.withColumnRenamed("__id", "__a"), F.col("a") == F.col("__a"), "left").join(known.withColumnRenamed("__id", "__b"), F.col("b") == F.col("__b"), "left")
    targets = wanted.select("query_id", F.coalesce("__a", "__b").alias("image_id")).filter("image_id is not null")
    ranks = retrieve.max_sim_ranks(rows.select("query_id", encoder(F.col("query")).alias("tokens")), index.items, targets)
    return retrieve.metrics(rows.select("query_id").join(ranks, "query_id", "left"), tuple(sorted({*ks, top})))


def search(queries: DataFrame, vectors: DataFrame | retrieve.MultiVectorIndex, encoder, k: int = 3, kind: str = "single") -> DataFrame:
    """(query_id, image_id, score, rank, ...) of the k best figures for (query_id, query)."""
    if kind == "multi":
        return vectors.search(queries.select("query_id", encoder(F.col("query")).alias("tokens")), k)
    items = vectors.withColumn("id", F.xxhash64("paper_id", "fig_id"))
    best = retrieve.top_k(queries.select(F.col("query_id").alias("id"), encoder(F.col("query")).alias("embedding")), items.select("id", "embedding"), k)
    names = items.select(F.col("id").alias("item_id"), F.concat_ws("_", "paper_id", "fig_id").alias("image_id"), "paper_id", "fig_id")
    return best.join(names, "item_id").drop("item_id")


def backfill(spark: SparkSession, metadata_path: str, feeds: DataFrame, out: str, scheme: str | None = None) -> None:
    """Fill blank categories from feeds and write to a new path."""
    meta = spark.read.parquet(metadata_path)
    found = extract.categories_of(feeds, scheme).select("paper_id", T.joined_categories(F.col("categories")).alias("categories"))
    curate.backfilled(meta, found).write.mode("overwrite").parquet(out)


def read_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(captions, references, metadata) of an extraction's output."""
    files.require(spark, f"{root}/captions", f"{root}/references", f"{root}/metadata")
    references = spark.read.parquet(f"{root}/references").filter("item_type = 'figure'").select("paper_id", F.col("item_id").alias("figure_id"), "ord", "reference_text")
    return spark.read.parquet(f"{root}/captions").drop("year", "month"), references, spark.read.parquet(f"{root}/metadata").drop("year", "month")
