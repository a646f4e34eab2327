"""Joins and order-preserving aggregations that make the sampling and candidate frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``; null keys form a key of their own."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def joined_text(order: str, text: str, separator: str, distinct: bool = False) -> Column:
    """Aggregate: non-blank texts in order, joined; optionally without repeats."""
    rows = F.array_sort(F.collect_list(F.when(F.trim(T.blank(F.col(text))) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    texts = F.transform(rows, lambda r: r["t"])
    return F.array_join(F.array_distinct(texts) if distinct else texts, separator)


def grouped_references(references: DataFrame, separator: str = " || ", distinct: bool = False, order: str = "ord") -> DataFrame:
    """(paper_id, figure_id, reference_text): one line per figure."""
    return references.groupBy("paper_id", "figure_id").agg(joined_text(order, "reference_text", separator, distinct).alias("reference_text"))


def joined_array(texts: Column, separator: str = " | ") -> Column:
    """Non-empty entries of an array, joined."""
    return F.array_join(F.filter(texts, lambda t: t != ""), separator)


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the missing ones of ``names`` added as empty text."""
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns})


def snake_case(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def figure_frame(captions: DataFrame, metadata: DataFrame, references: DataFrame, separator: str = " || ", distinct: bool = False) -> DataFrame:
    """Captions with metadata (first row per paper) and their references; unmatched sides are empty."""
    meta = keep_first(metadata, ["paper_id"], ["url", "title"])
    rows = captions.join(meta, "paper_id", "left").join(grouped_references(references, separator, distinct), ["paper_id", "figure_id"], "left")
    return rows.fillna("", [c for c, t in rows.dtypes if t == "string"]).filter(F.trim(T.caption_or_sub(F.col("caption"), F.col("sub_caption"))) != "")


def table_frame(tables: DataFrame, metadata: DataFrame) -> DataFrame:
    """Tables with metadata; rows need title, abstract and caption."""
    meta = keep_first(metadata, ["paper_id"], ["url", "title"])
    rows = tables.withColumn("paper_id", T.paper_of_table(F.col("table_id"))).withColumn("reference_text", joined_array(F.col("references")))
    rows = rows.join(meta, "paper_id", "left").fillna("", ["title", "abstract", "categories", "url", "caption"])
    return rows.filter((F.col("title") != "") & (F.col("abstract") != "") & (F.col("caption") != ""))


def category_rows(df: DataFrame, key: str, categories: str = "categories") -> DataFrame:
    """(category, key), a row per category of each item; items without one get their own bucket."""
    return df.select(F.explode(F.array_distinct(T.category_list(F.col(categories)))).alias("category"), F.col(key)).distinct()


def category_sizes(rows: DataFrame) -> DataFrame:
    """(category, size) of a category index."""
    return rows.groupBy("category").agg(F.count("*").alias("size"))


def category_text(rows: DataFrame, key: str) -> DataFrame:
    """(key, category): sorted categories joined by commas, less the bucket of those without."""
    real = F.when(F.col("category") != T.UNCATEGORISED, F.col("category"))
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(real)), ", ").alias("category"))


def remaining(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids not yet done: the resume filter, before any expensive step."""
    return ids.join(done.select(key).distinct(), key, "left_anti")


def done_ids(*sources: DataFrame, key: str = "paper_id") -> DataFrame:
    """Distinct ids over all records of finished work."""
    out = sources[0].select(key)
    for s in sources[1:]:
        out = out.union(s.select(key))
    return out.distinct()


def resolved_images(figures: DataFrame, listing: DataFrame) -> DataFrame:
    """Figures with the path of their image: by paper and stem, png before jpg before jpeg."""
    rank = F.array_position(F.array(*map(F.lit, ("png", "jpg", "jpeg"))), F.lower(F.regexp_extract("path", r"[.]([^.]+)$", 1)))
    files = listing.select(T.path_paper(F.col("path")).alias("paper_id"), T.path_stem(F.col("path")).alias("stem"), F.col("path").alias("image_path"), rank.alias("rank")).filter("rank > 0")
    best = files.groupBy("paper_id", "stem").agg(F.min_by("image_path", F.struct("rank", "image_path")).alias("image_path"))
    return figures.withColumn("stem", F.concat("figure_id", T.blank(F.col("sub_id")))).join(best, ["paper_id", "stem"], "inner").drop("stem")


def backfilled(metadata: DataFrame, categories: DataFrame) -> DataFrame:
    """Metadata with blank categories filled from (paper_id, categories)."""
    new = categories.select("paper_id", F.col("categories").alias("__new"))
    own = F.nullif(F.trim(T.blank(F.col("categories"))), F.lit(""))
    return metadata.join(new, "paper_id", "left").withColumn("categories", F.coalesce(own, "__new", F.lit(""))).select(*metadata.columns)


def evaluation_rows(df: DataFrame) -> DataFrame:
    """(paper_id, fig_id, query): the three query columns as rows, blanks left out."""
    names = ["Query 1", "Query 2", "Query 3"]
    long = df.select(F.col("Paper ID").alias("paper_id"), F.col("Figure ID").alias("fig_id"), *[F.col(f"`{n}`") for n in names])
    return long.unpivot(["paper_id", "fig_id"], names, "slot", "query").filter(F.trim(T.blank(F.col("query"))) != "")


def figure_sample_frame(figures: DataFrame) -> DataFrame:
    """The sampled figures under their display names, with three empty query columns."""
    from ..schemas import FIGURE_SAMPLE

    url = T.anchored(F.col("url"), F.col("html_id"))
    values = ["paper_id", "figure_id", "sampling_category", "categories", "url", url, T.caption_or_sub(F.col("caption"), F.col("sub_caption")), "reference_text", "title", "abstract"]
    text = {6, 7, 8, 9}
    columns = [T.collapse(T.blank(F.col(v) if isinstance(v, str) else v)) if i in text else (F.col(v) if isinstance(v, str) else v) for i, v in enumerate(values)]
    return figures.select(*[c.alias(n) for c, n in zip([*columns, *[F.lit("")] * 3], FIGURE_SAMPLE)])


def table_sample_frame(frame: DataFrame, sample: DataFrame, base_url: str) -> DataFrame:
    """The sampled tables: one row each, all categories joined, URLs from paper and anchor."""
    from ..schemas import TABLE_SAMPLE

    cats = category_text(category_rows(frame, "table_id"), "table_id")
    rows = keep_first(frame.join(sample.select("table_id"), "table_id", "left_semi"), ["table_id"], ["html_id", "caption"]).join(cats, "table_id", "left")
    rows = rows.withColumn("category", T.blank(F.col("category"))).withColumn("paper_url", F.concat(F.lit(base_url), "paper_id"))
    rows = rows.withColumn("table_url", T.anchored(F.col("paper_url"), F.col("html_id")))
    return with_columns(rows, TABLE_SAMPLE).select(*[F.col(f"`{c}`") for c in TABLE_SAMPLE])
