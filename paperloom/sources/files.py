"""File sources with explicit schemas. An empty field reads as the empty string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

IMAGES = ("png", "jpg", "jpeg", "gif")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, *paths: str) -> None:
    """Fail at once when an input is missing."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def read_tsv(spark: SparkSession, path: str | list[str], schema: str, na: tuple[str, ...] = ()) -> DataFrame:
    """All-text table with a header; the words in ``na`` become empty, by default none do."""
    df = spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"', multiLine=True, enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, charToEscapeQuoteEscaping="\uffff").csv(path)
    df = df.fillna("")
    return df.replace(list(na), "") if na else df


def read_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Table records, one JSON object a line."""
    return spark.read.schema(schemas.TABLES).json(path)


def read_corpus(spark: SparkSession, *roots: str) -> DataFrame:
    """Figures of per-paper JSON files with title and citing paragraphs; unreadable files are skipped.

    A root holds ``figures/<paper>.json`` and, where known, ``metadata/<paper>.json``.
    """
    stem = T.path_stem(F.col("_metadata.file_path"))
    found = spark.read.schema(schemas.CORPUS).options(multiLine=True, mode="PERMISSIVE").json([f"{r}/figures/*.json" for r in roots])
    rows = found.filter("figures is not null").select(stem.alias("paper_id"), F.explode("figures").alias("f"), "figure_references")
    rows = rows.select("paper_id", "f.*", F.coalesce(F.try_element_at("figure_references", F.concat(F.lit("Figure "), F.col("f.figure_id").cast("string"))), F.array().cast("array<string>")).alias("context_paras"))
    rows = rows.filter("local_path <> ''")
    titled = [f"{r}/metadata" for r in roots if exists(spark, f"{r}/metadata")]
    if not titled:
        return rows.withColumn("title", F.lit(""))
    titles = spark.read.schema("title string").options(multiLine=True).json([f"{r}/*.json" for r in titled]).select(stem.alias("paper_id"), "title")
    return rows.join(titles, "paper_id", "left").fillna("", ["title"])


def list_images(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, paper_id, fig_id[, content]) of images below a folder, any case of extension."""
    both = ",".join([*IMAGES, *[e.upper() for e in IMAGES]])
    df = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=f"*.{{{both}}}").load(root)
    return df.select("path", T.path_paper(F.col("path")).alias("paper_id"), T.path_stem(F.col("path")).alias("fig_id"), *["content"] * content)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A vector cache: ids and vectors of one row belong together by construction."""
    return spark.read.schema(schemas.VECTORS).parquet(path)


def read_test_queries(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Queries with the stems of their source figures."""
    df = spark.read.schema(schemas.TEST_QUERIES).option("multiLine", True).json(path)
    df = df.select("query", F.transform("source_figure_uids", T.uid_stem).alias("stems"))
    return df.limit(n) if n is not None else df


def month_ids(spark: SparkSession, years: list[str], months: list[str], start: int = 1, end: int = 100_000) -> DataFrame:
    """(paper_id, year, month) of every number of every month, in order of id."""
    small = spark.createDataFrame([(y, m) for y in years for m in months], "year string, month string")
    numbers = spark.range(start, end).withColumnRenamed("id", "number")
    return numbers.crossJoin(F.broadcast(small)).select(T.paper_id(F.col("year"), F.col("month"), F.col("number")).alias("paper_id"), "year", "month")
