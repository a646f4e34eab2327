"""Sinks. Appends go to directories of files, so a lost task never leaves half a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: White space at the ends of a value belongs to it; Spark would cut it off.
_TSV = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "charToEscapeQuoteEscaping": "\uffff"}


def append_tsv(df: DataFrame, path: str) -> None:
    """Add rows; every file has its header."""
    df.write.mode("append").options(**_TSV).csv(path)


def overwrite_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Replace; a single file only for exports of a known small size."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").options(**_TSV).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add records, one JSON object a line, null fields left out."""
    df.write.mode("append").json(path)


def by_month(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet below ``year=YY/month=MM`` of the paper id; filters on them prune folders.

    Rows are brought together by month by a rebalance: small months share a task, and one that
    holds much of the data is split over several.
    """
    part = T.year_month(F.col("paper_id"))
    df.withColumn("year", part["year"]).withColumn("month", part["month"]).hint("rebalance", "year", "month").write.mode(mode).partitionBy("year", "month").parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_images(figures: DataFrame, folder: str, timeout: float = 30.0) -> DataFrame:
    """Download each figure's ``source`` to ``folder/yy/mm/paper/<figure><sub>.png``; returns (path, error).

    A side effect per row, each file renamed when whole, so that a repeated task does no harm.
    """
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("error", pa.string())])

    def run(batches):
        import urllib.request
        import uuid

        from pyarrow import fs

        for b in batches:
            rows = []
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with urllib.request.urlopen(source, timeout=timeout) as r:
                        content = r.read()
                    system, place = fs.FileSystem.from_uri(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    temp = f"{place}.{uuid.uuid4().hex[:8]}"
                    with system.open_output_stream(temp) as out:
                        out.write(content)
                    system.move(temp, place)
                    rows.append({"path": path, "error": None})
                except Exception as x:
                    rows.append({"path": path, "error": str(x)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    ym = T.year_month(F.col("paper_id"))
    path = F.concat_ws("/", F.lit(folder), ym["year"], ym["month"], "paper_id", F.concat("figure_id", T.blank(F.col("sub_id")), F.lit(".png")))
    return figures.filter("source is not null").select(path.alias("path"), "source").mapInArrow(run, "path string, error string")
