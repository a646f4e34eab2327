"""Arriving pages as a stream of micro-batches, each written as the batch job writes it.

The checkpoint remembers which files were read, in place of a set of finished ids; a batch
that is run again overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators import agents, extract


def stream_pages(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_batch: int = 64) -> None:
    """Read all new Parquet files of ``source`` (page_id, url, html) and write nested records and captions; then stop."""

    def batch(df: DataFrame, number: int) -> None:
        path = f"{out}/records/batch={number}"
        extract.page_records(df).write.mode("overwrite").parquet(path)
        records = spark.read.schema(extract.RECORD_DDL).parquet(path)
        extract.item_captions(records).write.mode("overwrite").parquet(f"{out}/captions/batch={number}")

    pages = spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_queries(candidates: DataFrame, factory: Callable[[], agents.ChatModel], out: str, checkpoint: str) -> None:
    """Run the author and reviewer over streamed candidates; accepted queries are kept by batch."""

    def batch(df: DataFrame, number: int) -> None:
        agents.queries_for(df, factory).filter("query is not null").write.mode("overwrite").parquet(f"{out}/batch={number}")

    candidates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
