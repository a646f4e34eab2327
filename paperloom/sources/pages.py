"""Pages over HTTP as a Python data source, with retries; offline work reads a table instead.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("urls", json.dumps(urls)).load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES, WAIT, TIMEOUT = 3, 5.0, 30.0


def fetch(url: str, retries: int = RETRIES, wait: float = WAIT, timeout: float = TIMEOUT, pause: float = 0.0) -> tuple[str | None, int | None]:
    """(body or None, status); a missing page is not asked for again."""
    status = None
    for attempt in range(retries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                time.sleep(pause)
                return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.status
        except urllib.error.HTTPError as x:
            status = x.code
            if status == 404:
                break
        except (OSError, ValueError):
            pass
        if attempt + 1 < retries:
            time.sleep(wait)
    return None, status


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options.get("urls", "[]"))
        self.size = int(options.get("batch", 16))
        self.retries, self.wait, self.timeout = int(options.get("retries", RETRIES)), float(options.get("wait", WAIT)), float(options.get("timeout", TIMEOUT))

    def partitions(self):
        return [_Urls(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [_Urls([])]

    def read(self, partition):
        for url in partition.urls:
            body, status = fetch(url, self.retries, self.wait, self.timeout)
            yield (url, body, status)


class PageSource(DataSource):
    """Format ``pages``: options urls (JSON list), batch, retries, wait, timeout."""

    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return "url string, html string, status int"

    def reader(self, schema):
        return _Reader(self.options)


def fetched(ids: DataFrame, base_url: str, retries: int = RETRIES, wait: float = WAIT, timeout: float = TIMEOUT, pause: float = 1.0) -> DataFrame:
    """(page_id, url, html) of ids in a table, fetched where the rows are; missing pages are left out."""
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("html", pa.string())])

    def run(batches):
        for b in batches:
            for page in b.column(0).to_pylist():
                body, _ = fetch(base_url + page, retries, wait, timeout, pause)
                if body is not None:
                    yield pa.RecordBatch.from_pylist([{"page_id": page, "url": base_url + page, "html": body}], schema)

    return ids.select(F.col("paper_id").alias("page_id")).mapInArrow(run, "page_id string, url string, html string")
