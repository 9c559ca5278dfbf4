"""A data source over open-data services that give JSON arrays by page.

Every page is a partition of its own and is asked for independently, again after a failure. A page that the
service has no rows for is empty, so pages beyond the end cost a request and nothing else. Rows come as JSON
text, for ``normalizers``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST, PAGE = 50_000, 5_000  #: rows that one read asks for, and that a page holds, at most


class _Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PagedJson(DataSource):
    """Format ``paged_json``. Options: path (the service's url), limit, page, where, order, attempts."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "offset long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["path"]
        self.limit = min(max(int(options.get("limit", 1000)), 1), MOST)
        self.page = min(max(int(options.get("page", 1000)), 1), PAGE)
        self.query = {f"${k}": options[k] for k in ("where", "order") if options.get(k)}
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[_Page]:
        return [_Page(at, min(self.page, self.limit - at)) for at in range(0, self.limit, self.page)]

    def read(self, page: _Page) -> Iterator[tuple]:
        asked = urllib.parse.urlencode({"$limit": page.limit, "$offset": page.offset, **self.query})
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(f"{self.url}?{asked}", timeout=30) as r:
                    rows = json.loads(r.read())
                break
            except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.2 * 2**attempt)
        for i, row in enumerate(rows if isinstance(rows, list) else []):
            yield page.offset + i, json.dumps(row, ensure_ascii=False)


def pages(spark: SparkSession, url: str, **options) -> DataFrame:
    """offset, raw of up to ``limit`` rows, in the service's order (give ``order``, or pages may overlap)."""
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(**{k: str(v) for k, v in options.items()}).load(url)
