"""Paginated records of a portal as a data source: executors fetch the pages.

    spark.dataSource.register(PagedRecords)
    spark.read.format("portal_records").option("url", "https://...").option("resource", "...").load()

A row is a record: page, at (its place there), record (its JSON).  The portal is asked once for the number of
records; each page is then a partition, and the last one reads on until an empty page, as records may have
come since.  Where the portal doesn't tell, ``readers`` partitions take every ``readers``-th page
until their first empty one.

Options: url, resource, path (of the search), page (records of a page), readers, timeout (seconds), retries and wait
(seconds before the first; twice as long each time).  A page without records gives no rows; a
request that fails in the end fails its task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from permitloom.sources.base import HttpClient

# Fixed values of the portal: rows of a page, and the path of its search.
PAGE, RECORDS = 32_000, "/api/3/action/datastore_search"
READERS = 32
SCHEMA = "page long, at long, record string"


class Pages(InputPartition):
    """Every ``step``-th page from ``first`` on; without a step that page alone."""

    def __init__(self, first: int, step: int = 0):
        super().__init__((first, step))
        self.first, self.step = first, step


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client = HttpClient.of(options)
        self.resource, self.path = options["resource"], options.get("path", RECORDS)
        self.page, self.readers = int(options.get("page", PAGE)), int(options.get("readers", READERS))

    def _ask(self, limit: int, offset: int) -> dict:
        return self.client.get_json(self.path, {"id": self.resource, "limit": limit, "offset": offset})["result"]

    def partitions(self) -> list[Pages]:
        total = self._ask(0, 0).get("total")
        if total is None:
            return [Pages(k, self.readers) for k in range(self.readers)]
        last = int(total) // self.page
        return [*(Pages(k) for k in range(last)), Pages(last, 1)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        k = partition.first
        while records := self._ask(self.page, k * self.page)["records"]:
            lines = [json.dumps(r) for r in records]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(lines), pa.int64()), pa.array(range(len(lines)), pa.int64()), pa.array(lines)], names=["page", "at", "record"])
            if not partition.step:
                return
            k += partition.step


class PagedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "portal_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))
