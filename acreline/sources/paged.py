"""A paged record service as a Spark data source: one input partition a page.

The service is a function url -> (records, total) given by import path, so the source has
no client of its own; retries with waits are in the reader and a failed page fails its
task, which Spark runs again.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WAITS = (0.05, 0.1, 0.2)


class Page(InputPartition):
    def __init__(self, offset: int) -> None:
        super().__init__(offset)
        self.offset = offset


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        module, _, name = options["fetch"].rpartition(".")
        self.module, self.name = module, name
        self.limit = int(options.get("limit", 500))
        self.most = int(options.get("cap", 5000))

    def _fetch(self, offset: int) -> tuple[list, int]:
        call = getattr(importlib.import_module(self.module), self.name)
        for wait in (*WAITS, None):
            try:
                return call(offset, self.limit)
            except OSError:
                if wait is None:
                    raise
                time.sleep(wait)
        raise AssertionError

    def partitions(self) -> list[InputPartition]:
        total = min(self._fetch(0)[1], self.most)
        return [Page(o) for o in range(0, total, self.limit)] or [Page(0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows, total = self._fetch(partition.offset)
        yield from rows[: max(0, min(total, self.most) - partition.offset)]


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").option("fetch", "module.function")."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options.get("schema", "id long, address string, price double")

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))
