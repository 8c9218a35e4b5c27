"""A paginated service as a Spark data source: page ranges are partitions, read where executors are."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .service import PAGE, ServiceError

#: (offset, limit) -> fields, offset, and totalFields or remainingCount. Runs in workers, so it must be picklable.
Fetch = Callable[[int, int], dict[str, Any]]
RANGE = 64


class Rows(InputPartition):
    def __init__(self, start: int, stop: int | None):
        self.start, self.stop = start, stop


def _page(fetch: Fetch, at: int, limit: int) -> tuple[list[dict[str, Any]], int, int | None]:
    """A page's fields, the place behind them, and how many there are of all if it says so."""
    page = fetch(at, limit)
    fields = page.get("fields")
    if not isinstance(fields, list):
        raise ServiceError("a page without fields")
    then = int(page.get("offset", at)) + len(fields)
    total = then + int(page["remainingCount"]) if "remainingCount" in page else int(page["totalFields"]) if "totalFields" in page else None
    return fields, then, total


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, names: list[str], page: int, pages: int):
        self.fetch, self.names, self.page, self.size = fetch, names, page, page * pages

    def partitions(self) -> list[InputPartition]:
        total = _page(self.fetch, 0, self.page)[2]
        if total is None:  # without a total there is one range, up to a page that is short
            return [Rows(0, None)]
        return [Rows(a, min(total, a + self.size)) for a in range(0, total, self.size)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        at = partition.start
        while partition.stop is None or at < partition.stop:
            limit = self.page if partition.stop is None else min(self.page, partition.stop - at)
            fields, then, _ = _page(self.fetch, at, limit)
            if partition.stop is not None and then <= at:
                raise ServiceError("pages make no progress while fields remain")
            for row in fields if partition.stop is None else fields[: partition.stop - at]:
                yield tuple(row.get(n) for n in self.names)
            if partition.stop is None and len(fields) < limit:
                return
            at = then


def paged(name: str, fetch: Fetch, schema: str, *, page: int = PAGE, pages: int = RANGE) -> type[DataSource]:
    """A data source to be registered (spark.dataSource.register): spark.read.format(name).load() gives all fields, typed by the schema.

    A partition reads `pages` pages. A service may give fewer fields than asked for; one that gives none while some remain fails the read.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, schema.names, page, pages)

    return Paged
