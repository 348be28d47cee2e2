"""A batch source of paged history: one partition a time window, each read page by page.

``spark.dataSource.register(HistorySource)``, then ``spark.read.format("paged_history")`` with the options ``start``, ``end`` and ``window``
(milliseconds), ``limit`` (rows of a page), ``schema`` (DDL) and ``pages``: "module:function" of (start, end, limit), which
returns the rows from start on, in order of their first value, ``limit`` at most.  A page that isn't full ends its window.
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.end = int(options["start"]), int(options["end"])
        self.window, self.limit = int(options.get("window", self.end - self.start)), int(options.get("limit", 1000))
        self.pages = options["pages"]

    def partitions(self) -> list[Span]:
        return [Span(a, min(a + self.window, self.end)) for a in range(self.start, self.end, self.window)]

    def read(self, part: Span):
        module, name = self.pages.split(":")
        fetch, at = getattr(importlib.import_module(module), name), part.start
        while at < part.end:
            rows = [r for r in fetch(at, part.end, self.limit) if r[0] < part.end]
            yield from rows
            if len(rows) < self.limit:
                break
            at = rows[-1][0] + 1


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


def even_prices(start: int, end: int, limit: int, step: int = 60_000) -> list[tuple[int, float]]:
    """Pages of an even grid, in place of a remote service: a price that follows from its time."""
    first = -(-start // step) * step
    return [(t, 100.0 + (t // step) % 7) for t in range(first, min(end, first + limit * step), step)]
