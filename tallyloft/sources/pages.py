"""A data source of paged listings with offsets: a batch and a streaming reader over any fetch function.

``fetch(page)`` returns (rows, more); it runs on executors. A partition is a run of pages, a stream's
offset is the next page, so a restart goes on where the last batch was committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Fetch = Callable[[int], tuple[list[tuple], bool]]


class Pages(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


def paged_source(short_name: str, columns: str, fetch: Fetch, budget: int = 10, step: int = 2) -> type[DataSource]:
    """A DataSource class of at most ``budget`` pages, ``step`` to a partition; the stream reads a page a batch."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [Pages(i, min(budget, i + step)) for i in range(0, budget, step)]

        def read(self, partition):
            for page in range(partition.first, partition.end):
                rows, more = fetch(page)
                yield from rows
                if not more:
                    return

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self):
            return {"page": 0}

        def read(self, start):
            if start["page"] >= budget:
                return iter([]), start
            rows, _ = fetch(start["page"])
            return iter(rows), {"page": start["page"] + 1}

        def readBetweenOffsets(self, start, end):
            return iter([r for page in range(start["page"], end["page"]) for r in fetch(page)[0]])

        def commit(self, end):
            pass

    class Source(DataSource):
        @classmethod
        def name(cls):
            return short_name

        def schema(self):
            return columns

        def reader(self, schema):
            return Reader()

        def simpleStreamReader(self, schema):
            return Stream()

    return Source
