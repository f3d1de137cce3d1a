"""A paged listing as a Spark data source. A fetcher - a function of a page number to a list of JSON items - plugs in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def paged_source(fetch: Callable[[int], list[dict]], name: str = "paged_listing") -> type[DataSource]:
    """A data source class ``name`` for ``spark.dataSource.register``; options: pages, pages_per_task, page_size.

    Batch: partitions of page ranges; a range ends at its first page that is
    empty, shorter than the one before or, if that is given, than ``page_size``.
    Ranges are read at the same time: ``until_short_page`` takes out what stands
    behind the listing's first short page. Stream: the offset is the next page.
    """

    def rows(page: int) -> list[tuple[int, str]]:
        return [(page, json.dumps(x, sort_keys=True)) for x in fetch(page)]

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.pages, self.step, self.full = int(options.get("pages", 1)), int(options.get("pages_per_task", 10)), int(options.get("page_size", 1))

        def partitions(self):
            return [Pages(i, min(i + self.step, self.pages)) for i in range(0, self.pages, self.step)]

        def read(self, partition) -> Iterator[tuple]:
            size = self.full
            for page in range(partition.first, partition.last):
                got = rows(page)
                yield from got
                if len(got) < size:
                    return
                size = len(got)

    class StreamReader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.step = int(options.get("pages_per_task", 10))

        def initialOffset(self):
            return {"page": 0}

        def read(self, start):
            out, page = [], start["page"]
            while page < start["page"] + self.step and (got := rows(page)):
                out += got
                page += 1
            return iter(out), {"page": page}

        def readBetweenOffsets(self, start, end):
            return iter([r for page in range(start["page"], end["page"]) for r in rows(page)])

    class PagedListing(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "page long, item string"

        def reader(self, schema):
            return Reader(self.options)

        def simpleStreamReader(self, schema):
            return StreamReader(self.options)

    return PagedListing
