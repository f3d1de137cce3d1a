"""A log with a cursor as a streaming source: offsets are cursors, tasks read ranges of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Range(InputPartition):
    """Cursors first to last, both of them read."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def cursor_source(rows: Callable[[int, int], list[dict]], tip: Callable[[], int], schema: str, name: str = "cursor_log") -> type[DataSource]:
    """A data source class ``name`` for ``spark.dataSource.register``.

    rows(first, last): the log's entries with such cursors; tip(): its newest
    cursor. Options: ``start``, a cursor after which a stream without checkpoint
    begins, or ``tip`` (the default) for what comes after its start; ``until``, a
    cursor where a run ends; ``per_task``, cursors of a task. A stream with a
    checkpoint resumes after the cursor that it has committed, whatever ``start``
    says, so each entry is read once.
    """
    columns = [c.split()[0] for c in schema.split(",")]

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.start, self.step = options.get("start", "tip"), int(options.get("per_task", 1000))
            self.until = int(options["until"]) if "until" in options else None

        def initialOffset(self) -> dict:
            return {"cursor": tip() if self.start == "tip" else int(self.start)}

        def latestOffset(self) -> dict:
            newest = tip()
            return {"cursor": newest if self.until is None else min(newest, self.until)}

        def partitions(self, start: dict, end: dict):
            return [Range(i, min(i + self.step - 1, end["cursor"])) for i in range(start["cursor"] + 1, end["cursor"] + 1, self.step)]

        def read(self, partition) -> Iterator[tuple]:
            for r in rows(partition.first, partition.last):
                yield tuple(r[c] for c in columns)

        def commit(self, end: dict) -> None:
            pass

        def stop(self) -> None:
            pass

    class CursorLog(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def streamReader(self, schema):
            return Reader(self.options)

    return CursorLog
