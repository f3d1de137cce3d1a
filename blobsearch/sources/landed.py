"""Rows landed in the shared folder in ranges of a number, and how a task of a Python data source reads one range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def land(df: DataFrame, path: str, by: str, span: int) -> None:
    """Appends the rows to a folder for each ``span`` values of a column; ``path`` is one that all executors reach."""
    df.withColumn("_range", F.floor(F.col(by) / span)).repartition("_range").write.mode("append").partitionBy("_range").parquet(path)


def range_reader(path: str, by: str, span: int) -> tuple[Callable[[int, int], list[dict]], Callable[[], int]]:
    """rows(first, last): the landed rows with first <= by <= last, in order; tip(): the greatest value landed, -1 before the first.

    Both run in Python workers, which open the folder's file system by its address.
    """

    def listed(under: str) -> list:
        """Landed files of the folder, or of one below it. A file of a write that is not committed yet lies below _temporary."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        found = files.get_file_info(fs.FileSelector(f"{root}{under}", recursive=True, allow_not_found=True))
        return [f.path for f in found if f.is_file and f.path.endswith(".parquet") and "/_temporary/" not in f.path]

    def read(names: list[str]) -> list[dict]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(path)
        return [r for n in names for r in pq.read_table(n, filesystem=files, partitioning=None).to_pylist()]

    def rows(first: int, last: int) -> list[dict]:
        # only the folders of the range are listed: listing all for each range would grow with its square
        names = [n for k in range(first // span, last // span + 1) for n in listed(f"/_range={k}")]
        return sorted((r for r in read(names) if first <= r[by] <= last), key=lambda r: r[by])

    def tip() -> int:
        there: dict[int, list[str]] = {}
        for n in listed(""):
            k = n.rsplit("_range=", 1)[1].split("/")[0]
            if k.lstrip("-").isdigit():  # else rows without a number
                there.setdefault(int(k), []).append(n)
        return max((r[by] for r in read(there[max(there)])), default=-1) if there else -1

    return rows, tip
