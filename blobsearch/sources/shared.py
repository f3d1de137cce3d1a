"""Versioned tables and exports in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local session, as in tests, gets a folder of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="blobsearch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends, and a lost executor costs a task."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A Parquet table that is replaced as a whole: each version is a folder, the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("version=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def read(self) -> DataFrame | None:
        v = self._versions()
        return self.spark.read.parquet(f"{self.path}/version={v[-1]}") if v else None

    def replace(self, df: DataFrame, backups: int = 8) -> int:
        """Writes the next version; so many earlier ones stay as backups."""
        done = self._versions() or [0]
        df.write.mode("overwrite").parquet(f"{self.path}/version={done[-1] + 1}")
        for old in done[:-backups]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={old}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return done[-1] + 1


class BucketTable:
    """A Parquet table in hash buckets of its key, each a partition folder; a merge writes the buckets that its batch touches and no other.

    The merged buckets are written aside first. Only a complete set replaces the
    table's folders, and a job that finds one left by a lost driver replaces them
    again before it does anything else.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _bucket int").parquet(path)

    def _finish(self) -> None:
        """Puts a complete set of merged buckets in place."""
        aside = f"{self.path}.merged"
        if self._exists(f"{aside}/_SUCCESS"):
            self._rows(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        p, fs = self._fs(aside)
        fs.delete(p, True)

    def read(self) -> DataFrame:
        self._finish()
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        return self._rows(self.path).drop("_bucket")

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """combine(old rows of the touched buckets, batch) gives their new rows. Returns the touched buckets, so many at most as the table has."""
        self._finish()
        # its rows are read twice, and a stateful stream would run twice for that
        aside = f"{self.path}.batch"
        batch.write.mode("overwrite").parquet(aside)
        batch = self.spark.read.schema(batch.schema).parquet(aside)
        touched = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())
        if not touched:
            return touched
        old = self._rows(self.path).where(F.col("_bucket").isin(touched)).drop("_bucket") if self._exists(self.path) else self.spark.createDataFrame([], self.schema)
        new = combine(old, batch).withColumn("_bucket", self._bucket())
        # the folder has buckets below it, so it is read by bucket again
        new.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}.merged")
        self._finish()
        return touched


def write_snapshot(table: VersionedTable, vectors: DataFrame, blacklist: DataFrame) -> int:
    """Vectors without the blacklisted ids as the next version."""
    return table.replace(vectors.join(blacklist.select("blob_id"), "blob_id", "left_anti"))


def write_exports(df: DataFrame, path: str, key: str = "blob_id") -> dict[str, str]:
    """The ids as text, and the rows as CSV and JSON lines."""
    flat = df.select([c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))])
    df.select(F.col(key).cast("string").alias("value")).write.text(f"{path}/ids")
    flat.write.option("header", True).csv(f"{path}/csv")
    df.write.json(f"{path}/jsonl")
    return {k: f"{path}/{k}" for k in ("ids", "csv", "jsonl")}
