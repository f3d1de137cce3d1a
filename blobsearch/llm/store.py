"""Tables that a job writes and reads again, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobsearch.sources.shared import new_path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch of the pipeline's stages; Spark's own bound is 64 MB, for each task and on both sides.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table that ``new_path`` named, on whichever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The settled tables of one operator, to be dropped when those that its result reads are settled too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Drops all tables but those named."""
        for df, path in self.tables:
            if not any(df is k for k in keep):
                drop_path(self.spark, path)
        self.tables = [t for t in self.tables if any(t[0] is k for k in keep)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table that may be told to every task; larger ones are joined by shuffling.
TOLD = 200_000


def told(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A settled table with a broadcast hint if it has at most so many rows (TOLD); else as it is."""
    rows = TOLD if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a hash of doc_id and text in a column of a new name, and that name. Nulls hash like anything else."""
    name = "_row_key"
    while name in docs.columns:
        name = f"_{name}"
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))), name


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id and text only, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
