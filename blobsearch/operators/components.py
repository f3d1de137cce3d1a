"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsearch.sources.shared import new_path


def _drop(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """node, component (the smallest node that links reach) of every node of links (a, b).

    Links are turned into stars: in turn every node hands its greater neighbours,
    and then its smaller ones and itself, to its smallest neighbour. No list of
    neighbours is gathered, and rounds grow with the logarithm of a component's
    width. Each round is a table in the shared folder, so a lost executor costs a
    task and not the rounds before it.
    """
    spark = links.sparkSession
    both = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, seen = None, None
    for _ in range(most):
        if path is None:
            start = both
        else:
            every = edges.union(edges.select("v", "u"))
            least = every.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            # greater neighbours go to the smallest one
            large = every.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # every row is (greater, smaller): smaller neighbours and the node itself go to the smallest
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            start = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = new_path(spark, "links")
        start.write.parquet(new)
        if path:
            _drop(spark, path)
        path = new
        edges = spark.read.schema(start.schema).parquet(path)
        # the same set of links again: all are stars
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
