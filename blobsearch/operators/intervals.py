"""Joins of intervals by overlap, in time bins that fit their lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsearch.functions.ranges import interval_iou

#: Width of the finest bins; those of each next level are twice as wide.
WIDTH = 4.0


def _level(start: Column, end: Column, width: float) -> Column:
    """The finest level of which a bin is as long as the interval, which then lies in two bins at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2((end - start) / width))).cast("int")


def _bins(df: DataFrame, start: str, end: str, level: Column, width: float) -> DataFrame:
    """Adds _first, and a row for each bin (_bin) of a level."""
    size = F.lit(width) * F.pow(F.lit(2.0), level)
    first, last = F.floor(F.col(start) / size), F.floor(F.col(end) / size)
    # an interval that ends at a bin's border does not reach into the bin
    last = F.greatest(first, F.when(F.col(end) == last * size, last - 1).otherwise(last))
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, on: tuple[str, str] = ("s", "e"), other: tuple[str, str] = ("g0", "g1"), width: float = WIDTH) -> DataFrame:
    """Every pair of rows of one key whose intervals share more than a point, once, with all columns of both sides.

    Both sides may hold many intervals of a key. An interval's level is that of the
    finest bins that are as long as itself. A pair meets at the greater level of
    the two, in the bins that both touch, and is kept in the first of them: so a
    bin holds, of one side, only intervals about as long as the bin, nearly every
    row that meets there is a result, and a key of very many intervals is spread
    over its bins. Intervals that are null, not finite or without length match
    nothing. Other columns of the two sides need different names.
    """

    def known(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        a, b = (F.col(c).cast("double") for c in ends)
        fine = F.coalesce((b > a) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")), F.lit(False))
        return df.where(fine).withColumn("_level", _level(a, b, width))

    left, right = known(left, on), known(right, other)
    # the levels of both sides: a few numbers
    levels = sorted(r[0] for r in left.select("_level").union(right.select("_level")).distinct().collect())
    if not levels:
        return left.join(right.drop("_level"), key).drop("_level").limit(0)
    above = lambda strict: F.explode(F.filter(F.array(*map(F.lit, levels)), lambda n: n > F.col("_level") if strict else n >= F.col("_level")))

    def own(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        return _bins(df.withColumnRenamed("_level", "_at"), *ends, F.col("_at"), width)

    def every(df: DataFrame, ends: tuple[str, str], strict: bool) -> DataFrame:
        return _bins(df.withColumn("_at", above(strict)).drop("_level"), *ends, F.col("_at"), width)

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.join(b.withColumnRenamed("_first", "_other"), [key, "_at", "_bin"])
        touch = (F.col(on[0]) < F.col(other[1])) & (F.col(other[0]) < F.col(on[1]))
        return pairs.where(touch & (F.col("_bin") == F.greatest("_first", "_other"))).drop("_at", "_bin", "_first", "_other")

    # the left interval is as long or of a longer level; then the right one is of a longer level
    return met(own(left, on), every(right, other, False)).unionByName(met(every(left, on, True), own(right, other)))


def iou_join(segments: DataFrame, truths: DataFrame, key: str = "blob_id") -> DataFrame:
    """Overlapping pairs of segments (s, e) and truths (g0, g1) of one key with their iou."""
    both = overlap_join(segments, truths, key)
    return both.withColumn("iou", interval_iou(F.col("s"), F.col("e"), F.col("g0"), F.col("g1")))
