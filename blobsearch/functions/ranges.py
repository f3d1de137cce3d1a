"""Sliding windows over text and time, and overlap of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_windows(df: DataFrame, text: str, size: int = 4000, overlap: int = 400, most: int | None = 64) -> DataFrame:
    """One row for each window: n, piece. The last window is the one that reaches the end; texts without characters have none."""
    step = max(1, size - min(overlap, size - 1))
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    if most:
        last = F.least(last, F.lit(most - 1))
    rows = df.where(F.length(text) > 0).withColumn("n", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("piece", F.substr(F.col(text), F.col("n") * step + 1, F.lit(size)))


def slide_windows(duration: Column | str, width: float = 4.0, stride: float = 2.0) -> Column:
    """array<struct<start, end>> over [0, duration]; a short clip is one window, an empty one has none."""
    d = F.col(duration) if isinstance(duration, str) else duration
    n = F.ceil((d - width) / stride).cast("int")
    window = lambda i: F.struct((i * stride).alias("start"), F.least(d, i * stride + width).alias("end"))
    none = F.array().cast("array<struct<start:double,end:double>>")
    return F.when(d <= 0, none).when(d <= width, F.array(F.struct(F.lit(0.0).alias("start"), d.alias("end")))).otherwise(F.transform(F.sequence(F.lit(0), n), window))


def multiscale_windows(duration: Column | str, widths: tuple[float, ...] = (4.0, 8.0, 16.0)) -> Column:
    """The different windows of all widths, each sliding by half, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[slide_windows(duration, w, w / 2) for w in widths]))))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def recency_boost(at: Column, as_of: Column, weight: float = 0.05, hours: float = 24.0) -> Column:
    """weight at no age, falling to 0 at ``hours``; times after as_of count as no age."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 3600.0)
    return F.when(age < hours, weight * (1 - age / hours)).otherwise(0.0)
