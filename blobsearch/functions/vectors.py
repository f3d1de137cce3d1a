"""Vector arithmetic on array columns, in double precision and inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """v / |v|; a zero vector stays as it is."""
    # one-element arrays bind the vector, then its norm: else both are computed again for every component
    bound = F.transform(F.array(doubles(v)), lambda e: F.struct(e.alias("v"), norm(e).alias("n")))
    unit = F.transform(bound, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))
    return F.element_at(unit, 1)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def reshape_dim(v: Column | str, dim: int) -> Column:
    """The first ``dim`` components, padded with zeros, normalised again."""
    v = doubles(v)
    return l2_normalize(F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim))


def blend(a: Column | str, b: Column | str, w: float = 0.2) -> Column:
    """(1 - w) a + w b, normalised."""
    return l2_normalize(F.zip_with(doubles(a), doubles(b), lambda x, y: x * (1 - w) + y * w))


def rounded_number(x: Column | str, digits: int = 6) -> Column:
    """x rounded. What rounds to zero keeps its sign, as in IEEE arithmetic; Spark's own round takes it."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(x) < 0.5 / 10**digits, x * 0.0).otherwise(F.round(x, digits))


def rounded(v: Column | str, digits: int = 6) -> Column:
    return F.transform(doubles(v), lambda x: rounded_number(x, digits))


def centroid(df: DataFrame, key: str | list[str], vector: str, out: str = "centroid") -> DataFrame:
    """The normalised mean vector of each key. Components are averaged map-side first."""
    keys = [key] if isinstance(key, str) else key
    each = df.select(*keys, F.posexplode(doubles(vector)).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    rows = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(out))
    return rows.withColumn(out, l2_normalize(out))
