"""Encoders: texts to vectors. A model plugs in as a function of a list of texts to a matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsearch.operators.search import tokens

from .ranges import text_windows
from .vectors import centroid, l2_normalize


def hashed_vectors(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """key, embedding: normalised counts of a text's words in ``dim`` places chosen by md5; the encoder of tests. Keys are unique.

    Words are counted map-side by place, so a text of any length adds ``dim`` rows at most.
    """
    words = df.select(key, F.explode_outer(tokens(text)).alias("t"))
    place = F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long"), F.lit(dim))
    counts = words.groupBy(key, place.alias("i")).agg(F.count("t").cast("double").alias("n"))
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return held.select(key, l2_normalize(dense).alias("embedding"))


def encode(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray], size: int = 4000, overlap: int = 400, most: int = 64) -> DataFrame:
    """key, embedding: the normalised mean of the vectors of each text's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(encoder(b["piece"].to_pylist()), float).reshape(len(b), -1)
            offsets = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
            yield pa.record_batch([b[key], pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], [key, "v"])

    pieces = text_windows(df.select(key, text), text, size, overlap, most).select(key, "piece")
    kind = df.schema[key].dataType.simpleString()
    return centroid(pieces.mapInArrow(run, f"{key} {kind}, v array<double>"), key, "v", "embedding")
