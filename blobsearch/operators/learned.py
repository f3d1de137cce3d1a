"""Operators that fit something: approximate search, clustering, projection, adapters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsearch.functions import vectors as V
from blobsearch.sources.shared import settled

from .search import ranked, small

#: Clustering: seed, starts, rounds and rows of a round, about.
SEED, STARTS, ROUNDS, BATCH = 42, 3, 20, 8192
#: Distances are compared with so much room for rounding.
SLACK = 1e-6


def kmeans_centres(df: DataFrame, k: int, seed: int = SEED, starts: int = STARTS, rounds: int = ROUNDS, batch: int = BATCH) -> np.ndarray:
    """The k centres of rows (id, v array<double>) by mini-batches: of several starts the one with the least inertia over all rows.

    A start is the k rows of the smallest hashes. A round takes about ``batch``
    rows, chosen by hash, the same for all starts; tasks return a sum and a count
    for each centre, and each centre moves to the mean of all rows that it has been
    given so far. Only these sums reach the driver.
    """
    rows = df.select("id", "v")
    pick = lambda s: rows.orderBy(F.xxhash64("id", F.lit(s)), "id").limit(k).select("v").collect()
    centres = [np.array([r["v"] for r in pick(seed + s)], float) for s in range(starts)]
    given = [np.zeros(k) for _ in centres]
    share = max(1, -(-rows.count() // batch))

    def sums(part: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each start: sums and counts of the rows nearest to each centre, and their squared distances."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [(np.zeros_like(c), np.zeros(len(c)), 0.0) for c in centres]
            for b in batches:
                x = np.asarray(b["v"].flatten(), float).reshape(len(b), -1)
                for i, c in enumerate(centres):
                    label, far = nearest(x, c)
                    s, n, inertia = total[i]
                    np.add.at(s, label, x)
                    total[i] = s, n + np.bincount(label, minlength=len(c)), inertia + far.sum()
            for i, (s, n, inertia) in enumerate(total):
                yield pa.record_batch([pa.array([i] * len(n), pa.int32()), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(list(s)), pa.array(n), pa.array([inertia / len(n)] * len(n))], ["start", "centre", "s", "n", "inertia"])

        each = part.select("v").mapInArrow(add, "start int, centre int, s array<double>, n double, inertia double")
        # a sum for each start, centre and component
        flat = each.select("start", "centre", "n", "inertia", F.posexplode("s").alias("i", "x")).groupBy("start", "centre", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("inertia").alias("inertia"))
        out = [(np.zeros_like(c), np.zeros(len(c)), 0.0) for c in centres]
        got = flat.collect()
        for r in got:
            out[r["start"]][0][r["centre"], r["i"]] = r["x"]
            out[r["start"]][1][r["centre"]] = r["n"]
        return [(s, n, sum(r["inertia"] for r in got if r["start"] == i and r["i"] == 0)) for i, (s, n, _) in enumerate(out)]

    for step in range(rounds):
        taken = rows.where(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(step)), F.lit(share)) == 0)
        for i, (s, n, _) in enumerate(sums(taken, centres)):
            given[i] += n
            some = n > 0
            centres[i][some] += (s[some] - n[some, None] * centres[i][some]) / given[i][some, None]
    inertia = [x[2] for x in sums(rows, centres)]
    return centres[int(np.argmin(inertia))]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equal ones, and its squared distance."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    label = d.argmin(1)
    return label, np.maximum(d[np.arange(len(x)), label], 0)


def assigned(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, v, cell, far: the nearest centre of each row and the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b["v"].flatten(), float).reshape(len(b), -1)
            label, far = nearest(x, centres)
            yield pa.record_batch([b["id"], b["v"], pa.array(label.astype(np.int32)), pa.array(np.sqrt(far))], ["id", "v", "cell", "far"])

    return df.select("id", "v").mapInArrow(assign, "id string, v array<double>, cell int, far double")


def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), V.l2_normalize(vector).alias("v"))


def kmeans(df: DataFrame, k: int = 30, seed: int = SEED) -> DataFrame:
    """blob_id, cluster_id of unit vectors; needs two rows for each cluster."""
    rows = settled(_units(df, "blob_id", "embedding"), "units")
    if rows.limit(2 * k).count() < 2 * k:
        raise ValueError(f"{k} clusters need {2 * k} rows")
    return assigned(rows, kmeans_centres(rows, k, seed)).select(F.col("id").alias("blob_id"), F.col("cell").alias("cluster_id"))


class CellIndex:
    """Unit vectors in coarse cells, each row with its distance to its cell's centre; the index is a table sorted by cell and distance.

    A row is no nearer to a query than the difference of both their distances to
    the row's centre. So once a query has k rows of its nearest cells, only rows in
    a ring of each cell can be nearer than the k-th of them: the answer is exact,
    and how much is read depends on how well the cells part the vectors.
    """

    def __init__(self, df: DataFrame, cells: int = 64, seed: int = SEED):
        rows = settled(_units(df, "blob_id", "embedding"), "units")
        n = rows.limit(cells).count()
        self.centres = kmeans_centres(rows, min(cells, n), seed) if n else np.zeros((0, 0))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = assigned(rows, self.centres).repartitionByRange(parts, "cell", "far").sortWithinPartitions("cell", "far") if n else rows.withColumn("cell", F.lit(0)).withColumn("far", F.lit(0.0))
        self.rows = settled(ranged, "cells")
        # a cell's rows and reach
        self.cells = {r["cell"]: (r["n"], r["reach"]) for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("reach")).collect()}

    def _rings(self, query: DataFrame, bound: DataFrame | None, k: int) -> DataFrame:
        """query_id, q, cell, low, high: the cells, and distances to their centres, that a query reads. Without a bound: its nearest cells that hold k rows together."""
        centres, cells, nearest_only = self.centres, self.cells, bound is None

        def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = np.asarray(b["q"].flatten(), float).reshape(len(b), -1)
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ centres.T + (centres * centres).sum(1), 0))
                who, cell, low, high = [], [], [], []
                for i in range(len(b)):
                    if nearest_only:
                        have = 0
                        for c in np.argsort(d[i], kind="stable"):
                            if have >= k:
                                break
                            n, reach = cells.get(int(c), (0, 0.0))
                            have += n
                            if n:
                                who, cell, low, high = [*who, i], [*cell, int(c)], [*low, 0.0], [*high, reach]
                    else:
                        reach_q = b["kth"][i].as_py() + SLACK
                        for c, (_, reach) in cells.items():
                            if d[i, c] - reach_q <= reach:
                                who, cell, low, high = [*who, i], [*cell, c], [*low, d[i, c] - reach_q], [*high, d[i, c] + reach_q]
                rows = pa.array(who, pa.int64())
                yield pa.record_batch([b["query_id"].take(rows), b["q"].take(rows), pa.array(cell, pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["query_id", "q", "cell", "low", "high"])

        rows = query if bound is None else query.join(bound, "query_id")
        return rows.mapInArrow(ring, "query_id string, q array<double>, cell int, low double, high double")

    def _read(self, rings: DataFrame) -> DataFrame:
        """query_id, blob_id, sim of all rows in the rings. Cells of many rows are many ranges of the table, and the join splits them."""
        rings = settled(rings, "rings")
        both = self.rows.join(small(rings), "cell").where((F.col("far") >= F.col("low")) & (F.col("far") <= F.col("high")))
        return both.select("query_id", F.col("id").alias("blob_id"), V.dot("v", "q").alias("sim"))

    def top_k(self, query: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """query_id, blob_id, sim, rank of the k rows of the greatest cosine to each query (query_id, q); also query_id, blob_id of all rows that were read for it."""
        asked = settled(_units(query, "query_id", "q").select(F.col("id").cast("string").alias("query_id"), F.col("v").alias("q")), "asked")
        first = settled(ranked(self._read(self._rings(asked, None, k)), F.col("query_id"), [F.desc("sim"), "blob_id"]).where(F.col("rank") <= k), "first")
        # distance of unit vectors; the k-th of what was read, or the last, if there are fewer rows than k
        kth = first.groupBy("query_id").agg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("sim"))).alias("kth"))
        read = settled(self._read(self._rings(asked, kth, k)), "read")
        return ranked(read, F.col("query_id"), [F.desc("sim"), "blob_id"]).where(F.col("rank") <= k), read.select("query_id", "blob_id")


def pca_2d(df: DataFrame) -> DataFrame:
    """blob_id, x, y: scores of the two first components of centred vectors; each component's largest loading is positive."""
    dim = V.doubles("embedding")
    mean = df.select(F.posexplode(dim).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()
    centre = F.array(*[F.lit(float(r["v"])) for r in mean])
    rows = df.select("blob_id", array_to_vector(F.zip_with(dim, centre, lambda a, b: a - b)).alias("c"))
    model = PCA(k=2, inputCol="c", outputCol="p").fit(rows)
    pc = model.pc.toArray()
    sign = [float(np.sign(pc[np.abs(pc[:, j]).argmax(), j])) for j in (0, 1)]
    p = vector_to_array("p")
    return model.transform(rows).select("blob_id", (p[0] * sign[0]).alias("x"), (p[1] * sign[1]).alias("y"))


def residual_adapter(df: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """blob_id, embedding = normalised x + W x + b."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch["embedding"].flatten(), float).reshape(len(batch), len(b))
            y = x + x @ w.T + b
            n = np.linalg.norm(y, axis=1, keepdims=True)
            y = np.divide(y, n, out=y, where=n > 0)
            offsets = np.arange(len(y) + 1, dtype=np.int32) * len(b)
            yield pa.record_batch([batch["blob_id"], pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], ["blob_id", "embedding"])

    return df.select("blob_id", V.doubles("embedding").alias("embedding")).mapInArrow(apply, "blob_id string, embedding array<double>")
