"""Exact top-k search with vector-approximation files.

A file of its own holds a quantised cell, one byte, for each component of every
vector; each dimension has cells of its own, of about equally many vectors. A
task holds the cells of a block of vectors, scans them for bounds of the inner
product with each query of a group, and answers with the rows that may be among a
query's k best of the block. Then exact vectors are read in the order of their
bounds: the best ones first, and of the others those whose bound reaches the k-th
score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import settle, table, told

K, SCALE, EVERY = 5, 256, 50
CELLS = 256
#: Vectors of each dimension that the borders of cells are taken from, at most; every vector gets its cells.
GRID = 4096
#: Blocks of vectors and groups of queries, at any size; vectors of a block, which a task holds, at most on average.
BLOCKS, GROUPS, HELD = 16, 4, 524_288
#: Vectors, and queries, that are multiplied at once.
VECTORS, ROWS = 8192, 512
#: Exact vectors that are read first for each query.
READ = 32


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, v array<long> = floor(scale * x): one row for each vec_id.

    Vectors that are null or hold a null or non-finite component, and rows
    without vec_id, take no part; of a repeated vec_id the smallest vector counts.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return known.select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v")


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, n, lo, hi: how many vectors a task has, the least and the greatest value of each component."""
    ends: dict[int, list[np.ndarray]] = {}
    n: dict[int, int] = {}
    for b in batches:
        for d in set(b["dim"].to_pylist()) - {0}:
            x = b.filter(pa.compute.equal(b["dim"], d))["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            lo, hi = ends.get(d, (x[0], x[0]))
            ends[d] = [np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))]
            n[d] = n.get(d, 0) + len(x)
    yield pa.record_batch([pa.array(list(ends), pa.int32()), pa.array([n[d] for d in ends], pa.int64()), *(pa.array([e[k].tolist() for e in ends.values()], pa.list_(pa.int64())) for k in (0, 1))], ["dim", "n", "lo", "hi"])


def grids(vectors: DataFrame, cells: int = CELLS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the least and the greatest value of every cell of every component: dim x cells.

    Inner borders are quantiles of at most GRID vectors, those of the least hashes;
    the outer ones are the extremes of all vectors. A far-off value widens the last
    cell of its component, and no other.
    """
    ends = vectors.mapInArrow(_extremes, "dim int, n long, lo array<long>, hi array<long>").select("dim", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("at", "x"))
    ends = ends.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    # a row for each component of each dimension
    rows = ends.groupBy("dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "lo", "hi"))).alias("x")).select("dim", "n", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")).collect()
    by = F.xxhash64("vec_id", F.lit(3))
    out = {0: (np.zeros((0, cells)), np.zeros((0, cells)))}
    for r in rows:
        # every task sends the driver its GRID least, so only hashes that some 2 * GRID vectors have are looked at
        most = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * GRID // r["n"])
        sample = vectors.where((F.col("dim") == r["dim"]) & (by <= most)).orderBy(by, "vec_id").limit(GRID).select("v").collect()
        inner = np.floor(np.quantile(np.array([x["v"] for x in sample], float), np.arange(1, cells) / cells, axis=0))
        # cell c holds lo[c] <= v <= hi[c]; a border belongs to the cell above it
        lo = np.vstack([np.array(r["lo"], float), inner])
        hi = np.vstack([inner - 1, np.array(r["hi"], float)])
        out[r["dim"]] = lo.T, np.maximum(hi, lo).T
    return out


def approximation_file(vectors: DataFrame, grid: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """dim, vec_id, cell: the cells of a vector, one byte for each component."""

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in sorted(set(b["dim"].to_pylist())):
                one = b.filter(pa.compute.equal(b["dim"], d))
                x = one["v"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(one), d)
                cell = np.zeros(x.shape, np.uint8)
                for k in range(d):
                    cell[:, k] = np.searchsorted(grid[d][0][k, 1:], x[:, k], side="right")
                yield pa.record_batch([one["dim"], one["vec_id"], pa.array([c.tobytes() for c in cell], pa.binary())], ["dim", "vec_id", "cell"])

    return vectors.select("dim", "vec_id", "v").mapInArrow(quantised, "dim int, vec_id long, cell binary")


def bounded_candidates(ids: np.ndarray, cell: np.ndarray, qids: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
    """Query, vector and upper bound of the rows of a block that may be among a query's k best.

    Along each component a row's value is off the middle of its cell by half the
    cell at most, so its score is off by the halves weighed with the query's
    absolute values. A row stays if its upper bound reaches the k-th lower bound of
    the whole block, which VECTORS rows at a time raise.
    """
    at, q = np.arange(cell.shape[1]), q.astype(float)
    best, found = np.full((len(q), k), -np.inf), []
    for a in range(0, len(ids), VECTORS):
        some = cell[a : a + VECTORS]
        low, high = lo[at, some], hi[at, some]
        middle, half = (low + high) / 2, (high - low) / 2
        score, slack = q @ middle.T, np.abs(q) @ half.T
        slack += 1e-9 * (np.abs(q) @ np.abs(middle).max(0, initial=0))[:, None] + 1e-9 * slack + 1e-6  # rounding
        own = qids[:, None] == ids[None, a : a + VECTORS]
        lower = np.where(own, -np.inf, score - slack)
        m = min(k, len(some))
        best = -np.sort(-np.concatenate([best, -np.partition(-lower, m - 1, axis=1)[:, :m]], 1), axis=1)[:, :k]
        upper = score + slack
        i, j = np.nonzero((upper >= best[:, -1:]) & ~own)
        found.append((i, a + j, upper[i, j]))
    i, j, upper = (np.concatenate(x) for x in zip(*found, strict=True))
    stays = upper >= best[i, -1]
    return qids[i[stays]], ids[j[stays]], upper[stays]


def pairs(file: DataFrame, queries: DataFrame) -> DataFrame:
    """A partition for each pair of a block of vectors (dim, vec_id, cell) and a group of queries (dim, vec_id, v, asks): first the vectors, then the queries.

    The numbers of blocks and groups do not follow the tables, so a row is sent
    equally often at any size, and by a shuffle only: as one side of a join, the
    queries of all blocks could be broadcast. Only if a block had more than HELD
    vectors there are more blocks.
    """
    n = max(BLOCKS, -(-file.count() // HELD))
    number = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = file.withColumn("block", number(n)).withColumn("grp", every(GROUPS)).withColumn("asks", F.lit(False))
    right = queries.select("dim", "vec_id", "v").withColumn("block", every(n)).withColumn("grp", number(GROUPS)).withColumn("asks", F.lit(True))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("part", F.col("block") * GROUPS + F.col("grp")).drop("block", "grp")
    return rows.repartitionById(n * GROUPS, "part").sortWithinPartitions("asks")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score for queries and vectors of ``integer_vectors``.

    Cells alone are scanned. Of a query's candidates the READ best by bound are
    read exactly; their k-th score decides which of the others, by their bounds,
    are read too. Only vectors of the query's own dimension are candidates. Scores
    are ranked exactly, as decimals of 38 digits where 64 bits do not hold them
    (then ``score`` is the nearest long). Without vectors or queries the result is
    empty.
    """
    # of equal vectors the k + 1 smallest ids beat all others (one may be the query's own)
    equal = Window.partitionBy("dim", "v").orderBy("vec_id")
    grid = grids(vectors, cells)
    file = approximation_file(vectors.withColumn("r", F.row_number().over(equal)).where(F.col("r") <= k + 1), grid)
    file, asked = settle(file, "approximations"), settle(queries, "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        block: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # ids and cells, once all vectors are there
        for b in batches:
            n = len(b) - b["asks"].true_count
            for part, asks in ((b.slice(0, n), False), (b.slice(n), True)):
                for d in sorted(set(part["dim"].to_pylist())):
                    one = part.filter(pa.compute.equal(part["dim"], d))
                    if not asks:
                        held.setdefault(d, []).append(one.select(["vec_id", "cell"]))
                        continue
                    if d in held:
                        t = pa.Table.from_batches(held.pop(d))
                        block[d] = t["vec_id"].to_numpy(), np.frombuffer(b"".join(t["cell"].to_pylist()), np.uint8).reshape(len(t), d)
                    if d in block:
                        qids, qs = one["vec_id"].to_numpy(), one["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(one), d)
                        for a in range(0, len(qids), ROWS):
                            yield pa.record_batch([pa.array(x) for x in bounded_candidates(*block[d], qids[a : a + ROWS], qs[a : a + ROWS], *grid[d], k)], ["query_id", "vec_id", "upper"])

    found = settle(pairs(file, asked).mapInArrow(search, "query_id long, vec_id long, upper double"), "candidates")
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    first = settle(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= READ), "first")
    read = settle(exact_scores(first, vectors, asked), "scores")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = read.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    # without a k-th score a query has READ candidates at most, which are read; of others those after the first READ
    last = first.where(F.col("r") == READ).select("query_id", F.col("upper").alias("last"), F.col("vec_id").alias("last_id"))
    more = found.join(told(settle(kth.join(last, "query_id"), "kth")), "query_id")
    more = more.where((F.col("upper") >= F.col("kth")) & ((F.col("upper") < F.col("last")) | ((F.col("upper") == F.col("last")) & (F.col("vec_id") > F.col("last_id")))))
    every_one = read.unionByName(exact_scores(settle(more.select("query_id", "vec_id"), "more"), vectors, asked))
    return every_one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.greatest(F.least("score", F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("long").alias("score"))


def exact_scores(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, score decimal(38,0) of settled candidates; sums beyond 38 digits are the greatest or least such number. Vectors are told the candidates, if these are few, and not the other way round."""
    one = vectors.select("vec_id", "v").join(told(candidates.select("query_id", "vec_id")), "vec_id")
    both = one.join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    wide = lambda x: x.cast("decimal(19,0)")
    whole = F.aggregate(F.zip_with("v", "q", F.try_multiply), F.lit(0).cast("long"), F.try_add)
    exact = F.aggregate(F.zip_with("v", "q", lambda x, y: wide(x) * wide(y)), F.lit(0).cast("decimal(38,0)"), lambda n, x: F.try_add(n, x).cast("decimal(38,0)"))
    near = F.aggregate(F.zip_with("v", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda n, x: n + x)
    most = F.lit("9" * 38).cast("decimal(38,0)")
    return both.select("query_id", "vec_id", F.coalesce(whole.cast("decimal(38,0)"), exact, F.when(near > 0, most).otherwise(-most)).alias("score"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = settle(integer_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP2_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
