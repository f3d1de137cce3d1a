"""Vector search, text search, rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blobsearch.functions import vectors as V

#: A table goes to every task only if its size is known to be below these rows.
BROADCAST_ROWS = 100_000
#: Blocks of vectors and groups of queries of an all-pairs search; vectors of a block, which a task holds, at most on average.
BLOCKS, GROUPS, HELD = 8, 16, 524_288
#: Vectors, and queries, that are multiplied at once.
BLOCK, ROWS = 4096, 512


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has at most so many rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, by: Column, order: list, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top_k(df: DataFrame, query: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """The k rows closest to each query (query_id, q): query_id, blob_id, sim, rank. Filters belong before it.

    Each partition keeps its own best k of a query before rows are shuffled (window group limit).
    """
    sims = df.crossJoin(small(query)).select("query_id", "blob_id", V.dot(vector, "q").alias("sim"))
    return ranked(sims, F.col("query_id"), [F.desc("sim"), "blob_id"]).where(F.col("rank") <= k)


def _pairs(v: DataFrame, q: DataFrame) -> DataFrame:
    """A partition for each pair of a block of vectors (id, v) and a group of queries (id, q, own): the vectors in the order of ids, then the queries.

    The numbers of blocks and groups do not follow the tables, so a row is sent
    equally often at any size. Only if a block had more than HELD vectors there
    are more blocks.
    """
    n = max(BLOCKS, -(-v.count() // HELD))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = v.withColumn("block", number(n)).withColumn("grp", every(GROUPS)).withColumn("asks", F.lit(False))
    right = q.withColumn("block", every(n)).withColumn("grp", number(GROUPS)).withColumn("asks", F.lit(True))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("part", F.col("block") * GROUPS + F.col("grp")).drop("block", "grp")
    return rows.repartitionById(n * GROUPS, "part").sortWithinPartitions("asks", "id")


def _floats(df: DataFrame, vector: str) -> Column:
    """Single precision is sent as it is, anything else in double."""
    return F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else V.doubles(vector)


def _held(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, pa.Array, pa.RecordBatch]]:
    """The vectors of a partition of ``_pairs``, their ids, and queries as they come."""
    vectors, ids, x, names = [], [], None, None
    for b in batches:
        n = len(b) - b["asks"].true_count
        if n:
            vectors.append(b["v"].slice(0, n).flatten().to_numpy(zero_copy_only=False))
            ids.append(b["id"].slice(0, n))
        if n < len(b) and (ids or names is not None):
            if names is None:
                x, names = np.concatenate(vectors).reshape(-1, dim), pa.concat_arrays(ids)
                vectors.clear()
            yield x, names, b.slice(n)


def _best(y: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k vectors closest to each query, as query, place of the vector and similarity; of equal ones the first places. NaN is greatest, as in SQL."""
    who, place, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least, short = np.full(len(y), -np.inf), np.ones(len(y), bool)
    for at in range(0, len(x), BLOCK):
        s = y @ x[at : at + BLOCK].astype(float).T
        if at == 0 and s.shape[1] > k:
            s = np.round(s, 9)
            kth = np.partition(s, -k, axis=1)[:, -k, None]
            tie = s == kth
            row, col = np.nonzero(~(s <= kth) | (tie & (np.cumsum(tie, 1) <= k)))
            new = s[row, col]
        else:
            # what may reach the k-th best when rounded; a later place loses a tie
            row, col = np.nonzero(~(s < (least - 1e-9 - 1e-14 * np.abs(least))[:, None]) | short[:, None])
            new = np.round(s[row, col], 9)
            better = short[row] | ~(new <= least[row])
            row, col, new = row[better], col[better], new[better]
        if not len(row):
            continue
        who, place, sim = np.append(who, row), np.append(place, at + col), np.append(sim, new)
        order = np.lexsort((place, -sim, ~np.isnan(sim), who))
        order = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < k]
        who, place, sim = who[order], place[order], sim[order]
        n = np.bincount(who, minlength=len(y))
        short = n < k
        least[~short] = sim[np.cumsum(n)[~short] - 1]
    return who, place, sim


def top_k_blocks(df: DataFrame, query: DataFrame, k: int, dim: int) -> DataFrame:
    """As ``top_k`` for many queries: hashed blocks of vectors meet hashed groups of queries, and each pair keeps k for each query.

    Only vectors and queries of ``dim`` components take part.
    """
    v = df.select(F.col("blob_id").alias("id"), _floats(df, "embedding").alias("v")).where(F.size("v") == dim)
    q = query.select(F.col("query_id").alias("id"), _floats(query, "q").alias("q")).where(F.size("q") == dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids, b in _held(batches, dim):
            y = b["q"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            for at in range(0, len(y), ROWS):
                who, place, sim = _best(y[at : at + ROWS], x, k)
                yield pa.record_batch([b["id"].take(pa.array(at + who)), ids.take(pa.array(place)), pa.array(sim)], ["query_id", "blob_id", "sim"])

    found = _pairs(v, q).mapInArrow(search, "query_id string, blob_id string, sim double")
    return ranked(found, F.col("query_id"), [F.desc("sim"), "blob_id"]).where(F.col("rank") <= k)


def _ahead(y: np.ndarray, own: np.ndarray, place: np.ndarray, mine: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many vectors stand before each query's own similarity: of equal ones those of smaller places. The row at ``place`` is none of them where it is the query's own (``mine``)."""
    n, tol = np.zeros(len(y), np.int64), (2e-9 + 1e-14 * np.abs(own))[:, None]
    for at in range(0, len(x), BLOCK):
        s = y @ x[at : at + BLOCK].astype(float).T
        d = s - own[:, None]
        n += np.count_nonzero(d > tol, axis=1)
        # those that rounding may make equal, or that are not numbers
        row, col = np.nonzero(~(np.abs(d) > tol))
        r, o, p = np.round(s[row, col], 9), own[row], at + col
        above = (r > o) | (np.isnan(r) & ~np.isnan(o))
        tie = (r == o) | (np.isnan(r) & np.isnan(o))
        n += np.bincount(row[(above & ~(mine[row] & (p == place[row]))) | (tie & (p < place[row]))], minlength=len(y))
    return n


def rank_of_own(df: DataFrame, query: DataFrame, dim: int) -> DataFrame:
    """query_id, first: the rank that the row named like the query has in the query's order. query: query_id, q, own (its similarity to that row).

    Blocks of vectors meet groups of queries; a pair of them returns a count for
    each query, so nothing is ranked. Ties go to smaller ids.
    """
    v = df.select(F.col("blob_id").alias("id"), _floats(df, "embedding").alias("v")).where(F.size("v") == dim)
    q = query.select(F.col("query_id").alias("id"), _floats(query, "q").alias("q"), "own").where(F.size("q") == dim)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for x, ids, b in _held(batches, dim):
            names = np.array(ids.to_pylist()) if names is None else names
            asked = np.array(b["id"].to_pylist())
            place = np.searchsorted(names, asked)
            mine = names[np.minimum(place, len(names) - 1)] == asked
            y = b["q"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            own = np.round(b["own"].to_numpy(zero_copy_only=False).astype(float), 9)
            parts = [slice(at, at + ROWS) for at in range(0, len(y), ROWS)]
            yield pa.record_batch([b["id"], pa.array(np.concatenate([_ahead(y[p], own[p], place[p], mine[p], x) for p in parts]))], ["query_id", "ahead"])

    return _pairs(v, q).mapInArrow(count, "query_id string, ahead long").groupBy("query_id").agg((F.sum("ahead") + 1).alias("first"))


def tokens(text: Column | str) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, text: str = "caption") -> DataFrame:
    """term, blob_id, tf of rows with a text."""
    return docs.where(F.col(text).isNotNull()).select("blob_id", F.explode(tokens(text)).alias("term")).groupBy("term", "blob_id").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, text: str = "caption", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, blob_id, bm25 of documents that hold every term of a query (query_id, terms array)."""
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("n_terms"))
    wanted = small(asked.select("term").distinct())
    split = docs.where(F.col(text).isNotNull()).select("blob_id", tokens(text).alias("t"))
    corpus = split.agg(F.count("*").alias("nd"), F.avg(F.size("t").cast("double")).alias("avgdl"))
    # a posting carries its document's length; terms that nobody asked for go before they are shuffled
    each = split.select("blob_id", F.size("t").cast("double").alias("dl"), F.explode("t").alias("term"))
    found = each.join(wanted, "term").groupBy("term", "blob_id", "dl").agg(F.count("*").alias("tf"))
    df = found.groupBy("term").agg(F.count("*").alias("n"))
    hit = found.join(asked, "term").join(df, "term").crossJoin(F.broadcast(corpus))
    idf = F.greatest(F.log((F.col("nd") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "blob_id").agg(F.sum(part).alias("bm25"), F.count("*").alias("hits"), F.max("n_terms").alias("n_terms")).where("hits = n_terms").select("query_id", "blob_id", "bm25")


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """query_id, blob_id, rrf: the sum of 1 / (k + rank) over ranked lists (query_id, blob_id, rank)."""
    every = lists[0].select("query_id", "blob_id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "blob_id", "rank"))
    return every.groupBy("query_id", "blob_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"))


def duplicate_penalty(df: DataFrame, weight: float, order: str = "rank") -> DataFrame:
    """weight times the number of earlier rows of the same parent; 0 without a parent."""
    earlier = F.row_number().over(Window.partitionBy("query_id", "parent_quilt_id").orderBy(order)) - 1
    return df.withColumn("dupe", F.when(F.col("parent_quilt_id").isNull(), 0.0).otherwise(earlier * weight))


def rerank_soft(df: DataFrame, keep: int = 1, nsfw: float = 0.15, tiny: float = 0.10, dupe: float = 0.20, recent: Column | None = None) -> DataFrame:
    """Adds rerank_score and final_rank to candidates (sim, rank, nsfw_score, is_nsfw, size, parent_quilt_id); the first ``keep`` stay in place."""
    df = duplicate_penalty(df, dupe)
    bad = F.when(F.coalesce("nsfw_score", F.lit(0.0)) > 0, F.col("nsfw_score") / 100 * nsfw).when(F.coalesce("is_nsfw", F.lit(False)), nsfw).otherwise(0.0)
    little = F.when((F.col("size") > 0) & (F.col("size") < 10_240), tiny).otherwise(0.0)
    score = F.col("sim") * (1 + (recent if recent is not None else F.lit(0.0)) - bad - F.col("dupe") - little)
    df = df.withColumn("rerank_score", F.round(score * 100, 2))
    first = F.when(F.col("rank") <= keep, F.col("rank"))
    w = Window.partitionBy("query_id").orderBy(first.asc_nulls_last(), F.desc("rerank_score"), "rank", "blob_id")
    return df.withColumn("final_rank", F.row_number().over(w))


def reassign_scores(df: DataFrame) -> DataFrame:
    """The i-th best display score of a query goes to its i-th ranked row, rounded to one digit."""
    w = Window.partitionBy("query_id")
    scores = df.select("query_id", F.round("score", 1).alias("display"), F.row_number().over(w.orderBy(F.desc("score"), "blob_id")).alias("final_rank"))
    return df.join(scores, ["query_id", "final_rank"])


def mmr(df: DataFrame, k: int, lam: float = 0.85, same_parent: float = 0.15, schema_id: str = "query_id") -> DataFrame:
    """query_id, blob_id, mmr_rank: greedy choice of relevance less similarity to what is chosen. Candidates of a query are few by contract (a top-k list)."""
    import pandas as pd

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sim", "blob_id"], ascending=[False, True], ignore_index=True)
        if lam >= 1:
            chosen = list(range(min(k, len(pdf))))
        else:
            e = np.array(pdf["embedding"].tolist(), float)
            near = e @ e.T
            parent = pdf["parent_quilt_id"].to_numpy(object)
            same = (parent[:, None] == parent[None, :]) & np.array([p is not None for p in parent])[None, :]
            near = near + same_parent * same
            worst, left, chosen = np.full(len(pdf), -np.inf), set(range(len(pdf))), []
            while left and len(chosen) < k:
                gain = {i: lam * pdf["sim"][i] - (1 - lam) * (worst[i] if chosen else 0.0) for i in left}
                best = max(sorted(left), key=gain.__getitem__)
                chosen.append(best)
                left.remove(best)
                worst = np.maximum(worst, near[:, best])
        out = pdf.loc[chosen, ["query_id", "blob_id"]]
        return out.assign(mmr_rank=np.arange(1, len(out) + 1))

    return df.select("query_id", "blob_id", "sim", V.doubles("embedding").alias("embedding"), "parent_quilt_id").groupBy("query_id").applyInPandas(choose, "query_id string, blob_id string, mmr_rank long")


def cluster_candidates(df: DataFrame, top: int, mult: float = 1.0, rounds: int = 50) -> DataFrame:
    """Adds cluster_id to candidates (query_id, blob_id, sim, embedding): k-means of each query's own ones, k = round(top * mult), at least 2.

    Candidates of a query are few by contract. They start from the best one and
    each time the one farthest from all centres; up to ``top`` of them are a
    cluster each. A candidate without vector gets none and goes.
    """
    import pandas as pd

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sim", "blob_id"], ascending=[False, True], ignore_index=True)
        if len(pdf) <= top:
            return pdf[["query_id", "blob_id"]].assign(cluster_id=np.arange(len(pdf)))
        x = np.array(pdf["embedding"].tolist(), float)
        k = max(2, min(round(top * mult), len(pdf)))
        centres = [0]
        far = ((x - x[0]) ** 2).sum(1)
        while len(centres) < k:
            centres.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[centres[-1]]) ** 2).sum(1))
        c, label = x[centres], None
        for _ in range(rounds):
            new = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2).argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            c = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
        return pdf[["query_id", "blob_id"]].assign(cluster_id=label)

    rows = df.where("embedding is not null").select("query_id", "blob_id", "sim", V.doubles("embedding").alias("embedding"))
    labels = rows.groupBy("query_id").applyInPandas(cluster, "query_id string, blob_id string, cluster_id long")
    return df.join(labels, ["query_id", "blob_id"])


def rerank_clusters(df: DataFrame, cluster: str = "label") -> DataFrame:
    """Round robin over clusters: the best of each cluster, then the second of each; clusters by their sum of sim."""
    sums = df.groupBy("query_id", cluster).agg(F.round(F.sum("sim"), 9).alias("mass"))
    order = ranked(sums, F.col("query_id"), [F.desc("mass"), cluster], "cluster_rank").drop("mass")
    within = F.row_number().over(Window.partitionBy("query_id", cluster).orderBy(F.desc("sim"), "blob_id"))
    rows = df.withColumn("turn", within).join(order, ["query_id", cluster])
    return ranked(rows, F.col("query_id"), ["turn", "cluster_rank"], "final_rank")


def rescore_top(df: DataFrame, k: int, scorer) -> DataFrame:
    """A second scorer (a function of Arrow batches to a double array) on the first k rows of each query; the others get -100."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("second", pa.array(scorer(b), pa.float64()))

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("second", T.DoubleType())])
    return df.where(F.col("rank") <= k).mapInArrow(run, schema).unionByName(df.where(F.col("rank") > k).withColumn("second", F.lit(-100.0)))


def hybrid(vectors: DataFrame, captions: DataFrame, query: DataFrame, k: int, exclude_nsfw: bool = True, multiplier: float = 450.0, over: int = 20, index=None) -> DataFrame:
    """Vector and caption candidates fused by rank, floored, reranked and cut to k.

    query: query_id, q, terms. index: a ``TextIndex`` of the captions; without one they are split anew. Returns query_id, blob_id, final_rank, display, caption.
    """
    pool = vectors.where((F.col("kind") == "image") & (~F.col("is_nsfw") if exclude_nsfw else F.lit(True)))
    near = top_k(pool, query.select("query_id", "q"), over * k)
    words = (index.bm25(query) if index else bm25(captions, query)).join(pool.select("blob_id"), "blob_id", "left_semi")
    words = ranked(words, F.col("query_id"), [F.desc(F.round("bm25", 9)), "blob_id"], "rank")
    fused = rrf([near, words])
    both = fused.join(near.select("query_id", "blob_id", F.col("sim").alias("near_sim")), ["query_id", "blob_id"], "left").join(words.select("query_id", "blob_id", F.col("rank").alias("fts_rank")), ["query_id", "blob_id"], "left")
    full = both.join(pool.select("blob_id", "embedding", "size", "is_nsfw", "parent_quilt_id"), "blob_id").join(small(query.select("query_id", "q")), "query_id")
    cos = F.coalesce("near_sim", V.dot("embedding", "q"))
    floor = F.when(F.col("fts_rank").isNotNull(), F.greatest(F.lit(0.0), 0.20 - 0.005 * F.col("fts_rank"))).otherwise(0.0)
    cand = full.withColumn("sim", F.greatest(cos, floor, F.lit(0.0))).withColumn("score", F.least(F.col("sim") * multiplier, F.lit(100.0)))
    cand = ranked(cand, F.col("query_id"), [F.desc(F.round("rrf", 12)), "blob_id"]).withColumn("nsfw_score", F.lit(0.0))
    final = reassign_scores(rerank_soft(cand).where(F.col("final_rank") <= k))
    return final.join(captions.select("blob_id", "caption"), "blob_id", "left").select("query_id", "blob_id", "final_rank", "display", F.coalesce(F.nullif("caption", F.lit("")), F.lit("")).alias("caption"))
