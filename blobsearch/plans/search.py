"""Vectors, joins, windows, ranking and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blobsearch.functions import vectors as V
from blobsearch.operators import catalog as C
from blobsearch.operators import judge as J
from blobsearch.operators import search as S
from blobsearch.operators.textindex import TextIndex
from blobsearch.sources.shared import new_path

from .registry import query

DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
SIMS = f"SELECT query_id, blob_id, {DOT.format('embedding', 'q')} AS sim, v.* EXCLUDE (blob_id) FROM v_vectors v, v_queries"
KNN = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, blob_id) AS rank FROM ({0})"


def knn_sql(where: str = "TRUE", k: int = 10, cols: str = "query_id, blob_id, round(sim, 6) AS sim, CAST(rank AS INT) AS rank") -> str:
    return f"SELECT {cols} FROM ({KNN.format(f'SELECT * FROM ({SIMS}) WHERE {where}')}) WHERE rank <= {k}"


def _sims(df):
    return df.withColumn("sim", V.rounded_number("sim"))


@query("l2_normalize", "WITH d AS (SELECT blob_id, CAST(embedding AS DOUBLE[]) AS e FROM v_vectors) SELECT blob_id, list_transform(e, lambda x: round(3 * x / sqrt(9 * list_dot_product(e, e)), 6)) AS v FROM d")
def _(t):
    tripled = F.transform(V.doubles("embedding"), lambda x: x * 3)
    return t.v_vectors.select("blob_id", V.rounded(V.l2_normalize(tripled)).alias("v"))


@query("cosine", f"SELECT query_id, blob_id, round({DOT.format('embedding', 'q')}, 6) AS sim FROM v_vectors, v_queries WHERE query_id = '3'")
def _(t):
    q = t.v_queries.where("query_id = '3'")
    return t.v_vectors.crossJoin(F.broadcast(q)).select("query_id", "blob_id", V.rounded_number(V.dot("embedding", "q")).alias("sim"))


@query("l2_distance", "SELECT query_id, blob_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS d FROM v_vectors, v_queries WHERE query_id = '4'")
def _(t):
    q = t.v_queries.where("query_id = '4'")
    return t.v_vectors.crossJoin(F.broadcast(q)).select("query_id", "blob_id", F.round(V.l2_distance("embedding", "q"), 6).alias("d"))


@query("reshape_dim", """
WITH s AS (SELECT blob_id, CAST(embedding[1:40] AS DOUBLE[]) AS e FROM v_vectors), c AS (SELECT blob_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS c FROM s)
SELECT blob_id, list_transform(c, lambda x: round(x, 6)) AS cut, list_concat(list_transform(c, lambda x: round(x / sqrt(list_dot_product(c, c)), 6)), [0.0, 0.0]) AS padded FROM c
""")  # fmt: skip
def _(t):
    cut = t.v_vectors.select("blob_id", V.reshape_dim("embedding", 40).alias("c"))
    return cut.select("blob_id", V.rounded("c").alias("cut"), V.rounded(V.reshape_dim("c", 42)).alias("padded"))


@query("blend", """
WITH b AS (SELECT v.blob_id, list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])), lambda p: p[1] * 0.8 + p[2] * 0.2) AS e FROM v_vectors v JOIN v_queries q ON CAST(v.label AS VARCHAR) = q.query_id)
SELECT blob_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6)) AS v FROM b
""")  # fmt: skip
def _(t):
    both = t.v_vectors.join(t.v_queries, F.col("label").cast("string") == F.col("query_id"))
    return both.select("blob_id", V.rounded(V.blend("embedding", "q", 0.2)).alias("v"))


_CENTROID = """
WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM v_vectors), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY 1), cen AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c)
"""


@query("centroid", _CENTROID + "SELECT label, list_transform(c, lambda x: round(x, 6)) AS centroid FROM cen")
def _(t):
    return V.centroid(t.v_vectors, "label", "embedding").withColumn("centroid", V.rounded("centroid"))


@query("cluster_medoid", _CENTROID + f"SELECT label, arg_min(blob_id, (round(1 - {DOT.format('embedding', 'c')}, 9), blob_id)) AS blob_id FROM v_vectors JOIN cen USING (label) GROUP BY label")
def _(t):
    # one centroid for each label: the side that a shuffle of the vectors by label meets
    rows = t.v_vectors.join(V.centroid(t.v_vectors, "label", "embedding"), "label").withColumn("d", F.round(1 - V.dot("embedding", "centroid"), 9))
    return rows.groupBy("label").agg(F.min_by("blob_id", F.struct("d", "blob_id")).alias("blob_id"))


@query("cluster_label", _CENTROID + f"SELECT label, arg_max(proto_id, (round({DOT.format('c', 'p')}, 9), proto_id)) AS proto_id FROM cen, v_prototypes GROUP BY label")
def _(t):
    rows = V.centroid(t.v_vectors, "label", "embedding").crossJoin(S.small(t.v_prototypes)).withColumn("s", F.round(V.dot("centroid", "p"), 9))
    return rows.groupBy("label").agg(F.max_by("proto_id", F.struct("s", "proto_id")).alias("proto_id"))


@query("distinct_vectors", "SELECT CAST(count(DISTINCT list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 6))) AS BIGINT) AS n FROM v_vectors")
def _(t):
    return t.v_vectors.agg(F.countDistinct(V.rounded("embedding")).alias("n"))


@query("src_vectors", "SELECT CAST(count(*) FILTER (len(embedding) = 64) AS BIGINT) AS loaded, CAST(count(*) FILTER (len(embedding) <> 64) AS BIGINT) AS rejected FROM v_vectors")
def _(t):
    return t.v_vectors.agg(F.count_if(F.size("embedding") == 64).alias("loaded"), F.count_if(F.size("embedding") != 64).alias("rejected"))


@query("score_scale", f"SELECT blob_id, round(least(greatest(sim, 0) * 450, 100), 4) AS score, round(least(greatest((sim + 1) / 2, 0), 1) * 100, 4) AS modality, round(1 - sim, 6) AS distance FROM (SELECT blob_id, {DOT.format('embedding', 'q')} AS sim FROM v_vectors, v_queries WHERE query_id = '1')")
def _(t):
    sims = t.v_vectors.crossJoin(F.broadcast(t.v_queries.where("query_id = '1'"))).select("blob_id", V.dot("embedding", "q").alias("sim"))
    return sims.select("blob_id", F.round(C.score_scale(F.col("sim"), 450), 4).alias("score"), F.round(C.modality_score(F.col("sim")), 4).alias("modality"), V.rounded_number(1 - F.col("sim")).alias("distance"))


@query("knn_exact", knn_sql("query_id = '0'"))
def _(t):
    return _sims(S.top_k(t.v_vectors, t.v_queries.where("query_id = '0'"), 10))


@query("knn_filtered", knn_sql("query_id = '2' AND kind = 'image' AND NOT is_nsfw AND blob_id <> '25'"))
def _(t):
    return _sims(S.top_k(t.v_vectors.where("kind = 'image' and not is_nsfw and blob_id <> '25'"), t.v_queries.where("query_id = '2'"), 10))


@query("knn_modality", knn_sql("query_id = '2' AND kind = 'video' AND NOT is_nsfw", 5, "query_id, blob_id, round(least(greatest((sim + 1) / 2, 0), 1) * 100, 4) AS score"))
def _(t):
    top = S.top_k(t.v_vectors.where("kind = 'video' and not is_nsfw"), t.v_queries.where("query_id = '2'"), 5)
    return top.select("query_id", "blob_id", F.round(C.modality_score(F.col("sim")), 4).alias("score"))


@query("knn_batch", f"SELECT query_id, blob_id, round(sim, 3) AS sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, blob_id) AS rank FROM (SELECT w.blob_id AS query_id, v.blob_id, {DOT.format('v.embedding', 'w.embedding')} AS sim FROM v_vectors v, v_vectors w)) WHERE rank <= 10")
def _(t):
    return S.top_k_blocks(t.v_vectors, t.v_vectors.select(F.col("blob_id").alias("query_id"), F.col("embedding").alias("q")), 10, 64).withColumn("sim", F.round("sim", 3))


@query("knn_ann", knn_sql(cols="query_id, blob_id, CAST(rank AS INT) AS rank"))
def _(t):
    from blobsearch.operators.learned import CellIndex

    return CellIndex(t.v_vectors).top_k(t.v_queries, 10)[0].select("query_id", "blob_id", "rank")


@query("cross_similarity", f"SELECT query_id, round(avg({DOT.format('embedding', 'q')}), 6) AS mean, round(max({DOT.format('embedding', 'q')}), 6) AS top FROM v_vectors, v_queries GROUP BY query_id")
def _(t):
    s = t.v_vectors.crossJoin(S.small(t.v_queries)).select("query_id", V.dot("embedding", "q").alias("s"))
    return s.groupBy("query_id").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.max("s"), 6).alias("top"))


_TOP2 = f"SELECT blob_id, anchor_id, {DOT.format('embedding', 'a')} AS s, row_number() OVER (PARTITION BY blob_id ORDER BY {DOT.format('embedding', 'a')} DESC, anchor_id) AS r FROM v_vectors, v_anchors"


def _top2(t):
    rows = t.v_vectors.crossJoin(S.small(t.v_anchors)).select("blob_id", "anchor_id", V.dot("embedding", "a").alias("s"))
    best = S.ranked(rows, F.col("blob_id"), [F.desc("s"), "anchor_id"], "r").where("r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return best.groupBy("blob_id").agg(pick("anchor_id", 1).alias("best"), pick("anchor_id", 2).alias("second"), pick("s", 1).alias("s1"), pick("s", 2).alias("s2"))


@query("top2_margin", f"SELECT a.blob_id, a.anchor_id AS best, b.anchor_id AS second, round(a.s - b.s, 6) AS margin FROM ({_TOP2}) a JOIN ({_TOP2}) b ON a.blob_id = b.blob_id AND a.r = 1 AND b.r = 2")
def _(t):
    return _top2(t).select("blob_id", "best", "second", F.round(F.col("s1") - F.col("s2"), 6).alias("margin"))


@query("cross_anchor", f"SELECT anchor_id, CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS mean FROM ({_TOP2}) WHERE r = 1 GROUP BY 1")
def _(t):
    return _top2(t).groupBy(F.col("best").alias("anchor_id")).agg(F.count("*").alias("n"), F.round(F.avg("s1"), 6).alias("mean"))


@query("join_hits_meta", knn_sql("TRUE", 10, "query_id, blob_id, kind, size, round(sim, 6) AS sim"))
def _(t):
    hits = S.top_k(t.v_vectors, t.v_queries, 10)
    return hits.join(t.v_vectors.select("blob_id", "kind", "size"), "blob_id").select("query_id", "blob_id", "kind", "size", F.round("sim", 6).alias("sim"))


@query("join_caption", knn_sql("TRUE", 5, "query_id, blob_id, coalesce((SELECT nullif(caption, '') FROM v_captions c WHERE c.blob_id = x.blob_id), '') AS caption").replace(") WHERE rank <= 5", ") x WHERE rank <= 5"))
def _(t):
    hits = S.top_k(t.v_vectors, t.v_queries, 5)
    return hits.join(t.v_captions, "blob_id", "left").select("query_id", "blob_id", F.coalesce(C.present("caption"), F.lit("")).alias("caption"))


@query("semi_hydrate", "SELECT blob_id, size, owner FROM v_blobs WHERE indexed AND blob_id IN (SELECT blob_id FROM v_vectors)")
def _(t):
    return t.v_blobs.where("indexed").join(t.v_vectors, "blob_id", "left_semi").select("blob_id", "size", "owner")


@query("anti_known", "SELECT blob_id FROM v_blobs WHERE NOT indexed AND blob_id NOT IN (SELECT blob_id FROM v_vectors)")
def _(t):
    return t.v_blobs.where("not indexed").join(t.v_vectors, "blob_id", "left_anti").select("blob_id")


@query("anti_blacklist", "SELECT blob_id FROM v_vectors WHERE blob_id NOT IN (SELECT blob_id FROM v_blobs WHERE is_nsfw UNION SELECT blob_id FROM v_blobs WHERE status = 'fetch_failed')")
def _(t):
    black = t.v_blobs.where("is_nsfw").select("blob_id").union(t.v_blobs.where("status = 'fetch_failed'").select("blob_id")).distinct()
    return t.v_vectors.join(black, "blob_id", "left_anti").select("blob_id")


@query("semi_chunked_in", "SELECT blob_id FROM v_blobs WHERE blob_id IN (SELECT blob_id FROM v_batch WHERE seq = 1)")
def _(t):
    return t.v_blobs.join(t.v_batch.where("seq = 1"), "blob_id", "left_semi").select("blob_id")


@query("join_fts", "SELECT b.blob_id, b.size FROM v_blobs b JOIN v_captions c ON b.blob_id = c.blob_id WHERE b.is_active AND b.kind = 'image' AND c.caption LIKE '%and%'")
def _(t):
    match = t.v_captions.where(F.col("caption").contains("and")).select("blob_id")
    return t.v_blobs.where("is_active and kind = 'image'").join(match, "blob_id").select("blob_id", "size")


TERMS = "SELECT CAST(item_id AS VARCHAR) AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1:2]) AS terms FROM benchmark"
BM25 = f"""
asked AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n_terms FROM ({TERMS})),
tok AS (SELECT blob_id, unnest(list_filter(regexp_split_to_array(lower(caption), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM v_captions),
len_ AS (SELECT blob_id, count(*) AS dl FROM tok GROUP BY 1), corpus AS (SELECT count(*) AS nd, (SELECT avg(dl) FROM len_) AS avgdl FROM v_captions),
found AS (SELECT term, blob_id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2), df AS (SELECT term, count(*) AS n FROM found GROUP BY 1),
bm AS (SELECT query_id, blob_id, sum(greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM found JOIN asked USING (term) JOIN df USING (term) JOIN len_ USING (blob_id), corpus GROUP BY query_id, blob_id HAVING count(*) = max(n_terms))
"""


def _terms(t):
    return t.benchmark.select(F.col("item_id").cast("string").alias("query_id"), F.slice(S.tokens("text"), 1, 2).alias("terms"))


def _index(t, captions):
    index = TextIndex(t.spark, new_path(t.spark, "caption-index"))
    index.rebuild(captions)
    return index


@query("bm25_match", f"WITH {BM25} SELECT query_id, blob_id, round(bm25, 6) AS bm25 FROM bm")
def _(t):
    return _index(t, t.v_captions).bm25(_terms(t)).withColumn("bm25", F.round("bm25", 6))


@query("bm25_of_texts", f"WITH {BM25} SELECT query_id, blob_id, round(bm25, 6) AS bm25 FROM bm")
def _(t):
    return S.bm25(t.v_captions, _terms(t)).withColumn("bm25", F.round("bm25", 6))


_ACTIVE = "SELECT blob_id, caption FROM v_captions WHERE blob_id IN (SELECT blob_id FROM v_blobs WHERE is_active)"
_SYNCED = f"SELECT blob_id, caption FROM ({_ACTIVE}) WHERE blob_id NOT IN (SELECT blob_id FROM v_changes) UNION ALL SELECT blob_id, caption FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY seq DESC) AS r FROM v_changes) WHERE r = 1 AND NOT deleted AND caption IS NOT NULL"


def _synced(t, compact):
    # the active captions, then a batch of changes that arrives twice
    index = _index(t, t.v_captions.join(t.v_blobs.where("is_active"), "blob_id", "left_semi"))
    for _ in range(2):
        index.apply(t.v_changes, run=1)
    if compact:
        index.compact()
        index.clean()
    return index


@query("fts_sync", f"WITH tok AS (SELECT blob_id, unnest(list_filter(regexp_split_to_array(lower(caption), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM ({_SYNCED})) SELECT term, CAST(count(DISTINCT blob_id) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS tf FROM tok GROUP BY 1")
def _(t):
    return _synced(t, True).postings().groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


@query("bm25_after_changes", f"WITH {BM25.replace('v_captions', f'({_SYNCED})')} SELECT query_id, blob_id, round(bm25, 6) AS bm25 FROM bm")
def _(t):
    return _synced(t, False).bm25(_terms(t)).withColumn("bm25", F.round("bm25", 6))


_NEAR = f"SELECT query_id, blob_id, rank, sim FROM ({KNN.format(SIMS)}) WHERE rank <= 20"
_SECOND = f"SELECT query_id, blob_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY size, blob_id) AS rank FROM ({SIMS}) WHERE kind = 'video') WHERE rank <= 15"


def _second(t):
    rows = t.v_vectors.where("kind = 'video'").crossJoin(S.small(t.v_queries)).select("query_id", "blob_id", "size")
    return S.ranked(rows, F.col("query_id"), ["size", "blob_id"]).where("rank <= 15")


@query("rrf_fuse", f"SELECT query_id, blob_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (SELECT query_id, blob_id, rank FROM ({_NEAR}) UNION ALL SELECT * FROM ({_SECOND})) GROUP BY 1, 2")
def _(t):
    return S.rrf([S.top_k(t.v_vectors, t.v_queries, 20), _second(t)]).withColumn("rrf", F.round("rrf", 6))


@query("outer_hybrid", f"SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.blob_id, b.blob_id) AS blob_id, round(coalesce(a.sim, 0), 6) AS sim FROM ({_NEAR}) a FULL OUTER JOIN ({_SECOND}) b ON a.query_id = b.query_id AND a.blob_id = b.blob_id")
def _(t):
    near = S.top_k(t.v_vectors, t.v_queries, 20).select("query_id", "blob_id", "sim")
    return near.join(_second(t).select("query_id", "blob_id"), ["query_id", "blob_id"], "full_outer").select("query_id", "blob_id", F.round(F.coalesce("sim", F.lit(0.0)), 6).alias("sim"))


@query("union_ids", f"SELECT query_id, blob_id FROM ({_NEAR}) UNION SELECT query_id, blob_id FROM ({_SECOND})")
def _(t):
    return S.top_k(t.v_vectors, t.v_queries, 20).select("query_id", "blob_id").union(_second(t).select("query_id", "blob_id")).distinct()


@query("fts_floor", f"SELECT query_id, blob_id, round(greatest(sim, 0, 0.20 - 0.005 * rank), 6) AS rank_sim FROM ({_NEAR})")
def _(t):
    near = S.top_k(t.v_vectors, t.v_queries, 20)
    return near.select("query_id", "blob_id", F.round(F.greatest(F.col("sim"), F.lit(0.0), 0.20 - 0.005 * F.col("rank")), 6).alias("rank_sim"))


def _candidates(t, k=30):
    near = S.top_k(t.v_vectors, t.v_queries, k)
    return near.join(t.v_vectors.select("blob_id", "size", "is_nsfw", "parent_quilt_id", "label", "embedding"), "blob_id").withColumn("nsfw_score", F.when(F.col("size") % 3 == 0, F.col("size") % 100).otherwise(0).cast("double"))


_CAND = f"SELECT *, CASE WHEN size % 3 = 0 THEN size % 100 ELSE 0 END AS nsfw_score FROM ({KNN.format(SIMS)}) WHERE rank <= 30"
_DUPE = f"SELECT *, CASE WHEN parent_quilt_id IS NULL THEN 0 ELSE 0.2 * (row_number() OVER (PARTITION BY query_id, parent_quilt_id ORDER BY rank) - 1) END AS dupe FROM ({_CAND})"
_SOFT = f"SELECT *, round(100 * sim * (1 - CASE WHEN nsfw_score > 0 THEN nsfw_score / 100.0 * 0.15 WHEN is_nsfw THEN 0.15 ELSE 0 END - dupe - CASE WHEN size > 0 AND size < 10240 THEN 0.10 ELSE 0 END), 2) AS rerank_score FROM ({_DUPE})"
_FINAL = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 1 THEN rank END NULLS LAST, rerank_score DESC, rank, blob_id) AS final_rank FROM ({_SOFT})"


@query("dupe_penalty", f"SELECT query_id, blob_id, CAST(round(dupe, 6) AS DOUBLE) AS dupe FROM ({_DUPE})")
def _(t):
    return S.duplicate_penalty(_candidates(t), 0.2).select("query_id", "blob_id", F.round("dupe", 6).alias("dupe"))


@query("rerank_soft", f"SELECT query_id, blob_id, rerank_score, CAST(final_rank AS INT) AS final_rank FROM ({_FINAL})")
def _(t):
    return S.rerank_soft(_candidates(t)).select("query_id", "blob_id", "rerank_score", "final_rank")


@query("preserve_top_n", f"SELECT query_id, blob_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 3 THEN rank END NULLS LAST, rerank_score DESC, rank, blob_id) AS INT) AS final_rank FROM ({_SOFT})")
def _(t):
    return S.rerank_soft(_candidates(t), keep=3).select("query_id", "blob_id", "final_rank")


@query("score_reassign", f"WITH f AS (SELECT query_id, blob_id, final_rank, least(greatest(sim, 0) * 450, 100) AS score FROM ({_FINAL})), s AS (SELECT query_id, round(score, 1) AS display, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, blob_id) AS final_rank FROM f) SELECT f.query_id, f.blob_id, s.display FROM f JOIN s ON f.query_id = s.query_id AND f.final_rank = s.final_rank")
def _(t):
    soft = S.rerank_soft(_candidates(t)).withColumn("score", C.score_scale(F.col("sim"), 450))
    return S.reassign_scores(soft).select("query_id", "blob_id", "display")


@query("rerank_mmr")
def _(t):
    return S.mmr(_candidates(t), 10)


@query("rerank_mmr_plain", f"SELECT query_id, blob_id, CAST(rank AS BIGINT) AS mmr_rank FROM ({_CAND}) WHERE rank <= 10")
def _(t):
    return S.mmr(_candidates(t), 10, lam=1.0)


@query("rerank_mmr_tail")
def _(t):
    soft = S.rerank_soft(_candidates(t)).withColumn("sim", F.col("rerank_score") / 100)
    return S.mmr(soft, 10, lam=0.7)


@query("rerank_cluster", f"""
WITH c AS ({_CAND}), m AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(sim), 9) DESC, label) AS cr FROM c GROUP BY query_id, label),
r AS (SELECT c.query_id, c.blob_id, cr, row_number() OVER (PARTITION BY c.query_id, c.label ORDER BY sim DESC, blob_id) AS turn FROM c JOIN m ON c.query_id = m.query_id AND c.label = m.label)
SELECT query_id, blob_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, cr) AS INT) AS final_rank FROM r
""")  # fmt: skip
def _(t):
    return S.rerank_clusters(_candidates(t)).select("query_id", "blob_id", "final_rank")


@query("rerank_cluster_search")
def _(t):
    clustered = S.cluster_candidates(_candidates(t).drop("label"), 10)
    return S.rerank_clusters(clustered, "cluster_id").where("final_rank <= 10").select("query_id", "blob_id", "cluster_id", "cluster_rank", "final_rank")


@query("cross_encoder_rerank", f"""
WITH s AS (SELECT query_id, blob_id, rank, CASE WHEN rank <= 10 THEN tanh(3 * sim) - (size % 100) / 200.0 ELSE -100 END AS second FROM ({KNN.format(SIMS)}) WHERE rank <= 30)
SELECT query_id, blob_id, CAST(rank AS INT) AS rank, round(second, 6) AS second, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(second, 9) DESC, rank) AS INT) AS final_rank FROM s
""")  # fmt: skip
def _(t):
    import numpy as np
    import pyarrow as pa

    # the second scorer looks at the pair's row too, so that its order is another one
    scorer = lambda b: pa.array(np.tanh(b["sim"].to_numpy() * 3) - b["size"].to_numpy() % 100 / 200)
    near = S.top_k(t.v_vectors, t.v_queries, 30).join(t.v_vectors.select("blob_id", "size"), "blob_id")
    scored = S.ranked(S.rescore_top(near, 10, scorer), F.col("query_id"), [F.desc(F.round("second", 9)), "rank"], "final_rank")
    return scored.select("query_id", "blob_id", "rank", F.round("second", 6).alias("second"), "final_rank")


HYBRID = f"""
WITH {BM25}, qs AS (SELECT q.query_id, q.q FROM v_queries q),
pool AS (SELECT * FROM v_vectors WHERE kind = 'image' AND NOT is_nsfw),
near AS (SELECT * FROM (SELECT query_id, blob_id, {DOT.format('embedding', 'q')} AS sim, row_number() OVER (PARTITION BY query_id ORDER BY {DOT.format('embedding', 'q')} DESC, blob_id) AS rank FROM pool, qs) WHERE rank <= 100),
words AS (SELECT query_id, blob_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, blob_id) AS rank FROM bm WHERE blob_id IN (SELECT blob_id FROM pool) AND query_id IN (SELECT query_id FROM qs)),
fused AS (SELECT query_id, blob_id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT query_id, blob_id, rank FROM near UNION ALL SELECT * FROM words) GROUP BY 1, 2),
cand AS (SELECT f.query_id, f.blob_id, rrf, size, parent_quilt_id, greatest(coalesce(n.sim, {DOT.format('p.embedding', 'qs.q')}), CASE WHEN w.rank IS NULL THEN 0 ELSE greatest(0, 0.20 - 0.005 * w.rank) END, 0) AS sim
  FROM fused f LEFT JOIN near n ON f.query_id = n.query_id AND f.blob_id = n.blob_id LEFT JOIN words w ON f.query_id = w.query_id AND f.blob_id = w.blob_id JOIN pool p ON f.blob_id = p.blob_id JOIN qs ON f.query_id = qs.query_id),
ord AS (SELECT *, least(sim * 450, 100) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, blob_id) AS rank FROM cand),
dup AS (SELECT *, CASE WHEN parent_quilt_id IS NULL THEN 0 ELSE 0.2 * (row_number() OVER (PARTITION BY query_id, parent_quilt_id ORDER BY rank) - 1) END AS dupe FROM ord),
soft AS (SELECT *, round(100 * sim * (1 - dupe - CASE WHEN size > 0 AND size < 10240 THEN 0.10 ELSE 0 END), 2) AS rs FROM dup),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 1 THEN rank END NULLS LAST, rs DESC, rank, blob_id) AS final_rank FROM soft) WHERE final_rank <= 5),
sc AS (SELECT query_id, round(score, 1) AS display, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, blob_id) AS final_rank FROM fin)
SELECT fin.query_id, fin.blob_id, CAST(fin.final_rank AS INT) AS final_rank, sc.display, coalesce(nullif(c.caption, ''), '') AS caption FROM fin JOIN sc ON fin.query_id = sc.query_id AND fin.final_rank = sc.final_rank LEFT JOIN v_captions c ON fin.blob_id = c.blob_id
"""


@query("hybrid_search", HYBRID)
def _(t):
    asked = t.v_queries.join(_terms(t), "query_id").select("query_id", "q", "terms")
    return S.hybrid(t.v_vectors, t.v_captions, asked, 5, index=_index(t, t.v_captions))


@query("source_compare", "SELECT blob_id, max(CASE WHEN src = 'a' THEN size END) AS a, max(CASE WHEN src = 'b' THEN size END) AS b FROM (SELECT blob_id, 'a' AS src, size FROM v_old UNION ALL SELECT blob_id, 'b', size FROM v_batch WHERE seq = 0) GROUP BY blob_id")
def _(t):
    both = t.v_old.select("blob_id", F.lit("a").alias("src"), "size").union(t.v_batch.where("seq = 0").select("blob_id", F.lit("b"), "size"))
    return both.groupBy("blob_id").pivot("src", ["a", "b"]).agg(F.max("size"))


_ASOF = "SELECT blob_id, arg_max(code, pass) AS code FROM v_probes GROUP BY blob_id"


@query("anti_broken", f"SELECT query_id, blob_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, blob_id) AS r FROM (SELECT n.query_id, n.blob_id, sim FROM ({_NEAR}) n WHERE n.blob_id NOT IN (SELECT blob_id FROM ({_ASOF}) WHERE code = 404))) WHERE r <= 8")
def _(t):
    latest = t.v_probes.groupBy("blob_id").agg(F.max_by("code", "pass").alias("code")).where("code = 404")
    left = S.top_k(t.v_vectors, t.v_queries, 20).drop("rank").join(latest, "blob_id", "left_anti")
    return S.ranked(left, F.col("query_id"), [F.desc("sim"), "blob_id"]).where("rank <= 8").select("query_id", "blob_id")


@query("known_streak", """
WITH l AS (SELECT blob_id, indexed AS known, row_number() OVER (ORDER BY first_seen_at DESC, blob_id) AS pos FROM v_blobs), g AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS grp FROM l),
s AS (SELECT *, CASE WHEN known THEN row_number() OVER (PARTITION BY grp, known ORDER BY pos) ELSE 0 END AS streak FROM g), cut AS (SELECT coalesce(min(pos), 1000000000) AS at FROM s WHERE streak = 6)
SELECT blob_id FROM s, cut WHERE pos <= cut.at AND NOT known
""")  # fmt: skip
def _(t):
    from blobsearch.operators.listing import until_known_streak

    return until_known_streak(t.v_blobs.select("blob_id", "first_seen_at", F.col("indexed").alias("known")), 6).where("not known").select("blob_id")


@query("resume_after_cursor", "WITH l AS (SELECT blob_id, row_number() OVER (ORDER BY first_seen_at DESC, blob_id) AS pos FROM v_blobs) SELECT blob_id FROM l WHERE pos > (SELECT pos FROM l WHERE blob_id = '97')")
def _(t):
    from blobsearch.operators.listing import after_cursor

    return after_cursor(t.v_blobs.select("blob_id", "first_seen_at"), "97").select("blob_id")


@query("rank_of_truth", f"WITH r AS (SELECT query_id, label, q.truth, row_number() OVER (PARTITION BY query_id ORDER BY {DOT.format('embedding', 'q')} DESC, blob_id) AS rank FROM v_vectors v, v_queries q), f AS (SELECT query_id, min(rank) AS first FROM r WHERE label = truth GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n, median(first) AS median_rank, round(avg(first), 6) AS mean_rank FROM f")
def _(t):
    sims = t.v_vectors.crossJoin(S.small(t.v_queries)).select("query_id", "blob_id", "label", "truth", V.dot("embedding", "q").alias("sim"))
    first = J.first_true_rank(sims, F.col("label") == F.col("truth")).where("first is not null")
    return first.agg(F.count("*").alias("n"), F.median("first").alias("median_rank"), F.round(F.avg("first"), 6).alias("mean_rank"))


@query("dedupe_keep_first", "SELECT owner, min_by(blob_id, CAST(blob_id AS BIGINT)) AS blob_id FROM v_blobs GROUP BY owner")
def _(t):
    return S.ranked(t.v_blobs, F.col("owner"), [F.col("blob_id").cast("long")]).where("rank = 1").select("owner", "blob_id")


@query("softmax_columns", f"WITH s AS ({SIMS}), e AS (SELECT query_id, blob_id, sim, exp(100 * (sim - max(sim) OVER (PARTITION BY blob_id))) AS e FROM s) SELECT query_id, blob_id, round(sim * e / sum(e) OVER (PARTITION BY blob_id), 6) AS score FROM e")
def _(t):
    s = t.v_vectors.crossJoin(S.small(t.v_queries)).select("query_id", "blob_id", V.dot("embedding", "q").alias("sim"))
    w = Window.partitionBy("blob_id")
    e = s.withColumn("e", F.exp(100 * (F.col("sim") - F.max("sim").over(w))))
    return e.select("query_id", "blob_id", F.round(F.col("sim") * F.col("e") / F.sum("e").over(w), 6).alias("score"))


@query("paged_list", "SELECT blob_id, nsfw_score FROM v_blobs WHERE is_nsfw ORDER BY nsfw_score DESC, blob_id LIMIT 20 OFFSET 40")
def _(t):
    return t.v_blobs.where("is_nsfw").orderBy(F.desc("nsfw_score"), "blob_id").offset(40).limit(20).select("blob_id", "nsfw_score")


@query("page_size_sort", "SELECT page, blob_id, CAST(row_number() OVER (PARTITION BY page ORDER BY coalesce(try_cast(raw AS BIGINT), 0) DESC, blob_id) AS INT) AS pos FROM (SELECT CAST(floor(CAST(blob_id AS BIGINT) / 400) AS BIGINT) AS page, blob_id, CASE WHEN CAST(blob_id AS BIGINT) % 5 = 0 THEN 'bad' ELSE CAST(size AS VARCHAR) END AS raw FROM v_blobs)")
def _(t):
    # every page of a listing by itself
    n = F.col("blob_id").cast("long")
    rows = t.v_blobs.select(F.floor(n / 400).alias("page"), "blob_id", F.when(n % 5 == 0, "bad").otherwise(F.col("size").cast("string")).alias("raw"))
    w = Window.partitionBy("page").orderBy(F.desc(F.coalesce(F.expr("try_cast(raw AS BIGINT)"), F.lit(0))), "blob_id")
    return rows.select("page", "blob_id", F.row_number().over(w).alias("pos"))


@query("list_order_active", "SELECT blob_id, is_active, end_epoch FROM v_blobs ORDER BY is_active DESC, end_epoch DESC NULLS LAST, blob_id LIMIT 200")
def _(t):
    return t.v_blobs.orderBy(F.desc("is_active"), F.col("end_epoch").desc_nulls_last(), "blob_id").limit(200).select("blob_id", "is_active", "end_epoch")


@query("pending_quilts", "SELECT blob_id FROM v_blobs WHERE kind = 'quilt' AND is_active AND (status IS NULL OR status NOT IN ('indexed', 'expanded')) ORDER BY blob_id LIMIT 100")
def _(t):
    open_ = F.col("status").isNull() | ~F.col("status").isin("indexed", "expanded")
    return t.v_blobs.where((F.col("kind") == "quilt") & F.col("is_active") & open_).orderBy("blob_id").limit(100).select("blob_id")


_PROTO = f"SELECT blob_id, min(list_distance(CAST(embedding AS DOUBLE[]), CAST(p AS DOUBLE[]))) AS d FROM v_vectors, v_prototypes GROUP BY 1"


@query("bottom_n_forced", f"SELECT blob_id, round(d, 6) AS d FROM ({_PROTO}) ORDER BY round(d, 9), blob_id LIMIT 15")
def _(t):
    d = t.v_vectors.crossJoin(S.small(t.v_prototypes)).groupBy("blob_id").agg(F.min(V.l2_distance("embedding", "p")).alias("d"))
    return d.orderBy(F.round("d", 9), "blob_id").limit(15).select("blob_id", F.round("d", 6).alias("d"))


@query("seeded_sample", "SELECT blob_id FROM v_blobs ORDER BY md5(concat('42', blob_id)), blob_id LIMIT 120")
def _(t):
    return t.v_blobs.orderBy(F.md5(F.concat(F.lit("42"), "blob_id")), "blob_id").limit(120).select("blob_id").orderBy("blob_id")


@query("active_minus_indexed", "SELECT blob_id FROM v_blobs WHERE is_active EXCEPT SELECT blob_id FROM v_blobs WHERE indexed")
def _(t):
    return t.v_blobs.where("is_active").select("blob_id").subtract(t.v_blobs.where("indexed").select("blob_id"))


@query("query_clean", "SELECT item_id, lower(trim(text)) AS q, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.lower(F.trim("text")).alias("q"), S.tokens("text").alias("terms"))


@query("text_normalization", "SELECT blob_id, lower(trim(caption)) AS caption FROM v_captions")
def _(t):
    return t.v_captions.select("blob_id", F.lower(F.trim("caption")).alias("caption"))


@query("dot", f"SELECT v.blob_id, round({DOT.format('v.embedding', 'w.embedding')}, 6) AS dot FROM v_vectors v JOIN v_vectors w ON v.label = CAST(w.blob_id AS BIGINT) - 100")
def _(t):
    w = t.v_vectors.select((F.col("blob_id").cast("long") - 100).alias("label"), F.col("embedding").alias("other"))
    return t.v_vectors.join(w, "label").select("blob_id", V.rounded_number(V.dot("embedding", "other")).alias("dot"))


@query("join_ground_truth", knn_sql("TRUE", 10, "query_id, blob_id, CAST(rank AS INT) AS rank, label = (SELECT truth FROM v_queries q WHERE q.query_id = x.query_id) AS hit").replace(") WHERE rank <= 10", ") x WHERE rank <= 10"))
def _(t):
    hits = S.top_k(t.v_vectors, t.v_queries, 10).join(t.v_vectors.select("blob_id", "label"), "blob_id")
    return hits.join(t.v_queries.select("query_id", "truth"), "query_id").select("query_id", "blob_id", "rank", (F.col("label") == F.col("truth")).alias("hit"))
