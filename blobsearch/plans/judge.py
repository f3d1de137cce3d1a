"""Classification, duplicates, time ranges and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blobsearch.functions import hashing as H
from blobsearch.functions import ranges as R
from blobsearch.functions import vectors as V
from blobsearch.operators import intervals as I
from blobsearch.operators import judge as J
from blobsearch.operators import search as S

from .registry import query
from .search import _CENTROID, DOT, KNN

_PROTO = f"SELECT blob_id, least(greatest(max({DOT.format('embedding', 'p')}), 0) * 300, 100) AS score FROM v_vectors, v_prototypes GROUP BY blob_id"


@query("nsfw_score", f"SELECT blob_id, round(score, 6) AS nsfw_score, score > 85 AS flagged FROM ({_PROTO})")
def _(t):
    return J.prototype_score(t.v_vectors, t.v_prototypes, 300).withColumn("nsfw_score", F.round("nsfw_score", 6))


@query("nsfw_rescore", f"SELECT p.blob_id, round(score, 6) AS new_score, score > 85 AS new_flag FROM ({_PROTO}) p JOIN v_vectors v ON p.blob_id = v.blob_id WHERE v.is_nsfw <> (score > 85) OR CAST(v.blob_id AS BIGINT) % 5 = 0 OR abs(score - v.size % 101) > 1e-5")
def _(t):
    stored = t.v_vectors.select("blob_id", "is_nsfw", F.when(F.col("blob_id").cast("long") % 5 != 0, (F.col("size") % 101).cast("double")).alias("nsfw_score"))
    return J.rescored(stored, J.prototype_score(t.v_vectors, t.v_prototypes, 300)).withColumn("new_score", F.round("new_score", 6))


@query("vlm_label_score", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 98.0::DOUBLE WHEN doc_id % 4 = 1 THEN 0.0::DOUBLE WHEN doc_id % 4 = 2 THEN 92.0::DOUBLE END AS score, coalesce(doc_id % 4 IN (0, 2), FALSE) AS flagged FROM documents")
def _(t):
    said = F.element_at(F.array(*map(F.lit, ("It is explicit, not safe", "safe.", "GORE", "unsure"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = t.documents.select("doc_id", J.label_score(said).alias("score"))
    return rows.select("doc_id", "score", (F.coalesce("score", F.lit(0.0)) >= 80).alias("flagged"))


_NEAREST = _CENTROID + f""", s AS (SELECT blob_id, c.label AS anchor, {DOT.format('embedding', 'c.c')} AS s, row_number() OVER (PARTITION BY blob_id ORDER BY {DOT.format('embedding', 'c.c')} DESC, c.label) AS r FROM v_vectors v, cen c),
n AS (SELECT a.blob_id, a.anchor AS best, b.anchor AS second, a.s AS s1, b.s AS s2 FROM s a JOIN s b ON a.blob_id = b.blob_id AND a.r = 1 AND b.r = 2) """


def _nearest(t):
    anchors = V.centroid(t.v_vectors, "label", "embedding").select(F.col("label").alias("anchor_id"), F.col("centroid").alias("a"))
    return J.nearest_anchors(t.v_vectors.select("blob_id", "embedding"), anchors)


@query("nearest_anchor", _NEAREST + "SELECT CASE WHEN v.is_nsfw THEN 'nsfw' WHEN best < 6 THEN CAST(best AS VARCHAR) ELSE 'other' END AS category, CAST(count(*) AS BIGINT) AS n FROM n JOIN v_vectors v ON n.blob_id = v.blob_id GROUP BY 1")
def _(t):
    rows = _nearest(t).join(t.v_vectors.select("blob_id", "is_nsfw"), "blob_id")
    category = F.when(F.col("is_nsfw"), "nsfw").when(F.col("best") < 6, F.col("best").cast("string")).otherwise("other")
    return rows.groupBy(category.alias("category")).agg(F.count("*").alias("n"))


_TIER = "CASE WHEN round(s1, 9) >= 0.42 AND round(s1 - s2, 9) >= 0.02 THEN 'high' WHEN round(s1, 9) >= 0.36 AND round(s1 - s2, 9) >= 0.008 THEN 'low' ELSE 'uncertain' END"


def _tiered(t):
    s1, margin = F.round("s1", 9), F.round(F.col("s1") - F.col("s2"), 9)
    return _nearest(t).withColumn("tier", J.tier(s1, margin, high=0.42, low=0.36)).withColumn("margin", margin)


_SEM = "(SELECT * FROM s WHERE anchor NOT IN (0, 1))"
_DASH = _CENTROID + f""", img AS (SELECT * FROM v_vectors WHERE kind = 'image'), s AS (SELECT blob_id, c.label AS anchor, round({DOT.format('embedding', 'c.c')}, 9) AS s FROM img v, cen c),
r AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY s DESC, anchor) AS r FROM {_SEM}), n AS (SELECT a.blob_id, a.anchor AS best, a.s AS s1, round(a.s - b.s, 9) AS m FROM r a JOIN r b ON a.blob_id = b.blob_id AND a.r = 1 AND b.r = 2),
x AS (SELECT n.*, p.score > 85 AS tag, sem.s AS sem FROM n JOIN ({_PROTO}) p USING (blob_id) JOIN (SELECT blob_id, max(s) AS s FROM s WHERE anchor IN (0, 1) GROUP BY 1) sem USING (blob_id)),
k AS (SELECT *, CASE WHEN s1 >= {{0}} AND m >= 0.02 THEN 'high' WHEN s1 >= {{1}} AND m >= 0.008 THEN 'low' ELSE 'uncertain' END AS tier, CASE WHEN tag THEN 'high' WHEN sem >= {{2}} THEN 'low' END AS bad FROM x)
SELECT key, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(list_concat(CASE WHEN tier = 'uncertain' THEN ['uncertain'] ELSE [CAST(best AS VARCHAR), concat(CAST(best AS VARCHAR), ':', tier)] END, CASE WHEN bad IS NULL THEN [] ELSE ['nsfw', concat('nsfw:', bad)] END)) AS key FROM k) GROUP BY 1
"""  # fmt: skip


def _dashboard(t, **thresholds):
    anchors = V.centroid(t.v_vectors, "label", "embedding").select(F.col("label").cast("string").alias("anchor_id"), F.col("centroid").alias("a"))
    return J.dashboard(t.v_vectors.where("kind = 'image'"), anchors, t.v_prototypes, ("0", "1"), **thresholds)


@query("classify_dashboard", _DASH.format("0.62", "0.56", "0.62"))
def _(t):
    return _dashboard(t)


@query("classify_dashboard_loose", _DASH.format("0.42", "0.36", "0.3"))
def _(t):
    return _dashboard(t, high=0.42, low=0.36, semantic=0.3)


@query("tiered_classify", _NEAREST + f"SELECT blob_id, best, {_TIER} AS tier, round(round(s1 - s2, 9), 6) AS margin FROM n")
def _(t):
    return _tiered(t).select("blob_id", "best", "tier", F.round("margin", 6).alias("margin"))


@query("classifier_rebuild", _NEAREST + f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (best <> v.label OR ({_TIER}) <> 'high') AS BIGINT) AS changed FROM n JOIN v_vectors v ON n.blob_id = v.blob_id")
def _(t):
    rows = _tiered(t).join(t.v_vectors.select("blob_id", "label"), "blob_id")
    return rows.agg(F.count("*").alias("n"), F.count_if((F.col("best") != F.col("label")) | (F.col("tier") != "high")).alias("changed"))


@query("nft_probability", f"WITH s AS (SELECT blob_id, max(CASE WHEN proto_id = '10' THEN {DOT.format('embedding', 'p')} END) AS a, max(CASE WHEN proto_id = '11' THEN {DOT.format('embedding', 'p')} END) AS b FROM v_vectors, v_prototypes GROUP BY 1) SELECT blob_id, round(1 / (1 + exp(100 * (b - a))), 6) AS p FROM s")
def _(t):
    two = t.v_vectors.crossJoin(S.small(t.v_prototypes.where("proto_id in ('10', '11')"))).withColumn("s", V.dot("embedding", "p"))
    of = lambda i: F.max(F.when(F.col("proto_id") == i, F.col("s")))
    return two.groupBy("blob_id").agg(of("10").alias("a"), of("11").alias("b")).select("blob_id", F.round(J.two_anchor_probability(F.col("a"), F.col("b")), 6).alias("p"))


@query("category_counts_meta", "SELECT c AS category, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([kind, source]) AS c FROM v_blobs) WHERE c IS NOT NULL GROUP BY 1")
def _(t):
    return t.v_blobs.select(F.explode(F.array("kind", "source")).alias("category")).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@query("atlas_projection", _NEAREST + "SELECT best, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (round(s1 - s2, 9) < 0.05) AS BIGINT) AS border, round(quantile_cont(1 - s1, 0.5), 6) AS p50, round(quantile_cont(1 - s1, 0.9), 6) AS p90, round(avg(s1 - s2), 6) AS margin FROM n GROUP BY 1")
def _(t):
    rows = _nearest(t).withColumn("margin", F.round(F.col("s1") - F.col("s2"), 9)).withColumn("d", 1 - F.col("s1"))
    return rows.groupBy("best").agg(F.count("*").alias("n"), F.count_if(F.col("margin") < 0.05).alias("border"), F.round(F.percentile("d", 0.5), 6).alias("p50"), F.round(F.percentile("d", 0.9), 6).alias("p90"), F.round(F.avg(F.col("s1") - F.col("s2")), 6).alias("margin"))


@query("percentiles", "SELECT kind, round(quantile_cont(size, 0.5), 4) AS p50, round(quantile_cont(size, 0.9), 4) AS p90, round(avg(CASE WHEN nsfw_score < 20 THEN 1.0 ELSE 0.0 END), 6) AS border FROM v_blobs WHERE kind IS NOT NULL GROUP BY kind")
def _(t):
    p = F.percentile("size", F.array(F.lit(0.5), F.lit(0.9)))
    rows = t.v_blobs.where("kind is not null").groupBy("kind").agg(p.alias("p"), F.avg(F.when(F.col("nsfw_score") < 20, 1.0).otherwise(0.0)).alias("border"))
    return rows.select("kind", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p90"), F.round("border", 6).alias("border"))


@query("latency_stats", "SELECT upstream, CAST(count(*) AS BIGINT) AS calls, round(count(*) / sum(latency_secs), 6) AS per_sec, round(1000 * avg(latency_secs), 4) AS ms, round(min(latency_secs), 6) AS low, round(quantile_cont(latency_secs, 0.5), 6) AS p50, round(quantile_cont(latency_secs, 0.95), 6) AS p95, round(max(latency_secs), 6) AS high FROM v_events GROUP BY 1")
def _(t):
    x = "latency_secs"
    return t.v_events.groupBy("upstream").agg(
        F.count("*").alias("calls"), F.round(F.count("*") / F.sum(x), 6).alias("per_sec"), F.round(1000 * F.avg(x), 4).alias("ms"), F.round(F.min(x), 6).alias("low"),
        F.round(F.percentile(x, 0.5), 6).alias("p50"), F.round(F.percentile(x, 0.95), 6).alias("p95"), F.round(F.max(x), 6).alias("high"),
    )


@query("quadrant_stats", "WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM v_vectors) SELECT CAST(count(*) FILTER (x >= 0 AND y >= 0) AS BIGINT) AS q1, CAST(count(*) FILTER (x < 0 AND y >= 0) AS BIGINT) AS q2, round(quantile_cont(sqrt(x * x + y * y), 0.5), 6) AS median_radius, round(quantile_cont(sqrt(x * x + y * y), 0.95), 6) AS p95, round(corr(x, y), 6) AS corr FROM p")
def _(t):
    p = t.v_vectors.select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return p.agg(F.count_if((F.col("x") >= 0) & (F.col("y") >= 0)).alias("q1"), F.count_if((F.col("x") < 0) & (F.col("y") >= 0)).alias("q2"), F.round(F.percentile(r, 0.5), 6).alias("median_radius"), F.round(F.percentile(r, 0.95), 6).alias("p95"), F.round(F.corr("x", "y"), 6).alias("corr"))


_REPS = "reps AS (SELECT h, min(blob_id) AS rep, count(*) AS copies FROM v_hashes GROUP BY h), near AS (SELECT x.h AS ha, y.h AS hb, x.rep AS ra, y.rep AS rb, y.copies FROM reps x JOIN reps y ON x.h <> y.h AND bit_count(xor(x.h, y.h)) <= 6)"


@query("hash_dup_join", f"WITH {_REPS} SELECT ra AS a, rb AS b, CAST(bit_count(xor(ha, hb)) AS INT) AS distance FROM near WHERE ra < rb UNION ALL SELECT rep, blob_id, 0 FROM v_hashes JOIN reps USING (h) WHERE blob_id <> rep")
def _(t):
    return H.near_pairs(t.v_hashes)


@query("hash_dup_classes", f"""
WITH RECURSIVE {_REPS}, reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT reach.a, near.rb FROM reach JOIN near ON reach.b = near.ra),
cls AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a), links AS (SELECT ra AS rep, count(*) AS links FROM near GROUP BY ra)
SELECT blob_id, class_id, CAST(copies AS BIGINT) AS copies, CAST(coalesce(links, 0) AS BIGINT) AS links FROM v_hashes JOIN reps USING (h) JOIN cls USING (rep) LEFT JOIN links USING (rep)
""")  # fmt: skip
def _(t):
    return J.duplicate_classes(t.v_hashes)


@query("hamming", "SELECT x.blob_id, CAST(bit_count(xor(x.h, y.h)) AS INT) AS d FROM v_hashes x JOIN v_hashes y ON y.blob_id = concat('dup', x.blob_id)")
def _(t):
    y = t.v_hashes.select(F.col("blob_id").alias("other"), F.col("h").alias("g"))
    return t.v_hashes.join(y, F.col("other") == F.concat(F.lit("dup"), "blob_id")).select("blob_id", H.hamming("h", "g").alias("d"))


def _dups(t):
    y = t.v_hashes.select(F.col("blob_id").alias("other"), F.col("h").alias("g"))
    pairs = t.v_hashes.where("blob_id not like 'dup%'").join(y, F.col("other") == F.concat(F.lit("dup"), "blob_id"), "left")
    return pairs.select("blob_id", H.duplicate_class(H.hamming("h", "g")).alias("class"))


_CLASS = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} <= 0 THEN 'exact_duplicate' WHEN {0} <= 6 THEN 'near_duplicate' ELSE 'similar' END"
_DUPS = f"SELECT x.blob_id, {_CLASS.format('bit_count(xor(x.h, y.h))')} AS class FROM v_hashes x LEFT JOIN v_hashes y ON y.blob_id = concat('dup', x.blob_id) WHERE x.blob_id NOT LIKE 'dup%'"


@query("dup_class", _DUPS)
def _(t):
    return _dups(t)


_GRID = "SELECT vec_id, embedding, list_transform(range(0, 72), lambda i: CAST(floor(abs(embedding[(i % 64) + 1]) * 1000) AS INT)) AS px FROM embeddings"
_BITS = "list_transform(list_filter(range(1, 72), lambda i: i % 9 > 0), lambda i: CASE WHEN px[i + 1] > px[i] THEN 1 ELSE 0 END)"
_HALF = f"list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform({_BITS}[{{0}}], lambda x: CAST(x AS BIGINT))), lambda a, b: a * 2 + b)"


def _grid(t):
    # multiplied in the components' own single precision, as the SQL does it: in double, products that round up to a whole number stay below it
    px = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(F.abs(F.element_at("embedding", (i % 64 + 1).cast("int"))) * F.lit(1000.0).cast("float")).cast("int"))
    return t.embeddings.select("vec_id", "embedding", px.alias("px"))


@query("dhash", f"SELECT vec_id, printf('%08X%08X', {_HALF.format('1:32')}, {_HALF.format('33:64')}) AS h FROM ({_GRID})")
def _(t):
    return _grid(t).select("vec_id", F.lpad(F.hex(H.dhash("px")), 16, "0").alias("h"))


@query("phash_dct")
def _(t):
    px = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.element_at("embedding", (i * 7 % 64 + 1).cast("int")).cast("double"))
    return t.embeddings.select("vec_id", H.phash_dct(px).alias("h"))


# the query images: rows 30 to 39 of the catalog, of image k the first 3 k pixels black
_QIMG = f"SELECT CAST(vec_id - 30 AS VARCHAR) AS query_id, embedding AS own, list_transform(range(0, 72), lambda i: CASE WHEN i < 3 * (vec_id - 30) THEN 0 ELSE px[i + 1] END) AS px FROM ({_GRID}) WHERE vec_id BETWEEN 30 AND 39"
_HASH = f"CAST(array_to_string({_BITS}, '') AS BIT)"


def _query_images(t):
    k = F.col("vec_id") - 30
    px = F.transform("px", lambda x, i: F.when(i < 3 * k, 0).otherwise(x))
    return _grid(t).where("vec_id between 30 and 39").select(k.cast("string").alias("query_id"), F.col("embedding").alias("own"), H.dhash(px).alias("g"))


def _prov_sql(q: str) -> str:
    """q: what the query image's candidates are searched by."""
    near = KNN.format(f"SELECT x.query_id, x.g, blob_id, {DOT.format('v.embedding', 'x.q')} AS sim FROM v_vectors v, x")
    c = f"SELECT *, {_CLASS.format('distance')} AS class FROM (SELECT n.query_id, blob_id, rank, bit_count(xor(n.g, i.h)) AS distance FROM ({near}) n JOIN i USING (blob_id) WHERE rank <= 12)"
    best = "SELECT query_id, blob_id, class FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY class <> 'exact_duplicate', rank) AS r FROM c WHERE class IN ('exact_duplicate', 'near_duplicate')) WHERE r = 1"
    x = f"x AS (SELECT m.query_id, {_HASH} AS g, {q} AS q FROM ({_QIMG}) m JOIN v_queries c ON c.query_id = m.query_id), i AS (SELECT CAST(vec_id AS VARCHAR) AS blob_id, {_HASH} AS h FROM ({_GRID}))"
    return f"WITH {x}, c AS ({c}) SELECT t.query_id, b.blob_id, b.class, t.n_exact, t.n_near FROM (SELECT query_id, CAST(count(*) FILTER (class = 'exact_duplicate') AS BIGINT) AS n_exact, CAST(count(*) FILTER (class = 'near_duplicate') AS BIGINT) AS n_near FROM c GROUP BY 1) t LEFT JOIN ({best}) b ON t.query_id = b.query_id"


def _told(t, images):
    """Provenance of query images (query_id, q, g) by the hashes of their candidates' grids."""
    near = S.top_k(t.v_vectors, images.select("query_id", "q"), 30).select("query_id", "blob_id", "rank")
    hashes = _grid(t).select(F.col("vec_id").cast("string").alias("blob_id"), H.dhash("px").alias("h"))
    rows = hashes.join(S.small(near), "blob_id").join(S.small(images.select("query_id", "g")), "query_id")
    return J.provenance(rows.select("query_id", "blob_id", "rank", H.hamming("g", "h").alias("distance")))


@query("provenance", _prov_sql("CAST(m.own AS DOUBLE[])"))
def _(t):
    return _told(t, _query_images(t).select("query_id", F.col("own").alias("q"), "g"))


@query("reverse_image", _prov_sql("list_transform(list_zip(CAST(m.own AS DOUBLE[]), CAST(c.q AS DOUBLE[])), lambda p: p[1] * 0.8 + p[2] * 0.2)"))
def _(t):
    # the caption's vector of image k is that of query k; the order of candidates is the same before and after normalising
    images = _query_images(t).join(t.v_queries.select("query_id", F.col("q").alias("cap")), "query_id")
    return _told(t, images.select("query_id", V.blend("own", "cap", 0.2).alias("q"), "g"))


@query("dup_accuracy", f"""
WITH d AS ({_DUPS.replace('SELECT x.blob_id,', 'SELECT x.blob_id, x.h,')}), f AS (SELECT blob_id, EXISTS (SELECT 1 FROM v_hashes y WHERE y.blob_id <> d.blob_id AND y.blob_id <> concat('dup', d.blob_id) AND bit_count(xor(y.h, d.h)) <= 6) AS fp FROM d)
SELECT round(avg(CASE WHEN class = 'exact_duplicate' THEN 1.0 ELSE 0.0 END) FILTER (class <> 'unknown'), 6) AS exact, round(avg(CASE WHEN class = 'near_duplicate' THEN 1.0 ELSE 0.0 END) FILTER (class <> 'unknown'), 6) AS near,
  round(avg(CASE WHEN fp THEN 1.0 ELSE 0.0 END), 6) AS false_positive FROM d JOIN f USING (blob_id)
""")  # fmt: skip
def _(t):
    originals = t.v_hashes.where("blob_id not like 'dup%'")
    return J.duplicate_accuracy(t.v_hashes, originals.select("blob_id", F.concat(F.lit("dup"), "blob_id").alias("copy")))


@query("recency_boost", "SELECT event_id, round(CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) < 86400 THEN 0.05 * (1 - greatest(0, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts))) / 3600.0 / 24) ELSE 0 END, 6) AS boost FROM v_events")
def _(t):
    return t.v_events.select("event_id", F.round(R.recency_boost(F.col("ts").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp")), 6).alias("boost"))


_WIN = "SELECT blob_id, duration, CAST(n * {s} AS DOUBLE) AS s, least(duration, n * {s} + {w}) AS e FROM (SELECT blob_id, duration, unnest(range(0, CASE WHEN duration <= {w} THEN 1 ELSE CAST(ceil((duration - {w}) / {s}) AS BIGINT) + 1 END)) AS n FROM v_clips)"


@query("slide_windows", f"SELECT blob_id, s AS \"start\", e AS \"end\" FROM ({_WIN.format(w='4.0', s='2.0')})")
def _(t):
    return t.v_clips.select("blob_id", F.explode(R.slide_windows("duration")).alias("w")).select("blob_id", "w.start", "w.end")


@query("multiscale_windows_dedup", " UNION ".join(f"SELECT blob_id, s AS \"start\", e AS \"end\" FROM ({_WIN.format(w=w, s=w / 2)})" for w in (4.0, 8.0, 16.0)))
def _(t):
    return t.v_clips.select("blob_id", F.explode(R.multiscale_windows("duration")).alias("w")).select("blob_id", "w.start", "w.end")


_IOU = "greatest(0, least(e, g1) - greatest(s, g0)) / ((e - s) + (g1 - g0) - greatest(0, least(e, g1) - greatest(s, g0)))"


@query("interval_iou_join", f"SELECT x.blob_id, truth_id, s, e, round({_IOU}, 6) AS iou FROM v_segments x JOIN v_truths y ON x.blob_id = y.blob_id AND s < g1 AND g0 < e")
def _(t):
    both = I.iou_join(t.v_segments.select("blob_id", "s", "e"), t.v_truths.select("blob_id", "truth_id", "g0", "g1"))
    return both.select("blob_id", "truth_id", "s", "e", F.round("iou", 6).alias("iou"))


_SEGSIM = f"SELECT query_id, blob_id, s, e, {DOT.format('embedding', 'q')} AS sim, row_number() OVER (PARTITION BY query_id, blob_id ORDER BY round({DOT.format('embedding', 'q')}, 9) DESC, s) AS r FROM v_segments, v_queries"


def _scored_segments(t):
    rows = t.v_segments.crossJoin(S.small(t.v_queries.select("query_id", "q"))).select("query_id", "blob_id", "s", "e", V.dot("embedding", "q").alias("sim"))
    w = Window.partitionBy("query_id", "blob_id").orderBy(F.desc(F.round("sim", 9)), "s")
    return rows.withColumn("r", F.row_number().over(w))


@query("in_video_search", f"SELECT query_id, blob_id, s, e, round((round(sim, 9) + 1) * 50, 2) AS score FROM ({_SEGSIM}) WHERE r <= 3")
def _(t):
    return _scored_segments(t).where("r <= 3").select("query_id", "blob_id", "s", "e", F.round((F.round("sim", 9) + 1) * 50, 2).alias("score"))


@query("moment_recall", f"SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN iou >= 0.3 THEN 1.0 ELSE 0 END), 6) AS r3, round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN iou >= 0.7 THEN 1.0 ELSE 0 END), 6) AS r7, round(avg(iou), 6) AS miou FROM (SELECT {_IOU} AS iou FROM ({_SEGSIM}) x JOIN v_truths y ON x.blob_id = y.blob_id AND x.query_id = y.query_id WHERE r = 1)")
def _(t):
    # the best segment of each query and video against every true span of that query in it
    best = _scored_segments(t).where("r = 1").drop("r")
    rows = t.v_truths.join(S.small(best), ["query_id", "blob_id"]).select(R.interval_iou(F.col("s"), F.col("e"), F.col("g0"), F.col("g1")).alias("iou"))
    at = lambda x: F.round(F.avg(F.when(F.col("iou") >= x, 1.0).otherwise(0.0)), 6)
    return rows.agg(F.count("*").alias("n"), at(0.3).alias("r3"), at(0.5).alias("r5"), at(0.7).alias("r7"), F.round(F.avg("iou"), 6).alias("miou"))


@query("span_hit_rate", "WITH p AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e, length(text) AS d, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN total * 0.4 BETWEEN e - d AND e THEN 1.0 ELSE 0.0 END), 6) AS hit FROM p WHERE turn = 1")
def _(t):
    rows = J.spans(t.conversations.select("conv_id", "turn", F.length("text").alias("d")), "conv_id", "turn", "d")
    rows = rows.withColumn("total", F.sum("d").over(Window.partitionBy("conv_id")))
    mid = F.col("total") * 0.4
    return rows.where("turn = 1").agg(F.count("*").alias("n"), F.round(F.avg(F.when((mid >= F.col("start")) & (mid <= F.col("end")), 1.0).otherwise(0.0)), 6).alias("hit"))


def _ranks_sql(true: str) -> str:
    return f"SELECT query_id, min(CASE WHEN {true} THEN rank END) AS first FROM (SELECT query_id, label, truth, blob_id, row_number() OVER (PARTITION BY query_id ORDER BY {DOT.format('embedding', 'q')} DESC, blob_id) AS rank FROM v_vectors, v_queries) GROUP BY 1"


def _recalls(*ks: int) -> str:
    return "CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in ks)


def _query_sims(t):
    return t.v_vectors.crossJoin(S.small(t.v_queries)).select("query_id", "blob_id", "label", "truth", V.dot("embedding", "q").alias("sim"))


@query("recall_t2i", f"SELECT {_recalls(1, 5, 10)} FROM ({_ranks_sql('label = truth')})")
def _(t):
    return J.recall_at(J.first_true_rank(_query_sims(t), F.col("label") == F.col("truth")), (1, 5, 10))


@query("recall_i2t", f"SELECT {_recalls(1, 5, 10)} FROM (SELECT truth AS image, min(first) AS first FROM ({_ranks_sql('label = truth')}) r JOIN v_queries q ON r.query_id = q.query_id GROUP BY 1)")
def _(t):
    first = J.first_true_rank(_query_sims(t), F.col("label") == F.col("truth")).join(t.v_queries.select("query_id", "truth"), "query_id")
    return J.recall_at(first.groupBy("truth").agg(F.min("first").alias("first")), (1, 5, 10))


@query("gate", f"SELECT recall_10 >= 0.5 AS passed FROM (SELECT {_recalls(10)} FROM ({_ranks_sql('label = truth')}))")
def _(t):
    return J.recall_at(J.first_true_rank(_query_sims(t), F.col("label") == F.col("truth")), (10,)).select((F.col("recall_10") >= 0.5).alias("passed"))


_NEG = f"SELECT query_id, blob_id, label, truth, sim, row_number() OVER (PARTITION BY query_id, label = truth ORDER BY md5(concat(query_id, '-', blob_id)), blob_id) AS pick FROM (SELECT query_id, blob_id, label, truth, {DOT.format('embedding', 'q')} AS sim FROM v_vectors, v_queries)"


@query("recall_local_neg", f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, blob_id) AS rank FROM ({_NEG}) WHERE (label = truth AND pick = 1) OR (label <> truth AND pick <= 20)) SELECT {_recalls(1, 5)} FROM (SELECT query_id, min(CASE WHEN label = truth THEN rank END) AS first FROM p GROUP BY 1)")
def _(t):
    true = F.col("label") == F.col("truth")
    w = Window.partitionBy("query_id", true).orderBy(F.md5(F.concat("query_id", F.lit("-"), "blob_id")), "blob_id")
    pool = _query_sims(t).withColumn("pick", F.row_number().over(w)).where((true & (F.col("pick") == 1)) | (~true & (F.col("pick") <= 20)))
    return J.recall_at(J.first_true_rank(pool, true), (1, 5))


@query("sanity_gap", f"SELECT round(avg(CASE WHEN label = truth THEN s END), 6) AS positive, round(avg(CASE WHEN label = (truth + 1) % 10 THEN s END), 6) AS negative FROM (SELECT label, truth, {DOT.format('embedding', 'q')} AS s FROM v_vectors, v_queries)")
def _(t):
    mean = lambda c: F.round(F.avg(F.when(c, F.col("sim"))), 6)
    return _query_sims(t).agg(mean(F.col("label") == F.col("truth")).alias("positive"), mean(F.col("label") == (F.col("truth") + 1) % 10).alias("negative"))


@query("zero_shot_accuracy", f"WITH a AS (SELECT x AS cls, x % 2 AS template, anchor_id, a FROM v_anchors), s AS (SELECT blob_id, label, template, cls, row_number() OVER (PARTITION BY blob_id, template ORDER BY {DOT.format('embedding', 'a')} DESC, anchor_id) AS r FROM v_vectors, a) SELECT template, round(avg(CASE WHEN cls = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s WHERE r = 1 GROUP BY template")
def _(t):
    a = t.v_anchors.select(F.col("x").alias("cls"), (F.col("x") % 2).alias("template"), "anchor_id", "a")
    s = t.v_vectors.crossJoin(S.small(a)).select("blob_id", "label", "template", "cls", "anchor_id", V.dot("embedding", "a").alias("s"))
    best = s.groupBy("blob_id", "label", "template").agg(F.max_by("cls", F.struct("s", "anchor_id")).alias("cls"))
    return best.groupBy("template").agg(F.round(F.avg(F.when(F.col("cls") == F.col("label"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("keyword_precision", "SELECT query_id, round(avg(CASE WHEN regexp_matches(caption, 'the|and') THEN 1.0 ELSE 0.0 END), 6) AS p FROM (SELECT query_id, blob_id FROM (SELECT query_id, blob_id, row_number() OVER (PARTITION BY query_id ORDER BY " + DOT.format("embedding", "q") + " DESC, blob_id) AS r FROM v_vectors, v_queries) WHERE r <= 10) JOIN v_captions USING (blob_id) GROUP BY 1")
def _(t):
    hits = S.top_k(t.v_vectors, t.v_queries, 10).join(t.v_captions, "blob_id")
    return hits.groupBy("query_id").agg(F.round(F.avg(F.when(F.col("caption").rlike("the|and"), 1.0).otherwise(0.0)), 6).alias("p"))


@query("recall_i2i", f"WITH q AS (SELECT blob_id AS query_id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), lambda p: p[1] + 0.3 * p[2]) AS q FROM v_vectors), r AS (SELECT query_id, blob_id, row_number() OVER (PARTITION BY query_id ORDER BY round({DOT.format('embedding', 'q')}, 9) DESC, blob_id) AS rank FROM v_vectors, q) SELECT {_recalls(1, 5)} FROM (SELECT query_id, min(CASE WHEN query_id = blob_id THEN rank END) AS first FROM r GROUP BY 1)")
def _(t):
    e = V.doubles("embedding")
    q = t.v_vectors.select(F.col("blob_id").alias("query_id"), F.zip_with(e, F.reverse(e), lambda a, b: a + 0.3 * b).alias("q"), "embedding")
    return J.recall_at(S.rank_of_own(t.v_vectors, q.withColumn("own", V.dot("embedding", "q")), 64), (1, 5))


@query("pca_2d")
def _(t):
    from blobsearch.operators.learned import pca_2d

    return pca_2d(t.v_vectors)


@query("kmeans")
def _(t):
    from blobsearch.operators.learned import kmeans

    return kmeans(t.v_vectors)


@query("residual_adapter")
def _(t):
    import numpy as np

    from blobsearch.operators.learned import residual_adapter

    r = np.random.default_rng(1)
    return residual_adapter(t.v_vectors, 0.1 * r.standard_normal((64, 64)), 0.05 * r.standard_normal(64))


@query("embed_text_hash", """
WITH tok AS (SELECT blob_id, unnest(list_filter(regexp_split_to_array(lower(caption), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM v_captions),
c AS (SELECT blob_id, CAST(concat('0x', substr(md5(t), 1, 8)) AS BIGINT) % 64 AS i, count(*) AS n FROM tok GROUP BY 1, 2), l AS (SELECT blob_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1)
SELECT blob_id, CAST(i AS INT) AS i, round(n / norm, 6) AS x FROM c JOIN l USING (blob_id)
""")  # fmt: skip
def _(t):
    from blobsearch.functions.encode import hashed_vectors

    v = hashed_vectors(t.v_captions, "blob_id", "caption", 64)
    return v.select("blob_id", F.posexplode("embedding").alias("i", "x")).where("x <> 0").select("blob_id", "i", F.round("x", 6).alias("x"))


@query("interval_iou", "SELECT p_partkey, round(greatest(0, least(p_size, 30) - greatest(p_size % 7, 5)) / nullif((p_size - p_size % 7) + (30 - 5) - greatest(0, least(p_size, 30) - greatest(p_size % 7, 5)), 0)::DOUBLE, 6) AS iou FROM part")
def _(t):
    size = F.col("p_size").cast("double")
    return t.part.select("p_partkey", F.round(R.interval_iou(size % 7, size, F.lit(5.0), F.lit(30.0)), 6).alias("iou"))
