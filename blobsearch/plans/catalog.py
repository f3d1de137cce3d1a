"""Catalog queries: rows, upserts, updates, counts, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from blobsearch.operators import catalog as C

from .registry import query

EPOCH = 30


def _upsert_sql(old: str, new: str, keys: list[str], rules: dict[str, str], has_old: set[str] | None = None) -> str:
    """A full outer join written for the oracle."""
    a = lambda c: f"o.{c}" if has_old is None or c in has_old else "NULL"
    value = {
        "coalesce": lambda c: f"coalesce(n.{c}, {a(c)})", "keep": lambda c: f"coalesce({a(c)}, n.{c})",
        "overwrite": lambda c: f"CASE WHEN n.{keys[0]} IS NOT NULL THEN n.{c} ELSE {a(c)} END",
        "positive": lambda c: f"CASE WHEN n.{c} IS NULL OR n.{c} = 0 THEN {a(c)} ELSE n.{c} END",
        "greatest": lambda c: f"CASE WHEN {a(c)} IS NULL THEN n.{c} WHEN n.{c} IS NULL THEN {a(c)} ELSE {a(c)} OR n.{c} END",
        "unless_indexed": lambda c: f"CASE WHEN n.{keys[0]} IS NULL OR coalesce(o.indexed, FALSE) THEN {a(c)} ELSE n.{c} END",
    }
    cols = ", ".join([f"coalesce(o.{k}, n.{k}) AS {k}" for k in keys] + [f"{value[r](c)} AS {c}" for c, r in rules.items()])
    on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    return f"SELECT {cols} FROM ({old}) o FULL OUTER JOIN ({new}) n ON {on}"


LAST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY seq DESC) AS rn FROM v_batch) WHERE rn = 1"
FULL = {"end_epoch": "coalesce", "size": "coalesce", "owner": "coalesce", "kind": "coalesce", "mime_type": "coalesce", "is_active": "overwrite", "status": "overwrite"}
PATCH = {"size": "positive", "kind": "overwrite", "mime_type": "overwrite", "owner": "coalesce"}
MONOTONIC = {"indexed": "greatest", "status": "unless_indexed", "owner": "coalesce"}
META = {"size": "coalesce", "kind": "coalesce", "is_active": "keep"}


def _register_upsert(key: str, rules: dict[str, str]) -> None:
    query(key, _upsert_sql("SELECT * FROM v_old", LAST, ["blob_id"], rules))(lambda t: C.upsert(t.v_old, t.v_batch, ["blob_id"], rules, "seq"))


for _key, _rules in (("upsert_catalog", FULL), ("upsert_patch", PATCH), ("upsert_monotonic", MONOTONIC), ("upsert_vector_meta", META)):
    _register_upsert(_key, _rules)


@query("upsert_status", """
SELECT coalesce(o.blob_id, n.blob_id) AS blob_id, coalesce(n.status, o.status) AS status,
  coalesce(n.status = 'seen' OR coalesce(o.kind, '') = 'quilt', coalesce(o.kind, '') = 'quilt') AS flagged
FROM (SELECT * FROM v_old) o FULL OUTER JOIN (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY seq DESC) AS rn FROM v_batch) WHERE rn = 1) n ON o.blob_id = n.blob_id
""")  # fmt: skip
def _(t):
    new = t.v_batch.select("blob_id", "seq", "status", (F.col("status") == "seen").alias("seen"))
    old = t.v_old.select("blob_id", "status", F.lit(None).cast("boolean").alias("seen"), "kind")
    both = C.upsert(old, new, ["blob_id"], {"status": "coalesce", "seen": "coalesce", "kind": "coalesce"}, "seq")
    return both.select("blob_id", "status", (F.coalesce("seen", F.lit(False)) | F.coalesce(F.col("kind") == "quilt", F.lit(False))).alias("flagged"))


@query("upsert_source_pair", _upsert_sql("SELECT blob_id, source, size FROM v_old", "SELECT blob_id, CASE WHEN CAST(blob_id AS BIGINT) % 3 = 0 THEN 'graphql' ELSE 'listing' END AS source, try_cast(CASE WHEN size = 0 THEN 'none' ELSE CAST(size AS STRING) END AS BIGINT) AS size FROM v_batch WHERE seq = 0", ["blob_id", "source"], {"size": "overwrite"}))
def _(t):
    source = F.when(F.col("blob_id").cast("long") % 3 == 0, "graphql").otherwise("listing")
    text = F.when(F.col("size") == 0, "none").otherwise(F.col("size").cast("string"))
    new = t.v_batch.where("seq = 0").select("blob_id", source.alias("source"), text.alias("raw")).select("blob_id", "source", F.expr("try_cast(raw AS BIGINT)").alias("size"))
    return C.upsert(t.v_old.select("blob_id", "source", "size"), new, ["blob_id", "source"], {"size": "overwrite"})


@query("upsert_cluster", """
SELECT coalesce(o.cluster_id, n.cluster_id) AS cluster_id, coalesce(n.label, o.label) AS label, coalesce(n.size, o.size) AS size
FROM (SELECT cluster_id, CAST(count(*) AS BIGINT) AS size, 'old' AS label FROM v_blobs WHERE cluster_id IS NOT NULL GROUP BY cluster_id) o
FULL OUTER JOIN (SELECT cluster_id + 10 AS cluster_id, CAST(count(*) AS BIGINT) AS size, CASE WHEN cluster_id % 2 = 0 THEN 'new' END AS label FROM v_blobs WHERE cluster_id IS NOT NULL AND is_active GROUP BY 1, cluster_id) n
ON o.cluster_id = n.cluster_id
""")  # fmt: skip
def _(t):
    b = t.v_blobs.where("cluster_id is not null")
    old = b.groupBy("cluster_id").agg(F.count("*").alias("size"), F.lit("old").alias("label"))
    new = b.where("is_active").groupBy("cluster_id").agg(F.count("*").alias("size"))
    new = new.select((F.col("cluster_id") + 10).alias("cluster_id"), "size", F.when(F.col("cluster_id") % 2 == 0, "new").alias("label"))
    return C.upsert(old, new, ["cluster_id"], {"label": "coalesce", "size": "coalesce"})


@query("mark_indexed", """
SELECT b.blob_id, b.indexed OR n.blob_id IS NOT NULL AS indexed, CASE WHEN n.blob_id IS NOT NULL THEN 'indexed' ELSE b.status END AS status,
  CASE WHEN n.blob_id IS NOT NULL THEN coalesce(n.cluster, b.cluster_id) ELSE b.cluster_id END AS cluster_id
FROM v_blobs b LEFT JOIN (SELECT blob_id, CASE WHEN CAST(blob_id AS BIGINT) % 4 = 0 THEN 77 END AS cluster FROM v_batch WHERE seq = 0) n ON b.blob_id = n.blob_id
""")  # fmt: skip
def _(t):
    ch = t.v_batch.where("seq = 0").select("blob_id", F.lit(True).alias("indexed"), F.lit("indexed").alias("status"), F.when(F.col("blob_id").cast("long") % 4 == 0, 77).alias("cluster_id"))
    return C.update_where(t.v_blobs, ch, "blob_id", ["indexed", "status", "cluster_id"]).select("blob_id", "indexed", "status", "cluster_id")


@query("mark_failed", """
SELECT b.blob_id, CASE WHEN n.blob_id IS NULL THEN b.indexed ELSE FALSE END AS indexed, CASE WHEN n.blob_id IS NULL THEN b.status ELSE 'embed_failed' END AS status
FROM v_blobs b LEFT JOIN (SELECT DISTINCT blob_id FROM v_batch) n ON b.blob_id = n.blob_id
""")
def _(t):
    return C.mark_failed(t.v_blobs, t.v_batch.select("blob_id").distinct(), "embed_failed").select("blob_id", "indexed", "status")


@query("set_flag", "SELECT b.blob_id, CASE WHEN CAST(b.blob_id AS BIGINT) % 10 = 0 THEN TRUE WHEN CAST(b.blob_id AS BIGINT) % 10 = 2 THEN FALSE ELSE b.is_nsfw END AS is_nsfw FROM v_blobs b")
def _(t):
    tail = F.col("blob_id").cast("long") % 10
    manual = t.v_blobs.where(tail.isin(0, 2)).select("blob_id", (tail == 0).alias("is_nsfw"))
    return C.update_where(t.v_blobs, manual, "blob_id", ["is_nsfw"]).select("blob_id", "is_nsfw")


@query("mark_expired", "SELECT blob_id, is_active AND NOT coalesce(end_epoch <= 30, FALSE) AS is_active, CASE WHEN is_active AND coalesce(end_epoch <= 30, FALSE) THEN 'expired' ELSE status END AS status FROM v_blobs")
def _(t):
    return C.mark_expired(t.v_blobs, EPOCH).select("blob_id", "is_active", "status")


@query("status_reset", "SELECT blob_id, FALSE AS indexed, 'queued_reindex' AS status FROM v_blobs")
def _(t):
    return C.reset_status(t.v_blobs).select("blob_id", "indexed", "status")


@query("catalog_filter_reclassify", """
SELECT b.blob_id, n.mime_type, 'webp' AS extension, n.kind FROM v_blobs b JOIN (SELECT * FROM v_batch WHERE seq = 0) n ON b.blob_id = n.blob_id
WHERE b.mime_type IS DISTINCT FROM n.mime_type OR b.extension IS DISTINCT FROM 'webp' OR b.kind IS DISTINCT FROM n.kind
""")
def _(t):
    return C.reclassified(t.v_blobs, t.v_batch.where("seq = 0").withColumn("extension", F.lit("webp")))


@query("build_catalog_row", "SELECT blob_id, end_epoch, CASE WHEN end_epoch <= 30 THEN FALSE ELSE is_active END AS is_active, CASE WHEN end_epoch <= 30 AND status = 'discovered' THEN 'expired' ELSE status END AS status FROM v_blobs")
def _(t):
    return C.build_rows(t.v_blobs, EPOCH).select("blob_id", "end_epoch", "is_active", "status")


for _mode, _cond in (("strict", "end_epoch > 30"), ("lenient", "end_epoch IS NULL OR end_epoch > 30"), ("flag", "is_active")):
    query(f"active_{_mode}", f"SELECT blob_id FROM v_blobs WHERE {_cond}")(lambda t, m=_mode: t.v_blobs.where(C.is_active(EPOCH, m)).select("blob_id"))


@query("expiry_state", "SELECT CASE WHEN end_epoch IS NULL THEN 'unknown' WHEN end_epoch <= 30 THEN 'expired' ELSE 'active' END AS state, CAST(count(*) AS BIGINT) AS n FROM v_blobs GROUP BY 1")
def _(t):
    return t.v_blobs.groupBy(C.expiry(EPOCH).alias("state")).agg(F.count("*").alias("n"))


@query("normalize_kind", "SELECT blob_id, CASE WHEN lower(trim(upper(kind) || ' ')) IN ('image','video','audio','doc','quilt') THEN lower(trim(upper(kind) || ' ')) END AS kind FROM v_blobs")
def _(t):
    return t.v_blobs.select("blob_id", C.normalize_kind(F.concat(F.upper("kind"), F.lit(" "))).alias("kind"))


_BUCKET = "CASE WHEN lower(trim(coalesce(kind,''))) IN ('image','video','audio','quilt') THEN lower(trim(kind)) WHEN lower(trim(coalesce(kind,''))) IN ('doc','pdf','text') THEN 'doc' ELSE 'other' END"


@query("modality_bucket", f"SELECT blob_id, {_BUCKET} AS bucket FROM v_blobs")
def _(t):
    return t.v_blobs.select("blob_id", C.modality("kind").alias("bucket"))


@query("supported_media", "SELECT blob_id FROM v_blobs WHERE lower(trim(extension)) IN ('png','jpg','jpeg','gif','webp','mp4','mp3')")
def _(t):
    return t.v_blobs.where(F.lower(F.trim("extension")).isin("png", "jpg", "jpeg", "gif", "webp", "mp4", "mp3")).select("blob_id")


@query("expired_before_fetch", "SELECT blob_id FROM v_blobs WHERE (end_epoch IS NULL OR end_epoch > 30) AND status NOT IN ('indexed','expired')")
def _(t):
    return t.v_blobs.where(C.is_active(EPOCH, "lenient") & ~F.col("status").isin("indexed", "expired")).select("blob_id")


@query("point_lookup", "SELECT b.blob_id, size, owner, CASE WHEN mime_type <> '' THEN mime_type END AS mime_type, extension, kind FROM v_blobs b WHERE blob_id = '33'")
def _(t):
    return t.v_blobs.where(F.col("blob_id") == "33").select("blob_id", "size", "owner", C.present("mime_type").alias("mime_type"), "extension", "kind")


@query("catalog_counts", "SELECT coalesce(kind,'unknown') AS kind, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (end_epoch IS NULL OR end_epoch > 30) AS BIGINT) AS active FROM v_blobs GROUP BY 1")
def _(t):
    return C.kind_counts(t.v_blobs, EPOCH)


@query("indexed_counts", "SELECT coalesce(kind,'other') AS kind, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (end_epoch IS NULL OR end_epoch > 30) AS BIGINT) AS active FROM v_blobs WHERE indexed GROUP BY 1")
def _(t):
    return C.kind_counts(t.v_blobs.where("indexed").withColumn("kind", F.coalesce("kind", F.lit("other"))), EPOCH)


@query("lifecycle_counts", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (is_active) AS BIGINT) AS active, CAST(greatest(0, count(*) - count(*) FILTER (is_active)) AS BIGINT) AS expired FROM v_blobs")
def _(t):
    return C.totals(t.v_blobs, active=F.col("is_active")).withColumn("expired", F.greatest(F.lit(0), F.col("total") - F.col("active")))


@query("catalog_stats", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (indexed) AS BIGINT) AS indexed, CAST(count(*) FILTER (is_nsfw) AS BIGINT) AS nsfw, CAST(count(*) FILTER (status = 'discovered') AS BIGINT) AS queued FROM v_blobs")
def _(t):
    return C.totals(t.v_blobs, indexed=F.col("indexed"), nsfw=F.col("is_nsfw"), queued=F.col("status") == "discovered")


@query("distributions", "SELECT 'kind' AS dimension, kind AS value, CAST(count(*) AS BIGINT) AS n FROM v_blobs GROUP BY kind UNION ALL SELECT 'mime_type', mime_type, CAST(count(*) AS BIGINT) FROM v_blobs GROUP BY mime_type UNION ALL SELECT 'status', status, CAST(count(*) AS BIGINT) FROM v_blobs GROUP BY status")
def _(t):
    return C.distributions(t.v_blobs, ["kind", "mime_type", "status"])


@query("ext_distribution", "SELECT CASE WHEN lower(trim(coalesce(extension,'unknown'))) = '' THEN 'unknown' ELSE lower(trim(coalesce(extension,'unknown'))) END AS extension, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (end_epoch IS NULL OR end_epoch > 30) AS BIGINT) AS active FROM v_blobs GROUP BY 1")
def _(t):
    return C.extension_distribution(t.v_blobs, EPOCH)


@query("modality_counts", f"""
WITH a AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM v_vectors GROUP BY 1), b AS (SELECT {_BUCKET} AS bucket, count(*) AS n FROM v_blobs WHERE indexed GROUP BY 1)
SELECT coalesce(a.bucket, b.bucket) AS bucket, CAST(greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS BIGINT) AS n FROM a FULL OUTER JOIN b ON a.bucket = b.bucket
""")  # fmt: skip
def _(t):
    tally = lambda df: df.groupBy(C.modality("kind").alias("bucket")).agg(F.count("*").alias("n"))
    return C.larger_counts(tally(t.v_vectors), tally(t.v_blobs.where("indexed")), "bucket")


@query("cluster_sizes", "SELECT cluster_id, CAST(count(*) AS BIGINT) AS n FROM v_blobs WHERE indexed AND cluster_id IS NOT NULL GROUP BY 1")
def _(t):
    return t.v_blobs.where("indexed and cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("nsfw_count", "SELECT CAST(greatest((SELECT count(*) FROM v_blobs WHERE indexed AND is_nsfw), (SELECT count(*) FROM v_vectors WHERE is_nsfw)) AS BIGINT) AS n")
def _(t):
    stored = t.v_blobs.agg(F.count_if(F.col("indexed") & F.col("is_nsfw")).alias("n"))
    return stored.union(t.v_vectors.agg(F.count_if("is_nsfw").alias("n"))).agg(F.max("n").alias("n"))


@query("outcome_counters", "SELECT status, CAST(count(*) AS BIGINT) AS n, mode(kind) IS NOT NULL AS has_kind FROM v_blobs GROUP BY status")
def _(t):
    return t.v_blobs.groupBy("status").agg(F.count("*").alias("n"), F.mode("kind").isNotNull().alias("has_kind"))


@query("stats_delta_sum", "SELECT source, CAST(sum(CASE WHEN status='indexed' THEN 1 ELSE 0 END) AS BIGINT) AS indexed, CAST(sum(CASE WHEN status='fetch_failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(size) AS BIGINT) AS bytes FROM v_blobs GROUP BY source")
def _(t):
    flag = lambda s: F.when(F.col("status") == s, 1).otherwise(0)
    return t.v_blobs.groupBy("source").agg(F.sum(flag("indexed")).alias("indexed"), F.sum(flag("fetch_failed")).alias("failed"), F.sum("size").alias("bytes"))


@query("epoch_mode", """
WITH top AS (SELECT end_epoch FROM v_blobs WHERE end_epoch IS NOT NULL ORDER BY first_seen_at DESC, blob_id LIMIT 100), per AS (SELECT end_epoch, count(*) AS n FROM top GROUP BY 1)
SELECT (SELECT end_epoch FROM per ORDER BY n DESC, end_epoch LIMIT 1) AS epoch, CAST((SELECT max(n) FROM per) AS BIGINT) AS n, (SELECT min(end_epoch) FROM per) AS low, (SELECT max(end_epoch) FROM per) AS high
""")  # fmt: skip
def _(t):
    return C.epoch_mode(t.v_blobs)


@query("progress_summary", """
SELECT CASE WHEN count(*) > 0 THEN 'ready' ELSE 'indexing' END AS state, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (is_active) AS BIGINT) AS active,
  CAST(count(*) FILTER (indexed AND kind='image') AS BIGINT) AS image, CAST(count(*) FILTER (indexed AND kind='video') AS BIGINT) AS video, CAST(count(*) FILTER (indexed AND kind='audio') AS BIGINT) AS audio FROM v_blobs
""")  # fmt: skip
def _(t):
    of = lambda k: F.col("indexed") & F.coalesce(F.col("kind") == k, F.lit(False))
    return C.totals(t.v_blobs, active=F.col("is_active"), image=of("image"), video=of("video"), audio=of("audio")).withColumn("state", F.when(F.col("total") > 0, "ready").otherwise("indexing"))


@query("prune_expired", "SELECT CAST(count(*) AS BIGINT) AS before, CAST(count(*) FILTER (expires_at <= 30) AS BIGINT) AS expired, CAST(count(*) FILTER (expires_at IS NULL OR expires_at > 30) AS BIGINT) AS kept FROM v_vectors")
def _(t):
    keep = C.is_active(EPOCH, "lenient", "expires_at")
    return t.v_vectors.agg(F.count("*").alias("before"), F.count_if(~keep).alias("expired"), F.count_if(keep).alias("kept"))


@query("remove_ids", "SELECT blob_id FROM v_vectors WHERE blob_id NOT IN (SELECT blob_id FROM v_blobs WHERE is_nsfw)")
def _(t):
    return t.v_vectors.join(t.v_blobs.where("is_nsfw"), "blob_id", "left_anti").select("blob_id")


_GONE = "SELECT blob_id FROM v_probes GROUP BY blob_id HAVING bool_and(code = 404) AND count(DISTINCT pass) = 2"


@query("confirm_all_passes", _GONE)
def _(t):
    return C.confirmed_gone(t.v_probes, 2)


@query("sweep_confirmed", f"SELECT b.blob_id, b.is_active AND g.blob_id IS NULL AS is_active, CASE WHEN g.blob_id IS NULL THEN b.status ELSE 'expired' END AS status FROM v_blobs b LEFT JOIN ({_GONE}) g ON b.blob_id = g.blob_id")
def _(t):
    return C.mark_expired(t.v_blobs, ids=C.confirmed_gone(t.v_probes, 2)).select("blob_id", "is_active", "status")


@query("enqueue_new_images", "SELECT blob_id FROM v_blobs WHERE kind = 'image' AND lower(trim(extension)) IN ('png','jpg') AND blob_id NOT IN (SELECT blob_id FROM v_batch)")
def _(t):
    return C.enqueue(t.v_batch, t.v_blobs, ["png", "jpg"])


@query("queue_claim", "SELECT blob_id FROM v_blobs WHERE status = 'discovered' ORDER BY first_seen_at, blob_id LIMIT 50")
def _(t):
    queue = t.v_blobs.where("status = 'discovered'").select("blob_id", F.col("first_seen_at").alias("queued_at"))
    return C.claim(queue, 50)[0].select("blob_id")


_OUTCOME_IN = "SELECT blob_id, end_epoch, kind, CAST(blob_id AS BIGINT) % 9 = 0 AS known, status <> 'fetch_failed' AS fetched FROM v_blobs"


@query("process_outcome", f"""
SELECT blob_id, CASE WHEN known THEN 'skipped' WHEN end_epoch <= 30 THEN 'expired' WHEN NOT fetched THEN 'fetch_failed' WHEN kind = 'quilt' THEN 'container' WHEN kind IN ('image','video','audio','text') THEN 'indexed' ELSE 'unsupported' END AS status,
  CASE WHEN known THEN 'already_indexed' WHEN end_epoch <= 30 THEN 'expired_before_fetch' WHEN NOT fetched THEN 'no_payload' WHEN kind = 'quilt' THEN 'expanded_separately' WHEN kind IN ('image','video','audio','text') THEN 'ok' ELSE 'unsupported_type' END AS reason,
  coalesce(known OR (NOT coalesce(end_epoch <= 30, FALSE) AND fetched AND coalesce(kind IN ('image','video','audio','text'), FALSE)), FALSE) AS indexed FROM ({_OUTCOME_IN})
""")  # fmt: skip
def _(t):
    rows = t.v_blobs.select("blob_id", "end_epoch", "kind", (F.col("blob_id").cast("long") % 9 == 0).alias("known"), (F.col("status") != "fetch_failed").alias("fetched"))
    return C.outcome(rows, EPOCH)


@query("size_gate", "SELECT blob_id, CASE WHEN size > 250000 THEN 'too_large' WHEN status = 'fetch_failed' THEN 'fetch_failed' WHEN size % 50 = 0 THEN 'embed_failed' ELSE 'ok' END AS outcome FROM v_blobs")
def _(t):
    o = F.when(F.col("size") > 250_000, "too_large").when(F.col("status") == "fetch_failed", "fetch_failed").when(F.col("size") % 50 == 0, "embed_failed").otherwise("ok")
    return t.v_blobs.select("blob_id", o.alias("outcome"))


@query("rebuild_plan", "SELECT b.blob_id FROM v_blobs b LEFT JOIN v_captions c ON b.blob_id = c.blob_id WHERE b.kind = 'image' AND (end_epoch IS NULL OR end_epoch > 30) AND (c.caption IS NULL OR c.caption LIKE '%the%')")
def _(t):
    rows = t.v_blobs.where((F.col("kind") == "image") & C.is_active(EPOCH, "lenient")).join(t.v_captions, "blob_id", "left")
    return rows.where(F.col("caption").isNull() | F.col("caption").contains("the")).select("blob_id")


@query("index_swap", "SELECT b.blob_id, CASE WHEN v.blob_id IS NOT NULL THEN 'indexed' ELSE 'embed_failed' END AS status FROM v_blobs b LEFT JOIN v_vectors v ON b.blob_id = v.blob_id WHERE b.kind = 'image'")
def _(t):
    new = t.v_vectors.select("blob_id", F.lit(True).alias("made"))
    return t.v_blobs.where("kind = 'image'").join(new, "blob_id", "left").select("blob_id", F.when(F.col("made"), "indexed").otherwise("embed_failed").alias("status"))


@query("expire_flush", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status = 'expired') AS BIGINT) AS expired FROM (SELECT CASE WHEN is_active AND end_epoch <= 30 THEN 'expired' ELSE status END AS status FROM v_blobs)")
def _(t):
    return C.mark_expired(t.v_blobs, EPOCH).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "expired").alias("expired"))
