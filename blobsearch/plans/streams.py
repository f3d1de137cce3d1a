"""Streaming queries: each runs its stream to the end of the given events and returns the final state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsearch.operators import listing as G
from blobsearch.sources import landed
from blobsearch.sources import shared as H
from blobsearch.sources.cursor import cursor_source
from blobsearch.sources.paged import paged_source
from blobsearch.streaming import jobs as J

from .registry import Tables, query

AS_OF = "2024-01-31 00:00:00"


def event_stream(t: Tables) -> DataFrame:
    """The events stand-in over a stream of the table's files."""
    raw = t.spark.readStream.schema(t.events.schema).parquet(f"{t.dir}/events.parquet*")
    blob = F.when(F.col("event_id") % 10 == 0, "").otherwise((F.col("event_id") % 4000).cast("string"))
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), blob.alias("blob_id"), (F.col("user_id") % 12).cast("string").alias("upstream"), (F.col("value") / 10.0).alias("latency_secs"), (F.col("event_type") != "error").alias("ok"))


@query("src_events_stream", "SELECT event_id, type, blob_id FROM v_events WHERE type IN ('purchase', 'error')")
def _(t):
    return J.collected(J.of_types(event_stream(t), ["purchase", "error"]).select("event_id", "type", "blob_id"), t.spark)


@query("stream_skip_pending", "SELECT event_id, blob_id FROM v_events WHERE blob_id <> ''")
def _(t):
    return J.collected(J.with_id(event_stream(t)).select("event_id", "blob_id"), t.spark)


@query("stream_dedupe", "SELECT DISTINCT blob_id FROM v_events WHERE blob_id <> ''")
def _(t):
    return J.collected(J.dedupe(J.with_id(event_stream(t)).select("blob_id")), t.spark)


_LAST = "SELECT blob_id, arg_max(type, event_id) AS status FROM v_events WHERE blob_id <> '' GROUP BY blob_id"


def _catalog(t, name):
    return H.BucketTable(t.spark, H.new_path(t.spark, name), "blob_id", "blob_id string, status string")


def _merge_events(t, table):
    rows = J.with_id(event_stream(t)).select("blob_id", F.col("type").alias("status"), "event_id")
    J.run_available(rows, J.merge_buckets(table, {"status": "overwrite"}, "event_id"), H.new_path(t.spark, "checkpoint"))
    return table.read()


@query("stream_event_filter", _LAST)
def _(t):
    return _merge_events(t, _catalog(t, "catalog"))


@query("stream_backfill_listen", f"SELECT coalesce(b.blob_id, e.blob_id) AS blob_id, coalesce(e.status, b.status) AS status FROM v_blobs b FULL OUTER JOIN ({_LAST}) e ON b.blob_id = e.blob_id")
def _(t):
    # the full scan is a merge into an empty table; the stream then touches the buckets of its blobs
    table = _catalog(t, "catalog")
    table.merge(t.v_blobs.select("blob_id", "status"), lambda old, new: old.unionByName(new))
    return _merge_events(t, table)


_LOG = "event_id long, type string"


def _log(t, path):
    """The events as a log with cursors, landed in ranges of 1,000."""
    rows, tip = landed.range_reader(path, "event_id", 1000)
    name = f"cursor_log_{path.rsplit('-', 1)[1]}"
    t.spark.dataSource.register(cursor_source(rows, tip, _LOG, name))
    return t.spark.readStream.format(name).option("per_task", 2500)


def _middle(t):
    return t.events.agg(F.floor(F.max("event_id") / 2)).first()[0] or 0


@query("stream_cursor_resume", "SELECT event_id, type FROM v_events")
def _(t):
    # a run that ends half way, then one on the same checkpoint: it begins after the first one's cursor
    path, out, check = (H.new_path(t.spark, n) for n in ("log", "out", "checkpoint"))
    landed.land(t.v_events.select("event_id", "type"), path, "event_id", 1000)
    J.collected(_log(t, path).option("start", -1).option("until", _middle(t)).load(), t.spark, check, out)
    return J.collected(_log(t, path).option("start", -1).load(), t.spark, check, out)


@query("stream_from_tip", "SELECT event_id, type FROM v_events WHERE event_id > (SELECT floor(max(event_id) / 2) FROM events)")
def _(t):
    # without a cursor a stream begins at the tip: of a log that grows between two runs it gives the growth
    path, out, check = (H.new_path(t.spark, n) for n in ("log", "out", "checkpoint"))
    rows, half = t.v_events.select("event_id", "type"), _middle(t)
    landed.land(rows.where(F.col("event_id") <= half), path, "event_id", 1000)
    J.collected(_log(t, path).load(), t.spark, check, out)
    landed.land(rows.where(F.col("event_id") > half), path, "event_id", 1000)
    return J.collected(_log(t, path).load(), t.spark, check, out)


PAGE, POLLED, STREAK = 100, 5, 20
#: Pages of a landed folder, and of a task of the paged source.
SPAN = 100

#: Newest first: page 0 holds the newest events. Every 41st page lacks an event, and so ends the listing.
_DEALT = f"SELECT CAST(floor(r / {PAGE}) AS BIGINT) AS page, CAST(r % {PAGE} AS BIGINT) AS pos, event_id FROM (SELECT event_id, (SELECT max(event_id) FROM events) - event_id AS r FROM events) WHERE r % {41 * PAGE} <> {40 * PAGE + 7}"
_KNOWN = "SELECT event_id FROM events WHERE event_id % 9 <> 0 AND event_id < (SELECT max(event_id) FROM events) - 130 OR event_id < (SELECT max(event_id) FROM events) - 370"


def _paged(t, pages):
    """The events dealt into pages, landed, and listed through the paged source."""
    newest = F.broadcast(t.events.agg(F.max("event_id").alias("newest")))
    r = F.col("newest") - F.col("event_id")
    rows = t.events.crossJoin(newest).where(r % (41 * PAGE) != 40 * PAGE + 7).select(F.floor(r / PAGE).alias("page"), (r % PAGE).alias("pos"), F.col("event_id").cast("string").alias("blobId"))
    path = H.new_path(t.spark, "pages")
    landed.land(rows, path, "page", SPAN)
    read, tip = landed.range_reader(path, "page", SPAN)
    held = {}

    def fetch(page):
        # a task's pages come from one folder, read once
        first = page // SPAN * SPAN
        if first not in held:
            held.clear()
            pages = held[first] = {}
            for x in read(first, first + SPAN - 1):
                pages.setdefault(x["page"], []).append({"pos": x["pos"], "blobId": x["blobId"]})
        return sorted(held[first].get(page, []), key=lambda x: x["pos"])

    name = f"paged_{path.rsplit('-', 1)[1]}"
    t.spark.dataSource.register(paged_source(fetch, name))
    listed = t.spark.read.format(name).option("pages", tip() + 1 if pages is None else pages).option("pages_per_task", SPAN).option("page_size", PAGE).load()
    item = F.from_json("item", "pos long, blobId string")
    return listed.select("page", item.alias("x")).select("page", "x.pos", F.col("x.blobId").alias("blob_id"))


@query("src_paged_listing", f"WITH d AS ({_DEALT}), n AS (SELECT page, count(*) AS n FROM d GROUP BY 1) SELECT page, pos, CAST(event_id AS VARCHAR) AS blob_id FROM d WHERE page <= (SELECT coalesce(min(page), 1000000000) FROM n WHERE n < {PAGE})")
def _(t):
    # written once: pages are counted first and then cut
    return G.until_short_page(H.settled(_paged(t, None), "listed"), PAGE)


@query("poll_newest_pages", f"""
WITH d AS (SELECT d.*, k.event_id IS NOT NULL AS known, row_number() OVER (ORDER BY page, pos) AS nth FROM ({_DEALT}) d LEFT JOIN ({_KNOWN}) k USING (event_id) WHERE page < {POLLED}),
g AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (ORDER BY nth) AS g FROM d), s AS (SELECT *, CASE WHEN known THEN row_number() OVER (PARTITION BY g, known ORDER BY nth) ELSE 0 END AS run FROM g)
SELECT page, pos, CAST(event_id AS VARCHAR) AS blob_id, known FROM s WHERE nth <= (SELECT coalesce(min(nth), 1000000000) FROM s WHERE run = {STREAK})
""")  # fmt: skip
def _(t):
    known = t.sql(_KNOWN).select(F.col("event_id").cast("string").alias("blob_id"))
    return G.poll_newest(_paged(t, POLLED), known, STREAK, POLLED)


@query("stream_coverage", "SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (blob_id <> '') AS BIGINT) AS with_id FROM v_events GROUP BY type")
def _(t):
    table = H.VersionedTable(t.spark, H.new_path(t.spark, "coverage"))
    J.run_table(J.coverage(event_stream(t)), "complete", J.replace_with(table), H.new_path(t.spark, "checkpoint"))
    return table.read()


@query("stream_retry_budget", "SELECT blob_id, CAST(least(count(*), 3) AS BIGINT) AS failures, CASE WHEN count(*) >= 3 THEN 'failed' ELSE 'requeue' END AS action FROM v_events WHERE NOT ok AND blob_id <> '' GROUP BY 1")
def _(t):
    table = H.BucketTable(t.spark, H.new_path(t.spark, "retries"), "blob_id", "blob_id string, failures long, action string")
    failures = J.with_id(event_stream(t)).where("not ok").withWatermark("ts", "0 seconds")
    J.run_table(J.retry_stream(failures), "update", J.latest_in_buckets(table), H.new_path(t.spark, "checkpoint"))
    return table.read()


@query("retry_budget_of_log", "SELECT blob_id, CAST(least(count(*), 3) AS BIGINT) AS failures, CASE WHEN count(*) >= 3 THEN 'failed' ELSE 'requeue' END AS action FROM v_events WHERE NOT ok AND blob_id <> '' GROUP BY 1")
def _(t):
    return J.retry_budget(J.with_id(t.v_events).where("not ok"))


_HEALTH = """
WITH s AS (SELECT upstream, list(CASE WHEN ok THEN latency_secs ELSE greatest(latency_secs, 4.0) END ORDER BY ts, event_id) AS l, list(ok ORDER BY ts, event_id) AS oks, max(CASE WHEN NOT ok THEN ts END) AS bad FROM v_events GROUP BY 1)
SELECT upstream, CAST(len(l) AS BIGINT) AS requests, CAST(len(list_filter(oks, lambda x: NOT x)) AS BIGINT) AS failures,
  round(list_reduce(list_concat([CAST(1.0 AS DOUBLE)], l), lambda a, x: 0.25 * x + 0.75 * a), 6) AS ema,
  CAST(coalesce(list_position(list_reverse(oks), TRUE) - 1, len(oks)) AS BIGINT) AS streak,
  coalesce(list_position(list_reverse(oks), TRUE) - 1, len(oks)) >= 3 AND epoch(bad) + 60 > epoch(TIMESTAMP '2024-01-31 00:00:00') AS tripped FROM s
"""  # fmt: skip


@query("stream_health", _HEALTH.replace("epoch(TIMESTAMP '2024-01-31 00:00:00')", "(SELECT epoch(max(ts)) FROM v_events)"))
def _(t):
    # timers fire until the watermark stands at the newest event
    table = H.BucketTable(t.spark, H.new_path(t.spark, "health"), "upstream", "upstream string, requests long, failures long, ema double, streak long, tripped boolean")
    log = event_stream(t).select("upstream", "ts", "event_id", "ok", "latency_secs").withWatermark("ts", "0 seconds")
    J.run_table(J.health_stream(log), "update", J.latest_in_buckets(table), H.new_path(t.spark, "checkpoint"))
    return table.read().withColumn("ema", F.round("ema", 6))


@query("health_of_log", _HEALTH)
def _(t):
    return J.health(t.v_events.withColumn("ts", F.col("ts").cast("timestamp")), AS_OF).withColumn("ema", F.round("ema", 6))


@query("stream_expire_flush", "SELECT blob_id, expires_at, expires_at IS NOT NULL AND expires_at <= (SELECT max(event_id) // 200 FROM events) AS expired FROM v_vectors")
def _(t):
    # epochs arrive as a stream of ticks, one for each 200 events; each batch marks and takes out what has expired by then
    table = H.BucketTable(t.spark, H.new_path(t.spark, "live"), "blob_id", "blob_id string, expires_at int, expired boolean")
    table.merge(t.v_vectors.select("blob_id", "expires_at", F.lit(False).alias("expired")), lambda old, new: old.unionByName(new))
    ticks = event_stream(t).select(F.floor(F.col("event_id") / 200).alias("epoch"))
    J.run_available(ticks, J.expire_in(table), H.new_path(t.spark, "checkpoint"))
    return table.read()


@query("write_snapshot", "SELECT blob_id, label, kind FROM v_vectors WHERE blob_id NOT IN (SELECT blob_id FROM v_blobs WHERE is_nsfw)")
def _(t):
    table = H.VersionedTable(t.spark, H.new_path(t.spark, "vectors"))
    H.write_snapshot(table, t.v_vectors, t.v_blobs.where("is_nsfw"))
    return table.read().select("blob_id", "label", "kind")


@query("write_exports", "SELECT form, blob_id, CASE WHEN form <> 'ids' THEN label END AS label, CASE WHEN form <> 'ids' THEN kind END AS kind FROM v_vectors, (SELECT unnest(['ids', 'csv', 'jsonl']) AS form)")
def _(t):
    # each form is read again
    rows = t.v_vectors.select("blob_id", "label", "kind")
    paths = H.write_exports(rows, H.new_path(t.spark, "exports"))
    ids = t.spark.read.text(paths["ids"]).select(F.col("value").alias("blob_id"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("kind"))
    forms = {"ids": ids, "csv": t.spark.read.schema(rows.schema).option("header", True).csv(paths["csv"]), "jsonl": t.spark.read.schema(rows.schema).json(paths["jsonl"])}
    out = [df.select(F.lit(form).alias("form"), "blob_id", "label", "kind") for form, df in forms.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
