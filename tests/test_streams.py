"""Streams, stored indexes and joins that run in several steps, against plain Python."""

import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from blobsearch.operators import intervals, listing
from blobsearch.operators.search import bm25
from blobsearch.operators.textindex import TextIndex
from blobsearch.sources import landed
from blobsearch.sources import shared as H
from blobsearch.sources.cursor import cursor_source
from blobsearch.sources.paged import paged_source
from blobsearch.streaming import jobs as J


def test_overlap_join_against_all_pairs(spark):
    r = random.Random(4)

    def spans(n):
        out = []
        for i in range(n):
            a = r.choice((r.uniform(-50, 400), 4.0 * r.randrange(60)))
            out.append((r.choice("aab"), i, a, a + r.choice((0.5, 4.0, r.uniform(0, 9), 64.0, r.uniform(0, 3000)))))
        return out

    left, right = [*spans(300), ("a", 900, 1.0, 1.0), ("a", 901, None, 2.0), ("a", 902, 5.0, 3.0), (None, 903, 0.0, 9.0)], [*spans(300), ("a", 900, 0.0, float("inf")), ("b", 901, float("nan"), 3.0)]
    a = spark.createDataFrame(left, "k string, i int, s double, e double")
    b = spark.createDataFrame(right, "k string, j int, g0 double, g1 double")
    got = [(x.k, x.i, x.j) for x in intervals.overlap_join(a, b, "k").collect()]
    fine = lambda x: x[2] is not None and x[3] is not None and abs(x[2]) < 1e300 and abs(x[3]) < 1e300 and x[2] < x[3]
    want = {(k, i, j) for k, i, s, e in filter(fine, left) for m, j, g0, g1 in filter(fine, right) if k == m and k and s < g1 and g0 < e}
    assert len(got) == len(set(got)) and set(got) == want
    assert intervals.overlap_join(a.limit(0), b.limit(0), "k").count() == 0


def test_overlap_join_meets_few_pairs_in_vain(spark):
    """One key of very many short intervals beside long ones: what meets in a bin is a small multiple of the result."""
    short = spark.range(20_000).select(F.lit("v").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("s"), (F.col("id") + 1.5).cast("double").alias("e"))
    long = spark.range(40).select(F.lit("v").alias("k"), F.col("id").alias("j"), (F.col("id") * 500.0).alias("g0"), (F.col("id") * 500.0 + 3).alias("g1"))
    both = long.unionByName(spark.createDataFrame([("v", 99, 0.0, 20_000.0)], long.schema))
    assert intervals.overlap_join(short, both, "k").groupBy("j").count().where("j = 99").first()["count"] == 20_000
    assert intervals.overlap_join(short, long, "k").count() == 40 * 4 - 1


def words(spark, rows):
    return spark.createDataFrame(rows, "blob_id string, caption string")


def test_text_index_follows_changes(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice("ab cd ef gh ij kl mn é".split()) for _ in range(r.randrange(1, 20)))
    now = {f"b{i}": text() for i in range(120)} | {"none": None, "empty": "", "odd": "?! "}
    index = TextIndex(spark, H.new_path(spark, "ix"))
    index.rebuild(words(spark, list(now.items())))
    asked = spark.createDataFrame([("q1", ["ab", "cd"]), ("q2", ["é"]), ("q3", ["unseen"]), ("q4", ["ab", "ab"])], "query_id string, terms array<string>")

    def same():
        want = {(x.query_id, x.blob_id): x.bm25 for x in bm25(words(spark, list(now.items())), asked).collect()}
        got = {(x.query_id, x.blob_id): x.bm25 for x in index.bm25(asked).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        terms = Counter(t for v in now.values() if v for t in v.lower().split() if t.isalnum())
        assert {x.term: x.tf for x in index.postings().groupBy("term").agg(F.sum("tf").alias("tf")).collect()} == terms

    same()
    for step in range(4):
        changes = []
        for seq in range(2):
            for b in r.sample(sorted(now), 15) + [f"new{step}{seq}"]:
                gone, t = r.random() < 0.3, r.choice((None, text(), text()))
                changes.append((b, seq, gone, t))
        for b, _, gone, t in sorted({(b, s): (b, s, g, t) for b, s, g, t in changes}.values(), key=lambda x: x[1]):
            now[b] = None if gone else t
        batch = spark.createDataFrame([*{(c[0], c[1]): c for c in changes}.values(), (None, 0, False, "ab")], "blob_id string, seq int, deleted boolean, caption string")
        index.apply(batch, run=step + 1)
        index.apply(batch, run=step + 1)  # the stream repeats it
        now = {k: v for k, v in now.items() if v is not None}
        if step < 3:
            same()
    index.compact()
    assert len(index.runs()) == 1
    index.clean()
    same()


def test_postings_are_written_in_order_without_a_shuffle(spark):
    docs = spark.createDataFrame([(f"d{i}", f"the w{i % 7} w{i % 11}") for i in range(60)], "blob_id string, caption string").repartition(3)
    index = TextIndex(spark, H.new_path(spark, "ix"))
    index.rebuild(docs)
    index.apply(spark.createDataFrame([("d1", "anew", 0, False), ("d2", None, 0, True)], "blob_id string, caption string, seq int, deleted boolean"))
    index.compact()
    for run, n in ((0, 60), (2, 58)):
        files = {}
        for r in spark.read.parquet(f"{index.path}/postings-{run}").where("term is not null").select("*", F.input_file_name().alias("file")).collect():
            files.setdefault(r.file, []).append(r.term)
        # a file's terms are in order, whatever others hold
        assert all(x == sorted(x) for x in files.values()) and sum(x.count("the") for x in files.values()) == n
        assert run or all("the" in x for x in files.values())
    assert sorted(r.blob_id for r in index.postings(["the", "anew"]).collect()) == sorted(["d0", "d1", *(f"d{i}" for i in range(3, 60))])


def test_text_index_writes_a_failed_batch_anew(spark):
    path = H.new_path(spark, "ix")
    index = TextIndex(spark, path)
    index.rebuild(words(spark, [("a", "x y"), ("b", "x")]))
    # postings of a batch whose driver was lost before its totals were written
    spark.createDataFrame([("x", "zz", 9, 9.0, 1)], "term string, blob_id string, tf long, dl double, run long").write.parquet(f"{path}/postings-1")
    assert index.postings().count() == 3
    index.apply(spark.createDataFrame([("a", 0, False, "z")], "blob_id string, seq int, deleted boolean, caption string"), run=1)
    assert sorted((x.term, x.blob_id) for x in index.postings().collect()) == [("x", "b"), ("z", "a")]


def _buckets(spark, n=16):
    return H.BucketTable(spark, H.new_path(spark, "t"), "blob_id", "blob_id string, status string", n)


def _stamps(spark, table):
    root = spark._jvm.org.apache.hadoop.fs.Path(table.path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return {d.getPath().getName(): sorted(f.getPath().getName() for f in fs.listStatus(d.getPath())) for d in fs.listStatus(root) if d.isDirectory()}


def test_merge_writes_touched_buckets_only(spark):
    table = _buckets(spark)
    first = spark.range(400).select(F.col("id").cast("string").alias("blob_id"), F.lit("old").alias("status"))
    assert len(table.merge(first, lambda old, new: old.unionByName(new))) == 16
    before = _stamps(spark, table)
    sink = J.merge_buckets(table, {"status": "overwrite"}, "n")
    batch = spark.createDataFrame([("7", "x", 1), ("7", "y", 2), ("new", "z", 1)], "blob_id string, status string, n int")
    sink(batch, 0)
    after = _stamps(spark, table)
    assert 1 <= sum(before[k] != after[k] for k in after) <= 2
    want = {str(i): "old" for i in range(400)} | {"7": "y", "new": "z"}
    rows = lambda: {r.blob_id: r.status for r in table.read().collect()}
    assert rows() == want and table.read().count() == 401
    sink(batch, 0)
    assert rows() == want
    sink(batch.limit(0), 1)
    assert rows() == want


def test_merge_is_finished_after_a_lost_driver(spark):
    table = _buckets(spark, 4)
    table.merge(spark.createDataFrame([("a", "1"), ("b", "1")], "blob_id string, status string"), lambda old, new: old.unionByName(new))
    # merged buckets were complete, and none was put in place
    bucket = table.read().where("blob_id = 'a'").select(table._bucket().alias("b")).first()["b"]
    old = [(r.blob_id, "2", bucket) for r in table.read().where(table._bucket() == bucket).collect()]
    spark.createDataFrame(old, "blob_id string, status string, _bucket int").write.partitionBy("_bucket").parquet(f"{table.path}.merged")
    assert {r.blob_id: r.status for r in table.read().collect()}["a"] == "2" and table.read().count() == 2


def _feed(spark, tmp_path, schema):
    """A stream over files that are taken one by one."""
    folder = f"{tmp_path}/in"
    os.makedirs(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    return folder, stream


def _put(folder, n, rows, columns):
    name = f"{folder}/{n:03}.json"
    pd.DataFrame(rows, columns=columns).to_json(name, orient="records", lines=True, date_format="iso")
    os.utime(name, (1_700_000_000 + n, 1_700_000_000 + n))


def _at(seconds):
    return pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=seconds)


def test_health_trips_cools_down_and_resets_in_the_stream(spark, tmp_path):
    columns = ["upstream", "ts", "event_id", "ok", "latency_secs"]
    folder, stream = _feed(spark, tmp_path, "upstream string, ts timestamp, event_id long, ok boolean, latency_secs double")
    _put(folder, 0, [("a", _at(i), i, i == 0, 0.5) for i in range(4)] + [("b", _at(2), 9, True, 1.0)], columns)
    _put(folder, 1, [("b", _at(30), 10, True, 1.0)], columns)  # a is tripped until 63
    _put(folder, 2, [("b", _at(90), 11, True, 1.0)], columns)  # now its cooldown is over
    _put(folder, 3, [("b", _at(91), 17, True, 1.0)], columns)  # the watermark stands at 90
    _put(folder, 4, [("a", _at(100), 12, False, 9.0), ("a", _at(101), 13, False, 1.0)], columns)  # fails on: tripped until 161
    _put(folder, 5, [("a", _at(110), 14, True, 2.0), ("b", _at(111), 15, True, 1.0)], columns)  # a success resets
    seen = []
    q = J.health_stream(stream.withWatermark("ts", "0 seconds")).writeStream.outputMode("update").foreachBatch(lambda b, i: seen.extend((i, r) for r in b.collect()))
    q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    a = [r for _, r in seen if r.upstream == "a"]
    assert [(r.requests, r.streak, r.tripped) for r in a] == [(4, 3, True), (4, 3, False), (6, 5, True), (7, 0, False)]
    ema = 1.0
    for cost in (0.5, 4.0, 4.0, 4.0, 9.0, 4.0, 2.0):
        ema = 0.25 * cost + 0.75 * ema
    assert abs(a[-1].ema - ema) < 1e-12 and a[-1].failures == 5


def test_health_in_batches_equals_the_log(spark, tmp_path):
    r = random.Random(2)
    rows = [(str(r.randrange(3)), _at(i), i, r.random() < 0.6, round(r.uniform(0, 6), 3)) for i in range(900)]
    columns = ["upstream", "ts", "event_id", "ok", "latency_secs"]
    schema = "upstream string, ts timestamp, event_id long, ok boolean, latency_secs double"
    folder, stream = _feed(spark, tmp_path, schema)
    for k in range(3):
        part = rows[k * 300 : k * 300 + 300]
        r.shuffle(part)
        _put(folder, k, part, columns)
    table = H.BucketTable(spark, H.new_path(spark, "h"), "upstream", "upstream string, requests long, failures long, ema double, streak long, tripped boolean")
    J.run_table(J.health_stream(stream.withWatermark("ts", "0 seconds")), "update", J.latest_in_buckets(table), f"{tmp_path}/c")
    log = spark.read.schema(schema).json(folder)
    want = {x.upstream: x for x in J.health(log, str(_at(899))).collect()}
    got = {x.upstream: x for x in table.read().collect()}
    assert got.keys() == want.keys()
    for u, x in want.items():
        assert (got[u].requests, got[u].failures, got[u].streak, got[u].tripped) == (x.requests, x.failures, x.streak, x.tripped) and abs(got[u].ema - x.ema) < 1e-9


def test_retries_end_and_are_forgotten(spark, tmp_path):
    folder, stream = _feed(spark, tmp_path, "blob_id string, ts timestamp")
    columns = ["blob_id", "ts"]
    _put(folder, 0, [("a", _at(1)), ("a", _at(2)), ("b", _at(3))], columns)
    _put(folder, 1, [("a", _at(4)), ("c", _at(5))], columns)  # a is given up
    _put(folder, 2, [("a", _at(6)), ("b", _at(20))], columns)  # ignored
    _put(folder, 3, [("b", _at(90))], columns)  # b is given up; a's state has ended by then
    _put(folder, 4, [("a", _at(91))], columns)  # a counts anew
    seen = []
    out = J.retry_stream(stream.withWatermark("ts", "0 seconds"), forget=60.0)
    out.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    of = lambda k: [x[1:] for x in seen if x[0] == k]
    assert of("a") == [(2, "requeue"), (3, "failed"), (1, "requeue")] and of("c") == [(1, "requeue")]
    assert of("b") == [(1, "requeue"), (2, "requeue"), (3, "failed")]


def _log_source(spark, path, name):
    rows, tip = landed.range_reader(path, "event_id", 10)
    spark.dataSource.register(cursor_source(rows, tip, "event_id long, type string", name))
    return spark.readStream.format(name).option("per_task", 7)


def test_cursor_source_reads_each_event_once(spark):
    path, out, check = (H.new_path(spark, n) for n in ("log", "out", "check"))
    events = lambda a, b: spark.range(a, b).select(F.col("id").alias("event_id"), F.lit("x").alias("type"))
    landed.land(events(0, 50), path, "event_id", 10)
    ids = lambda: [r.event_id for r in spark.read.parquet(out).collect()]
    J.collected(_log_source(spark, path, "log_a").option("start", 4).option("until", 23).load(), spark, check, out)
    assert sorted(ids()) == list(range(5, 24))
    landed.land(events(50, 75), path, "event_id", 10)
    for _ in range(2):  # the second run finds nothing new
        J.collected(_log_source(spark, path, "log_a").option("start", 4).load(), spark, check, out)
        assert sorted(ids()) == list(range(5, 75))


def test_a_range_lists_its_own_folders(spark, monkeypatch):
    import pyarrow.fs as fs

    path = H.new_path(spark, "log")
    landed.land(spark.range(100).select(F.when(F.col("id") != 57, F.col("id")).alias("event_id")), path, "event_id", 10)
    rows, tip = landed.range_reader(path, "event_id", 10)
    seen, selector = [], fs.FileSelector
    monkeypatch.setattr(fs, "FileSelector", lambda base, **kw: seen.append(base) or selector(base, **kw))
    assert [r["event_id"] for r in rows(28, 31)] == [28, 29, 30, 31] and [b.rsplit("/", 1)[1] for b in seen] == ["_range=2", "_range=3"]
    assert tip() == 99 and rows(200, 210) == []


def test_cursor_source_starts_at_the_tip(spark):
    path, out, check = (H.new_path(spark, n) for n in ("log", "out", "check"))
    landed.land(spark.range(30).select(F.col("id").alias("event_id"), F.lit("x").alias("type")), path, "event_id", 10)
    assert J.collected(_log_source(spark, path, "log_b").load(), spark, check, out).count() == 0
    landed.land(spark.range(30, 33).select(F.col("id").alias("event_id"), F.lit("y").alias("type")), path, "event_id", 10)
    assert sorted(r.event_id for r in J.collected(_log_source(spark, path, "log_b").load(), spark, check, out).collect()) == [30, 31, 32]


@pytest.mark.parametrize(("sizes", "last"), [([5] * 7 + [2] + [5] * 9, 7), ([5] * 4 + [0] + [5] * 9, 3), ([3, 5, 5], 0), ([5, 5], 1), ([], -1)])
def test_short_page_ends_later_ranges(spark, sizes, last):
    name = f"pages_{len(sizes)}_{last + 1}"
    source = paged_source(lambda p: [{"blobId": f"b{p}-{i}"} for i in range(sizes[p] if p < len(sizes) else 0)], name)
    spark.dataSource.register(source)
    listed = spark.read.format(name).option("pages", 30).option("pages_per_task", 3).option("page_size", 5).load()
    got = {r.page for r in listing.until_short_page(listed, 5).select("page").collect()}
    assert got == set(range(last + 1))


def test_poll_stops_at_the_streak_across_pages(spark):
    r = random.Random(6)
    rows = [(p, i, f"b{p}-{i}") for p in range(8) for i in range(6)]
    for share, streak, most in ((0.9, 9, 5), (0.7, 4, 8), (1.0, 6, 3), (0.0, 2, 4), (1.0, 100, 3)):
        known = {b for *_, b in rows if r.random() < share}
        want, run = [], 0
        for p, i, b in rows:
            if p >= most:
                break
            want.append((p, i, b, b in known))
            run = run + 1 if b in known else 0
            if run == streak:
                break
        pages = spark.createDataFrame(rows, "page long, pos long, blob_id string")
        got = listing.poll_newest(pages, spark.createDataFrame([(b,) for b in known], "blob_id string"), streak, most)
        assert sorted(map(tuple, got.collect())) == want


def test_expiry_marks_only_what_is_due(spark):
    table = H.BucketTable(spark, H.new_path(spark, "live"), "blob_id", "blob_id string, expires_at int, expired boolean", 8)
    table.merge(spark.createDataFrame([(f"b{i}", None if i % 5 == 0 else i, False) for i in range(40)], "blob_id string, expires_at int, expired boolean"), lambda old, new: old.unionByName(new))
    flush = J.expire_in(table)
    for epoch in (3, 3, 17):
        flush(spark.createDataFrame([(epoch,), (1,)], "epoch long"), 0)
        assert {r.blob_id for r in table.read().where("expired").collect()} == {f"b{i}" for i in range(epoch + 1) if i % 5}
    flush(spark.createDataFrame([], "epoch long"), 1)
    assert table.read().count() == 40


def test_moving_average_in_closed_form():
    costs, ema = np.array([0.5, 4.0, 2.0, 9.0]), 1.0
    for c in costs:
        ema = J.ALPHA * c + (1 - J.ALPHA) * ema
    weights = J.ALPHA * (1 - J.ALPHA) ** np.arange(3, -1, -1.0)
    assert abs((weights * costs).sum() + (1 - J.ALPHA) ** 4 - ema) < 1e-12
