"""Edges that the tables do not hold."""

import base64
import json
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blobsearch.functions import encode, files, hashing
from blobsearch.functions import ranges as R
from blobsearch.functions import vectors as V
from blobsearch.operators import catalog as C
from blobsearch.operators import listing
from blobsearch.sources import landing as L
from blobsearch.sources import paged
from blobsearch.sources import shared as H


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_zero_vector_stays(spark):
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_rounding_keeps_the_sign_of_zero(spark):
    x = [-3e-7, -0.0, 0.0, 3e-7, -5e-7, -1.25e-3, None, float("inf"), float("nan")]
    df = spark.createDataFrame([(x,)], "x array<double>")
    assert str(df.select(V.rounded("x").alias("x")).first().x) == "[-0.0, -0.0, 0.0, 0.0, -1e-06, -0.00125, None, inf, nan]"
    # vectors that are blended, cut and normalised to a component just below zero
    v = spark.createDataFrame([([-3e-7, 1.0], [-3e-7, 1.0])], "a array<double>, b array<double>")
    for c in (V.l2_normalize("a"), V.blend("a", "b"), V.reshape_dim("a", 2)):
        assert str(v.select(V.rounded(c).alias("x")).first().x) == "[-0.0, 1.0]"


def test_top_k_blocks_beyond_a_bound(spark, monkeypatch):
    from blobsearch.operators import search as S

    monkeypatch.setattr(S, "BROADCAST_ROWS", 20)  # no bound on queries
    monkeypatch.setattr(S, "BLOCK", 16, raising=False)
    monkeypatch.setattr(S, "ROWS", 5, raising=False)
    x = np.random.default_rng(4).standard_normal((90, 4)).round(1)
    x[20:50] = x[20]  # ties
    rows = [(f"b{i}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("short", [1.0]), ("none", None)], "blob_id string, embedding array<double>")
    got = S.top_k_blocks(df, df.select(F.col("blob_id").alias("query_id"), F.col("embedding").alias("q")), 6, 4).collect()
    sims = np.round(x @ x.T, 9)
    want = {(f"b{q}", f"b{i}", k + 1) for q in range(90) for k, i in enumerate(sorted(range(90), key=lambda i: (-sims[q, i], f"b{i}"))[:6])}
    assert {(r.query_id, r.blob_id, r["rank"]) for r in got} == want and len(got) == len(want)


def _sent(df):
    """Bytes that the shuffles of a query wrote, once it has run."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def _unit(n, dim=16):
    x = np.random.default_rng(n).standard_normal((n, dim))
    return [(f"b{i}", v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]


@pytest.mark.parametrize("search", ["top_k_blocks", "rank_of_own"])
def test_all_pairs_are_sent_in_proportion(spark, monkeypatch, search):
    from blobsearch.operators import search as S

    monkeypatch.setattr(S, "BLOCK", 16)
    sent = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with large tables
    for n in (200, 800):
        df = spark.createDataFrame(_unit(n), "blob_id string, embedding array<float>")
        q = df.select(F.col("blob_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(1.0).alias("own"))
        out = S.top_k_blocks(df, q, 3, 16) if search == "top_k_blocks" else S.rank_of_own(df, q, 16)
        assert len(out.collect()) == n * (3 if search == "top_k_blocks" else 1)
        sent.append(_sent(out))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < sent[1] < 5 * sent[0]


def test_rank_of_own_with_ties_in_any_block(spark, monkeypatch):
    from blobsearch.operators import search as S

    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "ROWS", 5)
    monkeypatch.setattr(S, "HELD", 9, raising=False)  # more blocks than BLOCKS
    x = np.random.default_rng(5).standard_normal((90, 4)).round(1)
    x[20:50] = x[20]  # ties
    y = x + 0.3 * x[:, ::-1]
    own = [float(a @ b) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame([*((f"b{i}", v.tolist()) for i, v in enumerate(x)), ("short", [1.0]), ("none", None)], "blob_id string, embedding array<double>")
    q = spark.createDataFrame([(f"b{i}", v.tolist(), o) for i, (v, o) in enumerate(zip(y, own, strict=True))], "query_id string, q array<double>, own double")
    got = {r.query_id: r["first"] for r in S.rank_of_own(df, q, 4).collect()}
    sims = np.round(y @ x.T, 9)
    assert got == {f"b{j}": 1 + sorted(range(90), key=lambda i: (-sims[j, i], f"b{i}")).index(j) for j in range(90)}
    found = S.top_k_blocks(df, q, 6, 4).collect()
    assert {(r.query_id, r.blob_id, r["rank"]) for r in found} == {(f"b{j}", f"b{i}", k + 1) for j in range(90) for k, i in enumerate(sorted(range(90), key=lambda i: (-sims[j, i], f"b{i}"))[:6])}


def test_active_modes(spark):
    df = spark.createDataFrame([("a", "31", True), ("b", "soon", False), ("c", None, None)], "blob_id string, end_epoch string, is_active boolean")
    ids = lambda mode: sorted(r[0] for r in df.where(C.is_active(30, mode)).collect())
    assert ids("strict") == ["a"] and ids("lenient") == ["a", "b", "c"] and ids("flag") == ["a"]


def test_upsert_repeated_batch_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1, "x")], "blob_id string, size long, status string")
    new = spark.createDataFrame([("a", 0, None, 1), ("b", 5, "y", 0), ("b", 6, "z", 1)], "blob_id string, size long, status string, seq int")
    rules = {"size": "positive", "status": "coalesce"}
    once = C.upsert(old, new, ["blob_id"], rules, "seq")
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 6, "z")]
    assert sorted(map(tuple, C.upsert(once, new, ["blob_id"], rules, "seq").collect())) == [("a", 1, "x"), ("b", 6, "z")]


def test_u256(spark):
    n = 2**200 + 12345
    want = base64.urlsafe_b64encode(n.to_bytes(32, "little")).decode().rstrip("=")
    df = spark.createDataFrame([(str(n),), ("x",), (None,), (str(1 << 256),)], "id string")
    assert [r[0] for r in df.select(files.u256_to_base64url("id")).collect()] == [want, None, None, None]


@pytest.mark.parametrize(("h", "kind"), [("", "empty"), ("FFFE", "audio"), ("FFD8FF00", "image"), ("C3A9", "text"), ("C3", "binary"), ("00", "binary"), ("474946383761", "image")])
def test_sniff(spark, h, kind):
    df = spark.createDataFrame([(h,)], "h string")
    assert df.select(files.sniff(F.col("h"), F.length("h") / 2)["kind"]).first()[0] == kind


def test_sniff_transport_stream(spark):
    raw = bytearray(564)
    raw[0] = raw[188] = raw[376] = 0x47
    df = spark.createDataFrame([(raw.hex().upper(),)], "h string")
    assert df.select(files.sniff(F.col("h"), F.length("h") / 2)["extension"]).first()[0] == "ts"


def test_grid_in_single_precision(spark):
    # in double, the product of the single 0.009 and 1000 is below 9; so is that of 0.011 and 1000 below 11
    from blobsearch.plans import judge

    x = np.float32([0.009, 0.011, -0.009, 0.5, 0.0, *np.random.default_rng(2).uniform(-1, 1, 59)])
    up = np.floor(np.abs(x) * np.float32(1000))
    assert (up > np.floor(np.abs(x).astype(float) * 1000)).any()
    df = spark.createDataFrame([(1, x.tolist())], "vec_id long, embedding array<float>")
    assert judge._grid(SimpleNamespace(embeddings=df)).first().px == [int(up[i % 64]) for i in range(72)]


def test_dhash_against_numpy(spark):
    px = [random.Random(1).randrange(256) for _ in range(72)]
    g = np.array(px).reshape(8, 9)
    bits = (g[:, 1:] > g[:, :-1]).ravel()
    want = int(np.packbits(bits).view(">i8")[0])
    assert spark.createDataFrame([(px,)], "px array<int>").select(hashing.dhash("px")).first()[0] == want


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(40)]
    rows = [(f"a{i}", h) for i, h in enumerate(base)] + [(f"b{i}", h ^ sum(1 << b for b in r.sample(range(62), i % 9))) for i, h in enumerate(base)]
    want = {(min(x, y), max(x, y)) for x, h in rows for y, g in rows if x < y and bin(h ^ g).count("1") <= 6}
    got = hashing.near_pairs(spark.createDataFrame(rows, "blob_id string, h long"))
    assert {(x.a, x.b) for x in got.collect()} == want


def test_near_hashes_of_small_numbers(spark):
    # multiples below 2**45: the highest bits are all zero, and no band may consist of them
    rows = spark.range(3000).select((F.col("id") * 2654435761).alias("h")).union(spark.range(60).select((F.col("id") * 2654435761).bitwiseXOR(F.lit(1 << 40 | 5)).alias("h")))
    near = hashing.near_hashes(rows)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    h = np.unique([i * 2654435761 for i in range(3000)] + [(i * 2654435761) ^ (1 << 40 | 5) for i in range(60)])
    want = {(int(a), int(b)) for i, a in enumerate(h) for b in h[i + 1 :][np.bitwise_count(h[i + 1 :] ^ a) <= 6]}
    assert want and {(x.ha, x.hb) for x in near.collect()} == want


def test_terms_are_counted_in_pieces(monkeypatch):
    from blobsearch.operators import textindex

    monkeypatch.setattr(textindex, "TERMS", 5)
    b = pa.record_batch({"t": [["x"], ["a"] * 3, [], ["b"] * 2, ["c"] * 9, ["d"], []], "n": list(range(7))}).slice(1)
    pieces = list(textindex._pieces(b))
    assert [p["n"].to_pylist() for p in pieces] == [[1, 2, 3], [4], [5, 6]]
    assert [len(p["t"].flatten()) for p in pieces] == [5, 9, 1]


def test_windows(spark):
    ends = lambda d: [(w.start, w.end) for w in one(spark, R.slide_windows(F.lit(d)))]
    assert ends(0.0) == [] and ends(3.0) == [(0, 3)] and ends(4.5) == [(0, 4), (2, 4.5)]
    assert one(spark, R.interval_iou(*map(F.lit, (0.0, 0.0, 0.0, 0.0)))) == 0


def test_known_streak_and_cursor(spark):
    r = random.Random(5)
    rows = [(f"b{i:03}", f"2024-01-{1 + i // 7:02d} 00:00:00", r.random() < 0.8) for i in range(150)]
    df = spark.createDataFrame(rows, "blob_id string, t string, known boolean").withColumn("first_seen_at", F.col("t").cast("timestamp")).drop("t")
    order = sorted(rows, key=lambda x: (-int(x[1][8:10]), x[0]))
    for streak in (3, 6, 400):
        want, run = [], 0
        for b, _, known in order:
            want.append(b)
            run = run + 1 if known else 0
            if run == streak:
                break
        assert sorted(x.blob_id for x in listing.until_known_streak(df, streak).collect()) == sorted(want)
    at = [x[0] for x in order].index("b050")
    assert {x.blob_id for x in listing.after_cursor(df, "b050").collect()} == {x[0] for x in order[at + 1 :]}
    assert listing.after_cursor(df, "none").count() == 150


def test_paged_source(spark, tmp_path):
    source = paged.paged_source(lambda p: [{"blobId": f"b{p}-{i}", "endEpoch": 40} for i in range(3 if p < 4 else 0)])
    spark.dataSource.register(source)
    df = spark.read.format("paged_listing").option("pages", 9).option("pages_per_task", 2).load()
    assert L.normalize_listing(df).select("blob_id").distinct().count() == 12


def test_payload_files(spark, tmp_path):
    (tmp_path / "q1__a.txt").write_bytes(b"abc")
    got = L.payloads(spark, f"file://{tmp_path}/*").first()
    assert (got.blob_id, bytes(got.content), got.size) == ("q1::a.txt", b"abc", 3)


def test_versions(spark):
    table = H.VersionedTable(spark, H.new_path(spark, "t"))
    assert table.read() is None
    for n in range(3):
        table.replace(spark.range(n + 1), backups=1)
    assert table.read().count() == 3 and len(table._versions()) == 2


def test_encoder_plugs_in(spark):
    df = spark.createDataFrame([("a", "xy" * 30), ("b", "")], "blob_id string, text string")
    out = encode.encode(df, "blob_id", "text", lambda texts: np.array([[len(x), 1.0] for x in texts]), 20, 5).collect()
    assert [r.blob_id for r in out] == ["a"] and abs(sum(x * x for x in out[0].embedding) - 1) < 1e-9


def test_listing_prefers_named_keys(spark):
    item = json.dumps({"blobIdBase64": "", "blob_id": "b", "size": 0, "blob_size": 9, "end_epoch": "x"})
    got = L.normalize_listing(spark.createDataFrame([(item,), ("{broken",)], "item string")).collect()
    assert [(r.blob_id, r.size, r.end_epoch) for r in got] == [("b", 9, None)]
