"""Clusters, the cell index, duplicate classes and file types against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blobsearch.functions import files, hashing
from blobsearch.operators import judge as J
from blobsearch.operators import learned as L
from blobsearch.operators.components import components


def blobs(spark, n, dim=8, centres=12, seed=3):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, dim))
    x = c[r.integers(0, centres, n)] + 0.05 * r.standard_normal((n, dim))
    return x, spark.createDataFrame([(f"b{i}", v.tolist()) for i, v in enumerate(x)], "blob_id string, embedding array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_mini_batches_against_a_plain_loop(spark):
    x, df = blobs(spark, 600)
    x = unit(x)
    hashes = lambda *more: np.array([r.h for r in df.select(F.xxhash64(F.col("blob_id"), *map(F.lit, more)).alias("h")).collect()])
    k, batch, rounds = 6, 200, 5
    best = None
    for start in range(3):
        order = sorted(range(600), key=lambda i, h=hashes(42 + start): (h[i], f"b{i}"))
        c, given = x[order[:k]].copy(), np.zeros(k)
        for step in range(rounds):
            taken = x[hashes(42, step) % 3 == 0]
            label = ((taken[:, None] - c[None]) ** 2).sum(2).argmin(1)
            for j in range(k):
                mine = taken[label == j]
                if len(mine):
                    given[j] += len(mine)
                    c[j] += (mine.sum(0) - len(mine) * c[j]) / given[j]
        inertia = ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()
        if best is None or inertia < best[0]:
            best = inertia, c
    rows = df.select(F.col("blob_id").alias("id"), L.V.l2_normalize("embedding").alias("v")).repartition(5)
    got = L.kmeans_centres(rows, k, rounds=rounds, batch=batch)
    assert np.abs(got - best[1]).max() < 1e-9


def test_kmeans_finds_the_groups(spark):
    x, df = blobs(spark, 500, centres=4, seed=9)
    out = {r.blob_id: r.cluster_id for r in L.kmeans(df, 12).collect()}
    c = unit(x) @ unit(x).T
    # rows of one cluster are of one group
    assert len(out) == 500 and all(c[i, j] > 0.9 for i in range(0, 500, 7) for j in range(500) if out[f"b{i}"] == out[f"b{j}"])
    with pytest.raises(ValueError):
        L.kmeans(df.limit(20), 12)


@pytest.mark.parametrize(("n", "k", "share"), [(3000, 10, 0.3), (7, 10, 1.0)])
def test_cell_index_is_exact_and_reads_little(spark, n, k, share):
    x, df = blobs(spark, n, centres=40)
    odd = spark.createDataFrame([("none", None), ("zero", [0.0] * 8)], df.schema)
    index = L.CellIndex(df.union(odd), cells=32)
    q, asked = x[:25] + 0.01, None
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, q array<double>")
    top, read = index.top_k(asked, k)
    sims = unit(q) @ np.vstack([unit(x), np.zeros(8)]).T
    names = [*(f"b{i}" for i in range(n)), "zero"]
    want = {(f"q{i}", names[j]) for i in range(len(q)) for j in sorted(range(n + 1), key=lambda j, i=i: (-sims[i, j], names[j]))[:k]}
    got = {(r.query_id, r.blob_id) for r in top.collect()}
    assert len(got & want) / len(want) >= 0.999 and len(got) == len(want)
    assert read.count() <= share * len(q) * (n + 1)


def test_components_against_a_plain_search(spark):
    r = random.Random(5)
    links = [(f"n{r.randrange(400)}", f"n{r.randrange(400)}") for _ in range(260)] + [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("hub", f"s{i}") for i in range(200)] + [("x", "x")]
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            m = todo.pop()
            if m not in want:
                want[m] = node
                todo += near[m]
    got = components(spark.createDataFrame(links, "a string, b string")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_duplicate_classes(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(30)]
    rows = [(f"a{i:02}", h) for i, h in enumerate(base)] + [(f"b{i:02}", h ^ sum(1 << b for b in r.sample(range(62), i % 9))) for i, h in enumerate(base)]
    rows += [(f"c{i:02}", base[i] ^ 0b1111 ^ (0b11111 << 20)) for i in range(5)] + [(f"same{i}", base[0]) for i in range(3000)] + [("none", None)]
    h = dict(rows)
    ids = [x for x in h if h[x] is not None and not x.startswith("same")]
    near = {x: {y for y in ids if h[x] != h[y] and bin(h[x] ^ h[y]).count("1") <= 6} for x in ids}
    got = {x.blob_id: x for x in J.duplicate_classes(spark.createDataFrame(rows, "blob_id string, h long")).collect()}
    assert len(got) == len(ids) + 3000
    for x in ids:
        seen, todo = set(), [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += [z for z in ids if h[z] == h[y] or z in near[y]]
        assert got[x].class_id == min(seen) and got[x].links == len({h[y] for y in near[x]})
    assert got["same7"].class_id == got["a00"].class_id and got["a00"].copies >= 3001
    pairs = hashing.near_pairs(spark.createDataFrame(rows, "blob_id string, h long"))
    assert pairs.where("a = 'a00' and distance = 0").count() >= 3000 and pairs.count() < 3200


def sniffed(spark, h):
    return spark.createDataFrame([(h,)], "h string").select(files.sniff(F.col("h"), F.length("h") / 2)["extension"]).first()[0]


def test_sniff_keeps_to_byte_borders(spark):
    text = lambda s: s.encode().hex().upper()
    webm = text("webm")
    assert sniffed(spark, "1A45DFA3" + "0" + webm + "0") == "mkv" and sniffed(spark, "1A45DFA3" + "0" + webm + "0" + webm) == "webm"
    assert sniffed(spark, "0000001C" + text("ftypAVIF")) == "avif"
    isom = "0000001C" + text("ftypisom")
    assert sniffed(spark, isom + text("hdlr") + "0" + text("soun") + "0") == "mp4"
    assert sniffed(spark, isom + text("hdlr") + text("soun")) == "m4a" and sniffed(spark, isom + text("hdlrsounvide")) == "mp4"
    late = "00" * 40 + "0" + text("ftypheic") + "0" + text("ftypM4A ")
    assert sniffed(spark, late) == "m4a"
    assert sniffed(spark, "00000018" + text("free") + "00" * 16 + "0000001C" + text("ftypheic")) == "heic"
