"""Ranked search, filter audit, toxicity, and edges of top-k search and decontamination, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blobsearch.llm import audit, decontaminate, ranked, store, textnum, topk, toxicity
from llm import brute


def clashing(df):
    """Columns whose names the operators use themselves."""
    for c in ("part", "same", "fails", "slot", "key", "good", "toxic", "n", "term", "score", "rank", "held_out", "top", "mean", "label", "own"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def plain_audit(rows, labels):
    """{(part, order, step): the seven counts}"""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first, parts = {}, defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, t, p in rows:
        t = t or ""
        w = brute.SPACE_WORD.findall(t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and first[t] < d), strict=True) if x}
        parts[p or ""].append((d, fails))
    out = {}
    for p, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone, before = [x for x in left if f in x[1]], left
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[p, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[1] for x in docs) - sum(f in x[1] for x in before), sum(x[1] == {f} for x in docs), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (q, order, k), v in out.items():
            if q == p:
                v.append(shapley[order[k - 1]])
    return out


def test_audit(spark):
    r = random.Random(5)
    pool = ["a", "B", "cc#", "dé", "EE", "f$g", "x" * 9]
    rows = []
    for i in range(120):
        text = " ".join(r.choice(pool[: r.randrange(1, 8)]) if r.random() < 0.5 else f"w{r.randrange(500)}" for _ in range(r.choice((3, 150, 199, 200, 260))))
        rows.append((i, text, r.choice(("en", "de", None, ""))))
    rows += [(200 + i, rows[i % 7][1], "en") for i in range(30)]  # copies
    rows += [(3, rows[3][1], "en"), (None, rows[3][1], "en"), (None, None, None), (None, None, "fr"), (300, "", "en"), (301, None, "de"), (302, " \t", "en"), (303, "W" * 50_000 + " é" * 40_000, "en")]
    labels = [(d, r.choice((0, 1, None)), r.choice((0, 1, None))) for d, *_ in rows if r.random() < 0.6] + [(None, 1, 1), (999, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in audit.audit(docs, table).collect()}
    assert got == plain_audit(rows, labels)
    assert audit.audit(docs.limit(0), table).count() == 0
    assert audit.audit(docs, table.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def plain_ranked(rows, items, k):
    terms = {i: brute.TERM.findall(brute.lower(t or "")) for i, (d, t) in enumerate(rows) if d is not None}
    terms = {i: w for i, w in terms.items() if w}
    n_docs, n_terms = len(terms), sum(map(len, terms.values()))
    df = Counter(t for w in terms.values() for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(brute.TERM.findall(brute.lower(t or "")))
    out = set()
    for item, words in asked.items():
        found = []
        for i, w in terms.items():
            tf, m = Counter(w), 100 - 90 + (90 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words if tf[t])
            if score > 0:
                found.append((-score, rows[i][0]))
        out |= {(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize(("shard", "passes"), [(40, 10**6), (16384, 9)])
def test_ranked_search(spark, monkeypatch, shard, passes):
    r = random.Random(9)
    vocab = [f"t{i}" for i in range(60)]
    zipf = lambda n: " ".join(vocab[min(int(r.paretovariate(0.7)) - 1, 59)] for _ in range(n))
    rows = [(i, zipf(r.randrange(1, 120))) for i in range(400)]
    rows += [(500 + i, rows[11][1].upper()) for i in range(30)]  # ties
    rows += [(11, rows[11][1]), (None, "t1 t2"), (600, None), (601, ""), (602, "?!"), (603, "t3 " * 70_000 + "é" * 300), (604, "t5_t6@t7" * 400)]
    items = [(i, zipf(r.randrange(1, 15))) for i in range(25)] + [(50, "t1 T1 t2"), (50, "t59"), (51, None), (None, "t1"), (52, "unseen"), (53, "é" * 300), (54, " ".join(vocab))]
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked, "BLOCK", 8)
    monkeypatch.setattr(ranked, "FIRST", 16)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = ranked.ranked_search(docs, asked, 10, pass_terms=passes)
    assert {(x.item_id, x["rank"], x.doc_id, x.score) for x in got.collect()} == plain_ranked(rows, items, 10)
    assert ranked.ranked_search(docs.limit(0), asked).count() == 0 and ranked.ranked_search(docs, asked.limit(0)).count() == 0
    named = asked.withColumn("item_id", F.concat(F.lit("q"), F.col("item_id")))
    assert {(x.item_id, x.score) for x in ranked.ranked_search(docs, named, 1).collect()} == {(f"q{i}", s) for i, k, _, s in plain_ranked(rows, items, 1)}


def test_blocks_round_trip_and_are_skipped():
    r = np.random.default_rng(3)
    n = 3000
    words = [r.integers(0, 300, r.integers(1, 80)) ** 2 % 300 for _ in range(n)]
    doc = np.repeat(np.arange(n), [len(w) for w in words])
    h = textnum.mix(np.concatenate(words).astype(np.uint64) + np.uint64(1))
    lengths = np.array([len(w) for w in words])
    lengths[7] += 5_000_000  # a width of four bytes is stored too
    h, doc = np.concatenate([h[doc <= 7], np.full(70_000, h[0]), h[doc > 7]]), np.concatenate([doc[doc <= 7], np.full(70_000, 7), doc[doc > 7]])
    s = ranked.build_shard(np.arange(n), lengths, h, doc)
    shard = ranked.Shard({k: s[k].astype(t).tobytes() for k, t in ranked._PARTS.items()}, n, int(lengths.sum()))
    for term in np.unique(h)[:40]:
        docs, impact = shard.all_of(int(shard.find(np.array([term]))[0]))
        tf = np.bincount(doc[h == term], minlength=n)
        assert (docs == np.flatnonzero(tf)).all() and (impact == shard.impact(tf[docs], shard.m[docs])).all()
    terms, counts = np.unique(h, return_counts=True)
    rare, common = terms[np.argsort(counts)[:1]], terms[np.argsort(counts)[-6:]]
    query = np.sort(np.concatenate([rare, common]))
    weights = np.where(query == rare[0], 9000, 10)
    best = ranked.Heap(3)
    ranked.search_shard(shard, query, weights, best, first=64)
    # a heap that earlier shards have filled: common lists are read where the rare one leaves candidates
    shard.whole.clear()
    shard.decoded = 0
    again = ranked.Heap(3)
    again.push(best.score, best.ids)
    ranked.search_shard(shard, query, weights, again)
    lists = shard.find(query)
    assert 0 < shard.decoded < 0.5 * sum(int(shard.list_start[j + 1] - shard.list_start[j]) for j in lists)
    assert set(again.score.tolist()) <= set(best.score.tolist())


def test_toxicity_gradients():
    seg = next(textnum.segments(pa.array(["you are a clown réeuxpa", "", "a b c " * 20, "x"]), textnum.NOT_WORD, lower=True))
    types = toxicity.Types(seg)
    _, idx = toxicity.window_types(seg, types)
    net = toxicity.Network(1)
    r = np.random.default_rng(2)
    net.p = {k: r.standard_normal(v.shape) * 0.3 for k, v in net.p.items()}
    y = np.arange(len(idx)) % 2.0
    _, g = net.gradients(types, idx, y)
    for name, v in net.p.items():
        for i in np.argsort(-np.abs(g[name]).ravel())[:3]:
            old, e = v.flat[i], 1e-5
            v.flat[i] = old + e
            up, _ = net.gradients(types, idx, y)
            v.flat[i] = old - e
            down, _ = net.gradients(types, idx, y)
            v.flat[i] = old
            assert abs((up - down) / (2 * e) - g[name].flat[i]) < 1e-5 + 1e-2 * abs(g[name].flat[i])


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 56, 57, 1000])
    of, at = toxicity.windows_of(counts)
    for k, n in enumerate(counts):
        starts = at[of == k]
        assert set(range(n)) <= {p for a in starts for p in range(a, a + toxicity.SPAN)} and len(starts) >= 1
        assert all(b - a <= toxicity.STEP for a, b in zip(starts, starts[1:], strict=False)) and (n < toxicity.SPAN or starts[-1] + toxicity.SPAN == n)


def plain_logit(net, words):
    """A window's logit, word by word."""
    h, p = toxicity.HIDDEN, net.p
    bytes_of = [w.encode() for w in words]
    x = []
    for w in bytes_of:
        seg = next(textnum.segments(pa.array([w.decode()]), textnum.NOT_WORD, lower=True))
        grams = [textnum.mix(np.array([int.from_bytes(b, "little") + g], np.uint64))[0] % np.uint64(toxicity.GRAM_BUCKETS) for g in toxicity.GRAMS for i in range(len(w) + 3 - g) if len(b := (b"\0" + w + b"\0")[i : i + g]) == g]
        x.append(np.concatenate([p["word"][int(seg.word_hashes()[0] % np.uint64(toxicity.WORD_BUCKETS))], sum(p["gram"][int(g)] for g in grams) / len(grams) ** 0.5]))
    sig = lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for k in (0, 1):
        state, out = np.zeros(h), []
        for v in x if k == 0 else x[::-1]:
            a, b = v @ p["wx"][k] + p["bx"][k], state @ p["u"][k]
            z, r = sig(a[:h] + b[:h]), sig(a[h : 2 * h] + b[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * b[2 * h :])
            state = new + z * (state - new)
            out.append(state)
        sides.append(out if k == 0 else out[::-1])
    if not x:
        return p["bias"][0]
    seen = np.concatenate([np.array(sides[0]), np.array(sides[1])], 1)
    e = np.exp(np.tanh(seen @ p["wa"]) @ p["va"])
    return (e / e.sum()) @ seen @ p["out"] + p["bias"][0]


def test_network_against_a_plain_loop():
    r = np.random.default_rng(4)
    net = toxicity.Network(1)
    net.p = {k: r.standard_normal(v.shape) * 0.3 for k, v in net.p.items()}
    texts = ["one Two three", "", "wörd " * 40, "k"]
    seg = next(textnum.segments(pa.array(texts), textnum.NOT_WORD, lower=True))
    of, logit = net.score(seg)
    _, at = toxicity.windows_of(seg.words)
    for o, a, v in zip(of, at, logit, strict=True):
        words = brute.TERM.findall(brute.lower(texts[o]))[a : a + toxicity.SPAN]
        assert abs(plain_logit(net, words) - v) < 1e-6


@pytest.fixture(scope="module")
def marked():
    r = random.Random(3)
    clean, bad = [f"word{i}" for i in range(300)], ["vileword", "foulterm", "nastybit"]
    rows, labels = [], []
    for i in range(500):
        y = i % 4 == 0
        text = " ".join(r.choice(bad) + r.choice(("", "er", "ing")) if y and r.random() < 0.06 else r.choice(clean) for _ in range(r.randrange(60, 300)))
        rows.append((i, text))
        labels.append((i, int(y)))
    return rows, labels


def test_toxicity_held_out(spark, marked, monkeypatch):
    monkeypatch.setattr(toxicity.Network.train, "__defaults__", (80, 0))
    rows, labels = marked
    extra = [(None, rows[0][1]), (0, rows[0][1]), (900, None), (901, ""), (902, rows[0][1] + " " + "x" * 300_000 + " calm" * 30_000)]
    docs = clashing(spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(3))
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (901, 7)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, table).toPandas()
    truth = dict(labels)
    held = out[out.held_out & out.doc_id.notna() & (out.doc_id < 500)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.93 and len(out) == len(rows) + len(extra)
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    same = out[(out.doc_id == 0) | out.doc_id.isna()]
    assert same.score.nunique() == 1 and same[same.doc_id.isna()].held_out.all()
    assert out[out.doc_id == 902].n_windows.iloc[0] > 1000 and out[out.doc_id.isin([900, 901])].score.nunique() == 1


def test_toxicity_without_labels(spark, marked):
    docs = spark.createDataFrame(marked[0][:10], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.5] * 10
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("proximity", [True, False])
def test_short_benchmark_items(spark, proximity):
    texts = ["a", "a a", " ".join("bcdefghijklm"), " ".join("bcdefghijklmn"), " ".join("bcdefghijklmno"), ""]
    rows = [(1, "x a y"), (2, "q a a a"), (3, "z " + texts[3] + " n o"), (4, " ".join(texts[4].split()[::-1])), (5, None), (6, texts[4] + " a " + texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for some in ([0], [1], [2], [3], [4], range(6)):
        items = [(i, texts[i]) for i in some]
        got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), proximity=proximity).collect()}
        assert got == brute.contamination(rows, items)


def test_short_item_in_the_stage(spark, sf_dir, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "zz yy")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a"), (2, "b " * 30), (3, "zz yy zz")], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(spark, docs, f"file://{tmp_path}").collect()} == {2}


@pytest.mark.parametrize("odd", [None, 50.0, 1e8, -1e17])
def test_topk_with_a_far_off_component(spark, odd):
    x = np.random.default_rng(1).standard_normal((1200, 16)) * 0.125
    if odd:
        x[[50, 60, 61], 3] = odd, odd, -odd
    rows = [*enumerate(x.tolist()), (1200, []), (1201, []), (1250, [1.0, 2.0]), (1251, [0.5, 0.5])]
    vectors = store.settle(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "v")
    lim = 2**63
    v = {i: [max(min(math.floor(256 * c), lim - 1), -lim) for c in e] for i, e in rows}
    want = set()
    for q in range(0, 1300, 50):
        if q in v:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:5]
            want |= {(q, k + 1, c, max(min(-s, lim - 1), -lim)) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()} == want


@pytest.mark.parametrize("odd", [None, 50.0, 1e8])
def test_far_off_component_leaves_few_candidates(spark, odd):
    x = np.random.default_rng(2).standard_normal((4000, 64)) * 0.125
    if odd:
        x[7, 3] = odd
    vectors = store.settle(topk.integer_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")), "v")
    lo, hi = topk.grids(vectors)[64]
    v = np.floor(256 * x)
    cell = np.stack([np.searchsorted(lo[k, 1:], v[:, k], side="right") for k in range(64)], 1).astype(np.uint8)
    assert all((lo[k][cell[:, k]] <= v[:, k]).all() and (v[:, k] <= hi[k][cell[:, k]]).all() for k in range(64))
    ids = np.arange(4000)
    found = topk.bounded_candidates(ids, cell, ids[::50], v[::50], lo, hi, 5)
    assert np.bincount(found[0]).max() < 50


def executions(spark):
    """Ids of the SQL executions that Spark still has a record of."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    known = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {known.apply(i).executionId() for i in range(known.size())}


def broadcasts(spark, ids):
    """MB of the broadcasts of these SQL executions."""
    status, out = spark._jsparkSession.sharedState().statusStore(), []
    for e in ids:
        nodes, values = status.planGraph(e).allNodes(), status.executionMetrics(e)
        for n in (nodes.apply(i) for i in range(nodes.size())):
            for m in (n.metrics().apply(i) for i in range(n.metrics().size())):
                if n.name() == "BroadcastExchange" and m.name() == "data size" and values.contains(m.accumulatorId()):
                    size, unit = values.apply(m.accumulatorId()).split()
                    out.append(float(size.replace(",", "")) * {"B": 1e-6, "KiB": 2**10 / 1e6, "MiB": 2**20 / 1e6, "GiB": 2**30 / 1e6}[unit])
    return out


def test_topk_broadcasts_no_copies_of_queries(spark, monkeypatch):
    # with few vectors of a block, queries once for each block would be over 40 MB
    monkeypatch.setattr(topk, "VECTORS", 4)
    x = np.random.default_rng(3).standard_normal((4000, 64)) * 0.125
    vectors = store.settle(topk.integer_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")), "v")
    before = max(executions(spark))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()}
    sizes = broadcasts(spark, {e for e in executions(spark) if e > before})
    assert sizes and max(sizes) < 10
    v = np.floor(256 * x).astype(int)
    for q in range(0, 4000, 50):
        s = v @ v[q]
        assert [got[q, k + 1] for k in range(5)] == [(i, s[i]) for i in sorted((i for i in range(4000) if i != q), key=lambda i: (-s[i], i))[:5]]


@pytest.mark.parametrize("held", [524_288, 20])
def test_topk_pairs_meet_once(spark, monkeypatch, held):
    monkeypatch.setattr(topk, "HELD", held)
    file = spark.range(600).select(F.lit(1).alias("dim"), F.col("id").alias("vec_id"), F.lit(b"a").alias("cell"))
    asked = spark.range(0, 600, 50).select(F.lit(1).alias("dim"), F.col("id").alias("vec_id"), F.array(F.col("id")).alias("v"))
    blocks = max(16, -(-600 // held))
    rows = topk.pairs(file, asked)
    assert rows.rdd.getNumPartitions() == blocks * 4 and rows.count() == 600 * 4 + 12 * blocks
    met = Counter()
    for part in rows.rdd.glom().collect():
        kinds = [r.asks for r in part]
        assert kinds == sorted(kinds)
        met.update((q.vec_id, v.vec_id) for q in part if q.asks for v in part if not v.asks)
    assert len(met) == 600 * 12 and set(met.values()) == {1}


def test_topk_grid_is_of_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(topk, "GRID", 16)
    x = np.random.default_rng(4).integers(-99, 99, (3000, 4))
    rows = [*((i, 4, v) for i, v in enumerate(x.tolist())), (3000, 2, [5, 6]), (3001, 0, [])]
    vectors = store.settle(spark.createDataFrame(rows, "vec_id long, dim int, v array<long>").repartition(8), "v")
    grid = topk.grids(vectors, 8)
    first = [r.vec_id for r in vectors.where("dim = 4").orderBy(F.xxhash64("vec_id", F.lit(3))).limit(16).collect()]
    lo, hi = grid[4]
    assert set(grid) == {0, 2, 4} and (lo[:, 1:] == np.floor(np.quantile(x[first].astype(float), np.arange(1, 8) / 8, axis=0)).T).all()
    assert (lo[:, 0] == x.min(0)).all() and (hi[:, -1] == x.max(0)).all()
    assert (grid[2][0][:, 0] == [5, 6]).all()
