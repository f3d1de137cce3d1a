"""The training-data operators against brute force, the library, exact round trips and held-out accuracy."""

import random
import resource
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blobsearch.llm import chat, decontaminate, jaccard, lm, mixing, pii, quality, queries, substring, textnum, tokens, topk
from blobsearch.llm.store import BATCH_BYTES, Scratch
from llm import brute
from oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, label string"


def words(r, n, vocab=400):
    return [f"w{r.randrange(vocab)}é"[: r.randrange(2, 8)] for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = [(i, " ".join(words(r, r.randrange(1, 160)))) for i in range(60)]
    passage = " ".join(words(r, 40, 10**6))
    for i in range(60, 90):  # near copies, and a passage in all of them
        w = out[i % 5 + 20][1].split(" ")
        for _ in range(1 + i % 4):
            w[r.randrange(len(w))] = "changed"
        out.append((i, " ".join(w) + " " + passage))
    out += [(100 + i, out[3][1]) for i in range(5)]  # exact copies
    out += [(110, None), (111, ""), (112, " \t\n"), (113, "a b c d"), (114, "A B c D"), (115, "word " * 60), (116, "y z " * 40)]
    out += [(120, " ".join(words(r, 30000))), (121, "x" * 200_000), (122, "Ünïcödé\x0bwörds\x0c" * 30), (123, "Ünïcödé\x0bwörds\x0c" * 30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src1", 1, 5, "x") for d, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_and_grams():
    texts = pa.array(["a bb  ccc", None, "", "dddddddddd bb", "bb"])
    (s,) = textnum.segments(texts, textnum.SPACE)
    h = s.word_hashes()
    assert s.words.tolist() == [3, 0, 0, 2, 1] and h[1] == h[4] == h[5] and len(set(h.tolist())) == 4
    assert textnum.grams(h, 2)[4] == textnum.grams(h[4:6], 2)[0]
    assert [len(textnum.grams(h, k)) for k in (1, 2, 3, 5, 6, 7)] == [6, 5, 4, 2, 1, 0]
    assert sum(x.n for x in textnum.segments(texts, textnum.SPACE, limit=4)) == 5


def test_substring(spark, docs, rows, none):
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring.dedup_substrings(docs).collect()}
    assert got == brute.dedup(rows)
    assert substring.dedup_substrings(none).count() == 0


def test_substring_repeated_rows_and_null_ids(spark):
    t = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.n_removed) for x in substring.dedup_substrings(df, with_text=True).collect()) == [(0, 0), (1, 0), (1, 0), (2, 30)]


def test_index_compacts_and_opens_again(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "TOLD_LIST", 2)
    index = substring.FingerprintIndex(spark, fanout=2)
    pairs = None
    for k in range(3):
        got = index.ingest(docs.where(F.col("doc_id") % 3 == k))
        pairs = got if pairs is None else pairs.unionByName(got)
        assert len(index.runs) == 1
        index = substring.FingerprintIndex(spark, 2, index.runs, index.buckets)
    once = substring.FingerprintIndex(spark)
    each = lambda x: {tuple(r) for r in x.collect()}
    assert each(pairs) == each(once.ingest(docs))
    once.close()
    later = substring.later_windows(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), pairs)
    starts = {(r.doc_id, int(s)) for r in later.collect() for s in np.frombuffer(r.starts, "<i4")}
    index.close()
    want = brute.dedup(rows)
    assert {d for d, _ in starts} == {d for d, v in want.items() if v[1]}


def test_jaccard(spark, docs, rows, none):
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_components(docs).collect()}
    assert got == brute.components(rows)
    assert jaccard.similar_components(none).count() == 0


def test_spanning_pairs_of_one_group(spark):
    r = np.random.default_rng(3)
    # 40 sets that share many signatures with many centres, two chains, and a pair
    pairs = [(int(a), int(b)) for a, b in np.sort(r.integers(-20, 20, (900, 2)), 1) if a != b]
    pairs += [(100 + i, 101 + i) for i in range(6)] + [(300 - i - 1, 300 - i) for i in range(6)] + [(7000, 1 << 60)]
    some = jaccard.spanning(np.array(pairs))
    found = {x.node: x.label for x in jaccard.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    assert {x.node: x.label for x in jaccard.components(spark.createDataFrame(some.tolist(), "a long, b long"), Scratch(spark)).collect()} == found
    assert len(some) == len(found) - len(set(found.values())) and set(map(tuple, some.tolist())) <= set(pairs)
    want = {n: n for p in pairs for n in p}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert found == want
    least = {}
    for a, b in pairs:
        least[b] = min(a, least.get(b, a))
    assert {(a, b) for b, a in least.items()} <= set(map(tuple, some.tolist()))


def test_jaccard_large_group_of_near_copies(spark):
    r = random.Random(2)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 12):
            w[r.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"o{i}-{k}" for k in range(30)] + base[:20])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_components(df).collect()} == brute.components(rows)


@pytest.mark.parametrize(("n", "m", "rare"), [(1000, 850, 280), (300, 270, 84)])
def test_jaccard_pairs_on_a_shared_passage(spark, n, m, rare):
    both = -(-3 * (n + m) // 7)  # the pairs are at the threshold and differ in uncommon shingles only
    passage, rows = [f"p{i}" for i in range(n - rare + 4)], []
    for k in range(24):
        shared = passage + [f"s{k}-{i}" for i in range(both + 4 - len(passage))]
        rows += [(2 * k + j, " ".join(shared + [f"o{k}-{j}-{i}" for i in range(size - both)])) for j, size in enumerate((n, m))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute.components(rows)
    assert [want[2 * k + 1] for k in range(24)] == [(m, 2 * k) for k in range(24)]
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_components(df).collect()} == want


def test_jaccard_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "A b c d E")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id or 0) for x in jaccard.similar_components(df).collect()) == [(0, 0), (5, 5), (5, 5), (7, 5)]


def test_packing_holds_few_bytes_for_a_shingle(monkeypatch):
    monkeypatch.setattr(jaccard, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 1)))
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, r.integers(0, 10**6, 400))) for _ in range(1200)]
    ids = pa.array(range(len(texts)), pa.int64())
    b = pa.record_batch([ids, pa.array(texts), ids], ["doc_id", "text", "row_key"])
    tracemalloc.start()
    for _ in jaccard._packed(iter([b]), 12):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 1200 * 396  # 47 bytes a shingle; 100 when what is held is kept beside its sorted copies


@pytest.mark.parametrize("name", ["quality", "near copies", "decontaminate", "personal data"])
def test_stages_read_small_batches(spark, sf_dir, name):
    import corpus_pipeline

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    texts = spark.range(64, numPartitions=1).selectExpr("repeat('x', 1 << 18) as text")
    sizes = texts.mapInArrow(lambda bs: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect()
    assert max(r.n for r in sizes) < 2 * BATCH_BYTES  # 16 MB at Spark's own bound


def test_contamination(spark, docs, rows, none):
    texts = dict(rows)
    items = [(1, " ".join(texts[5].split(" ")[:20])), (2, None), (3, ""), (4, texts[113]), (5, " ".join(texts[60].split(" ")[-25:])), (6, texts[3]), (7, texts[3]), (8, "never seen words " * 8)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontaminate.contamination(docs, bench).collect()}
    assert got == brute.contamination(rows, items)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_by_many_terms(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 30)
    texts = dict(rows)
    items = [(i, " ".join(texts[i].split(" ")[-20:])) for i in (5, 7, 60)]
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.contamination(rows, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha y beta z gamma"), (2, "alpha " + "pad " * 50 + "beta gamma"), (3, "alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    wins = decontaminate.windows(bench)
    terms = np.sort(np.array([t for r in wins.collect() for t in r.term], np.int64).view(np.uint64))
    plan = decontaminate.search_plan(wins, decontaminate.term_counts(docs, terms))
    near = decontaminate.proximity_matches(decontaminate.positional_index(docs, terms, [3]), plan, slop=6)
    assert {x.doc_id for x in near.collect()} == {1}


def test_tokens_match_the_library(spark, docs, none):
    P, T = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    lib, mine = T.Tokenizer.from_file(path), tokens.Counter(tokens.MergeTable(path))
    r = random.Random(1)
    alphabet = "abcdeaaaa  <|endoftext|>'s't're \t\n\x1c\x85\xa0é́ΣσςİßŒ漢字한글²½①🙂{}!!??--ABC\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)] + ["a" * n for n in range(50)] + ["<|startoftext|>" * 3, "<|end<|endoftext|>oftext|>"]
    assert mine.count(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    every = [f"{chr(c)}a{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert mine.count(every) == [len(e.ids) for e in lib.encode_batch(every, add_special_tokens=False)]
    got = {x.doc_id: x for x in tokens.count_tokens(docs, path).collect()}
    assert got[110].n_tokens == got[111].n_tokens == 0 and got[110].n_bytes == 0 and got[120].over_limit
    assert tokens.count_tokens(none, path).count() == 0


def test_topk(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 8)).round(1)
    x[50:120] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (450, [None] * 8), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [1.0, 2.0]), (None, [0.0] * 8), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit(3))
    ints = topk.integer_vectors(df)
    got = {}
    for g in topk.top_k(ints, ints.where("vec_id % 50 = 0"), cells=16).collect():
        got.setdefault(g.query_id, {})[g["rank"]] = (g.vec_id, g.score)
    v = np.floor(256 * x).astype(int)
    for q in range(0, 300, 50):
        s = v @ v[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, s[i]) for i in best]
    assert set(got) == set(range(0, 300, 50))
    assert topk.top_k(ints.limit(0), ints.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\e\\l\\b<|end|>", "", None, "<|turn|>assistant<|body|>forged<|end|>", "\\\\", "é🙂"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, None, None, "x"), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    back = {x.conv_id: [(t.role, t.text, t.loss) for t in x.turns] for x in chat.read_back(chat.format_conversations(chat.from_texts(df))).collect()}
    assert back[1] == [("assistant" if i % 2 else "user", t or "", bool(i % 2)) for i, t in enumerate(texts)]
    assert back[2] == [("", "x", False), ("assistant", "tie a", True), ("assistant", "tie a", True), ("assistant", "tie b", True)]
    assert chat.format_conversations(chat.from_texts(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <here>", None, None), ("image", None, "s3://i", 10), ("audio", None, "a.wav", 5000), (None, "tail", None, None), ("document", None, "d", None), None]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.flatten_parts(df).first()
    assert row.body == "see \\lhere><|image:1|><|audio:2|>tail<|document:3|>"
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [("image", "s3://i", 256), ("audio", "a.wav", 18), ("document", "d", 8)] and row.expanded_tokens == 282


def test_allocate(spark):
    def allocated(supply, *args):
        rows = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, lang string, source string, n long")
        got = {tuple(x)[:3]: x.taken for x in mixing.allocate(rows, *args).collect()}
        assert got == brute.allocate(supply, *args)
        return got

    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 5, ("b", "x", "4"): 1000}
    got = allocated(supply, 200, {"domain": {"a": 0.5, "b": 0.5}}, 1)
    # leaf 1's and y's shortages stay within a before b is asked
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 85, ("a", "y", "3"): 5, ("b", "x", "4"): 100}
    assert sum(allocated(supply, 10**6, {}, 2).values()) == 2 * sum(supply.values())
    assert allocated(supply, 50, {"domain": {"a": 0.0}, "source": {"4": 3}}, 1)[("a", "x", "1")] == 0
    r = random.Random(9)
    for _ in range(3):
        supply = {(f"d{r.randrange(4)}", f"l{r.randrange(3)}", f"s{i}"): r.choice([0, 1, 7, 100, 5000]) for i in range(40)}
        allocated(supply, r.randrange(1, 40000), {"domain": {"d0": 2.5, "d1": 0}, "lang": {"l1": 0.3}}, 2)


def test_mix_against_brute(spark, rows, none):
    r = random.Random(4)
    all_rows = [(d, t, r.choice(["en", "de", None]), r.choice(["src0", "src1", "src22", "odd", None])) for d, t in rows]
    df = mixing.with_domain(spark.createDataFrame(all_rows, "doc_id long, text string, lang string, source string")).withColumn("key", F.lit(1))
    got = {x.doc_id: x.copies for x in mixing.mix(df, mixing.WEIGHTS, 0.7, 2, 5).collect()}
    key = lambda e: F.xxhash64(F.lit(5), F.lit(e).cast("long"), "doc_id").bitwiseAND(F.lit((1 << 63) - 1))
    p = df.select("doc_id", F.coalesce("domain", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), mixing.word_count(F.col("text")), *[key(e) for e in range(3)]).collect()
    supply = {}
    for x in p:
        supply[x[1:4]] = supply.get(tuple(x[1:4]), 0) + x[4]
    taken, want = brute.allocate({tuple(k): v for k, v in supply.items()}, 0.7 * sum(supply.values()), mixing.WEIGHTS, 2), {}
    for path, n in supply.items():
        e, rest = divmod(taken[tuple(path)], n) if n else (0, 0)
        total = 0
        for x in sorted((x for x in p if x[1:4] == path), key=lambda x: (x[5 + min(e, 2)], x[0])):
            total += x[4]
            if copies := e + (total <= rest and rest > 0):
                want[x[0]] = copies
    assert got == want
    assert mixing.mix(mixing.with_domain(none), mixing.WEIGHTS, 0.5).count() == 0


def test_quality_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    out = quality.op9_quality_classifier(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_quality_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([(d, d % 2, 0) for d, _ in rows] + [(None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.count() == len(rows) and out.where("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert quality.classify(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.classify(none, labels).count() == 0


def test_base_spans_against_patterns():
    import re

    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    r = random.Random(2)
    for _ in range(20000):
        t = "".join(r.choice("a.b-@@..1 23+4()é 0@ 00255.") for _ in range(r.randrange(60)))
        want = [(m.start(), m.end(), k) for k, p in pats.items() for m in re.finditer(p, t) if ok(k, m[0])]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))
    assert pii.base_spans("1" * 300_000 + "a" * 300_000 + "@" * 1000) == []


def test_gradients():
    net, r = pii.BiLstmCrf(), np.random.default_rng(0)
    chars = r.integers(1, pii.N_CHARS, (3, 9))
    chars[1, 6:] = chars[2, 4:] = 0
    tags = np.array([pii.tags_of(9, [s]) for s in ((1, 4, "ip"), (2, 5, "email"), (0, 3, "card"))])
    _, grad = net.loss_and_gradients(chars, tags)
    for k in ("e", "wf", "wb", "bf", "bb", "o", "ob"):
        i = (chars[0, 2], 1) if k == "e" else tuple(r.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][i]
        losses = []
        for d in (1e-5, -1e-5):
            net.p[k][i] = old + d
            losses.append(net.loss_and_gradients(chars, tags)[0])
        net.p[k][i] = old
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grad[k][i], abs=1e-5, rel=1e-3)


def test_pii_network_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet")
    wins = pii.labelled_windows(docs)
    n = len(wins) * 4 // 5
    net = pii.BiLstmCrf()
    net.train(wins[:n])
    right = found = true = 0
    for (_, want), got in zip(wins[n:], pii.model_spans([w for w, _ in wins[n:]], net), strict=True):
        right, found, true = right + len(set(want) & set(got)), found + len(got), true + len(want)
    assert right / true > 0.8 and right / found > 0.8
    # long stretches are cut into windows and decided together
    text = "call +1 (415) 555-0100 or 10.0.0.1 now, " * 40
    assert all(0 <= s < e <= len(text) for s, e, _ in pii.model_spans([text, None, ""], net)[0])


def test_pii_edges(spark, docs, rows, none):
    assert pii.fit(none) is None and pii.find(none, None).count() == 0
    assert pii.find(docs, None).count() == len(rows)
    assert pii.redact(["mail a@b.cc now", None, ""], None) == ["mail [EMAIL] now", None, ""]


def plain_score(net, text, count):
    """The sum of a text's log probabilities, one word and one plain loop at a time."""
    (s,) = textnum.segments(pa.array([text]), textnum.SPACE, lower=True)
    h = s.word_hashes()
    known = {int(w): i for i, w in enumerate(net.words)}
    tok = [lm.PAD] * lm.SIDE + [known.get(int(x), lm.WORDS + int(x) % lm.HASHED) for x in h] + [lm.PAD] * lm.SIDE
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    total = 0.0
    for i, x in enumerate(h):
        pre = net.b1.astype(float)
        for k, at in enumerate((i, i + 1, i + 3, i + 4)):
            pre = pre + net.e[tok[at]].astype(float) @ net.w1[k].astype(float)
        hid, (c, j) = np.tanh(pre), divmod(tok[i + 2], lm.CLASS)
        total += np.log(soft(hid @ net.wc + net.bc)[c]) + np.log(soft(hid @ net.w2[c] + net.b2[c])[j])
        if tok[i + 2] >= lm.WORDS:
            total += np.log(count.get(int(x), 1) / net.sizes[j])
    return total


def small_vocabulary(monkeypatch):
    pad = lm.CLASS + lm.HASHED
    n = pad // lm.CLASS
    monkeypatch.setattr(lm, "WORDS", lm.CLASS)
    monkeypatch.setattr(lm, "N_CLASSES", n)
    monkeypatch.setattr(lm, "PAD", pad)
    shapes = lm.Network.SHAPES | {"e": (pad + 1, lm.EMBED), "wc": (lm.HIDDEN, n), "bc": (n,), "w2": (n, lm.HIDDEN, lm.CLASS), "b2": (n, lm.CLASS)}
    monkeypatch.setattr(lm.Network, "SHAPES", shapes)


def test_lm_score_against_a_plain_loop(spark, docs, rows, none, monkeypatch):
    small_vocabulary(monkeypatch)
    net = lm.fit(docs)
    count = {}
    for _, t in rows:
        for s in textnum.segments(pa.array([t]), textnum.SPACE, lower=True):
            for x in s.word_hashes():
                count[int(x)] = count.get(int(x), 0) + 1
    out = {x.doc_id: x for x in lm.score(docs, net).collect()}
    assert len(out) == len(rows)
    for d, t in rows:
        n = len(brute.SPACE_WORD.findall(t or ""))
        assert out[d].n_tokens == n
        if n < 1000:
            want = plain_score(net, t, count) if t else 0.0
            assert out[d].sum_logprob == pytest.approx(want, rel=1e-4, abs=1e-4) and out[d].mean_logprob == pytest.approx(want / max(n, 1), rel=1e-4, abs=1e-4)
    # neither files nor partitions matter, and every row gets its score again if repeated or without id
    again = docs.repartition(5)
    assert (lm.fit(again).weights() == net.weights()).all()
    more = docs.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id"))).unionByName(docs)
    assert lm.score(more, net).count() == 2 * len(rows)
    assert lm.score(none, lm.fit(none)).count() == 0


def test_lm_prefers_real_order(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    net = lm.fit(d)
    mixed = d.withColumn("text", F.array_join(F.shuffle(F.split("text", " ")), " "))
    a, b = (lm.score(x, net).where("n_tokens > 80").toPandas().set_index("doc_id").mean_logprob for x in (d, mixed))
    assert (a > b.reindex(a.index)).mean() > 0.7


@pytest.mark.parametrize("told", [lm.TOLD, 5])
def test_lm_words_of_a_bucket_have_their_shares(spark, monkeypatch, told):
    monkeypatch.setattr(lm, "TOLD", told)
    small_vocabulary(monkeypatch)
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(30000)]
    texts = [" ".join(vocab[min(int(r.paretovariate(0.4)), 29999)] for _ in range(500)) for _ in range(100)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    net = lm.fit(df)
    # one word alone: the network's distribution of that place sums to 1 over all words and one unknown of each hashed token
    known = sorted({w for t in texts for w in (t or "").split(" ") if w})
    alone = spark.createDataFrame([(i, w) for i, w in enumerate(known)], "doc_id long, text string")
    lp = {x.doc_id: x.sum_logprob for x in lm.score(alone, net).collect()}
    count = {}
    for t in texts:
        for w in (t or "").split(" "):
            count[w] = count.get(w, 0) + 1
    (s,) = textnum.segments(pa.array(known), textnum.SPACE, lower=True)
    token = net.tokens(s.word_hashes())
    empty = [net.log_prob(np.array([lm.PAD] * 2 + [lm.WORDS + k] + [lm.PAD] * 2, np.uint16))[0] for k in range(lm.HASHED)]
    seen = np.exp([lp[i] for i in range(len(known))]).sum()
    assert seen + (np.exp(empty) / net.sizes).sum() == pytest.approx(1, abs=1e-4)
    pairs = {}
    for i, k in enumerate(token.tolist()):
        if k >= lm.WORDS:
            pairs.setdefault(k, []).append((lp[i], count[known[i]]))
    assert pairs and any(len({n for _, n in v}) > 1 for v in pairs.values())
    assert all(x[0] - v[0][0] == pytest.approx(np.log(x[1] / v[0][1]), abs=1e-5) for v in pairs.values() for x in v)


def test_lm_learns_from_every_word(spark):
    w = words(random.Random(5), 2000)
    weights = lambda w: lm.fit(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string").coalesce(1)).weights()
    whole = weights(w)
    for i in range(0, 2000, 500):  # the same words in another order, anywhere in the text
        assert (weights(w[:i] + w[i : i + 100][::-1] + w[i + 100 :]) != whole).any()


def test_lm_steps_take_no_fresh_memory():
    lm._keep_freed()
    r = np.random.default_rng(2)
    net, memory = lm.Network(np.arange(lm.WORDS).astype(np.uint64) << np.uint64(48)), {}
    s = np.minimum(r.zipf(1.3, lm.STEP + 2 * lm.SIDE), lm.PAD - 1).astype(np.uint16)
    pages = []
    for _ in range(8):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        net.train(s, memory)
        net.log_prob(s)
        pages.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
    assert sorted(pages[2:])[3] < 500  # of 4 KB; over 2,000 when each step gives its arrays back


def test_lm_large_outputs(monkeypatch):
    r = np.random.default_rng(4)
    s = r.integers(0, lm.PAD + 1, 3000).astype(np.uint16)
    net = lm.Network(np.arange(lm.WORDS).astype(np.uint64) << np.uint64(48))
    lp, grad = net.log_prob(s), net.gradients(s)
    monkeypatch.setattr(lm, "SAFE", 0.0)  # the greatest output is taken off
    assert net.log_prob(s) == pytest.approx(lp, abs=1e-4)
    for k, (where, g) in net.gradients(s).items():
        assert np.array_equal(grad[k][0], where) if k in ("e", "w2", "b2") else grad[k][0] == where
        assert g == pytest.approx(grad[k][1], rel=1e-3, abs=1e-7)
    monkeypatch.undo()
    net.wc, net.w2 = net.wc * 1e4, net.w2 * 1e4
    assert np.isfinite(net.log_prob(s)).all() and all(np.isfinite(g).all() for _, g in net.gradients(s).values())


def test_lm_tokens_of_any_hashes():
    r = np.random.default_rng(6)
    h = r.integers(0, 2**64, 5000, dtype=np.uint64)
    h[:3000] &= np.uint64(0x0007FFFFFFFFFFFF)  # hundreds of equal leading bits
    h[3000:3002] = 0, 2**64 - 1
    words = np.unique(h)[r.permutation(len(np.unique(h)))][:2500]
    net, rank = lm.Network(words), {int(x): i for i, x in enumerate(words)}
    want = [rank.get(int(x), lm.WORDS + int(x) % lm.HASHED) for x in h]
    assert net.tokens(h).tolist() == want and lm.Network(words[:0]).tokens(h[:9]).tolist() == [lm.WORDS + int(x) % lm.HASHED for x in h[:9]]


def test_lm_gradients():
    net = lm.Network(np.arange(lm.WORDS).astype(np.uint64))
    r = np.random.default_rng(0)
    s = np.concatenate([[lm.PAD] * 2, r.integers(0, 300, 20), [lm.PAD] * 2, r.integers(lm.WORDS - 150, lm.WORDS + 50, 20), [lm.PAD] * 2]).astype(np.uint16)
    grad, n = net.gradients(s), 40
    c = int(s[2]) // lm.CLASS
    for k, i in (("w1", (1, 3, 4)), ("b1", (2,)), ("wc", (5, c)), ("bc", (c,)), ("w2", (c, 3, int(s[2]) % lm.CLASS)), ("b2", (c, int(s[2]) % lm.CLASS)), ("e", (int(s[3]), 2)), ("e", (lm.PAD, 1))):
        where, g = grad[k]
        dense = np.zeros(net.SHAPES[k])
        dense[where] = g
        w = getattr(net, k).copy()
        losses = []
        for d in (1e-2, -1e-2):
            x = w.copy()
            x[i] += d
            setattr(net, k, x)
            losses.append(-net.log_prob(s).sum() / n)
        setattr(net, k, w)
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(float(dense[i]), abs=2e-4, rel=0.05)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without id, repeated rows, one id with two texts, and columns whose names the operators use themselves."""
    text = "Call +1 (415) 555-0100 or mail a.b@example.org about 10.0.0.1 and 4111 1111 1111 1111 today. " + " ".join(f"word{i}" for i in range(40))
    rows = [(None, text), (None, text), (1, text), (1, text), (2, "one short text"), (2, "another short text"), (3, None), (None, None), (4, "")]
    df = spark.createDataFrame([(d, x, "en", "src1", len(x or "")) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("domain", "n_tokens", "copies", "score", "cls", "row_key", "_row_key", "key", "n_hit", "component_id", "leaf"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df.repartition(2)


def test_odd_rows_in_operators(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    n = odd.count()
    spans = pii.find(odd, None).collect()
    assert len(spans) == n and sorted(len(r.base) for r in spans) == [0, 0, 0, 0, 0, 4, 4, 4, 4]
    counted = tokens.count_tokens(odd, P.path("word_bpe_49k.json")).collect()
    assert len(counted) == n and len({r.n_tokens for r in counted if r.n_bytes > 100}) == 1
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    scored = quality.classify(odd, labels).collect()
    assert len(scored) == n and all(r.held_out for r in scored if r.doc_id is None)
    bench = spark.createDataFrame([("b", "one short text"), (None, "another short text"), ("b", "one short text"), ("c", None)], "item_id string, text string")
    hits = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in decontaminate.contamination(odd, bench).collect()}
    assert hits[(2, 3)] == (3, ["b"]) and hits[(None, 0)] == (0, []) and decontaminate.contamination(odd, bench).count() == n
    taken = mixing.mix(mixing.with_domain(odd), {}, 1.0).collect()
    assert len(taken) == n and all(r.copies == 1 and r.domain == "d1" for r in taken)
    assert jaccard.similar_components(odd).count() == n and substring.dedup_substrings(odd).count() == n


def test_odd_rows_in_stages(spark, sf_dir, odd, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("b", "another short text")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    # without labelled rows every document scores the same share of label 1, which is kept
    good = stages["quality"](spark, odd, d)
    assert good.columns == odd.columns and rows(good) == rows(odd)
    one = stages["near copies"](spark, odd, d)
    # repeated rows leave one, those without id are in no component
    assert one.columns == odd.columns and rows(one) == sorted({(r.doc_id or 0, r.text or "") for r in odd.collect()})
    clean = stages["decontaminate"](spark, odd, d)
    assert clean.columns == odd.columns and rows(clean) == [x for x in rows(odd) if x != (2, "another short text")]
    bare = stages["personal data"](spark, odd, d)
    assert bare.columns == odd.columns and sum("[EMAIL]" in (r.text or "") for r in bare.collect()) == 4 and bare.count() == odd.count()
    mix = stages["mix"](spark, odd, d)
    assert set(mix.columns) == set(odd.columns) and {(r.domain, r.key) for r in mix.collect()} == {("d1", "own key")}
    again = mixing.mix(mixing.with_domain(odd), mixing.WEIGHTS, mixing.BUDGET_SHARE, mixing.EPOCHS, mixing.SEED)
    assert sorted((r.doc_id or 0, r.n_tokens, r.copies) for r in mix.collect()) == sorted((r.doc_id or 0, r.n_tokens, r.copies) for r in again.collect())


def test_odd_conversations(spark):
    long = "<[\\" * 50_000
    rows = [(-7, 0, "user", "own turn"), (5, 0, "assistant", long), (5, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionByName(chat.probe(spark))
    back = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.read_back(chat.format_conversations(chat.from_texts(df))).collect()}
    assert back[5] == [("assistant", long), ("user", "")]
    assert back[-7] == [("user", "</s>[INST] ok [/INST]"), ("user", "own turn"), ("assistant", "</s>[INST] ok [/INST]")]


def test_base_span_columns(spark, odd, sf_dir):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.op1_pii(spark, sf_dir).collect():
        base = pii.base_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in base) for x in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_discriminant_against_plain_densities(spark, sf_dir):
    """The query's scores from means, covariances and log densities written out, over the same statistics."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs).toPandas().set_index("doc_id")
    y = labels.toPandas().drop_duplicates("doc_id").set_index("doc_id").quality.reindex(stats.index)
    x = np.array(stats.stats.tolist())
    train = ~stats.held_out.to_numpy(bool) & y.notna().to_numpy()
    cls = [x[train & (y == k).to_numpy()] for k in (0, 1)]
    n, means, covs = [len(c) for c in cls], [c.mean(0) for c in cls], [np.cov(c.T, bias=True) for c in cls]
    pooled = sum(a * c for a, c in zip(n, covs, strict=True)) / sum(n)
    density = []
    for k in (0, 1):
        c = 0.7 * covs[k] + 0.3 * pooled
        c += (1e-3 * np.trace(pooled) / len(pooled) + 1e-9) * np.eye(len(pooled))
        far = np.einsum("ij,jk,ik->i", x - means[k], np.linalg.inv(c), x - means[k])
        density.append(np.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * far)
    want = 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / len(quality.FEATURES), -60, 60)))
    got = quality.op9_quality_classifier(spark, sf_dir).toPandas().set_index("doc_id").reindex(stats.index)
    assert np.allclose(got.score, want, atol=1e-6) and (got.predicted == (got.score >= 0.3)).all()


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, key):
    compare(spark, sf_dir, queries.QUERIES[key], queries.ORACLE_SQL[key])


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = seen
        seen = stage(spark, before, sf_dir).cache()
        ids = {r[0] for r in seen.select("doc_id").collect()}
        texts = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        assert ids <= {d for d, _ in texts}
        if name == "quality":
            out = quality.classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert ids == {r.doc_id for r in out.where("predicted = 1").collect()}
        if name == "mix":
            out = mixing.mix(mixing.with_domain(before), mixing.WEIGHTS, mixing.BUDGET_SHARE, mixing.EPOCHS, mixing.SEED)
            assert sorted((r.doc_id, r.copies) for r in seen.collect()) == sorted((r.doc_id, r.copies) for r in out.collect())
        if name == "near copies":
            assert ids == {d for d, (_, c) in brute.components(texts).items() if c == d}
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert ids == {d for d, (n, hit, _) in brute.contamination(texts, items).items() if not (hit and 20 * hit >= n)}
        if name == "personal data":
            assert all(not pii.base_spans(r.text) for r in seen.select("text").collect())
        if name != "mix":
            assert seen.columns == columns
