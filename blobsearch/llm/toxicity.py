"""Toxicity: a bidirectional gated recurrent network with attention pooling, scoring all overlapping windows.

A word enters the network twice: as a word, by a hashed embedding, and as
characters, by the embeddings of its character n-grams, its borders included. A
window of words runs through two gated recurrent layers, one from each side;
attention pools their states into one logit. Training in numpy (backpropagation
through time, Adam) is on windows of labelled documents, each with its
document's label. A document is told by the greatest and the mean score of all
its windows, weighed by a logistic that is fitted on documents of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .store import Scratch, documents_of, table

#: Words of a window, and from one window's start to the next.
SPAN, STEP = 32, 24
WORD_BUCKETS, GRAM_BUCKETS, GRAMS = 1 << 13, 1 << 15, (3, 5, 7)
EMBED, HIDDEN = 12, 12
#: Labelled documents of each class that the network is trained on, at most, and windows of each class; documents of each class for the logistic.
DOCS, WINDOWS, WEIGHED = 4000, 8000, 20_000
#: Words and n-grams are learned if so many documents of the training set hold them; of others nothing is known, and they add nothing.
KNOWN = 4
#: Longer windows (words of very many letters) are scored but not trained on.
TRAINED_BYTES = 4096
#: DROP: share of word and n-gram inputs that an update leaves out.
BATCH, UPDATES, RATE, DROP = 256, 200, 5e-3, 0.3
#: Windows that run through the network at once.
CHUNK = 2048
THRESHOLD = 0.5


class Types:
    """The distinct words of a segment, or of a training set: word buckets, and n-gram buckets as ragged rows."""

    def __init__(self, seg: textnum.Segment):
        h = seg.word_hashes()
        _, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.word = (h[first] % np.uint64(WORD_BUCKETS)).astype(np.int64)
        start, length = seg.start[first], seg.end[first] - seg.start[first]
        # each word with a border byte on both sides, and seven more to read eight at once
        size = length + 2
        begin = np.cumsum(size) - size
        text = np.zeros(int(size.sum()) + 8, np.uint8)
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        text[np.repeat(begin + 1, length) + inner] = seg.data[np.repeat(start, length) + inner]
        eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)[:-1]).view(np.uint64).ravel()
        at = np.arange(len(eights))
        owner = np.repeat(np.arange(len(size)), size)
        left = np.repeat(begin + size, size) - at
        grams, owners = [], []
        for g in GRAMS:
            some = np.flatnonzero(left >= g)
            piece = eights[some] & np.uint64(0xFFFFFFFFFFFFFFFF >> (8 * (8 - g)))
            grams.append(textnum.mix(piece + np.uint64(g)) % np.uint64(GRAM_BUCKETS))
            owners.append(owner[some])
        order = np.argsort(np.concatenate(owners), kind="stable") if owners else np.zeros(0, np.int64)
        self.gram = np.concatenate(grams)[order].astype(np.int64)
        self.size = np.bincount(np.concatenate(owners), minlength=len(size))  # three borders and letters at least: never 0
        self.begin = np.cumsum(self.size) - self.size

    def rows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, gram buckets and grams of each of some types."""
        n = self.size[some]
        at = np.repeat(self.begin[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.word[some], self.gram[at], n


def windows_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word, counted in its text, of each window. The last of several ends with the text; a text without words has one empty window."""
    n = np.maximum(-(-(words - SPAN) // STEP), 0) + 1
    of = np.repeat(np.arange(len(words)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return of, np.minimum(k * STEP, np.maximum(words[of] - SPAN, 0))


def window_types(seg: textnum.Segment, types: Types) -> tuple[np.ndarray, np.ndarray]:
    """Text of each window; windows x SPAN types, the number of types where a window has no word."""
    of, at = windows_of(seg.words)
    place = at[:, None] + np.arange(SPAN)
    inside = place < seg.words[of][:, None]
    flat = np.append(types.of, len(types.word))
    return of, flat[np.where(inside, seg.begin[of][:, None] + place, len(types.of))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values added up by their place."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    order = np.argsort(at, kind="stable")
    places = at[order]
    begin = np.flatnonzero(np.diff(places, prepend=-1))
    if len(begin):
        out[places[begin]] = np.add.reduceat(values[order], begin, axis=0)
    return out


def known_buckets(types: Types, idx: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets and n-gram buckets that at least so many documents hold."""
    pairs = np.unique(np.stack([np.broadcast_to(doc[:, None], idx.shape).ravel(), idx.ravel()], 1), axis=0)
    pairs = pairs[pairs[:, 1] < len(types.word)]
    word, gram, n = types.rows(pairs[:, 1])
    held = lambda bucket, d, size: np.bincount(np.unique(bucket * (doc.max(initial=0) + 1) + d) // (doc.max(initial=0) + 1), minlength=size) >= least
    return held(word, pairs[:, 0], WORD_BUCKETS), held(gram, np.repeat(pairs[:, 0], n), GRAM_BUCKETS)


class Network:
    """Parameters by name; both directions of the recurrent layer are computed at once, on a leading axis of two."""

    def __init__(self, seed: int = 0):
        r, e, h = np.random.default_rng(seed), 2 * EMBED, HIDDEN
        init = lambda *shape, by=1.0: (r.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "word": np.zeros((WORD_BUCKETS, EMBED), np.float32), "gram": np.zeros((GRAM_BUCKETS, EMBED), np.float32), "wx": init(2, e, 3 * h, by=e**-0.5), "bx": np.zeros((2, 3 * h), np.float32),
            "u": init(2, h, 3 * h, by=h**-0.5), "wa": init(2 * h, h, by=(2 * h) ** -0.5), "va": init(h, by=h**-0.5), "out": init(2 * h, by=0.1), "bias": np.zeros(1, np.float32),
        }

    def inputs(self, word: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Types x 2 EMBED: the word's embedding and the scaled sum of its n-grams'."""
        if not len(word):
            return np.zeros((0, 2 * EMBED), np.float32)
        total = np.add.reduceat(self.p["gram"][gram], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], total], 1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """2 x (types + 1) x 3 HIDDEN: what each type adds to the gates; the last row is that of no word."""
        out = np.matmul(x[None], self.p["wx"]) + self.p["bx"][:, None]
        return np.concatenate([out, np.zeros((2, 1, out.shape[2]), np.float32)], 1)

    def forward(self, gates: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Logits of windows x SPAN types; with ``keep`` also what ``backward`` needs."""
        p, h, t_all = self.p, HIDDEN, idx.shape[1]
        none = gates.shape[1] - 1
        both = np.stack([idx, idx[:, ::-1]])
        real = (both != none).astype(np.float32)[..., None]
        state = np.zeros((2, len(idx), h), np.float32)
        states, kept = np.zeros((t_all, 2, len(idx), h), np.float32), []
        for t in range(t_all):
            x = np.stack([gates[0][both[0, :, t]], gates[1][both[1, :, t]]])
            y = np.matmul(state, p["u"])
            zr = _sigmoid(x[..., : 2 * h] + y[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            new = np.tanh(x[..., 2 * h :] + r * y[..., 2 * h :])
            before = state
            state = (new + z * (before - new)) * real[:, :, t]
            states[t] = state
            if keep:
                kept.append((before, z, r, new, y[..., 2 * h :]))
        seen = np.concatenate([states[:, 0], states[::-1, 1]], -1)  # SPAN x windows x 2 HIDDEN
        a = np.tanh(seen @ p["wa"])
        weight = np.exp(a @ p["va"]) * (idx != none).T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, seen)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (both, real, kept, seen, a, weight, pooled)) if keep else logit

    def backward(self, d: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the embeddings, and of every gate input (2 x windows x SPAN x 3 HIDDEN, in each direction's order); d: of the logits."""
        p, h = self.p, HIDDEN
        both, real, steps, seen, a, weight, pooled = kept
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        dw = np.einsum("bh,tbh->tb", dp, seen)
        ds = weight * (dw - (weight * dw).sum(0))
        da = ds[..., None] * p["va"] * (1 - a * a)
        g["va"] = np.einsum("tb,tbh->h", ds, a)
        g["wa"] = np.einsum("tbh,tbk->hk", seen, da)
        dseen = weight[..., None] * dp[None] + da @ p["wa"].T
        dx = np.zeros((*both.shape, 3 * h), np.float32)
        g["u"] = np.zeros_like(p["u"])
        back = np.zeros((2, both.shape[1], h), np.float32)
        for t in range(both.shape[2] - 1, -1, -1):
            before, z, r, new, yn = steps[t]
            dh = (back + np.stack([dseen[t, :, :h], dseen[-1 - t, :, h:]])) * real[:, :, t]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dnew * yn * r * (1 - r)
            dx[:, :, t] = np.concatenate([dz, dr, dnew], -1)
            dy = np.concatenate([dz, dr, dnew * r], -1)
            g["u"] += np.matmul(before.transpose(0, 2, 1), dy)
            back = dh * z + np.matmul(dy, p["u"].transpose(0, 2, 1))
        return g, dx

    def gradients(self, types: Types, idx: np.ndarray, y: np.ndarray, r: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows with labels y, and the gradients of all parameters; with ``r`` the words and the n-grams of DROP of all types are left out."""
        some, local = np.unique(idx, return_inverse=True)
        local = local.reshape(idx.shape)
        none = len(types.word)
        if some[-1] == none:
            some = some[:-1]
        word, gram, n = types.rows(some)
        x = self.inputs(word, gram, n)
        left = np.ones_like(x) if r is None else np.repeat((r.random((len(x), 2)) >= DROP) / (1 - DROP), EMBED, 1).astype(np.float32)
        x *= left
        logit, kept = self.forward(self.projected(x), np.where(idx == none, len(some), local), keep=True)
        q = _sigmoid(logit)
        loss = -np.mean(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))
        g, dx = self.backward(((q - y) / len(y)).astype(np.float32), kept)
        dgate = np.zeros((2, len(some) + 1, dx.shape[-1]), np.float32)
        for k in (0, 1):
            dgate[k] = _summed(kept[0][k].ravel(), dx[k].reshape(-1, dx.shape[-1]), len(some) + 1)
        dgate = dgate[:, :-1]
        g["bx"], g["wx"] = dgate.sum(1), np.matmul(x.T[None], dgate)
        dtype = np.matmul(dgate, self.p["wx"].transpose(0, 2, 1)).sum(0) * left
        g["word"] = _summed(word, dtype[:, :EMBED], WORD_BUCKETS)
        g["gram"] = _summed(gram, np.repeat(dtype[:, EMBED:] / np.sqrt(n)[:, None].astype(np.float32), n, 0), GRAM_BUCKETS)
        return float(loss), g

    def train(self, types: Types, idx: np.ndarray, y: np.ndarray, doc: np.ndarray, updates: int = UPDATES, seed: int = 0) -> Network:
        """Adam over batches that hold as many windows of either class; doc: the document's number of each window.

        Many windows of a toxic document hold nothing toxic. After half of the
        updates those that the network takes for clean are left out, but for the
        likeliest one of each document.
        """
        r = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        known = dict(zip(("word", "gram"), known_buckets(types, idx, doc, KNOWN), strict=True))
        classes = [np.flatnonzero(y == c) for c in (0, 1)]
        deal = [np.zeros(0, np.int64)] * 2
        for k in range(1, updates + 1):
            if k == updates // 2 + 1:
                classes[1] = self._likely(types, idx, doc, classes[1])
                deal[1] = deal[1][:0]
            half = []
            for c in (0, 1):
                while len(deal[c]) < BATCH // 2:
                    deal[c] = np.concatenate([deal[c], r.permutation(classes[c])])
                half.append(deal[c][: BATCH // 2])
                deal[c] = deal[c][BATCH // 2 :]
            some = np.concatenate(half)
            _, g = self.gradients(types, idx[some], y[some], r)
            rate = RATE * min(1.0, 2 * (1 - k / (updates + 1)))
            for name, v in self.p.items():
                if name in known:
                    g[name][~known[name]] = 0
                first[name] += 0.1 * (g[name] - first[name])
                second[name] += 0.01 * (g[name] * g[name] - second[name])
                v -= rate * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-7)
        return self

    def _likely(self, types: Types, idx: np.ndarray, doc: np.ndarray, some: np.ndarray) -> np.ndarray:
        gates = self.projected(self.inputs(types.word, types.gram, types.size))
        logit = np.concatenate([self.forward(gates, idx[some[i : i + CHUNK]]) for i in range(0, len(some), CHUNK)])
        order = np.lexsort((-logit, doc[some]))
        best = np.zeros(len(some), bool)
        best[order[np.flatnonzero(np.diff(doc[some][order], prepend=-1))]] = True
        return some[best | (logit > 0)]

    def score(self, seg: textnum.Segment) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of every window of a segment."""
        types = Types(seg)
        of, idx = window_types(seg, types)
        gates = self.projected(self.inputs(types.word, types.gram, types.size))
        parts = [self.forward(gates, idx[i : i + CHUNK]) for i in range(0, len(idx), CHUNK)]
        return of, np.concatenate(parts)


def _words(texts: pa.Array) -> Iterator[textnum.Segment]:
    return textnum.segments(texts, textnum.NOT_WORD, lower=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, start, text of the windows of a batch that can be trained on."""
    for b in batches:
        for s in _words(b["text"]):
            of, at = windows_of(s.words)
            some = np.flatnonzero(s.words[of] > 0)
            of, at = of[some], at[some]
            first = s.begin[of] + at
            last = s.begin[of] + np.minimum(at + SPAN, s.words[of]) - 1
            start, end = s.start[first], s.end[last]
            fit = np.flatnonzero(end - start <= TRAINED_BYTES)
            raw = s.data.tobytes()
            text = pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(start[fit], end[fit], strict=True)], pa.string())
            rows = pa.array(s.first + of[fit])
            yield pa.record_batch([b["doc_id"].take(rows), b["label"].take(rows), pa.array(at[fit]), text], ["doc_id", "label", "start", "text"])


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, label, own: documents that are learned from; a third of them (own) fits the logistic, the others the network."""
    y = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("label"))
    return y.where(~held_out(F.col("doc_id"))).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0)


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network trained on at most WINDOWS windows of each class, from at most DOCS labelled documents of each, all chosen by hash. None without both classes."""
    pool = labelled(labels).where("not own")
    pick = lambda df, n, *by: df.orderBy(F.xxhash64(*by), *by).limit(n)
    chosen = pick(pool.where("label = 0"), DOCS, "doc_id").unionByName(pick(pool.where("label = 1"), DOCS, "doc_id"))
    scratch = Scratch(docs.sparkSession)
    # 2 DOCS rows at most go to every task
    cut = scratch.settle(documents_of(docs).join(F.broadcast(chosen.select("doc_id", "label")), "doc_id").mapInArrow(_cut, "doc_id long, label int, start long, text string"), "toxic-windows")
    found = [pick(cut.where(F.col("label") == c), WINDOWS, "doc_id", "start", "text").select("text", "label", "doc_id").collect() for c in (0, 1)]
    scratch.drop()
    if not all(found):
        return None
    rows = [r for x in found for r in x]
    # all texts in one segment, so that types are shared
    seg = next(textnum.segments(pa.array([r["text"] for r in rows]), textnum.NOT_WORD, lower=True, limit=1 << 40))
    types = Types(seg)
    _, idx = window_types(seg, types)
    doc = np.unique([r["doc_id"] for r in rows], return_inverse=True)[1]
    return Network().train(types, idx, np.array([r["label"] for r in rows], np.float32), doc)


def window_scores(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, top, mean, n: of all windows of each whole text the greatest logit, the mean probability and the number."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _words(b["text"]):
                of, logit = network.score(s)
                begin = np.searchsorted(of, np.arange(s.n))
                n = np.bincount(of, minlength=s.n)
                top = np.maximum.reduceat(logit, begin)
                mean = np.add.reduceat(_sigmoid(logit), begin) / n
                one = b.slice(s.first, s.n)
                yield pa.record_batch([one["doc_id"], one["held_out"], pa.array(top.astype(float)), pa.array(mean.astype(float)), pa.array(n)], ["doc_id", "held_out", "top", "mean", "n"])

    return documents_of(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(scored, "doc_id long, held_out boolean, top double, mean double, n long")


def _features(top, mean, n, log, clip):
    """What the logistic weighs, for arrays and for columns alike."""
    m = clip(mean)
    return [top, log(m / (1 - m)), log(n + 1.0), top * log(n + 1.0)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the bias last, by Newton's steps; columns are scaled for the ridge and scaled back."""
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], 1)
    w, cost = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(30):
        q = _sigmoid(z @ w)
        w = w + np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(cost) + 1e-9 * np.eye(len(w)), z.T @ (y - q) - cost * w)
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows: one row for each row of ``docs``.

    Null and empty texts have one empty window and are scored like any other. Rows
    of ``labels`` with a null or other label, or of held-out documents, are not
    learned from; of several labels of one document the smallest counts. Without
    labels of both classes every document gets the smoothed share of label 1.
    Repeated rows get equal scores, texts of any length are scored whole; extra
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    y = labelled(labels)
    network = train(docs, labels)
    scores = scratch.settle(window_scores(docs, network or Network()), "toxic-scores")
    known = scores.join(y.where("own"), "doc_id").select("label", "top", "mean", "n", F.xxhash64("doc_id", "top", "mean").alias("h"))
    rows = [r for c in (0, 1) for r in known.where(F.col("label") == c).orderBy("h").limit(WEIGHED).collect()]
    if network is None or len({r["label"] for r in rows}) < 2:
        n = {r["label"]: r["n"] for r in y.groupBy("label").agg(F.count("*").alias("n")).collect()}
        score = F.lit((n.get(1, 0) + 1) / (sum(n.values()) + 2))
    else:
        a = np.array([[r["top"], r["mean"], r["n"]] for r in rows]).T
        x = np.stack(_features(*a, np.log, lambda m: np.clip(m, 1e-4, 1 - 1e-4)), 1)
        w = fit_logistic(x, np.array([r["label"] for r in rows], float))
        columns = _features(F.col("top"), F.col("mean"), F.col("n"), F.log, lambda m: F.greatest(F.least(m, F.lit(1 - 1e-4)), F.lit(1e-4)))
        total = sum((F.lit(float(k)) * c for k, c in zip(w[:-1], columns, strict=True)), F.lit(float(w[-1])))
        score = 1 / (1 + F.exp(-total))
    return scores.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), F.col("n").alias("n_windows"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
