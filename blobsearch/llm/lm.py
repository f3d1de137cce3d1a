"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token from two tokens on each side. The WORDS
most frequent words of the whole corpus are tokens, in classes of neighbouring
frequency: a token's probability is that of its class by that of the token in
it. All other words share HASHED hashed tokens, a last class; such a word has
its share of its token's probability: its count by the token's, which has one
count more for all words that the corpus lacks.

Documents are dealt by hash into shards whose number follows the corpus's words.
In a round every shard trains the network in numpy on all words of the round's
documents, and weights are averaged by the words they saw; the rounds take
disjoint shares of the documents, together all of them. A document's score is
the sum of its words' conditional log probabilities.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .store import documents_of, settle, table

#: Tokens of a class; words that are tokens of their own; hashed tokens of the others.
CLASS, WORDS, HASHED = 64, 8192, 64
N_CLASSES = (WORDS + HASHED) // CLASS
#: The token beside the first and the last word of a text.
PAD = WORDS + HASHED
SIDE, EMBED, HIDDEN = 2, 16, 24
#: Places of a step; places scored at once; the rate.
STEP, SCORED, RATE = 16_384, 65_536, 0.1
#: Places whose outputs are held at once; up to this size of all outputs, exponentials need no greatest output taken off first.
BLOCK, SAFE = 512, 60.0
#: Of each 8 documents by hash those of the first round; the second takes the others.
ROUNDS = ((0,), (1, 2, 3, 4, 5, 6, 7))
#: Words of a shard, on average.
SHARD_WORDS = 2_000_000
#: Numbers of a part of the weights that tasks send to be averaged.
PART = 2048
#: Counts of words that are told to every task; those of other words are joined.
TOLD = 262_144


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(HASHED)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed()
        held, n = [], 0

        def flush(held) -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "n"])

        for b in batches:
            for s in textnum.segments(b["text"], textnum.SPACE, lower=True):
                held.append(s.word_hashes())
                n += len(held[-1])
                if n >= 2_000_000:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return documents_of(docs).select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keep_freed() -> None:
    """Frees a large block once: malloc then keeps freed arrays of up to this size for the next ones, instead of fresh pages for each step."""
    np.empty(31 << 20, np.uint8)


class Network:
    """Tokens to the 2 * SIDE around them; weights as one vector for averaging."""

    SHAPES = {
        "e": (PAD + 1, EMBED), "w1": (2 * SIDE, EMBED, HIDDEN), "b1": (HIDDEN,), "wc": (HIDDEN, N_CLASSES), "bc": (N_CLASSES,),
        "w2": (N_CLASSES, HIDDEN, CLASS), "b2": (N_CLASSES, CLASS),
    }
    #: Where a token's neighbours begin in a stream that has SIDE more places at each end.
    AT = tuple(i for i in range(2 * SIDE + 1) if i != SIDE)

    def __init__(self, words: np.ndarray, weights: np.ndarray | None = None, seed: int = 7):
        """words: hashes of the words that are tokens, most frequent first."""
        self.words = words.astype(np.uint64)
        self.rank = np.argsort(self.words)
        self.known = self.words[self.rank]
        # where the hashes of each 16 leading bits begin, and how many there are at most
        heads = (self.known >> np.uint64(48)).astype(np.int64)
        self.first, self.longest = np.searchsorted(heads, np.arange(1 << 16)), int(np.bincount(heads, minlength=1).max())
        r = np.random.default_rng(seed)
        if weights is None:
            scale = {"e": 0.1, "w1": (2 * SIDE * EMBED) ** -0.5, "wc": HIDDEN**-0.5, "w2": HIDDEN**-0.5}
            weights = np.concatenate([(r.standard_normal(s) * scale[k] if k in scale else np.zeros(s)).ravel() for k, s in self.SHAPES.items()])
        self.set(weights)
        # counts of hashed tokens and of words in them; those of other words, to be joined
        self.sizes, self.told, self.told_n, self.joined = np.ones(HASHED), np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def set(self, weights: np.ndarray) -> None:
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            setattr(self, k, weights[at : at + n].reshape(s).astype(np.float32))
            at += n

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.SHAPES])

    def tokens(self, h: np.ndarray) -> np.ndarray:
        bucket = WORDS + _bucket(h)
        if not len(self.words):
            return bucket
        last = len(self.known) - 1
        at = np.minimum(self.first.take((h >> np.uint64(48)).astype(np.int64)), last)
        for _ in range(self.longest - 1):
            at = np.minimum(at + (self.known.take(at) < h), last)
        return np.where(self.known.take(at) == h, self.rank.take(at), bucket)

    def stream(self, s: textnum.Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a segment with SIDE pads around each text that has words; where each word stands; the words' hashes."""
        h = s.word_hashes()
        texts = np.cumsum(s.words > 0)
        at = np.arange(len(h)) + SIDE * texts[s.doc]
        out = np.full(len(h) + SIDE * (int(texts[-1]) + 1 if s.n else 1), PAD, np.uint16)
        out[at] = self.tokens(h)
        return out, at, h

    def hidden(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place of a stream but SIDE at either end: its neighbours' embeddings; the hidden layer, and a 1 that biases multiply."""
        near = np.lib.stride_tricks.sliding_window_view(s, 2 * SIDE + 1)[:, self.AT]
        x = self.e.take(near, 0).reshape(len(near), -1)
        out = np.zeros((len(x), HIDDEN + 1), np.float32)
        np.matmul(x, self.w1.reshape(-1, HIDDEN), out=out[:, :HIDDEN])
        out[:, :HIDDEN] += self.b1
        np.tanh(out, out=out)
        out[:, HIDDEN] = 1
        return x, out

    @staticmethod
    def _grouped(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Places of tokens other than pads in the order of tokens, these tokens, and the stretch of each class."""
        order = np.argsort(t, kind="stable")
        ts = t[order].astype(np.int64)
        cuts = np.searchsorted(ts, np.arange(0, PAD + 1, CLASS))
        return order[: cuts[-1]], ts[: cuts[-1]], [(c, a, b) for c, (a, b) in enumerate(itertools.pairwise(cuts.tolist())) if b > a]

    def _outputs(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights with biases as the last row, of the softmax over classes and of those within them; whether no value can pass SAFE."""
        wc, w2 = np.concatenate([self.wc, self.bc[None]]), np.concatenate([self.w2, self.b2[:, None]], 1)
        # hidden values are at most 1
        return wc, w2, bool(max(np.abs(wc).sum(0).max(), np.abs(w2).sum(1).max()) < SAFE)

    @staticmethod
    def _softmaxes(ts: np.ndarray, classes: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Stretches of at most BLOCK sorted tokens: -1 for the softmax over classes, else the class that it is in; begin, end, chosen outputs."""
        of, own = divmod(ts, CLASS)
        for chosen, (c, a, b) in itertools.chain([(of, (-1, 0, len(ts)))], ((own, x) for x in classes)):
            for i in range(a, b, BLOCK):
                j = min(i + BLOCK, b)
                yield c, i, j, chosen[i:j]

    def log_prob(self, s: np.ndarray) -> np.ndarray:
        """The log probability of each place of a stream but SIDE at either end; 0 for pads."""
        out = np.zeros(len(s) - 2 * SIDE, np.float64)
        (wc, w2, safe), rows, ones = self._outputs(), np.arange(BLOCK), np.ones(max(N_CLASSES, CLASS), np.float32)
        for at in range(0, len(out), SCORED):
            part = s[at : at + SCORED + 2 * SIDE]
            _, hid = self.hidden(part)
            order, ts, classes = self._grouped(part[SIDE:-SIDE])
            hs = hid.take(order, 0)
            # for each place the outputs chosen and the sums of exponentials, over classes and within one
            value, total = np.empty((2, len(ts)), np.float32), np.empty((2, len(ts)), np.float32)
            for c, i, j, chosen in self._softmaxes(ts, classes):
                z = hs[i:j] @ (wc if c < 0 else w2[c])
                if not safe:
                    z -= z.max(1, keepdims=True)
                value[int(c >= 0), i:j] = z[rows[: j - i], chosen]
                np.matmul(np.exp(z, out=z), ones[: z.shape[1]], out=total[int(c >= 0), i:j])
            out[at + order] = (value - np.log(total)).sum(0)
        return out

    def gradients(self, s: np.ndarray) -> dict[str, tuple]:
        """Of the mean negative log probability over the places of a stream that are no pads: for each weight where it applies, and its values."""
        x, hid = self.hidden(s)
        order, ts, classes = self._grouped(s[SIDE:-SIDE])
        n, hs = max(len(ts), 1), hid.take(order, 0)
        (wc, w2, safe), rows, ones = self._outputs(), np.arange(BLOCK), np.ones(max(N_CLASSES, CLASS), np.float32)
        # before scaling, over classes and within one
        dh, scale, gc = np.empty((2, len(ts), HIDDEN), np.float32), np.empty((2, len(ts), 1), np.float32), np.zeros_like(wc)
        chosen_classes = np.array([c for c, _, _ in classes], np.int64)
        g2 = {c: np.zeros((HIDDEN + 1, CLASS), np.float32) for c, _, _ in classes}
        for c, i, j, chosen in self._softmaxes(ts, classes):
            h, w = hs[i:j], wc if c < 0 else w2[c]
            z = h @ w
            if not safe:
                z -= z.max(1, keepdims=True)
            total = np.exp(z, out=z) @ ones[: z.shape[1]]
            # rows are left unscaled: the narrower hidden values are scaled in their place
            z[rows[: j - i], chosen] -= total
            at = int(c >= 0), slice(i, j)
            np.divide(1, n * total[:, None], out=scale[at])
            np.matmul(z, w[:HIDDEN].T, out=dh[at])
            g = gc if c < 0 else g2[c]
            g += (z.T @ (h * scale[at])).T
        gs = np.stack(list(g2.values())) if g2 else np.zeros((0, HIDDEN + 1, CLASS), np.float32)
        out = {"wc": (slice(None), gc[:HIDDEN]), "bc": (slice(None), gc[HIDDEN]), "w2": (chosen_classes, gs[:, :HIDDEN]), "b2": (chosen_classes, gs[:, HIDDEN])}
        d = np.zeros((len(hid), HIDDEN), np.float32)
        hs = hs[:, :HIDDEN]
        dh *= scale
        d[order] = (dh[0] + dh[1]) * (1 - hs * hs)
        dx, de, m = d @ self.w1.reshape(-1, HIDDEN).T, np.zeros((len(s), EMBED), np.float32), len(d)
        for k, i in enumerate(self.AT):
            de[i : i + m] += dx[:, k * EMBED : (k + 1) * EMBED]
        out |= {"w1": (slice(None), (x.T @ d).reshape(self.w1.shape)), "b1": (slice(None), np.ones(m, np.float32) @ d)}
        by = np.argsort(s, kind="stable")
        tokens = s.take(by).astype(np.int64)
        head = np.flatnonzero(np.diff(tokens, prepend=-1))
        out["e"] = (tokens[head], np.add.reduceat(de.take(by, 0), head))
        return out

    def train(self, s: np.ndarray, memory: dict) -> None:
        """A step of Adagrad on a stream; ``memory`` keeps the sums of squares."""
        for k, (where, g) in self.gradients(s).items():
            w = getattr(self, k)
            if k not in memory:
                memory[k] = np.full_like(w, 1e-8)
            seen = memory[k][where] + g * g
            memory[k][where] = seen
            w[where] -= np.float32(RATE) * g / np.sqrt(seen, out=seen)


def _shards(docs: DataFrame, shards: int, shares: tuple[int, ...]) -> DataFrame:
    """text of a round's documents, dealt by hash and in its order, so that neither files nor partitions matter."""
    keyed = documents_of(docs).where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("key"))
    mine = keyed.where(F.pmod("key", F.lit(8)).isin(*shares))
    return mine.repartition(shards, F.shiftright("key", 3)).sortWithinPartitions("key", "text").select("text")


def _train_round(docs: DataFrame, net: Network) -> np.ndarray:
    """Weights averaged over shards by the words they saw; each starts from ``net``."""
    words, start = net.words, net.weights()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed()
        own, memory, seen = Network(words, start), {}, 0
        rest = np.full(SIDE, PAD, np.uint16)
        for b in batches:
            for s in textnum.segments(b["text"], textnum.SPACE, lower=True):
                stream, at, _ = own.stream(s)
                seen += len(at)
                rest = np.append(rest, stream[SIDE:])
                while len(rest) >= STEP + 2 * SIDE:
                    own.train(rest[: STEP + 2 * SIDE], memory)
                    rest = rest[STEP:]
        if len(rest) > 2 * SIDE:
            own.train(rest, memory)
        if seen:
            w, shard = own.weights(), TaskContext.get().partitionId()
            pieces = [w[i : i + PART].astype("<f4").tobytes() for i in range(0, len(w), PART)]
            n = len(pieces)
            yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, shard)), pa.array(np.full(n, seen)), pa.array(pieces, pa.binary())], ["part", "shard", "seen", "w"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = {}, {}
        for b in batches:
            for part, n, w in zip(b["part"].to_pylist(), b["seen"].to_pylist(), b["w"], strict=True):
                total[part] = total.get(part, 0.0) + n * np.frombuffer(w.as_buffer(), "<f4").astype(float)
                seen[part] = seen.get(part, 0) + n
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([(total[p] / seen[p]).astype("<f4").tobytes() for p in total], pa.binary())], ["part", "w"])

    parts = -(-len(start) // PART)
    sent = docs.mapInArrow(train, "part int, shard long, seen long, w binary")
    rows = sent.repartitionById(parts, "part").sortWithinPartitions("part", "shard").mapInArrow(average, "part int, w binary").collect()
    out = start.copy()
    for r in rows:
        w = np.frombuffer(r["w"], "<f4")
        out[r["part"] * PART : r["part"] * PART + len(w)] = w
    return out


def fit(docs: DataFrame) -> Network:
    """The vocabulary of all words' counts, then rounds of training in every shard and averaging; keeps the counts for ``score``."""
    counts = settle(word_counts(docs), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    order = [F.desc("n"), "word"]
    top = counts.orderBy(*order).limit(WORDS).collect()
    net = Network(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    for shares in ROUNDS:
        net.set(_train_round(_shards(docs, -(-total // SHARD_WORDS) or 1, shares), net))
    rest = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(r["word"],) for r in top], "word long")), "word", "left_anti")
    net.sizes = np.ones(HASHED)
    for r in rest.groupBy(F.pmod("word", F.lit(HASHED)).alias("b")).agg(F.sum("n").alias("n")).collect():
        net.sizes[r["b"]] += r["n"]
    # a word that occurs once counts as much as one that the corpus lacks: log 1
    often = rest.where("n > 1")
    told = often.orderBy(*order).limit(TOLD).toArrow()
    word, n = told["word"].to_numpy(), told["n"].to_numpy()
    at = np.argsort(word.view(np.uint64))
    net.told, net.told_n = word.view(np.uint64)[at], n[at]
    if len(n) >= TOLD:
        last = np.lexsort((word, -n))[-1]  # of equal counts the smaller hashes are told
        least = F.lit(int(n[last]))
        net.joined = often.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > F.lit(int(word[last])))))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, sum_logprob, mean_logprob: one row for each row of ``docs``.

    Null and empty texts have no tokens and score 0. Repeated rows score alike;
    extra columns are ignored.
    """
    words, weights, sizes, told, told_n = net.words, net.weights(), net.sizes, net.told, net.told_n
    join = net.joined is not None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed()
        own, row = Network(words, weights), TaskContext.get().partitionId() << 40
        log_size, log_n = np.log(sizes), np.log(np.append(told_n, 1))
        for b in batches:
            for s in textnum.segments(b["text"], textnum.SPACE, lower=True):
                stream, at, h = own.stream(s)
                token, lp = stream[at].astype(np.int64), own.log_prob(stream)[at - SIDE]
                hashed = np.flatnonzero(token >= WORDS)
                at = np.searchsorted(told, h[hashed])
                at[np.append(told, ~h[-1:])[at] != h[hashed]] = len(told)
                lp[hashed] += log_n[at] - log_size[token[hashed] - WORDS]
                total = np.bincount(s.doc, weights=lp, minlength=s.n)
                rows = pa.array(np.arange(row, row + s.n))
                yield pa.record_batch([rows, b["doc_id"].slice(s.first, s.n), pa.array(s.words.astype(np.int64)), pa.array(total), pa.nulls(s.n, pa.int64())], names)
                if join and len(some := hashed[at == len(told)]):
                    yield pa.record_batch([pa.array(row + s.doc[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.float64()), pa.array(h[some].view(np.int64))], names)
                row += s.n

    names = ["row", "doc_id", "n_tokens", "sum_logprob", "word"]
    found = documents_of(docs).mapInArrow(scored, "row long, doc_id long, n_tokens long, sum_logprob double, word long")
    if join:
        found = settle(found, "lm-parts")
        parts = found.where("word is not null").select("row", "word").join(net.joined, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        found = found.where("word is null").join(parts, "row", "left").withColumn("sum_logprob", F.col("sum_logprob") + F.coalesce("more", F.lit(0.0)))
    return found.select("doc_id", "n_tokens", "sum_logprob", (F.col("sum_logprob") / F.greatest("n_tokens", F.lit(1))).alias("mean_logprob"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
