"""Personal data by rules and a character-level bidirectional LSTM with CRF transitions.

The rules find the base spans. Their matches in a bounded sample of the corpus,
rewritten into forms that the rules miss, are the labelled spans on which the
network is trained, in numpy. It reads overlapping windows; each character's
scores are those of the window in which it stands nearest to the middle, and
one Viterbi pass over each connected stretch of windows decides all spans
together. A span must hold a digit, '@' or a bracketed 'at', so windows
without any of these cannot hold one and are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents_of, small_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Base spans that training takes at most; each gives a window as it stands, one rewritten and one without it.
SAMPLE = 600
WINDOW, STRIDE, BATCH = 96, 48, 512
EMBED, HIDDEN = 12, 20
#: Training: steps of a batch of windows, the rate's start (it falls to a tenth), and the largest norm of a step's gradient.
STEPS, RATE, CLIP = 300, 0.02, 5.0
#: Mean margin of a span's tags over "outside" from which a span of the network counts.
MARGIN = 0.0
TRIGGER = re.compile(r"[0-9@]|[(\[] ?at ?[)\]]")

_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)|[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[^0-9]")
_AT = re.compile(r"@|[(\[] ?at ?[)\]]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, sorted by start, then kind. Time is linear in the text."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, end := m.end(), "email"))
        at = text.find("@", max(at + 1, end))
    # a run of digits that begins no address is passed over whole: no later start in it can
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if m.end() - m.start() < 60 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- labelled spans ---------------------------------------------------------


def rewrite(value: str, kind: str, r: np.random.Generator) -> str:
    """The same kind of datum with other characters, often in a form that the rules miss."""
    value = re.sub("[0-9]", lambda m: str(r.integers(10)), value)
    value = re.sub("[a-z]", lambda m: chr(97 + int(r.integers(26))), value) if kind == "email" and r.random() < 0.3 else value
    form = int(r.integers(3))
    if kind == "email" and "@" in value:
        return value.replace("@", ("@", "(at)", " [at] ")[form])
    if kind == "phone":
        bare = value.lstrip("+")
        return (value, re.sub(r"^[0-9]{1,3}[ .-]?(?=\()", "", bare), bare)[form]
    if kind == "card":
        digits = _DIGITS.sub("", value)
        return (digits, ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "-".join(digits[i : i + 4] for i in range(0, len(digits), 4)))[form]
    return (value, value.replace(".", "[.]"), value.replace(".", " . "))[form] if kind == "ip" else value


def labelled_windows(docs: DataFrame, limit: int = SAMPLE) -> list[tuple[str, list[Span]]]:
    """Windows (text, spans) around at most ``limit`` base spans, chosen by hash of document and place.

    Each span gives three: without it (other digits and plain words are what the
    network has to leave alone), as it stands, and rewritten.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                for s, e, kind in base_spans(text) if text and TRIGGER.search(text) else ():
                    h = int.from_bytes(hashlib.blake2b(f"{doc}:{s}:{kind}".encode(), digest_size=7).digest())
                    before = h % (WINDOW - 16)  # the span's place in its window varies
                    rows.append((kind, text[max(0, s - before) : s], text[s:e], text[e : e + WINDOW - before], h))
            yield pa.RecordBatch.from_pylist([dict(zip(_CUT, r, strict=True)) for r in rows], schema=_CUT_SCHEMA)

    rows = documents_of(docs).where(F.col("text").rlike("[0-9]")).mapInArrow(cut, "kind string, l string, v string, r string, h long")
    picked = rows.where(F.length("v") < WINDOW // 2).orderBy("h", "kind", "v").limit(limit).collect()
    out = []
    for row in picked:
        r = np.random.default_rng(row["h"])
        plain = str(r.integers(10 ** int(r.integers(1, 8)))) if r.random() < 0.5 else ""
        out.append((row["l"] + plain + row["r"], base_spans(row["l"] + plain + row["r"])))
        for value in (row["v"], rewrite(row["v"], row["kind"], r)):
            text, own = row["l"] + value + row["r"], (len(row["l"]), len(row["l"]) + len(value), row["kind"])
            out.append((text, combined([own], base_spans(text))))
    return out


_CUT = ("kind", "l", "v", "r", "h")
_CUT_SCHEMA = pa.schema([("kind", pa.string()), ("l", pa.string()), ("v", pa.string()), ("r", pa.string()), ("h", pa.int64())])

# --- the network ------------------------------------------------------------

#: Character classes: padding, ASCII marks as they are, one each for digits, small and capital letters and others. Tags: outside, then B and I of each kind.
N_CHARS, N_TAGS = 130, 1 + 2 * len(KINDS)
_CLASS = np.arange(1, 130)
for _first, _last in ("09", "az", "AZ"):
    _CLASS[ord(_first) : ord(_last) + 1] = ord(_first) + 1


def encode(text: str) -> np.ndarray:
    """Character classes of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(c, 128)]


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for s, e, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[s:e] = k + 1
        out[s : s + 1] = k
    return out


def _allowed() -> np.ndarray:
    """Transitions a -> b that tags allow: I only after B or I of its kind."""
    ok = np.ones((N_TAGS, N_TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()
_FAR = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    """Embedding, one LSTM in each direction, linear tag scores and CRF transitions; all weights in ``p``."""

    def __init__(self, seed: int = 3, p: dict[str, np.ndarray] | None = None):
        r = np.random.default_rng(seed)
        init = lambda *s: r.standard_normal(s) * s[0] ** -0.5
        self.p = p or {
            "e": r.standard_normal((N_CHARS, EMBED)) * 0.5,
            **{f"w{d}": init(EMBED + HIDDEN, 4 * HIDDEN) for d in "fb"},
            **{f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN) for d in "fb"},
            "o": init(2 * HIDDEN, N_TAGS), "ob": np.zeros(N_TAGS), "t": np.zeros((N_TAGS, N_TAGS)),
        }

    def transitions(self) -> np.ndarray:
        return np.where(ALLOWED, self.p["t"], self.p["t"].dtype.type(_FAR))

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x, mask: time first. Padding leaves the state as it is."""
        w, b = self.p[f"w{d}"], self.p[f"b{d}"]
        n = x.shape[1]
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        out = np.empty((len(x), n, HIDDEN), x.dtype)
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        xw = x @ w[:EMBED] + b
        for t in steps:
            g = xw[t] + h @ w[EMBED:]
            ifo = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            h2 = o * tc
            if keep is not None:
                keep.append((t, h, c, i, f, o, u, tc, m))
            c, h = np.where(m, c2, c), np.where(m, h2, h)
            out[t] = h
        return out

    def _lstm_back(self, x: np.ndarray, keep: list, dout: np.ndarray, d: str, grad: dict) -> np.ndarray:
        w = self.p[f"w{d}"]
        dx = np.zeros_like(x)
        dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN, x.dtype)
        dh, dc = np.zeros((x.shape[1], HIDDEN), x.dtype), np.zeros((x.shape[1], HIDDEN), x.dtype)
        for t, h, c, i, f, o, u, tc, m in reversed(keep):
            dh = dh + dout[t]
            dh2, dc2 = np.where(m, dh, 0), np.where(m, dc, 0)
            dct = dc2 + dh2 * o * (1 - tc * tc)
            dg = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), dh2 * tc * o * (1 - o), dct * i * (1 - u * u)], 1)
            dw[:EMBED] += x[t].T @ dg
            dw[EMBED:] += h.T @ dg
            db += dg.sum(0)
            dx[t] = dg @ w[:EMBED].T
            dh = np.where(m, 0, dh) + dg @ w[EMBED:].T
            dc = np.where(m, 0, dc) + dct * f
        grad[f"w{d}"], grad[f"b{d}"] = dw, db
        return dx

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores (time, window, tag) of windows (window, time) of character classes; 0 is padding."""
        x, mask = self.p["e"][chars.T], chars.T > 0
        return np.concatenate([self._lstm(x, mask, "f"), self._lstm(x, mask, "b")], 2) @ self.p["o"] + self.p["ob"]

    def loss_and_gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags (window, time) under the CRF. Windows end in padding only."""
        mask = chars.T > 0
        x = self.p["e"][chars.T]
        keep_f, keep_b = [], []
        hid = np.concatenate([self._lstm(x, mask, "f", keep_f), self._lstm(x, mask, "b", keep_b)], 2)
        em = hid @ self.p["o"] + self.p["ob"]
        tr, steps, n, y = self.transitions(), len(em), em.shape[1], tags.T
        alpha = np.empty_like(em)
        alpha[0] = em[0]
        for t in range(1, steps):
            alpha[t] = np.where(mask[t][:, None], _logsumexp(alpha[t - 1][:, :, None] + tr, 1) + em[t], alpha[t - 1])
        log_z = _logsumexp(alpha[-1], 1)
        beta = np.zeros_like(em)
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(mask[t + 1][:, None], _logsumexp(tr + (em[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        grid = np.arange(n)
        gold = em[0][grid, y[0]] * mask[0]
        dem = np.exp(alpha + beta - log_z[:, None])
        dtr = np.zeros_like(tr)
        dem[0][grid, y[0]] -= 1
        for t in range(1, steps):
            m = mask[t]
            gold = gold + m * (em[t][grid, y[t]] + tr[y[t - 1], y[t]])
            pair = np.exp(alpha[t - 1][:, :, None] + tr + (em[t] + beta[t])[:, None, :] - log_z[:, None, None])
            dtr += (pair * m[:, None, None]).sum(0)
            np.add.at(dtr, (y[t - 1][m], y[t][m]), -1)
            dem[t][grid, y[t]] -= 1
        dem *= mask[:, :, None]
        grad = {"t": dtr * ALLOWED, "o": np.einsum("tnh,tnk->hk", hid, dem), "ob": dem.sum((0, 1))}
        dhid = dem @ self.p["o"].T
        dx = self._lstm_back(x, keep_f, dhid[:, :, :HIDDEN], "f", grad) + self._lstm_back(x, keep_b, dhid[:, :, HIDDEN:], "b", grad)
        grad["e"] = np.zeros_like(self.p["e"])
        np.add.at(grad["e"], chars.T[mask], dx[mask])
        return float((log_z - gold).sum() / n), {k: g / n for k, g in grad.items()}

    def train(self, windows: list[tuple[str, list[Span]]], steps: int = STEPS, rate: float = RATE, batch: int = 32) -> None:
        """Adam with clipped gradients over seeded batches, in single precision."""
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        r = np.random.default_rng(5)
        m, v = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            chosen = [windows[i] for i in r.integers(0, len(windows), batch)]
            size = max(max(len(t) for t, _ in chosen), 1)
            chars, tags = np.zeros((batch, size), np.int64), np.zeros((batch, size), np.int64)
            for j, (text, spans) in enumerate(chosen):
                chars[j, : len(text)], tags[j, : len(text)] = encode(text), tags_of(len(text), spans)
            _, grad = self.loss_and_gradients(chars, tags)
            scale = min(1.0, CLIP / (np.sqrt(sum((g * g).sum() for g in grad.values())) + 1e-12))
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * scale * g
                v[k] = 0.99 * v[k] + 0.01 * (scale * g) ** 2
                self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)


def viterbi(em: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The best tags of one stretch (time, tag); it cannot begin inside a span."""
    score = em[0].copy()
    score[2::2] = _FAR
    back = np.zeros(em.shape, np.int8)
    for t in range(1, len(em)):
        step = score[:, None] + tr
        back[t] = step.argmax(0)
        score = step[back[t], np.arange(len(score))] + em[t]
    out = np.empty(len(em), np.int64)
    out[-1] = score.argmax()
    for t in range(len(em) - 1, 0, -1):
        out[t - 1] = back[t][out[t]]
    return out


def plausible(value: str, kind: str) -> bool:
    """What a span of the network has to hold at least."""
    if kind == "email":
        return bool(_AT.search(value))
    groups = re.findall("[0-9]+", value)
    digits = sum(map(len, groups))
    return {"ip": len(groups) >= 4, "card": 13 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def stretches(text: str) -> list[tuple[int, int]]:
    """Connected stretches of the fixed windows that hold a trigger."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        first = max(0, (m.start() - WINDOW) // STRIDE + 1) * STRIDE
        last = m.start() // STRIDE * STRIDE + WINDOW
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, min(b, len(text))) for a, b in out]


def model_spans(texts: list[str | None], net: BiLstmCrf) -> list[list[Span]]:
    """Spans of the network in each text. Overlapping windows are scored in batches; each character takes the window nearest to whose middle it stands."""
    todo = [(k, a, b) for k, t in enumerate(texts) if t for a, b in stretches(t)]
    out: list[list[Span]] = [[] for _ in texts]
    tr = net.transitions()
    at = 0
    while at < len(todo):
        # a batch of whole stretches, or one long stretch in pieces
        group, n = [], 0
        while at < len(todo) and (not group or n < BATCH):
            k, a, b = todo[at]
            group.append((k, a, b))
            n += max(1, -(-(b - a - WINDOW) // STRIDE) + 1)
            at += 1
        wins = [(g, x) for g, (_, a, b) in enumerate(group) for x in range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE)]
        ems = [np.full((b - a, N_TAGS), 0.0, np.float32) for _, a, b in group]
        near = [np.full(b - a, 1 << 30) for _, a, b in group]
        for i in range(0, len(wins), BATCH):
            part = wins[i : i + BATCH]
            chars = np.zeros((len(part), WINDOW), np.int64)
            for j, (g, x) in enumerate(part):
                k, _, b = group[g]
                piece = encode(texts[k][x : min(x + WINDOW, b)])
                chars[j, : len(piece)] = piece
            em = net.emissions(chars)
            for j, (g, x) in enumerate(part):
                _, a, b = group[g]
                size = min(WINDOW, b - x)
                far = np.abs(np.arange(size) - WINDOW // 2)
                here = slice(x - a, x - a + size)
                better = far < near[g][here]
                ems[g][here][better] = em[:size, j][better]
                near[g][here][better] = far[better]
        for (k, a, _), em in zip(group, ems, strict=True):
            tags = viterbi(em, tr)
            for s in np.flatnonzero(tags % 2 == 1):
                e = s + 1
                while e < len(tags) and tags[e] == tags[s] + 1:
                    e += 1
                margin = (em[np.arange(s, e), tags[s:e]] - em[s:e, 0]).mean()
                if e - s >= 6 and margin >= MARGIN and plausible(texts[k][a + int(s) : a + int(e)], KINDS[(tags[s] - 1) // 2]):
                    out[k].append((a + int(s), a + int(e), KINDS[(tags[s] - 1) // 2]))
    return out


def combined(base: list[Span], added: list[Span]) -> list[Span]:
    """Base spans stay; spans of the network that touch none of them are added."""
    free = [x for x in added if not any(x[0] < b[1] and b[0] < x[1] for b in base)]
    return sorted(base + free, key=lambda s: (s[0], KINDS.index(s[2])))


def fit(docs: DataFrame) -> BiLstmCrf | None:
    """The network trained on the corpus's labelled windows; None where it has none."""
    windows = labelled_windows(docs)
    if not windows:
        return None
    net = BiLstmCrf()
    net.train(windows)
    return net


def find(docs: DataFrame, net: BiLstmCrf | None) -> DataFrame:
    """doc_id, base and all (arrays of start, end, kind): one row for each row of ``docs``.

    Null texts are empty. A null doc_id is kept; repeated rows each get the same
    spans; extra columns are ignored; an empty table gives an empty result.
    """
    params = net.p if net else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BiLstmCrf(p=params) if params else None
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                texts = part["text"].to_pylist()
                texts = [t if t and TRIGGER.search(t) else None for t in texts]
                base = [base_spans(t) if t else [] for t in texts]
                added = model_spans(texts, own) if own else [[] for _ in texts]
                every = [combined(x, y) for x, y in zip(base, added, strict=True)]
                yield pa.record_batch([part["doc_id"], _spans(base), _spans(every)], ["doc_id", "base", "all"])

    return documents_of(docs).mapInArrow(search, f"doc_id long, base {_TYPE}, all {_TYPE}")


_TYPE = "array<struct<start:int,end:int,kind:string>>"


def _spans(rows: list[list[Span]]) -> pa.Array:
    t = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    return pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in r] for r in rows], t)


def _joined(c: str):
    return F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"))


def redact(texts: list[str | None], net: BiLstmCrf | None) -> list[str | None]:
    """Texts with each span, or stretch of overlapping spans, replaced by its kind in brackets."""
    live = [t if t and TRIGGER.search(t) else None for t in texts]
    added = model_spans(live, net) if net else [[] for _ in live]
    out = []
    for text, t, more in zip(texts, live, added, strict=True):
        if t:
            pieces, upto = [], 0
            for s, e, kind in combined(base_spans(t), more):
                if s >= upto:
                    pieces += [t[upto:s], f"[{kind.upper()}]"]
                upto = max(upto, e)
            text = "".join(pieces) + t[upto:]
        out.append(text)
    return out


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced in the texts, and n_chars follows.

    Every row is rewritten where it stands, whatever its doc_id; null and empty
    texts stay as they are, other columns are kept.
    """
    small_batches(spark)
    net = fit(docs)
    params, columns = (net.p if net else None), docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BiLstmCrf(p=params) if params else None
        for b in batches:
            at = b.schema.get_field_index("text")
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                new = pa.array(redact(part["text"].to_pylist(), own), pa.string())
                yield part.set_column(at, "text", new)

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(replace, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*columns) if "n_chars" in columns else out

