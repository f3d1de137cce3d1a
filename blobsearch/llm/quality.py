"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document becomes a short vector of transformed statistics of its whole
text. Class means and covariances come from one distributed aggregation over
all labelled training rows; each covariance is shrunk towards the pooled one
and towards a scaled identity. A score is the logistic of the difference of the
two Gaussian log densities, from Mahalanobis distances solved with Cholesky
factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .store import documents_of, settle, small_batches, table

FEATURES = (
    "log_words", "word_length", "word_length_sd", "distinct_words", "repeat_pairs", "upper", "digits",
    "marks", "odd_symbols", "pipes", "exclamations", "non_ascii", "lines_per_word", "top_word", "sentence_ends",
)

#: Score from which a document is predicted to be good.
THRESHOLD = 0.3

_SCHEMA = "doc_id long, held_out boolean, stats array<double>"


def _class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars)] = 1
    return out


_UPPER = _class_table(bytes(range(65, 91)))
_DIGIT = _class_table(b"0123456789")
_MARKS = _class_table(b".,;:?'\"()-")
_ODD = _class_table(b"*$%&#@^~=+<>{}[]\\_")
_HIGH = _class_table(bytes(range(192, 256)))
_CONT = _class_table(bytes(range(128, 192)))


def statistics(seg: textnum.Segment) -> np.ndarray:
    """One row of FEATURES for each text of a segment; an empty text gives zeros."""
    n = seg.n
    length = np.bincount(seg.doc, weights=seg.end - seg.start, minlength=n)
    squares = np.bincount(seg.doc, weights=(seg.end - seg.start).astype(float) ** 2, minlength=n)
    words = np.maximum(seg.words, 1).astype(float)
    starts = np.concatenate([[0], seg.borders[:-1]])
    count = lambda t: np.add.reduceat(t[seg.data], starts)  # noqa: E731  every text has its closing separator
    chars = np.maximum(count(1 - _CONT - textnum.SPACE), 1)

    h = seg.word_hashes()
    order = np.lexsort((h, seg.doc))
    hs, ds = h[order], seg.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, ds[new], runs)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (seg.doc[1:] == seg.doc[:-1])
    repeats = np.bincount(seg.doc[same], minlength=n)

    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))
    mean = length / words
    out = np.stack([
        np.log1p(seg.words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(squares / words - mean**2, 0))),
        share(distinct, words), share(repeats, words), share(count(_UPPER), chars), share(count(_DIGIT), chars),
        share(count(_MARKS), chars), share(count(_ODD), chars), share(count(_class_table(b"|")), chars),
        share(count(_class_table(b"!")), chars), share(count(_HIGH), chars), share(count(_class_table(b"\n")), words),
        share(top, words), share(count(_class_table(b".?!")), words),
    ], axis=1)
    out[seg.words == 0] = 0
    return out


def _stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(s) for s in textnum.segments(b["text"], textnum.SPACE, limit=textnum.SMALL_BYTES)]
        x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        offsets = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
        yield pa.record_batch([b["doc_id"], b["held_out"], pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "held_out", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, stats. held_out: crc32 of doc_id as text, modulo 5, is 0; a null doc_id is held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return documents_of(docs).withColumn("held_out", held).mapInArrow(_stats_of, _SCHEMA)


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of the two classes. ``only`` is the score where a class has no rows."""

    means: np.ndarray
    inverses: np.ndarray
    offsets: np.ndarray
    only: float | None = None

    @staticmethod
    def fit(n: np.ndarray, means: np.ndarray, covs: np.ndarray, shrink: float = 0.3, ridge: float = 1e-3) -> Discriminant:
        """n, means, covs of classes 0 and 1. shrink: weight of the pooled covariance; ridge: of its mean variance."""
        if min(n) < 2:
            return Discriminant(means, covs, np.zeros(2), float(np.clip((n[1] + 1) / (n.sum() + 2), 0, 1)))
        pooled = (covs * n[:, None, None]).sum(0) / n.sum()
        mixed = (1 - shrink) * covs + shrink * pooled
        mixed += (ridge * np.trace(pooled) / len(pooled) + 1e-9) * np.eye(len(pooled))
        factors = np.linalg.cholesky(mixed)
        logdet = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
        return Discriminant(means, np.linalg.inv(factors), np.log(n / n.sum()) - 0.5 * logdet)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        density = []
        for k in (0, 1):
            z = self.inverses[k] @ (x - self.means[k]).T
            density.append(self.offsets[k] - 0.5 * (z * z).sum(0))
        # densities of far-off texts differ by hundreds: tempered by the number of statistics
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / len(FEATURES), -60, 60)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on every labelled row that is not held out; only the class moments reach the driver."""
    d = len(FEATURES)
    y = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    x = stats.where("not held_out").join(y, "doc_id").select("quality", *[F.col("stats")[i].alias(f"x{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = x.groupBy("quality").agg(
        F.count("*").alias("n"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).collect()
    n, means, covs = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        k = int(r["quality"])
        n[k], means[k] = r["n"], [r[f"m{i}"] for i in range(d)]
        for i, j in pairs:
            covs[k, i, j] = covs[k, j, i] = r[f"c{i}_{j}"]
    return Discriminant.fit(n, means, covs)


def _model(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant]:
    stats = settle(document_statistics(docs), "quality-stats")
    return stats, fit(stats, labels)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    Null and empty texts have all-zero statistics and are scored like any other.
    Rows of ``labels`` with a null or other label are not learned from; of
    several labels of one document the smallest counts. Without rows of both
    classes every document gets the smoothed share of label 1. Repeated rows
    get equal scores; extra columns are ignored.
    """
    stats, model = _model(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b["stats"].flatten(), float).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.record_batch([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go.

    Every row is judged by its own text where it stands, so rows without doc_id or
    with a repeated one are judged like any other, and nothing is joined back.
    Null and empty texts are scored too. Columns are kept as they are.
    """
    small_batches(spark)
    _, model = _model(docs, table(spark, sf_dir, "labels"))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in textnum.segments(b["text"], textnum.SPACE, limit=textnum.SMALL_BYTES):
                yield b.slice(s.first, s.n).filter(pa.array(model.score(statistics(s)) >= THRESHOLD))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(good, docs.schema)
