"""Substring deduplication with a log-structured fingerprint index.

A window of 20 words is fingerprinted by the smallest hash among its 8-word
grams: equal windows have equal fingerprints, and neighbouring windows mostly
share one, so that the index holds about one entry for seven words. Each batch
becomes an immutable run, bucketed and sorted by fingerprint, that is
merge-joined with the historical runs. Windows of matched fingerprints are then
verified: their full hashes decide exactly which of them start earlier
elsewhere. Runs are compacted when there are too many.

A fingerprint that a task meets in several documents is matched by that alone:
the task tells its documents at once, and the index gets one entry for them all,
so an entry's row is as short and a fingerprint's rows are as few as tasks.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum
from .store import documents_of, drop_path, new_path, partitions, settle, table

WINDOW, GRAM = 20, 8
#: Entries that a task gathers before it sorts them and passes them on.
FLUSH = 1_000_000
#: From this many documents of one task on, a fingerprint is one entry.
COMBINE = 3
#: Documents of a told list.
TOLD_LIST = 4096
#: Fewest tasks that compare full windows. A document's later windows come back in at most one row from each.
TASKS = 64


def _windows(s: textnum.Segment) -> tuple[np.ndarray, ...]:
    """First word, full hash, fingerprint, and word of the fingerprint's gram (the first, if equal) of each window of a segment."""
    rows = textnum.gram_rows(s, WINDOW)
    if not len(rows):
        return rows, rows.astype(np.uint64), rows.astype(np.uint64), rows
    h = s.word_hashes()
    least = textnum.grams(h, GRAM)
    at, span, reach = np.arange(len(least)), 1, WINDOW - GRAM + 1

    def lower(shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        right = least[shift : shift + n] < least[:n]
        return np.where(right, least[shift : shift + n], least[:n]), np.where(right, at[shift : shift + n], at[:n])

    while span * 2 <= reach:
        least, at = lower(span, len(least) - span)
        span *= 2
    least, at = lower(reach - span, len(h) - WINDOW + 1)
    return rows, textnum.grams(h, WINDOW)[rows], least[rows], at[rows]


def _gather(batches: Iterator[pa.RecordBatch], each, flush, limit: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """Calls ``each`` on every segment of a task, and ``flush`` on the gathered arrays at every ``limit`` entries."""
    held, n = [], 0
    for b in batches:
        for s in textnum.segments(b["text"], textnum.SPACE):
            got = each(b, s)
            held.append(got)
            n += len(got[0])
            if n >= limit:
                yield from flush(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if n:
        yield from flush(*map(np.concatenate, zip(*held, strict=True)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """place, fp, doc_id, told: entries of the index (place is the fingerprint; no fp, no told), and lists of documents of one task that share fp (told; place: any)."""

    def each(b: pa.RecordBatch, s: textnum.Segment):
        rows, _, fp, at = _windows(s)
        doc = b["doc_id"].to_numpy()[s.first + s.doc[rows]]
        new = np.ones(len(fp), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (at[1:] != at[:-1]) | (s.doc[rows[1:]] != s.doc[rows[:-1]])
        return fp[new], doc[new]

    def flush(fp: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, fp))
        fp, doc = fp[order], doc[order]
        same = np.zeros(len(fp), bool)
        same[1:] = (fp[1:] == fp[:-1]) & (doc[1:] == doc[:-1])
        third = same.copy()
        third[1:] &= same[:-1]  # a document that repeats a fingerprint stands twice
        fp, doc, same = fp[~third], doc[~third], same[~third]
        head = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        size = np.diff(np.append(head, len(fp)))
        many = (size >= COMBINE) | np.logical_or.reduceat(same, head)
        entry = np.repeat(~many, size)
        entry[head] = True
        n, names = int(entry.sum()), ["place", "fp", "doc_id", "told"]
        yield pa.record_batch([pa.array(fp[entry].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(doc[entry]), pa.nulls(n, pa.list_(pa.int64()))], names)
        if many.any():
            fp, doc = fp[np.repeat(many, size)], doc[np.repeat(many, size)]
            at = np.arange(len(fp)) - np.repeat(np.cumsum(size[many]) - size[many], size[many])
            head = np.flatnonzero(at % TOLD_LIST == 0)
            lists = pa.ListArray.from_arrays(np.append(head, len(fp)).astype(np.int32), pa.array(doc))
            place = textnum.mix(fp[head] + doc[head].astype(np.uint64)).view(np.int64)
            yield pa.record_batch([pa.array(place), pa.array(fp[head].view(np.int64)), pa.array(doc[head]), lists], names)

    known = documents_of(docs).where("doc_id is not null and text is not null")
    return known.mapInArrow(lambda batches: _gather(batches, each, flush), "place long, fp long, doc_id long, told array<long>")


class FingerprintIndex:
    """Immutable runs of fingerprints in the shared folder, bucketed and sorted; at ``fanout`` runs they are merged into one.

    ``runs`` (names and paths of tables) of an index that was not closed open it again.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, runs: list[tuple[str, str]] | None = None, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.runs: list[tuple[str, str]] = list(runs or [])

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        """rows: dealt to tasks by ``place`` already."""
        name, path = f"fingerprints_{uuid.uuid4().hex}", new_path(self.spark, "run")
        rows.write.partitionBy("kind").bucketBy(self.buckets, "place").sortBy("place").option("path", path).saveAsTable(name)
        return name, path

    def _entries(self, name: str) -> DataFrame:
        return self.spark.table(name).where("kind = 'entry'").select("place", "doc_id")

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Adds a batch; returns doc_id, fp (with repeats) of new and old documents that share a fingerprint through it."""
        rows = fingerprints(batch).repartition(self.buckets, "place")
        run = self._write(rows.withColumn("kind", F.when(F.col("told").isNull(), "entry").otherwise("told")))
        new = self._entries(run[0])
        inside = new.withColumn("n", F.count("*").over(Window.partitionBy("place"))).where("n > 1").drop("n")
        found = [inside]
        for name, _ in self.runs:
            old = self._entries(name)
            found.append(new.join(old.select("place").hint("merge"), "place", "left_semi"))
            found.append(old.join(new.select("place").hint("merge"), "place", "left_semi"))
        told = self.spark.table(run[0]).where("kind = 'told'").select(F.explode("told").alias("doc_id"), "fp")
        matched = reduce(DataFrame.unionByName, [x.select("doc_id", F.col("place").alias("fp")) for x in found], told)
        pairs = settle(matched, "matched")
        self.runs.append(run)
        if len(self.runs) >= self.fanout:
            self.compact()
        return pairs

    def compact(self) -> None:
        """Merges all runs' entries into one run. Runs are read bucket by bucket, so nothing is shuffled."""
        merged = reduce(DataFrame.unionByName, [self._entries(name) for name, _ in self.runs])
        merged = merged.select("place", F.lit(None).cast("long").alias("fp"), "doc_id", F.lit(None).cast("array<long>").alias("told"), F.lit("entry").alias("kind"))
        old, self.runs = self.runs, [self._write(merged)]
        self._drop(old)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)

    def close(self) -> None:
        self._drop(self.runs)
        self.runs = []


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id of each document whose whole text stands under a smaller doc_id too."""
    keyed = documents_of(docs).where("doc_id is not null and text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    first = settle(keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("key", "first"), "copies")
    return keyed.join(first, "key").where("doc_id > first").select("doc_id").distinct()


def _pack(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Window starts by document, as little-endian int32."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype("<i4")
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    cuts = np.append(head, len(doc))
    return pa.record_batch([pa.array(doc[head]), pa.array([start[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary())], ["doc_id", "starts"])


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of matched fingerprints: the first of each task as h, fp, doc_id, start; the others, which start later, packed."""

    def each(b: pa.RecordBatch, s: textnum.Segment):
        rows, h, fp, _ = _windows(s)
        offsets = b["fps"].offsets.to_numpy()[s.first : s.first + s.n + 1]
        wanted = b["fps"].values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
        owner = np.repeat(np.arange(s.n), np.diff(offsets))
        # fingerprint and owner in one hash: a pair is wanted if its document lists it
        key = lambda f, d: textnum.mix(f + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live = np.isin(key(fp, s.doc[rows]), key(wanted, owner))
        rows, h, fp = rows[live], h[live], fp[live]
        return h, fp, b["doc_id"].to_numpy()[s.first + s.doc[rows]], rows - s.begin[s.doc[rows]]

    def flush(h, fp, doc, start) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((start, doc, fp, h))
        h, fp, doc, start = h[order], fp[order], doc[order], start[order]
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (doc > doc[first]) | (start > start[first])
        n = int(head.sum())
        names = ["h", "fp", "doc_id", "start", "starts"]
        yield pa.record_batch([pa.array(h[head].view(np.int64)), pa.array(fp[head].view(np.int64)), pa.array(doc[head]), pa.array(start[head].astype(np.int32)), pa.nulls(n, pa.binary())], names)
        packed = _pack(doc[later], start[later])
        yield pa.record_batch([pa.array(textnum.mix(packed["doc_id"].to_numpy().astype(np.uint64)).view(np.int64)), pa.nulls(len(packed), pa.int64()), packed["doc_id"], pa.nulls(len(packed), pa.int32()), packed["starts"]], names)

    yield from _gather(batches, each, flush)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, fp, doc_id, start: every window but the first of its kind, packed by document."""
    last, docs, starts, n = None, [], [], 0
    for b in batches:
        done = b.filter(b["starts"].is_valid())
        if len(done):
            yield done.select(["doc_id", "starts"])
        b = b.filter(b["starts"].is_null())
        if not len(b):
            continue
        h, fp, doc, start = (b[c].to_numpy() for c in ("h", "fp", "doc_id", "start"))
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])])
        if last and last[:2] == (h[0], fp[0]):
            head[0] = False
        group = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        first_doc = np.append(doc[at], last[2] if last else 0)[group]  # group -1: the kind that the batch before began
        first_start = np.append(start[at], last[3] if last else 0)[group]
        later = (doc > first_doc) | ((doc == first_doc) & (start > first_start))
        docs.append(doc[later])
        starts.append(start[later])
        n += int(later.sum())
        last = (h[-1], fp[-1], first_doc[-1], first_start[-1])
        if n >= FLUSH:
            yield _pack(np.concatenate(docs), np.concatenate(starts))
            docs, starts, n = [], [], 0
    if n:
        yield _pack(np.concatenate(docs), np.concatenate(starts))


def later_windows(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, starts (list of packed int32): verified windows that also start earlier; ``pairs`` from the index."""
    n = max(TASKS, partitions(docs.sparkSession))
    lists = pairs.distinct().groupBy("doc_id").agg(F.collect_list("fp").alias("fps"))
    seen = docs.join(lists, "doc_id").mapInArrow(_suspects, "h long, fp long, doc_id long, start int, starts binary")
    dealt = seen.repartition(n, "h").sortWithinPartitions("h", "fp", "doc_id", "start")
    return dealt.mapInArrow(_later, "doc_id long, starts binary")


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b["text"].cast(pa.binary())
        n_words, n_removed, sha, kept_text = [], [], [], []
        for text, starts, copy in zip(texts, b["starts"].to_pylist(), b["copy"].to_pylist(), strict=True):
            words = (text.as_py() or b"").split()  # bytes split at blanks and \x09-\x0D, as the word rule does
            n = len(words)
            covered = np.zeros(n + 1, np.int32)
            if copy and n >= WINDOW:
                covered[0] += 1
            elif starts:
                at = np.concatenate([np.frombuffer(x, "<i4") for x in starts])
                at = at[at + WINDOW <= n]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + WINDOW, -1)
            gone = np.cumsum(covered[:n]) > 0
            kept = b" ".join(itertools.compress(words, ~gone) if gone.any() else words)
            n_words.append(n)
            n_removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode() if with_text else None)
        out = [b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        yield pa.record_batch(out[: 4 + with_text], names[: 4 + with_text])


def dedup_substrings(docs: DataFrame, batches: int = 3, fanout: int = 2, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept): one row for each row of ``docs``.

    A word goes if a 20-word window over it also starts earlier (smaller doc_id,
    or same document and earlier start). The corpus enters the index in
    ``batches`` batches by hash of doc_id, and its runs are compacted at ``fanout``. Null and empty texts have no words; a
    null doc_id keeps all its words and repeats no other's; rows that repeat a
    doc_id are one document, none earlier than the other. Extra columns are
    ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = documents_of(docs)
    index = FingerprintIndex(spark, fanout)
    pairs = None
    for k in range(batches):
        got = index.ingest(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
        pairs = pairs.unionByName(got) if pairs else got
    index.close()
    copies = settle(exact_copies(docs), "copies")
    pairs = pairs.join(copies, "doc_id", "left_anti")  # their windows start earlier by definition
    marks = later_windows(docs, pairs).withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    marks = marks.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"), F.bool_or("copy").alias("copy"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return docs.join(marks, "doc_id", "left").mapInArrow(lambda b: _kept(b, with_text), schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, s + i AS p FROM later, range({WINDOW}) r(i)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
