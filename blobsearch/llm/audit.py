"""Filter interaction audit: what each quality filter removes, in every order of application.

The five filters are judged once for each document. Documents of equal verdicts
are counted for each part, which leaves 32 counts for each part and label; these
are a 2x2x2x2x2 tensor with an axis for each filter. Every step of every order
is then a contraction: along each axis it selects pass, fail or all.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum
from .store import partitions, table

#: A: under so many words; B: under so many distinct words in 100; C: over so many capitals in 100 code points; D: holds one of these.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
FILTERS = "ABCDE"
#: What is counted of each set of documents: all, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")

_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_LEAD = np.ones(256, np.int64)
_LEAD[128:192] = 0
_MARK = np.zeros(256, np.int64)
_MARK[list(MARKS)] = 1


def text_failures(seg: textnum.Segment) -> np.ndarray:
    """Which of the filters A to D each text of a segment fails, as bits from A = 1 on."""
    starts = np.concatenate([[0], seg.borders[:-1]])
    count = lambda t: np.add.reduceat(t[seg.data], starts)  # noqa: E731  every text has its closing separator
    h = seg.word_hashes()
    order = np.lexsort((h, seg.doc))
    hs, ds = h[order], seg.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=seg.n)
    points = count(_LEAD) - 1
    fails = (seg.words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * seg.words, 100 * count(_CAPITAL) > MOST_CAPITALS * points, count(_MARK) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in textnum.segments(b["text"], textnum.SPACE):
            one = b.slice(s.first, s.n)
            yield pa.record_batch([one["doc_id"], one["part"], one["same"], pa.array(text_failures(s), pa.int32())], ["doc_id", "part", "same", "fails"])


def verdicts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, fails int (a bit for each filter, A = 1 to E = 16), n, good, toxic: documents of equal part and verdicts, counted.

    Copies of a text are told by SHA-256. They meet in counts only: rows of one
    text are first counted by doc_id, then by part and labels with the smallest
    doc_id, so that a text of very many rows is a few rows in the last shuffle.
    """
    slot = lambda: F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("same"), F.lit(1 << 20))).otherwise(F.lit(0).cast("long"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text"))
    judged = rows.mapInArrow(_judged, "doc_id long, part string, same binary, fails int")
    # equal rows are one; rows without doc_id are spread, for no label can meet them
    once = judged.groupBy("doc_id", "part", "same", "fails").agg(F.count("*").alias("n")).withColumn("slot", slot()).withColumn("key", F.coalesce("doc_id", F.lit(0)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = once.join(marks.withColumn("slot", F.lit(0).cast("long")), ["key", "slot"], "left")
    no = F.lit(False)
    texts = known.groupBy("same", "part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    # smallest doc_id of the text; rows of that doc_id and rows without one pass E
    least = F.min("first").over(Window.partitionBy("same"))
    passed = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    both = texts.withColumn("least", least).withColumn("passed", passed).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("fails"), F.col("passed").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("passed")).alias("n")))).alias("x"),
    )
    flag = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
    return both.groupBy("part", F.col("x.fails").alias("fails")).agg(F.sum("x.n").alias("n"), flag("good"), flag("toxic"))


def steps(filters: str = FILTERS) -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray]:
    """Every (order, step), and for each axis what the step's tensor of kept documents and that of removed ones select: rows x axes x (pass, fail)."""
    every, kept, removed = [], [], []
    for order in permutations(range(len(filters))):
        for k, f in enumerate(order):
            select = np.ones((len(filters), 2), np.int64)
            select[list(order[:k]), 1] = 0
            gone = select.copy()
            select[f, 1] = 0
            gone[f, 0] = 0
            every.append(("".join(filters[i] for i in order), k + 1))
            kept.append(select)
            removed.append(gone)
    return every, np.array(kept), np.array(removed)


def contract(tensor: np.ndarray, select: np.ndarray) -> np.ndarray:
    """counts x 2 x ... x 2 by rows x axes x 2: rows x counts."""
    axes = string.ascii_lowercase[: select.shape[1]]
    return np.einsum(f"Z{axes},{','.join(f'Y{a}' for a in axes)}->YZ", tensor, *(select[:, i] for i in range(select.shape[1])), optimize=True)


def interactions(tensor: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """The columns of ``audit`` for one part, a row for each (order, step); tensor: COUNTS x 2 x ... x 2 (pass, fail along each axis)."""
    every, kept, removed = steps(filters)
    own = np.array([filters.index(order[k - 1]) for order, k in every])
    gone = contract(tensor, removed)
    alone, failing = np.zeros((2, len(filters), len(filters), 2), np.int64)
    alone[:, :, 0], failing[:] = 1, 1
    at = np.arange(len(filters))
    alone[at, at], failing[at, at] = [0, 1], [0, 1]
    return {
        "kept": contract(tensor, kept)[:, 0], "removed": gone[:, 0], "redundant": contract(tensor, failing)[own, 0] - gone[:, 0], "unique_fails": contract(tensor, alone)[own, 0],
        "good_lost": gone[:, 1], "toxic_lost": gone[:, 2], "shapley": np.bincount(own, weights=gone[:, 0], minlength=len(filters)).astype(np.int64)[own],
    }


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty, a null part is ''. A row without doc_id has no label, is
    no copy and has none. Of several labels of a document any that says so counts.
    Rows that repeat doc_id and text are counted each, and none is the copy of
    another. Extra columns are ignored; an empty table has no parts and no rows.
    """
    names = list(interactions(np.zeros((3, *[2] * 5), np.int64)))
    every, _, _ = steps()
    cells = verdicts(docs, labels, part)
    one = cells.groupBy("part").agg(F.collect_list(F.struct("fails", *COUNTS)).alias("cells"))

    def tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, cells in zip(b["part"].to_pylist(), b["cells"].to_pylist(), strict=True):
                # bit 0 (A) is the last axis of the array and the first of the tensor
                flat = np.zeros((len(COUNTS), 32), np.int64)
                for c in cells:
                    flat[:, c["fails"]] = [c[k] for k in COUNTS]
                tensor = flat.reshape(len(COUNTS), *[2] * 5).transpose(0, 5, 4, 3, 2, 1)
                found = interactions(tensor)
                yield pa.record_batch(
                    [pa.array([part] * len(every)), pa.array([o for o, _ in every]), pa.array([k for _, k in every], pa.int32()), *[pa.array(found[c]) for c in names]],
                    ["part", "filter_order", "step", *names],
                )

    # a part's 32 counts are one row: parts are spread however many they are
    spread = one.repartition(partitions(docs.sparkSession), "part")
    return spread.mapInArrow(tensors, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_WORDS = "list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(w) < {LEAST_WORDS} AS a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > least, FALSE) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM x p, x q, x r, x s, x u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda i: substr('{FILTERS}', i, 1)), '') AS filter_order, k.i AS step, o[k.i] AS own FROM orders, x k),
per AS (SELECT part, filter_order, step, own, n, good, toxic, list_position(list_transform(o, lambda i: fails[i]), TRUE) AS gone, fails[own] AS hit, len(list_filter(fails, lambda y: y)) AS n_fails FROM steps, cells),
s AS (SELECT part, filter_order, step, own, sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN hit AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM per GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM s
"""
