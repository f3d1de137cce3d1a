"""Ranked lexical search over a sharded index by Block-Max MaxScore.

A shard holds some thousand documents of one task: a sorted lexicon of term
hashes and, for each term, its postings in compressed blocks. For each block the
index keeps the least document length of every term frequency in it, from which
the block's greatest impact follows for any totals of the corpus, so shards are
written in one pass and need no totals. A query splits its lists by their bounds
in the shard: only essential lists give candidates; block maxima of the others
reject candidates before a block of theirs is decompressed. Each task keeps one
heap for each query over all its shards; the heaps are merged at last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum
from .store import Scratch, documents_of, partitions, table

K = 10
#: Postings of a block; documents and bytes of text of a shard, about; documents that a search with an open heap takes at first, doubled each time.
BLOCK, SHARD_DOCS, SHARD_BYTES, FIRST = 64, 16384, 8 << 20, 256
#: Terms of all items that are searched in one pass over the index, on average.
PASS_TERMS = 1_000_000

_PARTS = {
    "ids": np.int64, "lengths": np.int64, "terms": np.uint64, "list_start": np.int32, "block_first": np.int32, "block_last": np.int32,
    "block_size": np.uint8, "block_byte": np.int32, "gap_width": np.uint8, "tf_width": np.uint8, "peak_start": np.int32, "peak_tf": np.int32, "peak_n": np.int32, "payload": np.uint8,
}
_INDEX = "n_docs long, n_terms long, " + ", ".join(f"{k} binary" for k in _PARTS)


def _width(x: np.ndarray) -> np.ndarray:
    """Bytes, 1, 2 or 4, that a number takes."""
    return np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4)).astype(np.uint8)


def _put(out: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    for j in range(4):
        some = np.flatnonzero(width > j)
        out[at[some] + j] = (value[some] >> (8 * j)) & 255


def _get(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = data[at].astype(np.int64)
    for j in range(1, int(width.max(initial=1))):
        some = np.flatnonzero(width > j)
        out[some] |= data[at[some] + j].astype(np.int64) << (8 * j)
    return out


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. of each run of so many."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def build_shard(ids: np.ndarray, lengths: np.ndarray, h: np.ndarray, doc: np.ndarray) -> dict:
    """One shard: ids and lengths of its documents; h and doc are the term hash and the document's number of each word, documents ascending."""
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(hs)))
    term, who = hs[at], ds[at]
    first = np.ones(len(term), bool)
    first[1:] = term[1:] != term[:-1]
    lists = np.flatnonzero(first)
    sizes = np.diff(np.append(lists, len(term)))
    nth = _within(sizes)
    head = nth % BLOCK == 0
    starts = np.flatnonzero(head)
    count = np.diff(np.append(starts, len(term)))
    block = np.cumsum(head) - 1
    gap = np.zeros(len(term), np.int64)
    gap[1:] = who[1:] - who[:-1]
    gap[starts] = 0
    most = lambda x: np.maximum.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64)
    gw, tw = _width(most(gap)), _width(most(tf))
    byte = np.cumsum(count * (gw.astype(np.int64) + tw))
    payload = np.zeros(int(byte[-1]) if len(byte) else 0, np.uint8)
    begin = byte - count * (gw.astype(np.int64) + tw)
    inner = _within(count)
    _put(payload, begin[block] + inner * gw[block], gap, gw[block])
    _put(payload, begin[block] + count[block] * gw[block].astype(np.int64) + inner * tw[block], tf, tw[block])
    # least length of each frequency in a block
    n = lengths[who]
    o = np.lexsort((n, tf, block))
    peak = np.ones(len(o), bool)
    peak[1:] = (block[o][1:] != block[o][:-1]) | (tf[o][1:] != tf[o][:-1])
    peaks = o[peak]
    return {
        "ids": ids, "lengths": lengths, "terms": term[lists], "list_start": np.append(block[lists], len(starts)), "block_first": who[starts], "block_last": who[starts + count - 1],
        "block_size": count, "block_byte": begin, "gap_width": gw, "tf_width": tw, "peak_start": np.append(np.searchsorted(block[peaks], np.arange(len(starts))), len(peaks)),
        "peak_tf": tf[peaks], "peak_n": n[peaks], "payload": payload,
    }


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, lengths, h, doc, size = [], [], [], [], 0

    def row() -> pa.RecordBatch:
        s = build_shard(*(np.concatenate(x) for x in (ids, lengths, h, doc)))
        data = [pa.array([s[k].astype(t).tobytes()], pa.binary()) for k, t in _PARTS.items()]
        return pa.record_batch([pa.array([int((s["lengths"] > 0).sum())]), pa.array([int(s["lengths"].sum())]), *data], ["n_docs", "n_terms", *_PARTS])

    n = 0
    for b in batches:
        for s in textnum.segments(b["text"], textnum.NOT_WORD, lower=True):
            # documents without a term are in no list: their ids are not kept
            some = np.flatnonzero(s.words)
            place = np.cumsum(s.words > 0) - 1
            ids.append(b["doc_id"].slice(s.first, s.n).to_numpy(zero_copy_only=False)[some])
            lengths.append(s.words[some])
            h.append(s.word_hashes())
            doc.append(n + place[s.doc])
            n, size = n + len(some), size + len(s.data)
            if n >= SHARD_DOCS or size >= SHARD_BYTES:
                yield row()
                ids, lengths, h, doc, size, n = [], [], [], [], 0, 0
    if n:
        yield row()


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard. Null texts have no terms; rows without doc_id take no part. No shuffle: a shard is part of one task's input."""
    return documents_of(docs).where("doc_id is not null").mapInArrow(_shards, _INDEX)


class Shard:
    """A shard opened for searching; totals of the corpus make impacts of its postings."""

    def __init__(self, row: dict[str, bytes], n_docs: int, n_terms: int):
        self.__dict__ |= {k: np.frombuffer(row[k], t) for k, t in _PARTS.items()}
        self.m = 100 - 90 + (90 * self.lengths * n_docs) // n_terms
        self.docs = len(self.ids)
        peak = self.impact(self.peak_tf.astype(np.int64), 10 + (90 * self.peak_n.astype(np.int64) * n_docs) // n_terms)
        self.block_max = np.maximum.reduceat(peak, self.peak_start[:-1]) if len(peak) else peak
        self.list_max = np.maximum.reduceat(self.block_max, self.list_start[:-1]) if len(self.terms) else self.block_max
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.decoded = 0  # blocks

    @staticmethod
    def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term's list, -1 without one."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of ascending blocks of one list."""
        self.decoded += len(blocks)
        count = self.block_size[blocks].astype(np.int64)
        of = np.repeat(np.arange(len(blocks)), count)
        inner = _within(count)
        gw, tw, base = self.gap_width[blocks][of], self.tf_width[blocks][of], self.block_byte[blocks].astype(np.int64)[of]
        gap = _get(self.payload, base + inner * gw, gw)
        tf = _get(self.payload, base + count[of] * gw + inner * tw, tw)
        run = np.cumsum(gap)
        begin = np.cumsum(count) - count
        docs = run - np.repeat(run[begin] - gap[begin], count) + self.block_first[blocks][of]
        return docs, self.impact(tf, self.m[docs])

    def all_of(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """A whole list, kept for the other queries of this shard."""
        if j not in self.whole:
            self.whole[j] = self.decode(np.arange(self.list_start[j], self.list_start[j + 1]))
        return self.whole[j]


class Heap:
    """The k best rows of one query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A row needs this score to enter."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def push(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[best], ids[best]


def search_shard(s: Shard, terms: np.ndarray, weights: np.ndarray, heap: Heap, first: int = FIRST) -> None:
    """Adds the shard's best rows for one query to its heap. Rows whose bound equals the heap's least score stay candidates, so ties are exact."""
    at = s.find(terms)
    have = np.flatnonzero((at >= 0) & (weights > 0))
    lists, w = at[have], weights[have]
    bound = s.list_max[lists] * w
    order = np.argsort(bound, kind="stable")
    lists, w, bound = lists[order], w[order], bound[order]
    upto = np.cumsum(bound)
    a, step = 0, first if len(heap.ids) < heap.k else s.docs
    while a < s.docs:
        b = min(a + step, s.docs)
        least = heap.least
        rest = int(np.searchsorted(upto, least))  # so many lists together stay below it
        if rest == len(lists):
            return
        total = np.zeros(b - a, np.int64)
        for j, wj in zip(lists[rest:], w[rest:], strict=True):
            docs, impact = s.all_of(j)
            lo, hi = np.searchsorted(docs, (a, b))
            total[docs[lo:hi] - a] += impact[lo:hi] * wj
        who = np.flatnonzero(total)
        score = total[who]
        who = who + a
        if rest:
            keep = score + upto[rest - 1] >= least
            who, score = who[keep], score[keep]
            blocks, most = [], []
            for j, wj in zip(lists[:rest], w[:rest], strict=True):
                lo, hi = s.list_start[j], s.list_start[j + 1]
                k = lo + np.searchsorted(s.block_last[lo:hi], who)
                inside = (k < hi) & (s.block_first[np.minimum(k, hi - 1)] <= who)
                blocks.append(np.where(inside, k, -1))
                most.append(np.where(inside, s.block_max[np.minimum(k, hi - 1)] * wj, 0))
            blocks, most = np.array(blocks), np.array(most)
            upper = score + most.sum(0)
            for i in range(rest - 1, -1, -1):  # from the greatest bound on
                keep = upper >= least
                who, score, upper, blocks, most = who[keep], score[keep], upper[keep], blocks[:, keep], most[:, keep]
                asked = np.flatnonzero(blocks[i] >= 0)
                if not len(asked):
                    continue
                docs, impact = s.whole[lists[i]] if lists[i] in s.whole else s.decode(np.unique(blocks[i][asked]))
                p = np.minimum(np.searchsorted(docs, who[asked]), len(docs) - 1)
                true = np.where(docs[p] == who[asked], impact[p] * w[i], 0)
                score[asked] += true
                upper[asked] += true - most[i][asked]
        good = score >= least
        if good.any():
            heap.push(score[good], s.ids[who[good]])
        a, step = b, step * 2


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct term hashes of each item. Rows of one item_id are one item; null ids and texts take no part."""
    kind = dict(items.dtypes)["item_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in textnum.segments(b["text"], textnum.NOT_WORD, lower=True):
                yield pa.record_batch([b["item_id"].take(pa.array(s.first + s.doc)), pa.array(s.word_hashes().view(np.int64))], ["item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null")
    return rows.mapInArrow(cut, f"item_id {kind}, term long").distinct()


def document_counts(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """term, df of the sorted terms that the index has, from its lexicons and the sizes of lists alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for lexicon, start, size in zip(*(b[c] for c in ("terms", "list_start", "block_size")), strict=True):
                own, start, size = np.frombuffer(lexicon.as_buffer(), np.uint64), np.frombuffer(start.as_buffer(), np.int32), np.frombuffer(size.as_buffer(), np.uint8)
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    hit = np.flatnonzero(own[at] == terms)
                    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                    total[hit] += ends[start[at[hit] + 1]] - ends[start[at[hit]]]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(terms[some].view(np.int64)), pa.array(total[some])], ["term", "df"])

    return index.select("terms", "list_start", "block_size").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _heaps(index: DataFrame, queries: list[tuple], kind: str, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: each task's k best rows of each query (item_id, terms, weights)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in queries]
        for b in batches:
            for i in range(len(b)):
                shard = Shard({c: b[c][i].as_buffer() for c in _PARTS}, n_docs, n_terms)
                for (_, terms, weights), heap in zip(queries, heaps, strict=True):
                    search_shard(shard, terms, weights, heap)
        for (item, *_), heap in zip(queries, heaps, strict=True):
            yield pa.record_batch([pa.array([item] * len(heap.ids), out_type), pa.array(heap.ids), pa.array(heap.score)], ["item_id", "doc_id", "score"])

    out_type = pa.int64() if kind == "bigint" else pa.string()
    return index.mapInArrow(search, f"item_id {'long' if kind == 'bigint' else 'string'}, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, pass_terms: int = PASS_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    Items of PASS_TERMS terms are told to every task at once; more take further
    passes over the stored index, never over the documents. Rows that repeat a
    doc_id are documents of their own. Null and empty texts match nothing; ties go
    to the smaller doc_id. Without documents or items the result is empty. Ids of
    items are long or text; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    whole = dict(items.dtypes)["item_id"] in ("bigint", "int", "smallint", "tinyint")
    kind = "bigint" if whole else "string"
    index = scratch.settle(build_index(docs), "lexical-index")
    asked = scratch.settle(item_terms(items.withColumn("item_id", F.col("item_id").cast(kind))), "item-terms")
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    passes = max(1, -(-asked.count() // pass_terms))
    found = None
    for i in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        terms = np.sort(np.array([r[0] for r in mine.select("term").distinct().collect()], np.int64).view(np.uint64))
        counts = document_counts(index, terms)
        weight = F.floor(1000 * F.log((2 * F.lit(totals["n"] or 0) + 2) / (2 * F.col("df") + 1))).alias("w")
        queries = mine.join(counts, "term").select("item_id", "term", weight).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("x")).collect()
        packed = [(r["item_id"], np.array([x["term"] for x in r["x"]], np.int64).view(np.uint64), np.array([x["w"] for x in r["x"]], np.int64)) for r in queries]
        heaps = scratch.settle(_heaps(index, packed, kind, totals["n"] or 0, totals["l"] or 1, k), "heaps")
        found = heaps if found is None else found.unionByName(heaps)
    scratch.drop(*[t for t, _ in scratch.tables if t.columns == ["item_id", "doc_id", "score"]])
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents WHERE doc_id IS NOT NULL) WHERE len(w) > 0),
t AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
post AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, t GROUP BY term, nd),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN post USING (term) JOIN df USING (term), t GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""
