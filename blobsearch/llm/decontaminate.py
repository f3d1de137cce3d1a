"""Benchmark decontamination with a distributed positional inverted index.

Postings (term, document, position) of training tokens are stored for the test
terms that can start a search: for every test window its rarest terms, by their
frequency over the whole corpus. Lists are intersected from the rarest term on,
each shifted by its offset in the window; a candidate that survives is an exact
phrase when the hash of the whole window, stored beside the posting, agrees.
Lists of the rarest terms alone also answer proximity searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .store import documents_of, settle, small_batches, table, told, with_row_key

WINDOW = 13
#: Terms of each window whose lists are intersected before the whole window is compared.
LISTS = 3
#: Words between terms that stand near each other, at most.
SLOP = 20
#: Test terms that are sent to every task at once, on average; more are searched in hashed parts, one after the other.
BROADCAST_TERMS = 1_000_000


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _words(texts: pa.Array) -> Iterator[textnum.Segment]:
    return textnum.segments(texts, textnum.NOT_WORD, lower=True)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, start, length, term array<long>, phrase: the windows of each test item.

    An item of fewer words, but not none, is one window; null and empty items have none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["item_id"].to_pylist()
            for s in _words(b["text"]):
                h = s.word_hashes()
                for k in range(s.n):
                    mine = h[s.begin[k] : s.begin[k] + s.words[k]]
                    n = min(size, len(mine))
                    if not n:
                        continue
                    starts = np.arange(len(mine) - n + 1)
                    terms = np.lib.stride_tricks.sliding_window_view(mine, n)
                    flat = np.ascontiguousarray(terms).view(np.int64).ravel()
                    yield pa.record_batch(
                        [pa.array([ids[s.first + k]] * len(starts)), pa.array(starts.astype(np.int32)), pa.array(np.full(len(starts), n, np.int32)), pa.ListArray.from_arrays(np.arange(len(starts) + 1, dtype=np.int32) * n, pa.array(flat)), _int64(textnum.grams(mine, n))],
                        ["item_id", "start", "length", "term", "phrase"],
                    )

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where("item_id is not null").mapInArrow(cut, "item_id string, start int, length int, term array<long>, phrase long")


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """term, n: how often each of the sorted test terms stands in the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for s in _words(b["text"]):
                at, _ = _find(terms, s.word_hashes())
                total += np.bincount(at, minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.record_batch([_int64(terms[some]), pa.array(total[some])], ["term", "n"])

    return documents_of(docs).select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _find(terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in ``terms`` of each value of h that is one, and where it stands in h."""
    if not len(terms) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == h)
    return at[hit], hit


def positional_index(docs: DataFrame, terms: np.ndarray, lengths: list[int], sizes: bool = True) -> DataFrame:
    """The stored index: term, doc_id, pos and, for each window length, the phrase hashes around the posting.

    phrases[l][o] is the hash of the l words that start o words before pos (0 where
    they leave the document). A row with a null term carries the document's number
    of words; its pos is that number. Without ``sizes`` there are none of those.
    """
    reach = [(n, o) for n in lengths for o in range(n)]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"]
            for s in _words(b["text"]):
                h = s.word_hashes()
                at, where = _find(terms, h)
                around = np.zeros((len(where), len(reach)), np.uint64)
                inside = {}
                for c, (n, o) in enumerate(reach):
                    if n not in inside:
                        inside = {n: (textnum.grams(h, n), s.doc)}
                    g = inside[n][0]
                    start = where - o
                    ok = (start >= 0) & (start < len(g))
                    ok[ok] = (s.doc[start[ok]] == s.doc[where[ok]]) & (s.doc[start[ok] + n - 1] == s.doc[where[ok]])
                    around[ok, c] = g[start[ok]]
                doc = ids.take(pa.array(s.first + s.doc[where]))
                pos = (where - s.begin[s.doc[where]]).astype(np.int32)
                phrases = pa.ListArray.from_arrays(np.arange(len(where) + 1, dtype=np.int32) * len(reach), _int64(around.ravel()))
                yield pa.record_batch([_int64(terms[at]), doc, pa.array(pos), phrases], ["term", "doc_id", "pos", "phrases"])
                k = s.n if sizes else 0
                yield pa.record_batch([pa.nulls(k, pa.int64()), ids.slice(s.first, k), pa.array(s.words.astype(np.int32)), pa.nulls(k, pa.list_(pa.int64()))], ["term", "doc_id", "pos", "phrases"])

    return documents_of(docs).mapInArrow(post, "term long, doc_id long, pos int, phrases array<long>")


def search_plan(wins: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """For each window its rarest terms with their offsets, rarest first: item_id, start, length, phrase, rare array<struct<n, term, offset>>.

    Windows with a term that the corpus lacks cannot occur and go.
    """
    each = wins.select("item_id", "start", "length", "phrase", F.posexplode("term").alias("offset", "term"))
    return (
        each.join(counts, "term", "left").groupBy("item_id", "start", "length", "phrase")
        .agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("all"), F.count("n").alias("known"), F.count("*").alias("terms"))
        .where("known = terms").select("item_id", "start", "length", "phrase", F.slice("all", 1, lists).alias("rare"))
    )


def phrase_matches(index: DataFrame, plan: DataFrame, lengths: list[int], lists: int = LISTS) -> DataFrame:
    """item_id, doc_id, at, length: exact occurrences of the planned windows.

    The list of the rarest term gives candidate starts; the lists of the next
    rarest ones, shifted by their offsets, narrow them; the stored phrase hash decides.
    """
    base = {n: sum(x for x in lengths if x < n) for n in lengths}
    slot = F.create_map(*[F.lit(v) for n in lengths or [0] for v in (n, base.get(n, 0))])
    lead = plan.select("item_id", "length", "phrase", F.col("rare")[0]["term"].alias("term"), F.col("rare")[0]["offset"].alias("offset"), "rare")
    postings = index.where("term is not null")
    found = (
        postings.join(told(lead), "term")
        .withColumn("here", F.col("phrases")[slot[F.col("length")] + F.col("offset")])
        .where("here <> 0")
        .select("item_id", "doc_id", (F.col("pos") - F.col("offset")).alias("at"), "length", "phrase", "here", "rare")
    )
    # further lists: each candidate asks for the posting (term, document, start + offset)
    for k in range(1, lists):
        wants = found.withColumn("next", F.get("rare", F.lit(k))).withColumn("term", F.col("next.term")).withColumn("pos", F.col("at") + F.col("next.offset")).drop("next")
        have = postings.select("term", "doc_id", "pos")
        found = wants.where("term is not null").join(have, ["term", "doc_id", "pos"], "left_semi").unionByName(wants.where("term is null")).drop("term", "pos")
    return found.where("here = phrase").select("item_id", "doc_id", "at", "length")


def proximity_matches(index: DataFrame, plan: DataFrame, slop: int = SLOP, lists: int = LISTS) -> DataFrame:
    """item_id, doc_id, at: places of a window's rarest term with its next rarest ones within ``slop`` words."""
    lead = plan.select("item_id", "start", F.col("rare")[0]["term"].alias("term"), F.expr(f"transform(slice(rare, 2, {lists - 1}), x -> x.term)").alias("others"))
    postings = index.where("term is not null").select("term", "doc_id", "pos")
    found = postings.join(told(lead), "term").select("item_id", "start", "doc_id", F.col("pos").alias("at"), "others")
    near = postings.select(F.col("term").alias("o_term"), F.col("doc_id").alias("o_doc"), F.col("pos").alias("o_pos"))
    for k in range(lists - 1):
        found = found.withColumn("want", F.get("others", F.lit(k)))
        pair = (F.col("want") == F.col("o_term")) & (F.col("doc_id") == F.col("o_doc")) & (F.abs(F.col("at") - F.col("o_pos")) <= slop)
        found = found.where("want is not null").join(near, pair, "left_semi").unionByName(found.where("want is null")).drop("want")
    return found.select("item_id", "doc_id", "at").distinct()


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_hit: words inside the union of a document's occurrences."""
    for b in batches:
        hit = []
        for spans in b["spans"].to_pylist():
            n, upto = 0, -1
            for x in sorted(spans, key=lambda x: (x["at"], x["length"])):
                end = x["at"] + x["length"]
                n += max(0, end - max(upto, x["at"]))
                upto = max(upto, end)
            hit.append(n)
        yield pa.record_batch([b["doc_id"], pa.array(hit, pa.int64()), b["items"]], ["doc_id", "n_hit", "items"])


def _parts(terms: DataFrame) -> list[DataFrame]:
    """Terms in hashed parts of BROADCAST_TERMS on average."""
    n = -(-terms.count() // BROADCAST_TERMS) or 1
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, proximity: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items array<string> and, with ``proximity``, n_near: one row for each row of ``docs``.

    n_near: items of which a window's rarest terms stand near each other (proximity
    matches, exact ones among them).

    Null and empty texts have no words. Repeated benchmark items count each under
    its own item_id; items or documents without an id match nothing. Rows that
    repeat a doc_id are taken as one document and show the same hits. Extra
    columns are ignored; an empty benchmark or corpus gives no hits.
    """
    spark = docs.sparkSession
    wins = settle(windows(benchmark, size), "windows")
    terms = wins.select(F.explode("term").alias("term")).distinct()
    lists = lambda df: [np.sort(np.array([r[0] for r in x.collect()], np.int64).view(np.uint64)) for x in _parts(df)]
    lengths = sorted(r[0] for r in wins.select("length").distinct().collect())
    counts = settle(reduce(DataFrame.union, [term_counts(docs, x) for x in lists(terms)]), "term-counts")
    plan = settle(search_plan(wins, told(counts)), "search-plan")
    searched = lists(plan.select(F.explode("rare.term").alias("term")).distinct())
    index = settle(reduce(DataFrame.union, [positional_index(docs, x, lengths, i == 0) for i, x in enumerate(searched)]), "postings")
    found = phrase_matches(index, plan, lengths)
    # the same words are hit again and again by overlapping windows: distinct starts per document and length
    per_doc = found.groupBy("doc_id").agg(F.collect_set(F.struct("at", "length")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = per_doc.mapInArrow(_covered, "doc_id long, n_hit long, items array<string>")
    words = index.where("term is null").select("doc_id", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = words.join(hits, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items")).withColumn("n_items", F.size("items").cast("long"))
    if not proximity:
        return out
    near = proximity_matches(index, plan).select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_near"))
    return out.join(near, "doc_id", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def _contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), _contaminated().alias("contaminated"), "n_near")


_TERMS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bwin AS (SELECT item_id, n, s, w[s:s + n - 1] AS t FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
dwin AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, s, x.n, item_id FROM dwin x JOIN (SELECT item_id, n, array_to_string(t, ' ') AS k FROM bwin) y ON x.n = y.n AND x.k = y.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
post AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
counts AS (SELECT term, count(*) AS n FROM post GROUP BY term),
each AS (SELECT item_id, s, unnest(t) AS term, generate_subscripts(t, 1) AS o FROM bwin),
rare AS (SELECT item_id, s, each.term, row_number() OVER (PARTITION BY item_id, s ORDER BY counts.n, o) AS r, count(counts.n) OVER (PARTITION BY item_id, s) AS known, count(*) OVER (PARTITION BY item_id, s) AS terms FROM each LEFT JOIN counts USING (term)),
plan AS (SELECT DISTINCT item_id, max(CASE WHEN r = 1 THEN term END) AS t1, max(CASE WHEN r = 2 THEN term END) AS t2, max(CASE WHEN r = 3 THEN term END) AS t3 FROM rare WHERE known = terms AND r <= {LISTS} GROUP BY item_id, s),
searched AS (SELECT * FROM post WHERE term IN (SELECT unnest([t1, t2, t3]) FROM plan)),
lead AS (SELECT item_id, doc_id, pos, t2, t3 FROM searched JOIN plan ON term = t1),
second AS (SELECT DISTINCT lead.* FROM lead LEFT JOIN searched p ON p.term = t2 AND p.doc_id = lead.doc_id AND p.pos BETWEEN lead.pos - {SLOP} AND lead.pos + {SLOP} WHERE t2 IS NULL OR p.pos IS NOT NULL),
third AS (SELECT DISTINCT second.* FROM second LEFT JOIN searched p ON p.term = t3 AND p.doc_id = second.doc_id AND p.pos BETWEEN second.pos - {SLOP} AND second.pos + {SLOP} WHERE t3 IS NULL OR p.pos IS NOT NULL),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM third GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go.

    Every row is judged by its own text: doc_id and text, as a hash, stand for it,
    so rows without doc_id or with a repeated one are judged like any other. Other
    columns are kept as they are, whatever their names.
    """
    small_batches(spark)
    keyed, key = with_row_key(docs)
    found = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), proximity=False)
    bad = settle(found.where(_contaminated()).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(told(bad), key, "left_anti").drop(key)
