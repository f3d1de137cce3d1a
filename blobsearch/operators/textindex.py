"""A stored caption index: runs of postings that follow the catalog's inserts, updates and deletions.

A batch of changes writes one run: the postings and the lengths of changed rows
alone, and a row for each deleted one. A posting counts while its run is the
newest of its document. How many documents there are and how long they are
together is kept as differences, so nothing is recounted, and texts of unchanged
rows are not read. Compaction writes what counts as one run.

A file of postings has all terms of its documents, in the order of terms: the
task that split the texts sorts and writes them, so no posting is shuffled, a
scan for some terms skips the other pages, and a common term is in every file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import small, tokens

#: Asked terms up to which the scan of the postings itself is filtered; the others are joined.
FILTERED = 256
#: A join on terms is dealt over so many tasks for each term, for a common term has a share of all documents.
SALT = 32
#: Terms that a task counts at a time.
TERMS = 200_000
_POSTING = "term string, blob_id string, tf long, dl double, run long"
_DOC = "blob_id string, dl double, run long"
_TOTAL = "run long, base boolean, docs long, words double"


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of at most TERMS terms, or one row: what a task holds to count does not follow the batch."""
    ends = b["t"].offsets.to_numpy()
    at = 0
    while at < len(b):
        upto = max(at + 1, int(ends.searchsorted(ends[at] + TERMS, "right")) - 1)
        yield b.slice(at, upto - at)
        at = upto


def postings_of(docs: DataFrame, path: str, run: int, text: str = "caption") -> DataFrame:
    """Writes the postings of rows with an id and a text to ``path``, as a run's; returns the lengths (blob_id, dl).

    A row stands in one batch, so nothing is shuffled to count it. Texts are split
    once: a row without term for each document stands before the postings.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in _pieces(whole)):
            terms = b["t"]
            flat = pa.table({"row": pa.compute.list_parent_indices(terms), "term": terms.flatten()}).group_by(["row", "term"]).aggregate([([], "count_all")])
            row = flat["row"].combine_chunks()
            yield pa.record_batch([flat["term"].combine_chunks(), b["blob_id"].take(row), flat["count_all"].combine_chunks(), b["dl"].take(row)], ["term", "blob_id", "tf", "dl"])
            yield pa.record_batch([pa.nulls(len(b), pa.string()), b["blob_id"], pa.array([0] * len(b), pa.int64()), b["dl"]], ["term", "blob_id", "tf", "dl"])

    split = docs.where(F.col(text).isNotNull() & F.col("blob_id").isNotNull()).select(F.col("blob_id").cast("string").alias("blob_id"), tokens(text).alias("t")).withColumn("dl", F.size("t").cast("double"))
    rows = split.mapInArrow(counted, "term string, blob_id string, tf long, dl double").withColumn("run", F.lit(run).cast("long"))
    _write_postings(rows, path)
    return docs.sparkSession.read.schema(_POSTING).parquet(path).where("term is null").select("blob_id", "dl")


def _write_postings(rows: DataFrame, path: str) -> None:
    rows.select("term", "blob_id", "tf", "dl", "run").sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd").parquet(path)


class TextIndex:
    """An index in a folder that all executors share. A run counts once its totals are written, so a batch that failed is written anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, kind: str, schema: str, runs: list[int]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}-{r}" for r in runs])

    def _totals(self) -> list:
        """Totals of the newest base run and all later ones: one row for each batch since the last compaction."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = sorted(int(n.split("-")[1]) for n in names if n.startswith("total-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))
        rows = sorted(self._read("total", _TOTAL, done).collect(), key=lambda r: r["run"])
        bases = [i for i, r in enumerate(rows) if r["base"]]
        return rows[bases[-1] :] if bases else rows

    def runs(self) -> list[int]:
        return [r["run"] for r in self._totals()]

    def documents(self) -> DataFrame:
        """blob_id, dl, run of each document: its newest row. A deleted document has no dl."""
        return self._newest(self._read("docs", _DOC, self.runs()))

    @staticmethod
    def _newest(docs: DataFrame) -> DataFrame:
        return docs.groupBy("blob_id").agg(F.max(F.struct("run", "dl")).alias("x")).select("blob_id", "x.dl", "x.run")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, blob_id, tf, dl of the documents as they stand. With one run all postings count, and nothing is joined."""
        runs = self.runs()
        rows = self._read("postings", _POSTING, runs)
        rows = rows.where("term is not null" if terms is None else F.col("term").isin(terms))
        if len(runs) > 1:
            # only what came after the base run can make a posting old: its documents alone are read
            changed = self._read("docs", _DOC, runs[1:]).groupBy("blob_id").agg(F.max("run").alias("newest"))
            rows = rows.join(small(changed), "blob_id", "left").where(F.col("newest").isNull() | (F.col("newest") == F.col("run")))
        return rows.select("term", "blob_id", "tf", "dl")

    def _write(self, run: int, docs: DataFrame, base: bool, before: tuple[int, float]) -> None:
        """The documents of a run whose postings are written, then its totals, with which it counts."""
        at = F.lit(run).cast("long").alias("run")
        docs.select("blob_id", "dl", at).write.mode("overwrite").parquet(f"{self.path}/docs-{run}")
        own = self._read("docs", _DOC, [run]).agg(F.count("dl").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0.0)).alias("words"))
        total = own.select(at, F.lit(base).alias("base"), (F.col("docs") - before[0]).alias("docs"), (F.col("words") - before[1]).alias("words"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/total-{run}")

    def rebuild(self, docs: DataFrame, text: str = "caption") -> None:
        """One run of all rows with a text; it replaces all earlier ones. Ids are unique, as a catalog's are."""
        run = max(self.runs(), default=-1) + 1
        self._write(run, postings_of(docs, f"{self.path}/postings-{run}", run, text), True, (0, 0.0))

    def apply(self, changes: DataFrame, run: int | None = None, text: str = "caption", order: str = "seq") -> None:
        """A batch of changes: blob_id, text, deleted and an order; of several changes of one row the last counts.

        A row that is deleted, or whose text is null, leaves the index; others are
        inserted or take the place of what the index has. Rows without id are
        skipped. A run of a number that is there already is not written again, so
        a stream may repeat its batch.
        """
        runs = self.runs()
        run = max(runs, default=-1) + 1 if run is None else run
        if run in runs or (runs and run < runs[0]):
            return
        last = Window.partitionBy("blob_id").orderBy(F.desc(order))
        rows = changes.where("blob_id is not null").withColumn("_r", F.row_number().over(last)).where("_r = 1")
        kept = rows.withColumn(text, F.when(~F.coalesce("deleted", F.lit(False)), F.col(text)))
        lengths = postings_of(kept, f"{self.path}/postings-{run}", run, text)
        docs = kept.select(F.col("blob_id").cast("string").alias("blob_id")).join(lengths, "blob_id", "left")
        # what the changed rows were before, from their kept lengths
        ids = small(kept.select(F.col("blob_id").cast("string").alias("blob_id")))
        old = self._newest(self._read("docs", _DOC, runs).join(ids, "blob_id", "left_semi")).agg(F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0.0))).first()
        self._write(run, docs, False, (old[0], old[1]))

    def compact(self) -> None:
        """What counts as one run. Earlier runs stay for readers that have begun; ``clean`` drops them."""
        runs = self.runs()
        if len(runs) > 1:
            run = runs[-1] + 1
            _write_postings(self.postings().withColumn("run", F.lit(run).cast("long")), f"{self.path}/postings-{run}")
            self._write(run, self.documents().where("dl is not null"), True, (0, 0.0))

    def clean(self) -> None:
        """Drops the folders of runs that a base run has replaced."""
        first = min(self.runs(), default=0)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(root) if fs.exists(root) else []:
            if int(s.getPath().getName().split("-")[1]) < first:
                fs.delete(s.getPath(), True)

    def bm25(self, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, blob_id, bm25 of documents that hold every term of a query (query_id, terms array)."""
        asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"), F.size(F.array_distinct("terms")).alias("n_terms"))
        some = [r[0] for r in asked.select("term").distinct().limit(FILTERED + 1).collect()]
        totals = self._totals()
        nd, words = sum(r["docs"] for r in totals), sum(r["words"] for r in totals)
        wanted = asked.select("term").distinct()
        found = self.postings(some) if len(some) <= FILTERED else self.postings().join(small(wanted), "term", "left_semi")
        df = found.groupBy("term").agg(F.count("*").alias("n"))
        idf = F.greatest(F.log((F.lit(nd) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
        each = asked.join(df, "term").select("query_id", "term", "n_terms", idf.alias("idf"))
        salted = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hit = found.withColumn("salt", F.pmod(F.xxhash64("blob_id"), F.lit(SALT)).cast("int")).join(salted, ["term", "salt"])
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(words / nd if nd and words else 1.0)))
        return hit.groupBy("query_id", "blob_id").agg(F.sum(part).alias("bm25"), F.count("*").alias("hits"), F.max("n_terms").alias("n_terms")).where("hits = n_terms").select("query_id", "blob_id", "bm25")
