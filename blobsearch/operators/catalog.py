"""The blob catalog: row building, activity rules, upserts, updates and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("image", "video", "audio", "doc", "quilt")


def present(c: Column | str) -> Column:
    """Empty strings count as missing."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def is_active(epoch: int, mode: str = "strict", end: str = "end_epoch", flag: str = "is_active") -> Column:
    """strict: a known end after the epoch; lenient: an unknown end counts as active too; flag: the stored flag."""
    later = F.expr(f"try_cast({end} AS BIGINT)") > epoch
    return {"strict": F.coalesce(later, F.lit(False)), "lenient": F.coalesce(later, F.lit(True)), "flag": F.coalesce(F.col(flag), F.lit(False))}[mode]


def expiry(epoch: int, end: str = "end_epoch") -> Column:
    """expired, active or unknown."""
    e = F.expr(f"try_cast({end} AS BIGINT)")
    return F.when(e.isNull(), "unknown").when(e <= epoch, "expired").otherwise("active")


def build_rows(df: DataFrame, epoch: int) -> DataFrame:
    """Catalog rows of discovered blobs: expired ones are inactive, and their status 'discovered' becomes 'expired'."""
    e = F.expr("try_cast(end_epoch AS INT)")
    gone = e <= epoch
    return df.withColumn("end_epoch", e).withColumn("is_active", F.when(gone, False).otherwise(F.col("is_active"))).withColumn(
        "status", F.when(gone & (F.col("status") == "discovered"), "expired").otherwise(F.col("status"))
    )


def normalize_kind(kind: Column | str) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin(*KINDS), k)


def modality(kind: Column | str) -> Column:
    """image, video, audio, doc (also pdf and text kinds), quilt or other."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k.isin("image", "video", "audio", "quilt"), k).when(k.isin("doc", "pdf", "text"), "doc").otherwise("other")


def score_scale(sim: Column, multiplier: float) -> Column:
    return F.least(F.greatest(sim, F.lit(0.0)) * multiplier, F.lit(100.0))


def modality_score(sim: Column) -> Column:
    return F.least(F.greatest((sim + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 100


def last_of_batch(new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of several rows of a key in one batch the last counts."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, str], order: str | None = None) -> DataFrame:
    """Both tables' rows, merged by key. One shuffle of each side on the keys.

    rules by column: ``coalesce`` new unless null, ``overwrite`` new where there is
    a new row, ``positive`` new unless null or 0, ``greatest``, ``keep`` old unless
    null, ``unless_indexed`` old while its ``indexed`` is set.
    """
    if order:
        new = last_of_batch(new, keys, order)
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = o.join(n, same, "full_outer")

    def col(side: str, c: str, df: DataFrame) -> Column:
        return F.col(f"{side}.{c}") if c in df.columns else F.lit(None)

    out = [F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys]
    for c, rule in rules.items():
        a, b = col("o", c, old), col("n", c, new)
        value = {
            "coalesce": lambda: F.coalesce(b, a),
            "keep": lambda: F.coalesce(a, b),
            "overwrite": lambda: F.when(F.col("_new"), b).otherwise(a),
            "positive": lambda: F.coalesce(F.nullif(b, F.lit(0)), a),
            "greatest": lambda: F.greatest(a, b),
            "unless_indexed": lambda: F.when(F.coalesce(F.col("o.indexed"), F.lit(False)) | F.col("_new").isNull(), a).otherwise(b),
        }[rule]()
        out.append(value.alias(c))
    return both.select(*out)


def update_where(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Rows with values of ``changes`` where their key is named; null changes keep the old value unless ``overwrite``."""
    named = changes.select(key, F.lit(True).alias("_named"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(named, key, "left")
    for c in columns:
        new = F.col(f"_{c}") if overwrite else F.coalesce(F.col(f"_{c}"), F.col(c))
        out = out.withColumn(c, F.when(F.col("_named"), new).otherwise(F.col(c)))
    return out.drop("_named", *[f"_{c}" for c in columns])


def mark_failed(df: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    return update_where(df, ids.select("blob_id", F.lit(False).alias("indexed"), F.lit(status).alias("status")), "blob_id", ["indexed", "status"])


def mark_expired(df: DataFrame, epoch: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Inactive and expired: active rows whose end is reached, or the rows named."""
    if ids is not None:
        return update_where(df, ids.select("blob_id", F.lit(False).alias("is_active"), F.lit("expired").alias("status")), "blob_id", ["is_active", "status"])
    due = F.coalesce((F.col("end_epoch") <= epoch) & F.col("is_active"), F.lit(False))
    return df.withColumn("status", F.when(due, "expired").otherwise(F.col("status"))).withColumn("is_active", F.when(due, False).otherwise(F.col("is_active")))


def reset_status(df: DataFrame) -> DataFrame:
    return df.withColumn("indexed", F.lit(False)).withColumn("status", F.lit("queued_reindex"))


def reclassified(df: DataFrame, detected: DataFrame) -> DataFrame:
    """Rows whose detected mime type, extension or kind differs, with the detected values."""
    d = detected.select("blob_id", *[F.col(c).alias(f"_{c}") for c in ("mime_type", "extension", "kind")])
    changed = F.lit(False)
    for c in ("mime_type", "extension", "kind"):
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(d, "blob_id").where(changed).select("blob_id", *[F.col(f"_{c}").alias(c) for c in ("mime_type", "extension", "kind")])


def kind_counts(df: DataFrame, epoch: int) -> DataFrame:
    """kind, total, active (lenient): one pass over the catalog."""
    return df.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("total"), F.count_if(is_active(epoch, "lenient")).alias("active"))


def totals(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: all rows, and those that meet each condition."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """dimension, value, n for each column, in one scan by grouping sets."""
    dim = F.lit(None)
    value = F.lit(None)
    for i, c in enumerate(columns):
        only = F.grouping(c) == 0
        dim, value = F.when(only, c).otherwise(dim), F.when(only, F.col(c)).otherwise(value)
    return df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), dim.alias("dimension"), value.alias("value")).select("dimension", "value", "n")


def extension_distribution(df: DataFrame, epoch: int) -> DataFrame:
    ext = F.coalesce(present(F.lower(F.trim(F.coalesce("extension", F.lit("unknown"))))), F.lit("unknown"))
    return df.groupBy(ext.alias("extension")).agg(F.count("*").alias("total"), F.count_if(is_active(epoch, "lenient")).alias("active"))


def larger_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts by key of two tallies, the larger of each."""
    return a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), key, "full_outer").select(key, F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))).alias("n"))


def epoch_mode(df: DataFrame, newest: int = 100) -> DataFrame:
    """The most common end epoch among the newest rows (ties: the smallest), with their range."""
    top = df.where("end_epoch is not null").orderBy(F.desc("first_seen_at"), "blob_id").limit(newest)
    per = top.groupBy("end_epoch").agg(F.count("*").alias("n"))
    return per.agg(F.min_by("end_epoch", F.struct(-F.col("n"), "end_epoch")).alias("epoch"), F.max("n").alias("n"), F.min("end_epoch").alias("low"), F.max("end_epoch").alias("high"))


def prune_expired(df: DataFrame, epoch: int, end: str = "expires_at") -> DataFrame:
    """Rows that stay: an end that cannot be read stays."""
    return df.where(is_active(epoch, "lenient", end))


def enqueue(queue: DataFrame, blobs: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Blob ids of supported images that are not queued yet."""
    fresh = blobs.where(F.lower(F.trim("extension")).isin(*extensions) & (F.col("kind") == "image"))
    return fresh.join(queue.select("blob_id"), "blob_id", "left_anti").select("blob_id")


def claim(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The oldest n entries, and the rest of the queue."""
    taken = queue.orderBy("queued_at", "blob_id").limit(n)
    return taken, queue.join(taken.select("blob_id"), "blob_id", "left_anti")


def outcome(df: DataFrame, epoch: int) -> DataFrame:
    """status, reason and indexed of each blob, by the first rule that holds: known, expired, fetch failed, container, supported, unsupported."""
    rules = [
        (F.col("known"), "skipped", "already_indexed", True),
        (F.coalesce(F.col("end_epoch") <= epoch, F.lit(False)), "expired", "expired_before_fetch", False),
        (~F.col("fetched"), "fetch_failed", "no_payload", False),
        (F.coalesce(F.col("kind") == "quilt", F.lit(False)), "container", "expanded_separately", False),
        (F.coalesce(F.col("kind").isin("image", "video", "audio", "text"), F.lit(False)), "indexed", "ok", True),
    ]
    status, reason, indexed = F.lit("unsupported"), F.lit("unsupported_type"), F.lit(False)
    for when, s, r, i in reversed(rules):
        status, reason, indexed = F.when(when, s).otherwise(status), F.when(when, r).otherwise(reason), F.when(when, i).otherwise(indexed)
    return df.select("blob_id", status.alias("status"), reason.alias("reason"), indexed.alias("indexed"))


def confirmed_gone(probes: DataFrame, passes: int) -> DataFrame:
    """Ids that every pass found gone."""
    return probes.groupBy("blob_id").agg(F.every(F.col("code") == 404).alias("all_gone"), F.countDistinct("pass").alias("n")).where((F.col("n") == passes) & F.col("all_gone")).select("blob_id")
