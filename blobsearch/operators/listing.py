"""Newest-first listings: where an incremental scan stops and where it resumes.

A listing's order is over all its rows, so positions are found by distributed
aggregates (ranges and counts), and windows only run inside one day's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def after_cursor(listing: DataFrame, cursor: str) -> DataFrame:
    """Rows after the cursor's row, newest first, ties by id; all rows if it is not listed."""
    at = listing.where(F.col("blob_id") == cursor).agg(F.max("first_seen_at").alias("_at"))
    later = F.col("_at").isNull() | (F.col("first_seen_at") < F.col("_at")) | ((F.col("first_seen_at") == F.col("_at")) & (F.col("blob_id") > cursor))
    return listing.crossJoin(F.broadcast(at)).where(later).drop("_at")


def until_known_streak(listing: DataFrame, streak: int) -> DataFrame:
    """Rows up to the one that completes ``streak`` known rows in a row, newest first; all rows if none does.

    Days are walked by their totals: for each, the known rows at its end and
    whether it holds a new one give the streak with which the next day begins.
    """
    day = Window.partitionBy("_day").orderBy(F.desc("first_seen_at"), "blob_id")
    rows = listing.withColumn("_day", F.to_date("first_seen_at"))
    rows = rows.withColumn("_grp", F.sum(F.when(F.col("known"), 0).otherwise(1)).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("_day", "_grp", "known").orderBy(F.desc("first_seen_at"), "blob_id"))
    rows = rows.withColumn("_run", F.when(F.col("known"), run).otherwise(0))
    days = rows.groupBy("_day").agg(F.max("_grp").alias("new"), F.max_by("_run", F.struct("_grp", "_run")).alias("tail"), F.count("*").alias("n"))
    # a day without new rows adds to the streak before it; others start it anew
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_day"))
    days = days.withColumn("_seg", F.sum(F.when(F.col("new") > 0, 1).otherwise(0)).over(order))
    carried = F.sum("tail").over(Window.partitionBy("_seg").orderBy(F.desc("_day")))
    days = days.withColumn("_after", carried).withColumn("carry", F.coalesce(F.lag("_after").over(order), F.lit(0)))
    rows = rows.join(days.select("_day", "carry"), "_day")
    total = F.when(F.col("known"), F.col("_run") + F.when(F.col("_grp") == 0, F.col("carry")).otherwise(0)).otherwise(0)
    stop = rows.where(total >= streak).agg(F.max(F.struct("first_seen_at", F.lit(0))).alias("m"), F.min_by("blob_id", F.struct(-F.unix_timestamp("first_seen_at"), "blob_id")).alias("_id")).select(F.col("m.first_seen_at").alias("_at"), "_id")
    inside = F.col("_at").isNull() | (F.col("first_seen_at") > F.col("_at")) | ((F.col("first_seen_at") == F.col("_at")) & (F.col("blob_id") <= F.col("_id")))
    return rows.crossJoin(F.broadcast(stop)).where(inside).select(listing.columns)


def until_short_page(pages: DataFrame, page_size: int) -> DataFrame:
    """Rows of a paged listing (page) up to its first page that is missing or has fewer than ``page_size`` rows, that one included."""
    sizes = pages.groupBy("page").agg(F.count("*").alias("n"))
    # full pages from 0 on: page p is one of them if p full pages stand before it, so the first other one has the least number that is not full
    full = sizes.where(F.col("n") >= page_size).select("page")
    after = full.select((F.col("page") + 1).alias("page")).union(full.sparkSession.range(1).select(F.col("id").alias("page")))
    first = after.join(full, "page", "left_anti").agg(F.min("page").alias("_last"))
    return pages.crossJoin(F.broadcast(first)).where(F.col("page") <= F.col("_last")).drop("_last")


def poll_newest(pages: DataFrame, known: DataFrame, streak: int, most: int) -> DataFrame:
    """What a poll of a newest-first listing sees of its first ``most`` pages: page, pos, blob_id, known, up to the row that completes ``streak`` known ids in a row.

    A streak runs on from page to page and starts anew after an id that is not
    known. A poll is of few pages by contract, so one task numbers its rows.
    """
    seen = pages.where(F.col("page") < most).select("page", "pos", "blob_id")
    rows = seen.join(known.select("blob_id", F.lit(True).alias("known")).distinct(), "blob_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    order = Window.partitionBy(F.lit(0)).orderBy("page", "pos")
    new = F.sum(F.when(F.col("known"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_at", F.row_number().over(order)).withColumn("_new", new)
    # known rows since the last new one
    run = F.row_number().over(Window.partitionBy("_new", "known").orderBy("page", "pos"))
    rows = rows.withColumn("_run", F.when(F.col("known"), run).otherwise(0))
    stop = rows.where(F.col("_run") == streak).agg(F.min("_at").alias("_stop"))
    return rows.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop"))).select("page", "pos", "blob_id", "known")
