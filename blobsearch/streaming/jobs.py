"""Change events as streams: filtered, de-duplicated, merged into the catalog, and rolled up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blobsearch.operators.catalog import upsert
from blobsearch.sources.shared import BucketTable, VersionedTable, new_path

ALPHA, START, PENALTY, TRIP, COOLDOWN = 0.25, 1.0, 4.0, 3, 60.0
#: Failures of a blob until it is given up; seconds of event time that this is remembered.
MOST, FORGET = 3, 86_400.0


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that has arrived since the checkpoint, then stop."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collected(stream: DataFrame, spark: SparkSession, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """An append stream's rows, written as Parquet with exactly-once commits."""
    out, checkpoint = out or new_path(spark, "stream-out"), checkpoint or new_path(spark, "stream-checkpoint")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def of_types(events: DataFrame, types: list[str]) -> DataFrame:
    return events.where(F.col("type").isin(*types))


def with_id(events: DataFrame) -> DataFrame:
    """Events without a blob id wait for a later one: they are skipped."""
    return events.where(F.coalesce("blob_id", F.lit("")) != "")


def dedupe(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each blob id once; with a delay, state is bounded by the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["blob_id"]) if delay else events.dropDuplicates(["blob_id"])


def merge_buckets(table: BucketTable, rules: dict[str, str], order: str) -> Callable[[DataFrame, int], None]:
    """A batch sink that upserts by the table's key into the buckets that the batch touches; a repeated batch changes nothing."""
    return lambda batch, _: table.merge(batch, lambda old, new: upsert(old, new, [table.key], rules, order))


def latest_in_buckets(table: BucketTable) -> Callable[[DataFrame, int], None]:
    """A batch sink for a stream in update mode: a key's new row replaces its old one in its bucket."""
    return lambda batch, _: table.merge(batch, lambda old, new: old.join(new.select(table.key), table.key, "left_anti").unionByName(new))


def expire_in(table: BucketTable) -> Callable[[DataFrame, int], None]:
    """A batch sink for a stream of epochs: rows of the table (expires_at, expired) that expire by the newest one are marked. Only their buckets are written."""

    def flush(batch: DataFrame, _: int) -> None:
        now = batch.agg(F.max("epoch")).first()[0]
        due = table.read().where(~F.col("expired") & (F.col("expires_at") <= F.lit(now))).withColumn("expired", F.lit(True))
        if now is not None:
            table.merge(due, lambda old, new: old.join(new.select(table.key), table.key, "left_anti").unionByName(new))

    return flush


def replace_with(table: VersionedTable) -> Callable[[DataFrame, int], None]:
    """A batch sink for a stream in complete mode: each result replaces the one before."""
    return lambda batch, _: table.replace(batch)


def run_table(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """A stateful stream over all that has arrived, in the given output mode."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def coverage(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("blob_id") != "").alias("with_id"))


def retry_budget(failures: DataFrame, most: int = MOST) -> DataFrame:
    """blob_id, failures, action of a table: requeue until ``most`` failures, then give up; later failures count no more."""
    n = failures.groupBy("blob_id").agg(F.least(F.count("*"), F.lit(most)).alias("failures"))
    return n.withColumn("action", F.when(F.col("failures") >= most, "failed").otherwise("requeue"))


def _stateful(stream: DataFrame, by: str, processor, schema: str) -> DataFrame:
    """Timers and state of a key need the state store on disk."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(by).transformWithStateInPandas(processor, schema, "update", "eventTime")


def retry_stream(failures: DataFrame, most: int = MOST, forget: float = FORGET) -> DataFrame:
    """blob_id, failures, action after each batch of a failure stream (blob_id, ts with a watermark).

    State is a count. A blob that is given up says so once and ignores later
    failures; ``forget`` seconds of event time after its last one its state ends.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Budget(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "failures long, until long")

        def handleInputRows(self, key, rows, timerValues):
            n, until = self.seen.get() if self.seen.exists() else (0, 0)
            first, last, count = float("inf"), until, 0
            for frame in rows:
                if len(frame):
                    count += len(frame)
                    first = min(first, int(frame["ts"].min().timestamp() * 1000))
                    last = max(last, int(frame["ts"].max().timestamp() * 1000))
            if n >= most and first > until + int(forget * 1000):
                n = 0  # its timer has not come to fire before these rows
            before, until, n = n, last, min(n + count, most)
            self.seen.update((n, until))
            if n >= most:
                self.handle.registerTimer(until + int(forget * 1000))
            if before < most:
                yield pd.DataFrame({"blob_id": [key[0]], "failures": [n], "action": ["failed" if n >= most else "requeue"]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            n, until = self.seen.get() if self.seen.exists() else (0, 0)
            # a failure since then has a timer of its own
            if expiredTimerInfo.getExpiryTimeInMs() >= until + int(forget * 1000):
                self.seen.clear()
            yield pd.DataFrame({"blob_id": pd.Series([], dtype=str), "failures": pd.Series([], dtype="int64"), "action": pd.Series([], dtype=str)})

        def close(self) -> None:
            pass

    return _stateful(failures.select("blob_id", "ts"), "blob_id", Budget(), "blob_id string, failures long, action string")


def health(log: DataFrame, as_of: str, reach: int = 200) -> DataFrame:
    """upstream, requests, failures, ema, streak, tripped after a request log (upstream, ts, event_id, ok, latency_secs).

    The moving average weighs the r-th newest request with ALPHA (1 - ALPHA)^(r-1);
    beyond ``reach`` requests the weight is below 1e-24, so only those are sorted.
    """
    cost = F.when(F.col("ok"), F.col("latency_secs")).otherwise(F.greatest(F.col("latency_secs"), F.lit(PENALTY)))
    w = Window.partitionBy("upstream").orderBy(F.desc("ts"), F.desc("event_id"))
    near = log.withColumn("r", F.row_number().over(w)).where(F.col("r") <= reach)
    ema = near.groupBy("upstream").agg(F.sum(ALPHA * F.pow(F.lit(1 - ALPHA), F.col("r") - 1) * cost).alias("part"))
    at = F.struct("ts", "event_id")
    ends = log.groupBy("upstream").agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"), F.max(F.when(F.col("ok"), at)).alias("good"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_bad"))
    since = log.join(ends.select("upstream", "good"), "upstream").where(~F.col("ok") & (F.col("good").isNull() | (at > F.col("good")))).groupBy("upstream").agg(F.count("*").alias("streak"))
    out = ends.join(ema, "upstream").join(since, "upstream", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
    cooling = F.unix_timestamp("last_bad") + COOLDOWN > F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    return out.select("upstream", "requests", "failures", (F.col("part") + START * F.pow(F.lit(1 - ALPHA), "requests")).alias("ema"), "streak", ((F.col("streak") >= TRIP) & cooling).alias("tripped"))


def health_stream(log: DataFrame, reach: int = 200) -> DataFrame:
    """upstream, requests, failures, ema, streak, tripped after each batch of a request stream (upstream, ts with a watermark, event_id, ok, latency_secs).

    An upstream with TRIP failures in a row is tripped until COOLDOWN seconds after
    the last one; a timer ends that, or a success. State is six numbers. Frames of
    a batch come in any order, and none is kept: of each only the newest ``reach``
    costs, the newest success and the failures after it matter. Batches are taken
    in order of time.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Health(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("health", "requests long, failures long, ema double, streak long, until long, tripped boolean")

        def _row(self, key, state):
            n, bad, ema, streak, _, tripped = state
            return pd.DataFrame({"upstream": [key[0]], "requests": [n], "failures": [bad], "ema": [ema], "streak": [streak], "tripped": [tripped]})

        def handleInputRows(self, key, rows, timerValues):
            n, bad, ema, streak, until, tripped = self.state.get() if self.state.exists() else (0, 0, START, 0, 0, False)
            at, cost = np.zeros((0, 2), np.int64), np.zeros(0)
            good, failed, count = None, np.zeros((0, 2), np.int64), 0
            for f in rows:
                when = np.stack([f["ts"].astype("datetime64[us]").to_numpy().astype(np.int64), f["event_id"].to_numpy(np.int64)], 1)
                ok, late = f["ok"].to_numpy(bool), f["latency_secs"].to_numpy(float)
                count, bad = count + len(f), bad + int((~ok).sum())
                at, cost = np.concatenate([at, when]), np.concatenate([cost, np.where(ok, late, np.maximum(late, PENALTY))])
                newest = np.lexsort((at[:, 1], at[:, 0]))[-reach:]
                at, cost = at[newest], cost[newest]
                if ok.any():
                    best = max(map(tuple, when[ok]))
                    good = best if good is None else max(good, best)
                failed = np.concatenate([failed, when[~ok]])
                if good is not None:
                    failed = failed[(failed[:, 0] > good[0]) | ((failed[:, 0] == good[0]) & (failed[:, 1] > good[1]))]
            # the r-th newest request weighs ALPHA (1 - ALPHA)^(r-1); beyond ``reach`` that is below 1e-24
            ema = float(ALPHA * (cost * (1 - ALPHA) ** np.arange(len(cost) - 1, -1, -1.0)).sum() + (1 - ALPHA) ** count * ema)
            streak = len(failed) + (streak if good is None else 0)
            if len(failed):
                until = int(failed[:, 0].max() // 1000 + COOLDOWN * 1000)
            tripped = streak >= TRIP and until > timerValues.getCurrentWatermarkInMs()
            if tripped:
                self.handle.registerTimer(until)
            state = (n + count, bad, ema, streak, until, tripped)
            self.state.update(state)
            yield self._row(key, state)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            state = self.state.get()
            # a later failure has moved the end on, a success has ended it before
            over = state[5] and expiredTimerInfo.getExpiryTimeInMs() >= state[4]
            if over:
                state = (*state[:5], False)
                self.state.update(state)
            yield self._row(key, state)[: int(over)]

        def close(self) -> None:
            pass

    return _stateful(log, "upstream", Health(), "upstream string, requests long, failures long, ema double, streak long, tripped boolean")
