"""Documents expire an hour after they were last touched, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues

from maskline.sources.ingest import is_document_id

# Seconds that an idle document is kept, and between two sweeps.
RETENTION_S, SWEEP_S = 3600, 300


def last_touch(touches: DataFrame, doc: str = "doc_id", ts: str = "ts") -> DataFrame:
    return touches.groupBy(doc).agg(F.max(ts).alias("last_touch"))


def stale(touches: DataFrame, now: Column, doc: str = "doc_id", ts: str = "ts", retention_s: int = RETENTION_S) -> DataFrame:
    """Documents that nobody has touched for the retention time, or longer, as of now."""
    age = F.unix_micros(F.to_timestamp_ltz(now)) - F.unix_micros(F.to_timestamp_ltz(F.col("last_touch")))
    return last_touch(touches, doc, ts).withColumn("age_s", age / 1e6).where(F.col("age_s") >= retention_s)


def sweep(touches: DataFrame, now: Column, doc: str = "doc_id", ts: str = "ts", retention_s: int = RETENTION_S) -> DataFrame:
    """As stale(), of documents alone: what isn't named like one is never removed."""
    return stale(touches.where(is_document_id(F.col(doc))), now, doc, ts, retention_s)


def deleted_count(swept: DataFrame) -> DataFrame:
    return swept.agg(F.count("*").alias("deleted_count"))


class Expiry(StatefulProcessor):
    """Keeps the last touch of each document; a timer at last touch + retention emits it and forgets it."""

    def __init__(self, retention_s: int = RETENTION_S):
        self.retention_ms = retention_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pd.to_datetime(b["ts"]).max().value // 1_000_000) for b in rows)
        if self.last.exists():
            old = self.last.get()[0]
            if old >= newest:
                return iter(())
            self.handle.deleteTimer(old + self.retention_ms)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.retention_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"doc_id": [key[0]], "last_touch": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


class Closing(Expiry):
    """As Expiry, and a touch that closes its document (its download) removes that at once."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        rows = list(rows)
        closed = [pd.to_datetime(b.loc[b["closes"], "ts"]).max() for b in rows if b["closes"].any()]
        if not closed:
            yield from super().handleInputRows(key, iter(rows), timerValues)
            return
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[0] + self.retention_ms)
            self.last.clear()
        yield pd.DataFrame({"doc_id": [key[0]], "last_touch": [max(closed)], "reason": ["downloaded"]})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        for gone in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield gone.assign(reason="expired")


def close_stream(touches: DataFrame, doc: str = "doc_id", late: str = "10 minutes", retention_s: int = RETENTION_S) -> DataFrame:
    """A stream of touches (doc, ts, closes) to one of removed documents (doc_id, last_touch, reason): downloaded or expired."""
    events = touches.select(F.col(doc).alias("doc_id"), "ts", F.coalesce("closes", F.lit(False)).alias("closes")).withWatermark("ts", late)
    kind = dict(events.dtypes)["doc_id"]
    return events.groupBy("doc_id").transformWithStateInPandas(Closing(retention_s), f"doc_id {kind}, last_touch timestamp, reason string", "Append", "EventTime")


def expire_stream(touches: DataFrame, doc: str = "doc_id", late: str = "10 minutes", retention_s: int = RETENTION_S) -> DataFrame:
    """A stream of touches (doc, ts) to one of expired documents; touches later than late are ignored."""
    events = touches.select(F.col(doc).alias("doc_id"), "ts").withWatermark("ts", late)
    kind = dict(events.dtypes)["doc_id"]
    return events.groupBy("doc_id").transformWithStateInPandas(Expiry(retention_s), f"doc_id {kind}, last_touch timestamp", "Append", "EventTime")


def sessions(touches: DataFrame, doc: str = "doc_id", retention_s: int = RETENTION_S) -> DataFrame:
    """Spells of activity, each ended by the retention time without a touch."""
    return touches.groupBy(doc, F.session_window("ts", f"{retention_s} seconds").alias("w")).agg(F.count("*").alias("touches")).select(doc, F.col("w.start").alias("opened"), F.col("w.end").alias("expired"), "touches")


def run_sweeps(expired: DataFrame, sink: str, checkpoint: str, once: bool = False):
    """Starts the periodic sweep: expired documents are appended to sink as Parquet."""
    writer = expired.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{SWEEP_S} seconds")).start()
