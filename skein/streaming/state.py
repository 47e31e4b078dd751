"""Streams: windowed counts with a watermark, ingest by micro-batches, and keyed state with a time to live."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunking import pack_sentences, redact
from ..operators.index import apply_delta

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) counts; rows later than the watermark are dropped and state is released."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("window.start", "event_type", "n", "mean")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, target: str, checkpoint: str):
    """Each micro-batch of (document_id, content) is redacted, packed into chunks and appended with hashes."""

    def write(batch: DataFrame, number: int) -> None:
        c = batch.select("document_id", F.posexplode(pack_sentences(redact(F.col("content")))).alias("idx", "chunk"))
        c.withColumn("content_hash", F.sha2("chunk", 256)).withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(stream: DataFrame, target: str, checkpoint: str):
    """Each micro-batch of (document_id, content) becomes the chunk table's next version by hash difference: folders ``target/v0``,
    ``v1`` and so on, each whole, so that readers keep the one they opened. Documents that the batch lacks stay as they are."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("document_id", F.posexplode(pack_sentences(redact(F.col("content")))).alias("idx", "chunk"))
        new = new.select("document_id", "idx", F.sha2("chunk", 256).alias("content_hash"))
        if number == 0:
            table = new.withColumn("chunk_version", F.lit(1))
        else:
            old = spark.read.parquet(f"{target}/v{number - 1}")
            seen = batch.select("document_id").distinct()
            table = apply_delta(old.join(seen, "document_id", "left_semi"), new).unionByName(old.join(seen, "document_id", "left_anti"))
        table.write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keyed state with timers needs this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _LastSeen(StatefulProcessor):
    """One timestamp a key; a timer clears it when the watermark has passed its time to live."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            t = np.sort(pdf["ts"].to_numpy("datetime64[us]").astype(np.int64))
            before = np.concatenate([[t[0] if last is None else last], t[:-1]])
            hit = t - before <= self.ttl_s * 1_000_000
            hit[0] &= last is not None
            last = int(max(t[-1], before[0]))
            yield pd.DataFrame({"key": key[0], "ts": t.astype("datetime64[us]"), "hit": hit})
        if last is not None:
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.ttl_s * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.last.exists() and self.last.get()[0] // 1000 + self.ttl_s * 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())


def cached_answers(stream: DataFrame, ttl_s: int = 3600, late: str = "2 hours") -> DataFrame:
    """(key, ts, hit) of lookups (key, ts): a hit if the key was looked up within the time to live before. State is one timestamp a key,
    released when the watermark has passed it. The session's state store must be STATE_STORE."""
    return stream.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_LastSeen(ttl_s), "key string, ts timestamp, hit boolean", "Append", "EventTime")
