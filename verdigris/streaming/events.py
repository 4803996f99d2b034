"""Structured Streaming: appending documents batch by batch, idempotency keys with a fixed time to live, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_documents(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch's documents, first of each source, appended as Parquet; a batch that is replayed overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["source"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def idempotency_keys(stream: DataFrame, ttl_seconds: float, late: str = "1 hour") -> DataFrame:
    """stream (fingerprint, ts) -> fingerprint, ts, key_at, reused: a key lives ttl_seconds from its creation, however often it is used.

    Once the watermark (late behind the newest event) has passed a key's end, its state is removed.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts in rows["ts"]:
            now = ts.timestamp()
            reused = made is not None and now < made + ttl_seconds
            made = made if reused else now
            out.append((key[0], ts, pd.Timestamp(made, unit="s"), reused))
        state.update((made,))
        ends = int((made + ttl_seconds) * 1000)
        if ends > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["fingerprint", "ts", "key_at", "reused"])

    rows = stream.withWatermark("ts", late).groupBy("fingerprint")
    return rows.applyInPandasWithState(run, "fingerprint string, ts timestamp, key_at timestamp, reused boolean", "made double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Event-time windows with a watermark: start, event_type, n, total."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
