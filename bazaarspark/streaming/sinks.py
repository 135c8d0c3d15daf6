"""Appends of streams that write every row once, however often a batch is tried."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from bazaarspark.operators.conversations import clean_feedback, turns_to_messages


def append_once(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = (), ts: str = "ts", delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own number, which a second try of the batch replaces; the table is all of them. Rows with
    equal ``keys`` within ``delay`` of each other are one row, whichever batch they come in, with state for no longer than that."""
    rows = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys)) if keys else stream

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_messages(turns: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = ("customer_id", "turn_id"), ts: str = "ts", **trigger) -> StreamingQuery:
    """Turns as message rows (see ``turns_to_messages``), each turn once."""
    once = turns.withWatermark(ts, "10 minutes").dropDuplicatesWithinWatermark(list(keys))
    return append_once(turns_to_messages(once), folder, checkpoint, **trigger)


def append_feedback(feedback: DataFrame, folder: str, checkpoint: str, keys: Sequence[str] = ("feedback_id",), ts: str = "ts", **trigger) -> StreamingQuery:
    """Feedback rows with clean identifiers (see ``clean_feedback``), each once."""
    return append_once(clean_feedback(feedback), folder, checkpoint, keys, ts, **trigger)
