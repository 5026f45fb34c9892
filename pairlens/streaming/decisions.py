"""The decision log as a stream: ingest, running counters, per-sequence state, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairlens.operators.outcomes import outcome

SEQUENCE = "run_id string, sequence_id string, logged int, counted int, outcome string, closed boolean, kind string"
_COLUMNS = ["run_id", "sequence_id", "logged", "counted", "outcome", "closed", "kind"]
_STATE = "logged int, ended boolean"


def ingest(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all events that are there to Parquet and stops; a restart goes on after the last finished batch, each event once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_outcomes(events: DataFrame) -> DataFrame:
    """Outcome counts so far by run, for complete or update mode; the same as the batch count."""
    return events.where(F.col("event_type") == "sequence_end").select("run_id", outcome().alias("outcome")).where(F.col("outcome").isNotNull()).groupBy("run_id", "outcome").agg(F.count("*").alias("n"))


def to_table(rows: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Runs a stream whose result is few rows (a summary) to its present end into an in-memory table."""
    rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sequences(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Rows of sequences by ``kind``: ended (by its end event), expired (``timeout_ms`` without events before an end), late.

    State is a count and a flag per sequence. What comes after a sequence's end
    doesn't open it anew: it is given out by itself as late, with the number of
    logged events that came. With ``timeout_ms`` the state of an ended sequence
    lives that long after its last event, so state stays bounded; without, as in
    a run over what is there now (a timeout would make it wait), it is kept.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        logged, ended = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.remove()
            if not ended:
                yield pd.DataFrame([(*key, logged, None, None, False, "expired")], columns=_COLUMNS)
            return
        came, end = 0, None
        for batch in batches:
            came += int((batch["event_type"] == "token_disagreement").sum())
            ends = batch[batch["event_type"] == "sequence_end"]
            if len(ends):
                end = ends.iloc[-1]
        counted = None if end is None or pd.isna(end["disagreement_count"]) else int(end["disagreement_count"])
        found = None if end is None or pd.isna(end["outcome"]) else end["outcome"]
        if ended:
            yield pd.DataFrame([(*key, came, counted, found, end is not None, "late")], columns=_COLUMNS)
        elif end is not None:
            yield pd.DataFrame([(*key, logged + came, counted, found, True, "ended")], columns=_COLUMNS)
        state.update((logged if ended else logged + came, ended or end is not None))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    slim = events.where(F.col("sequence_id").isNotNull()).select("run_id", "sequence_id", "event_type", "disagreement_count", outcome().alias("outcome"))
    return slim.groupBy("run_id", "sequence_id").applyInPandasWithState(step, SEQUENCE, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def _windowed(events: DataFrame, window, value: str) -> DataFrame:
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def tumbling(events: DataFrame, length: str = "1 hour", late: str | None = None, at: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums per window and type; ``late`` sets a watermark for streams."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    return _windowed(rows.withWatermark(at, late) if late else rows, F.window(at, length), value)


def sliding(events: DataFrame, length: str = "1 day", step: str = "6 hours", late: str | None = None, at: str = "ts", value: str = "value") -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    return _windowed(rows.withWatermark(at, late) if late else rows, F.window(at, length, step), value)


def sessions(events: DataFrame, gap: str = "6 hours", by: str = "user_id", late: str | None = None, at: str = "ts") -> DataFrame:
    """Per user the stretches of events without a pause of ``gap``."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        rows = rows.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
