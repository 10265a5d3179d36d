"""Streaming extras: event-time counts and session memory kept as state (the batch views are the reference)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.memory import FOLD_CHARS, KEEP, SUMMARY_CHARS


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def ndjson_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def session_memory(turns: DataFrame) -> DataFrame:
    """A session's summary and number of recent messages after each batch of turns; state is the window and the summary."""
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        summary, recent = state.get if state.exists else ("", [])
        recent = list(recent)
        for pdf in batches:  # what is older than the window is folded batch by batch, so no list holds a whole session
            recent += [f"{row.role}: {(row.text or '')}" for row in pdf.sort_values("turn").itertuples()]
            folded = [f"- {x.replace(chr(10), ' ')[: FOLD_CHARS + x.index(':') + 2]}" for x in recent[:-KEEP]]
            summary, recent = "\n".join(x for x in (summary, *folded) if x)[-SUMMARY_CHARS:], recent[-KEEP:]
        state.update((summary, recent[-KEEP:]))
        yield pd.DataFrame({"session_id": [key[0]], "summary": [summary], "recent": [len(recent[-KEEP:])]})

    return turns.groupBy("session_id").applyInPandasWithState(update, "session_id long, summary string, recent int", "summary string, recent array<string>", "update", GroupStateTimeout.NoTimeout)
