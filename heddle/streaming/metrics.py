"""Streaming roll-up of events, and a buffer that flushes by tokens; both also run on batch input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUFFER = "key string, flushed long, tokens long"


def roll_up(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of each window; a stream drops its state `late` after a window's end."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _flush(limit: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, held = state.get if state.exists else (0, 0)
        out = []
        for part in parts:
            for tokens in part["tokens"]:
                count, held = count + 1, held + int(tokens)
                if held >= limit:
                    out.append((key[0], count, held))
                    count = held = 0
        state.update((count, held))
        yield pd.DataFrame(out, columns=["key", "flushed", "tokens"])

    return run


def buffered(units: DataFrame, limit: int = 512) -> DataFrame:
    """key, flushed, tokens for each time a key's buffer (key, tokens) reaches the limit and is emptied; state is two numbers a key."""
    return units.groupBy("key").applyInPandasWithState(_flush(limit), BUFFER, "count long, held long", "append", GroupStateTimeout.NoTimeout)
