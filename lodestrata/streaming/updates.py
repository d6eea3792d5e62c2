"""Structured Streaming forms of the logical-clock operators; extensions, since the batch forms define the results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_capital(stream: DataFrame, null_mean: float, bet: float, alpha: float = 0.05) -> DataFrame:
    """stream (key, nth, x): after each batch, every key's capital and the first observation at which it reached 1 / alpha.

    The state is three numbers a key.  Observations of a batch are taken by nth.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        capital, stop, n = state.get if state.exists else (1.0, -1, 0)
        rows = pd.concat(list(frames)).sort_values("nth")
        for nth, x in zip(rows["nth"], rows["x"]):
            capital *= 1 + bet * (x - null_mean)
            n += 1
            if stop < 0 and capital >= 1 / alpha:
                stop = int(nth)
        state.update((float(capital), stop, n))
        yield pd.DataFrame({"key": [key[0]], "capital": [capital], "stopping": [stop if stop >= 0 else None], "n": [n]}).astype({"stopping": "Int64"})

    return stream.groupBy("key").applyInPandasWithState(step, "key long, capital double, stopping long, n long", "capital double, stopping long, n long", "update", GroupStateTimeout.NoTimeout)


def decaying_edges(stream: DataFrame, rate: float = 0.1, restore_at: int = 10, restore: float = 0.75) -> DataFrame:
    """stream (src, dst, tick, confidence): each event follows an edge; confidence decays by the ticks in between and is
    restored where the edge is followed often."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("tick")
        conf, count, last = state.get if state.exists else (float(rows["confidence"].iloc[0]), 0, int(rows["tick"].iloc[0]))
        for tick in rows["tick"]:
            conf *= (1 - rate) ** max(0, int(tick) - last)
            count, last = count + 1, max(last, int(tick))
            if count >= restore_at:
                conf = min(1.0, conf + restore * rate)
        state.update((float(conf), count, last))
        yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "confidence": [conf], "traversal_count": [count], "last_tick": [last]})

    return stream.groupBy("src", "dst").applyInPandasWithState(step, "src string, dst string, confidence double, traversal_count long, last_tick long", "confidence double, traversal_count long, last_tick long", "update", GroupStateTimeout.NoTimeout)


def windowed_means(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """stream (ts, event_type, value): mean by event-time window; events later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
