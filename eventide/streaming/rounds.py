"""The same results from a stream of observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_observations(obs: DataFrame, late: str = "72 hours") -> DataFrame:
    """Replays of an observation are dropped while it can still be late."""
    return obs.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["observation_id"])


def slot_counts(obs: DataFrame, slot: str = "1 hour", late: str = "72 hours") -> DataFrame:
    """Rounds (counted exactly: a slot has few) and best score by event, platform and sampling slot."""
    w = obs.withWatermark("observed_at", late).groupBy(F.window("observed_at", slot), "event_id", "platform")
    return w.agg(F.size(F.collect_set("run_id")).cast("bigint").alias("rounds"), F.max("score").alias("score")).select("window.start", "window.end", "event_id", "platform", "rounds", "score")


def rolling_presence(obs: DataFrame, size: str = "24 hours", slide: str = "1 hour", late: str = "72 hours") -> DataFrame:
    """Observations with presence in rolling windows (start, end]: Spark's windows are [start,
    end), so times move back by a microsecond."""
    left_open = obs.withWatermark("observed_at", late).withColumn("_t", F.col("observed_at") - F.expr("INTERVAL 0.000001 SECOND"))
    return left_open.withWatermark("_t", late).where("present").groupBy(F.window("_t", size, slide), "event_id", "platform").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_id", "platform", "n")


def presence_sessions(obs: DataFrame, gap: str = "120 minutes", late: str = "72 hours") -> DataFrame:
    """Sessions of presence that a longer gap ends."""
    s = obs.withWatermark("observed_at", late).where("present").groupBy(F.session_window("observed_at", gap), "event_id", "platform").agg(F.count("*").alias("n"))
    return s.select("session_window.start", "session_window.end", "event_id", "platform", "n")


def running_trend(obs: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Direction of each observation against the one before, with state by series. What a series has
    in one batch (bound it by files or rows a trigger) is ordered and compared as whole columns;
    rows older than the state are flagged late, not applied."""
    out = "event_id bigint, platform string, observed_at timestamp, trend string"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = pd.concat([x[["observed_at", "observation_id", "score"]] for x in frames]).sort_values(["observed_at", "observation_id"])
        last = state.get if state.exists else None
        at, score = f["observed_at"].astype("int64").to_numpy(), f["score"].to_numpy(float)
        late = at < last[0] if last else np.zeros(len(f), bool)
        old = int(late.sum())  # they come first
        change = np.diff(score[old:], prepend=last[1] if last else np.nan)
        trend = np.select([np.isnan(change), change >= threshold, change <= -threshold], ["unknown", "rising", "cooling"], "stable")
        if old < len(f):
            state.update((int(at[-1]), float(score[-1])))
        yield pd.DataFrame({"event_id": key[0], "platform": key[1], "observed_at": f["observed_at"].to_numpy(), "trend": ["late"] * old + trend.tolist()})

    return obs.groupBy("event_id", "platform").applyInPandasWithState(step, out, "at bigint, score double", "append", GroupStateTimeout.NoTimeout)
