"""A log of workflow stages from a stream: one event for the first time that a question reaches a stage, with the seconds
since its stage before. What a question has reached is kept as state, so repeats and replays add nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "query_id string, stage string, nth int, at timestamp, elapsed double"
_STATE = "stages array<string>, last double"
#: A question that is silent for so long is forgotten.
FORGET = "1 hour"


def stage_events(reached: DataFrame) -> DataFrame:
    """EVENT rows of a table (query_id, stage, at): stages by their first time, ties by name."""
    first = reached.groupBy("query_id", "stage").agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "stage")
    since = F.unix_micros("at") - F.unix_micros(F.lag("at").over(order))
    return first.select("query_id", "stage", F.row_number().over(order).alias("nth"), "at", F.round(F.coalesce(since, F.lit(0)) / 1e6, 2).alias("elapsed"))


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    stages, last = state.get if state.exists else ([], None)
    stages, out = list(stages), []
    rows = pd.concat(list(frames)).sort_values(["at", "stage"])
    for stage, at in zip(rows["stage"], rows["at"], strict=True):
        if stage in stages:
            continue
        now = at.timestamp()
        stages.append(stage)
        out.append((key[0], stage, len(stages), at, round(now - last, 2) if last is not None else 0.0))
        last = now
    state.update((stages, last))
    state.setTimeoutTimestamp(int(last * 1000) + 3_600_000 if last is not None else 3_600_000)
    yield pd.DataFrame(out, columns=["query_id", "stage", "nth", "at", "elapsed"])


def follow_stages(stream: DataFrame, late: str = FORGET) -> DataFrame:
    """EVENT rows of a stream (query_id, stage, at) as they come; a stage is numbered when it is first seen.

    Write the result with a checkpoint to a sink that commits a batch once (files), and each event is in it exactly once.
    A question's state has one name a stage.
    """
    marked = stream.withWatermark("at", late)
    return marked.groupBy("query_id").applyInPandasWithState(_follow, EVENT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
