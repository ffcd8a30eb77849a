"""Streaming forms: states of a frame stream, and sessions of an event stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.frames import COLUMNS, Scanner, ScanRule

SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS)


def track_states(frames: DataFrame, width: int, height: int, rule: ScanRule = ScanRule()) -> DataFrame:
    """Closed states and events of each media as frames arrive. The state store holds one scanner per media; frames
    that come after a later one are dropped, since the fold has no rule for them. A state that is open stays so."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        scanner: Scanner = pickle.loads(held.get[0]) if held.exists else Scanner(key[0], rule)
        arrived = pd.concat(list(batches)).sort_values("t_us")
        for t, pixels in zip(arrived["t_us"], arrived["pixels"], strict=True):
            if scanner.before is None or t > scanner.before:
                scanner.feed(int(t), np.asarray(pixels, np.int16).reshape(height, width))
        out, scanner.out = scanner.out, []
        held.update((pickle.dumps(scanner),))
        yield pd.DataFrame(out, columns=[n for n, _ in COLUMNS])

    return frames.groupBy("media_id").applyInPandasWithState(step, SCHEMA, "scanner binary", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user in an event stream (user_id, ts TIMESTAMP), late events allowed for."""
    windowed = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return windowed.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
