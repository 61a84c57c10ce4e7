"""Online resampling: state of one sample for each run, carried from batch to batch.

A micro-batch's samples of a run are put in order, linked with the last sample of the batches before, and give the ticks
between them at once. What a task holds is a micro-batch's samples of a run, which the source's trigger bounds, and the state is
one sample. A sample before the run's last one, in order of time and id, can't change ticks that are out already: it goes
to an output of its own. A run that has been silent for longer than ``idle``, as the watermark tells, loses its state by a
timer; what comes of it later begins a new run of ticks, and rows older than the watermark Spark drops itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "run string, us long, id long, v double, late boolean"


def ticks_between(us: np.ndarray, v: np.ndarray, before: tuple[int, float] | None, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Ticks (multiples of ``step``) and their linear values in the span of ordered samples and the one before them; a tick belongs to the interval that ends at or after it."""
    us0, v0 = (np.concatenate([[b], x[:-1]]) for b, x in zip(before or (us[0], v[0]), (us, v), strict=True))
    first = us0 // step + 1
    if before is None:
        first[0] = -(-us[0] // step)  # a tick at the first sample
    counts = np.maximum(us // step + 1 - first, 0)
    at = np.repeat(np.arange(len(us)), counts)
    tick = (first[at] + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    gap = (us - us0)[at]
    w = np.divide(tick - us0[at], gap, out=np.ones(len(at)), where=gap > 0)
    return tick, np.where(gap > 0, (1 - w) * v0[at] + w * v[at], v[at])


class Resampler(StatefulProcessor):
    """The processor of ``resampled``."""

    def __init__(self, step: int) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, id long, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
        us, ids, v = (new[c].to_numpy(kind) for c, kind in (("us", np.int64), ("id", np.int64), ("v", np.float64)))
        state = self.last.get()
        late = np.zeros(len(us), bool) if state is None else (us < state[0]) | ((us == state[0]) & (ids < state[1]))
        if late.any():
            yield pd.DataFrame({"run": key[0], "us": us[late], "id": ids[late], "v": v[late], "late": True})
        us, ids, v = us[~late], ids[~late], v[~late]
        if not len(us):
            return
        tick, value = ticks_between(us, v, None if state is None else (state[0], state[2]), self.step)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(us[-1]) // 1000 + 1)
        self.last.update((int(us[-1]), int(ids[-1]), float(v[-1])))
        if len(tick):
            yield pd.DataFrame({"run": key[0], "us": tick, "id": pd.array([None] * len(tick), "Int64"), "v": value, "late": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def resampled(stream: DataFrame, step: int, idle: str = "365 days") -> DataFrame:
    """run, us, id, v, late of (run, us, id, v): ticks (``late`` false, no id), and late samples as they came.

    Samples without a time, id or value take no part, nor do those of before the second 1 of 1970, which is before every stream's first watermark. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    whole = stream.where("us > 999999 and id is not null and v is not null")
    timed = whole.select("run", F.timestamp_micros("us").alias("ts"), "us", "id", "v").withWatermark("ts", idle)
    return timed.groupBy("run").transformWithStateInPandas(Resampler(step), OUT, "Append", "EventTime")
