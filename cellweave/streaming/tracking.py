"""Tracking of frames as they come in: the batch fold with the last tracked frame of each position as state.

``track_stream`` takes streams whose frames come whole; ``track_pixels`` those whose pixels come as they like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cellweave.operators.tracking import track_step

OUT = "position long, frame_i long, y long, x long, label long"
STATE = "frame_i long, place array<long>, label array<long>"


def track_stream(labels: DataFrame, threshold: float = 0.4, denominator: str = "area_prev", unique_new: bool = True, idle: str | None = None) -> DataFrame:
    """A stream of object pixels ``(position, frame_i, y, x, label)`` with labels that follow objects.

    All pixels of a frame come in one micro-batch. Frames that are not after the last one tracked of their position are late
    and left out. With an ``idle`` time ("1 hour"), a position without data for so long ends, and its state with it.
    """
    union = {"area_prev": False, "union": True}[denominator]
    wait = idle and int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["frame_i", "y", "x"]).reset_index(drop=True)
        last = state.get if state.exists else None
        at = int(last[0]) if last else None
        prev = tuple(np.array(x, np.int64) for x in last[1:]) if last else None
        for frame, own in rows.groupby("frame_i", sort=True):
            if at is not None and frame <= at:
                continue
            place = own["y"].to_numpy(np.int64) << 32 | own["x"].to_numpy(np.int64)
            label = own["label"].to_numpy(np.int64).copy()
            if frame > 0:
                none = (np.empty(0, np.int64), np.empty(0, np.int64))
                label = track_step(prev if prev and at == frame - 1 else none, place, label, threshold, union, unique_new)
            at, prev = int(frame), (place, label)
            yield own[["position", "frame_i", "y", "x"]].assign(label=label)
        if prev is not None:
            state.update((at, prev[0].tolist(), prev[1].tolist()))
        if wait:
            state.setTimeoutDuration(wait)

    rows = labels.where("label <> 0").selectExpr("cast(position as long) position", "cast(frame_i as long) frame_i", "cast(y as long) y", "cast(x as long) x", "cast(label as long) label")
    return rows.groupBy("position").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)


PIXELS_OUT = "position long, frame_i long, y long, x long, label long, late boolean"
#: The state store that keeps more than one variable of a key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


def _rows(position: int, frame: int, place: np.ndarray, label: np.ndarray, late: bool) -> pd.DataFrame:
    return pd.DataFrame({"position": position, "frame_i": frame, "y": place >> 32, "x": place & 0xFFFFFFFF, "label": label, "late": late})


class FrameByFrame(StatefulProcessor):
    """A position's open frames, the last tracked one, and the latest time seen."""

    def __init__(self, delay: int, idle: int | None, threshold: float, union: bool, unique_new: bool):
        self.delay, self.idle, self.rule = delay, idle, (threshold, union, unique_new)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "frame_i long", "time long, place array<long>, label array<long>")
        self.last = handle.getValueState("last", "frame_i long, place array<long>, label array<long>")
        self.clock = handle.getValueState("clock", "time long")

    def _tracked(self, position: int, until: int | None) -> Iterator[pd.DataFrame]:
        """Open frames in order up to the first that may still grow; all of them without ``until``."""
        held = {int(k[0]): v for k, v in self.frames.iterator()}
        last = self.last.get() if self.last.exists() else None
        for frame in sorted(held):
            time, place, label = held[frame]
            if until is not None and time + self.delay >= until:
                break
            order = np.argsort(np.array(place, np.int64), kind="stable")
            place, label = np.array(place, np.int64)[order], np.array(label, np.int64)[order]
            if frame > 0:
                before = (np.array(last[1], np.int64), np.array(last[2], np.int64)) if last and last[0] == frame - 1 else _NONE
                label = track_step(before, place, label, *self.rule)
            last = (frame, place.tolist(), label.tolist())
            self.frames.removeKey((frame,))
            yield _rows(position, frame, place, label, False)
        if last is not None:
            self.last.update(last)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        data = pd.concat(list(rows))
        time = data["time"].to_numpy("datetime64[ms]").astype(np.int64)
        done = self.last.get()[0] if self.last.exists() else -1
        frames, label = data["frame_i"].to_numpy(np.int64), data["label"].to_numpy(np.int64)
        place = data["y"].to_numpy(np.int64) << 32 | data["x"].to_numpy(np.int64)
        for frame in np.unique(frames[label != 0]):
            own = (frames == frame) & (label != 0)
            if frame <= done:
                yield _rows(key[0], int(frame), place[own], label[own], True)
                continue
            before = self.frames.getValue((int(frame),)) if self.frames.containsKey((int(frame),)) else (0, [], [])
            self.frames.updateValue((int(frame),), (max(int(before[0]), int(time[own].max())), [*before[1], *place[own].tolist()], [*before[2], *label[own].tolist()]))
        clock = max(int(time.max()), self.clock.get()[0] if self.clock.exists() else 0)
        self.clock.update((clock,))
        yield from self._tracked(key[0], clock)
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._tracked(key[0], None)

    def close(self) -> None:
        pass


def track_pixels(pixels: DataFrame, delay: str = "10 seconds", threshold: float = 0.4, denominator: str = "area_prev", unique_new: bool = True, idle: str | None = None) -> DataFrame:
    """A stream of object pixels ``(position, frame_i, y, x, label, time)`` with labels that follow objects, and ``late``.

    A frame's pixels may come in any number of micro-batches and order. A frame ends once its position has seen a ``time`` more than
    ``delay`` after the frame's latest, and no earlier frame is open; pixels of label 0 only move that time on. Pixels of a frame that has
    ended come out as they are, marked ``late``: the time is kept by position and not as Spark's watermark, which would drop them unseen. With an
    ``idle`` time, a position without pixels for so long ends its open frames. The session must use the RocksDB state store (``STATE_STORE``).
    """
    milliseconds = lambda t: int(pd.Timedelta(t).total_seconds() * 1000)
    processor = FrameByFrame(milliseconds(delay), milliseconds(idle) if idle else None, threshold, {"area_prev": False, "union": True}[denominator], unique_new)
    rows = pixels.selectExpr("cast(position as long) position", "cast(frame_i as long) frame_i", "cast(y as long) y", "cast(x as long) x", "cast(label as long) label", "cast(time as timestamp) time")
    return rows.groupBy("position").transformWithStateInPandas(processor, PIXELS_OUT, "Append", "ProcessingTime" if idle else "None")
