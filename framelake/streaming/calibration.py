"""Calibration of a stream of frames, equal to the batch operator on the same frames, also where these lack pixels.

Pixels are dealt to tiles with a rim of one pixel for the neighbours of bad pixels. A tile's state is what the recursive scrub keeps of each pixel, four values
and two times, and a map of the frames that came before their turn, an entry each. So a trigger writes a tile's scrub once and the frames that have to
wait, however many wait already. Frames whose number has passed, or is there already, are dropped. A frame's pixels must arrive in one trigger; frames may
arrive out of order.

A frame that is still missing when `max_ahead` later ones wait, or `max_wait_ms` after the first of these came, is given up, and the others go on without it, as the
batch operator does where there is no such frame. So a tile's state is max_ahead frames at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.functions.shipping import ship
from framelake.operators.calib import Scrub, prepared, with_rim

OUT = "frame_id int, y int, x int, v int"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TileCalibration(StatefulProcessor):
    """The frames of one tile in their order."""

    def __init__(self, tile: int, first_prepared: int, max_ahead: int, max_wait_ms: int | None):
        self.tile, self.first_prepared, self.max_ahead, self.max_wait_ms = tile, first_prepared, max_ahead, max_wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scrub = handle.getValueState("scrub", "data binary")
        #: the number that comes next; how many frames wait; whether a timer runs
        self.progress = handle.getValueState("progress", "expected int, n_waiting int, timed boolean")
        self.waiting = handle.getMapState("waiting", "frame int", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        expected, n_waiting, timed = self.progress.get() if self.progress.exists() else (0, 0, False)
        number = came["frame_id"].to_numpy()
        order = np.argsort(number, kind="stable")
        columns = {c: came[c].to_numpy()[order] for c in ("y", "x", "v", "off", "gain", "bad")}
        cuts = np.flatnonzero(np.diff(number[order])) + 1
        new = {}
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
            own = int(number[order[begin]])
            if own >= expected and not (n_waiting and self.waiting.containsKey((own,))):
                new[own] = self.frame(key, own, {c: x[begin:end] for c, x in columns.items()})
        yield self.go_on(key, timerValues, expected, n_waiting, timed, new, overdue=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, n_waiting, _ = self.progress.get() if self.progress.exists() else (0, 0, False)
        yield self.go_on(key, timerValues, expected, n_waiting, False, {}, overdue=True)

    def close(self) -> None:
        pass

    def frame(self, key, number: int, rows: dict[str, np.ndarray]) -> np.ndarray:
        """(values, -1 where there is no pixel; gains) of the tile's pixels; of a pixel that comes twice, the first."""
        y0, x0 = int(key[0]) * self.tile - 1, int(key[1]) * self.tile - 1
        grid = {c: np.full((self.tile + 2, self.tile + 2), -1, np.int64) for c in ("v", "off", "gain", "bad")}
        at = rows["y"][::-1] - y0, rows["x"][::-1] - x0
        for c in grid:
            grid[c][at] = rows[c][::-1]
        v = prepared(grid) if number >= self.first_prepared else grid["v"][1:-1, 1:-1]
        return np.stack([v, grid["gain"][1:-1, 1:-1]]).reshape(2, -1).astype(np.int32)

    def go_on(self, key, timers, expected: int, n_waiting: int, timed: bool, new: dict[int, np.ndarray], *, overdue: bool) -> pd.DataFrame:
        """Takes the frames whose turn it is; the others wait in the state. overdue: the missing ones before the first that waits are given up."""
        state, found = self.loaded(), []
        held = {f[0] for f in self.waiting.keys()} if n_waiting else set()
        turns = sorted([*held, *new], reverse=True)
        while turns:
            number = turns[-1]
            if number > expected and not overdue and len(turns) <= self.max_ahead:
                break
            overdue = False
            turns.pop()
            if number in new:
                v, gain = new.pop(number)
            else:
                v, gain = np.frombuffer(self.waiting.getValue((number,))[0], np.int32).reshape(2, -1)
                self.waiting.removeKey((number,))
            expected = number + 1
            at = np.flatnonzero((v >= 0) & (gain >= 0))
            done, times, out = state.add(at, number, v[at].astype(np.int64), gain[at].astype(np.int64))
            found.append((times, at[done] // self.tile + key[0] * self.tile, at[done] % self.tile + key[1] * self.tile, out))
        if found:
            self.scrub.update((np.concatenate([np.atleast_2d(x) for x in (state.seen, state.outputs, state.waiting, state.times)]).astype(np.int32).tobytes(),))
        for number, data in new.items():
            self.waiting.updateValue((number,), (data.tobytes(),))
        n_waiting = len(turns)
        if n_waiting and not timed and self.max_wait_ms is not None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.max_wait_ms)
            timed = True
        self.progress.update((expected, n_waiting, timed))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 4
        return pd.DataFrame({c: x.astype(np.int32) for c, x in zip(("frame_id", "y", "x", "v"), columns, strict=True)})

    def loaded(self) -> Scrub:
        state = Scrub(self.tile**2)
        if self.scrub.exists():
            rows = np.frombuffer(self.scrub.get()[0], np.int32).astype(np.int64).reshape(7, -1)
            state.seen, state.outputs, state.waiting, state.times = rows[0], rows[1:3].copy(), rows[3:5].copy(), rows[5:7].copy()
            state.seen = np.minimum(state.seen, 4)  # more are told apart nowhere
        return state


def calibrate_stream(frames: DataFrame, maps: DataFrame, *, tile: int = 16, first_prepared: int = 4, max_ahead: int = 64, max_wait_ms: int | None = None) -> DataFrame:
    """frames: a stream of (frame_id, y, x, v); maps: a static (y, x, off, gain, bad). Yields finished pixels; bins and sums are the sink's.

    max_wait_ms: of processing time; without it a missing frame is given up by count alone. The session's state store becomes RocksDB, which this kind of state needs.
    """
    spark = frames.sparkSession
    ship(spark)
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    dealt = frames.select("frame_id", "y", "x", "v").join(with_rim(maps.select("y", "x", "off", "gain", "bad"), tile), ["y", "x"])
    processor = TileCalibration(tile, first_prepared, max_ahead, max_wait_ms)
    return dealt.groupBy("ty", "tx").transformWithStateInPandas(processor, OUT, "append", "none" if max_wait_ms is None else "processingTime")
