"""State by sequence: windows of events and triplets of frames, each sequence by its own clock.

Spark's watermark is one for a whole query, so a sequence recorded earlier than another would be late as a whole. Here a sequence's state holds its
own clock. A row is late if what it belongs to was given out before. Late rows are dropped and counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A cell of a window as three whole numbers: its polarity and place in one code, events, and the time of the last.
CELL = np.dtype([("code", "<i8"), ("n", "<i8"), ("last", "<i8")])


def micros(span: str) -> int:
    return pd.Timedelta(span).value // 1000


def _code(p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows in 32 bits, columns in 31 (both may be negative), the polarity in the last."""
    return (y.astype(np.int64) << 32) + ((x.astype(np.int64) & 0x7FFFFFFF) << 1) + (p > 0)


def merged(cells: np.ndarray) -> np.ndarray:
    """One cell for each code: events added up, the last time of all."""
    cells = cells[np.argsort(cells["code"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], cells["code"][1:] != cells["code"][:-1]]))[: len(cells)]
    out = np.empty(len(first), CELL)
    if len(first):
        out["code"], out["n"], out["last"] = cells["code"][first], np.add.reduceat(cells["n"], first), np.maximum.reduceat(cells["last"], first)
    return out


def _frame(seq: list, *numbers) -> pd.DataFrame:
    """Rows of stream_windows(), of columns that may be null."""
    out = {"seq": pd.Series(seq, dtype=object)}
    for c, v in zip(("w_start", "w_end", "positive", "y", "x", "n", "last", "late"), numbers):
        out[c] = pd.array(list(v) if isinstance(v, list) or v.dtype == object else v, dtype="Int32" if c in ("positive", "y", "x") else "Int64")
    return pd.DataFrame(out)


class _Idle(StatefulProcessor):
    """A processor that is told when a sequence has been silent for ``idle`` milliseconds of processing time, if that is given."""

    idle: int | None = None

    def touched(self, timers) -> None:
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def forget(self) -> None:
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def close(self) -> None:
        pass


class EventWindows(_Idle):
    """Cells of tumbling windows. State: origin, latest time and first open window of a sequence, and the cells of each open window as bytes."""

    def __init__(self, dt: int, delay: int, start: int | None, idle: int | None):
        self.dt, self.delay, self.start, self.idle = dt, delay, start, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "origin long, latest long, closed long")
        self.open = handle.getMapState("open", "w long", "cells binary")

    def _rows(self, seq, windows: dict, origin: int, late: int = 0):
        """Output of closed windows, and one row for late events, if any."""
        for w in sorted(windows):
            c = windows[w]
            start, none = np.full(len(c), origin + w * self.dt), np.full(len(c), None, object)
            yield _frame([seq] * len(c), start, start + self.dt, c["code"] & 1, c["code"] >> 32, ((c["code"] >> 1 & 0x7FFFFFFF) ^ 1 << 30) - (1 << 30), c["n"], c["last"], none)
        if late:
            yield _frame([seq], *[[None]] * 7, [late])

    def _take(self, windows) -> dict:
        out = {}
        for w in windows:
            out[w] = np.frombuffer(self.open.getValue((w,))[0], CELL)
            self.open.removeKey((w,))
        return out

    def _end(self, seq, origin: int, latest: int):
        """All open windows that begin before the last event; the sequence is forgotten."""
        held = self._take([k[0] for k in self.open.keys()])
        self.clock.clear()
        self.forget()
        yield from self._rows(seq, {w: c for w, c in held.items() if origin + w * self.dt < latest}, origin)

    def handleInputRows(self, key, rows, timerValues):
        origin, latest, closed = self.clock.get() if self.clock.exists() else (self.start, None, None)
        parts = list(rows)
        times = [p["t"].dropna().astype(np.int64) for p in parts]
        top = max((int(t.max()) for t in times if len(t)), default=None)
        low = min((int(p["t"].min()) for p in parts if p["t"].notna().any()), default=None)
        ended = any((p["t"].isna() & p["x"].isna()).any() for p in parts)
        if origin is None and low is not None:
            origin = low
        late, now = 0, {}
        for p in parts:
            p = p[p["t"].notna() & p["x"].notna() & p["y"].notna() & p["p"].notna()]
            t = p["t"].to_numpy().astype(np.int64)
            if not len(t):
                continue
            w = (t - origin) // self.dt
            fine = (t >= origin) if self.start is None else np.ones(len(t), bool)
            if closed is not None:
                fine &= w >= closed
            late += int((~fine).sum())
            cells = np.empty(int(fine.sum()), CELL)
            cells["code"], cells["n"], cells["last"] = _code(*(p[c].to_numpy()[fine] for c in ("p", "y", "x"))), 1, t[fine]
            for v in np.unique(w[fine]).tolist():
                now.setdefault(v, []).append(merged(cells[w[fine] == v]))
        if origin is None:  # nothing but rows without a time
            return
        latest = top if latest is None else max(latest, top if top is not None else latest)
        for v, own in now.items():
            old = [np.frombuffer(self.open.getValue((v,))[0], CELL)] if self.open.containsKey((v,)) else []
            self.open.updateValue((v,), (merged(np.concatenate([*old, *own])).tobytes(),))
        if latest is not None:
            until = (latest - self.delay - origin) // self.dt
            closed = until if closed is None else max(closed, until)
            done = self._take([k[0] for k in self.open.keys() if k[0] < closed])
        else:
            done = {}
        yield from self._rows(key[0], done, origin, late)
        if ended:
            yield from self._end(key[0], origin, latest if latest is not None else origin)
        else:
            self.clock.update((origin, latest, closed))
            self.touched(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.clock.exists():
            origin, latest, _ = self.clock.get()
            yield from self._end(key[0], origin, latest)


class Triplets(_Idle):
    """Frames in order with the three before them. State: the frames that still wait, those given out last, and the greatest index."""

    def __init__(self, delay: int, idle: int | None):
        self.delay, self.idle = delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("frames", "waiting array<long>, before array<long>, top long")

    @staticmethod
    def _given(seq, before: list, ready: list, late: int = 0) -> tuple[pd.DataFrame, list]:
        rows = []
        for i in ready:
            if len(before) == 3:
                rows.append((seq, i, *before, None))
            before = [*before, i][-3:]
        if late:
            rows.append((seq, None, None, None, None, late))
        out = pd.DataFrame(rows, columns=["seq", "frame_idx", "f0", "f1", "f2", "late"])
        return out.astype({"seq": object, **{c: "Int64" for c in out.columns[1:]}}), before

    def handleInputRows(self, key, rows, timerValues):
        waiting, before, top = self.state.get() if self.state.exists() else ([], [], None)
        column = pd.concat([p["frame_idx"] for p in rows])
        came = column.dropna().astype(np.int64).tolist()
        ended = bool(column.isna().any())
        done = before[-1] if before else None
        fresh = [i for i in came if done is None or i > done]
        waiting = sorted([*waiting, *fresh])
        top = max([*came, *([] if top is None else [top])], default=None)
        cut = len(waiting) if ended else int(np.searchsorted(np.array(waiting, np.int64), top - self.delay, "right")) if waiting else 0
        out, before = self._given(key[0], list(before), waiting[:cut], len(came) - len(fresh))
        if ended:
            self.state.clear()
            self.forget()
        else:
            self.state.update((waiting[cut:], before, top))
            self.touched(timerValues)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            waiting, before, _ = self.state.get()
            self.state.clear()
            yield self._given(key[0], list(before), list(waiting))[0]


def _applied(df: DataFrame, processor: _Idle, schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # the store that such state needs
    return df.groupBy("seq").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="None" if processor.idle is None else "ProcessingTime")


def stream_windows(ev: DataFrame, dt: str, delay: str = "0 seconds", start: str | None = "0 seconds", idle: str | None = None) -> DataFrame:
    """seq, w_start, w_end (timestamps), positive, y, x, n, last (timestamp), late of a stream of events (seq, ts, x, y, p).

    Windows of ``dt`` begin at ``start`` after 1970, or, where that is None, at the sequence's first event (of its first micro-batch). A window
    is given out once the sequence's own latest time, less ``delay``, has reached its end. An event for a window given out before
    is late: it counts in a row that has only seq and late (one for each sequence and micro-batch with any). A row without x, y or p moves the clock only; one
    without x and ts ends the sequence, as ``idle`` of processing time without rows does: open windows that begin before its last event are given out,
    and its state goes. (Timers keep a query alive: with ``idle``, use a trigger that runs on, not availableNow.) Rows with ts missing otherwise are left out. A sequence is one key, as its clock is; its open windows are its state.
    """
    processor = EventWindows(micros(dt), micros(delay), None if start is None else micros(start), None if idle is None else micros(idle) // 1000)
    out = _applied(ev.select("seq", F.unix_micros("ts").alias("t"), "x", "y", "p"), processor, "seq string, w_start long, w_end long, positive int, y int, x int, n long, last long, late long")
    return out.select("seq", *[F.timestamp_micros(c).alias(c) for c in ("w_start", "w_end")], "positive", "y", "x", "n", F.timestamp_micros("last").alias("last"), "late")


def late_rows(out: DataFrame) -> DataFrame:
    """seq, late: how many rows of a sequence came too late, of what stream_windows() or stream_ordered_triplets() gives."""
    return out.where("late is not null").select("seq", "late")


def stream_ordered_triplets(frames: DataFrame, delay: int = 0, idle: str | None = None) -> DataFrame:
    """seq, frame_idx, f0, f1, f2, late of a stream of frames (seq, frame_idx): the three frames before each one, in the order of their indexes.

    A frame waits until the sequence has reached an index ``delay`` higher, so any order of arrival within that gives the same rows. A frame that comes
    behind one given out is late and counts in a row that has only seq and late. A row without an index ends the sequence, as ``idle`` of
    processing time without rows does: what waits is given out, and its state goes.
    """
    return _applied(frames.select("seq", "frame_idx"), Triplets(delay, None if idle is None else micros(idle) // 1000), "seq string, frame_idx long, f0 long, f1 long, f2 long, late long")
