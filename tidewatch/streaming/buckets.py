"""Keys dealt into buckets, worked on in arrays, with their state in one piece.

A call of a stateful operator for each key, with its own state and timer, costs
far more than its work. So the operators group by a bucket of keys, sort a
bucket's new rows by key and time in arrays, and keep what they know of all its
keys as one packed table with one timer.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Streams of packets and connections are dealt into so many buckets; a bucket's rows of a micro-batch must fit a task.
BUCKETS = 256
#: Stands for no earlier row.
NEVER = np.iinfo("int64").min
NEVER_AGAIN = np.iinfo("int64").max


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def coded(rows: pd.DataFrame, names: list[str]) -> np.ndarray:
    """The number of each row's key; null is a value."""
    code = np.zeros(len(rows), "int64")
    for name in names:
        part, found = pd.factorize(rows[name], use_na_sentinel=False)
        code = pd.factorize(code * max(len(found), 1) + part)[0]
    return code


def ordered(code: np.ndarray, ts: np.ndarray, row_id: pd.Series | None = None) -> np.ndarray:
    """Places of rows by key, time and ``row_id``; others as they came."""
    order = np.lexsort((ts, code))
    if row_id is None or not len(order):
        return order
    alike = (code[order][1:] == code[order][:-1]) & (ts[order][1:] == ts[order][:-1])
    tied = order[np.append(alike, False) | np.append(False, alike)]
    if len(tied):
        held = pd.DataFrame({"code": code[tied], "ts": ts[tied], "id": row_id.to_numpy()[tied]})
        order[np.append(alike, False) | np.append(False, alike)] = tied[held.sort_values(["code", "ts", "id"], kind="stable").index.to_numpy()]
    return order


class Line:
    """A bucket's new rows by key and time, beside what is ``held`` of their keys.

    ``first`` and ``end`` mark a key's first and last row, ``place`` is the row
    of ``held`` with its state or -1, ``latest`` the latest time of the key
    before a row, its state's among them.
    """

    def __init__(self, held: pd.DataFrame, rows: pd.DataFrame, names: list[str], row_id: str | None = None):
        known = len(held)
        code = coded(pd.concat([held[names], rows[names]], ignore_index=True) if known else rows, names)
        timed = rows["ts_us"].notna().to_numpy()
        ts = rows["ts_us"].fillna(NEVER_AGAIN).to_numpy("int64")
        order = ordered(code[known:], ts, None if row_id is None else rows[row_id])
        places = np.full(int(code.max()) + 1, -1)
        places[code[:known]] = np.arange(known)
        own = code[known:][order]
        self.rows, self.timed, self.place = rows.iloc[order], timed[order], places[own]
        self.first, self.end = np.append(True, own[1:] != own[:-1]), np.append(own[1:] != own[:-1], True)
        # Rows without time come last; for those after them, they are as late as the last one with a time.
        at = np.maximum.accumulate(np.where(self.timed | self.first, np.arange(len(own)), 0))
        self.ts = np.where(self.timed[at], ts[order][at], NEVER)
        before = np.where(self.first, NEVER, np.roll(self.ts, 1))
        self.latest = np.maximum(before, np.append(held["last_us"].to_numpy("int64"), NEVER)[self.place])
        self.silent = np.ones(known, bool)
        self.silent[self.place[self.place >= 0]] = False

    def gap(self) -> np.ndarray:
        """Time since the key's latest row; none where it is the first, or has no time."""
        return np.where(self.timed & (self.latest != NEVER), self.ts - np.where(self.latest == NEVER, 0, self.latest), 0)

    def last(self) -> np.ndarray:
        """The latest time of each key."""
        return np.maximum(self.ts, self.latest)[self.end]


class Bucketed(StatefulProcessor):
    """State of a bucket: a table with a row for each key, and one timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "packed binary")

    def held(self, columns: Iterable[str]) -> pd.DataFrame:
        if self.state.exists():
            return unpacked(bytes(self.state.get()[0])).to_pandas()
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})

    def keep(self, rows: pd.DataFrame, wake_us: int | None) -> None:
        """Hold ``rows`` and be called when the watermark has passed ``wake_us``."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not len(rows):
            self.state.clear()
            return
        self.state.update((packed(pa.Table.from_pandas(rows, preserve_index=False)),))
        self.handle.registerTimer(int(wake_us) // 1000 + 1)

    def close(self) -> None:
        pass


class Recent(Bucketed):
    """Keys that are forgotten ``keep_us`` after their latest row."""

    keep_us = 0

    def remember(self, held: pd.DataFrame, line: Line, values: dict, names: list[str], timer_values) -> None:
        """Hold each key's ``values`` and latest time, if a row that isn't late can still see them."""
        new = line.rows.loc[line.end, names].assign(last_us=line.last(), **{n: v[line.end] for n, v in values.items()})
        rows = pd.concat([held[line.silent], new], ignore_index=True) if line.silent.any() else new
        self._hold(rows, timer_values.getCurrentWatermarkInMs())

    def _hold(self, rows: pd.DataFrame, watermark_ms: int) -> None:
        rows = rows[(rows["last_us"] + self.keep_us) // 1000 + 1 > watermark_ms]
        self.keep(rows, rows["last_us"].max() + self.keep_us if len(rows) else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            self._hold(self.held(()), timerValues.getCurrentWatermarkInMs())
        return iter([])
