"""Streaming operators with their own keyed state.

State per key is a few numbers, so it does not grow with the stream. They need
the RocksDB state store (``session.STATE_STORE``). Rows of one key in a
micro-batch are handled in time order; the size of a micro-batch bounds them.
Where keys are many, they are dealt into buckets (``buckets``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.times import SECOND_US, with_ts_us
from tidewatch.operators import crossflow as cf
from tidewatch.operators.flows import IDLE_US, REEVALUATE_US, with_flow_key
from tidewatch.plans.versions import shared_owner
from tidewatch.schema import FLOW_KEY
from tidewatch.streaming.buckets import BUCKETS, NEVER, NEVER_AGAIN, Bucketed, Line, Recent, bucket

_KEY_TYPES = "a_ip string, a_port int, b_ip string, b_port int, protocol int"


def _flow_key(packets: DataFrame) -> tuple[list[str], str]:
    """Key columns of a flow, and their types; packets of several hosts have theirs as a part of it."""
    host = shared_owner(packets)
    return [*FLOW_KEY, *host], _KEY_TYPES + ", host string" * len(host)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(batches))
    return rows.sort_values(["ts_us", "flow_id"] if "flow_id" in rows else ["ts_us"], kind="stable")


class _Stateful(StatefulProcessor):
    """One value state; keys fall silent and are dropped by an event timer."""

    state_schema = ""
    keep_us = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def _remember(self, last_us: int, *values) -> None:
        self.state.update(values)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last_us + self.keep_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class NewFlows(Recent):
    keep_us = IDLE_US

    def __init__(self, names: list[str]):
        self.names = names

    def handleInputRows(self, key, rows, timerValues):
        rows, held = pd.concat(list(rows)), self.held([*self.names, "last_us"])
        line = Line(held, rows, self.names)
        fresh = (line.latest == NEVER) | (line.gap() >= IDLE_US)
        self.remember(held, line, {}, self.names, timerValues)
        out = line.rows.loc[fresh, [*self.names, "ts_us", "src_ip", "dst_ip", "local_ip"]]
        if len(out):
            yield out.rename(columns={"ts_us": "first_us"})


def _keyed(packets: DataFrame, delay: str, columns: list[str]) -> DataFrame:
    names = _flow_key(packets)[0]
    rows = with_flow_key(with_ts_us(packets)).withWatermark("ts", delay)
    return rows.select("ts", "ts_us", *names, *columns, bucket(names, BUCKETS)).groupBy("bucket")


def stream_connections(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """A row as soon as a flow's first packet arrives."""
    names, types = _flow_key(packets)
    return _keyed(packets, delay, ["src_ip", "dst_ip", "local_ip"]).transformWithStateInPandas(
        statefulProcessor=NewFlows(names), outputMode="append", timeMode="eventTime",
        outputStructType=f"{types}, first_us long, src_ip string, dst_ip string, local_ip string",
    )


_FLOW = ["first_us", "last_us", "packets", "bytes", "next_us"]


class Reevaluations(Bucketed):
    """Statistics of active flows at every whole interval after their start."""

    def __init__(self, names: list[str]):
        self.names = names

    def _told(self, flows: pd.DataFrame, until: np.ndarray, own: np.ndarray, ts: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        """The evaluations of ``flows`` before ``until``, and up to their end; moves each on to its next one.

        ``own`` numbers the flow of each packet, in the order of flow and time.
        An evaluation sees the packets up to its own time.
        """
        upcoming = flows["next_us"].to_numpy("int64")
        span = np.minimum(until, flows["last_us"].to_numpy("int64") + IDLE_US + 1) - upcoming
        n = np.maximum(-(-span // REEVALUATE_US), 0)
        flow = np.repeat(np.arange(len(flows)), n)
        at = upcoming[flow] + (np.arange(len(flow)) - np.repeat(np.cumsum(n) - n, n)) * REEVALUATE_US
        packets = np.searchsorted(own, np.arange(len(flows)))  # those before each flow's first
        sums = np.concatenate([[0], np.cumsum(size)])
        # Packets and evaluations in one order: equal times count packets first.
        order = np.lexsort((np.repeat([0, 1], [len(ts), len(at)]), np.concatenate([ts, at]), np.concatenate([own, flow])))
        asked = order >= len(ts)
        seen = np.zeros(len(at), "int64")
        seen[order[asked] - len(ts)] = np.cumsum(~asked)[asked]
        told = flows[[*self.names, "first_us"]].iloc[flow].assign(
            eval_us=at, packet_count=flows["packets"].to_numpy("int64")[flow] + seen - packets[flow],
            byte_count=flows["bytes"].to_numpy("int64")[flow] + sums[seen] - sums[packets[flow]])
        flows["next_us"] = upcoming + n * REEVALUATE_US
        return told

    def handleInputRows(self, key, rows, timerValues):
        rows, held = pd.concat(list(rows)).dropna(subset=["ts_us"]), self.held([*self.names, *_FLOW])
        if not len(rows):
            return
        line = Line(held, rows, self.names)
        ts, size = line.ts, line.rows["length"].fillna(0).to_numpy("int64")
        fresh = (line.latest == NEVER) | (line.gap() >= IDLE_US)
        # A stretch of packets goes on with the flow of the state, or is a new one.
        starts = np.flatnonzero(fresh | line.first)
        own = np.cumsum(fresh | line.first) - 1
        end = np.append(starts[1:], len(ts)) - 1
        known = ~fresh[starts]
        flows = line.rows[self.names].iloc[starts].reset_index(drop=True)
        for name, value in (("first_us", ts[starts]), ("last_us", ts[starts]), ("packets", 0), ("bytes", 0), ("next_us", ts[starts] + REEVALUATE_US)):
            flows[name] = np.where(known, np.append(held[name].to_numpy("int64"), 0)[line.place[starts]], value)
        flows["last_us"] = np.maximum(flows["last_us"].to_numpy("int64"), ts[end])
        ended = ~line.end[end]
        yield self._told(flows, np.where(ended, NEVER_AGAIN, ts[end]), own, ts, size)
        sums = np.concatenate([[0], np.cumsum(size)])
        flows["packets"] += end + 1 - starts
        flows["bytes"] += sums[end + 1] - sums[starts]
        # Flows of the state that a new one of their key has ended.
        over = held.iloc[line.place[starts[fresh[starts] & line.first[starts] & (line.place[starts] >= 0)]]].reset_index(drop=True)
        if len(over):
            yield self._rest(over, NEVER_AGAIN)
        self._wait(pd.concat([held[line.silent], flows[~ended]], ignore_index=True) if line.silent.any() else flows[~ended])

    def _rest(self, flows: pd.DataFrame, until: int) -> pd.DataFrame:
        nothing = np.zeros(0, "int64")
        return self._told(flows, np.full(len(flows), until), nothing, nothing, nothing)

    def _wait(self, flows: pd.DataFrame) -> None:
        self.keep(flows, flows["next_us"].min() if len(flows) else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        flows = self.held(())
        # Nothing older than the watermark will arrive.
        told = self._rest(flows, timerValues.getCurrentWatermarkInMs() * 1000)
        self._wait(flows[flows["next_us"] <= flows["last_us"] + IDLE_US])
        yield told


def stream_reevaluate(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Rows of ``flows.reevaluate`` as the watermark passes them."""
    names, types = _flow_key(packets)
    return _keyed(packets, delay, ["length"]).transformWithStateInPandas(
        statefulProcessor=Reevaluations(names), outputMode="append", timeMode="eventTime",
        outputStructType=f"{types}, first_us long, eval_us long, packet_count long, byte_count long",
    )


class RunningCounts(Recent):
    keep_us = cf.WINDOW_S * SECOND_US

    def __init__(self, names: list[str]):
        self.names = names

    def handleInputRows(self, key, rows, timerValues):
        rows, held = pd.concat(list(rows)), self.held([*self.names, "last_us", "scans", "dns"])
        line = Line(held, rows, self.names, "flow_id")
        fresh = (line.latest == NEVER) | (line.gap() > self.keep_us)
        at = np.arange(len(line.ts))
        # Counts go on from the last fresh start, or from the state before the first.
        begin = np.maximum.accumulate(np.where(fresh | line.first, at, 0))
        before = np.where(fresh[begin], -1, line.place)
        sums = np.concatenate([[0], np.cumsum(line.rows["is_dns"].fillna(False).to_numpy().astype("int64"))])
        scans, dns = (np.append(held[c].to_numpy("int64"), 0)[before] for c in ("scans", "dns"))
        n, d = at - begin + 1 + scans, sums[1:] - sums[begin] + dns
        self.remember(held, line, {"scans": n, "dns": d}, self.names, timerValues)
        yield pd.DataFrame({"flow_id": line.rows["flow_id"].to_numpy(), "scan_count": n, "dns_count": d})


def stream_running_counts(connections: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Every connection with the session counts it produced."""
    host = shared_owner(connections)
    names = [*host, "pid", "remote_ip"]
    rows = connections.withWatermark("ts", delay).select(
        "ts", "ts_us", "flow_id", *host, F.coalesce("pid", F.lit(0)).alias("pid"), "remote_ip",
        ((F.col("protocol") == 17) & (F.col("remote_port") == 53)).alias("is_dns"),
    )
    return rows.withColumn("bucket", bucket(names, BUCKETS)).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=RunningCounts(names), outputMode="append", timeMode="eventTime",
        outputStructType="flow_id string, scan_count long, dns_count long",
    )


class Beacons(_Stateful):
    """The arrival times of an endpoint within the window, which alone bounds them."""

    state_schema = "times array<long>"
    keep_us = cf.WINDOW_S * SECOND_US

    def handleInputRows(self, key, rows, timerValues):
        before = np.array(self.state.get()[0] if self.state.exists() else [], "int64")
        rows = _in_order(rows)
        times = np.concatenate([before, rows["ts_us"].to_numpy().astype("int64")])
        first = np.searchsorted(times, times - self.keep_us)[len(before):]
        at = np.arange(len(before), len(times))
        n = at - first + 1
        total = times[at] - times[first]
        gaps = np.diff(times, prepend=times[:1])
        squares = np.cumsum(np.where(gaps <= self.keep_us, gaps, 0) ** 2)  # longer gaps are inside no window
        spread = (squares[at] - squares[first]).astype(float)
        known = (n > 1) & (total > 0)
        whole = np.where(known, total, 1).astype(float)
        cv = np.sqrt(np.maximum((n - 1) * spread / whole**2 - 1.0, 0.0))
        self._remember(int(times[-1]), [int(t) for t in times[first[-1]:]])
        yield pd.DataFrame({
            "flow_id": rows["flow_id"].to_numpy(), "beacon_n": n,
            "beacon_mean_s": np.where(known, whole / np.maximum(n - 1, 1) / 1e6, np.nan), "beacon_cv": np.where(known, cv, np.nan),
        }).astype({"beacon_mean_s": "Float64", "beacon_cv": "Float64"})


def stream_beacon(connections: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Every connection with its endpoint's regularity in the last minute."""
    host = shared_owner(connections)
    rows = connections.withWatermark("ts", delay).select("ts", "ts_us", "flow_id", *host, "remote_ip", "remote_port", "protocol")
    return rows.groupBy(*host, "remote_ip", "remote_port", "protocol").transformWithStateInPandas(
        statefulProcessor=Beacons(), outputMode="append", timeMode="eventTime",
        outputStructType="flow_id string, beacon_n long, beacon_mean_s double, beacon_cv double",
    )


class Cooldown(_Stateful):
    state_schema = "until_us long"

    def handleInputRows(self, key, rows, timerValues):
        rows = _in_order(rows)
        ts, until = rows["ts_us"].to_numpy().astype("int64"), rows["ts_us"].to_numpy().astype("int64") + rows["ttl_ms"].to_numpy().astype("int64") * 1000
        free = self.state.get()[0] if self.state.exists() else NEVER
        # From one accepted row straight to the first that is free again.
        taken, row = [], int(np.searchsorted(ts, free))
        while row < len(ts):
            taken.append(row)
            free = int(until[row])
            row = max(row + 1, int(np.searchsorted(ts, free)))
        self._remember(free, free)
        yield pd.DataFrame({"flow_id": rows["flow_id"].to_numpy()[taken], "remote_ip": key[0], "ts_us": ts[taken], "until_us": until[taken]})


def stream_cooldown(blocks: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Block decisions that are carried out; state lives as long as a block."""
    rows = blocks.withWatermark("ts", delay).select("ts", "ts_us", "flow_id", "remote_ip", "ttl_ms")
    return rows.groupBy("remote_ip").transformWithStateInPandas(
        statefulProcessor=Cooldown(), outputMode="append", timeMode="eventTime",
        outputStructType="flow_id string, remote_ip string, ts_us long, until_us long",
    )
