"""Cross-flow counters of finished flows, answered at their evaluation.

Connections and flows come as two streams. A connection is an event for three
keys: (pid, remote) for scans, (remote, port, protocol) for beacons, pid for
diversity; a flow asks at its evaluation about both of its ends and its pid.
Events and questions of a key wait in its state until the watermark has passed
them and are then taken in the order of time, so that a question sees exactly
the connections made before it, in whatever order they arrived. The answers
carry the flow's evaluation time on, and a second stateful operator, an
aggregation by flow, brings a flow's answers together and lets it go.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import ip as ips
from tidewatch.functions.times import SECOND_US
from tidewatch.operators import crossflow as cf
from tidewatch.plans.versions import shared_owner
from tidewatch.streaming.buckets import coded, packed, unpacked

SCAN, BEACON, SPREAD = "scan", "beacon", "spread"
_ANSWER = (
    "flow_id string, ts timestamp, family string, side string, scan_count long, dns_count long, beacon_n long, "
    "beacon_mean_s double, beacon_cv double, distinct_ips long, pid_connections long, at_cap boolean"
)


class Counters(StatefulProcessor):
    """State of a bucket of keys: rows that wait, and events whose window hasn't passed.

    New rows are appended unread, some ten thousands packed in one piece. When
    the watermark moves past the first that waits, all that are due are taken
    at once, in arrays over all keys, and what has left the window is dropped;
    a silent bucket is forgotten by its last timer. Of a scan's session the
    last event stays, with the session's counts as its weights.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for piece in _pieces(pa.Table.from_pandas(r[_NAMES], _ROWS, preserve_index=False) for r in rows):
            self.rows.appendValue((packed(piece),))
            least = pc.min(piece["ts_us"]).as_py()
            first = least if first is None or least is not None and least < first else first
        if first is None:  # no row has a time, and none will be due
            return iter([])
        at, timers = first // 1000 + 1, list(self.handle.listTimers())
        if not timers or at < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, family = timerValues.getCurrentWatermarkInMs() * 1000, key[0]
        width = (cf.DIVERSITY_S if family == SPREAD else cf.WINDOW_S) * SECOND_US
        held = pa.concat_tables([unpacked(bytes(r[0])) for r in self.rows.get()])
        held = held.filter(pc.is_valid(held["ts_us"])).unify_dictionaries().combine_chunks()
        ts = held["ts_us"].to_numpy()
        # One number orders all keys' rows: no window reaches from one key to another.
        base, span = int(ts.min()), int(ts.max() - ts.min()) + 2 * width + 1
        code = _codes(held["key"])
        at = code * span + (ts - base)
        event, due = held["event"].to_numpy(), ts <= now
        made = np.flatnonzero(due & event)
        made = made[np.argsort(at[made], kind="stable")]
        asked = np.flatnonzero(due & ~event)
        asked = asked[np.argsort(at[asked], kind="stable")]
        events = pd.DataFrame({"code": code[made], "at": at[made], "scans": held["scans"].to_numpy()[made], "dns": held["dns"].to_numpy()[made]})
        if family == SPREAD:
            events["remote"] = _codes(held["remote"])[made]
        low = np.maximum(at[asked] - width, code[asked] * span)
        answers = getattr(self, family)(events, low, at[asked], width)
        kept = ts[made] >= now - width
        if family == SCAN:
            kept &= ~events["code"].duplicated(keep="last").to_numpy()
        left = held.take(np.append(made[kept], np.flatnonzero(~due)))
        if family == SCAN:
            for name in ("scans", "dns"):
                counts = np.append(events[name].to_numpy()[kept], held[name].to_numpy()[~due])
                left = left.set_column(_NAMES.index(name), name, pa.array(counts))
        self._keep(left, now, width)
        for k in range(0, len(asked), PIECE):
            part = asked[k : k + PIECE]
            told = held.select(["flow_id", "side"]).take(part)
            yield pd.DataFrame({
                "flow_id": told["flow_id"].to_pandas(), "ts": pd.to_datetime(ts[part], unit="us"), "family": family, "side": told["side"].cast(pa.string()).to_pandas(),
            } | {c: answers[c][k : k + PIECE] if c in answers else pd.array([None] * len(part), t) for c, t in _EMPTY.items()})

    def _keep(self, rows: pa.Table, now: int, width: int) -> None:
        self.rows.clear()
        if not len(rows):
            return
        for piece in _pieces([rows]):
            self.rows.appendValue((packed(piece),))
        ts = rows["ts_us"].to_numpy()
        waiting = ts[ts > now]
        # The timer that has just expired is the only one.
        self.handle.registerTimer((int(waiting.min()) if len(waiting) else int(ts.max()) + width) // 1000 + 1)

    def scan(self, events: pd.DataFrame, low: np.ndarray, at: np.ndarray, width: int) -> dict:
        ts = events["at"].to_numpy()
        fresh = np.diff(ts, prepend=ts[:1] - width - 1) > width
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(ts)), 0))
        for name in ("scans", "dns"):
            sums = np.concatenate([[0], np.cumsum(events[name].to_numpy().astype("int64"))])
            events[name] = sums[1:] - sums[begin]
        last = np.searchsorted(ts, at, "right") - 1
        live = (last >= 0) & (np.append(ts, 0)[last] >= low)
        return {f"{c}_count": np.where(live, np.append(events[n].to_numpy(), 0)[last], 0) for c, n in (("scan", "scans"), ("dns", "dns"))}

    def beacon(self, events: pd.DataFrame, low: np.ndarray, at: np.ndarray, width: int) -> dict:
        ts = events["at"].to_numpy()
        first, end = np.searchsorted(ts, low), np.searchsorted(ts, at, "right")
        gaps = np.diff(ts, prepend=ts[:1])
        squares = np.append(np.cumsum(np.where(gaps <= width, gaps, 0) ** 2), 0)
        n, padded = end - first, np.append(ts, 0)
        known = (n > 1) & (padded[end - 1] > padded[first])
        total = np.where(known, padded[end - 1] - padded[first], 1).astype(float)
        spread = np.where(known, squares[end - 1] - squares[first], 0).astype(float)
        cv = np.sqrt(np.maximum((n - 1) * spread / (total * total) - 1.0, 0.0))
        told = {"beacon_mean_s": total / np.maximum(n - 1, 1) / 1e6, "beacon_cv": cv}
        return {"beacon_n": n} | {c: pd.arrays.FloatingArray(x, ~known) for c, x in told.items()}

    def spread(self, events: pd.DataFrame, low: np.ndarray, at: np.ndarray, width: int) -> dict:
        ts = events["at"].to_numpy()
        first, end = np.searchsorted(ts, low), np.searchsorted(ts, at, "right")
        # A remote counts in a window at its first connection there: the one whose predecessor is before the window.
        code = coded(events, ["code", "remote"])
        order = np.argsort(code, kind="stable")
        before = np.full(len(ts), -1)
        alike = code[order][1:] == code[order][:-1]
        before[order[1:][alike]] = order[:-1][alike]
        distinct = np.array([np.count_nonzero(before[a:b] < a) for a, b in zip(first, end)], "int64")
        return {"distinct_ips": distinct, "pid_connections": end - first, "at_cap": end - first >= cf.MAX_PID_ENTRIES}

    def close(self) -> None:
        pass


#: Rows packed, and answers handed on, at once.
PIECE = 50_000


def _pieces(tables: Iterable[pa.Table]) -> Iterator[pa.Table]:
    held, size = [], 0
    for table in tables:
        for k in range(0, len(table), PIECE):
            held.append(table.slice(k, PIECE))
            size += len(held[-1])
            if size >= PIECE:
                yield _dense(held)
                held, size = [], 0
    if held:
        yield _dense(held)


def _dense(tables: list[pa.Table]) -> pa.Table:
    """One piece, whose columns of few values have only those that occur."""
    rows = pa.concat_tables(tables)
    for i, name in enumerate(rows.column_names):
        if name in ("key", "remote", "side"):
            rows = rows.set_column(i, name, rows[name].cast(pa.string()).combine_chunks().dictionary_encode())
    return rows.combine_chunks()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """The number of each value; null is one."""
    return pc.fill_null(column.combine_chunks().indices, -1).to_numpy(zero_copy_only=False).astype("int64") + 1


_NAMES = ["key", "ts_us", "event", "scans", "dns", "remote", "flow_id", "side"]
_ROWS = pa.schema([
    ("key", pa.string()), ("ts_us", pa.int64()), ("event", pa.bool_()), ("scans", pa.int64()), ("dns", pa.int64()),
    ("remote", pa.string()), ("flow_id", pa.string()), ("side", pa.string()),
])
_EMPTY = {"scan_count": "Int64", "dns_count": "Int64", "beacon_n": "Int64", "beacon_mean_s": "Float64", "beacon_cv": "Float64", "distinct_ips": "Int64", "pid_connections": "Int64", "at_cap": "boolean"}


def _asked(family: str, host: list[str], parts: list[str], side: str | None = None, remote: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in [*host, *parts]])
    return F.struct(
        F.lit(family).alias("family"), key.alias("key"), F.lit(side).cast("string").alias("side"), (nothing if remote is None else remote).alias("remote"))


def stream_answers(
    flows: DataFrame, connections: DataFrame, buckets: int = 64, families: tuple[str, ...] = (SCAN, BEACON, SPREAD)
) -> DataFrame:
    """The answers to each flow: (flow_id, ts, family, side) and the family's counters.

    Both streams have watermarks on ``ts``. Keys are dealt into ``buckets``, as
    a call for each key costs far more than its work; a bucket's last minute
    must fit a task.
    """
    host = shared_owner(flows, connections)
    known = F.col("pid").isNotNull()
    made = {
        SCAN: _asked(SCAN, host, ["pid", "remote_ip"]), BEACON: _asked(BEACON, host, ["remote_ip", "remote_port", "protocol"]),
        SPREAD: F.when(known, _asked(SPREAD, host, ["pid"], None, F.col("remote_ip"))),
    }
    keys = F.array(*[made[f] for f in families])
    dns = (F.col("protocol") == 17) & (F.col("remote_port") == 53)
    events = connections.select(
        "ts", F.lit(True).alias("event"), F.when(dns, 1).otherwise(0).cast("bigint").alias("dns"), F.lit(None).cast("string").alias("flow_id"),
        F.explode(F.array_compact(keys)).alias("k"))

    ends = [
        F.when(~ips.is_infrastructure(f"{s}_ip"), _asked(kind, host, parts, s))
        for s in "ab" for kind, parts in ((SCAN, ["pid", f"{s}_ip"]), (BEACON, [f"{s}_ip", f"{s}_port", "protocol"]))
        if kind in families
    ]
    asked = F.array(*ends, *[F.when(known, _asked(SPREAD, host, ["pid"]))] * (SPREAD in families))
    probes = flows.select("ts", F.lit(False).alias("event"), F.lit(0).cast("bigint").alias("dns"), "flow_id", F.explode(F.array_compact(asked)).alias("k"))
    line = events.unionByName(probes).select(
        "ts", F.unix_micros("ts").alias("ts_us"), "event", F.lit(1).cast("bigint").alias("scans"), "dns", "flow_id", "k.*",
        F.pmod(F.xxhash64("k.key"), F.lit(buckets)).alias("bucket"))
    return line.groupBy("family", "bucket").transformWithStateInPandas(
        statefulProcessor=Counters(), outputStructType=_ANSWER, outputMode="append", timeMode="eventTime", eventTimeColumnName="ts")


def stream_diversity_at(flows: DataFrame, connections: DataFrame, delay: str = "10 seconds", buckets: int = 64) -> DataFrame:
    """``crossflow.pid_diversity`` at the evaluation of each flow of a known pid."""
    # No filter here: Spark would move it in front of the watermark, which flows without a pid move on too.
    found = stream_answers(flows.withWatermark("ts", delay), connections.withWatermark("ts", delay), buckets, (SPREAD,))
    return found.select("flow_id", F.unix_micros("ts").alias("ts_us"), "distinct_ips", "pid_connections", "at_cap")


def stream_crossflow_lookup(flows: DataFrame, connections: DataFrame, delay: str = "10 seconds", buckets: int = 64) -> DataFrame:
    """``crossflow.crossflow_lookup`` of a stream of finished flows.

    ``flows`` has ``ts`` at the evaluation (``eval_us``), ``connections`` (see
    ``crossflow.connections``) at the start of a flow; both streams get a
    watermark of ``delay`` behind them, and the slower one sets the pace.
    """
    timed = flows.withWatermark("ts", delay)
    answers = stream_answers(timed, connections.withWatermark("ts", delay), buckets)
    names = [c for c in flows.columns if c not in ("flow_id", "ts")]
    both = answers.unionByName(timed.select("flow_id", "ts", F.struct(*names).alias("_flow")), allowMissingColumns=True)

    def pick(family: str, side: str | None, *columns: str) -> Column:
        hit = F.col("family") == family
        return F.max(F.when(hit & (F.col("side") == side) if side else hit, F.struct(*columns)))

    beacon = ("beacon_n", "beacon_mean_s", "beacon_cv")
    found = both.groupBy("flow_id", "ts").agg(
        F.max("_flow").alias("_flow"), pick(SCAN, "a", "scan_count", "dns_count").alias("_sa"), pick(SCAN, "b", "scan_count", "dns_count").alias("_sb"),
        pick(BEACON, "a", *beacon).alias("beacon_a"), pick(BEACON, "b", *beacon).alias("beacon_b"),
        pick(SPREAD, None, "distinct_ips", "at_cap").alias("diversity"),
    )
    return cf.counted(found.select("flow_id", "ts", "_flow.*", "_sa", "_sb", "beacon_a", "beacon_b", "diversity"))


def stream_cross_flow(flows: DataFrame, connections: DataFrame, delay: str = "10 seconds", buckets: int = 64) -> DataFrame:
    """Flows with the cross-flow finding, once the watermark has passed their evaluation."""
    return cf.score_cross_flow(stream_crossflow_lookup(flows, connections, delay, buckets))
