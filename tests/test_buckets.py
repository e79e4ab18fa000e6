"""Stream operators that deal keys into buckets, called without a stream."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidewatch.streaming import counters, stateful, windows
from tidewatch.streaming.buckets import Line, ordered, packed, unpacked

S = 1_000_000


class Handle:
    """A bucket's state and timers, as the operators use them."""

    def __init__(self):
        self.value, self.items, self.timers, self.calls = None, [], [], 0

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(self.items)

    def update(self, value):
        self.calls += 1
        self.value = value

    def appendValue(self, value):
        self.calls += 1
        self.items.append(value)

    def clear(self):
        self.value, self.items = None, []

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def run(processor, batches, key=(0,)):
    """The rows made of (rows, watermark in us) after each other, and the handle."""
    handle, made = Handle(), []
    processor.init(handle)
    for rows, watermark in batches:
        if rows is not None:
            made += processor.handleInputRows(key, iter([rows]), Clock(watermark // 1000))
        while handle.timers and min(handle.timers) <= watermark // 1000:
            handle.timers.remove(min(handle.timers))
            made += processor.handleExpiredTimer(key, Clock(watermark // 1000), None)
    return (pd.concat(made, ignore_index=True) if made else pd.DataFrame()), handle


def packets(keys, times, size=10):
    return pd.DataFrame({
        "a_ip": keys, "a_port": 1, "b_ip": "8.8.8.8", "b_port": 53, "protocol": 17, "ts_us": times, "src_ip": keys, "dst_ip": "8.8.8.8",
        "local_ip": keys, "length": size,
    })


NAMES = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]


def test_a_bucket_of_many_keys_takes_one_call_of_its_state():
    keys = [f"10.0.{k // 250}.{k % 250}" for k in range(5000)]
    made, handle = run(stateful.NewFlows(NAMES), [(packets(keys * 2, [k * S for k in range(10000)]), 0)])
    assert len(made) == 10000 and handle.calls == 1 and len(handle.timers) == 1


def test_new_flows_over_batches_and_keys_without_value():
    rows = packets(["a", None, "a", "b", None], [1 * S, 2 * S, 5 * S, 3 * S, 7 * S])
    more = packets(["a", "b", None], [10 * S, 9 * S, 11 * S])
    made, _ = run(stateful.NewFlows(NAMES), [(rows, 0), (more, 0)])
    told = sorted((r.a_ip or "", r.first_us) for r in made.itertuples())
    assert told == [("", 2 * S), ("", 7 * S), ("a", 1 * S), ("a", 10 * S), ("b", 3 * S), ("b", 9 * S)]


def test_silent_keys_are_forgotten_with_one_timer():
    _, handle = run(stateful.NewFlows(NAMES), [(packets(["a", "b"], [1 * S, 50 * S]), 0), (packets(["c"], [60 * S]), 58 * S)])
    assert list(unpacked(handle.value[0]).to_pandas()["a_ip"]) == ["c"]
    _, handle = run(stateful.NewFlows(NAMES), [(packets(["a", "b"], [1 * S, 50 * S]), 0), (None, 70 * S)])
    assert handle.value is None and not handle.timers


def plain_evaluations(times, until):
    """All evaluations of one key's packets (time, size), as stated."""
    runs = []
    for t, size in times:
        if runs and t - runs[-1][-1][0] < 5 * S:
            runs[-1].append((t, size))
        else:
            runs.append([(t, size)])
    told = []
    for run_ in runs:
        first, last = run_[0][0], run_[-1][0]
        for at in range(first + S, min(until, last + 5 * S) + 1, S):
            seen = [x for x in run_ if x[0] <= at]
            told.append((first, at, len(seen), sum(x[1] for x in seen)))
    return told


def test_reevaluations_of_many_keys_over_batches():
    rng = np.random.default_rng(5)
    line = {f"k{k}": [(int(t), int(s)) for t, s in zip(np.cumsum(rng.integers(100_000, 6 * S, 40)) + 100 * S, rng.integers(1, 99, 40))] for k in range(9)}
    flat = sorted((t, k, s) for k, own in line.items() for t, s in own)
    parts = [flat[i * 60 : i * 60 + 60] for i in range(6)]
    batches = [(packets([k for _, k, _ in p], [t for t, _, _ in p], [s for _, _, s in p]), p[0][0] - S) for p in parts]
    made, handle = run(stateful.Reevaluations(NAMES), [*batches, (None, 10**9)])
    got = sorted((r.a_ip, r.first_us, r.eval_us, r.packet_count, r.byte_count) for r in made.itertuples())
    assert got == sorted((k, *x) for k, own in line.items() for x in plain_evaluations(own, 10**12))
    assert handle.value is None and not handle.timers


def test_running_counts_of_many_keys_over_batches():
    rng = np.random.default_rng(6)
    rows = sorted((int(t), f"f{i:03d}", int(p), bool(d)) for i, (t, p, d) in enumerate(zip(rng.integers(0, 600 * S, 300) // S * S, rng.integers(0, 12, 300), rng.integers(0, 2, 300))))
    frame = lambda part: pd.DataFrame(part, columns=["ts_us", "flow_id", "pid", "is_dns"]).assign(remote_ip="r")
    made, _ = run(stateful.RunningCounts(["pid", "remote_ip"]), [(frame(rows[i : i + 100]).sample(frac=1, random_state=i), rows[i][0] - S) for i in (0, 100, 200)])
    want, state = {}, {}
    for t, i, p, d in rows:
        last, n, dns = state.get(p, (None, 0, 0))
        n, dns = (0, 0) if last is None or t - last > 60 * S else (n, dns)
        state[p] = (t, n + 1, dns + d)
        want[i] = (n + 1, dns + d)
    assert {r.flow_id: (r.scan_count, r.dns_count) for r in made.itertuples()} == want


def test_rows_without_time_come_last_and_start_nothing():
    rows = packets(["a", "a", "b"], [None, 1 * S, None])
    line = Line(pd.DataFrame({c: pd.Series(dtype="int64") for c in [*NAMES, "last_us"]}), rows, NAMES)
    assert list(line.rows["a_ip"]) == ["a", "a", "b"] and line.last().tolist()[0] == S and line.gap().tolist() == [0, 0, 0]


def test_ties_are_ordered_by_id():
    code, ts = np.array([0, 1, 0, 0, 1]), np.array([5, 3, 5, 1, 3])
    assert ordered(code, ts, pd.Series(["b", "z", "a", "c", "y"])).tolist() == [3, 2, 0, 4, 1]


def test_counters_hold_rows_packed():
    n = 120_000
    rows = pd.DataFrame({
        "key": [f"{k % 700}" for k in range(n)], "ts_us": np.arange(n) * 1000, "event": np.arange(n) % 2 == 0, "scans": 1, "dns": 0,
        "remote": [f"10.0.0.{k % 90}" if k % 2 == 0 else None for k in range(n)], "flow_id": [None if k % 2 == 0 else f"f{k}" for k in range(n)], "side": None,
    })
    made, handle = run(counters.Counters(), [(rows, 0)], (counters.SPREAD,))
    assert not len(made) and len(handle.items) == 3 and sum(len(x[0]) for x in handle.items) < 20 * n
    made, handle = run(counters.Counters(), [(rows, 0), (None, 10**9)], (counters.SPREAD,))
    assert sorted(made["flow_id"]) == sorted(rows["flow_id"].dropna())
    own = rows[rows["key"] == "1"]
    at = int(own["ts_us"].max())
    seen = rows[rows["event"] & (rows["key"] == "1") & (rows["ts_us"] <= at) & (rows["ts_us"] >= at - 10 * S)]
    told = made[made["flow_id"] == f"f{at // 1000}"].iloc[0]
    assert (told["distinct_ips"], told["pid_connections"]) == (seen["remote"].nunique(), len(seen))


def test_packed_tables_come_back():
    rows = pa.table({"a": [1, None], "b": ["x", None]})
    assert unpacked(packed(rows)).equals(rows)


def test_sliding_diversity_tells_each_window_once_and_leaves_out_what_is_late():
    rows = pd.DataFrame({"pid": [1, 1, 1, 2], "remote_ip": ["a", "b", "a", "c"], "ts_us": [int(0.2 * S), int(0.9 * S), 4 * S, 3 * S]})
    late = pd.DataFrame({"pid": [1, 1], "remote_ip": ["z", "a"], "ts_us": [2 * S, 30 * S]})
    made, handle = run(windows.Sliding(["pid"], 10 * S, S), [(rows, 5 * S), (late, 6 * S), (None, 100 * S)])
    got = {(r.pid, r.window_end_us // S): (r.distinct_ips, r.pid_connections) for r in made.itertuples()}
    assert len(got) == len(made)
    want = {}
    events = [(1, "a", 0.2), (1, "b", 0.9), (1, "a", 4), (2, "c", 3), (1, "z", 2), (1, "a", 30)]
    for end in range(1, 41):
        for pid in (1, 2):
            inside = [r for p, r, t in events if p == pid and end - 10 <= t < end and not (r == "z" and end <= 5)]
            if inside:
                want[pid, end] = (len(set(inside)), len(inside))
    assert got == want and not len(unpacked(handle.value[1])) and not handle.timers


@pytest.mark.parametrize("end", [0, 1])
def test_sliding_diversity_over_batches(end):
    rng = np.random.default_rng(7 + end)
    rows = pd.DataFrame({"pid": rng.integers(0, 5, 400), "remote_ip": [f"r{x}" for x in rng.integers(0, 8, 400)], "ts_us": np.sort(rng.integers(0, 90 * S, 400))})
    parts = [rows.iloc[i : i + 100] for i in range(0, 400, 100)]
    made, _ = run(windows.Sliding(["pid"], 10 * S, S), [*[(p, int(p["ts_us"].min()) - end * S) for p in parts], (None, 10**9)])
    wide = pd.concat([rows.assign(window_end_us=(rows["ts_us"] // S + k) * S) for k in range(1, 11)]).groupby(["pid", "window_end_us"])
    want = pd.DataFrame({"d": wide["remote_ip"].nunique(), "n": wide.size()}).reset_index()
    assert sorted(map(tuple, made[["pid", "window_end_us", "distinct_ips", "pid_connections"]].to_numpy())) == sorted(map(tuple, want.to_numpy()))
