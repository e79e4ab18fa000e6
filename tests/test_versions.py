"""Sets that change in time, per host, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import crossflow, decide, enrich, topology
from tidewatch.plans import versions

S = 1_000_000


def plain_intervals(rows, times):
    """rows: (host, ip, ts); times: (host, ts). Walks the snapshots of each host in order."""
    found = []
    for host in {h for h, _ in times}:
        order = sorted({t for h, t in times if h == host})
        for ip in {i for h, i, _ in rows if h == host}:
            held = {t for h, i, t in rows if (h, i) == (host, ip)}
            since = None
            for t in order:
                if t in held and since is None:
                    since = t
                if t not in held and since is not None:
                    found.append((host, ip, since, t))
                    since = None
            if since is not None:
                found.append((host, ip, since, None))
    return sorted(found, key=str)


@pytest.fixture(scope="module")
def history():
    rng = random.Random(4)
    times = [(h, t * S) for h in ("h1", "h2", "h3") for t in rng.sample(range(200_000), 40)]
    rows = [(h, ip, t) for h, t in times for ip in ("1.1.1.1", "2.2.2.2", "3.3.3.3") if rng.random() < 0.6]
    return rows + rows[:20], times


def test_intervals(spark, history):
    rows, times = history
    snapshots = spark.createDataFrame([*rows, ("h1", None, 0), (None, "1.1.1.1", 0), ("h1", "1.1.1.1", None)], "host string, ip string, ts_us long")
    taken = spark.createDataFrame(times, "host string, ts_us long")
    found = versions.intervals(snapshots, ["host"], ["ip"], times=taken)
    assert sorted(map(tuple, found.collect()), key=str) == plain_intervals(rows, times)
    assert versions.intervals(snapshots.limit(0), ["host"], ["ip"]).count() == 0


def test_intervals_without_owner(spark, history):
    rows = [("one", ip, t) for h, ip, t in history[0] if h == "h1"]
    times = [("one", t) for h, t in history[1] if h == "h1"]
    found = versions.intervals(spark.createDataFrame([r[1:] for r in rows], "ip string, ts_us long"), [], ["ip"], times=spark.createDataFrame([(t,) for _, t in times], "ts_us long"))
    assert sorted((("one", *r) for r in found.collect()), key=str) == plain_intervals(rows, times)


@pytest.mark.parametrize("width", [S, 10_000 * S, versions.SLOT_US])
def test_members_at_the_time_of_a_row(spark, history, width):
    rows, times = history
    sets = plain_intervals(rows, times)
    rng = random.Random(7)
    edges = [t for _, _, low, high in sets for t in (low, low - 1, high, high and high - 1) if t is not None]
    asked = [(k, rng.choice(["h1", "h2", "h4", None]), rng.choice(["1.1.1.1", "3.3.3.3", "9.9.9.9", None]), rng.choice([rng.randrange(-S, 300_000 * S), rng.choice(edges), None])) for k in range(600)]
    left = spark.createDataFrame(asked, "k int, host string, remote string, at long")
    right = spark.createDataFrame(sets, "host string, ip string, valid_from long, valid_to long")
    on = {"host": "host", "remote": "ip"}

    def since(host, ip, at):
        return next((low for h, i, low, high in sets if None not in (host, ip, at) and (h, i) == (host, ip) and low <= at and (high is None or at < high)), None)

    low = min(t for *_, t in asked if t is not None)
    for span in (None, (low, 400_000 * S)):
        found = versions.in_force(left, right, on, "at", {"since": "valid_from"}, width if width > S else 3_000 * S, span)
        assert {r["k"]: r["since"] for r in found.collect()} == {k: since(*x) for k, *x in asked} and found.count() == len(asked)
        kept = versions.not_in_force(left, right, on, "at", 3_000 * S, span)
        assert {r["k"] for r in kept.collect()} == {k for k, *x in asked if since(*x) is None}


def test_pid_of_equal_ports_on_two_hosts(spark):
    snapshots = [
        ("a", 10 * S, 5000, 6, 7), ("b", 10 * S, 5000, 6, 70), ("a", 20 * S, 5000, 6, 8), ("b", 20 * S, 1, 6, 1),
        ("a", 30 * S, 1, 6, 1), ("b", 30 * S, 5000, 6, 71), ("b", 30 * S, 5000, 6, 72),
    ]
    held = spark.createDataFrame(snapshots, "host string, snapshot_us long, port int, protocol int, pid long")
    asked = [("a", 9, None), ("a", 10, 7), ("a", 19, 7), ("a", 20, 8), ("a", 31, None), ("b", 15, 70), ("b", 25, None), ("b", 99, 72), ("c", 15, None)]
    flows = spark.createDataFrame([(k, h, t * S, 5000, 6) for k, (h, t, _) in enumerate(asked)], "k int, host string, first_us long, local_port int, protocol int")
    found = {r["k"]: (r["pid"], r["local_port"]) for r in enrich.asof_pid(flows, held).collect()}
    assert found == {k: (pid, 5000 if pid else 0) for k, (_, _, pid) in enumerate(asked)}


def test_process_of_equal_pids_on_two_hosts(spark):
    rows = spark.createDataFrame([("a", 7, 0, 50, "/bin/a1"), ("a", 7, 60, None, "/bin/a2"), ("b", 7, 0, None, "/bin/b")], "host string, pid long, start_us long, end_us long, path string")
    flows = spark.createDataFrame([(0, "a", 7, 10), (1, "b", 7, 10), (2, "a", 7, 55), (3, "a", 7, 61), (4, "c", 7, 10)], "k int, host string, pid long, first_us long")
    assert {r["k"]: r["process_path"] for r in enrich.interval_process(flows, rows).collect()} == {0: "/bin/a1", 1: "/bin/b", 2: None, 3: "/bin/a2", 4: None}


ROUTE = "host string, ts_us long, route_order int, dst string, gateway string, iface string, is_up boolean, is_gateway boolean"
INTERFACE = "host string, ts_us long, iface string, ip string, mask string, is_loopback boolean"


@pytest.fixture(scope="module")
def topology_tables(spark):
    routes = [
        ("a", 0, 0, "0.0.0.0", "9.9.9.1", "en0", True, True), ("a", 100 * S, 0, "0.0.0.0", "9.9.9.2", "en0", True, True),
        ("a", 200 * S, 0, "0.0.0.0", None, "en0", True, True), ("a", 200 * S, 1, "172.16.0.0", "9.9.9.7", "utun1", True, False),
        ("a", 300 * S, 0, "0.0.0.0", "9.9.9.1", "en0", True, True), ("b", 0, 0, "0.0.0.0", "9.9.9.5", "en0", True, True),
    ]
    interfaces = [("a", 0, "en0", "10.0.0.2", "255.255.255.0", False), ("a", 200 * S, "utun1", "9.9.9.8", "255.255.255.255", False), ("b", 0, "en0", "10.0.0.2", "255.255.255.0", False)]
    return spark.createDataFrame(interfaces, INTERFACE), spark.createDataFrame(routes, ROUTE)


def test_versions_of_own_addresses_gateway_and_peers(topology_tables):
    interfaces, routes = topology_tables
    own = {tuple(r) for r in topology.own_versions(interfaces).collect()}
    assert ("a", "10.0.0.2", 0, 200 * S) in own and ("a", "9.9.9.8", 200 * S, None) in own and ("b", "10.0.0.255", 0, None) in own
    gateways = {tuple(r) for r in topology.gateway_versions(routes).collect()}
    # The tunnel's gateway stands in where no route is flagged.
    assert gateways == {("a", "9.9.9.1", 0, 100 * S), ("a", "9.9.9.2", 100 * S, 200 * S), ("a", "9.9.9.7", 200 * S, 300 * S), ("a", "9.9.9.1", 300 * S, None), ("b", "9.9.9.5", 0, None)}
    peers = {tuple(r) for r in topology.peer_versions(routes, topology.own_versions(interfaces)).collect()}
    assert peers == {("a", "9.9.9.7", 200 * S, 300 * S)}


def test_a_missing_gateway_keeps_the_last(spark):
    rows = [("a", t * S, 0, "0.0.0.0", g, "en0", True, True) for t, g in ((0, "9.9.9.1"), (10, None), (20, "9.9.9.1"), (30, None), (40, "9.9.9.2"), (50, None))]
    found = {tuple(r) for r in topology.gateway_versions(spark.createDataFrame(rows, ROUTE)).collect()}
    assert found == {("a", "9.9.9.1", 0, 40 * S), ("a", "9.9.9.2", 40 * S, None)}


def test_gateway_change_alters_counts(spark, topology_tables):
    interfaces, routes = topology_tables
    rows = [(f"{h}{k}", h, k * S, k * S + 5 * S, 7, "9.9.9.1", 6, 443, "9.9.9.1", 443, "10.0.0.2", 1000 + k) for h in "ab" for k in range(0, 400, 2)]
    flows = spark.createDataFrame(rows, "flow_id string, host string, first_us long, eval_us long, pid long, remote_ip string, protocol int, remote_port int, a_ip string, a_port int, b_ip string, b_port int")
    excluded = topology.exclusion_versions(interfaces, routes)
    events = crossflow.connections(flows, excluded)
    # While 9.9.9.1 was the gateway of host a (up to 100 s and from 300 s on), its connections don't count there.
    counted = {h: sorted(r["ts_us"] // S for r in events.filter(F.col("host") == h).collect()) for h in "ab"}
    assert counted["a"] == list(range(100, 300, 2)) and counted["b"] == list(range(0, 400, 2))
    found = {r["flow_id"]: r for r in crossflow.crossflow_lookup(flows, events, excluded).collect()}
    assert found["b398"]["scan_a"] == 200 and found["a398"]["scan_a"] == 0 and found["a200"]["scan_a"] == 53
    assert found["a398"]["beacon_a"] is None and found["b398"]["beacon_a"]["beacon_n"] == 28
    # A listed address counts on no host.
    listed = spark.createDataFrame([("9.9.9.1",)], "ip string")
    assert crossflow.connections(flows, [excluded, listed]).count() == 0


def test_counters_are_a_hosts_own(spark):
    rows = [(f"{h}{k}", h, k * S, k * S + 5 * S, 7, f"9.9.9.{k % 5 + 1}", 6, 443, f"9.9.9.{k % 5 + 1}", 443, "10.0.0.2", 1000 + k) for h in "ab" for k in range(10)]
    flows = spark.createDataFrame(rows, "flow_id string, host string, first_us long, eval_us long, pid long, remote_ip string, protocol int, remote_port int, a_ip string, a_port int, b_ip string, b_port int")
    found = {r["flow_id"]: r for r in crossflow.crossflow_lookup(flows, crossflow.connections(flows)).collect()}
    assert found["a9"]["scan_a"] == 2 and found["a9"]["diversity"]["distinct_ips"] == 5
    merged = flows.drop("host")
    found = {r["flow_id"]: r for r in crossflow.crossflow_lookup(merged, crossflow.connections(merged)).collect()}
    assert found["a9"]["scan_a"] == 4 and found["a9"]["beacon_a"]["beacon_n"] == 4


def test_guard_at_the_time_of_the_verdict(spark, topology_tables):
    interfaces, routes = topology_tables
    rows = [(0, "a", "9.9.9.1", 50), (1, "a", "9.9.9.1", 150), (2, "a", "9.9.9.8", 150), (3, "a", "9.9.9.8", 250), (4, "b", "9.9.9.1", 50), (5, "b", "224.0.0.1", 50)]
    verdicts = spark.createDataFrame([(k, h, ip, t * S) for k, h, ip, t in rows], "k int, host string, remote_ip string, eval_us long")
    found = decide.block_guard(verdicts, topology.own_versions(interfaces), topology.gateway_versions(routes))
    assert {r["k"]: r["skip_reason"] for r in found.collect()} == {
        0: "remote is default gateway", 1: None, 2: None, 3: "remote is own IP", 4: None, 5: "remote is broadcast/multicast"}
    with pytest.raises(ValueError):
        decide.block_guard(verdicts.drop("host"), topology.own_versions(interfaces))
