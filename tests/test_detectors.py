import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import crossflow, decide, detectors, domains, registry
from tidewatch.operators.decide import Policy

S = 1_000_000
SCHEMA = ("flow_id string, a_ip string, a_port int, b_ip string, b_port int, protocol int, pid long, packet_count long, byte_count long, "
          "flow_age_us long, dns_name string, process_path string, reputation_score float, remote_ip string, remote_port int")
BASE = dict(flow_id="f", a_ip="10.0.0.1", a_port=50000, b_ip="93.184.216.34", b_port=443, protocol=6, pid=7, packet_count=10, byte_count=5000,
            flow_age_us=5 * S, dns_name=None, process_path="/usr/bin/x", reputation_score=None, remote_ip="93.184.216.34", remote_port=443)


def score(spark, fn, **change):
    df = spark.createDataFrame([tuple((BASE | change).values())], SCHEMA)
    prefix = {detectors.score_dns: "dns", detectors.score_process: "proc", detectors.score_flow_behavior: "behav",
              detectors.score_ip_reputation: "rep", detectors.score_dns_tunnel: "tunnel"}[fn]
    r = fn(df).collect()[0].asDict()
    return {k.removeprefix(prefix + "_"): v for k, v in r.items() if k.startswith(prefix + "_")}


def test_dns(spark):
    assert score(spark, detectors.score_dns)["score"] == 0
    assert score(spark, detectors.score_dns, dns_name="www.github.com")["score"] == 0
    hit = score(spark, detectors.score_dns, dns_name="x.malware.example.com")
    assert abs(hit["score"] - 1 / 7) < 1e-6 and hit["evidence"][0]["description"] == "Hostname matches blocklist"


def test_behavior(spark):
    fn = detectors.score_flow_behavior
    for change in (dict(packet_count=2000, byte_count=200_000, flow_age_us=S), dict(byte_count=5_000_000, flow_age_us=10 * S),
                   dict(packet_count=500, byte_count=5_000), dict(packet_count=200, flow_age_us=0)):
        assert score(spark, fn, **change)["score"] > 0
    assert score(spark, fn, packet_count=50, byte_count=25_000)["score"] == 0
    assert score(spark, fn, packet_count=0, byte_count=0)["score"] == 0
    big = dict(packet_count=10, byte_count=15_000)
    assert score(spark, fn, **big)["hits"] == 0 and score(spark, fn, remote_port=8080, **big)["hits"] == 1


def test_process_and_reputation(spark):
    assert score(spark, detectors.score_process, process_path="/tmp/malware.sh")["score"] > 0
    assert score(spark, detectors.score_process, process_path="/bin/bash")["score"] > 0
    for port in (53, 5353):
        assert score(spark, detectors.score_process, process_path=None, pid=None, protocol=17, b_port=port)["score"] == 0
    unknown = score(spark, detectors.score_process, process_path=None, pid=None)
    assert (unknown["score"], unknown["confidence"], unknown["severity"]) == (0.5, 0.5, "Medium")
    rep = detectors.score_ip_reputation
    listed = score(spark, rep, b_ip="45.33.32.156")
    assert listed["score"] > 0.5 and listed["severity"] == "High"
    private = score(spark, rep, b_ip="192.168.0.9")
    assert private["score"] == 0 and private["confidence"] > 0
    nobody = score(spark, rep, a_ip="93.184.216.1")
    assert nobody["score"] == 0 and nobody["confidence"] == 0


def test_tunnel(spark):
    fn = detectors.score_dns_tunnel
    assert score(spark, fn, protocol=17, remote_port=53, dns_name="www.example.com", packet_count=3, byte_count=300, flow_age_us=2 * S)["score"] == 0
    doh = score(spark, fn, protocol=17, remote_port=443)
    assert doh["score"] == 0 and "encrypted" in doh["evidence"][0]["description"]
    # 0.4 + 0.4 + 0.6 + 0.2 over 4 is just above 0.4 in single precision.
    label = "abcdefghijklmnopqrstuvwxyz0123456"
    edge = score(spark, fn, protocol=17, remote_port=53, dns_name="abcdefghijkl.example." + label, packet_count=110, byte_count=110 * 400, flow_age_us=10 * S)
    assert edge["hits"] == 4 and edge["severity"] == "High"


def test_domain_lists(spark):
    hosts = spark.createDataFrame([(h,) for h in ("malware.example.com", "foo.malware.example.com", "notmalware.example.com", "ec2-server.example.com", "C2.Evil.Com")], "dns_name string")
    entries = spark.createDataFrame([("malware.example.com",), ("c2",)], "entry string")
    got = {r.dns_name for r in domains.domain_match(hosts, entries).collect()}
    assert got == {"malware.example.com", "foo.malware.example.com", "C2.Evil.Com"}


def findings(spark, rows):
    return spark.createDataFrame([("f", i, f"d{i}", s, c, sev, st) for i, (s, c, sev, st) in enumerate(rows)],
                                 "flow_id string, ord int, detector_id string, score double, confidence double, severity string, status string")


@pytest.mark.parametrize("rows,policy,verdict,ttl", [
    ([(0.0, 1.0, "Low", "Completed")], Policy(), "Allow", None),
    ([(0.5, 0.8, "High", "Completed")], Policy(), "Alert", None),
    ([(0.5, 0.8, "High", "Completed")] * 2, Policy(), "Block", 900_000),
    ([(0.9, 0.95, "Critical", "Completed")], Policy(), "Block", 3_600_000),
    ([(0.9, 0.95, "Critical", "Errored")], Policy(), "Allow", None),
    ([(0.5, 0.8, "Low", "Completed")] * 2, Policy(min_ttl_s=120), "Block", 120_000),
    ([(0.5, 0.8, "Critical", "Completed")] * 2, Policy(max_ttl_s=600), "Block", 600_000),
])
def test_decisions(spark, rows, policy, verdict, ttl):
    row, = decide.decide_findings(findings(spark, rows), policy=policy).collect()
    assert (row.verdict, row.ttl_ms) == (verdict, ttl)


def connections(spark, rows):
    return spark.createDataFrame([(f"c{i:05d}", t, p, ip, port, proto) for i, (t, p, ip, port, proto) in enumerate(rows)],
                                 "flow_id string, ts_us long, pid long, remote_ip string, remote_port int, protocol int")


def test_cross_flow_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    t = 0
    for _ in range(700):
        t += rng.choice([0, 100_000, S, 5 * S, 60 * S, 60 * S + 1, 70 * S]) if rng.random() < 0.3 else rng.randrange(0, S)
        rows.append((t, rng.choice([1, 1, 1, 2, None]), rng.choice(["8.8.8.8", "9.9.9.9", "1.2.3.4"]), rng.choice([53, 443]), rng.choice([6, 17])))
    events = connections(spark, rows)
    # A narrow fixture makes every slice boundary matter.
    probes = events.select(F.col("flow_id"), "pid", F.col("remote_ip").alias("ip"), F.col("remote_port").alias("port"), "protocol", (F.col("ts_us") + 5 * S).alias("ts_us"))
    scans = {r.flow_id: (r.scan_count, r.dns_count) for r in crossflow.scan_counts(events, probes).collect()}
    beacons = {r.flow_id: r for r in crossflow.beacon_stats(events, probes).collect()}
    spread = {r.flow_id: (r.distinct_ips, r.pid_connections) for r in crossflow.pid_diversity(events, probes).collect()}
    for i, (t, pid, ip, port, proto) in enumerate(rows):
        at, name = t + 5 * S, f"c{i:05d}"
        last, n, dns = None, 0, 0
        for u, q, x, y, z in rows:
            if (q or 0) == (pid or 0) and x == ip and u <= at:
                if last is not None and u - last > 60 * S:
                    n = dns = 0
                n, dns, last = n + 1, dns + (z == 17 and y == 53), u
        assert scans[name] == (n, dns)
        times = [u for u, _, x, y, z in rows if (x, y, z) == (ip, port, proto) and at - 60 * S <= u <= at]
        assert beacons[name].beacon_n == len(times)
        gaps = [(b - a) / 1e6 for a, b in zip(times, times[1:])]
        if gaps and sum(gaps) > 0:
            mean = sum(gaps) / len(gaps)
            assert abs(beacons[name].beacon_mean_s - mean) < 1e-9
            assert abs(beacons[name].beacon_cv - statistics.pstdev(gaps) / mean) < 1e-6
        if pid is not None:
            near = [x for u, q, x, _, _ in rows if q == pid and at - 10 * S <= u <= at]
            assert spread[name] == (len(set(near)), len(near))


def test_cross_flow_tiers(spark):
    def tier(n, gap, cv):
        df = spark.createDataFrame([(n, gap, cv)], "beacon_n long, beacon_mean_s double, beacon_cv double").select(F.struct("*").alias("b"))
        r = df.select(crossflow.beacon_score(F.col("b")).alias("s")).first().s
        return round(r.score, 2), round(r.confidence, 2)

    assert tier(5, 3.0, 0.0) == (0.6, 0.6) and tier(10, 3.0, 0.0) == (0.7, 0.75)
    assert tier(5, 16.0, 0.0) == (0, 0) and tier(4, 3.0, 0.0) == (0, 0) and tier(5, 3.0, 0.9) == (0, 0)
    counts = [(100, 0, 0.0), (101, 0, 0.7), (200, 30, 0.7), (201, 0, 0.9), (0, 31, 0.5), (0, 81, 0.8)]
    df = spark.createDataFrame(counts, "n long, d long, want double")
    for r in df.select("want", crossflow.scan_score(F.col("n"), F.col("d")).alias("s")).collect():
        assert round(r.s.score, 2) == r.want


def test_row_detector_errors_are_findings(spark):
    def divide(row):
        return {"score": 1.0 / row["x"], "confidence": 1.0, "severity": "High", "evidence": [{"description": "d", "detail": None}]}

    own = registry.Detectors()
    own.register_row_detector("Own", divide, ["x"])
    with pytest.raises(ValueError):
        own.register_row_detector("Own", divide, ["x"])
    df = spark.createDataFrame([("a", 2.0), ("b", 0.0)], "flow_id string, x double")
    got = {r.flow_id: r for r in own.findings(df).collect()}
    assert got["a"].score == 0.5 and got["a"].status == "Completed"
    assert got["b"].status == "Errored" and got["b"].score == 0


def test_host_case_does_not_matter(spark):
    from pyspark.sql import functions as F

    from tidewatch.operators import domains

    hosts = spark.createDataFrame([("X.MALWARE.example.com",), ("My-BLOG.org",), ("other.net",)], "dns_name string")
    entries = spark.createDataFrame([("Malware.Example.com",), ("blog",)], "entry string")
    assert {r.dns_name for r in domains.domain_match(hosts, entries).collect()} == {"X.MALWARE.example.com", "My-BLOG.org"}
    hit = hosts.select("dns_name", domains.match_expr(F.col("dns_name"), ["malware.example.com", "Blog"]).alias("hit")).collect()
    assert {r.dns_name: r.hit for r in hit} == {"X.MALWARE.example.com": True, "My-BLOG.org": True, "other.net": False}
