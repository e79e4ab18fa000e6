import random

from pyspark.sql import functions as F

from tidewatch.functions.ip import ip_blob
from tidewatch.operators import audit, enrich, topology
from tidewatch.sources import feeds, sinks

LOG = "event_id string, ts_ms long, action string, ip_text string, ttl_ms long, reason string"


def test_active_blocks(spark):
    rows = [("1", 1000, "Block", "1.1.1.1", 60_000, "r"), ("2", 1000, "Block", "2.2.2.2", 10, "r"),
            ("3", 1000, "Block", "3.3.3.3", 60_000, "r"), ("4", 2000, "Unblock", "3.3.3.3", None, "r"),
            ("5", 1000, "Block", "4.4.4.4", 60_000, "r"), ("6", 2000, "Unblock", "4.4.4.4", None, "r"), ("7", 3000, "Block", "4.4.4.4", 60_000, "r")]
    log = spark.createDataFrame(rows, LOG)
    assert {r.ip_text for r in audit.active_blocks(log, 5000).collect()} == {"1.1.1.1", "4.4.4.4"}
    desired = audit.desired_blocks(log, 5000)
    live = spark.createDataFrame([("1.1.1.1",), ("203.0.113.99",)], "ip string")
    assert {(r.ip, r.action) for r in audit.reconcile_diff(desired, live).collect()} == {("203.0.113.99", "remove"), ("4.4.4.4", "add")}
    assert audit.desired_blocks(log, 5000, limit=1).count() == 1


def brute_intervals(rows):
    out, free = set(), {}
    for _, ts, action, ip, ttl, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        current = free.get(ip)
        if action == "Block" and (current is None or ts >= current[1]):
            free[ip] = (ts, ts + ttl)
            out.add((ip, ts, ts + ttl))
        elif action == "Unblock" and current is not None:
            if ts < current[1]:
                out.discard((ip, *current))
                out.add((ip, current[0], ts))
            free[ip] = None
    return {r for r in out}


def test_block_intervals_and_cooldown(spark):
    rng = random.Random(3)
    rows = [(f"e{i:04d}", rng.randrange(0, 4_000_000), "Block" if rng.random() < 0.8 else "Unblock", rng.choice(["1.1.1.1", "2.2.2.2"]),
             rng.choice([30_000, 60_000, 300_000]), "r") for i in range(400)]
    log = spark.createDataFrame(rows, LOG)
    want = brute_intervals(rows)
    assert {tuple(r) for r in audit.block_intervals(log).collect()} == want
    blocks = log.filter("action = 'Block'")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key spans batches
    try:
        got = {(r.ip_text, r.ts_ms, r.until) for r in audit.cooldown(blocks, "ip_text", row_id="event_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_intervals([r for r in rows if r[2] == "Block"])


def test_versions_and_checks(spark):
    key = ("10.0.0.1", 1, "8.8.8.8", 443, 6)
    rows = [(*key, "Alert", i, f"v{i}", f"reason {i}") for i in range(3)] + [(*key, "Block", 9, "v9", "b")]
    v = spark.createDataFrame(rows, "a_ip string, a_port int, b_ip string, b_port int, protocol int, verdict string, ts_ms long, verdict_id string, reason string")
    assert {(r.verdict, r.reason) for r in audit.latest_verdicts(v).collect()} == {("Alert", "reason 2"), ("Block", "b")}
    bad = spark.createDataFrame([("Ban", 1.5), ("Block", None), ("Unblock", 0.5)], "action string, score double")
    good, quarantine = audit.split_valid(bad, "enforcement_log")
    assert good.count() == 2 and quarantine.first().violations == ["action", "score"]


def test_enforcement_is_idempotent(spark, tmp_path):
    log = spark.createDataFrame([("a", 1000, "Block", "1.1.1.1", 60_000, "r"), ("b", 2000, "Block", "2.2.2.2", 60_000, "r")], LOG)
    log = log.withColumns({"ip_blob": ip_blob("ip_text"), "detector": F.lit("X"), "score": F.lit(0.5), "error": F.lit(None).cast("string")})
    path = str(tmp_path / "log")
    for _ in range(2):
        sinks.write_enforcement(log, path)
    assert spark.read.parquet(path).count() == 2
    entries = log.select("event_id", "ts_ms", F.when(F.col("event_id") == "a", 1).otherwise(2).alias("payload_version"), sinks.payload_json().alias("payload"))
    sinks.replay_events(entries.withColumn("event_id", F.concat(F.lit("n"), "event_id")), path, str(tmp_path / "dead"))
    assert {r.event_id for r in spark.read.parquet(path).collect()} == {"a", "b", "na"}
    assert spark.read.parquet(str(tmp_path / "dead")).first().event_id == "nb"
    sinks.record_unblock(spark.createDataFrame([("1.1.1.1",)], "ip string"), path, 5000)
    assert {r.ip_text for r in audit.active_blocks(spark.read.parquet(path), 6000).collect()} == {"2.2.2.2"}


def test_feeds(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("# list\n103.224.182.251\n\n198.51.100.0/24\n192.0.2.0/30\nnot-an-ip\n2001:db8::/32\n10.0.0.1\n1.2.3.4/40\n")
    (tmp_path / "feed.csv").write_text("ip,score,category\n203.0.113.9,.95,c2\n203.0.113.8,0.70,scan\nbadline\n203.0.113.7,high,x\n103.224.182.251,0.6,c2\n203.0.113.8,7,last\n")
    lists, scored = feeds.read_reputation_dir(spark, str(tmp_path))
    assert lists.count() == 5 and scored.count() == 3
    asked = ["103.224.182.251", "198.51.100.42", "8.8.8.8", "192.0.2.3", "192.0.2.4", "203.0.113.8", "2001:db8::7", "10.0.0.1"]
    df = spark.createDataFrame([(a,) for a in asked], "ip string")
    got = {r.ip: r.reputation_score for r in enrich.reputation_lookup(df, lists, scored).collect()}
    assert abs(got["103.224.182.251"] - 0.6) < 1e-6 and got["203.0.113.8"] == 1.0
    assert got["198.51.100.42"] == got["192.0.2.3"] == got["2001:db8::7"] == 1.0
    assert got["8.8.8.8"] is None and got["192.0.2.4"] is None and "10.0.0.1" not in got
    empty, none = feeds.read_reputation_dir(spark, str(tmp_path / "missing"))
    assert empty.count() == 0 and none.count() == 0


def test_pid_snapshots_replace_each_other(spark):
    flows = spark.createDataFrame([("a", 50, 6, 7), ("b", 50, 6, 15), ("c", 50, 6, 3), ("d", None, 6, 7)], "flow_id string, local_port int, protocol int, first_us long")
    snaps = spark.createDataFrame([(5, 50, 6, 1), (10, 60, 6, 2)], "snapshot_us long, port int, protocol int, pid long")
    got = {r.flow_id: (r.local_port, r.pid) for r in enrich.asof_pid(flows, snaps).collect()}
    assert got == {"a": (50, 1), "b": (0, None), "c": (0, None), "d": (0, None)}


def test_broadcast_address(spark):
    df = spark.createDataFrame([("192.168.1.7", "255.255.255.0"), ("2001:db8::1", "ffff:ffff:ffff:ffff::")], "ip string, mask string")
    got = [r.b for r in df.select(topology.broadcast_address(F.col("ip"), F.col("mask")).alias("b")).collect()]
    assert got == ["192.168.1.255", "2001:db8::ffff:ffff:ffff:ffff"]
