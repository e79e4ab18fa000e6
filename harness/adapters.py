"""Network tables derived from the driver's tables.

The driver's tables hold no packets, so every row of ``events`` is mapped to
packets of one user's host, large-valued events to a burst of connections, and
the other tables to dimensions and audit tables. All adapters are plain
projections of whole tables; ``sql.py`` states the same mapping for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import ip as ips

# 30 days of events are compressed to 1000 seconds.
EPOCH_US = 1704067200000000
SQUEEZE = 2592
BURST_VALUE = 200
NOW_MS = 1706659200000  # 2024-01-31 00:00 UTC
TZ = "America/New_York"

POOL = [
    "93.184.216.10", "151.101.1.20", "45.33.32.156", "8.8.8.8", "203.0.113.7",
    "198.51.100.9", "185.130.5.37", "104.16.8.30", "192.0.2.77", "2001:db8::5",
]
PATHS = [
    "/Applications/Safari.app/Contents/MacOS/Safari", "/tmp/update.sh", "/usr/bin/curl", "/bin/bash",
    "/opt/tools/agentd", "/Applications/Chat.app/Contents/Frameworks/Chat Helper.app/Contents/MacOS/Chat Helper",
    "/private/tmp/python3", "",
]
DETECTOR_NAMES = ["DnsAnalyzer", "ProcessCorrelator", "FlowBehavior", "IpReputation", "DnsTunnelDetector", "CrossFlow"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def by_type(**values) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("event_type"))


def epoch_us(col: str = "ts") -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def user_ip(user: Column) -> Column:
    return F.concat_ws(".", F.lit("10"), div(user, 65536).cast("string"),
                       F.pmod(div(user, 256), F.lit(256)).cast("string"), F.pmod(user, F.lit(256)).cast("string"))


def squeezed(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    if streaming:
        events = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    return events.select(
        "event_id", "user_id", "event_type", "value", div(epoch_us() - EPOCH_US, SQUEEZE).alias("us")
    )


def packets(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    ev = squeezed(spark, sf_dir, streaming)
    n = by_type(view=3, click=2, signup=8, purchase=20, error=1)
    burst = F.when(F.col("value") >= BURST_VALUE, by_type(view=0, click=90, signup=7, purchase=60, error=240)).otherwise(0)

    def steps(kind: int, count: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.struct(F.lit(kind).alias("kind"), (i - 1).alias("i")))
        return F.when(count > 0, made).otherwise(F.array().cast("array<struct<kind:int,i:int>>"))

    p = ev.withColumn("s", F.explode(F.concat(steps(0, n), steps(1, burst)))).select("*", "s.kind", "s.i").drop("s")
    base = F.col("kind") == 0
    i = F.col("i")
    target = pick(POOL, F.pmod("event_id", F.lit(10)))
    remote_port = F.when(base, by_type(view=443, click=80, signup=53, purchase=8080, error=22)).otherwise(
        by_type(view=0, click=53, signup=8443, purchase=443, error=22))
    p = p.select(
        (F.col("us") + i * F.when(base, 100_000).otherwise(by_type(view=0, click=300_000, signup=5_000_000, purchase=100_000, error=200_000))).alias("ts_us"),
        user_ip(F.col("user_id")).alias("local_ip"),
        F.when(base, 40000 + F.pmod("user_id", F.lit(20000))).otherwise(
            10000 + F.pmod(F.col("event_id") * 251 + i, F.lit(25000))).cast("int").alias("local_port"),
        F.when(~base & (F.col("event_type") == "purchase"), F.concat(F.lit("198.51.100."), (i + 1).cast("string")))
        .when(~base & (F.col("event_type") == "click"), "203.0.113.53").otherwise(target).alias("remote_ip"),
        remote_port.alias("remote_port"),
        F.when(remote_port == 53, 17).otherwise(6).alias("protocol"),
        (60 + F.pmod(F.floor("value").cast("int"), F.lit(1400))).alias("length"),
        (base & (i % 2 == 1)).alias("reply"),
    )
    reply = F.col("reply")
    return p.select(
        "ts_us",
        F.when(reply, F.col("remote_ip")).otherwise(F.col("local_ip")).alias("src_ip"),
        F.when(reply, F.col("local_ip")).otherwise(F.col("remote_ip")).alias("dst_ip"),
        F.when(reply, F.col("remote_port")).otherwise(F.col("local_port")).alias("src_port"),
        F.when(reply, F.col("local_port")).otherwise(F.col("remote_port")).alias("dst_port"),
        "protocol", "length", "local_ip",
    )


def with_pid(flows: DataFrame) -> DataFrame:
    """The host address numbers the user; every seventh user has no pid."""
    user = ips.v4_num("local_ip") - ips.v4_num(F.lit("10.0.0.0"))
    return flows.withColumn("pid", F.when(user % 7 != 0, user))


def port_pids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = squeezed(spark, sf_dir)
    port = by_type(view=443, click=80, signup=53, purchase=8080, error=22)
    return ev.select(
        (div(F.col("us"), 5_000_000) * 5_000_000 + 2_000_000).alias("snapshot_us"),
        (40000 + F.pmod("user_id", F.lit(20000))).cast("int").alias("port"),
        F.when(port == 53, 17).otherwise(6).alias("protocol"), F.col("user_id").alias("pid"),
    ).distinct()


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    rows = users.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.col("half")
    return rows.select(
        F.col("user_id").alias("pid"),
        F.when(half == 0, F.lit(0)).otherwise(500_000_000 + F.col("user_id") % 100 * 1_000_000).cast("bigint").alias("start_us"),
        F.when(half == 0, F.lit(450_000_000).cast("bigint")).alias("end_us"),
        pick(PATHS, F.pmod(F.col("user_id") + half, F.lit(8))).alias("path"),
    )


def host_name() -> Column:
    """Host of a page; some are lengthened so that the length tiers occur."""
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    page = F.col("page_id")
    digest = F.md5(page.cast("string"))
    return (
        F.when(page % 5 == 1, F.concat(digest, F.lit("."), host))
        .when(page % 5 == 2, F.concat(digest, F.reverse(digest), F.lit(".a.b.c.d.e."), host))
        .when(page % 5 == 3, F.concat(F.substring(digest, 1, 12), F.lit(".10.1.2.3.Evil.XYZ")))
        .when((page % 5 == 4) & (page % 10 == 4), F.lit("WWW.GitHub.com"))
        .otherwise(host)
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", host_name().alias("dns_name"))


def ptr_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        pick(POOL, F.pmod("page_id", F.lit(10))).alias("ip"), host_name().alias("name"),
        (F.pmod(F.col("page_id") * 7919, F.lit(1000)) * 1_000_000).alias("ts_us"),
    )


def geo_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    plen = (8 + key % 17).cast("int")
    num = F.pmod(key * 2654435761, F.lit(4294967296))
    size = F.element_at(F.array(*[F.lit(1 << (32 - p)) for p in range(8, 25)]), (key % 17 + 1).cast("int"))
    v4 = c.select(
        F.concat(ips.v4_text(num - num % size), F.lit("/"), plen.cast("string")).alias("network"),
        F.col("c_nationkey").alias("_n"), key.alias("asn"),
    )
    v6 = c.select(
        F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.pmod(key, F.lit(65536)))), F.lit("::/48")).alias("network"),
        F.col("c_nationkey").alias("_n"), key.alias("asn"),
    )
    return v4.unionByName(v6).select("network", country_code(F.col("_n")).alias("country_code"), "asn")


def country_code(nation: Column) -> Column:
    """Two letters from a nation number."""
    return F.concat(F.char(nation + 65), F.char((nation * 7) % 26 + 65))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address per order, IPv6 for every tenth."""
    key = F.col("o_orderkey")
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.pmod(div(key, 10) * 5, F.lit(65536)))), F.lit("::1"))
    return table(spark, sf_dir, "orders").select(
        key.alias("order_id"),
        F.when(key % 10 == 0, v6).otherwise(ips.v4_text(F.pmod(key * 2246822519, F.lit(4294967296)))).alias("ip"),
    )


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text feed, one per supplier: addresses, CIDRs, noise."""
    key = F.col("s_suppkey")
    ip = ips.v4_text(F.pmod(key * 2 * 2246822519, F.lit(4294967296)))
    net = F.concat(ips.v4_text(F.pmod(key * 2654435761, F.lit(4294967296))), F.lit("/"), (8 + key % 9).cast("string"))
    return table(spark, sf_dir, "supplier").select(
        F.when(key % 5 == 0, net).when(key % 5 == 1, F.concat(F.lit("# "), ip)).when(key % 5 == 2, "not-an-ip")
        .otherwise(F.concat(F.lit("  "), ip, F.lit(" "))).alias("value")
    )


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a scored feed, one per customer; later lines repeat addresses."""
    key = F.col("c_custkey")
    ip = ips.v4_text(F.pmod((key % 700) * 3 * 2246822519, F.lit(4294967296)))
    score = (key % 13).cast("string")
    return table(spark, sf_dir, "customer").select(
        key.alias("line_no"),
        F.when(key % 11 == 0, "badline").when(key % 11 == 1, F.concat(ip, F.lit(",high,scanner")))
        .otherwise(F.concat(ip, F.lit(",0."), score, F.lit(",scanner"))).alias("value"),
    )


def enforcement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    user = F.col("user_id")
    ip = F.concat(F.lit("203.0."), F.pmod(div(user, 256), F.lit(256)).cast("string"), F.lit("."), F.pmod(user, F.lit(256)).cast("string"))
    block = F.col("event_type") == "purchase"
    return ev.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        div(epoch_us(), 1000).alias("ts_ms"),
        F.when(block, "Block").otherwise("Unblock").alias("action"),
        ips.ip_blob(ip).alias("ip_blob"), ip.alias("ip_text"),
        F.when(block, (60000 + F.floor("value") * 4000000)).cast("bigint").alias("ttl_ms"),
        F.concat(F.lit("rule "), (F.col("event_id") % 9).cast("string")).alias("reason"),
        pick(DETECTOR_NAMES, F.col("event_id") % 6).alias("detector"),
        (F.least(F.floor("value"), F.lit(100)) / 100).alias("score"),
        F.when(F.col("event_id") % 11 == 0, "send failed").alias("error"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    user, eid = F.col("user_id"), F.col("event_id")
    block = F.col("event_type").isin("signup", "purchase")
    local = user_ip(user)
    remote = pick(POOL[:9], eid % 9)
    return ev.select(
        eid.alias("verdict_id"), div(epoch_us(), 1000).alias("ts_ms"),
        local.alias("a_ip"), (40000 + user % 50).cast("int").alias("a_port"), remote.alias("b_ip"),
        F.lit(443).alias("b_port"), F.lit(6).alias("protocol"),
        F.when(user % 7 != 0, user).alias("pid"),
        F.when(user % 9 != 0, pick(PATHS, user % 8)).alias("process_path"),
        F.when(eid % 4 == 0, F.concat(F.lit("h"), (eid % 30).cast("string"), F.lit(".example.com"))).alias("dns_name"),
        F.when(eid % 6 != 0, country_code((user % 25).cast("int"))).alias("country_code"),
        F.when(block, "Block").otherwise("Alert").alias("verdict"),
        F.concat(F.lit("score "), (eid % 100).cast("string")).alias("reason"),
        (F.least(F.floor("value"), F.lit(100)) / 100).alias("composite_score"),
        F.when(block, 60000 + F.floor("value") * 1000).cast("bigint").alias("ttl_ms"),
        F.when(eid % 5 != 0, local).alias("local_ip"),
        F.when(eid % 3 == 0, remote).alias("remote_ip"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    eid, k = F.col("event_id"), F.col("k")
    score = ((eid + k) % 10) / 10
    # Evidence like a beacon or scan text, missing for every fourth finding.
    text = F.when((eid + k) % 3 == 0, "Beacon-like periodicity: 7 connections").when(
        (eid + k) % 3 == 1, "DNS query burst: 90 queries").otherwise("High connection count to IP")
    evidence = F.array(F.struct(text.alias("description"), F.lit(None).cast("string").alias("detail")))
    return ev.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        eid.alias("verdict_id"), k.alias("ord"), pick(DETECTOR_NAMES, k).alias("detector_id"),
        F.lit("1.0.0").alias("detector_version"), score.cast("float").alias("score"),
        (F.lit(0.5) + F.lit(0.1) * (k % 3)).cast("float").alias("confidence"),
        F.when(score > 0.7, "Critical").when(score > 0.5, "High").when(score > 0.3, "Medium").otherwise("Low").alias("severity"),
        F.when((eid * 7 + k) % 13 == 0, "TimedOut").when((eid * 7 + k) % 17 == 0, "Errored").otherwise("Completed").alias("status"),
        F.when((eid + k) % 4 != 0, evidence).alias("evidence"),
    )


def circuit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    states = ["Closed", "Open", "HalfOpen"]
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        eid.alias("id"), div(epoch_us(), 1000).alias("ts_ms"), pick(DETECTOR_NAMES, eid % 6).alias("detector_id"),
        pick(states, eid % 3).alias("from_state"), pick(states, (eid + 1) % 3).alias("to_state"),
        (eid % 5).cast("int").alias("consecutive_failures"),
    )


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface snapshots, one host per supplier, taken per nation number."""
    key = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    n = F.col("n")
    ip = (F.when(n == 0, "127.0.0.1")
          .when(n == 1, F.concat(F.lit("192.168."), (key % 256).cast("string"), F.lit("."), (key * 13 % 254 + 1).cast("string")))
          .otherwise(F.concat(F.lit("10.8."), (key % 256).cast("string"), F.lit(".2"))))
    return base.select(
        F.concat(F.lit("host"), key.cast("string")).alias("host"), F.lit(0).cast("bigint").alias("ts_us"),
        pick(["lo0", "en0", "utun3"], n).alias("iface"), ip.alias("ip"),
        pick(["255.0.0.0", "255.255.255.0", "255.255.255.252"], n).alias("mask"), (n == 0).alias("is_loopback"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route snapshots per supplier host; some snapshots have no gateway."""
    key = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn(
        "n", F.explode(F.sequence(F.lit(0), F.lit(3))))
    n, t = F.col("n"), F.col("t")
    net = F.concat(F.lit("192.168."), (key % 256).cast("string"))
    gateway = (F.when(n == 0, "127.0.0.1").when(n == 1, F.concat(net, F.lit(".254")))
               .when(n == 2, F.concat(net, F.lit(".1")))
               .otherwise(F.concat(F.lit("10.8."), (key % 256).cast("string"), F.when(key % 3 == 0, ".2").otherwise(".1"))))
    return base.select(
        F.concat(F.lit("host"), key.cast("string")).alias("host"), (t * 5_000_000).cast("bigint").alias("ts_us"),
        n.alias("route_order"),
        F.when((n == 2) & (key % 2 == 0), "0.0.0.0").otherwise(F.concat(F.lit("172.16."), n.cast("string"), F.lit(".0"))).alias("dst"),
        gateway.alias("gateway"), pick(["lo0", "en0", "en0", "utun3"], n).alias("iface"),
        (~((n < 3) & ((key + t) % 4 == 0))).alias("is_up"), ((n == 1) | (n == 2) | ((key % 5 == 0) & (n == 3))).alias("is_gateway"),
    )


# A fleet: ten users share a host, and every host uses the same ports and pids.
USERS_PER_HOST = 10
TICKS, TICK_US = 13, 100_000_000


def fleet_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    fold = lambda c: F.when(F.col(c) >= 40000, 40000 + (F.col(c) - 40000) % USERS_PER_HOST).otherwise(F.col(c)).cast("int")
    user = ips.v4_num("local_ip") - ips.v4_num(F.lit("10.0.0.0"))
    host = F.concat(F.lit("h"), div(user, USERS_PER_HOST).cast("string"))
    return p.withColumns({"src_port": fold("src_port"), "dst_port": fold("dst_port"), "host": host})


def with_fleet_pid(flows: DataFrame) -> DataFrame:
    user = ips.v4_num("local_ip") - ips.v4_num(F.lit("10.0.0.0"))
    return flows.withColumn("pid", F.when(user % 7 != 0, user % USERS_PER_HOST + 1))


def fleet_host(user: Column) -> Column:
    return F.concat(F.lit("h"), div(user, USERS_PER_HOST).cast("string"))


def fleet_port_pids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = squeezed(spark, sf_dir)
    port = by_type(view=443, click=80, signup=53, purchase=8080, error=22)
    user = F.col("user_id")
    return ev.select(
        fleet_host(user).alias("host"), (div(F.col("us"), 5_000_000) * 5_000_000 + 2_000_000).alias("snapshot_us"),
        (40000 + user % USERS_PER_HOST).cast("int").alias("port"), F.when(port == 53, 17).otherwise(6).alias("protocol"),
        (user % USERS_PER_HOST + 1).alias("pid"),
    ).distinct()


def fleet_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = processes(spark, sf_dir)
    user = F.col("pid")
    return rows.select(fleet_host(user).alias("host"), (user % USERS_PER_HOST + 1).alias("pid"), "start_us", "end_us", "path")


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "events").select(div(F.col("user_id"), USERS_PER_HOST).alias("h")).distinct()
    ticks = hosts.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(TICKS - 1))))
    return ticks.select("h", "t", F.concat(F.lit("h"), F.col("h").cast("string")).alias("host"), (F.col("t").cast("bigint") * TICK_US).alias("ts_us"))


def fleet_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of each host; its tunnel at times has an address that is a remote one otherwise."""
    h, t, n = F.col("h"), F.col("t"), F.col("n")
    base = _ticks(spark, sf_dir).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    there = (n == 0) | ((n == 1) & ((t + h) % 7 != 5)) | ((n == 2) & ((t + h) % 6 >= 3))
    net = F.concat(F.lit("192.168."), (h % 256).cast("string"), F.lit(".2"))
    return base.filter(there).select(
        "host", "ts_us", pick(["lo0", "en0", "utun3"], n).alias("iface"),
        F.when(n == 0, "127.0.0.1").when(n == 1, net).otherwise(pick(POOL, h % 4)).alias("ip"),
        pick(["255.0.0.0", "255.255.255.0", "255.255.255.255"], n).alias("mask"), (n == 0).alias("is_loopback"),
    )


def fleet_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of each host; gateway and tunnel peer change, and at times there is none."""
    h, t, n = F.col("h"), F.col("t"), F.col("n")
    base = _ticks(spark, sf_dir).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    peer = F.when((t + h) % 3 == 0, "203.0.113.53").otherwise(pick(POOL, (h + 1) % 4))
    return base.select(
        "host", "ts_us", n.alias("route_order"), pick(["0.0.0.0", "172.16.0.0"], n).alias("dst"),
        F.when(n == 0, pick(POOL, (h + F.floor(t / 4)) % 9)).otherwise(peer).alias("gateway"),
        pick(["en0", "utun3"], n).alias("iface"),
        F.when(n == 0, (t + h) % 5 != 3).otherwise(t % 4 >= 1).alias("is_up"), (n == 0).alias("is_gateway"),
    )
