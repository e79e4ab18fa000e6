import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import audit, crossflow, flows
from tidewatch.schema import FLOW_KEY
from tidewatch.streaming import stateful, windows
from tidewatch.streaming.sink import stream_sink

S = 1_000_000


@pytest.fixture
def feed(spark, tmp_path):
    """Write rows as several files and read them one file per micro-batch. A
    last far-away row moves the watermark past everything else."""

    def make(rows, schema, parts=3):
        rows = sorted(rows, key=lambda r: r[0])
        size = -(-len(rows) // parts)
        folder = tmp_path / "in"
        for i in range(parts):
            df = spark.createDataFrame(rows[i * size:(i + 1) * size], schema).withColumn("ts", F.timestamp_micros("ts_us"))
            df.coalesce(1).write.mode("append").parquet(str(folder))
        batch = spark.read.parquet(str(folder))
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return batch, stream

    return make


@pytest.fixture
def drain(spark, tmp_path):
    def run(rows):
        query = stream_sink(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).select(*rows.columns)

    return run


PACKET = "ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, length int, local_ip string"
FAR = 10_000 * S


def packet_rows():
    rng = random.Random(1)
    rows, t = [], 0
    for _ in range(120):
        t += rng.choice([100_000, S, 2 * S, 5 * S, 4_999_999])
        port = rng.choice([1, 2])
        ends = ("10.0.0.1", port, "8.8.8.8", 53) if rng.random() < 0.5 else ("8.8.8.8", 53, "10.0.0.1", port)
        rows.append((t, *ends, 17, rng.randrange(60, 90), "10.0.0.1"))
    return [*rows, (FAR, "10.0.0.9", 9, "8.8.8.8", 53, 17, 60, "10.0.0.9")]


def as_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_flows(feed, drain):
    batch, stream = feed(packet_rows(), PACKET)
    columns = [*FLOW_KEY, "first_us", "last_us", "packet_count", "byte_count", "remote_ip", "flow_id"]
    want = flows.flows(batch.drop("ts")).filter(F.col("first_us") < FAR)
    assert as_set(drain(windows.stream_flows(stream, "1 hour")), *columns) == as_set(want, *columns)


def test_new_flows(feed, drain):
    batch, stream = feed(packet_rows(), PACKET)
    columns = [*FLOW_KEY, "first_us"]
    assert as_set(drain(stateful.stream_connections(stream, "1 hour")), *columns) == as_set(flows.flows(batch.drop("ts")), *columns)


def test_reevaluations(feed, drain):
    batch, stream = feed(packet_rows(), PACKET)
    columns = [*FLOW_KEY, "first_us", "eval_us", "packet_count", "byte_count"]
    want = flows.reevaluate(batch.drop("ts")).filter(F.col("first_us") < FAR)
    assert as_set(drain(stateful.stream_reevaluate(stream, "1 hour")), *columns) == as_set(want, *columns)


CONNECTION = "ts_us long, flow_id string, pid long, remote_ip string, remote_port int, protocol int"


def test_beacons(feed, drain):
    rng = random.Random(2)
    rows = [((100 + i * 3) * S, f"r{i:03d}", 1, "9.9.9.9", 443, 6) for i in range(30)]
    rows += [(rng.randrange(100 * S, 190 * S), f"n{i:03d}", 2, "8.8.8.8", 53, 17) for i in range(150)]
    batch, stream = feed(rows, CONNECTION)
    got = {r.flow_id: (r.beacon_n, r.beacon_cv) for r in drain(stateful.stream_beacon(stream, "1 hour")).collect()}
    probes = batch.select("flow_id", F.col("remote_ip").alias("ip"), F.col("remote_port").alias("port"), "protocol", "ts_us")
    for r in crossflow.beacon_stats(batch.drop("ts"), probes).collect():
        n, cv = got[r.flow_id]
        assert n == r.beacon_n and (cv is None) == (r.beacon_cv is None) and (cv is None or abs(cv - r.beacon_cv) < 1e-9)
    assert max(n for n, _ in got.values()) > 31


def test_cooldown(feed, drain):
    rng = random.Random(4)
    rows = [(rng.randrange(S, 3000 * S), f"b{i:03d}", rng.choice(["1.1.1.1", "2.2.2.2"]), rng.choice([30_000, 300_000])) for i in range(150)]
    batch, stream = feed(rows, "ts_us long, flow_id string, remote_ip string, ttl_ms long")
    blocks = batch.drop("ts").withColumn("ttl_us", F.col("ttl_ms") * 1000)
    want = audit.cooldown(blocks, "remote_ip", "ts_us", "ttl_us", "flow_id").select("flow_id", F.col("until").alias("until_us"))
    assert as_set(drain(stateful.stream_cooldown(stream, "1 hour")), "flow_id", "until_us") == as_set(want, "flow_id", "until_us")


def test_equal_keys_on_two_hosts(spark, feed, drain):
    rows = [(*r, host) for r in packet_rows()[:-1] for host in ("a", "b") if host == "a" or r[0] % 3]
    last = [(FAR, "10.0.0.9", 9, "8.8.8.8", 53, 17, 60, "10.0.0.9", "c")]
    batch, stream = feed(rows + last, PACKET + ", host string")
    want = flows.flows(batch, extra_keys=["host"]).filter(F.col("first_us") < FAR)
    got = drain(windows.stream_flows(stream)).filter(F.col("first_us") < FAR)
    columns = ["host", *FLOW_KEY, "flow_id", "first_us", "last_us", "packet_count", "byte_count"]
    assert as_set(got, *columns) == as_set(want, *columns)
    assert {r["host"] for r in got.collect()} == {"a", "b"}


def test_connections_of_two_hosts(spark, feed, drain):
    rows = [(*r, host) for r in packet_rows()[:-1] for host in ("a", "b") if host == "a" or r[0] % 3]
    batch, stream = feed(rows + [(FAR, "10.0.0.9", 9, "8.8.8.8", 53, 17, 60, "10.0.0.9", "c")], PACKET + ", host string")
    want = flows.flows(batch, extra_keys=["host"]).filter(F.col("first_us") < FAR)
    got = drain(stateful.stream_connections(stream)).filter(F.col("first_us") < FAR)
    assert as_set(got, "host", *FLOW_KEY, "first_us") == as_set(want, "host", *FLOW_KEY, "first_us")
