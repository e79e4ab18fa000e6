"""Every source reads what is written in its form, and every sink's table reads back."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.operators import decide, detectors
from tidewatch.plans.lineage import stage
from tidewatch.plans.pipeline import packet_verdicts
from tidewatch.sources import dimensions, feeds, packets, sinks

S = 1_000_000


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


DIMENSIONS = {
    "read_port_pid": (schema.PORT_PID, [(5, 443, 6, 7), (10, 53, 17, None)]),
    "read_process_inventory": (schema.PROCESS, [(7, 0, 9, "/bin/a"), (7, 9, None, "/bin/b")]),
    "read_geo_networks": (schema.GEO_NETWORK, [("10.0.0.0/8", "DE", None), ("2001:db8::/32", None, 64512)]),
    "read_ptr_records": (schema.PTR_RECORD, [("8.8.8.8", "dns.example", 5)]),
    "read_interface_snapshots": (schema.INTERFACE, [("h", 5, "en0", "10.0.0.2", "255.0.0.0", False)]),
    "read_route_snapshots": (schema.ROUTE, [("h", 5, 0, "0.0.0.0", "10.0.0.1", "en0", True, True)]),
}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("reader", DIMENSIONS)
def test_dimensions(spark, tmp_path, reader, fmt):
    fields, rows = DIMENSIONS[reader]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, fields).write.format(fmt).option("header", "true").save(path)
    found = getattr(dimensions, reader)(spark, path, fmt)
    assert found.schema == fields and rows_of(found) == sorted(rows, key=str)


@pytest.mark.parametrize("reader", ["read_port_pid", "read_process_inventory"])
def test_dimensions_of_several_hosts(spark, tmp_path, reader):
    fields, rows = DIMENSIONS[reader]
    own = schema.with_host(fields)
    spark.createDataFrame([("h1", *r) for r in rows], own).write.parquet(str(tmp_path / "t"))
    found = getattr(dimensions, reader)(spark, str(tmp_path / "t"), hosts=True)
    assert found.columns[0] == "host" and rows_of(found) == sorted((("h1", *r) for r in rows), key=str)


def test_packets_and_frames(spark, tmp_path):
    at = datetime(2024, 1, 1, 12, 0, 0, 123456)
    rows = [(at, "10.0.0.1", "8.8.8.8", 5000, 53, 17, 60, "10.0.0.1", 1), (at, "::1", None, None, None, 6, None, None, None)]
    path = str(tmp_path / "packets")
    spark.createDataFrame(rows, schema.PACKET).write.parquet(path)
    assert rows_of(packets.read_packets(spark, path)) == sorted(rows, key=str)
    assert packets.read_packets(spark, path, streaming=True).isStreaming
    frame = bytes.fromhex("00" * 12 + "0800" + "45" + "00" + "0028" + "00000000" + "4006" + "0000" + "0a000001" + "08080808" + "1388" + "01bb" + "00" * 16)
    spark.createDataFrame([(at, bytearray(frame)), (at, bytearray(b"short")), (at, None)], schema.FRAME).write.parquet(str(tmp_path / "frames"))
    found = packets.decode_frames(packets.read_frames(spark, str(tmp_path / "frames"))).collect()
    assert [(r["src_ip"], r["dst_ip"], r["src_port"], r["dst_port"], r["protocol"], r["length"]) for r in found] == [("10.0.0.1", "8.8.8.8", 5000, 443, 6, 40)]


def test_reputation_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# feed\n 1.1.1.1 \n10.0.0.0/8\nnot an address\n\n")
    (tmp_path / "b.csv").write_text("ip,score,category\n2.2.2.2,0.5,x\n2.2.2.2,7,y\n3.3.3.3,high,z\n4.4.4.4,-1,w,more\n")
    (tmp_path / ".hidden.txt").write_text("9.9.9.9\n")
    (tmp_path / "other.md").write_text("8.8.8.8\n")
    lists, scored = feeds.read_reputation_dir(spark, str(tmp_path))
    assert {(r["entry"], r["is_network"]) for r in lists.collect()} == {("1.1.1.1", False), ("10.0.0.0/8", True)}
    assert {r["ip"]: round(r["score"], 3) for r in scored.collect()} == {"2.2.2.2": 1.0, "4.4.4.4": 0.0}
    lists, scored = feeds.read_reputation_dir(spark, str(tmp_path / "missing"))
    assert lists.count() == scored.count() == 0


@pytest.fixture(scope="module")
def decided(spark):
    bad = detectors.IP_BLOCKLIST[0]
    rows = [(k * 100_000, "10.0.0.1", 5000 + p, ip, 443, 6, 60, "10.0.0.1") for k in range(20) for p, ip in enumerate([bad, "8.8.8.8"])]
    made = spark.createDataFrame(rows, "ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, length int, local_ip string")
    return stage(packet_verdicts(made, prepare=lambda f: f.withColumn("pid", F.lit(None).cast("bigint"))))


def test_verdicts_with_findings_written_twice(spark, tmp_path, decided):
    shown = {r["flow_id"]: r for r in decided.filter("verdict <> 'Allow'").collect()}
    assert shown
    v, f = str(tmp_path / "verdicts"), str(tmp_path / "findings")
    assert sinks.read_verdicts(spark, v) is None and sinks.read_findings(spark, v, f) is None
    sinks.write_decided(decided, v, f)
    sinks.write_decided(decided, v, f)  # a repeated batch
    # A later version of the first, without evidence, and findings whose version was never stored.
    late = decided.limit(100).withColumn("eval_us", F.col("eval_us") + 90 * S)
    later = F.lit(200_000).cast("bigint")
    sinks.write_findings(sinks.finding_rows(late, later).withColumn("score", F.lit(0.25).cast("float")), f)
    sinks.write_findings(sinks.finding_rows(late, later + 1), f)
    sinks.append(sinks.verdict_rows(late, later), v)
    for paths in ((v, f), (str(tmp_path / "v2"), str(tmp_path / "f2"))):
        if paths[0] != v:
            sinks.compact(spark, v, f, *paths)
            assert spark.read.parquet(paths[0]).count() == len(shown) and spark.read.parquet(paths[1]).count() == 6 * len(shown)
        kept = sinks.read_verdicts(spark, paths[0]).collect()
        assert len(kept) == len(shown) and {r["ts_ms"] for r in kept} == {200_000}
        found = sinks.read_findings(spark, *paths).collect()
        assert len(found) == 6 * len(shown) and {r["score"] for r in found} == {0.25} and {r["ts_ms"] for r in found} == {200_000}
        assert {r["verdict_id"] for r in found} == {r["verdict_id"] for r in kept}
        told = {r["detector_id"]: [tuple(e) for e in r["evidence"]] for r in found}
        one = next(iter(shown.values()))
        assert told["IpReputation"] == [tuple(e) for e in one["rep_evidence"]] and told["IpReputation"]


def test_evidence_as_json(spark, decided):
    row = sinks.finding_rows(decided).filter("detector_id = 'IpReputation'").select("evidence_json").first()[0]
    assert row.startswith('[{"description":"') and "detail" in row


def test_logs(spark, tmp_path):
    blocks = [(f"e{k}", 1000 + k, "Block", bytearray(16), "1.1.1.1", 60_000, "r", "D", 0.5, None) for k in range(5)]
    events = spark.createDataFrame(blocks, schema.ENFORCEMENT)
    path = str(tmp_path / "log")
    sinks.write_enforcement(events, path)
    sinks.write_enforcement(events.unionByName(events.withColumn("event_id", F.concat("event_id", F.lit("x")))), path)
    stored = sinks.read_table(spark, path)
    assert stored.count() == 10 and rows_of(stored.filter("length(event_id) = 2").select(*schema.ENFORCEMENT.fieldNames())) == rows_of(events)
    sinks.record_unblock(spark.createDataFrame([("1.1.1.1",)], "ip string"), path, 5000)
    assert sinks.read_table(spark, path).filter("action = 'Unblock'").select("event_id", "reason").collect()[0][1] == "dashboard-requested"
    circuit = spark.createDataFrame([(1000, "CrossFlow", "Closed", "Open", 3)], schema.CIRCUIT_EVENT)
    sinks.write_circuit_events(circuit, str(tmp_path / "circuit"))
    assert rows_of(sinks.read_table(spark, str(tmp_path / "circuit")).drop("dt")) == rows_of(circuit)


def test_replay_stream_survives_a_restart(spark, tmp_path):
    entry = lambda k, at: (f"e{k}", 1000 * k, 1 if k % 3 else 2, '{"ip_text":"1.1.1.%d"}' % k, at * S)
    parts = [[entry(1, 1), entry(2, 2), entry(1, 3)], [entry(2, 700), entry(4, 701)], [entry(1, 5000), entry(3, 5001), entry(5, 5002)]]
    names = "event_id string, ts_ms long, payload_version int, payload string, ts_us long"
    log, dead = str(tmp_path / "log"), str(tmp_path / "dead")
    for part in parts:  # each restart reads on where the last one ended
        spark.createDataFrame(part, names).withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        entries = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        sinks.replay_stream(entries, log, dead, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["event_id"] for r in sinks.read_table(spark, log).collect()) == ["e1", "e2", "e4", "e5"]
    assert [r["event_id"] for r in sinks.read_table(spark, dead).collect()] == ["e3"]


def test_age_modes(spark):
    flow = spark.createDataFrame([("f", 0, 300_000, 5_300_000, 150, 15_000, 443, 6)], "flow_id string, first_us long, last_us long, flow_age_us long, packet_count long, byte_count long, remote_port int, protocol int")
    hits = lambda **mode: detectors.score_flow_behavior(flow, **mode).first()["behav_hits"]
    assert hits() == 0 and hits(age_mode="active") == 2  # a rate of 500 a second and a burst
    with pytest.raises((ValueError, PySparkException)):
        hits(age_mode="other")


def test_custom_policy_and_ids(decided):
    assert decided.select(decide.verdict_id().alias("i")).filter("length(i) <> 32").count() == 0
