from pyspark.sql import functions as F

from tidewatch.operators import flows

S = 1_000_000
COLUMNS = "ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, length int, local_ip string"


def packets(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_both_directions_share_a_flow(spark):
    p = packets(spark, [(0, "10.0.0.1", 5000, "10.0.0.2", 443, 6, 100, "10.0.0.1"), (S, "10.0.0.2", 443, "10.0.0.1", 5000, 6, 50, "10.0.0.1")])
    row, = flows.flows(p).collect()
    assert (row.packet_count, row.byte_count, row.local_port, row.remote_ip, row.remote_port) == (2, 150, 5000, "10.0.0.2", 443)
    assert row.flow_age_us == 6 * S


def test_key_ties_and_families(spark):
    p = packets(spark, [
        (0, "127.0.0.1", 5000, "127.0.0.1", 443, 6, 1, None), (0, "127.0.0.1", 443, "127.0.0.1", 5000, 6, 1, None),
        (0, "2001:db8::1", 1, "10.0.0.1", 2, 6, 1, None), (0, "9.0.0.1", 1, "10.0.0.1", 2, 6, 1, None),
        (0, "2001:db8::2", 1, "2001:db8::1", 9, 17, 1, None)])
    keys = {(r.a_ip, r.a_port, r.b_ip) for r in flows.with_flow_key(p).collect()}
    assert keys == {("127.0.0.1", 443, "127.0.0.1"), ("10.0.0.1", 2, "2001:db8::1"), ("9.0.0.1", 1, "10.0.0.1"), ("2001:db8::1", 9, "2001:db8::2")}


def test_idle_boundary(spark):
    def count(gap):
        p = packets(spark, [(7, "10.0.0.1", 1, "10.0.0.2", 2, 6, 1, None), (7 + gap, "10.0.0.1", 1, "10.0.0.2", 2, 6, 1, None)])
        return flows.flows(p).count()

    assert (count(4_999_999), count(5 * S), count(6 * S)) == (1, 2, 2)


def test_direction(spark):
    p = packets(spark, [
        (0, "203.0.113.5", 47382, "192.168.1.100", 53, 17, 1, "192.168.1.100"),
        (0, "192.168.1.100", 55000, "8.8.8.8", 53, 17, 1, "192.168.1.100"),
        (0, "1.1.1.1", 10, "2.2.2.2", 20, 17, 1, "192.168.1.100")])
    got = {(r.remote_ip, r.remote_port, r.local_port) for r in flows.with_remote_endpoint(flows.with_local_port(p)).collect()}
    assert got == {("203.0.113.5", 47382, 53), ("8.8.8.8", 53, 55000), ("2.2.2.2", 20, 10)}


def test_reevaluation_prefixes(spark):
    p = packets(spark, [(t, "10.0.0.1", 1, "10.0.0.2", 2, 6, 10, None) for t in (0, 500_000, S, 2_500_000)])
    rows = {r.eval_us: r.packet_count for r in flows.reevaluate(p).collect()}
    assert rows == {S: 3, 2 * S: 3, 3 * S: 4, 4 * S: 4, 5 * S: 4, 6 * S: 4, 7 * S: 4}


def test_features_without_age(spark):
    f = spark.createDataFrame([("x", 10, 100, 0, 6, 443, None, None, 0.5)],
                              "flow_id string, packet_count long, byte_count long, flow_age_us long, protocol int, remote_port int, dns_name string, process_path string, reputation_score double")
    row, = flows.flow_features(f).collect()
    assert row.packet_frequency == 0.0 and not row.has_dns_name
    assert flows.resolved_only(f.withColumn("remote_ip", F.lit(None).cast("string"))).count() == 0
