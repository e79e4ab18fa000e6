"""Fixed table schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


def with_host(fields: T.StructType) -> T.StructType:
    """The schema for tables of several hosts: ports, pids and processes are then those of one host."""
    return T.StructType([T.StructField("host", T.StringType(), True), *fields.fields])


_S, _I, _L, _F, _D = T.StringType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()

EVIDENCE = T.ArrayType(_schema(("description", _S), ("detail", _S)))

PACKET = _schema(
    ("ts", T.TimestampType()), ("src_ip", _S), ("dst_ip", _S), ("src_port", _I),
    ("dst_port", _I), ("protocol", _I), ("length", _I), ("local_ip", _S), ("seq", _L),
)
FRAME = _schema(("ts", T.TimestampType()), ("frame", T.BinaryType()))
FINDING = _schema(
    ("detector_id", _S), ("detector_version", _S), ("score", _F), ("confidence", _F),
    ("severity", _S), ("evidence", EVIDENCE), ("latency_us", _L), ("status", _S),
)
PORT_PID = _schema(("snapshot_us", _L), ("port", _I), ("protocol", _I), ("pid", _L))
PTR_RECORD = _schema(("ip", _S), ("name", _S), ("ts_us", _L))
PROCESS = _schema(("pid", _L), ("start_us", _L), ("end_us", _L), ("path", _S))
GEO_NETWORK = _schema(("network", _S), ("country_code", _S), ("asn", _L))
INTERFACE = _schema(
    ("host", _S), ("ts_us", _L), ("iface", _S), ("ip", _S), ("mask", _S), ("is_loopback", T.BooleanType()),
)
ROUTE = _schema(
    ("host", _S), ("ts_us", _L), ("route_order", _I), ("dst", _S), ("gateway", _S), ("iface", _S),
    ("is_up", T.BooleanType()), ("is_gateway", T.BooleanType()),
)
ENFORCEMENT = _schema(
    ("event_id", _S), ("ts_ms", _L), ("action", _S), ("ip_blob", T.BinaryType()), ("ip_text", _S),
    ("ttl_ms", _L), ("reason", _S), ("detector", _S), ("score", _D), ("error", _S),
)
CIRCUIT_EVENT = _schema(
    ("ts_ms", _L), ("detector_id", _S), ("from_state", _S), ("to_state", _S), ("consecutive_failures", _I),
)
REPLAY_PAYLOAD = _schema(
    ("ip_blob_hex", _S), ("ip_text", _S), ("ttl_ms", _L), ("reason", _S), ("detector", _S),
    ("score", _D), ("send_error", _S),
)

FLOW_KEY = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]
VERDICT_KEY = ["a_ip", "a_port", "b_ip", "b_port", "protocol", "verdict"]

# Severity names in rank order.
SEVERITIES = ["Low", "Medium", "High", "Critical"]

# The built-in detectors in summing order, with the prefix of
# their columns on a scored flow.
DETECTORS = {
    "DnsAnalyzer": "dns",
    "ProcessCorrelator": "proc",
    "FlowBehavior": "behav",
    "IpReputation": "rep",
    "DnsTunnelDetector": "tunnel",
    "CrossFlow": "cross",
}
