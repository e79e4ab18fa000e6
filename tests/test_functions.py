import ipaddress
import math

from pyspark.sql import functions as F

from tidewatch.functions import ip as ips
from tidewatch.functions import text
from tidewatch.sources.packets import decode_frames

ADDRESSES = [
    "10.0.0.1", "255.255.255.255", "0.0.0.0", "224.0.0.1", "169.254.1.1", "100.64.0.1", "100.128.0.1", "172.16.0.1",
    "172.32.0.1", "::1", "::", "fe80::1", "ff02::1", "fc00::5", "2001:db8::1", "2001:db8:0:1:1:0:0:1",
    "1:0:0:2:0:0:0:3", "2001:0:0:1::", "1:2:3:4:5:6:7:8",
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_blob_and_text_match_ipaddress(spark):
    expected = []
    for a in ADDRESSES:
        ip = ipaddress.ip_address(a)
        expected.append((b"\0" * 10 + b"\xff\xff" + ip.packed) if ip.version == 4 else ip.packed)
    assert [bytes(b) for b in column(spark, ADDRESSES, ips.ip_blob)] == expected
    assert column(spark, ADDRESSES, lambda c: ips.ip_text(ips.ip_blob(c))) == [str(ipaddress.ip_address(a)) for a in ADDRESSES]
    assert bytes(column(spark, ["::ffff:1.2.3.4"], ips.ip_blob)[0])[-4:] == bytes([1, 2, 3, 4])


def test_valid_addresses(spark):
    bad = ["1.2.3", "1.2.3.256", "01.2.3.4", "x", ":::", "1::2::3", "1:2:3:4:5:6:7", "12345::", "1:2:3:4:5:6:7:8:9", ":1::2"]
    assert all(column(spark, ADDRESSES, ips.valid_ip))
    assert not any(column(spark, bad, ips.valid_ip))


def test_address_classes(spark):
    public = dict(zip(ADDRESSES, column(spark, ADDRESSES, ips.is_public)))
    assert public["100.128.0.1"] and public["172.32.0.1"] and public["2001:db8::1"] and public["ff02::1"] and public["fe80::1"]
    assert not any(public[a] for a in ("10.0.0.1", "100.64.0.1", "169.254.1.1", "::1", "fc00::5", "0.0.0.0"))
    infra = dict(zip(ADDRESSES, column(spark, ADDRESSES, ips.is_infrastructure)))
    assert {a for a, v in infra.items() if v} == {"255.255.255.255", "224.0.0.1", "ff02::1"}


def test_block_validation(spark):
    rows = [("8.8.8.8", 29_000, "TtlTooSmall"), ("8.8.8.8", 30_000, None), ("8.8.8.8", 86_400_000, None),
            ("8.8.8.8", 86_401_000, "TtlTooLarge"), ("127.0.0.1", 60_000, "LoopbackIp"), ("224.0.0.1", 60_000, "MulticastIp"),
            ("255.255.255.255", 60_000, "BroadcastIp"), ("169.254.0.1", 60_000, "LinkLocalIp"), ("0.0.0.0", 60_000, "UnspecifiedIp"),
            ("::1", 60_000, "LoopbackIp"), ("ff02::1", 60_000, "MulticastIp"), ("::", 60_000, "UnspecifiedIp"), ("fe80::1", 60_000, "LinkLocalIp")]
    df = spark.createDataFrame(rows, "ip string, ttl long, want string")
    for r in df.select("want", ips.validation_error("ip", "ttl").alias("got")).collect():
        assert r.got == r.want


def test_host_functions(spark):
    assert column(spark, ["a.b.c.d.e.f", "example.com", ""], text.label_count) == [6, 2, 0]
    assert column(spark, ["a.b.c.example.com", "example.com"], text.subdomain) == ["a.b.c.", ""]
    assert column(spark, ["192.168.1.1.example.com", "www.example.com", "1.02.3.4.x"], text.has_ip_literal) == [True, False, False]
    got = column(spark, ["aabc", "", "aaaa", "é"], text.shannon_entropy)
    assert [round(g, 9) for g in got] == [1.5, 0.0, 0.0, 1.0]
    name = "f3a9c2.evil.example.com"
    want = -sum(name.count(c) / len(name) * math.log2(name.count(c) / len(name)) for c in set(name))
    assert abs(column(spark, [name], text.shannon_entropy)[0] - want) < 1e-9


def test_paths(spark):
    nested = "/Applications/B.app/Contents/Frameworks/B Helper.app/Contents/MacOS/B Helper"
    paths = [nested, "/Applications/X.APP/Contents/MacOS/X", "/usr/libexec/rapportd", "/bin/bash"]
    assert column(spark, paths, text.app_bundle) == ["/Applications/B.app", "/Applications/X.APP", None, None]
    assert column(spark, paths, text.basename) == ["B Helper", "X", "rapportd", "bash"]
    assert column(spark, ["", None, "/a/b"], text.app_name) == ["Unknown app", "Unknown app", "b"]


def frame_v4(proto=6, total=60, ports=(8000, 443)):
    head = bytes([0x45, 0]) + total.to_bytes(2, "big") + bytes(5) + bytes([proto]) + bytes(2) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    return bytes(12) + b"\x08\x00" + head + ports[0].to_bytes(2, "big") + ports[1].to_bytes(2, "big")


def test_decode_frames(spark):
    v6_head = b"\x60\0\0\0" + (0).to_bytes(2, "big") + bytes([17, 64]) + ipaddress.ip_address("fe80::1").packed + ipaddress.ip_address("ff02::fb").packed
    v6 = bytes(12) + b"\x86\xdd" + v6_head
    frames = [(1, frame_v4()), (2, frame_v4(proto=1)), (3, bytes(13)), (4, v6), (5, v6 + b"\x14\xe9\x14\xe9"), (6, frame_v4()[:33]), (7, bytes(60))]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in frames], "i int, frame binary")
    got = {r.i: tuple(r)[1:] for r in decode_frames(df).collect()}
    assert got == {
        1: ("10.0.0.1", "10.0.0.2", 8000, 443, 6, 60), 2: ("10.0.0.1", "10.0.0.2", 0, 0, 1, 60),
        5: ("fe80::1", "ff02::fb", 5353, 5353, 17, 44),
    }


def test_feed_lines_with_white_space(spark):
    from tidewatch.sources.feeds import parse_blocklist, parse_threat_csv

    lines = spark.createDataFrame([("\t1.2.3.4  ",), ("5.6.7.0/24/x",), (" 5.6.7.0/24\t",), ("\t# note",)], "value string")
    assert {r.entry for r in parse_blocklist(lines).collect()} == {"1.2.3.4", "5.6.7.0/24"}
    rows = spark.createDataFrame([("\t1.2.3.4\t,\t0.5 , botnet\t", 1)], "value string, at int")
    assert [tuple(r) for r in parse_threat_csv(rows, ["at"]).collect()] == [("1.2.3.4", 0.5, "botnet")]
