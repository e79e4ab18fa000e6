"""What is moved and kept on disk is bounded, and results are whole."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import crossflow, enrich
from tidewatch.plans import lineage


def test_addresses_are_looked_up_in_shares(spark, monkeypatch):
    nets = spark.createDataFrame([("93.0.0.0/8", "AA", 1), ("93.184.0.0/16", "BB", None), ("2001:db8::/32", "CC", 3), ("93.184.216.0/24", None, 4)], "network string, country_code string, asn long")
    wanted = spark.createDataFrame([(f"93.{k % 200}.{k % 7 + 214}.{k % 250}",) for k in range(600)] + [("2001:db8::7",), (None,), ("8.8.8.8",)], "ip string")
    show = lambda df: sorted(map(tuple, df.select("ip", "country_code", "asn").collect()), key=str)
    whole, staged = show(enrich.geo_lookup(wanted, nets, nets)), []
    monkeypatch.setattr(enrich, "in_shares", lambda *a, f=enrich.in_shares: f(*a, prefixes=500))
    monkeypatch.setattr(enrich, "stage", lambda df, f=lineage.stage: staged.append(f(df)) or staged[-1])
    assert show(enrich.geo_lookup(wanted, nets, nets)) == whole and len(whole) > 500
    assert len(staged) > 3 and max(df.count() for df in staged[2:]) < 300


def test_ids_come_back_from_bytes(spark):
    ids = ["0123456789abcdef0123456789abcdef", "0123456789ABCDEF0123456789abcdef", "f0001", "", None, "\u00e9\u20ac", "x" * 16]
    df = spark.createDataFrame([(i,) for i in ids], "id string").withColumn("b", text.compact_id("id"))
    rows = df.select("id", text.full_id("b").alias("back"), F.octet_length("b").alias("n")).collect()
    assert all(r["id"] == r["back"] for r in rows) and rows[0]["n"] == 17


FLOW = ("flow_id string, first_us long, eval_us long, pid long, remote_ip string, protocol int, remote_port int, "
        "a_ip string, a_port int, b_ip string, b_port int")


def flow(k, remote="8.8.8.8", local="10.0.0.1", pid=7):
    return (f"{k:032x}", k * 1_000_000, k * 1_000_000 + 5_000_000, pid, remote, 6, 443, remote, 443, local, 4000)


def test_counters_are_written_family_by_family_and_stay_whole(spark, monkeypatch):
    rows = [flow(k) for k in range(9)] + [flow(20, pid=None), flow(21, "224.0.0.1")]
    flows = spark.createDataFrame(rows, FLOW)
    written = []
    monkeypatch.setattr(crossflow, "stage", lambda df, f=lineage.stage: written.append(set(df.columns)) or f(df))
    found = {r["flow_id"]: r for r in crossflow.crossflow_lookup(flows, crossflow.connections(flows)).collect()}
    assert len(written) == 4 and not any("ts_us" in c for c in written)
    last = found[f"{8:032x}"]
    assert (last["scan_a"], last["scan_b"]) == (9, 0) and tuple(last["beacon_a"]) == (9, 1.0, 0.0)
    # An end that no connection went to has a count of nothing, one that isn't asked about has none.
    assert tuple(last["beacon_b"]) == (0, None, None)
    assert found[f"{21:032x}"]["beacon_a"] is None and found[f"{20:032x}"]["diversity"] is None


@pytest.mark.parametrize("rows", [0, 50])
def test_a_staged_table_can_be_given_up(spark, rows):
    staged = lineage.stage(spark.range(rows))
    folder = os.path.dirname(staged.inputFiles()[0].removeprefix("file://"))
    assert staged.count() == rows and os.path.isdir(folder)
    lineage.unstage(staged)
    assert not os.path.exists(folder)
