"""Stream operators that answer in the order of event time, against their batch counterparts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import crossflow
from tidewatch.streaming import counters, late
from tidewatch.streaming.sink import stream_sink

S = 1_000_000
FLOW = ("flow_id string, host string, first_us long, eval_us long, pid long, remote_ip string, protocol int, remote_port int, "
        "a_ip string, a_port int, b_ip string, b_port int, ts_us long")


def flow_rows(seed=3, n=260):
    rng, rows, t = random.Random(seed), [], 0
    for k in range(n):
        t += rng.choice([100_000, S, 3 * S, 61 * S if rng.random() < 0.02 else S])
        end = t + rng.choice([5, 6, 30]) * S
        remote, port = rng.choice(["8.8.8.8", "9.9.9.9", "1.1.1.1", "7.7.7.7"]), rng.choice([53, 443])
        rows.append((f"f{k:04d}", rng.choice("ab"), t, end, rng.choice([7, 8, None]), remote, 17, port, remote, port, "10.0.0.1", 4000 + k % 3, end))
    return rows


def fed(spark, folder, rows, schema, parts, far_us):
    """The rows, a file a micro-batch in the order of time, shuffled within; a last row far ahead."""
    df = spark.createDataFrame(rows, schema)
    names, at = df.columns, df.columns.index("ts_us")
    rows = sorted(rows, key=lambda r: r[at])
    size = -(-len(rows) // parts)
    for k in range(parts):
        part = rows[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(folder)
    for k in (1, 2):
        last = [tuple(far_us * k if i == at else v for i, v in enumerate(rows[0]))]
        spark.createDataFrame(last, schema).withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder).select(*names, "ts")


def drained(spark, tmp_path, rows):
    stream_sink(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).select(*rows.columns)


@pytest.mark.parametrize("hosts", [True, False])
def test_counters_of_a_stream_are_those_of_the_batch(spark, tmp_path, hosts):
    rows = flow_rows()
    flows = spark.createDataFrame(rows, FLOW)
    flows = flows if hosts else flows.drop("host")
    made = crossflow.connections(flows)
    names = [f.name for f in made.schema]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    events = [tuple(r[n] for n in names) for r in made.collect()]
    flow_schema = FLOW if hosts else FLOW.replace("host string, ", "")
    stream = counters.stream_crossflow_lookup(
        fed(spark, str(tmp_path / "flows"), [tuple(r) for r in flows.collect()], flow_schema, 3, 10**10),
        fed(spark, str(tmp_path / "made"), events, schema, 3, 10**10), buckets=3)
    columns = ["flow_id", "scan_a", "dns_a", "scan_b", "dns_b", "beacon_a", "beacon_b", "diversity"]
    got = drained(spark, tmp_path, stream.select(*columns, "ts_us")).filter(F.col("ts_us") < 10**9).select(*columns)
    want = crossflow.crossflow_lookup(flows, made).select(*columns)
    show = lambda df: sorted((r["flow_id"], r["scan_a"], r["dns_a"], r["scan_b"], r["dns_b"], *[
        None if r[b] is None or not r[b]["beacon_n"] else (r[b]["beacon_n"], r[b]["beacon_mean_s"] and round(r[b]["beacon_mean_s"], 9), r[b]["beacon_cv"] and round(r[b]["beacon_cv"], 9)) for b in ("beacon_a", "beacon_b")
    ], r["diversity"] and tuple(r["diversity"])) for r in df.collect())
    assert show(got) == show(want) and any(r[5] and r[5][0] > 5 for r in show(want))


def test_attributes_that_come_later(spark, tmp_path):
    flows = [("f1", 1 * S, "old", None, "keep"), ("f2", 2 * S, None, "DE", "x"), ("f3", 3 * S, None, None, "y"), ("f4", 30 * S, None, None, "z")]
    updates = [("f1", 4 * S, "new", None, 5), ("f1", 5 * S, None, "FR", None), ("f2", 1 * S, "early", "IT", None), ("f3", 99 * S, "late", None, None),
               ("f1", 2 * S, "stale", None, 4), ("f4", 31 * S, None, None, 9), ("f9", 4 * S, "nobody", None, None)]
    a = fed(spark, str(tmp_path / "a"), flows, "flow_id string, ts_us long, dns_name string, country_code string, more string", 2, 10**9)
    b = fed(spark, str(tmp_path / "b"), updates, "flow_id string, ts_us long, dns_name string, country_code string, asn long", 3, 10**9)
    rows = drained(spark, tmp_path, late.stream_enrich(a, b, wait_us=20 * S, buckets=2)).filter(F.col("ts_us") < 10**9).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["version"]):
        last[r["flow_id"]] = (r["dns_name"], r["country_code"], r["asn"], r["more"])
    assert last == {"f1": ("new", "FR", 5, "keep"), "f2": ("early", "IT", None, "x"), "f3": (None, None, None, "y"), "f4": (None, None, 9, "z")}
    assert {r["version"] for r in rows if r["flow_id"] == "f1"} == set(range(max(r["version"] for r in rows if r["flow_id"] == "f1") + 1))


def test_late_rows_are_kept_apart(spark, tmp_path):
    parts = [[(1, 100), (2, 50)], [(3, 200), (4, 89), (5, 91)], [(6, 190), (7, 10), (8, 191), (9, 300)], [(10, 290), (11, 291), (12, None)]]
    for k, part in enumerate(parts):
        spark.createDataFrame([(i, t and t * S) for i, t in part], "id long, ts_us long").withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart changes nothing
        late.split_late(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        kept = {r["id"] for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()}
        lost = {r["id"]: r["watermark_us"] for r in spark.read.parquet(str(tmp_path / "out/late")).collect()}
        assert kept == {1, 2, 3, 5, 8, 9, 11, 12} and lost == {4: 90 * S, 6: 190 * S, 7: 190 * S, 10: 290 * S}
