"""Packets to bidirectional flow sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import ip as ips
from tidewatch.functions.times import SECOND_US, slot, with_ts_us
from tidewatch.plans.sliced import islands, slice_runs
from tidewatch.schema import FLOW_KEY

# A flow ends when idle this long; active flows are scored again
# at this interval.
IDLE_US = 5 * SECOND_US
REEVALUATE_US = SECOND_US


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Order the two (ip, port) ends so that both directions share one key."""
    src_first = ips.not_after(
        F.col("src_ip"), F.col("_src_num"), F.col("src_port"), F.col("dst_ip"), F.col("_dst_num"), F.col("dst_port")
    )
    numbered = packets.withColumns({"_src_num": ips.v4_num("src_ip"), "_dst_num": ips.v4_num("dst_ip")})
    keyed = numbered.withColumn("src_is_a", src_first).drop("_src_num", "_dst_num")
    return keyed.withColumns(_ends(F.col("src_is_a"), "src", "dst", "a", "b"))


def _ends(flag: Column, yes: str, no: str, first: str, second: str) -> dict[str, Column]:
    """``first`` is the ``yes`` end where ``flag`` holds, else the ``no`` end."""
    columns = {}
    for part in ("ip", "port"):
        columns[f"{first}_{part}"] = F.when(flag, F.col(f"{yes}_{part}")).otherwise(F.col(f"{no}_{part}"))
        columns[f"{second}_{part}"] = F.when(flag, F.col(f"{no}_{part}")).otherwise(F.col(f"{yes}_{part}"))
    return columns


def _dst_is_local(local_ip: Column) -> Column:
    return (F.col("src_ip") != local_ip) & (F.col("dst_ip") == local_ip)


def with_local_port(df: DataFrame, local_ip: Column | str = "local_ip") -> DataFrame:
    """Local and remote port; the source is local when neither end matches."""
    local = F.col(local_ip) if isinstance(local_ip, str) else local_ip
    inbound = _dst_is_local(local)
    return df.withColumns({
        "local_port": F.when(inbound, F.col("dst_port")).otherwise(F.col("src_port")),
        "remote_port": F.when(inbound, F.col("src_port")).otherwise(F.col("dst_port")),
    })


def with_remote_endpoint(df: DataFrame, local_ip: Column | str = "local_ip") -> DataFrame:
    """Remote (ip, port); the destination is remote when neither end matches.

    Direction stays null where the local address is unknown.
    """
    local = F.col(local_ip) if isinstance(local_ip, str) else local_ip
    inbound = _dst_is_local(local)
    known = local.isNotNull()
    return df.withColumns({
        "remote_ip": F.when(known, F.when(inbound, F.col("src_ip")).otherwise(F.col("dst_ip"))),
        "remote_port": F.when(known, F.when(inbound, F.col("src_port")).otherwise(F.col("dst_port"))),
    })


def flows(packets: DataFrame, idle_us: int = IDLE_US, extra_keys: list[str] | None = None) -> DataFrame:
    """One row per flow session, final statistics and first-packet direction.

    ``extra_keys`` (for example a sensor column) separates hosts. Packets are
    reduced to one row per (key, idle-gap slice) before the shuffle, so a
    single busy flow costs one row per slice.
    """
    keys = [*FLOW_KEY, *(extra_keys or [])]
    keyed = with_flow_key(with_ts_us(packets))
    aggs = {
        "packet_count": ("sum", F.lit(1).cast("bigint")),
        "byte_count": ("sum", F.col("length").cast("bigint")),
        "_direction": ("min", time_and_direction()),
    }
    firsts = ("local_ip",) if "local_ip" in packets.columns else ()
    runs = islands(keyed, keys, "ts_us", idle_us, aggs, split_at_gap=True, firsts=firsts)
    return describe(runs, keys, idle_us)


def time_and_direction() -> Column:
    """Time and direction of a packet in one sortable number; packets of equal
    time count in a-to-b order."""
    return F.col("ts_us") * 2 + F.when(F.col("src_is_a"), 0).otherwise(1)


def describe(runs: DataFrame, keys: list[str], idle_us: int = IDLE_US) -> DataFrame:
    """Flow columns that follow from a session's key, times and direction."""
    a_first = F.pmod(F.col("_direction"), F.lit(2)) == 0
    described = runs.withColumns(_ends(a_first, "a", "b", "src", "dst")).drop("_direction")
    described = described.withColumns({
        "flow_id": flow_id(keys),
        "flow_age_us": F.col("last_us") + idle_us - F.col("first_us"),
        "eval_us": F.col("last_us") + idle_us,
    })
    if "local_ip" in described.columns:
        described = with_remote_endpoint(with_local_port(described))
    return described


def flow_id(keys: list[str]) -> Column:
    """Repeatable id of a flow: its key and start."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("first_us").cast("string")))


def packet_flow_starts(packets: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """Packets with the start time of the flow session each belongs to."""
    keyed = with_flow_key(with_ts_us(packets)).withColumn("_slice", slot("ts_us", idle_us))
    runs = slice_runs(keyed, FLOW_KEY, "ts_us", idle_us, {}, split_at_gap=True)
    starts = runs.select(*FLOW_KEY, "_slice", F.col("_run").alias("flow_first_us"))
    return keyed.join(starts, [*FLOW_KEY, "_slice"]).drop("_slice")


def resolved_only(flow_rows: DataFrame) -> DataFrame:
    """Flows of unknown direction are not scored."""
    return flow_rows.filter(F.col("remote_ip").isNotNull())


def reevaluate(packets: DataFrame, idle_us: int = IDLE_US, every_us: int = REEVALUATE_US) -> DataFrame:
    """A row for every re-evaluation of a flow while it is tracked.

    Evaluation k happens ``k * every_us`` after the first packet, up to the
    flow's expiry, and sees the packets that arrived until then.
    """
    placed = packet_flow_starts(packets, idle_us)
    offset = F.col("ts_us") - F.col("flow_first_us")
    # Evaluation that sees the packet first: the next multiple, at least 1.
    step = F.greatest(F.call_function("div", offset + every_us - 1, F.lit(every_us).cast("bigint")), F.lit(1))
    key = [*FLOW_KEY, "flow_first_us"]
    added = placed.groupBy(*key, step.alias("k")).agg(
        F.count("*").alias("n"), F.sum(F.col("length").cast("bigint")).alias("b"), F.max("ts_us").alias("last")
    )
    next_k = F.lead("k").over(Window.partitionBy(*key).orderBy("k"))
    upto = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    prefix = added.select(
        *key, "k", next_k.alias("next_k"),
        F.sum("n").over(upto).alias("packet_count"), F.sum("b").over(upto).alias("byte_count"),
        F.max("last").over(upto).alias("last_us"),
    )
    # Last evaluation at or before expiry, for the flow's final slice of k.
    expiry = F.call_function(
        "div", F.col("last_us") + idle_us - F.col("flow_first_us"), F.lit(every_us).cast("bigint")
    )
    until = F.coalesce(F.col("next_k") - 1, expiry)
    return (
        prefix.withColumn("k", F.explode(F.sequence(F.col("k"), F.greatest(until, F.col("k")))))
        .withColumn("eval_us", F.col("flow_first_us") + F.col("k") * every_us)
        .withColumn("flow_age_us", F.col("eval_us") - F.col("flow_first_us"))
        .withColumnRenamed("flow_first_us", "first_us")
        .drop("next_k", "k")
    )


def flow_features(flow_rows: DataFrame) -> DataFrame:
    """The feature row handed to the decision operator."""
    seconds = F.col("flow_age_us") / F.lit(1e6)
    return flow_rows.select(
        "flow_id", "packet_count", "byte_count",
        F.call_function("div", F.col("flow_age_us"), F.lit(1000).cast("bigint")).alias("duration_ms"),
        F.when(F.col("flow_age_us") > 0, F.col("packet_count") / seconds).otherwise(F.lit(0.0)).alias("packet_frequency"),
        "protocol", F.col("remote_port").alias("dst_port"),
        F.col("dns_name").isNotNull().alias("has_dns_name"),
        F.col("process_path").isNotNull().alias("has_process_path"),
        "reputation_score",
    )


def enrichable_ip(src: Column | str = "src_ip", dst: Column | str = "dst_ip") -> Column:
    """Address to enrich: the destination if public, else the source."""
    src = F.col(src) if isinstance(src, str) else src
    dst = F.col(dst) if isinstance(dst, str) else dst
    return F.when(ips.is_public(dst), dst).otherwise(src)
