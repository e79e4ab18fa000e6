"""Own addresses, gateways, tunnel peers and the exclusion set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import ip as ips
from tidewatch.plans.lineage import stage
from tidewatch.plans.sliced import running
from tidewatch.plans.versions import intervals, not_in_force, shared_owner

# Tunnel interface name prefixes.
TUNNELS = ["utun", "ppp", "tun"]


def broadcast_address(ip: Column, mask: Column) -> Column:
    """ip | ~mask, IPv4 by number and IPv6 hextet by hextet."""
    v4 = ips.v4_text(ips.v4_num(ip).bitwiseOR(ips.v4_num(mask).bitwiseXOR(F.lit(0xFFFFFFFF).cast("bigint"))))
    left, right = ips.v6_hex(ip), ips.v6_hex(mask)
    digits = F.concat(*[
        F.lpad(F.hex(
            F.conv(F.substring(left, 1 + 8 * i, 8), 16, 10).cast("bigint").bitwiseOR(
                F.conv(F.substring(right, 1 + 8 * i, 8), 16, 10).cast("bigint").bitwiseXOR(F.lit(0xFFFFFFFF).cast("bigint")))
        ), 8, "0") for i in range(4)
    ])
    same_family = ips.is_v4(ip) == ips.is_v4(mask)
    return F.when(same_family, F.when(ips.is_v4(ip), v4).otherwise(ips.ip_text(F.unhex(digits))))


def own_addresses_at(interfaces: DataFrame) -> DataFrame:
    """(host, ts_us, ip): interface addresses and their subnet broadcasts of every snapshot."""
    used = interfaces.filter(~F.col("is_loopback") & ~ips.is_unspecified("ip"))
    both = F.array(F.col("ip"), broadcast_address(F.col("ip"), F.col("mask")))
    return used.select("host", "ts_us", F.explode(F.array_compact(both)).alias("ip")).distinct()


def own_addresses(interfaces: DataFrame) -> DataFrame:
    """(host, ip): all addresses a host has ever had."""
    return own_addresses_at(interfaces).select("host", "ip").distinct()


def usable_gateway(gateway: Column) -> Column:
    return gateway.isNotNull() & ~ips.is_loopback(gateway) & ~ips.is_unspecified(gateway)


def _tunnel_gateways(routes: DataFrame) -> DataFrame:
    tunnel = reduce(lambda a, b: a | b, [F.col("iface").startswith(p) for p in TUNNELS])
    peers = routes.filter(F.col("is_up") & tunnel & usable_gateway(F.col("gateway")))
    return peers.select("host", "ts_us", F.col("gateway").alias("ip")).distinct()


def vpn_peers(routes: DataFrame, own: DataFrame) -> DataFrame:
    """(host, ip): gateways of live tunnel routes that are not own addresses."""
    return _tunnel_gateways(routes).select("host", "ip").distinct().join(own, ["host", "ip"], "left_anti")


def default_gateway(routes: DataFrame) -> DataFrame:
    """(host, ts_us, gateway) per snapshot; null when none is usable.

    Among live gateway routes the one to the unspecified destination is
    preferred, else the first. Only when these give nothing do all live routes
    count.
    """
    usable = F.col("is_up") & usable_gateway(F.col("gateway"))
    choice = F.struct(
        F.when(F.col("dst").isin("0.0.0.0", "::"), 0).otherwise(1).alias("p"), F.col("route_order").alias("o"),
        F.col("gateway").alias("g"),
    )
    return routes.groupBy("host", "ts_us").agg(
        F.min(F.when(usable & F.col("is_gateway"), choice)).alias("_flagged"), F.min(F.when(usable, choice)).alias("_any")
    ).select("host", "ts_us", F.coalesce("_flagged.g", "_any.g").alias("gateway"))


def carried_gateway(detected: DataFrame) -> DataFrame:
    """Last known gateway at every snapshot, and how many detections in a row
    have failed since it was known."""
    ordered = running(
        detected, ["host"], "ts_us", [],
        lasts={"effective_gateway": F.col("gateway")},
        sums={"_seen": F.col("gateway").isNotNull().cast("bigint")},
        slice_us=86_400_000_000,
    )
    failed = F.when(F.col("gateway").isNull() & (F.col("_seen") > 0), 1).otherwise(0)
    runs = Window.partitionBy("host", "_seen").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.withColumn("failures", F.sum(failed).over(runs)).drop("_seen")


def exclusion_set(*sources: DataFrame) -> DataFrame:
    """Union of address tables (own, gateway, tunnel peers, configured)."""
    return reduce(lambda a, b: a.unionByName(b), [s.select("ip").filter(F.col("ip").isNotNull()) for s in sources]).distinct()


def own_versions(interfaces: DataFrame) -> DataFrame:
    """(host, ip, valid_from, valid_to): when each address was a host's own."""
    return intervals(own_addresses_at(interfaces), ["host"], ["ip"], times=interfaces)


def gateway_versions(routes: DataFrame) -> DataFrame:
    """(host, ip, valid_from, valid_to) of the default gateway.

    A snapshot without a usable gateway keeps the last known one.
    """
    # So only snapshots that have one end a gateway's time.
    return intervals(default_gateway(routes).select("host", "ts_us", F.col("gateway").alias("ip")), ["host"], ["ip"])


def peer_versions(routes: DataFrame, own: DataFrame) -> DataFrame:
    """(host, ip, valid_from, valid_to) of tunnel peers that were not an own
    address (from ``own_versions``) at the time of the snapshot."""
    peers = not_in_force(_tunnel_gateways(routes), own, {"host": "host", "ip": "ip"}, "ts_us")
    return intervals(peers, ["host"], ["ip"], times=routes)


def exclusion_versions(interfaces: DataFrame, routes: DataFrame) -> DataFrame:
    """What each host excluded from cross-flow counting, and when.

    Own addresses, gateway and tunnel peers count from the snapshot that shows
    them up to the first that doesn't.
    """
    own = stage(own_versions(interfaces))
    return own.unionByName(gateway_versions(routes)).unionByName(peer_versions(routes, own))


def exclude_ips(df: DataFrame, excluded: DataFrame | list[DataFrame] | None, ip: str = "remote_ip", ts: str = "ts_us") -> DataFrame:
    """Rows whose address is neither excluded nor broadcast/multicast.

    ``excluded`` is one or more tables. A table is a set of addresses (ip), or
    has versions (ip, valid_from, valid_to), of which those at the row's time
    ``ts`` count; with a host in it and in the rows, only those of the row's
    host.
    """
    kept = df.filter(~ips.is_infrastructure(ip))
    for table in [excluded] if isinstance(excluded, DataFrame) else excluded or []:
        on = {**{h: h for h in shared_owner(df, table)}, ip: "ip"}
        if "valid_from" in table.columns:
            kept = not_in_force(kept, table, on, ts)
        else:
            listed = table.select(*[F.col(theirs).alias(mine) for mine, theirs in on.items()]).distinct()
            kept = kept.join(listed, list(on), "left_anti")
    return kept
