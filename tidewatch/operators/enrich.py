"""Enrichment joins: process, host name, geography, reputation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ip as ips
from tidewatch.operators.flows import enrichable_ip
from tidewatch.plans.lineage import stage
from tidewatch.plans.sliced import asof_join
from tidewatch.plans.versions import in_force, intervals, shared_owner


def asof_pid(flows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Flows with the pid that owned the local port when they started.

    A snapshot replaces the one before it (of the same host, if both tables
    have hosts): a port that is missing from the latest snapshot has no pid,
    and its flow gets local port 0. Of several pids of a port the largest
    counts.
    """
    host = shared_owner(flows, snapshots)
    port = [*host, "port", "protocol"]
    owners = snapshots.groupBy(*port, "snapshot_us").agg(F.max("pid").alias("pid"))
    held = intervals(owners, host, ["port", "protocol", "pid"], "snapshot_us", times=snapshots)
    on = {**{h: h for h in host}, "local_port": "port", "protocol": "protocol"}
    found = in_force(flows.drop("pid"), held, on, "first_us", {"pid": "pid"})
    return found.withColumn("local_port", F.when(F.col("pid").isNotNull(), F.col("local_port")).otherwise(0))


def interval_process(flows: DataFrame, processes: DataFrame) -> DataFrame:
    """Path and start of the process that held the pid (on the flow's host, if
    both tables have hosts) when the flow started."""
    host = shared_owner(flows, processes)
    rows = processes.select(*host, "pid", "start_us", F.col("path").alias("_path"), F.coalesce("end_us", F.lit(2**62)).alias("_end"))
    rows = rows.withColumn("process_start_us", F.col("start_us"))
    found = asof_join(
        flows.drop("process_path", "process_start_us"), rows, [*host, "pid"], "first_us", "start_us",
        ["process_start_us", "_path", "_end"],
    )
    alive = F.col("first_us") < F.col("_end")
    return found.withColumns({
        "process_path": F.when(alive, F.col("_path")), "process_start_us": F.when(alive, F.col("process_start_us")),
    }).drop("_path", "_end")


def asof_ptr(flows: DataFrame, records: DataFrame, ip: str = "remote_ip", at: str = "first_us") -> DataFrame:
    """Host name of the latest passive-DNS record at or before the flow."""
    names = records.select(F.col("ip").alias(ip), "ts_us", F.col("name").alias("dns_name"))
    return asof_join(flows.drop("dns_name"), names, [ip], at, "ts_us", ["dns_name"])


def _with_bits(df: DataFrame, ip: str) -> DataFrame:
    """Add family, IPv4 number and IPv6 digits of an address."""
    v4 = ips.is_v4(ip)
    return df.withColumns({
        "_family": F.when(v4, 4).otherwise(6), "_num": ips.v4_num(ip), "_hex": F.when(~v4, ips.v6_hex(ip)),
    })


def _prefix() -> Column:
    """The first ``_bits`` bits of an address as text comparable per length."""
    bits = F.col("_bits")
    v4 = F.call_function("shiftright", F.col("_num"), F.lit(32) - bits).cast("string")
    whole = F.call_function("div", bits, F.lit(4)).cast("int")
    nibble = F.conv(F.substring("_hex", whole + 1, F.lit(1)), 16, 10).cast("int")
    part = F.when(bits % 4 > 0, F.call_function("shiftright", nibble, (F.lit(4) - bits % 4)).cast("string")).otherwise("")
    return F.when(F.col("_family") == 4, v4).otherwise(F.concat(F.substring("_hex", F.lit(1), whole), part))


def longest_prefix(addresses: DataFrame, networks: DataFrame, values: list[str], ip: str = "ip") -> DataFrame:
    """Distinct matching addresses with ``values`` of their longest network.

    Addresses are expanded to the prefix lengths that occur and hash-joined on
    the prefix, so there is no range comparison of addresses with networks.
    Each value comes from the longest network that has one; equal networks
    resolve to the largest value.
    """
    nets = networks if "_prefix" in networks.columns else with_prefixes(networks, values)
    # At most 33 + 129 rows whatever the network table holds.
    lengths = F.broadcast(nets.select("_family", "_bits").distinct())
    wanted = addresses.select(F.col(ip).alias("_ip")).filter(F.col("_ip").isNotNull()).distinct()
    expanded = _with_bits(wanted, "_ip").join(lengths, "_family").withColumn("_prefix", _prefix())
    hits = expanded.select("_ip", "_family", "_bits", "_prefix").join(nets, ["_family", "_bits", "_prefix"])
    best = hits.groupBy("_ip").agg(*[
        F.max(F.when(F.col(v).isNotNull(), F.struct("_bits", v))).alias(f"_best_{v}") for v in values
    ])
    return best.select(F.col("_ip").alias(ip), *[F.col(f"_best_{v}.{v}").alias(v) for v in values])


def with_prefixes(networks: DataFrame, values: list[str]) -> DataFrame:
    """Networks as ``longest_prefix`` joins them."""
    split = networks.select(
        F.split_part(F.col("network"), F.lit("/"), F.lit(1)).alias("_addr"),
        F.split_part(F.col("network"), F.lit("/"), F.lit(2)).try_cast("int").alias("_bits"), *values,
    )
    return _with_bits(split, "_addr").withColumn("_prefix", _prefix()).select("_family", "_bits", "_prefix", *values)


#: Prefixes of addresses that are moved at once.
PREFIXES = 100_000_000


def in_shares(
    wanted: DataFrame, nets: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame], ip: str, prefixes: int = PREFIXES
) -> DataFrame:
    """``find`` of all addresses, so many at a time that their prefixes are few enough.

    An address is moved once for each prefix length. A share's result is
    written before the next is begun, so the disk holds the prefixes of one.
    """
    lengths = nets.select("_family", "_bits").distinct().count()
    shares = -(-wanted.count() * lengths // prefixes)
    if shares < 2:
        return find(wanted, nets)
    nets, share = stage(nets), F.pmod(F.xxhash64(ip), F.lit(shares))
    return reduce(DataFrame.unionByName, [stage(find(wanted.filter(share == k), nets)) for k in range(shares)])


def lookup_networks(
    countries: DataFrame | None = None, asns: DataFrame | None = None, lists: DataFrame | None = None
) -> DataFrame | None:
    """All network tables as one, so that one pass over addresses serves all."""
    parts = []
    if countries is not None:
        parts.append(countries.select("network", "country_code"))
    if asns is not None:
        parts.append(asns.select("network", "asn"))
    if lists is not None:
        parts.append(lists.filter("is_network").select(F.col("entry").alias("network"), F.col("score").alias("_net_score")))
    if not parts:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def geo_lookup(
    addresses: DataFrame, countries: DataFrame, asns: DataFrame | None = None, ip: str = "ip"
) -> DataFrame:
    """Public addresses (distinct) with country and, if known, ASN."""
    wanted = stage(addresses.select(ip).filter(ips.is_public(ip)).distinct())
    networks = lookup_networks(countries, asns)
    values = [c for c in networks.columns if c != "network"]
    result = in_shares(wanted, with_prefixes(networks, values), lambda own, nets: own.join(longest_prefix(own, nets, values, ip), ip, "left"), ip)
    return result if asns is not None else result.withColumn("asn", F.lit(None).cast("bigint"))


def _exact_scores(lists: DataFrame, ip: str) -> DataFrame:
    exact = lists.filter(~F.col("is_network"))
    return exact.groupBy(F.col("entry").alias(ip)).agg(F.max("score").alias("_exact_score"))


def reputation_lookup(addresses: DataFrame, lists: DataFrame, scored: DataFrame, ip: str = "ip") -> DataFrame:
    """Public addresses (distinct) with their reputation: the scored feed, else
    a listed network, else a listed address, else null."""
    wanted = addresses.select(ip).filter(ips.is_public(ip)).distinct()
    networks = lookup_networks(lists=lists)
    return (
        wanted.join(scored.select(F.col("ip").alias(ip), F.col("score").alias("_csv_score")), ip, "left")
        .join(longest_prefix(wanted, networks, ["_net_score"], ip), ip, "left")
        .join(_exact_scores(lists, ip), ip, "left")
        .select(ip, F.coalesce("_csv_score", "_net_score", "_exact_score").alias("reputation_score"))
    )


ENRICHED = ["dns_name", "process_path", "process_start_us", "country_code", "asn", "reputation_score"]


def attach_enrichment(flows: DataFrame, updates: DataFrame, on: list[str]) -> DataFrame:
    """Overwrite with the non-null values of ``updates`` (one row per key)."""
    fields = [c for c in updates.columns if c in ENRICHED]
    renamed = updates.select(*on, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = flows.join(renamed, on, "left")
    merged = {
        c: F.coalesce(f"_new_{c}", c) if c in flows.columns else F.col(f"_new_{c}") for c in fields
    }
    return joined.withColumns(merged).drop(*[f"_new_{c}" for c in fields])


def address_facts(
    flows: DataFrame, countries: DataFrame | None, asns: DataFrame | None, lists: DataFrame | None,
    scored: DataFrame | None, ip: str = "enrich_ip",
) -> DataFrame | None:
    """Everything known about each distinct address of ``ip``, one row each."""
    networks = lookup_networks(countries, asns, lists)
    if networks is None:
        return None
    values = [c for c in networks.columns if c != "network"]
    wanted = flows.select(ip).filter(F.col(ip).isNotNull()).distinct()
    facts = wanted.join(longest_prefix(wanted, networks, values, ip), ip, "left")
    if lists is None or scored is None:
        return facts.drop("_net_score")
    return (
        facts.join(scored.select(F.col("ip").alias(ip), F.col("score").alias("_csv_score")), ip, "left")
        .join(_exact_scores(lists, ip), ip, "left")
        .withColumn("reputation_score", F.coalesce("_csv_score", "_net_score", "_exact_score"))
        .drop("_csv_score", "_net_score", "_exact_score")
    )


def enrich(
    flows: DataFrame,
    snapshots: DataFrame | None = None,
    processes: DataFrame | None = None,
    ptr: DataFrame | None = None,
    countries: DataFrame | None = None,
    asns: DataFrame | None = None,
    lists: DataFrame | None = None,
    scored: DataFrame | None = None,
) -> DataFrame:
    """All enrichments; a missing dimension leaves its columns null."""
    target = enrichable_ip()
    flows = flows.withColumn("enrich_ip", F.when(ips.is_public(target), target))
    d = flows
    if snapshots is not None:
        d = asof_pid(d, snapshots)
    if processes is not None:
        d = interval_process(d, processes)
    if ptr is not None:
        # Each join moves whole flows; written between them, one's shuffle files are there at a time.
        d = asof_ptr(d if d is flows else stage(d), ptr)
    facts = address_facts(flows, countries, asns, lists, scored)
    if facts is not None:
        # A written table has a known size, so Spark broadcasts it when it is
        # small and otherwise joins by shuffle, splitting hot addresses.
        d = d.join(stage(facts), "enrich_ip", "left")
    types = {"dns_name": "string", "process_path": "string", "process_start_us": "bigint", "country_code": "string",
             "asn": "bigint", "reputation_score": "float", "pid": "bigint"}
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in d.columns}
    return d.withColumns(missing).drop("enrich_ip") if missing else d.drop("enrich_ip")
