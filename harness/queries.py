"""Every registered query with its DuckDB counterpart.

A query takes ``(spark, sf_dir)`` and reads whole tables. Scores are compared
as millionths, times as epoch numbers, evidence as counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import adapters as A
from harness import stages as S
from harness.sql import KEY, LOG_IP, build, code, f, infra, not_in_force, num, public, rfc1918, text as sql_text, v6
from tidewatch.functions import ip as ips
from tidewatch.functions import text
from tidewatch.operators import audit, crossflow, decide, detectors, domains, enrich, flows, registry, reports, topology
from tidewatch.plans.lineage import stage, work_folder
from tidewatch.plans.pipeline import actionable, packet_verdicts, score_flows
from tidewatch.schema import DETECTORS, FINDING, FLOW_KEY, VERDICT_KEY
from tidewatch.session import STATE_STORE
from tidewatch.sources import feeds, packets as packet_sources, sinks
from tidewatch.streaming import counters, late, stateful, windows
from tidewatch.streaming.sink import stream_sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if sql.startswith("WITH") else build(sql)
        return fn

    return register


def e6(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double") * 1e6).cast("bigint")


def net_flows(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_pid(flows.flows(A.packets(spark, sf)))


def rich_flows(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich(staged_flows(spark, sf), **dimensions(spark, sf))


def staged_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows written once, for queries that read them several times."""
    return stage(net_flows(spark, sf))


def dimensions(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    networks = A.geo_networks(spark, sf)
    return {
        "processes": A.processes(spark, sf), "ptr": A.ptr_records(spark, sf),
        "countries": networks, "asns": networks,
        "lists": feeds.parse_blocklist(A.feed_lines(spark, sf)),
        "scored": feeds.parse_threat_csv(A.csv_lines(spark, sf), ["line_no"]),
    }


S.cte("own_rows", "SELECT host, ip FROM iface_rows WHERE NOT is_loopback UNION SELECT host, ip | ((1<<hostbits)-1) FROM iface_rows WHERE NOT is_loopback")
S.cte("usable_routes", "SELECT * FROM route_rows WHERE is_up AND gateway<>'127.0.0.1'")
S.cte("gateways", """SELECT s.host, s.ts_us, coalesce(f.gateway, a.gateway) AS gateway FROM (SELECT DISTINCT host, ts_us FROM route_rows) s
LEFT JOIN (SELECT host, ts_us, arg_min(gateway, (dst<>'0.0.0.0', route_order)) AS gateway FROM usable_routes WHERE is_gateway GROUP BY ALL) f USING (host, ts_us)
LEFT JOIN (SELECT host, ts_us, arg_min(gateway, (dst<>'0.0.0.0', route_order)) AS gateway FROM usable_routes GROUP BY ALL) a USING (host, ts_us)""")
S.cte("guarded", f"SELECT order_id, ip, CASE WHEN {v6('ip')} THEN NULL ELSE {num('ip')} END AS n FROM (SELECT order_id, CASE WHEN order_id%3=0 THEN '192.168.' || order_id%256 || '.' || (order_id*13%254+1) WHEN order_id%3=1 THEN '192.168.' || order_id%256 || '.1' ELSE ip END AS ip FROM addr)")


# -- packets and flows -------------------------------------------------------

@query("flow_key", f"SELECT {KEY}, count(*) AS packets, CAST(sum(CASE WHEN first_a THEN 1 ELSE 0 END) AS BIGINT) AS from_a FROM keyed GROUP BY ALL")
def _(spark, sf):
    keyed = flows.with_flow_key(A.packets(spark, sf))
    return keyed.groupBy(*FLOW_KEY).agg(F.count("*").alias("packets"), F.count_if("src_is_a").alias("from_a"))


@query("flow_sessions", f"""SELECT flow_id, {KEY}, first_us, last_us, packet_count, byte_count, src_ip, dst_ip, remote_ip,
  CAST(remote_port AS INTEGER) AS remote_port, CAST(local_port AS INTEGER) AS local_port, flow_age_us FROM net_flows""")
def _(spark, sf):
    return flows.flows(A.packets(spark, sf)).select(
        "flow_id", *FLOW_KEY, "first_us", "last_us", "packet_count", "byte_count", "src_ip", "dst_ip", "remote_ip",
        "remote_port", "local_port", "flow_age_us")


@query("packet_direction", """SELECT local_ip, remote_ip, CAST(remote_port AS INTEGER) AS remote_port, CAST(local_port AS INTEGER) AS local_port, count(*) AS packets FROM (
  SELECT local_ip, CASE WHEN src_ip<>local_ip AND dst_ip=local_ip THEN src_ip ELSE dst_ip END AS remote_ip,
    CASE WHEN src_ip<>local_ip AND dst_ip=local_ip THEN src_port ELSE dst_port END AS remote_port,
    CASE WHEN src_ip<>local_ip AND dst_ip=local_ip THEN dst_port ELSE src_port END AS local_port FROM packets) GROUP BY ALL""")
def _(spark, sf):
    directed = flows.with_remote_endpoint(flows.with_local_port(A.packets(spark, sf)))
    return directed.groupBy("local_ip", "remote_ip", "remote_port", "local_port").agg(F.count("*").alias("packets"))


@query("packet_flow_ids", f"SELECT {KEY}, ts_us, min(ts_us) OVER (PARTITION BY {KEY}, run) AS flow_first_us FROM marked")
def _(spark, sf):
    return flows.packet_flow_starts(A.packets(spark, sf)).select(*FLOW_KEY, "ts_us", "flow_first_us")


@query("reevaluations", f"""SELECT e.flow_id, e.eval_us, e.eval_us-e.first_us AS flow_age_us, count(*) AS packet_count, CAST(sum(m.length) AS BIGINT) AS byte_count
FROM (SELECT *, unnest(generate_series(first_us+1000000, last_us+5000000, 1000000)) AS eval_us FROM (SELECT flow_id, {KEY}, first_us, last_us FROM bare_flows)) e
JOIN marked m USING (a_ip, a_port, b_ip, b_port, protocol) WHERE m.ts_us BETWEEN e.first_us AND least(e.eval_us, e.last_us) GROUP BY ALL""")
def _(spark, sf):
    rows = flows.reevaluate(A.packets(spark, sf))
    return rows.select(flows.flow_id(FLOW_KEY).alias("flow_id"), "eval_us", "flow_age_us", "packet_count", "byte_count")


@query("flow_features", f"""SELECT flow_id, packet_count, byte_count, flow_age_us//1000 AS duration_ms, {S.e6(S.RATE)} AS frequency_e6, protocol,
  CAST(remote_port AS INTEGER) AS dst_port, dns_name IS NOT NULL AS has_dns_name, process_path IS NOT NULL AS has_process_path, {S.e6("reputation_score")} AS reputation_e6 FROM rich_flows""")
def _(spark, sf):
    return flows.flow_features(rich_flows(spark, sf)).withColumns({
        "frequency_e6": e6("packet_frequency"), "reputation_e6": e6("reputation_score")
    }).drop("packet_frequency", "reputation_score")


@query("decoded_frames", """SELECT ts_us, CASE WHEN four THEN src_ip ELSE CASE WHEN position(':' IN src_ip)>0 THEN src_ip ELSE '::ffff:' || src_ip END END AS src_ip,
  CASE WHEN four THEN dst_ip ELSE CASE WHEN position(':' IN dst_ip)>0 THEN dst_ip ELSE '::ffff:' || dst_ip END END AS dst_ip,
  CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port, protocol, length FROM (
  SELECT *, position(':' IN src_ip)+position(':' IN dst_ip)=0 AS four FROM packets) WHERE length%10<>7""")
def _(spark, sf):
    # Each packet becomes a frame; every length ending in 7 is cut short.
    p = A.packets(spark, sf)
    h = lambda c, digits: F.lpad(F.hex(c.cast("bigint")), digits, "0")
    four = ips.is_v4("src_ip") & ips.is_v4("dst_ip")
    ports = F.concat(h(F.col("src_port"), 4), h(F.col("dst_port"), 4))
    v4 = F.concat(F.lit("00" * 12 + "08004500"), h(F.col("length"), 4), F.lit("0000000040"), h(F.col("protocol"), 2), F.lit("0000"),
                  h(ips.v4_num("src_ip"), 8), h(ips.v4_num("dst_ip"), 8), ports)
    v6_ = F.concat(F.lit("00" * 12 + "86dd60000000"), h(F.col("length"), 4), h(F.col("protocol"), 2), F.lit("40"),
                   ips.ip_hex("src_ip"), ips.ip_hex("dst_ip"), ports)
    whole = F.when(four, v4).otherwise(v6_)
    cut = F.when(F.col("length") % 10 == 7, F.substring(whole, 1, 40)).otherwise(whole)
    return packet_sources.decode_frames(stage(p.select("ts_us", F.unhex(cut).alias("frame"))))


# -- addresses ---------------------------------------------------------------

@query("address_classes", f"SELECT order_id, ip, {infra('ip')} AS infrastructure, {public('ip')} AS public, {rfc1918('ip')} AS private FROM addr")
def _(spark, sf):
    return A.addresses(spark, sf).select(
        "order_id", "ip", ips.is_infrastructure("ip").alias("infrastructure"), ips.is_public("ip").alias("public"),
        ips.is_rfc1918("ip").alias("private"))


@query("address_blobs", f"""SELECT order_id, ip AS text, CASE WHEN {v6("ip")} THEN '20010db8' || lpad(regexp_extract(ip,'^2001:db8:([0-9a-f]+)::1$',1),4,'0') || '00000000000000000001'
  ELSE '00000000000000000000ffff' || lpad(lower(hex(n)),8,'0') END AS blob_hex, CASE WHEN {v6("ip")} THEN 6 ELSE 4 END AS family FROM (
  SELECT order_id, n, CASE WHEN ip='2001:db8:0::1' THEN '2001:db8::1' ELSE ip END AS ip FROM addr WHERE ip<>'2001:db8:0::1')
UNION ALL SELECT order_id, '2001:db8::1', '20010db8000000000000000000000001', 6 FROM addr WHERE ip='2001:db8:0::1'""")
def _(spark, sf):
    a = A.addresses(spark, sf)
    return a.select("order_id", ips.ip_text(ips.ip_blob("ip")).alias("text"), ips.ip_hex("ip").alias("blob_hex"),
                    F.when(ips.is_v4("ip"), 4).otherwise(6).alias("family"))


@query("block_validation", f"""SELECT order_id, CASE WHEN ttl<30000 THEN 'TtlTooSmall' WHEN ttl>86400000 THEN 'TtlTooLarge' WHEN {v6("ip")} THEN NULL
  WHEN n>>24=127 THEN 'LoopbackIp' WHEN n=4294967295 THEN 'BroadcastIp' WHEN n>>28=14 THEN 'MulticastIp' WHEN n>>16=43518 THEN 'LinkLocalIp' WHEN n=0 THEN 'UnspecifiedIp' END AS validation_error
  FROM (SELECT *, order_id*7919%100000*1000 AS ttl FROM addr)""")
def _(spark, sf):
    ttl = F.pmod(F.col("order_id") * 7919, F.lit(100000)) * 1000
    return A.addresses(spark, sf).select("order_id", ips.validation_error("ip", ttl).alias("validation_error"))


@query("block_guard", f"""SELECT order_id, CASE WHEN n IN (SELECT ip FROM own_rows) THEN 'remote is own IP' WHEN ip IN (SELECT gateway FROM gateways) THEN 'remote is default gateway'
  WHEN {infra("ip")} THEN 'remote is broadcast/multicast' WHEN NOT {v6("ip")} AND n>>16=43518 THEN 'remote is link-local' END AS skip_reason FROM guarded""")
def _(spark, sf):
    a = guarded_addresses(spark, sf)
    gateways = topology.default_gateway(A.routes(spark, sf)).select(F.col("gateway").alias("ip")).filter("ip IS NOT NULL")
    own = topology.own_addresses(A.interfaces(spark, sf))
    return decide.block_guard(a, own, gateways, "ip").select("order_id", "skip_reason")


def guarded_addresses(spark, sf):
    """Addresses with private ones of the supplier hosts mixed in."""
    key = F.col("order_id")
    local = F.concat(F.lit("192.168."), (key % 256).cast("string"), F.lit("."), (key * 13 % 254 + 1).cast("string"))
    return A.addresses(spark, sf).withColumn(
        "ip", F.when(key % 3 == 0, local).when(key % 3 == 1, F.concat(F.lit("192.168."), (key % 256).cast("string"), F.lit(".1"))).otherwise(F.col("ip")))


# -- topology ----------------------------------------------------------------

@query("own_addresses", f"SELECT host, {sql_text('ip')} AS ip FROM own_rows")
def _(spark, sf):
    return topology.own_addresses(A.interfaces(spark, sf))


@query("vpn_peers", f"SELECT DISTINCT host, gateway AS ip FROM usable_routes r WHERE tunnel AND NOT EXISTS (SELECT 1 FROM own_rows o WHERE o.host=r.host AND o.ip={num('r.gateway')})")
def _(spark, sf):
    return topology.vpn_peers(A.routes(spark, sf), topology.own_addresses(A.interfaces(spark, sf)))


@query("default_gateway", "SELECT host, ts_us, gateway FROM gateways")
def _(spark, sf):
    return topology.default_gateway(A.routes(spark, sf))


@query("carried_gateway", """SELECT host, ts_us, gateway, last_value(gateway IGNORE NULLS) OVER w AS effective_gateway,
  CASE WHEN last_value(gateway IGNORE NULLS) OVER w IS NULL THEN 0 ELSE CAST(round((ts_us - max(CASE WHEN gateway IS NOT NULL THEN ts_us END) OVER w)/5000000) AS BIGINT) END AS failures
FROM gateways WINDOW w AS (PARTITION BY host ORDER BY ts_us ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return topology.carried_gateway(topology.default_gateway(A.routes(spark, sf)))


@query("exclude_ips", f"""SELECT order_id, ip FROM guarded WHERE NOT {infra("ip")} AND (n IS NULL OR n NOT IN (SELECT ip FROM own_rows)) AND ip NOT IN (SELECT gateway FROM gateways WHERE gateway IS NOT NULL)""")
def _(spark, sf):
    gateways = topology.default_gateway(A.routes(spark, sf)).select(F.col("gateway").alias("ip"))
    own = topology.own_addresses(A.interfaces(spark, sf))
    return topology.exclude_ips(guarded_addresses(spark, sf), topology.exclusion_set(own, gateways), "ip").select("order_id", "ip")


# -- text --------------------------------------------------------------------

@query("host_functions", f"""SELECT h.page_id, h.dns_name, CAST({S.LABELS.format("h.dns_name")} AS INTEGER) AS labels, CAST({S.LONGEST.format("h.dns_name")} AS INTEGER) AS longest,
  {S.SUB.format("h.dns_name")} AS subdomain, lower(regexp_extract(h.dns_name,'[^.]*$')) AS tld, {S.LITERAL.format("h.dns_name")} AS ip_literal,
  list_contains(regexp_split_to_array(lower(h.dns_name),'[.-]'),'blog') AS has_blog, CAST(round(ent*1e6) AS BIGINT) AS entropy_e6 FROM host_names h JOIN name_entropy USING (dns_name)""")
def _(spark, sf):
    n = F.col("dns_name")
    return A.hosts(spark, sf).select(
        "page_id", "dns_name", text.label_count(n).alias("labels"), text.longest_label(n).alias("longest"),
        text.subdomain(n).alias("subdomain"), text.tld(n).alias("tld"), text.has_ip_literal(n).alias("ip_literal"),
        text.has_label(n, "blog").alias("has_blog"), e6(text.shannon_entropy(n)).alias("entropy_e6"))


@query("document_entropy", f"""SELECT doc_id, CAST(round(-sum(c/n*log2(c/n))*1e4) AS BIGINT) AS entropy_e4 FROM (
  SELECT doc_id, b, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY doc_id, b) GROUP BY doc_id""")
def _(spark, sf):
    return A.table(spark, sf, "documents").filter(F.octet_length("text") > 0).select(
        "doc_id", F.round(text.shannon_entropy("text") * 1e4).cast("bigint").alias("entropy_e4"))


@query("app_paths", f"""SELECT user_id AS pid, path, CASE WHEN path='' THEN 'Unknown app' ELSE {S.BASE.format("path")} END AS app,
  nullif(regexp_extract(path, '(?i)^(.*?/[^/]+\\.app)/', 1), '') AS bundle, CAST(len(path)>0 AND (path LIKE '/tmp/%' OR path LIKE '/private/tmp/%') AS BOOLEAN) AS in_temp
FROM (SELECT pid AS user_id, path FROM proc)""")
def _(spark, sf):
    p = A.processes(spark, sf)
    return p.select("pid", "path", text.app_name("path").alias("app"), text.app_bundle("path").alias("bundle"),
                    text.starts_with_any("path", detectors.TEMP_DIRS).alias("in_temp"))


@query("domain_match", """SELECT DISTINCT dns_name FROM host_names WHERE lower(dns_name)='example.com' OR lower(dns_name) LIKE '%.example.com' OR lower(dns_name) LIKE '%.evil.xyz'
  OR lower(dns_name)='blog' OR lower(dns_name) LIKE '%.blog' OR list_contains(regexp_split_to_array(lower(dns_name),'[.-]'),'blog')""")
def _(spark, sf):
    entries = spark.createDataFrame([("Example.com",), ("evil.xyz",), ("blog",)], "entry string")
    return domains.domain_match(A.hosts(spark, sf), entries)


# -- enrichment --------------------------------------------------------------

@query("asof_pid", "SELECT flow_id, CAST(local_port AS INTEGER) AS local_port, pid FROM pid_flows")
def _(spark, sf):
    found = enrich.asof_pid(flows.flows(A.packets(spark, sf)), A.port_pids(spark, sf))
    return found.select("flow_id", "local_port", "pid")


@query("interval_process", "SELECT flow_id, pid, process_path, process_start_us FROM proc_flows")
def _(spark, sf):
    found = enrich.interval_process(net_flows(spark, sf), A.processes(spark, sf))
    return found.select("flow_id", "pid", "process_path", "process_start_us")


@query("asof_ptr", "SELECT f.flow_id, p.name AS dns_name FROM net_flows f ASOF LEFT JOIN ptr p ON f.remote_ip=p.ip AND f.first_us>=p.ts_us")
def _(spark, sf):
    return enrich.asof_ptr(net_flows(spark, sf), A.ptr_records(spark, sf)).select("flow_id", "dns_name")


@query("geo_lookup", f"""SELECT q.ip, arg_max(t.country_code, (t.plen, t.country_code)) AS country_code, arg_max(t.asn, (t.plen, t.asn)) AS asn
FROM (SELECT DISTINCT ip, n FROM addr WHERE NOT {v6("ip")} AND {public("ip")}) q LEFT JOIN nets t ON q.n BETWEEN t.lo AND t.hi GROUP BY q.ip
UNION ALL SELECT q.ip, max(s.country_code), max(s.asn) FROM (SELECT DISTINCT ip FROM addr WHERE {v6("ip")}) q LEFT JOIN nets6 s ON regexp_extract(q.ip,'^(.*)::1$',1)=s.prefix GROUP BY q.ip""")
def _(spark, sf):
    networks = A.geo_networks(spark, sf)
    return enrich.geo_lookup(A.addresses(spark, sf), networks, networks)


@query("reputation_lookup", f"SELECT ip, {S.e6('reputation_score')} AS reputation_e6 FROM feed_scores")
def _(spark, sf):
    d = dimensions(spark, sf)
    found = enrich.reputation_lookup(A.addresses(spark, sf), d["lists"], d["scored"])
    return found.select("ip", e6("reputation_score").alias("reputation_e6"))


@query("enriched_flows", f"SELECT flow_id, dns_name, process_path, country_code, asn, {S.e6('reputation_score')} AS reputation_e6 FROM rich_flows")
def _(spark, sf):
    return rich_flows(spark, sf).select("flow_id", "dns_name", "process_path", "country_code", "asn", e6("reputation_score").alias("reputation_e6"))


@query("attach_enrichment", """SELECT verdict_id, CASE WHEN verdict_id%3=0 THEN 'new' || verdict_id ELSE dns_name END AS dns_name, country_code FROM verd""")
def _(spark, sf):
    v = A.verdicts(spark, sf).select("verdict_id", "dns_name", "country_code")
    vid = F.col("verdict_id")
    updates = A.verdicts(spark, sf).select(
        "verdict_id", F.when(vid % 3 == 0, F.concat(F.lit("new"), vid.cast("string"))).alias("dns_name"),
        F.lit(None).cast("string").alias("country_code"))
    return enrich.attach_enrichment(v, updates, ["verdict_id"])


@query("blocklist_feed", f"""SELECT DISTINCT CASE WHEN m=0 THEN {sql_text("net")} || '/' || plen ELSE {sql_text("n")} END AS entry, m=0 AS is_network FROM feed WHERE m IN (0,3,4)""")
def _(spark, sf):
    return feeds.parse_blocklist(A.feed_lines(spark, sf)).select("entry", "is_network")


@query("threat_csv_feed", f"SELECT {sql_text('n')} AS ip, {S.e6('score')} AS score_e6, 'scanner' AS category FROM csv_feed")
def _(spark, sf):
    return feeds.parse_threat_csv(A.csv_lines(spark, sf), ["line_no"]).select("ip", e6("score").alias("score_e6"), "category")


# -- cross-flow --------------------------------------------------------------

@query("scan_counts", """SELECT flow_id, count(*) OVER w AS scan_count, CAST(sum(CASE WHEN protocol=17 AND remote_port=53 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS dns_count
FROM conn_marked WINDOW w AS (PARTITION BY pid0, remote_ip, run ORDER BY ts_us RANGE UNBOUNDED PRECEDING)""")
def _(spark, sf):
    # Equal times count together, as for a probe at that time.
    events = crossflow.connections(staged_flows(spark, sf))
    probes = events.select("flow_id", "pid", F.col("remote_ip").alias("ip"), "ts_us")
    return crossflow.scan_counts(events, probes).select("flow_id", "scan_count", "dns_count")


@query("beacon_stats", f"SELECT flow_id, side, CAST(beacon_n AS BIGINT) AS beacon_n, {S.e6('mean_s')} AS mean_e6, {S.e6('cv')} AS cv_e6 FROM beacon_at WHERE beacon_n>0")
def _(spark, sf):
    f_ = staged_flows(spark, sf)
    events = crossflow.connections(f_)
    ends = f_.select("flow_id", F.col("eval_us").alias("ts_us"), "protocol", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("a_ip").alias("ip"), F.col("a_port").alias("port")),
        F.struct(F.lit("b").alias("side"), F.col("b_ip").alias("ip"), F.col("b_port").alias("port")))).alias("e")
    ).select("flow_id", "ts_us", "protocol", "e.*")
    return crossflow.beacon_stats(events, ends).filter("beacon_n > 0").select(
        "flow_id", "side", "beacon_n", e6("beacon_mean_s").alias("mean_e6"), e6("beacon_cv").alias("cv_e6"))


@query("pid_diversity", "SELECT f.flow_id, coalesce(s.distinct_ips,0) AS distinct_ips, coalesce(s.conns,0) AS pid_connections, coalesce(s.conns,0)>=512 AS at_cap FROM net_flows f LEFT JOIN spread_at s USING (flow_id) WHERE f.pid IS NOT NULL")
def _(spark, sf):
    f_ = staged_flows(spark, sf)
    probes = f_.select("flow_id", "pid", F.col("eval_us").alias("ts_us"))
    return crossflow.pid_diversity(crossflow.connections(f_), probes).select("flow_id", "distinct_ips", "pid_connections", "at_cap")


@query("crossflow_lookup", f"""SELECT flow_id, scan_a, dns_a, scan_b, dns_b, CAST(coalesce(n_a,0)+coalesce(n_b,0) AS BIGINT) AS beacon_n,
  {S.e6("coalesce(cv_a,cv_b)")} AS cv_e6, distinct_ips FROM cross_at""")
def _(spark, sf):
    f_ = staged_flows(spark, sf)
    return counters_view(crossflow.crossflow_lookup(f_, crossflow.connections(f_)))


def counters_view(found: DataFrame) -> DataFrame:
    return found.select(
        "flow_id", "scan_a", "dns_a", "scan_b", "dns_b",
        (F.coalesce("beacon_a.beacon_n", F.lit(0)) + F.coalesce("beacon_b.beacon_n", F.lit(0))).alias("beacon_n"),
        e6(F.coalesce("beacon_a.beacon_cv", "beacon_b.beacon_cv")).alias("cv_e6"),
        F.coalesce("diversity.distinct_ips", F.lit(0)).alias("distinct_ips"))


# -- hosts of a fleet, and what changes with time ------------------------------

def fleet_flows(spark, sf):
    return stage(A.with_fleet_pid(flows.flows(A.fleet_packets(spark, sf), extra_keys=["host"])))


def fleet_excluded(spark, sf):
    return topology.exclusion_versions(A.fleet_interfaces(spark, sf), A.fleet_routes(spark, sf))


@query("exclusion_versions", "SELECT host, ip, valid_from, valid_to FROM fleet_excluded")
def _(spark, sf):
    return fleet_excluded(spark, sf)


@query("excluded_connections", f"SELECT host, flow_id, remote_ip, first_us AS ts_us FROM fleet_flows f WHERE NOT {infra('remote_ip')} AND {not_in_force('f', 'remote_ip', 'first_us')}")
def _(spark, sf):
    return crossflow.connections(fleet_flows(spark, sf), fleet_excluded(spark, sf)).select("host", "flow_id", "remote_ip", "ts_us")


def _held(name: str) -> str:
    return f"EXISTS (SELECT 1 FROM fleet_{name}_versions x WHERE x.host=f.host AND x.ip=f.remote_ip AND f.eval_us>=x.valid_from AND f.eval_us<coalesce(x.valid_to, 9000000000000000000))"


@query("block_guard_versions", f"""SELECT flow_id, CASE WHEN {_held("own")} THEN 'remote is own IP' WHEN {_held("gateway")} THEN 'remote is default gateway'
  WHEN {infra("remote_ip")} THEN 'remote is broadcast/multicast' WHEN NOT {v6("remote_ip")} AND {num("remote_ip")}>>16=43518 THEN 'remote is link-local' END AS skip_reason FROM fleet_flows f""")
def _(spark, sf):
    own, gateways = topology.own_versions(A.fleet_interfaces(spark, sf)), topology.gateway_versions(A.fleet_routes(spark, sf))
    return decide.block_guard(fleet_flows(spark, sf), own, gateways).select("flow_id", "skip_reason")


@query("asof_pid_hosts", "SELECT flow_id, host, CAST(local_port AS INTEGER) AS local_port, pid FROM fleet_pid_flows")
def _(spark, sf):
    return enrich.asof_pid(fleet_flows(spark, sf), A.fleet_port_pids(spark, sf)).select("flow_id", "host", "local_port", "pid")


@query("enrich_all", f"""SELECT flow_id, host, CAST(local_port AS INTEGER) AS local_port, pid, process_path, process_start_us, dns_name, country_code, asn,
  {S.e6('reputation_score')} AS reputation_e6 FROM fleet_rich_flows""")
def _(spark, sf):
    found = enrich.enrich(fleet_flows(spark, sf), **dimensions(spark, sf) | {
        "snapshots": A.fleet_port_pids(spark, sf), "processes": A.fleet_processes(spark, sf)})
    return found.select("flow_id", "host", "local_port", "pid", "process_path", "process_start_us", "dns_name", "country_code", "asn",
                        e6("reputation_score").alias("reputation_e6"))


@query("crossflow_excluded", f"""SELECT flow_id, scan_a, dns_a, scan_b, dns_b, CAST(coalesce(n_a,0)+coalesce(n_b,0) AS BIGINT) AS beacon_n,
  {S.e6("coalesce(cv_a,cv_b)")} AS cv_e6, distinct_ips FROM fleet_cross_at""")
def _(spark, sf):
    f_, excluded = fleet_flows(spark, sf), stage(fleet_excluded(spark, sf))
    return counters_view(crossflow.crossflow_lookup(f_, crossflow.connections(f_, excluded), excluded))


# -- detectors and decisions -------------------------------------------------

def finding_view(df: DataFrame, detector: str) -> DataFrame:
    p = DETECTORS[detector]
    return df.select("flow_id", e6(f"{p}_score").alias("score_e6"), e6(f"{p}_confidence").alias("confidence_e6"),
                     F.col(f"{p}_severity").alias("severity"), F.col(f"{p}_hits").alias("hits"))


def _register_detector(name: str, sql_cte: str, detector: str, score) -> None:
    @query(name, S.detector_sql(sql_cte))
    def _(spark, sf):
        rich = rich_flows(spark, sf)
        return finding_view(score(stage(rich) if detector == "CrossFlow" else rich), detector)


def _cross(f_: DataFrame) -> DataFrame:
    return crossflow.score_cross_flow(crossflow.crossflow_lookup(f_, crossflow.connections(f_)))


for _name, _cte, _detector, _score in (
    ("score_dns", "d1", "DnsAnalyzer", detectors.score_dns),
    ("score_process", "d2", "ProcessCorrelator", detectors.score_process),
    ("score_ip_reputation", "d4", "IpReputation", detectors.score_ip_reputation),
    ("score_dns_tunnel", "d5", "DnsTunnelDetector", detectors.score_dns_tunnel),
    ("score_cross_flow", "d6", "CrossFlow", _cross),
):
    _register_detector(_name, _cte, _detector, _score)

# Line items as flows, so that every traffic-shape tier occurs.
_SHAPES = """SELECT l_orderkey*10+l_linenumber AS flow_id, CAST(l_quantity AS BIGINT)*(l_linenumber*9+l_suppkey%7) AS packet_count,
  CAST(floor(l_extendedprice) AS BIGINT)*(1+l_partkey%40) AS byte_count, CAST((l_suppkey%9)*250000 AS BIGINT) AS flow_age_us,
  CASE l_linenumber%3 WHEN 0 THEN 53 WHEN 1 THEN 443 ELSE 8080 END AS remote_port, CASE WHEN l_partkey%2=0 THEN 6 ELSE 17 END AS protocol FROM lineitem"""


@query("score_flow_behavior", "WITH rich_flows AS (" + _SHAPES + "), d3 AS (" + S.CTES["d3"] + f") SELECT flow_id, {S.e6('score')} AS score_e6, {S.e6('conf')} AS confidence_e6, ['Low','Medium','High','Critical'][sev+1] AS severity, CAST(hits AS INTEGER) AS hits FROM d3")
def _(spark, sf):
    line = A.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("flow_id"),
        (F.col("l_quantity").cast("bigint") * (F.col("l_linenumber") * 9 + F.col("l_suppkey") % 7)).alias("packet_count"),
        (F.floor("l_extendedprice").cast("bigint") * (1 + F.col("l_partkey") % 40)).alias("byte_count"),
        (F.col("l_suppkey") % 9 * 250000).cast("bigint").alias("flow_age_us"),
        F.when(F.col("l_linenumber") % 3 == 0, 53).when(F.col("l_linenumber") % 3 == 1, 443).otherwise(8080).alias("remote_port"),
        F.when(F.col("l_partkey") % 2 == 0, 6).otherwise(17).alias("protocol"))
    return finding_view(detectors.score_flow_behavior(line), "FlowBehavior")


@query("score_feed_reputation", f"WITH feed_flows AS ({build('SELECT ip, reputation_score FROM feed_scores')}), rich_flows AS (SELECT ip AS flow_id, '10.0.0.1' AS a_ip, ip AS b_ip, reputation_score FROM feed_flows), d4 AS ({S.CTES['d4']}) SELECT flow_id, {S.e6('score')} AS score_e6, {S.e6('conf')} AS confidence_e6, ['Low','Medium','High','Critical'][sev+1] AS severity, CAST(hits AS INTEGER) AS hits FROM d4")
def _(spark, sf):
    d = dimensions(spark, sf)
    found = enrich.reputation_lookup(A.addresses(spark, sf), d["lists"], d["scored"])
    rows = found.select(F.col("ip").alias("flow_id"), F.lit("10.0.0.1").alias("a_ip"), F.col("ip").alias("b_ip"), "reputation_score")
    return finding_view(detectors.score_ip_reputation(rows), "IpReputation")


def decided(spark, sf):
    return packet_verdicts(A.packets(spark, sf), prepare=A.with_pid, **dimensions(spark, sf))


@query("packet_verdicts", S.DECIDED)
def _(spark, sf):
    return decided(spark, sf).select("flow_id", "remote_ip", "verdict", e6("composite_score").alias("composite_e6"),
                                     "detectors_scoring", "override", "top_detector", "ttl_ms")


@query("verdicts_by_country", f"SELECT country_code, count(*) AS count FROM ({S.DECIDED}) JOIN (SELECT flow_id, country_code FROM ({build('SELECT flow_id, country_code FROM rich_flows')})) USING (flow_id) WHERE verdict<>'Allow' AND country_code IS NOT NULL GROUP BY country_code")
def verdicts_by_country(spark, sf):
    """The flagship: packets to flows to verdicts to a report."""
    return reports.threat_countries(decided(spark, sf))


@query("verdict_rows", f"""SELECT md5(a_ip || '|' || a_port || '|' || b_ip || '|' || b_port || '|' || protocol || '|' || verdict) AS verdict_id, eval_us//1000 AS ts_ms, flow_id, verdict,
  {S.e6("total")} AS composite_e6, {S.TTL} AS ttl_ms, flow_age_us//1000 AS flow_age_ms, packet_count AS pkt_count FROM decided JOIN rich_flows USING (flow_id) WHERE verdict<>'Allow'""")
def _(spark, sf):
    return sinks.verdict_rows(stage(decided(spark, sf))).select(
        "verdict_id", "ts_ms", "flow_id", "verdict", e6("composite_score").alias("composite_e6"), "ttl_ms", "flow_age_ms", "pkt_count")


@query("finding_counts", f"""SELECT detector_id, count(*) AS runs, CAST(sum(CASE WHEN score>0 THEN 1 ELSE 0 END) AS BIGINT) AS findings FROM (
  {" UNION ALL ".join(f"SELECT '{name}' AS detector_id, score FROM d{i}" for i, name in enumerate(DETECTORS, 1))}) GROUP BY 1""")
def _(spark, sf):
    scored = stage(score_flows(stage(rich_flows(spark, sf))))
    return decide.finding_rows(scored).groupBy("detector_id").agg(
        F.count("*").alias("runs"), F.count_if(F.col("score") > 0).alias("findings"))


_W = f"CASE status WHEN 'Completed' THEN {f(1.0)} WHEN 'TimedOut' THEN {f(.1)} ELSE {f(0.0)} END"
S.cte("long_decided", f"""SELECT *, {" + ".join(f"a{i}" for i in range(6))} AS raw FROM (SELECT verdict_id,
  {", ".join(f"max(CASE WHEN ord={i} THEN score*confidence*{_W} END) AS a{i}" for i in range(6))},
  sum(CASE WHEN score*confidence*{_W}>0 THEN 1 ELSE 0 END) AS n, bool_or(status='Completed' AND score*confidence>={f(.85)}) AS override,
  max(CASE WHEN status='Completed' AND score>0 THEN sev END) AS worst,
  arg_max(CASE WHEN status='Completed' THEN detector_id END, CASE WHEN status='Completed' THEN (score*confidence, ord) END) AS top_detector FROM finds GROUP BY verdict_id)""")


@query("decide_findings", f"""SELECT verdict_id, {S.e6(f"least(raw,{f(1.0)})")} AS composite_e6, CAST(n AS INTEGER) AS detectors_scoring, override, top_detector,
  CASE WHEN raw>={f(.7)} AND (override OR n>=2) THEN 'Block' WHEN raw>={f(.3)} THEN 'Alert' ELSE 'Allow' END AS verdict,
  CASE WHEN raw>={f(.7)} AND (override OR n>=2) THEN CAST(CASE coalesce(worst,1) WHEN 3 THEN 3600000 WHEN 2 THEN 900000 WHEN 1 THEN 300000 ELSE 60000 END AS BIGINT) END AS ttl_ms FROM long_decided""")
def _(spark, sf):
    d = decide.decide_findings(A.findings(spark, sf), "verdict_id")
    return d.select("verdict_id", e6("composite_score").alias("composite_e6"), "detectors_scoring", "override", "top_detector", "verdict", "ttl_ms")


@query("top_detector", "SELECT verdict_id, arg_max(detector_id, (score*confidence, ord)) AS top_detector FROM finds WHERE status='Completed' GROUP BY verdict_id")
def _(spark, sf):
    return decide.top_detector(A.findings(spark, sf))


_CHAIN = f"""WITH RECURSIVE dec AS ({S.DECIDED}), fl AS ({build("SELECT flow_id, eval_us FROM net_flows")}),
 b AS (SELECT remote_ip, eval_us, min((flow_id, ttl_ms)) AS r FROM dec JOIN fl USING (flow_id) WHERE verdict='Block' GROUP BY ALL),
 nodes AS (SELECT remote_ip, eval_us, r[1] AS flow_id, eval_us+r[2]*1000 AS until FROM b),
 jumps AS (SELECT n.*, m.eval_us AS nxt FROM nodes n ASOF LEFT JOIN nodes m ON n.remote_ip=m.remote_ip AND n.until<=m.eval_us),
 chain AS (SELECT j.* FROM jumps j JOIN (SELECT remote_ip, min(eval_us) AS eval_us FROM nodes GROUP BY 1) s USING (remote_ip, eval_us)
   UNION ALL SELECT j.* FROM chain c JOIN jumps j ON j.remote_ip=c.remote_ip AND j.eval_us=c.nxt)
"""


@query("actionable", _CHAIN + "SELECT flow_id, 'Block' AS verdict FROM chain UNION ALL SELECT flow_id, 'Alert' FROM dec WHERE verdict='Alert'")
def _(spark, sf):
    return actionable(stage(decided(spark, sf).select("flow_id", "remote_ip", "eval_us", "ttl_ms", "verdict"))).select("flow_id", "verdict")


# Squeezed events end here.
_END_MS = 1_000_000


@query("enforced_blocks", _CHAIN + f"""SELECT ip_text, CAST(ts_ms+ttl_ms-{_END_MS} AS BIGINT) AS remaining_ms FROM (
  SELECT remote_ip AS ip_text, max(eval_us)//1000 AS ts_ms, arg_max(until-eval_us, eval_us)//1000 AS ttl_ms FROM chain GROUP BY 1) WHERE ts_ms+ttl_ms>{_END_MS}""")
def _(spark, sf):
    """Packets to verdicts to carried-out Blocks to the stored log to the addresses that are blocked."""
    rows = decided(spark, sf).select("flow_id", "remote_ip", "eval_us", "ttl_ms", "reason", "composite_score", *VERDICT_KEY)
    path = f"{work_folder(spark)}/enforcement"
    sinks.write_enforcement(sinks.enforcement_rows(actionable(stage(rows))), path)
    log = sinks.read_table(spark, path)
    return audit.active_blocks(log, _END_MS).select("ip_text", "remaining_ms")


@query("custom_detector", f"SELECT verdict_id, CASE WHEN composite_score>0.9 THEN 'Errored' ELSE 'Completed' END AS status, CASE WHEN composite_score>0.9 THEN 0 ELSE {S.e6('CAST(composite_score AS FLOAT)')} END AS score_e6 FROM verd")
def _(spark, sf):
    def fragile(row):
        if row["composite_score"] > 0.9:
            raise ValueError("too large")
        return {"score": row["composite_score"], "confidence": 1.0}

    own = registry.Detectors()
    own.register_row_detector("Fragile", fragile, ["composite_score"])
    return own.findings(A.verdicts(spark, sf), "verdict_id").select("verdict_id", "status", e6("score").alias("score_e6"))


# -- audit tables ------------------------------------------------------------

@query("latest_verdicts", """SELECT verdict_id, a_ip, a_port, b_ip, verdict, ts_ms, reason FROM (SELECT *, row_number() OVER (PARTITION BY a_ip, a_port, b_ip, b_port, protocol, verdict ORDER BY ts_ms DESC, verdict_id DESC) AS rn FROM verd) WHERE rn=1""")
def _(spark, sf):
    return audit.latest_verdicts(A.verdicts(spark, sf)).select("verdict_id", "a_ip", "a_port", "b_ip", "verdict", "ts_ms", "reason")


_LAST = "SELECT l.* FROM log l JOIN (SELECT ip_text, max(ts_ms) AS ts_ms FROM log GROUP BY 1) m USING (ip_text, ts_ms)"


@query("latest_actions", f"SELECT event_id, ip_text, action, ts_ms FROM ({build(_LAST)})")
def _(spark, sf):
    return audit.latest_actions(A.enforcement_log(spark, sf)).select("event_id", "ip_text", "action", "ts_ms")


_ACTIVE = f"SELECT ip_text, ts_ms+ttl_ms-{A.NOW_MS} AS remaining_ms, reason FROM ({_LAST}) WHERE action='Block' AND ts_ms+ttl_ms>{A.NOW_MS}"


@query("active_blocks", _ACTIVE)
def _(spark, sf):
    return audit.active_blocks(A.enforcement_log(spark, sf), A.NOW_MS)


_DESIRED = f"SELECT ip_text AS ip, least(remaining_ms//1000, 86400) AS ttl_s FROM ({_ACTIVE}) WHERE remaining_ms>=30000"


@query("desired_blocks", _DESIRED)
def _(spark, sf):
    return audit.desired_blocks(A.enforcement_log(spark, sf), A.NOW_MS)


@query("reconcile_diff", f"""SELECT coalesce(d.ip, l.ip) AS ip, CASE WHEN d.ip IS NULL THEN 'remove' ELSE 'add' END AS action
FROM (SELECT DISTINCT ip FROM ({_DESIRED})) d FULL JOIN (SELECT DISTINCT {LOG_IP} AS ip FROM events WHERE event_type='view') l ON d.ip=l.ip WHERE d.ip IS NULL OR l.ip IS NULL""")
def _(spark, sf):
    return audit.reconcile_diff(audit.desired_blocks(A.enforcement_log(spark, sf), A.NOW_MS), live_table(spark, sf))


def live_table(spark, sf):
    """Addresses of viewing users stand for what the firewall holds."""
    user = F.col("user_id")
    ip = F.concat(F.lit("203.0."), F.pmod(A.div(user, 256), F.lit(256)).cast("string"), F.lit("."), F.pmod(user, F.lit(256)).cast("string"))
    return A.table(spark, sf, "events").filter("event_type = 'view'").select(ip.alias("ip"))


@query("reconcile_report", f"""SELECT count(*) FILTER (WHERE d.ip IS NULL) AS orphans_removed, count(*) FILTER (WHERE l.ip IS NULL) AS re_applied
FROM (SELECT DISTINCT ip FROM ({_DESIRED})) d FULL JOIN (SELECT DISTINCT {LOG_IP} AS ip FROM events WHERE event_type='view') l ON d.ip=l.ip""")
def _(spark, sf):
    diff = audit.reconcile_diff(audit.desired_blocks(A.enforcement_log(spark, sf), A.NOW_MS), live_table(spark, sf))
    return audit.reconcile_report(diff)


_CUT7 = A.NOW_MS - 7 * 86400000


@query("retention", f"""SELECT 'enforcement_log' AS table_name, count(*) AS kept FROM log WHERE ts_ms>={A.NOW_MS - 90 * 86400000} UNION ALL SELECT 'verdicts', count(*) FROM verd WHERE ts_ms>={_CUT7}
UNION ALL SELECT 'detector_findings', count(*) FROM finds WHERE verdict_id IN (SELECT verdict_id FROM verd WHERE ts_ms>={_CUT7}) UNION ALL SELECT 'circuit_breaker_events', count(*) FROM breaker WHERE ts_ms>={_CUT7}""")
def _(spark, sf):
    kept = audit.retention(A.enforcement_log(spark, sf), A.verdicts(spark, sf), A.findings(spark, sf), A.circuit_events(spark, sf), A.NOW_MS)
    names = ["enforcement_log", "verdicts", "detector_findings", "circuit_breaker_events"]
    parts = [t.agg(F.count("*").alias("kept")).select(F.lit(n).alias("table_name"), "kept") for n, t in zip(names, kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("check_constraints", """SELECT event_id, CASE WHEN event_type='view' THEN 'action' ELSE '' END || CASE WHEN event_type='view' AND value>100 THEN ',' ELSE '' END || CASE WHEN value>100 THEN 'score' ELSE '' END AS violations FROM events""")
def _(spark, sf):
    ev = A.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "Ban").otherwise("Block").alias("action"), (F.col("value") / 100).alias("score"))
    return audit.check_constraints(ev, "enforcement_log").select("event_id", F.array_join("violations", ",").alias("violations"))


_CHAIN = """SELECT {key}, ts_ms, until FROM chain"""


def _chain_sql(rows: str, key: str, out: str) -> str:
    keys = key.replace(",", ", ")
    same = lambda a, b: " AND ".join(f"{a}.{k}={b}.{k}" for k in key.split(","))
    return f"""WITH RECURSIVE base AS ({build(rows)}),
 nodes AS (SELECT {keys}, ts_ms, ts_ms+(min((id, ttl)))[2] AS until FROM base GROUP BY {keys}, ts_ms),
 jumps AS (SELECT n.*, m.ts_ms AS nxt FROM nodes n ASOF LEFT JOIN nodes m ON {same("n", "m")} AND n.until<=m.ts_ms),
 chain AS (SELECT j.* FROM jumps j JOIN (SELECT {keys}, min(ts_ms) AS ts_ms FROM nodes GROUP BY {keys}) s USING ({keys}, ts_ms)
   UNION ALL SELECT j.* FROM chain c JOIN jumps j ON {same("j", "c")} AND j.ts_ms=c.nxt)
{out}"""


@query("cooldown", _chain_sql("SELECT b_ip AS remote, verdict_id AS id, ts_ms, ttl_ms AS ttl FROM verd WHERE verdict='Block'", "remote", "SELECT remote, ts_ms, until FROM chain"))
def _(spark, sf):
    blocks = A.verdicts(spark, sf).filter("verdict = 'Block'").select(F.col("b_ip").alias("remote"), "ts_ms", "ttl_ms", "verdict_id")
    return audit.cooldown(blocks, "remote").select("remote", "ts_ms", "until")


@query("cooldown_hot_keys", _chain_sql(
    "SELECT CASE WHEN verdict_id%3=0 THEN '198.51.100.1' ELSE a_ip END AS remote, verdict_id AS id, ts_ms, ttl_ms AS ttl FROM verd WHERE verdict='Block'",
    "remote", "SELECT remote, ts_ms, until FROM chain"))
def _(spark, sf):
    """One remote has a third of all Blocks, the others few each."""
    remote = F.when(F.col("verdict_id") % 3 == 0, "198.51.100.1").otherwise(F.col("a_ip"))
    blocks = A.verdicts(spark, sf).filter("verdict = 'Block'").select(remote.alias("remote"), "ts_ms", "ttl_ms", "verdict_id")
    return audit.cooldown(blocks, "remote").select("remote", "ts_ms", "until")


@query("block_intervals", _chain_sql(
    """SELECT ip_text, part, event_id AS id, ts_ms, ttl_ms AS ttl FROM (SELECT *, sum(CASE WHEN action='Unblock' THEN 1 ELSE 0 END) OVER (PARTITION BY ip_text ORDER BY ts_ms, action, event_id ROWS UNBOUNDED PRECEDING) AS part FROM log) WHERE action='Block'""",
    "ip_text,part", f"""SELECT c.ip_text, c.ts_ms AS start_ms, least(c.until, coalesce(min(l.ts_ms), c.until)) AS end_ms FROM chain c LEFT JOIN ({build("SELECT ip_text, ts_ms FROM log WHERE action='Unblock'")}) l ON l.ip_text=c.ip_text AND l.ts_ms>=c.ts_ms GROUP BY c.ip_text, c.ts_ms, c.until"""))
def _(spark, sf):
    return audit.block_intervals(A.enforcement_log(spark, sf))


@query("verdict_findings", "SELECT verdict_id, verdict, detector_id FROM verd JOIN finds USING (verdict_id)")
def _(spark, sf):
    return audit.verdict_findings(A.verdicts(spark, sf), A.findings(spark, sf)).select("verdict_id", "verdict", "detector_id")


@query("orphan_findings", "SELECT f.verdict_id, f.detector_id FROM finds f ANTI JOIN (SELECT * FROM verd WHERE verdict='Block') v USING (verdict_id)")
def _(spark, sf):
    return audit.orphan_findings(A.findings(spark, sf), A.verdicts(spark, sf).filter("verdict = 'Block'")).select("verdict_id", "detector_id")


@query("filter_by_detector", "SELECT verdict_id, ts_ms FROM verd WHERE verdict_id IN (SELECT verdict_id FROM finds WHERE detector_id='CrossFlow')")
def _(spark, sf):
    return audit.filter_by_detector(A.verdicts(spark, sf), A.findings(spark, sf), "CrossFlow").select("verdict_id", "ts_ms")


@query("filter_by_app", "SELECT verdict_id, ts_ms FROM verd WHERE lower(process_path) LIKE '%/safari'")
def _(spark, sf):
    return audit.filter_by_app(A.verdicts(spark, sf), "safari").select("verdict_id", "ts_ms")


@query("new_enforcement", "SELECT event_id, ts_ms FROM log WHERE action='Block' AND event_id NOT IN (SELECT event_id FROM log WHERE error IS NOT NULL)")
def _(spark, sf):
    log = A.enforcement_log(spark, sf)
    twice = log.filter("action = 'Block'").unionByName(log.filter("action = 'Block'"))
    return sinks.new_enforcement(twice, log.filter("error IS NOT NULL")).select("event_id", "ts_ms")


@query("unblock_rows", f"SELECT DISTINCT 'dashboard-{A.NOW_MS}-' || ip_text AS event_id, ip_text, 'Unblock' AS action, 'dashboard-requested' AS reason FROM log")
def _(spark, sf):
    addresses = A.enforcement_log(spark, sf).select(F.col("ip_text").alias("ip")).distinct()
    return sinks.unblock_rows(addresses, A.NOW_MS).select("event_id", "ip_text", "action", "reason")


@query("replay_rows", "SELECT event_id, ts_ms, 'Block' AS action, ip_text, ttl_ms, reason, detector, error FROM log WHERE CAST(substring(event_id,2) AS BIGINT)%5<>0 AND CAST(substring(event_id,2) AS BIGINT)%7<>0")
def _(spark, sf):
    n = F.substring("event_id", 2, 20).cast("bigint")
    entries = A.enforcement_log(spark, sf).select(
        "event_id", "ts_ms", F.when(n % 5 == 0, 2).otherwise(1).alias("payload_version"),
        F.when(n % 7 == 0, "{broken").otherwise(sinks.payload_json()).alias("payload"))
    rows, _ = sinks.replay_rows(entries)
    return rows.select("event_id", "ts_ms", "action", "ip_text", "ttl_ms", "reason", "detector", "error")


# -- reports -----------------------------------------------------------------

@query("recent_verdicts", "SELECT verdict_id, ts_ms FROM verd ORDER BY ts_ms DESC, verdict_id DESC LIMIT 100")
def _(spark, sf):
    return reports.recent_verdicts(A.verdicts(spark, sf), 100).select("verdict_id", "ts_ms")


@query("recent_enforcement", "SELECT event_id, ts_ms FROM log ORDER BY ts_ms DESC, event_id DESC LIMIT 100")
def _(spark, sf):
    return reports.recent_enforcement(A.enforcement_log(spark, sf), 100).select("event_id", "ts_ms")


@query("kpi_since", f"""SELECT (SELECT count(*) FROM verd WHERE verdict='Block' AND ts_ms>={_CUT7}) AS blocks, (SELECT count(*) FROM verd WHERE verdict='Alert' AND ts_ms>={_CUT7}) AS alerts,
  (SELECT count(DISTINCT ip_text) FROM log WHERE error IS NULL AND ts_ms>={_CUT7}) AS unique_ips, (SELECT count(*) FROM log WHERE error IS NOT NULL AND ts_ms>={_CUT7}) AS failures""")
def _(spark, sf):
    return reports.kpi_since(A.verdicts(spark, sf), A.enforcement_log(spark, sf), _CUT7)


@query("protection_status", f"SELECT true AS is_protected, count(*) AS blocks_week FROM verd WHERE verdict='Block' AND ts_ms>={_CUT7}")
def _(spark, sf):
    return reports.protection_status(A.verdicts(spark, sf), A.NOW_MS)


# The zone's offset in the month of the data is five hours.
_OFF = 5 * 3600000
_DAY0 = (A.NOW_MS - _OFF) // 86400000 * 86400000 + _OFF


@query("threat_stats", f"""SELECT (SELECT count(*) FROM verd WHERE verdict='Block' AND ts_ms>={_DAY0}) AS blocks_today, (SELECT count(*) FROM verd WHERE verdict='Block' AND ts_ms>={_CUT7}) AS blocks_week,
  (SELECT count(DISTINCT ip_text) FROM log WHERE error IS NULL AND ts_ms>={_CUT7}) AS blocked_addresses""")
def _(spark, sf):
    return reports.threat_stats(A.verdicts(spark, sf), A.enforcement_log(spark, sf), A.NOW_MS, A.TZ)


@query("detector_health", "SELECT detector_id, arg_max(to_state, (ts_ms, id)) AS last_state, count(*) AS transitions, max(ts_ms) AS last_ts_ms FROM breaker GROUP BY 1")
def _(spark, sf):
    return reports.detector_health(A.circuit_events(spark, sf))


_H = 3600000
_CHART = f"""SELECT h AS hour_ms, CAST((h-{_OFF})//{_H}%24 AS INTEGER) AS hour, count(verdict_id) AS count FROM
 (SELECT unnest(generate_series({A.NOW_MS - 23 * _H}, {A.NOW_MS}, {_H})) AS h) s LEFT JOIN verd v ON v.ts_ms//{_H}*{_H}=h GROUP BY h"""


@query("activity_chart", _CHART)
def _(spark, sf):
    return reports.activity_chart(A.verdicts(spark, sf), A.NOW_MS, A.TZ)


@query("activity_chart_for_day", f"""SELECT h AS hour_ms, CAST((h-{_OFF})//{_H}%24 AS INTEGER) AS hour, count(verdict_id) AS count FROM
 (SELECT unnest(generate_series({_DAY0 - 3 * 24 * _H}, {_DAY0 - 2 * 24 * _H - 1}, {_H})) AS h) s LEFT JOIN verd v ON v.ts_ms//{_H}*{_H}=h GROUP BY h""")
def _(spark, sf):
    return reports.activity_chart_for_day(A.verdicts(spark, sf), A.NOW_MS, A.TZ, 3)


_WEEK = f"""SELECT d AS day_offset, count(verdict_id) AS count FROM (SELECT unnest([0,1,2,3,4,5,6]) AS d) s
LEFT JOIN verd v ON v.verdict='Block' AND v.ts_ms>={_DAY0}-d*86400000 AND v.ts_ms<{_DAY0}-(d-1)*86400000 GROUP BY d"""


@query("weekly_blocks", _WEEK)
def _(spark, sf):
    return reports.weekly_blocks(A.verdicts(spark, sf), A.NOW_MS, A.TZ)


_BREAK = "SELECT detector_id, CAST(sum(CASE WHEN score>0 THEN 1 ELSE 0 END) AS BIGINT) AS findings, count(*) AS runs FROM finds GROUP BY 1"


@query("detector_breakdown", _BREAK)
def _(spark, sf):
    return reports.detector_breakdown(A.findings(spark, sf))


@query("top_apps", f"""SELECT process_path, blocks, alerts, {S.BASE.format("process_path")} AS app_name FROM (SELECT process_path, count(*) FILTER (WHERE verdict='Block') AS blocks, count(*) FILTER (WHERE verdict='Alert') AS alerts FROM verd
WHERE process_path<>'' AND ts_ms>={_CUT7} GROUP BY 1) ORDER BY blocks*2+alerts DESC, process_path LIMIT 5""")
def _(spark, sf):
    return reports.top_apps(A.verdicts(spark, sf), A.NOW_MS)


_COUNTRIES = "SELECT country_code, count(*) AS count FROM verd WHERE country_code IS NOT NULL GROUP BY 1"


@query("threat_countries", _COUNTRIES)
def _(spark, sf):
    return reports.threat_countries(A.verdicts(spark, sf))


def centroids(spark, sf):
    key = F.col("n_nationkey")
    return A.table(spark, sf, "nation").select(
        A.country_code(key).alias("code"), F.col("n_name").alias("name"), (key * 3).alias("lat"), (key * 7).alias("lng"))


_POINTS = f"SELECT country_code, count, n_name AS name, n_nationkey*3 AS lat, n_nationkey*7 AS lng FROM ({_COUNTRIES}) JOIN nation ON country_code={code('n_nationkey')}"


@query("country_points", _POINTS)
def _(spark, sf):
    return reports.country_points(reports.threat_countries(A.verdicts(spark, sf)), centroids(spark, sf))


@query("top_countries", f"{_POINTS} ORDER BY count DESC, country_code LIMIT 8")
def _(spark, sf):
    return reports.top_countries(reports.country_points(reports.threat_countries(A.verdicts(spark, sf)), centroids(spark, sf)))


@query("country_shares", f"SELECT country_code, count, CAST(round(CAST(count AS DOUBLE)/max(count) OVER ()*1e6) AS BIGINT) AS share_e6 FROM (SELECT * FROM ({_COUNTRIES}) ORDER BY count DESC, country_code LIMIT 4)")
def _(spark, sf):
    shown = reports.share_of_max(reports.threat_countries(A.verdicts(spark, sf)), "count", 4)
    return shown.select("country_code", "count", e6("share").alias("share_e6"))


@query("detector_shares", f"SELECT detector_id, findings, CAST(round(CAST(findings AS DOUBLE)/greatest(max(findings) OVER (),1)*1e6) AS BIGINT) AS share_e6 FROM ({_BREAK})")
def _(spark, sf):
    shown = reports.share_of_max(reports.detector_breakdown(A.findings(spark, sf)), "findings")
    return shown.select("detector_id", "findings", e6("share").alias("share_e6"))


@query("peak_hour", f"SELECT hour_ms, hour, count FROM ({_CHART}) ORDER BY count DESC, hour_ms LIMIT 1")
def _(spark, sf):
    return reports.peak_bucket(reports.activity_chart(A.verdicts(spark, sf), A.NOW_MS, A.TZ))


def _feed_sql(where: str = "", limit: int | None = 50) -> str:
    top = f"ORDER BY ts_ms DESC, verdict_id DESC LIMIT {limit}" if limit else ""
    return f"""SELECT v.verdict_id, v.ts_ms, CASE WHEN coalesce(process_path,'')='' THEN 'Unknown app' ELSE {S.BASE.format("process_path")} END AS app_name, verdict,
 (SELECT string_agg(detector_id, ',' ORDER BY score DESC, detector_id) FROM finds f WHERE f.verdict_id=v.verdict_id) AS detectors,
 coalesce(remote_ip, CASE WHEN a_ip=local_ip THEN b_ip WHEN b_ip=local_ip THEN a_ip END, b_ip) AS remote, country_code, dns_name,
 (SELECT first(ev_text ORDER BY score DESC, detector_id) FROM finds f WHERE f.verdict_id=v.verdict_id AND ev_text IS NOT NULL) AS top_text
FROM (SELECT * FROM verd {where} {top}) v"""


def feed_view(feed: DataFrame) -> DataFrame:
    return feed.select("verdict_id", "ts_ms", "app_name", "verdict", F.array_join("detector_ids", ",").alias("detectors"), "remote",
                       "country_code", "dns_name", F.get("top_evidence", F.lit(0))["description"].alias("top_text"))


@query("activity_feed", _feed_sql())
def _(spark, sf):
    return feed_view(reports.activity_feed(A.verdicts(spark, sf), A.findings(spark, sf), 50))


@query("activity_feed_by_app", _feed_sql("WHERE lower(process_path) LIKE '%/curl'"))
def _(spark, sf):
    return feed_view(reports.activity_feed(A.verdicts(spark, sf), A.findings(spark, sf), 50, app="curl"))


@query("activity_feed_by_detector", _feed_sql("WHERE verdict_id IN (SELECT verdict_id FROM finds WHERE detector_id='CrossFlow')"))
def _(spark, sf):
    return feed_view(reports.activity_feed(A.verdicts(spark, sf), A.findings(spark, sf), 50, detector="CrossFlow"))


@query("new_since", "SELECT verdict_id FROM (SELECT verdict_id, ts_ms FROM verd ORDER BY ts_ms DESC, verdict_id DESC LIMIT 80) WHERE verdict_id NOT IN (SELECT verdict_id FROM (SELECT verdict_id, ts_ms FROM verd WHERE verdict='Alert' ORDER BY ts_ms DESC, verdict_id DESC LIMIT 80))")
def _(spark, sf):
    v = A.verdicts(spark, sf)
    return reports.new_since(reports.recent_verdicts(v, 80), reports.recent_verdicts(v.filter("verdict = 'Alert'"), 80)).select("verdict_id")


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.PHRASES.items())


@query("explained_verdicts", f"""SELECT verdict_id, app_name || ' tried to ' || CASE WHEN top<>'CrossFlow' THEN CASE top {_CASE} END
 WHEN top_text LIKE 'Beacon%' THEN '{reports.BEACON_PHRASE}' WHEN top_text LIKE 'DNS query%' THEN '{reports.DNS_PHRASE}' ELSE '{reports.PHRASES["CrossFlow"]}' END || ' (' || coalesce(dns_name, remote) || ') ' ||
 CASE WHEN verdict='Block' THEN '— blocked.' ELSE '— flagged for review.' END AS sentence,
 app_name || ' tried to ' || array_to_string(phrases[:-2], ', ') || ' and ' || phrases[-1] || '. ' || CASE WHEN verdict='Block' THEN 'This system blocked it to protect you.' ELSE 'This system flagged it so you can review it.' END AS why
FROM (SELECT *, split_part(detectors,',',1) AS top, list_transform(string_split(detectors,','), lambda x: CASE x {_CASE} END) AS phrases FROM ({_feed_sql("", None)}))""")
def _(spark, sf):
    feed = reports.activity_feed(A.verdicts(spark, sf), A.findings(spark, sf), None)
    return reports.explain_why(reports.explain_verdict(feed)).select("verdict_id", "sentence", "why")


# -- streams -----------------------------------------------------------------
# Each reads a stream of several micro-batches that a batch job has written in
# the order of time, and last rows far ahead, which move the watermark past
# all others; what they make is left out.

# Files of each micro-batch, and how far ahead the last row is.
STREAM_FILES, STREAM_PARTS, AHEAD_US = 2, 2, 7_200_000_000


def drained(spark: SparkSession, rows: DataFrame) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    folder = work_folder(spark)
    stream_sink(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").select(*rows.columns)


def replayed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    rows = stage(rows.withColumn("ts", F.timestamp_micros("ts_us")))
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    folder = f"{work_folder(spark)}/stream"
    part = F.least(F.floor((F.col("ts_us") - low) * STREAM_PARTS / F.lit(max(high - low, 1))), F.lit(STREAM_PARTS - 1))
    for k in range(STREAM_PARTS):
        rows.filter(part == k).repartition(STREAM_FILES).write.mode("append").parquet(folder)
    one = stage(rows.limit(1))
    for k in range(1, 3):  # twice, as the second of two chained aggregations is a batch behind
        last = one.withColumn("ts_us", F.lit(high + k * AHEAD_US)).withColumn("ts", F.timestamp_micros("ts_us")).select(*rows.columns)
        for _ in range(STREAM_FILES):
            last.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(folder)


def before(rows: DataFrame, us: str) -> DataFrame:
    """Rows that the last rows didn't make: only they are beyond the squeezed month and an hour."""
    return rows.filter(F.col(us) < LAST_US)


# Events are squeezed to 1000 seconds, and bursts last for minutes.
LAST_US = 7_000_000_000


def packet_stream(spark, sf):
    return replayed(spark, A.packets(spark, sf))


@query("stream_flows", "SELECT flow_id, packet_count, byte_count, remote_ip, first_us, last_us FROM net_flows")
def _(spark, sf):
    return before(drained(spark, windows.stream_flows(packet_stream(spark, sf)).select(
        "flow_id", "packet_count", "byte_count", "remote_ip", "first_us", "last_us")), "first_us")


@query("stream_connections", f"SELECT {KEY}, first_us FROM bare_flows")
def _(spark, sf):
    return before(drained(spark, stateful.stream_connections(packet_stream(spark, sf))), "first_us").select(*FLOW_KEY, "first_us")


@query("stream_reevaluate", ORACLES["reevaluations"])
def _(spark, sf):
    rows = before(drained(spark, stateful.stream_reevaluate(packet_stream(spark, sf))), "eval_us")
    return rows.select(flows.flow_id(FLOW_KEY).alias("flow_id"), "eval_us", (F.col("eval_us") - F.col("first_us")).alias("flow_age_us"), "packet_count", "byte_count")


def connection_stream(spark, sf):
    """New flows as a stream."""
    return replayed(spark, crossflow.connections(net_flows(spark, sf)))


@query("stream_scan_dns", f"""SELECT pid0 AS pid, remote_ip, min(ts_us) AS first_us, count(*) AS scan_count, CAST(sum(CASE WHEN protocol=17 AND remote_port=53 THEN 1 ELSE 0 END) AS BIGINT) AS dns_count
FROM conn_marked GROUP BY pid0, remote_ip, run""")
def _(spark, sf):
    return before(drained(spark, windows.stream_scan_dns(connection_stream(spark, sf))), "first_us")


@query("stream_running_counts", """SELECT scan_count, dns_count, count(*) AS flows FROM (SELECT count(*) OVER w AS scan_count,
  CAST(sum(CASE WHEN protocol=17 AND remote_port=53 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS dns_count FROM conn_marked WINDOW w AS (PARTITION BY pid0, remote_ip, run ORDER BY ts_us, flow_id ROWS UNBOUNDED PRECEDING)) GROUP BY ALL""")
def _(spark, sf):
    connections = connection_stream(spark, sf)
    rows = drained(spark, stateful.stream_running_counts(connections.withColumn("flow_id", F.when(F.col("ts_us") < LAST_US, F.col("flow_id")))))
    return rows.filter("flow_id IS NOT NULL").groupBy("scan_count", "dns_count").agg(F.count("*").alias("flows"))


@query("stream_beacon", f"""SELECT flow_id, n AS beacon_n, {S.e6("CASE WHEN n>1 AND total>0 THEN total/(n-1)/1e6 END")} AS mean_e6,
  {S.e6("CASE WHEN n>1 AND total>0 THEN sqrt(greatest((n-1)*CAST(squares AS DOUBLE)/(CAST(total AS DOUBLE)*total)-1.0, 0.0)) END")} AS cv_e6
FROM (SELECT flow_id, place-min(place) OVER w+1 AS n, ts_us-min(ts_us) OVER w AS total, running-min(running) OVER w AS squares
  FROM (SELECT *, CAST(sum(gap*gap) OVER o AS BIGINT) AS running FROM (SELECT *, row_number() OVER o AS place, CASE WHEN ts_us-lag(ts_us) OVER o<=60000000 THEN ts_us-lag(ts_us) OVER o ELSE 0 END AS gap
    FROM conn WINDOW o AS (PARTITION BY remote_ip, remote_port, protocol ORDER BY ts_us, flow_id)) WINDOW o AS (PARTITION BY remote_ip, remote_port, protocol ORDER BY ts_us, flow_id))
  WINDOW w AS (PARTITION BY remote_ip, remote_port, protocol ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW))""")
def _(spark, sf):
    connections = connection_stream(spark, sf)
    rows = drained(spark, stateful.stream_beacon(connections.withColumn("flow_id", F.when(F.col("ts_us") < LAST_US, F.col("flow_id")))))
    return rows.filter("flow_id IS NOT NULL").select("flow_id", "beacon_n", e6("beacon_mean_s").alias("mean_e6"), e6("beacon_cv").alias("cv_e6"))


@query("stream_cooldown", ORACLES["cooldown"])
def _(spark, sf):
    blocks = A.verdicts(spark, sf).filter("verdict = 'Block'").select(
        (F.col("ts_ms") * 1000).alias("ts_us"), F.col("verdict_id").cast("string").alias("flow_id"), F.col("b_ip").alias("remote_ip"), "ttl_ms")
    last = blocks.agg(F.max("ts_us")).first()[0]
    rows = drained(spark, stateful.stream_cooldown(replayed(spark, blocks))).filter(F.col("ts_us") <= F.lit(last))
    return rows.select(F.col("remote_ip").alias("remote"), F.expr("ts_us div 1000").alias("ts_ms"), F.expr("until_us div 1000").alias("until"))


@query("stream_diversity", f"""SELECT pid, window_end_us, count(DISTINCT remote_ip) AS distinct_ips, count(*) AS pid_connections FROM (
  SELECT pid, remote_ip, unnest(generate_series(ts_us//1000000*1000000+1000000, ts_us//1000000*1000000+10000000, 1000000)) AS window_end_us FROM conn WHERE pid IS NOT NULL)
GROUP BY ALL""")
def _(spark, sf):
    known = crossflow.connections(net_flows(spark, sf)).filter("pid IS NOT NULL")
    return before(drained(spark, windows.stream_diversity(replayed(spark, known))), "window_end_us")


@query("stream_cross_flow", ORACLES["score_cross_flow"])
def _(spark, sf):
    f_ = staged_flows(spark, sf)
    evaluated = replayed(spark, f_.withColumn("ts_us", F.col("eval_us")))
    rows = counters.stream_cross_flow(evaluated, replayed(spark, crossflow.connections(f_)))
    kept = rows.select("flow_id", "eval_us", "ts_us", "cross_score", "cross_confidence", "cross_severity", "cross_hits")
    return finding_view(before(drained(spark, kept), "ts_us"), "CrossFlow")


@query("stream_pid_diversity", ORACLES["pid_diversity"])
def _(spark, sf):
    f_ = staged_flows(spark, sf)
    evaluated = replayed(spark, f_.withColumn("ts_us", F.col("eval_us")))
    rows = drained(spark, counters.stream_diversity_at(evaluated, replayed(spark, crossflow.connections(f_))))
    return before(rows, "ts_us").drop("ts_us")


@query("stream_enrich", ORACLES["attach_enrichment"])
def _(spark, sf):
    # Attributes come five seconds after their verdict, and some wait in another micro-batch.
    vid = F.col("verdict_id")
    v = A.verdicts(spark, sf).select("verdict_id", (F.col("ts_ms") * 1000).alias("ts_us"), "dns_name", "country_code")
    updates = v.select(
        "verdict_id", (F.col("ts_us") + 5_000_000).alias("ts_us"), F.when(vid % 3 == 0, F.concat(F.lit("new"), vid.cast("string"))).alias("dns_name"),
        F.lit(None).cast("string").alias("country_code"))
    last = v.agg(F.max("ts_us")).first()[0]
    rows = drained(spark, late.stream_enrich(replayed(spark, v), replayed(spark, updates), "verdict_id")).filter(F.col("ts_us") <= F.lit(last))
    newest = F.max_by(F.struct("dns_name", "country_code"), "version")
    return rows.groupBy("verdict_id").agg(newest.alias("r")).select("verdict_id", "r.*")


_MIDDLE = "(SELECT (min(us)+max(us))//2 FROM ev)"


@query("stream_late_rows", f"""SELECT event_id, us AS ts_us, event_id%50=0 AND us<{_MIDDLE} AND us<=(SELECT max(us) FROM ev)-10000000 AS late FROM ev""")
def _(spark, sf):
    """Every fiftieth event of the first half arrives after all others."""
    ev = stage(A.squeezed(spark, sf).select("event_id", F.col("us").alias("ts_us"), F.timestamp_micros("us").alias("ts")))
    low, high = ev.agg(F.min("ts_us"), F.max("ts_us")).first()
    held = (F.col("event_id") % 50 == 0) & (F.col("ts_us") < (low + high) // 2)
    folder = work_folder(spark)
    for part in (~held & (F.col("ts_us") < (low + high) // 2), ~held & (F.col("ts_us") >= (low + high) // 2), held):
        ev.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    late.split_late(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    read = lambda kind: spark.read.schema(ev.schema).parquet(f"{folder}/out/{kind}")
    return read("accepted").withColumn("late", F.lit(False)).unionByName(read("late").withColumn("late", F.lit(True))).select("event_id", "ts_us", "late")


@query("desired_blocks_bounded", f"SELECT * FROM ({build(_DESIRED)}) ORDER BY ttl_s DESC, ip LIMIT 5")
def _(spark, sf):
    return audit.desired_blocks(A.enforcement_log(spark, sf), A.NOW_MS, limit=5)


# -- stored tables, written and read back ---------------------------------------

@query("score_burst_behavior", "WITH rich_flows AS (" + build("SELECT * REPLACE (last_us-first_us AS flow_age_us) FROM net_flows") + "), d3 AS (" + S.CTES["d3"]
       + f") SELECT flow_id, {S.e6('score')} AS score_e6, {S.e6('conf')} AS confidence_e6, ['Low','Medium','High','Critical'][sev+1] AS severity, CAST(hits AS INTEGER) AS hits FROM d3")
def _(spark, sf):
    return finding_view(detectors.score_flow_behavior(net_flows(spark, sf), age_mode="active"), "FlowBehavior")


def stored_versions(spark, sf):
    """Verdict versions and findings as ``sinks`` stores them, in two appends, and then compacted."""
    v, f_ = A.verdicts(spark, sf), A.findings(spark, sf)
    own = v.select("verdict_id", decide.verdict_id().alias("_key"), "ts_ms")
    keyed = v.withColumn("_key", decide.verdict_id()).withColumn("event", F.col("verdict_id")).withColumn("verdict_id", F.col("_key")).drop("_key")
    listed = f_.join(own, "verdict_id").withColumn("verdict_id", F.col("_key")).drop("_key")
    listed = listed.withColumn("evidence_json", text.evidence_json("evidence")).drop("evidence")
    folder = work_folder(spark)
    for part in (0, 1):
        sinks.append(listed.filter(F.col("ts_ms") % 2 == part), f"{folder}/findings")
        sinks.append(keyed.filter(F.col("ts_ms") % 2 == part), f"{folder}/verdicts")
    sinks.compact(spark, f"{folder}/verdicts", f"{folder}/findings", f"{folder}/verdicts2", f"{folder}/findings2")
    return f"{folder}/verdicts2", f"{folder}/findings2"


_VKEY = "md5(a_ip || '|' || a_port || '|' || b_ip || '|' || b_port || '|' || protocol || '|' || verdict)"


@query("stored_verdicts", f"SELECT {_VKEY} AS verdict_id, max(ts_ms) AS ts_ms, count(*) AS versions FROM verd GROUP BY 1")
def _(spark, sf):
    verdicts, _ = stored_versions(spark, sf)
    kept = sinks.read_verdicts(spark, verdicts)
    counted = A.verdicts(spark, sf).groupBy(decide.verdict_id().alias("verdict_id")).agg(F.count("*").alias("versions"))
    return kept.select("verdict_id", "ts_ms").join(counted, "verdict_id")


@query("stored_findings", f"""SELECT verdict_id, ts_ms, detector_id, any_value(ev_text) AS description FROM (
  SELECT v.verdict_id, v.ts_ms, f.detector_id, f.ev_text, max(v.ts_ms) OVER (PARTITION BY v.verdict_id) AS newest
  FROM (SELECT verdict_id AS event, {_VKEY} AS verdict_id, ts_ms FROM verd) v JOIN finds f ON f.verdict_id=v.event) WHERE ts_ms=newest GROUP BY ALL HAVING count(*)=1""")
def _(spark, sf):
    verdicts, findings = stored_versions(spark, sf)
    kept = sinks.read_findings(spark, verdicts, findings)
    # Two events of one verdict at one millisecond would be told apart by nothing.
    v = A.verdicts(spark, sf).select(decide.verdict_id().alias("verdict_id"), "ts_ms").groupBy("verdict_id", "ts_ms").count().filter("count = 1")
    return kept.join(v, ["verdict_id", "ts_ms"], "left_semi").select("verdict_id", "ts_ms", "detector_id", F.get("evidence", F.lit(0))["description"].alias("description"))


@query("stream_replay", ORACLES["replay_rows"])
def _(spark, sf):
    """Every entry comes twice, and the log has a tenth of them already."""
    n = F.substring("event_id", 2, 20).cast("bigint")
    log = A.enforcement_log(spark, sf)
    entries = log.select(
        "event_id", "ts_ms", F.when(n % 5 == 0, 2).otherwise(1).alias("payload_version"),
        F.when(n % 7 == 0, "{broken").otherwise(sinks.payload_json()).alias("payload"), (F.col("ts_ms") * 1000).alias("ts_us"))
    folder = work_folder(spark)
    sinks.write_enforcement(sinks.replay_rows(entries.filter(n % 10 == 1).drop("ts_us"))[0], f"{folder}/log")
    twice = entries.unionByName(entries.withColumn("ts_us", F.col("ts_us") + 1_000_000))
    sinks.replay_stream(replayed(spark, twice), f"{folder}/log", f"{folder}/dead", f"{folder}/checkpoint").awaitTermination()
    return sinks.read_table(spark, f"{folder}/log").select("event_id", "ts_ms", "action", "ip_text", "ttl_ms", "reason", "detector", "error")


def _entry(condition: str, description: str, detail: str | None = None) -> str:
    told = f""" || ',"detail":"' || {detail} || '"'""" if detail else ""
    return f"""CASE WHEN {condition} THEN '{{"description":"{description}"'{told} || '}}' END"""


_EVIDENCE = ", ".join([
    _entry(f"a_ip IN {S.inlist(detectors.IP_BLOCKLIST)}", "Source IP matches blocklist", "a_ip"),
    _entry(f"b_ip IN {S.inlist(detectors.IP_BLOCKLIST)}", "Destination IP matches blocklist", "b_ip"),
    _entry(f"a_ip IN {S.inlist(detectors.IP_ALLOWLIST)}", "Source IP is allowlisted", "a_ip"),
    _entry(f"b_ip IN {S.inlist(detectors.IP_ALLOWLIST)}", "Destination IP is allowlisted", "b_ip"),
    _entry(rfc1918("a_ip"), "Source IP is RFC1918 (local network)"), _entry(rfc1918("b_ip"), "Destination IP is RFC1918 (local network)"),
])


@query("evidence_json", f"SELECT flow_id, '[' || concat_ws(',', {_EVIDENCE}) || ']' AS evidence_json FROM net_flows")
def _(spark, sf):
    """What a detector says, in the form it is stored in."""
    scored = detectors.score_ip_reputation(net_flows(spark, sf).withColumn("reputation_score", F.lit(None).cast("float")))
    stored = scored.select("flow_id", text.evidence_json("rep_evidence").alias("evidence_json"))
    # Read back and written again, it is the same.
    return stored.select("flow_id", text.evidence_json(text.parse_evidence("evidence_json")).alias("evidence_json"))
