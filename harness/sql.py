"""DuckDB statements of the input adapters and of the pipeline stages.

``build("...", "cte", ...)`` prefixes a query with the named common table
expressions and everything they need.
"""

from __future__ import annotations

import re
from collections import Counter

from harness.adapters import BURST_VALUE, DETECTOR_NAMES, EPOCH_US, PATHS, POOL, SQUEEZE, TICK_US, TICKS, USERS_PER_HOST

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def build(body: str, *extra: str) -> str:
    """``body`` with the CTEs it mentions, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in needed(CTES[name]):
            if other != name:
                visit(other)
        order.append(name)

    def needed(text: str) -> list[str]:
        words = set(re.findall(r"[a-z_0-9]+", text))
        return [n for n in CTES if n in words]

    for name in [*needed(body), *extra]:
        visit(name)
    # What several parts read is computed once, whatever the engine would choose.
    used = Counter(n for text in [body, *(CTES[n] for n in order)] for n in re.findall(r"[a-z_0-9]+", text))
    heads = ",\n".join(f"{n} AS {'MATERIALIZED ' if used[n] > 1 else ''}({CTES[n]})" for n in order)
    return f"WITH {heads}\n{body.strip()}" if heads else body.strip()


def f(value: float) -> str:
    return f"CAST({value!r} AS FLOAT)"


def num(ip: str) -> str:
    parts = [f"TRY_CAST(split_part({ip},'.',{i}) AS BIGINT)*{256 ** (4 - i)}" for i in range(1, 5)]
    return "(" + "+".join(parts) + ")"


def text(n: str) -> str:
    return f"(({n})//16777216 || '.' || ({n})//65536%256 || '.' || ({n})//256%256 || '.' || ({n})%256)"


def v6(ip: str) -> str:
    return f"(position(':' IN {ip}) > 0)"


def arr(values: list[str], index: str) -> str:
    items = ",".join("'" + v + "'" for v in values)
    return f"([{items}])[({index})+1]"


def public(ip: str) -> str:
    n = num(ip)
    return (
        f"(CASE WHEN {v6(ip)} THEN NOT ({ip} IN ('::1','::') OR regexp_matches({ip},'^f[cd][0-9a-f]{{2}}:')) ELSE NOT ("
        f"{n}>>24 IN (10,127) OR {n}>>20=2753 OR {n}>>16 IN (49320,43518) OR {n} IN (0,4294967295) OR {n}>>22=401) END)"
    )


def rfc1918(ip: str) -> str:
    n = num(ip)
    return (
        f"(CASE WHEN {v6(ip)} THEN {ip}='::1' OR regexp_matches({ip},'^(fe[89ab][0-9a-f]|f[cd][0-9a-f]{{2}}):') ELSE "
        f"{n}>>24=10 OR {n}>>20=2753 OR {n}>>16=49320 END)"
    )


def infra(ip: str) -> str:
    return f"(CASE WHEN {v6(ip)} THEN regexp_matches({ip},'^ff[0-9a-f]{{2}}:') ELSE {num(ip)}=4294967295 OR {num(ip)}>>28=14 END)"


def types(**values) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


USER_IP = "'10.' || (user_id//65536) || '.' || (user_id//256%256) || '.' || (user_id%256)"

cte("ev", f"SELECT event_id, user_id, event_type, value, (epoch_us(ts)-{EPOCH_US})//{SQUEEZE} AS us FROM events")
cte("steps", f"""
SELECT *, 0 AS kind, unnest(generate_series(0, {types(view=3, click=2, signup=8, purchase=20, error=1)} - 1)) AS i FROM ev
UNION ALL
SELECT *, 1, unnest(generate_series(0, {types(view=0, click=90, signup=7, purchase=60, error=240)} - 1)) FROM ev WHERE value >= {BURST_VALUE}
""")
cte("packets", f"""
SELECT ts_us, CASE WHEN reply THEN remote_ip ELSE local_ip END AS src_ip, CASE WHEN reply THEN local_ip ELSE remote_ip END AS dst_ip,
  CASE WHEN reply THEN remote_port ELSE local_port END AS src_port, CASE WHEN reply THEN local_port ELSE remote_port END AS dst_port,
  CASE WHEN remote_port=53 THEN 17 ELSE 6 END AS protocol, length, local_ip
FROM (SELECT us + i * CASE WHEN kind=0 THEN 100000 ELSE {types(view=0, click=300000, signup=5000000, purchase=100000, error=200000)} END AS ts_us,
  {USER_IP} AS local_ip,
  CAST(CASE WHEN kind=0 THEN 40000 + user_id%20000 ELSE 10000 + (event_id*251+i)%25000 END AS INTEGER) AS local_port,
  CASE WHEN kind=1 AND event_type='purchase' THEN '198.51.100.' || (i+1) WHEN kind=1 AND event_type='click' THEN '203.0.113.53'
    ELSE {arr(POOL, "event_id%10")} END AS remote_ip,
  CASE WHEN kind=0 THEN {types(view=443, click=80, signup=53, purchase=8080, error=22)} ELSE {types(view=0, click=53, signup=8443, purchase=443, error=22)} END AS remote_port,
  60 + CAST(floor(value) AS INTEGER)%1400 AS length, kind=0 AND i%2=1 AS reply
  FROM steps)
""")
cte("keyed", f"""
SELECT *, CASE WHEN first_a THEN src_ip ELSE dst_ip END AS a_ip, CASE WHEN first_a THEN src_port ELSE dst_port END AS a_port,
  CASE WHEN first_a THEN dst_ip ELSE src_ip END AS b_ip, CASE WHEN first_a THEN dst_port ELSE src_port END AS b_port
FROM (SELECT *, CASE WHEN {v6("src_ip")} THEN false WHEN {v6("dst_ip")} THEN true
  ELSE {num("src_ip")} < {num("dst_ip")} OR ({num("src_ip")} = {num("dst_ip")} AND src_port <= dst_port) END AS first_a FROM packets)
""")
KEY = "a_ip, a_port, b_ip, b_port, protocol"
cte("marked", f"""
SELECT *, sum(fresh) OVER (PARTITION BY {KEY} ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {KEY} ORDER BY ts_us) < 5000000 THEN 0 ELSE 1 END AS fresh FROM keyed)
""")
cte("bare_flows", f"""
SELECT {KEY}, first_us, last_us, packet_count, byte_count, local_ip, last_us + 5000000 AS eval_us, last_us + 5000000 - first_us AS flow_age_us,
  md5({KEY.replace(", ", " || '|' || ")} || '|' || first_us) AS flow_id,
  CASE WHEN dir=0 THEN a_ip ELSE b_ip END AS src_ip, CASE WHEN dir=0 THEN a_port ELSE b_port END AS src_port,
  CASE WHEN dir=0 THEN b_ip ELSE a_ip END AS dst_ip, CASE WHEN dir=0 THEN b_port ELSE a_port END AS dst_port
FROM (SELECT {KEY}, run, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
  min(local_ip) AS local_ip, min(ts_us*2 + CASE WHEN first_a THEN 0 ELSE 1 END)%2 AS dir FROM marked GROUP BY ALL)
""")
cte("net_flows", f"""
SELECT *, CASE WHEN user_no%7<>0 THEN user_no END AS pid FROM (
SELECT *, CASE WHEN src_ip<>local_ip AND dst_ip=local_ip THEN src_ip ELSE dst_ip END AS remote_ip,
  CASE WHEN src_ip<>local_ip AND dst_ip=local_ip THEN src_port ELSE dst_port END AS remote_port,
  CASE WHEN src_ip<>local_ip AND dst_ip=local_ip THEN dst_port ELSE src_port END AS local_port,
  {num("local_ip")} - 167772160 AS user_no FROM bare_flows)
""")
cte("host_names", f"""
SELECT page_id, CASE WHEN page_id%5=1 THEN md5(CAST(page_id AS VARCHAR)) || '.' || host
  WHEN page_id%5=2 THEN md5(CAST(page_id AS VARCHAR)) || reverse(md5(CAST(page_id AS VARCHAR))) || '.a.b.c.d.e.' || host
  WHEN page_id%5=3 THEN substring(md5(CAST(page_id AS VARCHAR)),1,12) || '.10.1.2.3.Evil.XYZ'
  WHEN page_id%10=4 THEN 'WWW.GitHub.com' ELSE host END AS dns_name
FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)
""")
cte("ptr_rows", f"SELECT {arr(POOL, 'page_id%10')} AS ip, dns_name AS name, (page_id*7919)%1000*1000000 AS ts_us FROM host_names")
cte("ptr", "SELECT ip, ts_us, max(name) AS name FROM ptr_rows GROUP BY ALL")
cte("proc", f"""
SELECT user_id AS pid, CASE WHEN half=0 THEN 0 ELSE 500000000 + user_id%100*1000000 END AS start_us,
  CASE WHEN half=0 THEN 450000000 END AS end_us, {arr(PATHS, "(user_id+half)%8")} AS path
FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([0,1]) AS half)
""")
cte("pids", """
SELECT DISTINCT us//5000000*5000000+2000000 AS snapshot_us, 40000+user_id%20000 AS port,
  CASE WHEN event_type='signup' THEN 17 ELSE 6 END AS protocol, user_id AS pid FROM ev
""")


def code(n: str) -> str:
    return f"(chr(CAST(({n})+65 AS INTEGER)) || chr(CAST(({n})*7%26+65 AS INTEGER)))"


cte("nets", f"""
SELECT base - base % size AS lo, base - base % size + size - 1 AS hi, plen, country_code, asn FROM (
SELECT (c_custkey*2654435761)%4294967296 AS base, 8+c_custkey%17 AS plen, CAST(1 AS BIGINT)<<CAST(24-c_custkey%17 AS BIGINT) AS size,
  {code("c_nationkey")} AS country_code, c_custkey AS asn FROM customer)
""")
cte("nets6", f"SELECT '2001:db8:' || lower(hex(c_custkey%65536)) AS prefix, {code('c_nationkey')} AS country_code, c_custkey AS asn FROM customer")
cte("addr", f"""
SELECT o_orderkey AS order_id, o_orderkey*2246822519%4294967296 AS n,
  CASE WHEN o_orderkey%10=0 THEN '2001:db8:' || lower(hex(o_orderkey//10*5%65536)) || '::1' ELSE {text("(o_orderkey*2246822519%4294967296)")} END AS ip FROM orders
""")
cte("feed", f"""
SELECT CASE WHEN s_suppkey%5=0 THEN NULL ELSE s_suppkey*2*2246822519%4294967296 END AS n, s_suppkey%5 AS m,
  s_suppkey*2654435761%4294967296 AS net, 8+s_suppkey%9 AS plen FROM supplier
""")
cte("csv_feed", """
SELECT n, arg_max(score, line_no) AS score FROM (SELECT c_custkey AS line_no, (c_custkey%700)*3*2246822519%4294967296 AS n,
  CAST('0.' || c_custkey%13 AS FLOAT) AS score FROM customer WHERE c_custkey%11>1) GROUP BY n
""")
LOG_IP = "'203.0.' || (user_id//256%256) || '.' || (user_id%256)"
cte("log", f"""
SELECT 'e' || event_id AS event_id, epoch_us(ts)//1000 AS ts_ms, CASE WHEN event_type='purchase' THEN 'Block' ELSE 'Unblock' END AS action,
  {LOG_IP} AS ip_text, CASE WHEN event_type='purchase' THEN 60000+CAST(floor(value) AS BIGINT)*4000000 END AS ttl_ms,
  'rule ' || event_id%9 AS reason, {arr(DETECTOR_NAMES, "event_id%6")} AS detector, least(floor(value),100)/100 AS score,
  CASE WHEN event_id%11=0 THEN 'send failed' END AS error FROM events WHERE event_type IN ('purchase','error')
""")
cte("verd", f"""
SELECT event_id AS verdict_id, epoch_us(ts)//1000 AS ts_ms, {USER_IP} AS a_ip, CAST(40000+user_id%50 AS INTEGER) AS a_port, {arr(POOL[:9], "event_id%9")} AS b_ip,
  443 AS b_port, 6 AS protocol, CASE WHEN user_id%7<>0 THEN user_id END AS pid, CASE WHEN user_id%9<>0 THEN {arr(PATHS, "user_id%8")} END AS process_path,
  CASE WHEN event_id%4=0 THEN 'h' || event_id%30 || '.example.com' END AS dns_name, CASE WHEN event_id%6<>0 THEN {code("user_id%25")} END AS country_code,
  CASE WHEN event_type IN ('signup','purchase') THEN 'Block' ELSE 'Alert' END AS verdict, 'score ' || event_id%100 AS reason,
  least(floor(value),100)/100 AS composite_score, CASE WHEN event_type IN ('signup','purchase') THEN 60000+CAST(floor(value) AS BIGINT)*1000 END AS ttl_ms,
  CASE WHEN event_id%5<>0 THEN {USER_IP} END AS local_ip, CASE WHEN event_id%3=0 THEN {arr(POOL[:9], "event_id%9")} END AS remote_ip
FROM events WHERE event_type<>'error'
""")
cte("finds", f"""
SELECT event_id AS verdict_id, k AS ord, {arr(DETECTOR_NAMES, "k")} AS detector_id, CAST((event_id+k)%10/10.0 AS FLOAT) AS score,
  CAST(CAST(0.5 AS DOUBLE)+CAST(0.1 AS DOUBLE)*(k%3) AS FLOAT) AS confidence,
  CASE WHEN (event_id+k)%10>7 THEN 3 WHEN (event_id+k)%10>5 THEN 2 WHEN (event_id+k)%10>3 THEN 1 ELSE 0 END AS sev,
  CASE WHEN (event_id*7+k)%13=0 THEN 'TimedOut' WHEN (event_id*7+k)%17=0 THEN 'Errored' ELSE 'Completed' END AS status,
  CASE WHEN (event_id+k)%4<>0 THEN CASE WHEN (event_id+k)%3=0 THEN 'Beacon-like periodicity: 7 connections' WHEN (event_id+k)%3=1 THEN 'DNS query burst: 90 queries' ELSE 'High connection count to IP' END END AS ev_text
FROM (SELECT event_id, unnest([0,1,2,3,4,5]) AS k FROM events WHERE event_type<>'error')
""")
cte("breaker", f"""
SELECT event_id AS id, epoch_us(ts)//1000 AS ts_ms, {arr(DETECTOR_NAMES, "event_id%6")} AS detector_id,
  {arr(["Closed", "Open", "HalfOpen"], "(event_id+1)%3")} AS to_state FROM events WHERE event_type='error'
""")
cte("iface_rows", """
SELECT 'host' || s_suppkey AS host, CAST(0 AS BIGINT) AS ts_us, n=0 AS is_loopback,
  CASE n WHEN 0 THEN 2130706433 WHEN 1 THEN 3232235520+s_suppkey%256*256+(s_suppkey*13%254+1) ELSE 168296448+s_suppkey%256*256+2 END AS ip,
  CASE n WHEN 0 THEN 24 WHEN 1 THEN 8 ELSE 2 END AS hostbits
FROM supplier, (SELECT unnest([0,1,2]) AS n)
""")
cte("route_rows", """
SELECT 'host' || s_suppkey AS host, t*5000000 AS ts_us, n AS route_order,
  CASE WHEN n=2 AND s_suppkey%2=0 THEN '0.0.0.0' ELSE '172.16.' || n || '.0' END AS dst,
  CASE n WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '192.168.' || s_suppkey%256 || '.254' WHEN 2 THEN '192.168.' || s_suppkey%256 || '.1'
    ELSE '10.8.' || s_suppkey%256 || CASE WHEN s_suppkey%3=0 THEN '.2' ELSE '.1' END END AS gateway,
  n=3 AS tunnel, NOT (n<3 AND (s_suppkey+t)%4=0) AS is_up, n IN (1,2) OR (s_suppkey%5=0 AND n=3) AS is_gateway
FROM supplier, (SELECT unnest(generate_series(0,5)) AS t), (SELECT unnest(generate_series(0,3)) AS n)
""")


# The fleet: several users share a host, and hosts use the same ports and pids.
def renamed(body: str, *names: str) -> str:
    for name in names:
        body = re.sub(rf"\b{name}\b", f"fleet_{name}", body)
    return body


_ID = KEY.replace(", ", " || '|' || ")
cte("fleet_packets", f"""
SELECT ts_us, src_ip, dst_ip, CASE WHEN src_port>=40000 THEN 40000+(src_port-40000)%{USERS_PER_HOST} ELSE src_port END AS src_port,
  CASE WHEN dst_port>=40000 THEN 40000+(dst_port-40000)%{USERS_PER_HOST} ELSE dst_port END AS dst_port, protocol, length, local_ip,
  'h' || ({num("local_ip")}-167772160)//{USERS_PER_HOST} AS host FROM packets
""")
cte("fleet_keyed", renamed(CTES["keyed"], "packets"))
cte("fleet_marked", renamed(CTES["marked"].replace(KEY, f"{KEY}, host"), "keyed"))
cte("fleet_bare_flows", renamed(CTES["bare_flows"].replace(_ID, f"{_ID} || '|' || host").replace(KEY, f"{KEY}, host"), "marked"))
cte("fleet_flows", renamed(CTES["net_flows"], "bare_flows").replace("THEN user_no END", f"THEN user_no%{USERS_PER_HOST}+1 END"))
cte("fleet_pids", f"""
SELECT DISTINCT 'h' || user_id//{USERS_PER_HOST} AS host, us//5000000*5000000+2000000 AS snapshot_us, 40000+user_id%{USERS_PER_HOST} AS port,
  CASE WHEN event_type='signup' THEN 17 ELSE 6 END AS protocol, user_id%{USERS_PER_HOST}+1 AS pid FROM ev
""")
cte("fleet_proc", f"SELECT 'h' || pid//{USERS_PER_HOST} AS host, pid%{USERS_PER_HOST}+1 AS pid, start_us, end_us, path FROM proc")
cte("fleet_ticks", f"""
SELECT h, t, 'h' || h AS host, CAST(t*{TICK_US} AS BIGINT) AS ts_us, CASE WHEN (t+h)%3=0 THEN '203.0.113.53' ELSE {arr(POOL, "(h+1)%4")} END AS peer
FROM (SELECT DISTINCT user_id//{USERS_PER_HOST} AS h FROM events), (SELECT unnest(generate_series(0,{TICKS - 1})) AS t)
""")
cte("fleet_own_at", f"""
SELECT host, ts_us, '192.168.' || h%256 || '.2' AS ip FROM fleet_ticks WHERE (t+h)%7<>5 UNION SELECT host, ts_us, '192.168.' || h%256 || '.255' FROM fleet_ticks WHERE (t+h)%7<>5
UNION SELECT host, ts_us, {arr(POOL, "h%4")} FROM fleet_ticks WHERE (t+h)%6>=3
""")
cte("fleet_gateway_at", f"""
SELECT host, ts_us, last_value(gateway IGNORE NULLS) OVER (PARTITION BY host ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS ip
FROM (SELECT host, ts_us, CASE WHEN (t+h)%5<>3 THEN {arr(POOL, "(h+t//4)%9")} WHEN t%4>=1 THEN peer END AS gateway FROM fleet_ticks)
""")
cte("fleet_peer_at", "SELECT host, ts_us, peer AS ip FROM fleet_ticks t WHERE t%4>=1 AND NOT EXISTS (SELECT 1 FROM fleet_own_at o WHERE o.host=t.host AND o.ts_us=t.ts_us AND o.ip=t.peer)")
cte("fleet_numbered", "SELECT host, ts_us, row_number() OVER (PARTITION BY host ORDER BY ts_us) AS n FROM fleet_ticks")


def versions(rows: str) -> str:
    """Intervals of the members (ip) in the snapshots (host, ts_us)."""
    return f"""SELECT v.host, v.ip, v.valid_from, e.ts_us AS valid_to FROM (
  SELECT host, ip, min(ts_us) AS valid_from, max(n) AS last_n FROM (
    SELECT r.host, r.ip, r.ts_us, s.n, s.n - row_number() OVER (PARTITION BY r.host, r.ip ORDER BY s.n) AS run
    FROM {rows} r JOIN fleet_numbered s ON s.host=r.host AND s.ts_us=r.ts_us WHERE r.ip IS NOT NULL) GROUP BY host, ip, run) v
LEFT JOIN fleet_numbered e ON e.host=v.host AND e.n=v.last_n+1"""


for _name in ("own", "gateway", "peer"):
    cte(f"fleet_{_name}_versions", versions(f"fleet_{_name}_at"))
cte("fleet_excluded", "SELECT * FROM fleet_own_versions UNION ALL SELECT * FROM fleet_gateway_versions UNION ALL SELECT * FROM fleet_peer_versions")


def not_in_force(row: str, ip: str, at: str) -> str:
    return (
        f"NOT EXISTS (SELECT 1 FROM fleet_excluded x WHERE x.host={row}.host AND x.ip={row}.{ip} AND {row}.{at}>=x.valid_from "
        f"AND {row}.{at}<coalesce(x.valid_to, 9000000000000000000))"
    )
