"""DuckDB statements of the enrichment, scoring and decision stages."""

from __future__ import annotations

from harness.sql import CTES, build, cte, f, infra, not_in_force, num, public, renamed, rfc1918, v6
from tidewatch.operators import detectors as D


def inlist(values) -> str:
    return "(" + ",".join("'" + v + "'" for v in values) + ")"


def e6(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DOUBLE)*1e6) AS BIGINT)"


def when(*steps: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {f(v)}" for c, v in steps) + f" ELSE {f(0.0)} END"


def plus(n: int) -> str:
    return "+".join(f"e{i}" for i in range(1, n + 1))


def count(n: int) -> str:
    return "+".join(f"CASE WHEN e{i}<>0 THEN 1 ELSE 0 END" for i in range(1, n + 1))


def share(n: int, parts: int) -> str:
    return f"least(CAST(CAST({plus(n)} AS DOUBLE)/{parts} AS FLOAT), {f(1.0)})"


def steps(expr: str, pairs, default, op: str = ">") -> str:
    return "CASE " + " ".join(f"WHEN {expr} {op} {f(c)} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def by_n(pairs, default: float) -> str:
    return "CASE " + " ".join(f"WHEN hits>={n} THEN {f(v)}" for n, v in pairs) + f" ELSE {f(default)} END"


def entropy(s: str) -> str:
    chars = f"list_sort(list_distinct(regexp_extract_all({s}, '.')))"
    n = f"len({s})"
    return (
        f"CASE WHEN {n}=0 THEN 0.0 ELSE list_sum(list_transform({chars}, lambda ch: "
        f"-CAST({n}-len(replace({s}, ch, '')) AS DOUBLE)/{n}*log2(CAST({n}-len(replace({s}, ch, '')) AS DOUBLE)/{n}))) END"
    )


LONGEST = "list_max(list_transform(string_split({0}, '.'), lambda x: len(x)))"
LABELS = "len(list_filter(string_split({0}, '.'), lambda x: x<>''))"
SUB = "CASE WHEN len(string_split({0},'.'))>2 THEN array_to_string(list_slice(string_split({0},'.'),1,len(string_split({0},'.'))-2),'.') || '.' ELSE '' END"
OCT = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
LITERAL = r"regexp_matches({0}, '(^|\.)" + OCT + r"(\." + OCT + r"){{3}}(\.|$)')"
BASE = "regexp_extract(rtrim({0},'/'), '[^/]*$')"


def suffix_match(name: str, entries) -> str:
    return "(" + " OR ".join(f"lower({name})='{e}' OR lower({name}) LIKE '%.{e}'" for e in entries) + ")"


# Enrichment.
cte("pid_until", "SELECT port, protocol, p.snapshot_us, max(pid) AS snap_pid, any_value(until_us) AS until_us FROM pids p JOIN (SELECT snapshot_us, lead(snapshot_us) OVER (ORDER BY snapshot_us) AS until_us FROM (SELECT DISTINCT snapshot_us FROM pids)) u ON p.snapshot_us=u.snapshot_us GROUP BY ALL")
cte("pid_flows", """
SELECT n.* EXCLUDE (pid, local_port), CASE WHEN live THEN local_port ELSE 0 END AS local_port, CASE WHEN live THEN snap_pid END AS pid FROM (
  SELECT f.*, s.snap_pid, s.snap_pid IS NOT NULL AND (s.until_us IS NULL OR f.first_us < s.until_us) AS live
  FROM net_flows f ASOF LEFT JOIN pid_until s ON f.local_port=s.port AND f.protocol=s.protocol AND f.first_us>=s.snapshot_us) n
""")
cte("fleet_pid_flows", """
SELECT n.* EXCLUDE (pid, local_port), CASE WHEN live THEN local_port ELSE 0 END AS local_port, CASE WHEN live THEN snap_pid END AS pid FROM (
  SELECT f.*, s.snap_pid, s.snap_pid IS NOT NULL AND (s.until_us IS NULL OR f.first_us < s.until_us) AS live
  FROM fleet_flows f ASOF LEFT JOIN (SELECT p.host, port, protocol, p.snapshot_us, max(pid) AS snap_pid, any_value(until_us) AS until_us FROM fleet_pids p
    JOIN (SELECT host, snapshot_us, lead(snapshot_us) OVER (PARTITION BY host ORDER BY snapshot_us) AS until_us FROM (SELECT DISTINCT host, snapshot_us FROM fleet_pids)) u
    ON u.host=p.host AND u.snapshot_us=p.snapshot_us GROUP BY ALL) s
  ON f.host=s.host AND f.local_port=s.port AND f.protocol=s.protocol AND f.first_us>=s.snapshot_us) n
""")
cte("fleet_proc_flows", """
SELECT f.*, CASE WHEN f.first_us < coalesce(p.end_us, 9e18) THEN p.path END AS process_path,
  CASE WHEN f.first_us < coalesce(p.end_us, 9e18) THEN p.start_us END AS process_start_us
FROM fleet_pid_flows f ASOF LEFT JOIN fleet_proc p ON f.host=p.host AND f.pid=p.pid AND f.first_us>=p.start_us
""")
cte("proc_flows", """
SELECT f.*, CASE WHEN f.first_us < coalesce(p.end_us, 9e18) THEN p.path END AS process_path,
  CASE WHEN f.first_us < coalesce(p.end_us, 9e18) THEN p.start_us END AS process_start_us
FROM net_flows f ASOF LEFT JOIN proc p ON f.pid=p.pid AND f.first_us>=p.start_us
""")
cte("named_flows", "SELECT f.*, p.name AS dns_name FROM proc_flows f ASOF LEFT JOIN ptr p ON f.remote_ip=p.ip AND f.first_us>=p.ts_us")
cte("feed_scores", f"""
SELECT ip, CASE WHEN n IN (SELECT n FROM csv_feed) THEN (SELECT max(score) FROM csv_feed c WHERE c.n=q.n)
  WHEN EXISTS (SELECT 1 FROM feed d WHERE d.m=0 AND d.net>>(32-d.plen)=q.n>>(32-d.plen)) THEN {f(1.0)}
  WHEN EXISTS (SELECT 1 FROM feed d WHERE d.m>2 AND d.n=q.n) THEN {f(1.0)} END AS reputation_score
FROM (SELECT DISTINCT ip, CASE WHEN {v6("ip")} THEN NULL ELSE n END AS n FROM addr WHERE {public("ip")}) q
""")
cte("pool_ips", f"SELECT DISTINCT CASE WHEN {public('dst_ip')} THEN dst_ip ELSE src_ip END AS ip FROM net_flows")
cte("pool_geo", f"""
SELECT q.ip, arg_max(t.country_code, (t.plen, t.country_code)) AS country_code, arg_max(t.asn, (t.plen, t.asn)) AS asn
FROM pool_ips q JOIN nets t ON {num("q.ip")} BETWEEN t.lo AND t.hi WHERE {public("q.ip")} GROUP BY q.ip
UNION ALL SELECT q.ip, max(t.country_code), max(t.asn) FROM pool_ips q JOIN nets6 t ON regexp_replace(q.ip, '^2001:db8::.*', '2001:db8:0')=t.prefix GROUP BY q.ip
""")
cte("pool_rep", f"""
SELECT ip, CASE WHEN {num("ip")} IN (SELECT n FROM csv_feed) THEN (SELECT max(score) FROM csv_feed c WHERE c.n={num("q.ip")})
  WHEN EXISTS (SELECT 1 FROM feed d WHERE d.m=0 AND d.net>>(32-d.plen)={num("q.ip")}>>(32-d.plen)) THEN {f(1.0)}
  WHEN EXISTS (SELECT 1 FROM feed d WHERE d.m>2 AND d.n={num("q.ip")}) THEN {f(1.0)} END AS reputation_score
FROM pool_ips q WHERE {public("q.ip")}
""")
cte("rich_flows", f"""
SELECT f.*, g.country_code, g.asn, r.reputation_score FROM named_flows f
LEFT JOIN pool_geo g ON g.ip=CASE WHEN {public("f.dst_ip")} THEN f.dst_ip ELSE f.src_ip END
LEFT JOIN pool_rep r ON r.ip=CASE WHEN {public("f.dst_ip")} THEN f.dst_ip ELSE f.src_ip END
""")
cte("fleet_rich_flows", f"""
SELECT f.*, n.name AS dns_name, g.country_code, g.asn, r.reputation_score FROM fleet_proc_flows f ASOF LEFT JOIN ptr n ON f.remote_ip=n.ip AND f.first_us>=n.ts_us
LEFT JOIN pool_geo g ON g.ip=CASE WHEN {public("f.dst_ip")} THEN f.dst_ip ELSE f.src_ip END
LEFT JOIN pool_rep r ON r.ip=CASE WHEN {public("f.dst_ip")} THEN f.dst_ip ELSE f.src_ip END
""")

# Cross-flow counters.
cte("conn", f"SELECT flow_id, first_us AS ts_us, pid, coalesce(pid,0) AS pid0, remote_ip, remote_port, protocol FROM net_flows WHERE NOT {infra('remote_ip')}")
cte("conn_marked", """
SELECT *, sum(fresh) OVER (PARTITION BY pid0, remote_ip ORDER BY ts_us, flow_id ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT *, CASE WHEN ts_us-lag(ts_us) OVER (PARTITION BY pid0, remote_ip ORDER BY ts_us, flow_id) <= 60000000 THEN 0 ELSE 1 END AS fresh FROM conn)
""")
cte("conn_counts", """
SELECT pid0, remote_ip, ts_us, max(c) AS scan_count, max(d) AS dns_count FROM (SELECT pid0, remote_ip, ts_us,
 count(*) OVER w AS c, CAST(sum(CASE WHEN protocol=17 AND remote_port=53 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS d
FROM conn_marked WINDOW w AS (PARTITION BY pid0, remote_ip, run ORDER BY ts_us, flow_id ROWS UNBOUNDED PRECEDING)) GROUP BY ALL
""")
cte("ends", f"""
SELECT * FROM (SELECT flow_id, eval_us, pid, coalesce(pid,0) AS pid0, protocol, 'a' AS side, a_ip AS ip, a_port AS port FROM net_flows
UNION ALL SELECT flow_id, eval_us, pid, coalesce(pid,0), protocol, 'b', b_ip, b_port FROM net_flows) WHERE NOT {infra("ip")}
""")
cte("scan_at", """
SELECT e.flow_id, e.side, CASE WHEN e.eval_us-c.ts_us<=60000000 THEN c.scan_count ELSE 0 END AS scan_count,
  CASE WHEN e.eval_us-c.ts_us<=60000000 THEN c.dns_count ELSE 0 END AS dns_count
FROM ends e ASOF LEFT JOIN conn_counts c ON e.pid0=c.pid0 AND e.ip=c.remote_ip AND e.eval_us>=c.ts_us
""")
cte("beacon_cum", """
SELECT remote_ip, remote_port, protocol, ts_us, sum(CASE WHEN d<=60000000 THEN d*d ELSE 0 END) OVER (PARTITION BY remote_ip, remote_port, protocol ORDER BY ts_us, flow_id ROWS UNBOUNDED PRECEDING) AS cum
FROM (SELECT *, ts_us-lag(ts_us) OVER (PARTITION BY remote_ip, remote_port, protocol ORDER BY ts_us, flow_id) AS d FROM conn)
""")
cte("beacon_at", """
SELECT flow_id, side, n AS beacon_n, CASE WHEN n>1 AND tot>0 THEN tot/(n-1)/1e6 END AS mean_s,
  CASE WHEN n>1 AND tot>0 THEN sqrt(greatest((n-1)*sq/(tot*tot)-1e0, 0e0)) END AS cv FROM (
SELECT flow_id, side, probe, CAST(count(ev) OVER w AS DOUBLE) AS n, CAST(max(ev) OVER w - min(ev) OVER w AS DOUBLE) AS tot, CAST(max(cum) OVER w - min(cum) OVER w AS DOUBLE) AS sq
FROM (SELECT remote_ip AS ip, remote_port AS port, protocol, ts_us AS at_us, ts_us AS ev, cum, NULL AS flow_id, NULL AS side, false AS probe FROM beacon_cum
  UNION ALL SELECT ip, port, protocol, eval_us, NULL, NULL, flow_id, side, true FROM ends)
WINDOW w AS (PARTITION BY ip, port, protocol ORDER BY at_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)) WHERE probe AND n>0
""")
cte("spread_at", """
SELECT flow_id, distinct_ips, conns FROM (
SELECT flow_id, probe, count(DISTINCT remote_ip) OVER w AS distinct_ips, count(remote_ip) OVER w AS conns
FROM (SELECT pid, ts_us AS at_us, remote_ip, NULL AS flow_id, false AS probe FROM conn WHERE pid IS NOT NULL
  UNION ALL SELECT pid, eval_us, NULL, flow_id, true FROM net_flows WHERE pid IS NOT NULL)
WINDOW w AS (PARTITION BY pid ORDER BY at_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW)) WHERE probe AND conns>0
""")
cte("cross_at", """
SELECT f.flow_id, coalesce(sa.scan_count,0) AS scan_a, coalesce(sa.dns_count,0) AS dns_a, coalesce(sb.scan_count,0) AS scan_b, coalesce(sb.dns_count,0) AS dns_b,
 ba.beacon_n AS n_a, ba.mean_s AS mean_a, ba.cv AS cv_a, bb.beacon_n AS n_b, bb.mean_s AS mean_b, bb.cv AS cv_b, coalesce(d.distinct_ips,0) AS distinct_ips, coalesce(d.conns,0) AS conns
FROM net_flows f LEFT JOIN scan_at sa ON sa.flow_id=f.flow_id AND sa.side='a' LEFT JOIN scan_at sb ON sb.flow_id=f.flow_id AND sb.side='b'
LEFT JOIN beacon_at ba ON ba.flow_id=f.flow_id AND ba.side='a' LEFT JOIN beacon_at bb ON bb.flow_id=f.flow_id AND bb.side='b'
LEFT JOIN spread_at d ON d.flow_id=f.flow_id
""")

# The same for a fleet, each host by itself and without what it excluded at the
# time: names of a host's own pids and remotes begin with the host.
cte("fleet_net_flows", "SELECT * REPLACE (host || '/' || pid AS pid) FROM fleet_flows")
cte("fleet_conn", f"""
SELECT flow_id, first_us AS ts_us, host || '/' || pid AS pid, host || '/' || coalesce(pid,0) AS pid0, host || '/' || remote_ip AS remote_ip, remote_port, protocol
FROM fleet_flows f WHERE NOT {infra('remote_ip')} AND {not_in_force("f", "remote_ip", "first_us")}
""")
cte("fleet_ends", f"""
SELECT * REPLACE (host || '/' || ip AS ip) FROM (
  SELECT host, flow_id, eval_us, host || '/' || pid AS pid, host || '/' || coalesce(pid,0) AS pid0, protocol, 'a' AS side, a_ip AS ip, a_port AS port FROM fleet_flows
  UNION ALL SELECT host, flow_id, eval_us, host || '/' || pid, host || '/' || coalesce(pid,0), protocol, 'b', b_ip, b_port FROM fleet_flows) e
WHERE NOT {infra("ip")} AND {not_in_force("e", "ip", "eval_us")}
""")
_chain = ("conn_marked", "conn_counts", "scan_at", "beacon_cum", "beacon_at", "spread_at", "cross_at")
for _name in _chain:
    cte(f"fleet_{_name}", renamed(CTES[_name], "net_flows", "conn", "ends", *_chain))


def scan_part(side: str, which: str) -> str:
    high = {"score": (0.9, 0.7, 0.8, 0.5), "conf": (0.95, 0.8, 0.7, 0.5)}[which]
    return (
        f"greatest({when((f'scan_{side}>200', high[0]), (f'scan_{side}>100', high[1]))},"
        f"{when((f'dns_{side}>80', high[2]), (f'dns_{side}>30', high[3]))})"
    )


def beacon_part(side: str, which: str) -> str:
    hi, lo = {"score": (0.7, 0.6), "conf": (0.75, 0.6)}[which]
    ok = f"n_{side}>=5 AND mean_{side}>=2 AND mean_{side}<=15"
    return when((f"{ok} AND n_{side}>=10 AND cv_{side}<0.2", hi), (f"{ok} AND cv_{side}<0.3", lo))


def spread_part(which: str) -> str:
    a, b, c = {"score": (0.65, 0.5, 0.3), "conf": (0.75, 0.55, 0.4)}[which]
    return when(("conns>=512", a), ("distinct_ips>50", b), ("distinct_ips>20", c))


_parts = ", ".join(
    f"{fn} AS {w[0]}{i}" for w in ("score", "conf")
    for i, fn in enumerate([scan_part("a", w), scan_part("b", w), beacon_part("a", w), beacon_part("b", w), spread_part(w)], 1)
)
_hits = "+".join([
    f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in
    ("scan_a>100", "dns_a>30", "scan_b>100", "dns_b>30", "s3>0", "s4>0", "s5>0")
])
cte("d6", f"""
SELECT flow_id, score, CASE WHEN score=0 THEN {f(0.0)} WHEN s1=score THEN c1 WHEN s2=score THEN c2 WHEN s3=score THEN c3 WHEN s4=score THEN c4 ELSE c5 END AS conf,
  {steps("score", [(0.85, 3), (0.5, 2), (0.3, 1)], 0, ">=")} AS sev, {_hits} AS hits
FROM (SELECT *, greatest(s1,s2,s3,s4,s5) AS score FROM (SELECT *, {_parts} FROM cross_at))
""")

# Per-flow detectors.
cte("d1", f"""
SELECT flow_id, CASE WHEN live THEN total ELSE {f(0.0)} END AS score, CASE WHEN live THEN {by_n([(3, .9), (2, .7), (1, .5)], 1.0)} ELSE {f(1.0)} END AS conf,
  CASE WHEN live THEN {steps("total", [(.7, 3), (.5, 2), (.3, 1)], 0)} ELSE 0 END AS sev, CASE WHEN live THEN hits ELSE 1 END AS hits FROM (
SELECT *, {share(7, 7)} AS total, {count(7)} AS hits FROM (
SELECT *, {when(("ent>4.5", .8), ("ent>3.5", .4))} AS e1, {when(("len(dns_name)>80", .6), ("len(dns_name)>50", .3))} AS e2,
  {when(("longest>40", .5), ("longest>25", .2))} AS e3, {when(("labels>6", .4), ("labels>4", .2))} AS e4,
  {when((LITERAL.format("dns_name"), .7))} AS e5, {when((suffix_match("dns_name", D.DNS_BLOCKLIST), 1.0))} AS e6,
  {when((f"lower(regexp_extract(dns_name,'[^.]*$')) IN {inlist(D.SUSPICIOUS_TLDS)}", .3))} AS e7
FROM (SELECT flow_id, dns_name, dns_name IS NOT NULL AND NOT {suffix_match("dns_name", D.DNS_ALLOWLIST)} AS live,
  ent, {LONGEST.format("dns_name")} AS longest, {LABELS.format("dns_name")} AS labels FROM rich_flows LEFT JOIN name_entropy USING (dns_name))))
""")
cte("name_entropy", f"SELECT dns_name, {entropy('dns_name')} AS ent, {SUB.format('dns_name')} AS sub FROM (SELECT DISTINCT dns_name FROM host_names)")
cte("d2", f"""
SELECT flow_id, CASE WHEN safe THEN {f(0.0)} WHEN unknown THEN e4 ELSE total END AS score,
  CASE WHEN safe THEN {f(1.0)} WHEN unknown THEN {f(0.5)} ELSE {by_n([(2, .7), (1, .5)], 1.0)} END AS conf,
  CASE WHEN safe THEN 0 WHEN unknown THEN 1 ELSE {steps("total", [(.6, 2), (.3, 1)], 0)} END AS sev, CASE WHEN safe OR unknown THEN 1 ELSE hits END AS hits FROM (
SELECT *, {share(4, 4)} AS total, {count(4)} AS hits, p='' AND pid IS NULL AND e4>0 AS unknown FROM (
SELECT *, base IN {inlist(D.SAFE_PROCESSES)} AS safe, {when(("(" + " OR ".join(f"starts_with(p,'{d}')" for d in D.TEMP_DIRS) + ")", .7))} AS e1,
  {when((f"base IN {inlist(D.SHELLS)}", .6))} AS e2, {when(("p<>'' AND NOT (" + " OR ".join(f"starts_with(p,'{d}')" for d in D.STANDARD_DIRS) + ")", .4))} AS e3,
  CASE WHEN pid IS NOT NULL OR (protocol=17 AND (a_port IN (53,5353) OR b_port IN (53,5353))) OR {infra("a_ip")} OR {infra("b_ip")} THEN {f(0.0)}
    WHEN NOT {v6("b_ip")} AND ({num("b_ip")}>>24=10 OR {num("b_ip")}>>20=2753 OR {num("b_ip")}>>16=49320) THEN {f(0.2)} ELSE {f(0.5)} END AS e4
FROM (SELECT *, coalesce(process_path,'') AS p, {BASE.format("coalesce(process_path,'')")} AS base FROM rich_flows)))
""")
RATE = "CASE WHEN flow_age_us>0 THEN packet_count/(flow_age_us/1e6) ELSE 0e0 END"
BPP = "CASE WHEN packet_count>0 THEN CAST(byte_count AS DOUBLE)/packet_count ELSE 0e0 END"
cte("d3", f"""
SELECT flow_id, total AS score, {by_n([(3, .8), (2, .6), (1, .4)], 1.0)} AS conf, {steps("total", [(.6, 2), (.3, 1)], 0)} AS sev, hits FROM (
SELECT *, {share(6, 6)} AS total, {count(6)} AS hits FROM (
SELECT *, {when(("rate>1000", .7), ("rate>500", .4), ("rate>100", .1))} AS e1, {when(("bpp>0 AND bpp<20", .5), ("bpp>1400 AND remote_port NOT IN (80,443,8443)", .2))} AS e2,
  {when(("packet_count<50 AND byte_count>1000000", .6))} AS e3, {when(("flow_age_us/1e6>2 AND packet_count>200 AND byte_count<10000", .5))} AS e4,
  {when(("flow_age_us/1e6<0.5 AND packet_count>100", .6))} AS e5, {when(("protocol=6 AND remote_port=53", .3))} AS e6
FROM (SELECT *, {RATE} AS rate, {BPP} AS bpp FROM rich_flows)))
""")
cte("d4", f"""
SELECT flow_id, total AS score, {by_n([(2, .8), (1, .5)], 0.0)} AS conf, {steps("total", [(.7, 3), (.4, 2), (.2, 1)], 0)} AS sev, hits FROM (
SELECT *, greatest(least({plus(7)}, {f(1.0)}), {f(0.0)}) AS total, {count(7)} AS hits FROM (
SELECT *, {when((f"a_ip IN {inlist(D.IP_BLOCKLIST)}", 1.0))} AS e1, {when((f"b_ip IN {inlist(D.IP_BLOCKLIST)}", 1.0))} AS e2,
  {when((f"a_ip IN {inlist(D.IP_ALLOWLIST)}", -.5))} AS e3, {when((f"b_ip IN {inlist(D.IP_ALLOWLIST)}", -.5))} AS e4,
  {when((rfc1918("a_ip"), -.3))} AS e5, {when((rfc1918("b_ip"), -.3))} AS e6,
  {when((f"reputation_score>{f(.7)}", .8), (f"reputation_score>{f(.4)}", .3))} AS e7 FROM rich_flows))
""")
cte("d5", f"""
SELECT flow_id, CASE WHEN live THEN total ELSE {f(0.0)} END AS score, CASE WHEN live THEN {by_n([(3, .8), (2, .6), (1, .4)], 1.0)} ELSE {f(1.0)} END AS conf,
  CASE WHEN live THEN {steps("total", [(.6, 3), (.4, 2), (.2, 1)], 0)} ELSE 0 END AS sev, CASE WHEN live THEN hits ELSE 1 END AS hits FROM (
SELECT *, {share(4, 4)} AS total, {count(4)} AS hits FROM (
SELECT *, {when(("ent>4.0", .8), ("ent>3.5", .4))} AS e1, {when(("longest>50", .7), ("longest>30", .4))} AS e2, {when(("rate>10", .6), ("rate>5", .3))} AS e3,
  {when(("bpp>500", .5), ("bpp>300", .2))} AS e4 FROM (
SELECT *, protocol=17 AND remote_port=53 AS live, {RATE} AS rate, {BPP} AS bpp, {LONGEST.format("coalesce(dns_name,'')")} AS longest, sub_ent AS ent
FROM rich_flows LEFT JOIN (SELECT dns_name, {entropy("sub")} AS sub_ent FROM name_entropy) USING (dns_name))))
""")
_d = [f"d{i}" for i in range(1, 7)]
cte("scored", "SELECT flow_id, " + ", ".join(
    f"{d}.score AS {d}s, {d}.conf AS {d}c, {d}.sev AS {d}v, {d}.hits AS {d}h" for d in _d
) + " FROM d1 " + " ".join(f"JOIN {d} USING (flow_id)" for d in _d[1:]))
_adj = [f"{d}s*{d}c" for d in _d]
_rev = list(reversed(list(zip(_d, D.DETECTORS))))
cte("decided", f"""
SELECT *, CASE WHEN total>={f(.7)} AND (override OR n>=2) THEN 'Block' WHEN total>={f(.3)} THEN 'Alert' ELSE 'Allow' END AS verdict FROM (
SELECT *, least({"+".join(_adj)}, {f(1.0)}) AS total, {"+".join(f"CASE WHEN {a}>0 THEN 1 ELSE 0 END" for a in _adj)} AS n,
  {" OR ".join(f"{a}>={f(.85)}" for a in _adj)} AS override, greatest({",".join(f"CASE WHEN {d}s>0 THEN {d}v END" for d in _d)}) AS worst,
  CASE {" ".join(f"WHEN {d}s*{d}c=greatest({','.join(_adj)}) THEN '{name}'" for d, name in _rev)} END AS top_detector FROM scored)
""")
TTL = "CASE WHEN verdict='Block' THEN CAST(CASE coalesce(worst,1) WHEN 3 THEN 3600000 WHEN 2 THEN 900000 WHEN 1 THEN 300000 ELSE 60000 END AS BIGINT) END"
DECIDED = build("""
SELECT r.flow_id, r.remote_ip, d.verdict, """ + e6("total") + """ AS composite_e6, n AS detectors_scoring, override, top_detector, """ + TTL + """ AS ttl_ms
FROM decided d JOIN rich_flows r USING (flow_id)""")


def detector_sql(d: str) -> str:
    return build(f"SELECT flow_id, {e6('score')} AS score_e6, {e6('conf')} AS confidence_e6, ['Low','Medium','High','Critical'][sev+1] AS severity, CAST(hits AS INTEGER) AS hits FROM {d}")
