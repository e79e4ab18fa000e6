"""The five per-flow detectors.

Each takes flows and returns them with ``<prefix>_score``, ``_confidence``,
``_severity``, ``_hits`` (number of evidence entries), ``_evidence`` and
``_status``. They are projections: no shuffle, and evidence text is only
built when a consumer reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ip as ips
from tidewatch.functions import text
from tidewatch.functions.f32 import add, by_count, evidence_list, f32, ladder, share, tiers
from tidewatch.operators.domains import match_expr
from tidewatch.schema import DETECTORS, SEVERITIES

# List entries and path rules of the detectors, and in each of
# them below its sub-scores, limits and evidence sentences.
DNS_BLOCKLIST = ["malware.example.com", "c2server.evil.net", "phishing.scam.org"]
DNS_ALLOWLIST = ["github.com", "google.com", "cloudflare.com", "amazonaws.com", "apple.com", "microsoft.com"]
SUSPICIOUS_TLDS = ["xyz", "top", "club", "work", "click", "info", "buzz", "gq", "ml", "cf", "ga"]

SAFE_PROCESSES = [
    "Brave Browser", "Brave Browser Helper", "Safari", "SafariHelper", "SafariCloudTabsAgent", "WebContent",
    "firefox", "Google Chrome", "Google Chrome Helper", "Chromium", "Microsoft Edge", "curl", "wget", "ssh",
    "git", "npm", "node", "cargo", "rustc", "Finder", "launchd", "cfprefsd", "nsurlsessiond", "SystemUIServer",
    "ControlCenter", "Spotlight", "mds", "mdworker", "WindowServer", "loginwindow",
]
TEMP_DIRS = ["/tmp/", "/var/tmp/", "/private/tmp/"]
STANDARD_DIRS = [
    "/usr/bin/", "/usr/sbin/", "/usr/libexec/", "/bin/", "/sbin/", "/System/", "/Applications/", "/Library/",
    "/opt/homebrew/bin/", "/opt/homebrew/sbin/", "/opt/homebrew/opt/", "/opt/local/bin/", "/usr/local/bin/",
    "/usr/local/sbin/", "/usr/local/opt/", "/Users/",
]
SHELLS = ["bash", "zsh", "sh", "csh", "tcsh", "ksh", "python", "python3", "perl", "ruby", "node", "php"]

IP_BLOCKLIST = [
    "103.224.182.251", "45.33.32.156", "198.235.24.39", "5.188.62.18", "91.121.89.191", "185.130.5.37",
    "31.184.198.176", "46.166.190.213", "51.15.43.205", "159.203.96.213", "165.227.104.61", "138.68.246.208",
    "167.99.168.196", "206.189.38.112", "178.62.65.200", "142.93.152.79", "188.166.2.99", "128.199.189.95",
    "67.205.160.38", "104.248.53.189",
]
IP_ALLOWLIST = ["8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1"]

VERSION = "1.0.0"


def with_finding(
    df: DataFrame, detector: str, score: Column, confidence: Column, severity: Column, hits: Column, evidence: Column
) -> DataFrame:
    p = DETECTORS[detector]
    return df.withColumns({
        f"{p}_score": score, f"{p}_confidence": confidence, f"{p}_severity": severity,
        f"{p}_hits": hits, f"{p}_evidence": evidence, f"{p}_status": F.lit("Completed"),
    })


def finding_struct(detector: str) -> Column:
    """A detector's columns as one finding."""
    p = DETECTORS[detector]
    return F.struct(
        F.lit(detector).alias("detector_id"), F.lit(VERSION).alias("detector_version"),
        F.col(f"{p}_score").alias("score"), F.col(f"{p}_confidence").alias("confidence"),
        F.col(f"{p}_severity").alias("severity"), F.col(f"{p}_evidence").alias("evidence"),
        F.lit(0).cast("bigint").alias("latency_us"), F.col(f"{p}_status").alias("status"),
    )


def _hits(*values: Column) -> Column:
    return add(*[F.when(v != f32(0), 1).otherwise(0) for v in values])


#: What a flow's age counts from its first packet to: its evaluation (which the
#: idle time precedes), or its last packet.
AGE_MODES = ("evaluation", "active")


def age_us(mode: str = "evaluation") -> Column:
    if mode not in AGE_MODES:
        raise ValueError(f"age_mode is one of {', '.join(AGE_MODES)}, not {mode}")
    return F.col("flow_age_us") if mode == "evaluation" else F.col("last_us") - F.col("first_us")


def age_seconds(mode: str = "evaluation") -> Column:
    return age_us(mode) / F.lit(1e6)


def packet_rate(mode: str = "evaluation") -> Column:
    return F.when(age_us(mode) > 0, F.col("packet_count") / age_seconds(mode)).otherwise(F.lit(0.0))


def bytes_per_packet() -> Column:
    return F.when(F.col("packet_count") > 0, F.col("byte_count") / F.col("packet_count")).otherwise(F.lit(0.0))


def score_dns(
    flows: DataFrame, blocked: Column | None = None, allowed: Column | None = None
) -> DataFrame:
    """Suspicious host names. ``blocked``/``allowed`` replace the short fixed
    lists with flags from ``domains.flag_domains`` for lists of any size."""
    name = F.col("dns_name")
    lower = F.lower(name)
    blocked = match_expr(lower, DNS_BLOCKLIST) if blocked is None else blocked
    if allowed is None:
        allowed = F.lit(False)
        for domain in DNS_ALLOWLIST:
            allowed = allowed | (lower == domain) | lower.endswith("." + domain)
    d = flows.withColumn("_live", name.isNotNull() & ~F.coalesce(allowed, F.lit(False)))
    d = d.withColumns({
        "_entropy": F.when(F.col("_live"), text.shannon_entropy(name)),
        "_len": F.octet_length(name),
        "_longest": F.when(F.col("_live"), text.longest_label(name)),
        "_labels": F.when(F.col("_live"), text.label_count(name)),
    })
    d = d.withColumns({
        "_e1": tiers((F.col("_entropy") > 4.5, 0.8), (F.col("_entropy") > 3.5, 0.4)),
        "_e2": tiers((F.col("_len") > 80, 0.6), (F.col("_len") > 50, 0.3)),
        "_e3": tiers((F.col("_longest") > 40, 0.5), (F.col("_longest") > 25, 0.2)),
        "_e4": tiers((F.col("_labels") > 6, 0.4), (F.col("_labels") > 4, 0.2)),
        "_e5": tiers((text.has_ip_literal(name), 0.7)),
        "_e6": tiers((F.coalesce(blocked, F.lit(False)), 1.0)),
        "_e7": tiers((text.tld(name).isin(SUSPICIOUS_TLDS), 0.3)),
    })
    e = [F.col(f"_e{i}") for i in range(1, 8)]
    live = F.col("_live")
    d = d.withColumns({
        "_total": F.when(live, share(add(*e), 7)).otherwise(f32(0)),
        "_n": F.when(live, _hits(*e)).otherwise(1),
    })
    scored = evidence_list(
        (e[0] > 0, F.concat(F.lit("High entropy: "), text.fixed("_entropy", 2), F.lit(" bits/char")), None),
        (e[1] > 0, F.concat(F.lit("Long hostname: "), F.col("_len").cast("string"), F.lit(" chars")), None),
        (e[2] > 0, F.concat(F.lit("Long label: "), F.col("_longest").cast("string"), F.lit(" chars")), None),
        (e[3] > 0, F.concat(F.lit("Many subdomains: "), F.col("_labels").cast("string"), F.lit(" labels")), None),
        (e[4] > 0, "IP literal embedded in hostname", None),
        (e[5] > 0, "Hostname matches blocklist", name),
        (e[6] > 0, "Suspicious TLD", None),
    )
    skipped = evidence_list(
        (name.isNull(), "No DNS name available", None), (name.isNotNull(), "DNS name is allowlisted", name)
    )
    total = F.col("_total")
    return with_finding(
        d, "DnsAnalyzer", total,
        F.when(live, by_count(F.col("_n"), [(3, 0.9), (2, 0.7), (1, 0.5)], 1.0)).otherwise(f32(1)),
        ladder(total, [(0.7, "Critical"), (0.5, "High"), (0.3, "Medium")], "Low"),
        F.col("_n"), F.when(live, scored).otherwise(skipped),
    ).drop("_live", "_entropy", "_len", "_longest", "_labels", "_total", "_n", *[f"_e{i}" for i in range(1, 8)])


def score_process(flows: DataFrame, use_remote: bool = False) -> DataFrame:
    """Unusual or unknown processes. The external test reads the canonical
    second address; ``use_remote`` reads the resolved remote one."""
    path = F.coalesce("process_path", F.lit(""))
    target = F.col("remote_ip") if use_remote else F.col("b_ip")
    dns_ports = F.col("a_port").isin(53, 5353) | F.col("b_port").isin(53, 5353)
    explained = (
        F.col("pid").isNotNull() | ((F.col("protocol") == 17) & dns_ports)
        | ips.is_infrastructure("a_ip") | ips.is_infrastructure("b_ip")
    )
    d = flows.withColumns({"_path": path, "_base": text.basename(path)})
    path, base = F.col("_path"), F.col("_base")
    d = d.withColumns({
        "_safe": base.isin(SAFE_PROCESSES),
        "_e1": tiers((text.starts_with_any(path, TEMP_DIRS), 0.7)),
        "_e2": tiers((base.isin(SHELLS), 0.6)),
        "_e3": tiers(((path != "") & ~text.starts_with_any(path, STANDARD_DIRS), 0.4)),
        "_e4": F.when(explained, f32(0)).when(ips.is_private_v4_block(target), f32(0.2)).otherwise(f32(0.5)),
    })
    e = [F.col(f"_e{i}") for i in range(1, 5)]
    unknown = (path == "") & F.col("pid").isNull() & (e[3] > 0)
    d = d.withColumns({
        "_unknown": unknown,
        "_total": F.when(F.col("_safe"), f32(0)).when(unknown, e[3]).otherwise(share(add(*e), 4)),
        "_n": F.when(F.col("_safe") | unknown, 1).otherwise(_hits(*e)),
    })
    safe, unknown, total = F.col("_safe"), F.col("_unknown"), F.col("_total")
    scored = evidence_list(
        (e[0] > 0, "Process running from temp directory", path),
        (e[1] > 0, "Shell/interpreter has network activity", path),
        (e[2] > 0, "Process at uncommon location", path),
        (e[3] > 0, "Process attribution failed", None),
    )
    single = evidence_list(
        (safe, "Known safe process", path),
        (~safe, "Process attribution failed — unknown process", None),
    )
    return with_finding(
        d, "ProcessCorrelator", total,
        F.when(safe, f32(1)).when(unknown, f32(0.5)).otherwise(by_count(F.col("_n"), [(2, 0.7), (1, 0.5)], 1.0)),
        F.when(safe, "Low").when(unknown, "Medium").otherwise(ladder(total, [(0.6, "High"), (0.3, "Medium")], "Low")),
        F.col("_n"), F.when(safe | unknown, single).otherwise(scored),
    ).drop("_path", "_base", "_safe", "_unknown", "_total", "_n", *[f"_e{i}" for i in range(1, 5)])


def score_flow_behavior(flows: DataFrame, age_mode: str = "evaluation") -> DataFrame:
    """Traffic shape: rate, packet size, bulk, scan, burst, port mismatch.

    With the age at the evaluation a flow is never younger than its idle time,
    so that a burst shows only with ``age_mode="active"``.
    """
    packets, size, port = F.col("packet_count"), F.col("byte_count"), F.col("remote_port")
    d = flows.withColumns({"_rate": packet_rate(age_mode), "_bpp": bytes_per_packet()})
    rate, bpp, age = F.col("_rate"), F.col("_bpp"), age_seconds(age_mode)
    d = d.withColumns({
        "_e1": tiers((rate > 1000, 0.7), (rate > 500, 0.4), (rate > 100, 0.1)),
        "_e2": tiers(((bpp > 0) & (bpp < 20), 0.5), ((bpp > 1400) & ~port.isin(80, 443, 8443), 0.2)),
        "_e3": tiers(((packets < 50) & (size > 1_000_000), 0.6)),
        "_e4": tiers(((age > 2.0) & (packets > 200) & (size < 10_000), 0.5)),
        "_e5": tiers(((age < 0.5) & (packets > 100), 0.6)),
        "_e6": tiers(((F.col("protocol") == 6) & (port == 53), 0.3)),
    })
    e = [F.col(f"_e{i}") for i in range(1, 7)]
    d = d.withColumns({"_total": share(add(*e), 6), "_n": _hits(*e)})
    count = packets.cast("string")
    evidence = evidence_list(
        (e[0] > 0, F.concat(F.lit("High packet rate: "), text.fixed(rate, 0), F.lit(" pkt/s")), None),
        (e[1] > 0, F.concat(F.lit("Unusual bytes/packet: "), text.fixed(bpp, 0)), None),
        (e[2] > 0, F.concat(F.lit("Bulk transfer: "), count, F.lit(" packets, "), size.cast("string"), F.lit(" bytes")), None),
        (e[3] > 0, "Sustained scanning pattern", None),
        (e[4] > 0, F.concat(F.lit("Burst: "), count, F.lit(" packets in "), text.fixed(age, 2), F.lit("s")), None),
        (e[5] > 0, "Protocol/port mismatch heuristic", None),
    )
    total = F.col("_total")
    return with_finding(
        d, "FlowBehavior", total, by_count(F.col("_n"), [(3, 0.8), (2, 0.6), (1, 0.4)], 1.0),
        ladder(total, [(0.6, "High"), (0.3, "Medium")], "Low"), F.col("_n"), evidence,
    ).drop("_rate", "_bpp", "_total", "_n", *[f"_e{i}" for i in range(1, 7)])


def score_ip_reputation(
    flows: DataFrame, blocklist: list[str] | None = None, allowlist: list[str] | None = None
) -> DataFrame:
    """Both canonical addresses against the lists, plus feed reputation."""
    blocked, allowed = blocklist or IP_BLOCKLIST, allowlist or IP_ALLOWLIST
    a, b, rep = F.col("a_ip"), F.col("b_ip"), F.col("reputation_score")
    d = flows.withColumns({
        "_e1": tiers((a.isin(blocked), 1.0)), "_e2": tiers((b.isin(blocked), 1.0)),
        "_e3": tiers((a.isin(allowed), -0.5)), "_e4": tiers((b.isin(allowed), -0.5)),
        "_e5": tiers((ips.is_rfc1918(a), -0.3)), "_e6": tiers((ips.is_rfc1918(b), -0.3)),
        "_e7": tiers((rep > f32(0.7), 0.8), (rep > f32(0.4), 0.3)),
    })
    e = [F.col(f"_e{i}") for i in range(1, 8)]
    d = d.withColumns({"_total": F.greatest(F.least(add(*e), f32(1)), f32(0)), "_n": _hits(*e)})
    evidence = evidence_list(
        (e[0] > 0, "Source IP matches blocklist", a), (e[1] > 0, "Destination IP matches blocklist", b),
        (e[2] < 0, "Source IP is allowlisted", a), (e[3] < 0, "Destination IP is allowlisted", b),
        (e[4] < 0, "Source IP is RFC1918 (local network)", None),
        (e[5] < 0, "Destination IP is RFC1918 (local network)", None),
        (e[6] > 0, "High reputation score from enrichment", text.fixed(rep, 2)),
    )
    total, n = F.col("_total"), F.col("_n")
    # Nothing known about two public addresses: no confidence either way. A
    # private address always leaves evidence, so no evidence means both public.
    return with_finding(
        d, "IpReputation", total, by_count(n, [(2, 0.8), (1, 0.5)], 0.0),
        ladder(total, [(0.7, "Critical"), (0.4, "High"), (0.2, "Medium")], "Low"), n, evidence,
    ).drop("_total", "_n", *[f"_e{i}" for i in range(1, 8)])


def score_dns_tunnel(flows: DataFrame) -> DataFrame:
    """Data hidden in DNS queries; only UDP port 53 is analysed."""
    name = F.coalesce("dns_name", F.lit(""))
    udp, port = F.col("protocol") == 17, F.col("remote_port")
    d = flows.withColumns({
        "_dns": udp & (port == 53), "_doh": udp & (port == 443), "_rate": packet_rate(), "_bpp": bytes_per_packet(),
    })
    live = F.col("_dns")
    d = d.withColumn("_sub", F.when(live, text.subdomain(name)))
    d = d.withColumns({
        "_entropy": F.when(live, text.shannon_entropy("_sub")),
        "_longest": F.when(live, text.longest_label(name)),
    })
    rate, bpp = F.col("_rate"), F.col("_bpp")
    d = d.withColumns({
        "_e1": tiers((F.col("_entropy") > 4.0, 0.8), (F.col("_entropy") > 3.5, 0.4)),
        "_e2": tiers((F.col("_longest") > 50, 0.7), (F.col("_longest") > 30, 0.4)),
        "_e3": tiers((live & (rate > 10), 0.6), (live & (rate > 5), 0.3)),
        "_e4": tiers((live & (bpp > 500), 0.5), (live & (bpp > 300), 0.2)),
    })
    e = [F.col(f"_e{i}") for i in range(1, 5)]
    d = d.withColumns({
        "_total": F.when(live, share(add(*e), 4)).otherwise(f32(0)), "_n": F.when(live, _hits(*e)).otherwise(1),
    })
    scored = evidence_list(
        (e[0] > 0, F.concat(F.lit("High-entropy subdomain: "), text.fixed("_entropy", 2), F.lit(" bits/char")), F.col("_sub")),
        (e[1] > 0, F.concat(F.lit("Long DNS label: "), F.col("_longest").cast("string"), F.lit(" chars")), None),
        (e[2] > 0, F.concat(F.lit("High query rate: "), text.fixed(rate, 1), F.lit(" pkt/s")), None),
        (e[3] > 0, "Large DNS payload", None),
    )
    skipped = evidence_list(
        (F.col("_doh"), "DNS-over-HTTPS — encrypted, not analyzed", None), (~F.col("_doh"), "Not a DNS flow", None)
    )
    total = F.col("_total")
    return with_finding(
        d, "DnsTunnelDetector", total,
        F.when(live, by_count(F.col("_n"), [(3, 0.8), (2, 0.6), (1, 0.4)], 1.0)).otherwise(f32(1)),
        ladder(total, [(0.6, "Critical"), (0.4, "High"), (0.2, "Medium")], "Low"),
        F.col("_n"), F.when(live, scored).otherwise(skipped),
    ).drop("_dns", "_doh", "_rate", "_bpp", "_sub", "_entropy", "_longest", "_total", "_n", *[f"_e{i}" for i in range(1, 5)])
