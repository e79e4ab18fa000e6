"""Cross-flow state as of a flow's evaluation, and the detector over it.

All measures are sweeps over time: an event adds to a counter when it arrives
and takes it back when it leaves the window, and a flow's evaluation is a
probe in the same order. Sweeps run in time slices, so a busy process or remote
address never sits in one task. Where a window bounds how far a probe looks
back, a slice gets the events of the one before too and needs no other
exchange; counts of sessions, which have no such bound, are carried from slice
to slice (``plans.sliced``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import ip as ips
from tidewatch.functions.f32 import f32, ladder
from tidewatch.functions.text import compact_id, fixed, full_id
from tidewatch.functions.times import SECOND_US, slot
from tidewatch.operators.detectors import with_finding
from tidewatch.operators.topology import exclude_ips
from tidewatch.plans.lineage import stage, unstage
from tidewatch.plans.sliced import session_running
from tidewatch.plans.versions import shared_owner

# Windows and thresholds.
WINDOW_S = 60
DIVERSITY_S = 10
SCAN_HIGH, SCAN_MEDIUM = 200, 100
DNS_HIGH, DNS_MEDIUM = 80, 30
BEACON_MIN_HIGH, BEACON_MIN_MEDIUM = 10, 5
BEACON_CV_HIGH, BEACON_CV_MEDIUM = 0.2, 0.3
BEACON_MEAN_MIN_S, BEACON_MEAN_MAX_S = 2.0, WINDOW_S / 4
DIVERSITY_HIGH, DIVERSITY_MEDIUM = 50, 20
MAX_PID_ENTRIES = 512

_ARRIVE, _PROBE, _LEAVE = 0, 1, 2


def connections(flows: DataFrame, excluded: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """One row per new flow: what the cross-flow counters count.

    ``excluded`` are addresses that are never counted, see
    ``topology.exclude_ips``. Flows with a host keep it, and counters are then
    those of the host.
    """
    rows = flows.filter(F.col("remote_ip").isNotNull()).select(
        *shared_owner(flows), "flow_id", F.col("first_us").alias("ts_us"), "pid", "remote_ip", "protocol", "remote_port"
    )
    return exclude_ips(rows, excluded)


def scan_counts(events: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Connections and DNS queries per (pid, remote) in the running session.

    Without ``probes`` every event is returned with the counts it produced;
    with ``probes`` (pid, ip, ts_us and any id columns) the probes are.
    """
    host = shared_owner(events) if probes is None else shared_owner(events, probes)
    keys = [*[f"_{h}" for h in host], "_pid", "_ip"]
    dns = (F.col("protocol") == 17) & (F.col("remote_port") == 53)
    facts = events.select(
        *[F.col(h).alias(f"_{h}") for h in host],
        F.coalesce("pid", F.lit(0)).cast("bigint").alias("_pid"), F.col("remote_ip").alias("_ip"), "ts_us",
        F.lit(True).alias("_event"), F.when(dns, 1).otherwise(0).alias("_dns"),
        F.struct(*events.columns).alias("_row"),
    )
    if probes is not None:
        asked = probes.select(
            *[F.col(h).alias(f"_{h}") for h in host],
            F.coalesce("pid", F.lit(0)).cast("bigint").alias("_pid"), F.col("ip").alias("_ip"), "ts_us",
            F.lit(False).alias("_event"), F.lit(0).alias("_dns"), F.struct(*[c for c in probes.columns if c not in (*host, "ip", "ts_us")]).alias("_row"),
        )
        facts = facts.drop("_row").withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    counted = session_running(
        facts, keys, "ts_us", "_event", WINDOW_S * SECOND_US,
        {"scan_count": F.lit(1).cast("bigint"), "dns_count": F.col("_dns").cast("bigint")},
    )
    if probes is None:
        return counted.select("_row.*", "scan_count", "dns_count")
    # What the keys tell isn't carried twice; a missing pid is another one than 0 in the row.
    told = {**{h: f"_{h}" for h in host}, "ip": "_ip", "ts_us": "ts_us"}
    own = [F.col(told.get(c, f"_row.{c}")).alias(c) for c in probes.columns]
    return counted.filter(~F.col("_event")).select(*own, "scan_count", "dns_count")


def _timeline(
    events: DataFrame, probes: DataFrame, keys: dict[str, str], asked: dict[str, str], extra: list[str], window: int
) -> tuple[DataFrame, list[str]]:
    """Events and probes in slices as wide as the window, ready for one exchange.

    An event goes to its own slice and to the next, so that whatever a probe
    looks back upon is in the probe's slice, and slices need nothing of each
    other. Returns the rows and the columns that partition them.
    """
    at = F.explode(F.array(slot("ts_us", window), slot("ts_us", window) + 1)).alias("_slice")
    facts = events.select(*[F.col(theirs).alias(mine) for mine, theirs in keys.items()], "ts_us", F.lit(_ARRIVE).alias("_kind"), *extra, at)
    told = [*asked.values(), "ts_us"]  # not carried twice, see _rows
    rest = [c for c in probes.columns if c not in told] or told[-1:]
    row = F.struct(*rest).alias("_row")
    wanted = probes.select(
        *[F.col(theirs).alias(mine) for mine, theirs in asked.items()], "ts_us", F.lit(_PROBE).alias("_kind"), row,
        slot("ts_us", window).alias("_slice"),
    )
    part = [*keys, "_slice"]
    return facts.unionByName(wanted, allowMissingColumns=True).repartition(*part), part


def _rows(probes: DataFrame, asked: dict[str, str]) -> list[Column]:
    """The probes' columns after a sweep."""
    told = {theirs: mine for mine, theirs in asked.items()} | {"ts_us": "m._at"}
    return [F.col(told.get(c, f"_row.{c}")).alias(c) for c in probes.columns]


def beacon_stats(events: DataFrame, probes: DataFrame) -> DataFrame:
    """Regularity of connections to (ip, port, protocol) in the last minute.

    Adds the number of connections ``beacon_n``, the mean interval in seconds
    and the coefficient of variation, from exact integer sums of intervals and
    their squares.
    """
    window = WINDOW_S * SECOND_US
    host = {f"_{h}": h for h in shared_owner(events, probes)}
    asked = {**host, "_ip": "ip", "_port": "port", "_protocol": "protocol"}
    rows, part = _timeline(
        events, probes, {**host, "_ip": "remote_ip", "_port": "remote_port", "_protocol": "protocol"}, asked, [], window)
    # The order of equal times is all the same: they are no interval apart.
    before = Window.partitionBy(*part).orderBy("ts_us", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    paired = rows.withColumn("_prev", F.last(F.when(F.col("_kind") == _ARRIVE, F.col("ts_us")), ignorenulls=True).over(before))
    gap = F.when(F.col("ts_us") - F.col("_prev") <= window, F.col("ts_us") - F.col("_prev"))
    zero = F.lit(0).cast("bigint")

    def move(at: Column, kind: int, n: int, interval: Column) -> Column:
        return F.struct(
            at.alias("_at"), F.lit(kind).alias("_move"), F.lit(n).cast("bigint").alias("_n"),
            interval.alias("_d"), (interval * F.abs(interval)).alias("_d2"),
        )

    # The interval to the previous event leaves together with that event.
    arrivals = F.array_compact(F.array(
        move(F.col("ts_us"), _ARRIVE, 1, F.coalesce(gap, zero)), move(F.col("ts_us") + window, _LEAVE, -1, zero),
        F.when(gap.isNotNull(), move(F.col("_prev") + window, _LEAVE, 0, -gap)),
    ))
    moves = F.when(F.col("_kind") == _ARRIVE, arrivals).otherwise(F.array(move(F.col("ts_us"), _PROBE, 0, zero)))
    swept = _swept(paired.select(*part, "_row", F.explode(moves).alias("m")), part, {"beacon_n": "_n", "_sum": "_d", "_squares": "_d2"})
    intervals = (F.col("beacon_n") - 1).cast("double")
    total, squares = F.col("_sum").cast("double"), F.col("_squares").cast("double")
    enough = (F.col("beacon_n") > 1) & (F.col("_sum") > 0)
    return swept.select(
        *_rows(probes, asked), "beacon_n",
        F.when(enough, total / intervals / F.lit(1e6)).alias("beacon_mean_s"),
        F.when(enough, F.sqrt(F.greatest(intervals * squares / (total * total) - F.lit(1.0), F.lit(0.0)))).alias("beacon_cv"),
    )


def _swept(moves: DataFrame, part: list[str], sums: dict[str, str]) -> DataFrame:
    """Probes with the running sums of the moves ``m`` before them."""
    upto = Window.partitionBy(*part).orderBy("m._at", "m._move").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = moves.withColumns({name: F.sum(f"m.{column}").over(upto) for name, column in sums.items()})
    return added.filter(F.col("m._move") == _PROBE)


def pid_diversity(events: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct remotes of a process in the last seconds, and connections.

    A remote counts from a connection until the window has passed since, and
    is taken over by the remote's next connection before that, so it counts
    once however often it is contacted.
    """
    window = DIVERSITY_S * SECOND_US
    host = {f"_{h}": h for h in shared_owner(events, probes)}
    key = {**host, "_pid": "pid"}
    rows, part = _timeline(
        events.filter(F.col("pid").isNotNull()), probes.filter(F.col("pid").isNotNull()), key, key, ["remote_ip"], window)
    remote = Window.partitionBy(*part, "remote_ip").orderBy("ts_us")
    paired = rows.withColumns({"_prev": F.lag("ts_us").over(remote), "_next": F.lead("ts_us").over(remote)})
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def move(at: Column, kind: int, ips_: Column, conns: Column) -> Column:
        return F.struct(at.alias("_at"), F.lit(kind).alias("_move"), ips_.alias("_ips"), conns.alias("_conns"))

    # A connection within the window after another of its remote goes on with that one's presence.
    begins = F.when(F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") > window), one).otherwise(zero)
    ends = F.when(F.col("_next").isNull() | (F.col("_next") - F.col("ts_us") > window), -one).otherwise(zero)
    moves = F.when(F.col("_kind") == _ARRIVE, F.array(
        move(F.col("ts_us"), _ARRIVE, begins, one), move(F.col("ts_us") + window, _LEAVE, ends, -one),
    )).otherwise(F.array(move(F.col("ts_us"), _PROBE, zero, zero)))
    swept = _swept(paired.select(*part, "_row", F.explode(moves).alias("m")), part, {"distinct_ips": "_ips", "pid_connections": "_conns"})
    return swept.select(*_rows(probes, key), "distinct_ips", "pid_connections", (F.col("pid_connections") >= MAX_PID_ENTRIES).alias("at_cap"))


def crossflow_lookup(flows: DataFrame, events: DataFrame, excluded: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """Flows with every counter as of their ``eval_us``.

    Both canonical ends are looked up. Adds ``scan_a``, ``dns_a``, ``scan_b``,
    ``dns_b``, ``beacon_a``, ``beacon_b`` (n, mean_s, cv) and ``diversity``
    (distinct_ips, at_cap).
    """
    return with_counters(flows, crossflow_counters(flows, events, excluded), excluded)


def with_counters(flows: DataFrame, counters: DataFrame, excluded: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    joined = flows.join(counters, "flow_id", "left")
    if excluded is None:  # else only the counters tell which ends were asked about
        nothing = F.struct(F.lit(0).cast("bigint").alias("beacon_n"), *[F.lit(None).cast("double").alias(c) for c in ("beacon_mean_s", "beacon_cv")])
        joined = joined.withColumns({
            f"beacon_{s}": F.coalesce(f"beacon_{s}", F.when(~ips.is_infrastructure(f"{s}_ip"), nothing)) for s in "ab"})
    return counted(joined)


def counted(joined: DataFrame) -> DataFrame:
    return joined.withColumns({
        "scan_a": F.coalesce("_sa.scan_count", F.lit(0)), "dns_a": F.coalesce("_sa.dns_count", F.lit(0)),
        "scan_b": F.coalesce("_sb.scan_count", F.lit(0)), "dns_b": F.coalesce("_sb.dns_count", F.lit(0)),
    }).drop("_sa", "_sb")


def crossflow_counters(flows: DataFrame, events: DataFrame, excluded: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """One row of counters per flow id, from the flows' keys and times only.

    Each family is written before the next is swept, so that the shuffle files
    of only one are there at a time. Counts of nothing are left out as far as
    ``with_counters`` knows them without.
    """
    host = shared_owner(flows)
    texts = flows.schema["flow_id"].dataType.simpleString() == "string"
    flows = flows.withColumn("flow_id", compact_id("flow_id")) if texts else flows
    ends = flows.select(
        *host, "flow_id", F.col("eval_us").alias("ts_us"), "pid", "protocol",
        F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col("a_ip").alias("ip"), F.col("a_port").alias("port")),
            F.struct(F.lit("b").alias("side"), F.col("b_ip").alias("ip"), F.col("b_port").alias("port")),
        )).alias("e"),
    ).select(*host, "flow_id", "ts_us", "pid", "protocol", "e.*")
    ends = exclude_ips(ends, excluded, "ip")
    scans = scan_counts(events, ends.select(*host, "flow_id", "side", "pid", "ip", "ts_us"))
    beacons = beacon_stats(events, ends.select(*host, "flow_id", "side", "ip", "port", "protocol", "ts_us"))
    spread = pid_diversity(events, flows.select(*host, "flow_id", "pid", F.col("eval_us").alias("ts_us")))
    scans = stage(scans.filter("scan_count > 0").select("flow_id", "side", "scan_count", "dns_count"))
    beacons = beacons.filter("beacon_n > 0") if excluded is None else beacons
    beacons = stage(beacons.select("flow_id", "side", "beacon_n", "beacon_mean_s", "beacon_cv"))
    spread = stage(spread.select("flow_id", "distinct_ips", "at_cap"))

    def pick(kind: str, side: str | None, *cols: str) -> Column:
        hit = F.col("kind") == kind
        if side:
            hit = hit & (F.col("side") == side)
        return F.max(F.when(hit, F.struct(*cols)))

    columns = ["flow_id", "kind", "side", "scan_count", "dns_count", "beacon_n", "beacon_mean_s", "beacon_cv",
               "distinct_ips", "at_cap"]
    long = scans.withColumn("kind", F.lit("scan")).unionByName(
        beacons.withColumn("kind", F.lit("beacon")), allowMissingColumns=True
    ).unionByName(spread.withColumn("kind", F.lit("spread")), allowMissingColumns=True).select(*columns)
    beacon = ("beacon_n", "beacon_mean_s", "beacon_cv")
    found = long.groupBy("flow_id").agg(
        pick("scan", "a", "scan_count", "dns_count").alias("_sa"),
        pick("scan", "b", "scan_count", "dns_count").alias("_sb"),
        pick("beacon", "a", *beacon).alias("beacon_a"),
        pick("beacon", "b", *beacon).alias("beacon_b"),
        pick("spread", None, "distinct_ips", "at_cap").alias("diversity"),
    )
    found = stage(found.withColumn("flow_id", full_id("flow_id")) if texts else found)
    for part in (scans, beacons, spread):
        unstage(part)
    return found


def _tier(score: float, confidence: float) -> Column:
    return F.struct(f32(score).alias("score"), f32(confidence).alias("confidence"))


def scan_score(scan: Column, dns: Column) -> Column:
    """Score and confidence are separate maxima over the two counters."""
    by_scan = F.when(scan > SCAN_HIGH, _tier(0.9, 0.95)).when(scan > SCAN_MEDIUM, _tier(0.7, 0.8)).otherwise(_tier(0, 0))
    by_dns = F.when(dns > DNS_HIGH, _tier(0.8, 0.7)).when(dns > DNS_MEDIUM, _tier(0.5, 0.5)).otherwise(_tier(0, 0))
    return F.struct(
        F.greatest(by_scan["score"], by_dns["score"]).alias("score"),
        F.greatest(by_scan["confidence"], by_dns["confidence"]).alias("confidence"),
    )


def beacon_score(beacon: Column) -> Column:
    n, mean, cv = beacon["beacon_n"], beacon["beacon_mean_s"], beacon["beacon_cv"]
    regular = (n >= BEACON_MIN_MEDIUM) & (mean >= BEACON_MEAN_MIN_S) & (mean <= BEACON_MEAN_MAX_S)
    return (
        F.when(regular & (n >= BEACON_MIN_HIGH) & (cv < BEACON_CV_HIGH), _tier(0.70, 0.75))
        .when(regular & (cv < BEACON_CV_MEDIUM), _tier(0.60, 0.60)).otherwise(_tier(0, 0))
    )


def diversity_score(spread: Column) -> Column:
    return (
        F.when(spread["at_cap"], _tier(0.65, 0.75)).when(spread["distinct_ips"] > DIVERSITY_HIGH, _tier(0.50, 0.55))
        .when(spread["distinct_ips"] > DIVERSITY_MEDIUM, _tier(0.30, 0.40)).otherwise(_tier(0, 0))
    )


def score_cross_flow(looked_up: DataFrame) -> DataFrame:
    """The cross-flow finding of rows from ``crossflow_lookup``.

    A sub-score only replaces an earlier one it strictly exceeds, together
    with its confidence; evidence of every sub-score is kept.
    """
    parts = {
        "_p1": scan_score(F.col("scan_a"), F.col("dns_a")), "_p2": scan_score(F.col("scan_b"), F.col("dns_b")),
        "_p3": beacon_score(F.col("beacon_a")), "_p4": beacon_score(F.col("beacon_b")),
        "_p5": diversity_score(F.col("diversity")),
    }
    d = looked_up.withColumns(parts)
    top = F.greatest(*[F.col(f"{p}.score") for p in parts])
    confidence = None
    for p in parts:
        hit = F.col(f"{p}.score") == F.col("_top")
        confidence = F.when(hit, F.col(f"{p}.confidence")) if confidence is None else confidence.when(hit, F.col(f"{p}.confidence"))
    d = d.withColumn("_top", top)
    entries = [*_scan_evidence("a"), *_scan_evidence("b"), _beacon_evidence("_p3", "beacon_a"),
               _beacon_evidence("_p4", "beacon_b"), _diversity_evidence()]
    hits = sum((F.when(condition, 1).otherwise(0) for condition, _ in entries[1:]),
               F.when(entries[0][0], 1).otherwise(0))
    return with_finding(
        d, "CrossFlow", F.col("_top"), F.when(F.col("_top") > 0, confidence).otherwise(f32(0)),
        ladder(F.col("_top"), [(0.85, "Critical"), (0.5, "High"), (0.3, "Medium")], "Low", inclusive=True),
        hits, F.array_compact(F.array(*[F.when(c, e) for c, e in entries])),
    ).drop("_top", *parts)


def _entry(*description: Column | str, detail: Column | None = None) -> Column:
    words = [F.lit(w) if isinstance(w, str) else w.cast("string") for w in description]
    note = F.lit(None).cast("string") if detail is None else detail
    return F.struct(F.concat(*words).alias("description"), note.alias("detail"))


def _scan_evidence(side: str) -> list[tuple[Column, Column]]:
    scan, dns, ip = F.col(f"scan_{side}"), F.col(f"dns_{side}"), F.col(f"{side}_ip")
    w = f"{WINDOW_S}s"
    return [
        (scan > SCAN_MEDIUM, _entry(
            F.when(scan > SCAN_HIGH, "High connection count to IP: ").otherwise("Elevated connection count to IP: "),
            scan, f" connections in {w}", detail=ip)),
        (dns > DNS_MEDIUM, _entry(
            F.when(dns > DNS_HIGH, "DNS query burst: ").otherwise("Elevated DNS queries: "),
            dns, f" queries to IP in {w}", detail=ip)),
    ]


def _beacon_evidence(part: str, beacon: str) -> tuple[Column, Column]:
    return F.col(f"{part}.score") > 0, _entry(
        "Beacon-like periodicity: ", F.col(f"{beacon}.beacon_n"), " connections, mean=",
        fixed(f"{beacon}.beacon_mean_s", 1), "s, CV=", fixed(f"{beacon}.beacon_cv", 3),
    )


def _diversity_evidence() -> tuple[Column, Column]:
    pid = F.concat(F.lit("pid="), F.col("pid").cast("string"))
    capped = F.concat(
        F.lit(f"Connection-diversity tracking saturated: {MAX_PID_ENTRIES}+ connections from "), pid,
        F.lit(f" in <{DIVERSITY_S}s — corroboration required for enforcement"),
    )
    wide = F.concat(F.lit("Process "), pid, F.lit(" connected to "), F.col("diversity.distinct_ips").cast("string"),
                    F.lit(f" distinct IPs in {DIVERSITY_S}s"))
    return F.col("_p5.score") > 0, F.struct(
        F.when(F.col("diversity.at_cap"), capped).otherwise(wide).alias("description"), pid.alias("detail")
    )
