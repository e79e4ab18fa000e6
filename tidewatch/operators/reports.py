"""The report queries. ``now_ms`` and ``tz`` are arguments, never the host's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.functions.times import DAY_MS, HOUR_MS, local_date, local_time
from tidewatch.operators.audit import filter_by_app, filter_by_detector


def recent(rows: DataFrame, limit: int, tie: str) -> DataFrame:
    """Newest rows first."""
    return rows.orderBy(F.desc("ts_ms"), F.desc(tie)).limit(limit)


def recent_verdicts(verdicts: DataFrame, limit: int = 100) -> DataFrame:
    return recent(verdicts, limit, "verdict_id")


def recent_enforcement(log: DataFrame, limit: int = 100) -> DataFrame:
    return recent(log, limit, "event_id")


def kpi_since(verdicts: DataFrame, log: DataFrame, since_ms: int) -> DataFrame:
    """One row: blocks, alerts, addresses acted on, failed actions."""
    return _both(verdicts, log, since_ms).agg(
        F.count_if(F.col("verdict") == "Block").alias("blocks"),
        F.count_if(F.col("verdict") == "Alert").alias("alerts"),
        F.count_distinct(F.when(F.col("error").isNull(), F.col("ip_text"))).alias("unique_ips"),
        F.count_if(F.col("error").isNotNull()).alias("failures"),
    )


def _both(verdicts: DataFrame, log: DataFrame, since_ms: int) -> DataFrame:
    """Young rows of both tables in one stream, for one aggregation."""
    recent_rows = F.col("ts_ms") >= since_ms
    return verdicts.filter(recent_rows).select("ts_ms", "verdict").unionByName(
        log.filter(recent_rows).select("ts_ms", "ip_text", "error"), allowMissingColumns=True
    )


def protection_status(verdicts: DataFrame | None, now_ms: int, spark: SparkSession | None = None) -> DataFrame:
    """Blocks of the last week; protected whenever the table exists."""
    if verdicts is None:
        return spark.range(1).select(F.lit(False).alias("is_protected"), F.lit(0).cast("bigint").alias("blocks_week"))
    week = (F.col("verdict") == "Block") & (F.col("ts_ms") >= now_ms - 7 * DAY_MS)
    return verdicts.filter(week).agg(F.count("*").alias("blocks_week")).select(F.lit(True).alias("is_protected"), "blocks_week")


def _midnight_ms(now_ms: int, tz: str, days_back: int = 0) -> Column:
    """Epoch milliseconds of the local midnight that began the day."""
    day = F.date_sub(local_date(F.lit(now_ms), tz), days_back)
    return F.unix_millis(F.to_utc_timestamp(day.cast("timestamp"), tz))


def threat_stats(verdicts: DataFrame, log: DataFrame, now_ms: int, tz: str) -> DataFrame:
    week = now_ms - 7 * DAY_MS
    block, acted = F.col("verdict") == "Block", F.col("verdict").isNull() & F.col("error").isNull()
    # A local day is shorter than the week, so the week's rows hold today's.
    return _both(verdicts, log, week).agg(
        F.count_if(block & (F.col("ts_ms") >= _midnight_ms(now_ms, tz))).alias("blocks_today"),
        F.count_if(block).alias("blocks_week"),
        F.count_distinct(F.when(acted, F.col("ip_text"))).alias("blocked_addresses"),
    )


def detector_health(events: DataFrame) -> DataFrame:
    return events.groupBy("detector_id").agg(
        F.max_by("to_state", F.struct("ts_ms", "id")).alias("last_state"),
        F.count("*").alias("transitions"), F.max("ts_ms").alias("last_ts_ms"),
    )


def _hour_start(ts: Column) -> Column:
    return ts - F.pmod(ts, F.lit(HOUR_MS))


def _filled_hours(spark: SparkSession, counts: DataFrame, hours: Column, tz: str) -> DataFrame:
    spine = spark.range(1).select(F.explode(hours).alias("hour_ms"))
    return spine.join(counts, "hour_ms", "left").select(
        "hour_ms", F.hour(local_time("hour_ms", tz)).alias("hour"), F.coalesce("n", F.lit(0)).alias("count")
    )


def activity_chart(verdicts: DataFrame, now_ms: int, tz: str) -> DataFrame:
    """Verdicts per hour for the 24 hours that end with the current one."""
    last = now_ms - now_ms % HOUR_MS
    first = last - 23 * HOUR_MS
    counts = (
        verdicts.filter((F.col("ts_ms") >= first) & (F.col("ts_ms") < last + HOUR_MS))
        .groupBy(_hour_start(F.col("ts_ms")).alias("hour_ms")).agg(F.count("*").alias("n"))
    )
    hours = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"), F.lit(HOUR_MS).cast("bigint"))
    return _filled_hours(verdicts.sparkSession, counts, hours, tz)


def activity_chart_for_day(verdicts: DataFrame, now_ms: int, tz: str, day_offset: int, trim: bool = False) -> DataFrame:
    """Verdicts per hour of one local day; ``trim`` drops hours after now."""
    start, end = _midnight_ms(now_ms, tz, day_offset), _midnight_ms(now_ms, tz, day_offset - 1)
    low = now_ms - (day_offset + 2) * DAY_MS
    counts = (
        verdicts.filter((F.col("ts_ms") >= low) & (F.col("ts_ms") >= start) & (F.col("ts_ms") < end))
        .groupBy((start + (F.col("ts_ms") - start) - F.pmod(F.col("ts_ms") - start, F.lit(HOUR_MS))).alias("hour_ms"))
        .agg(F.count("*").alias("n"))
    )
    # A day with a clock change has 23 or 25 hours, so hours are keyed by start.
    hours = F.sequence(start, end - 1, F.lit(HOUR_MS).cast("bigint"))
    filled = _filled_hours(verdicts.sparkSession, counts, hours, tz)
    return filled.filter(F.col("hour_ms") <= now_ms) if trim else filled


def weekly_blocks(verdicts: DataFrame, now_ms: int, tz: str) -> DataFrame:
    """Blocks per local day, 6 = six days ago to 0 = today, oldest first."""
    today = local_date(F.lit(now_ms), tz)
    offset = F.datediff(today, local_date("ts_ms", tz))
    counts = (
        verdicts.filter((F.col("verdict") == "Block") & (F.col("ts_ms") >= now_ms - 8 * DAY_MS))
        .groupBy(offset.alias("day_offset")).agg(F.count("*").alias("n"))
    )
    spine = verdicts.sparkSession.range(7).select(F.col("id").cast("int").alias("day_offset"))
    return spine.join(counts, "day_offset", "left").select(
        "day_offset", F.coalesce("n", F.lit(0)).alias("count")
    ).orderBy(F.desc("day_offset"))


def detector_breakdown(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("detector_id").isNotNull()).groupBy("detector_id").agg(
        F.count_if(F.col("score") > 0).alias("findings"), F.count("*").alias("runs")
    ).orderBy(F.desc("findings"), "detector_id")


def top_apps(verdicts: DataFrame, now_ms: int, k: int = 5) -> DataFrame:
    """Apps of the last week by blocks * 2 + alerts."""
    used = verdicts.filter(
        F.col("process_path").isNotNull() & (F.col("process_path") != "") & (F.col("ts_ms") >= now_ms - 7 * DAY_MS)
    )
    per_path = used.groupBy("process_path").agg(
        F.count_if(F.col("verdict") == "Block").alias("blocks"), F.count_if(F.col("verdict") == "Alert").alias("alerts")
    )
    top = per_path.orderBy(F.desc(F.col("blocks") * 2 + F.col("alerts")), "process_path").limit(k)
    return top.withColumn("app_name", text.app_name("process_path", "Unknown"))


def threat_countries(verdicts: DataFrame) -> DataFrame:
    """Alerts and blocks per country. The verdict is counted, not filtered, so
    a plan that still has to score the rows computes it once."""
    threats = F.count_if(F.col("verdict").isin("Block", "Alert"))
    counted = verdicts.filter(F.col("country_code").isNotNull()).groupBy("country_code").agg(threats.alias("count"))
    return counted.filter(F.col("count") > 0).orderBy(F.desc("count"), "country_code")


def country_points(counts: DataFrame, centroids: DataFrame) -> DataFrame:
    """Country counts with name and position; unknown codes are dropped."""
    known = centroids.select(F.upper("code").alias("_code"), "name", "lat", "lng")
    return counts.join(known, F.upper("country_code") == F.col("_code")).drop("_code")


def top_countries(points: DataFrame, k: int = 8) -> DataFrame:
    return points.orderBy(F.desc("count"), "country_code").limit(k)


def pick_remote(a: str = "a_ip", b: str = "b_ip", local: str = "local_ip", stored: str = "remote_ip") -> Column:
    """Stored remote, else the end that is not local, else the second end."""
    return F.coalesce(
        F.col(stored), F.when(F.col(a) == F.col(local), F.col(b)).when(F.col(b) == F.col(local), F.col(a)), F.col(b)
    )


def activity_feed(
    verdicts: DataFrame, findings: DataFrame, limit: int | None, detector: str | None = None, app: str | None = None
) -> DataFrame:
    """Newest verdicts with their detectors, best first, and top evidence.

    The verdicts are limited first; the findings are then semi-joined to that
    short list, so they are read once and only the wanted rows are grouped. A
    verdict has one finding per detector. Without ``limit`` every verdict is
    described, in no particular order.
    """
    chosen = verdicts
    if detector is not None:
        chosen = filter_by_detector(verdicts, findings, detector)
    elif app is not None:
        chosen = filter_by_app(verdicts, app)
    shown = chosen if limit is None else recent(chosen, limit, "verdict_id")
    item = F.struct((-F.col("score")).alias("neg"), "detector_id", "evidence")
    listed = findings.join(shown.select("verdict_id"), "verdict_id", "left_semi").groupBy("verdict_id").agg(
        F.array_sort(F.collect_list(item), _by_score).alias("_f")
    )
    with_text = F.filter("_f", lambda f: f["evidence"].isNotNull())
    return shown.join(listed, "verdict_id", "left").select(
        "verdict_id", "ts_ms", text.app_name("process_path").alias("app_name"), "process_path", "verdict",
        F.coalesce(F.transform("_f", lambda f: f["detector_id"]), F.array().cast("array<string>")).alias("detector_ids"),
        "a_ip", "b_ip", pick_remote().alias("remote"), "country_code", "dns_name",
        F.get(with_text, F.lit(0))["evidence"].alias("top_evidence"), "composite_score",
    )


def _by_score(x: Column, y: Column) -> Column:
    """Score descending, then detector name."""
    return (
        F.when(x["neg"] < y["neg"], -1).when(x["neg"] > y["neg"], 1)
        .when(x["detector_id"] < y["detector_id"], -1).when(x["detector_id"] > y["detector_id"], 1).otherwise(0)
    )


def share_of_max(counts: DataFrame, count: str | Column = "count", top: int | None = None) -> DataFrame:
    """Bar length: count over the largest count, which is at least 1 and comes from a one-row aggregate."""
    value = F.col(count) if isinstance(count, str) else count
    shown = counts if top is None else counts.orderBy(F.desc(value), counts.columns[0]).limit(top)
    peak = shown.agg(F.greatest(F.max(value), F.lit(1)).alias("peak")).scalar()
    return shown.withColumn("share", value / peak)


def new_since(feed: DataFrame, seen: DataFrame) -> DataFrame:
    """Feed rows that an earlier result did not hold."""
    return feed.join(seen.select("verdict_id"), "verdict_id", "left_anti")


def peak_bucket(chart: DataFrame, order: str = "hour_ms") -> DataFrame:
    """First bucket with the largest count."""
    return chart.agg(F.min_by(F.struct(*chart.columns), F.struct(-F.col("count"), F.col(order))).alias("p")).select("p.*")


# Sentences of the plain-language explanations.
PHRASES = {
    "IpReputation": "reach a known-bad address",
    "CrossFlow": "make an unusually high number of connections",
    "DnsAnalyzer": "reach a suspicious domain",
    "DnsTunnelDetector": "hide data in DNS requests",
    "FlowBehavior": "send an unusual pattern of traffic",
    "ProcessCorrelator": "behave like suspicious software",
}
BEACON_PHRASE = "make repeated automated connections at regular intervals"
DIVERSITY_PHRASE = "connect to an unusually wide variety of servers"
DNS_PHRASE = "make an unusually high number of DNS lookups"
FALLBACK_PHRASE = "do something suspicious"
COUNTRY_NAMES = {
    "US": "the United States", "GB": "the United Kingdom", "DE": "Germany", "FR": "France", "NL": "the Netherlands",
    "SE": "Sweden", "NO": "Norway", "CN": "China", "RU": "Russia", "JP": "Japan", "KR": "South Korea",
    "AU": "Australia", "CA": "Canada", "BR": "Brazil", "IN": "India", "SG": "Singapore", "HK": "Hong Kong",
    "UA": "Ukraine",
}


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def phrase(detector: Column, evidence: Column) -> Column:
    """What the top detector saw; cross-flow is refined by its evidence text."""
    words = F.lower(F.get(evidence, F.lit(0))["description"])
    has = lambda *parts: F.greatest(*[F.coalesce(words.contains(p), F.lit(False)) for p in parts])
    refined = (
        F.when(has("beacon", "cv="), BEACON_PHRASE).when(has("distinct ip", "diversity"), DIVERSITY_PHRASE)
        .when(has("dns query", "dns burst"), DNS_PHRASE)
    )
    return F.coalesce(F.when(detector == "CrossFlow", refined), _lookup(PHRASES, detector), F.lit(FALLBACK_PHRASE))


def explain_verdict(feed: DataFrame) -> DataFrame:
    """Add ``sentence``: one plain sentence per feed row."""
    app, target = F.col("app_name"), F.coalesce("dns_name", "remote")
    place = F.coalesce(F.concat(
        F.lit(" in "), F.coalesce(_lookup(COUNTRY_NAMES, F.upper("country_code")), F.col("country_code"))), F.lit(""))
    allowed = F.concat(app, F.lit(" connected to "), target, place, F.lit(". Looks normal — allowed."))
    action = F.when(F.col("verdict") == "Block", "— blocked.").otherwise("— flagged for review.")
    told = F.concat(app, F.lit(" tried to "), phrase(F.get("detector_ids", F.lit(0)), F.col("top_evidence")),
                    F.lit(" ("), target, F.lit(") "), action)
    return feed.withColumn("sentence", F.when(F.col("verdict") == "Allow", allowed).otherwise(told))


def explain_why(feed: DataFrame, product: str = "This system") -> DataFrame:
    """Add ``why``: all detector phrases in one sentence."""
    found = F.array_compact(F.transform("detector_ids", lambda d: _lookup(PHRASES, d)))
    d = feed.withColumn("_p", found)
    n = F.size("_p")
    joined = F.when(n == 1, F.get("_p", F.lit(0))).otherwise(F.concat(
        F.array_join(F.slice("_p", F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "),
        F.get("_p", F.greatest(n - 1, F.lit(0)))))
    action = F.when(F.col("verdict") == "Block", f"{product} blocked it to protect you.").otherwise(
        f"{product} flagged it so you can review it.")
    why = (
        F.when(F.col("verdict") == "Allow",
               f"This connection looks normal. {product} is watching it but has no reason to block it.")
        .when(n == 0, f"{product} detected unusual behaviour and took action to protect you.")
        .otherwise(F.concat(F.col("app_name"), F.lit(" tried to "), joined, F.lit(". "), action))
    )
    return d.withColumn("why", why).drop("_p")
