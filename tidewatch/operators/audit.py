"""Queries over the verdict, findings and enforcement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ip as ips
from tidewatch.functions.times import DAY_MS, HOUR_MS
from tidewatch.plans.chains import accepted_rows
from tidewatch.plans.sliced import running
from tidewatch.schema import SEVERITIES, VERDICT_KEY

# Retention periods, least remaining life of a wanted block, and
# the most blocks kept at once.
ENFORCEMENT_DAYS, VERDICT_DAYS = 90, 7
MIN_REMAINING_MS = 30_000


def latest_verdicts(verdicts: DataFrame, id_column: str = "verdict_id") -> DataFrame:
    """Newest row per 5-tuple and verdict; equal times resolve to the larger id.

    An aggregation rather than a ranking window, so versions combine before
    the shuffle.
    """
    rest = [c for c in verdicts.columns if c not in VERDICT_KEY]
    newest = F.max_by(F.struct(*rest), F.struct("ts_ms", id_column))
    return verdicts.groupBy(*VERDICT_KEY).agg(newest.alias("_r")).select(
        *[c if c in VERDICT_KEY else F.col(f"_r.{c}").alias(c) for c in verdicts.columns]
    )


def latest_findings(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings that belong to the stored version of their verdict."""
    return findings.join(verdicts.select("verdict_id", "ts_ms"), ["verdict_id", "ts_ms"], "left_semi")


def verdict_findings(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    return verdicts.join(findings, "verdict_id")


def orphan_findings(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    return findings.join(verdicts, "verdict_id", "left_anti")


def filter_by_detector(verdicts: DataFrame, findings: DataFrame, detector: str) -> DataFrame:
    wanted = findings.filter(F.col("detector_id") == detector).select("verdict_id")
    return verdicts.join(wanted, "verdict_id", "left_semi")


def filter_by_app(verdicts: DataFrame, app: str) -> DataFrame:
    """Path ends in ``/app``, ASCII case ignored, no wildcards."""
    return verdicts.filter(F.lower("process_path").endswith("/" + app.lower()))


def latest_actions(log: DataFrame) -> DataFrame:
    """Rows of each address's latest Block/Unblock time; equal times all stay.

    The latest time is an aggregate joined back on (address, time), which
    spreads one address over many tasks.
    """
    acted = log.filter(F.col("action").isin("Block", "Unblock"))
    latest = acted.groupBy("ip_text").agg(F.max("ts_ms").alias("ts_ms"))
    return acted.join(latest, ["ip_text", "ts_ms"], "left_semi")


def active_blocks(log: DataFrame, now_ms: int) -> DataFrame:
    """Addresses whose latest action is a Block that has not run out."""
    remaining = F.col("ts_ms") + F.col("ttl_ms") - F.lit(now_ms)
    return latest_actions(log).filter((F.col("action") == "Block") & (remaining > 0)).select(
        "ip_text", remaining.alias("remaining_ms"), F.coalesce("reason", F.lit("")).alias("reason")
    )


def desired_blocks(log: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Active blocks worth restoring, with their time to live in seconds.

    ``limit`` keeps the blocks that last longest (a guard for the enforcer).
    """
    active = active_blocks(log, now_ms).filter((F.col("remaining_ms") >= MIN_REMAINING_MS) & ips.valid_ip("ip_text"))
    ttl = F.least(F.call_function("div", F.col("remaining_ms"), F.lit(1000).cast("bigint")), F.lit(86_400).cast("bigint"))
    wanted = active.withColumn("ttl_s", ttl).filter(ips.validation_error("ip_text", F.col("ttl_s") * 1000).isNull())
    wanted = wanted.select(F.col("ip_text").alias("ip"), "ttl_s")
    if limit is not None:
        wanted = wanted.orderBy(F.desc("ttl_s"), "ip").limit(limit)
    return wanted


def reconcile_diff(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(ip, action): remove what is live but not desired, add the reverse."""
    want = desired.select("ip").distinct().withColumn("_want", F.lit(True))
    have = live.select("ip").distinct().withColumn("_have", F.lit(True))
    action = F.when(F.col("_want").isNull(), "remove").when(F.col("_have").isNull(), "add")
    return want.join(have, "ip", "full").select("ip", action.alias("action")).filter(F.col("action").isNotNull())


def reconcile_report(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count_if(F.col("action") == "remove").alias("orphans_removed"),
        F.count_if(F.col("action") == "add").alias("re_applied"),
    )


def retain(rows: DataFrame, now_ms: int, days: int) -> DataFrame:
    """Rows young enough to keep; a ``dt`` partition column is pruned too."""
    cutoff = now_ms - days * DAY_MS
    kept = rows.filter(F.col("ts_ms") >= cutoff)
    if "dt" in rows.columns:
        kept = kept.filter(F.col("dt") >= F.to_date(F.timestamp_millis(F.lit(cutoff))))
    return kept


def retention(
    log: DataFrame, verdicts: DataFrame, findings: DataFrame, circuit: DataFrame, now_ms: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables after retention; findings go with their verdict."""
    kept = retain(verdicts, now_ms, VERDICT_DAYS)
    return (
        retain(log, now_ms, ENFORCEMENT_DAYS), kept,
        findings.join(kept.select("verdict_id"), "verdict_id", "left_semi"), retain(circuit, now_ms, VERDICT_DAYS),
    )


def _unit(col: str) -> Column:
    return F.col(col).between(0, 1)


# Column checks per table: violation name, condition that must not be false.
CHECKS = {
    "enforcement_log": lambda: {
        "action": F.col("action").isin("Block", "Unblock"), "score": F.col("score").isNull() | _unit("score"),
    },
    "verdicts": lambda: {
        "verdict": F.col("verdict").isin("Alert", "Block"), "composite_score": _unit("composite_score"),
    },
    "detector_findings": lambda: {"score": _unit("score"), "confidence": _unit("confidence")},
}


def check_constraints(rows: DataFrame, table: str) -> DataFrame:
    """Add ``violations``: names of the checks a row fails."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in CHECKS[table]().items()]
    return rows.withColumn("violations", F.array_compact(F.array(*failed)))


def split_valid(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    checked = check_constraints(rows, table)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def cooldown(
    blocks: DataFrame, remote: str = "remote_ip", ts: str = "ts_ms", ttl: str = "ttl_ms", row_id: str = "verdict_id",
    width: int = HOUR_MS,
) -> DataFrame:
    """Block decisions that are carried out: none for a remote while its last
    one is in force. Adds ``until``. ``width`` is a slice of a remote's time in
    the unit of ``ts``; slices are worked on in parallel."""
    return accepted_rows(blocks, [remote], ts, ttl, row_id, width)


def block_intervals(log: DataFrame) -> DataFrame:
    """(ip_text, start_ms, end_ms) during which an address was blocked.

    A Block during a block changes nothing; an Unblock ends it. Unblocks clear
    all state, so each stretch between two of them is a cooldown chain of its
    own. At equal times Blocks count before Unblocks, then event id.
    """
    rows = log.filter(F.col("action").isin("Block", "Unblock")).withColumns({
        "_u": F.when(F.col("action") == "Unblock", 1).otherwise(0).cast("bigint"),
    })
    parts = running(rows, ["ip_text"], "ts_ms", ["_u", "event_id"], sums={"_part": F.col("_u")}, slice_us=DAY_MS)
    ends = parts.filter("_u = 1").select("ip_text", (F.col("_part") - 1).alias("_part"), F.col("ts_ms").alias("_cut"))
    blocks = parts.filter(F.col("action") == "Block").filter(F.col("ttl_ms") > 0)
    started = accepted_rows(blocks, ["ip_text", "_part"], "ts_ms", "ttl_ms", "event_id")
    return started.join(ends, ["ip_text", "_part"], "left").select(
        "ip_text", F.col("ts_ms").alias("start_ms"),
        F.least(F.col("until"), F.coalesce("_cut", F.col("until"))).alias("end_ms"),
    )
