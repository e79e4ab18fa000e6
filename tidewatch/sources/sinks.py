"""Audit tables: versioned append, idempotent logs, replay.

Tables are Parquet folders partitioned by day. An upsert is an append of a new
version; readers take the latest version per key (``operators.audit``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.ip import ip_blob
from tidewatch.functions.text import evidence_json, parse_evidence
from tidewatch.operators.audit import latest_findings, latest_verdicts
from tidewatch.operators.decide import verdict_id, with_findings
from tidewatch.plans.lineage import stage
from tidewatch.schema import ENFORCEMENT, FINDING, REPLAY_PAYLOAD

# Fixed value: the payload version this code can apply.
PAYLOAD_VERSION = 1


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("dt", F.to_date(F.timestamp_millis("ts_ms")))


# Files a day that one append writes at most.
FILES = 8


def append(df: DataFrame, path: str) -> None:
    """Rows of a day are brought together first, so that an append leaves a few files a day and not one a task."""
    days = with_day(df).withColumn("_share", F.pmod(F.xxhash64(*df.columns), F.lit(FILES)))
    days.repartition("dt", "_share").drop("_share").write.mode("append").partitionBy("dt").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return None
        raise


def verdict_rows(decided: DataFrame, ts_ms=None) -> DataFrame:
    """Rows of the verdict table: Alert and Block only, with a repeatable id."""
    stamp = F.call_function("div", F.col("eval_us"), F.lit(1000).cast("bigint")) if ts_ms is None else ts_ms
    return decided.filter("verdict <> 'Allow'").select(
        verdict_id().alias("verdict_id"), stamp.alias("ts_ms"), "flow_id", "a_ip", "a_port", "b_ip", "b_port",
        "protocol", "pid", "process_path", "dns_name", "country_code", "asn", "reputation_score", "verdict", "reason",
        "composite_score", "ttl_ms",
        F.call_function("div", F.col("flow_age_us"), F.lit(1000).cast("bigint")).alias("flow_age_ms"),
        F.col("packet_count").alias("pkt_count"), "byte_count", "local_ip", "remote_ip",
    )


def write_verdicts(decided: DataFrame, path: str) -> None:
    """``decided`` should be a written table (``lineage.stage``) of ``pipeline.actionable`` rows: a Block that is skipped
    (exempt, or within the cooldown of another) is not stored."""
    append(verdict_rows(decided), path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame | None:
    stored = read_table(spark, path)
    return None if stored is None else latest_verdicts(stored)


def finding_rows(decided: DataFrame, ts_ms=None) -> DataFrame:
    """Rows of the findings table for the rows ``verdict_rows`` makes: each
    detector's finding with the id and time of its verdict's version, and its
    evidence as JSON text."""
    stamp = F.call_function("div", F.col("eval_us"), F.lit(1000).cast("bigint")) if ts_ms is None else ts_ms
    listed = with_findings(decided.filter("verdict <> 'Allow'")).select(
        verdict_id().alias("verdict_id"), stamp.alias("ts_ms"), F.posexplode("findings").alias("ord", "f"))
    told = [c for c in FINDING.fieldNames() if c != "evidence"]
    return listed.select("verdict_id", "ts_ms", "ord", *[F.col(f"f.{c}") for c in told], evidence_json("f.evidence").alias("evidence_json"))


def write_findings(findings: DataFrame, path: str) -> None:
    """``findings`` carry ``verdict_id`` and the ``ts_ms`` of their verdict
    version, so readers keep only those of the latest version."""
    append(findings, path)


def write_decided(decided: DataFrame, verdict_path: str, finding_path: str) -> None:
    """A batch of decided flows into both tables.

    Findings go first: a reader that sees a version of a verdict then also
    finds what belongs to it, and findings without their verdict's version are
    not read. A repeated batch appends equal rows, which readers take once.
    """
    append(finding_rows(decided), finding_path)
    append(verdict_rows(decided), verdict_path)


def current(verdicts: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest version of every verdict, and the findings of just that version, one a detector."""
    newest = latest_verdicts(verdicts)
    return newest, latest_findings(findings, newest).dropDuplicates(["verdict_id", "detector_id"])


def read_findings(spark: SparkSession, verdict_path: str, finding_path: str) -> DataFrame | None:
    """Findings of the stored verdicts' latest versions, their evidence parsed again."""
    verdicts, findings = read_table(spark, verdict_path), read_table(spark, finding_path)
    if verdicts is None or findings is None:
        return None
    kept = current(verdicts, findings)[1]
    return kept.withColumn("evidence", parse_evidence("evidence_json")).drop("evidence_json")


def compact(spark: SparkSession, verdict_path: str, finding_path: str, new_verdict_path: str, new_finding_path: str) -> None:
    """Write both tables anew without superseded versions, days and files as ``append`` makes them.

    What is read is fixed when the job begins; readers go over to the new
    folders when both are written, and what was appended since is appended to
    them again, which is harmless.
    """
    verdicts, findings = read_table(spark, verdict_path), read_table(spark, finding_path)
    if verdicts is None or findings is None:
        return
    newest, kept = current(verdicts, findings)
    append(kept.drop("dt"), new_finding_path)
    append(newest.drop("dt"), new_verdict_path)


def new_enforcement(events: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Events whose id is not stored yet, one row per id."""
    fresh = events.dropDuplicates(["event_id"])
    if stored is None:
        return fresh
    return fresh.join(stored.select("event_id"), "event_id", "left_anti")


def write_enforcement(events: DataFrame, path: str) -> None:
    """Append, ignoring event ids already stored.

    A replayed event keeps its time, so only the days of the new events are
    read back.
    """
    stored = read_table(events.sparkSession, path)
    if stored is not None:
        days = with_day(events).agg(F.min("dt").alias("lo"), F.max("dt").alias("hi")).first()
        stored = stored.filter(F.col("dt").between(days["lo"], days["hi"]))
    append(new_enforcement(events, stored), path)


def enforcement_rows(actionable: DataFrame) -> DataFrame:
    """Log rows of the Blocks that are carried out (``pipeline.actionable``), with repeatable ids.

    ``detector`` is taken from the column of that name where there is one.
    """
    stamp = F.call_function("div", F.col("eval_us"), F.lit(1000).cast("bigint"))
    detector = F.col("detector") if "detector" in actionable.columns else F.lit(None).cast("string")
    return actionable.filter("verdict = 'Block'").select(
        F.md5(F.concat_ws("|", verdict_id(), F.col("eval_us").cast("string"))).alias("event_id"), stamp.alias("ts_ms"),
        F.lit("Block").alias("action"), ip_blob("remote_ip").alias("ip_blob"), F.col("remote_ip").alias("ip_text"), "ttl_ms",
        "reason", detector.alias("detector"), F.col("composite_score").cast("double").alias("score"),
        F.lit(None).cast("string").alias("error"),
    ).select(*ENFORCEMENT.fieldNames())


def write_circuit_events(events: DataFrame, path: str) -> None:
    append(events, path)


def unblock_rows(ips: DataFrame, now_ms: int) -> DataFrame:
    """Unblock log rows for every address in ``ip``."""
    # Reason text and id prefix.
    return ips.select(
        F.concat(F.lit("dashboard-"), F.lit(now_ms).cast("string"), F.lit("-"), F.col("ip")).alias("event_id"),
        F.lit(now_ms).cast("bigint").alias("ts_ms"), F.lit("Unblock").alias("action"), ip_blob("ip").alias("ip_blob"),
        F.col("ip").alias("ip_text"), F.lit(None).cast("bigint").alias("ttl_ms"),
        F.lit("dashboard-requested").alias("reason"), F.lit(None).cast("string").alias("detector"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("error"),
    )


def record_unblock(ips: DataFrame, path: str, now_ms: int) -> None:
    write_enforcement(unblock_rows(ips, now_ms), path)


def replay_rows(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split spooled (event_id, ts_ms, payload_version, payload) entries into
    enforcement rows and entries to retain: other versions, broken payloads."""
    # FAILFAST would end the job at one broken entry; PERMISSIVE leaves all
    # fields null, told from real nulls by the text not being an object.
    body = F.from_json("payload", REPLAY_PAYLOAD)
    parsed = entries.withColumn("p", body).withColumn(
        "_ok", (F.col("payload_version") == PAYLOAD_VERSION) & F.json_object_keys("payload").isNotNull()
    )
    good = F.coalesce("_ok", F.lit(False))
    rows = parsed.filter(good).select(
        "event_id", "ts_ms", F.lit("Block").alias("action"),
        F.unhex(F.coalesce("p.ip_blob_hex", F.lit(""))).alias("ip_blob"),
        F.coalesce("p.ip_text", F.lit("unknown")).alias("ip_text"), F.col("p.ttl_ms").alias("ttl_ms"),
        F.coalesce("p.reason", F.lit("")).alias("reason"), F.col("p.detector").alias("detector"),
        F.col("p.score").alias("score"), F.col("p.send_error").alias("error"),
    ).select(*ENFORCEMENT.fieldNames())
    return rows, parsed.filter(~good).drop("p", "_ok")


def replay_events(entries: DataFrame, log_path: str, dead_letter_path: str) -> None:
    rows, retained = replay_rows(entries)
    write_enforcement(rows, log_path)
    append(retained, dead_letter_path)


def replay_stream(
    entries: DataFrame, log_path: str, dead_letter_path: str, checkpoint: str, delay: str = "10 minutes", every: str | None = None
) -> StreamingQuery:
    """Replay a stream of spooled entries (with ``ts``); an id leaves one row however often it comes.

    Repeats within ``delay`` are dropped by their state, before they reach the
    log; only for what is left are stored ids looked up, and of the log only
    the id column of the entries' own days.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = stage(batch.drop("ts"))
        replay_events(held, log_path, dead_letter_path)

    fresh = entries.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    writer = fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def payload_json() -> Column:
    """The spooled form of an enforcement row."""
    return F.to_json(F.struct(
        F.lower(F.hex("ip_blob")).alias("ip_blob_hex"), "ip_text", "ttl_ms", "reason", "detector", "score",
        F.col("error").alias("send_error"),
    ))
