"""Findings to Allow / Alert / Block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ip as ips
from tidewatch.functions.f32 import add, f32
from tidewatch.functions.text import fixed
from tidewatch.operators.detectors import finding_struct
from tidewatch.plans.versions import in_force, shared_owner
from tidewatch.schema import DETECTORS, SEVERITIES, VERDICT_KEY


@dataclass(frozen=True)
class Policy:
    """Decision defaults."""

    block_threshold: float = 0.7
    alert_threshold: float = 0.3
    override_threshold: float = 0.85
    min_detectors: int = 2
    timed_out_weight: float = 0.1
    errored_weight: float = 0.0
    ttl_s: tuple[int, int, int, int] = (60, 300, 900, 3600)
    min_ttl_s: int = 30
    max_ttl_s: int = 86_400


def _weight(status: Column, policy: Policy) -> Column:
    return (
        F.when(status == "Completed", f32(1)).when(status == "TimedOut", f32(policy.timed_out_weight))
        .otherwise(f32(policy.errored_weight))
    )


def _ttl_s(rank: Column, policy: Policy) -> Column:
    """Lifetime of the worst severity; Medium when nothing completed."""
    chosen = F.get(F.array(*[F.lit(t) for t in policy.ttl_s]), F.coalesce(rank, F.lit(1)))
    return F.least(F.greatest(chosen, F.lit(policy.min_ttl_s)), F.lit(policy.max_ttl_s))


def _rank(severity: Column) -> Column:
    expr = None
    for i, name in enumerate(SEVERITIES):
        expr = F.when(severity == name, i) if expr is None else expr.when(severity == name, i)
    return expr


def _verdict_columns(total: Column, scoring: Column, override: Column, policy: Policy) -> Column:
    block = (total >= f32(policy.block_threshold)) & (override | (scoring >= policy.min_detectors))
    return F.when(block, "Block").when(total >= f32(policy.alert_threshold), "Alert").otherwise("Allow")


def decide(scored: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Verdict of flows that carry the built-in detectors' columns.

    Adds ``composite_score``, ``detectors_scoring``, ``override``, ``verdict``,
    ``ttl_ms``, ``top_detector`` and ``reason``. A projection: the six scores
    are added in their fixed order, no shuffle.
    """
    adjusted = {
        d: F.col(f"{p}_score") * F.col(f"{p}_confidence") * _weight(F.col(f"{p}_status"), policy)
        for d, p in DETECTORS.items()
    }
    d = scored.withColumns({f"_adj_{DETECTORS[k]}": e for k, e in adjusted.items()})
    adj = {k: F.col(f"_adj_{p}") for k, p in DETECTORS.items()}
    done = {k: F.col(f"{p}_status") == "Completed" for k, p in DETECTORS.items()}
    override = F.lit(False)
    worst = []
    for k, p in DETECTORS.items():
        override = override | (done[k] & (F.col(f"{p}_score") * F.col(f"{p}_confidence") >= f32(policy.override_threshold)))
        worst.append(F.when(done[k] & (F.col(f"{p}_score") > 0), _rank(F.col(f"{p}_severity"))))
    d = d.withColumns({
        "composite_score": F.least(add(*adj.values()), f32(1)),
        "detectors_scoring": add(*[F.when(a > 0, 1).otherwise(0) for a in adj.values()]),
        "override": override,
        "_worst": F.greatest(*worst),
        "_top": F.greatest(*[F.when(done[k], F.col(f"{p}_score") * F.col(f"{p}_confidence")) for k, p in DETECTORS.items()]),
    })
    # Ties go to the later detector.
    top = None
    for k, p in reversed(DETECTORS.items()):
        hit = done[k] & (F.col(f"{p}_score") * F.col(f"{p}_confidence") == F.col("_top"))
        top = F.when(hit, k) if top is None else top.when(hit, k)
    d = d.withColumn("verdict", _verdict_columns(
        F.col("composite_score"), F.col("detectors_scoring"), F.col("override"), policy))
    lines = F.flatten(F.array(*[
        F.when(done[k] & (F.col(f"{p}_score") > 0), F.transform(
            F.col(f"{p}_evidence"), lambda e, k=k: F.concat(F.lit(f"{k}: "), e["description"])
        )).otherwise(F.array().cast("array<string>"))
        for k, p in DETECTORS.items()
    ]))
    return d.withColumns({
        "ttl_ms": F.when(F.col("verdict") == "Block", _ttl_s(F.col("_worst"), policy).cast("bigint") * 1000),
        "top_detector": top,
        "reason": _reason(lines, policy),
    }).drop("_worst", "_top", *[f"_adj_{p}" for p in DETECTORS.values()])


def _reason(lines: Column, policy: Policy) -> Column:
    verdict = F.col("verdict")
    threshold = F.when(verdict == "Block", "block").otherwise("alert")
    head = F.concat(F.lit("score "), fixed("composite_score", 2), F.lit(" exceeds "), threshold, F.lit(" threshold"))
    body = F.when(F.size(lines) > 0, F.concat(F.lit(": "), F.array_join(lines, "; "))).otherwise("")
    alone = (verdict == "Block") & F.col("override") & (F.col("detectors_scoring") < policy.min_detectors)
    return F.when(verdict != "Allow", F.concat(head, body, F.when(alone, " (override)").otherwise("")))


def with_findings(scored: DataFrame) -> DataFrame:
    """Gather the detector columns into one ``findings`` array per flow."""
    return scored.withColumn("findings", F.array(*[finding_struct(d) for d in DETECTORS]))


def finding_rows(scored: DataFrame, id_column: str = "flow_id") -> DataFrame:
    """Long table: one row per flow and detector."""
    return with_findings(scored).select(id_column, F.posexplode("findings").alias("ord", "f")).select(id_column, "ord", "f.*")


def decide_findings(findings: DataFrame, id_column: str = "flow_id", policy: Policy = Policy()) -> DataFrame:
    """Verdict per id from a long findings table of any set of detectors.

    ``ord`` gives the summing order. A flow has one finding per detector, so
    the gathered array is as short as the detector list.
    """
    item = F.struct("ord", "detector_id", "score", "confidence", "severity", "status")
    d = findings.groupBy(id_column).agg(F.array_sort(F.collect_list(item)).alias("_f"))
    adj = lambda f: f["score"].cast("float") * f["confidence"].cast("float") * _weight(f["status"], policy)
    plain = lambda f: f["score"].cast("float") * f["confidence"].cast("float")
    completed = F.filter("_f", lambda f: f["status"] == "Completed")
    d = d.withColumns({
        "composite_score": F.least(F.aggregate("_f", f32(0), lambda acc, f: acc + adj(f)), f32(1)),
        "detectors_scoring": F.size(F.filter("_f", lambda f: adj(f) > 0)),
        "override": F.exists(completed, lambda f: plain(f) >= f32(policy.override_threshold)),
        "_worst": F.array_max(F.transform(F.filter(completed, lambda f: f["score"] > 0), lambda f: _rank(f["severity"]))),
        "top_detector": F.array_max(F.transform(
            completed, lambda f: F.struct(plain(f).alias("p"), f["ord"].alias("o"), f["detector_id"].alias("d"))))["d"],
    })
    d = d.withColumn("verdict", _verdict_columns(F.col("composite_score"), F.col("detectors_scoring"), F.col("override"), policy))
    return d.withColumn(
        "ttl_ms", F.when(F.col("verdict") == "Block", _ttl_s(F.col("_worst"), policy).cast("bigint") * 1000)
    ).drop("_f", "_worst")


def top_detector(findings: DataFrame, id_column: str = "verdict_id") -> DataFrame:
    """Completed finding with the largest score x confidence, ties to the last."""
    weight = (F.col("score").cast("float") * F.col("confidence").cast("float"))
    return findings.filter("status = 'Completed'").groupBy(id_column).agg(
        F.max_by("detector_id", F.struct(weight, F.col("ord"))).alias("top_detector")
    )


def verdict_id() -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in VERDICT_KEY]))


def block_guard(
    verdicts: DataFrame, own_ips: DataFrame | None = None, gateways: DataFrame | None = None, remote: str = "remote_ip",
    ts: str = "eval_us",
) -> DataFrame:
    """Add ``skip_reason``: why a remote is exempt from blocking, else null.

    ``own_ips`` and ``gateways`` are sets of addresses (ip), or have versions
    (ip, valid_from, valid_to), of which those at the verdict's time count.
    With a host in both tables, only the verdict's host counts.
    """
    d = verdicts
    for flag, exempt in (("_own", own_ips), ("_gw", gateways)):
        if exempt is None:
            d = d.withColumn(flag, F.lit(False))
            continue
        on = {**{h: h for h in shared_owner(d, exempt)}, remote: "ip"}
        if "valid_from" in exempt.columns:
            if "host" in exempt.columns and "host" not in d.columns:
                raise ValueError("versions of several hosts need verdicts with a host")
            found = in_force(d, exempt, on, ts, {flag: "valid_from"})
            d = found.withColumn(flag, F.col(flag).isNotNull())
        else:
            listed = exempt.select(*[F.col(theirs).alias(mine) for mine, theirs in on.items()]).distinct().withColumn(flag, F.lit(True))
            d = d.join(listed, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return d.withColumn("skip_reason", ips.guard_reason(remote, F.col("_own"), F.col("_gw"))).drop("_own", "_gw")
