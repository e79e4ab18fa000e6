"""Packets to verdicts, end to end."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import SECOND_US
from tidewatch.operators import crossflow, detectors
from tidewatch.operators.audit import cooldown
from tidewatch.operators.decide import Policy, block_guard, decide
from tidewatch.operators.enrich import enrich
from tidewatch.operators.flows import flows, resolved_only
from tidewatch.plans.lineage import stage, unstage


def score_flows(flow_rows: DataFrame, excluded: DataFrame | list[DataFrame] | None = None, age_mode: str = "evaluation") -> DataFrame:
    """All six detectors over enriched flows of known direction.

    The five per-flow detectors are a projection of the flow table; the
    cross-flow counters are computed from a few of its columns and joined on
    the flow id.
    """
    known = resolved_only(flow_rows)
    counters = crossflow.crossflow_counters(known, crossflow.connections(known, excluded), excluded)
    scored = known
    behavior = partial(detectors.score_flow_behavior, age_mode=age_mode)
    for score in (detectors.score_dns, detectors.score_process, behavior, detectors.score_ip_reputation, detectors.score_dns_tunnel):
        scored = score(scored)
    return crossflow.score_cross_flow(crossflow.with_counters(scored, counters, excluded))


def packet_verdicts(
    packets: DataFrame,
    excluded: DataFrame | list[DataFrame] | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    policy: Policy = Policy(),
    **dimensions: DataFrame,
) -> DataFrame:
    """One decided row per flow.

    Bare and enriched flows are written once each, as the address lookup and
    the cross-flow sweeps read narrow slices of them several times; the bare
    ones go when they are enriched.

    ``prepare`` runs on the bare flows (for example to attach a pid known at
    capture); ``dimensions`` are the arguments of ``enrich``.
    """
    bare = stage(prepare(flows(packets)))
    enriched = stage(enrich(bare, **dimensions))
    unstage(bare)
    return decide(score_flows(enriched, excluded), policy)


def actionable(
    decided: DataFrame, own_ips: DataFrame | None = None, gateways: DataFrame | None = None
) -> DataFrame:
    """Alerts, and the Blocks that are carried out: the remote is not exempt
    and no earlier Block of it is still in force.

    Give it a written table (``lineage.stage``): filters on the verdict would
    otherwise repeat the whole scoring expression.
    """
    alerts = decided.filter("verdict = 'Alert'")
    guarded = block_guard(decided.filter("verdict = 'Block'"), own_ips, gateways)
    allowed = guarded.filter(F.col("skip_reason").isNull()).drop("skip_reason").withColumn("_ttl_us", F.col("ttl_ms") * 1000)
    done = cooldown(allowed, "remote_ip", "eval_us", "_ttl_us", "flow_id", 600 * SECOND_US)
    return alerts.unionByName(done.select(*alerts.columns))
