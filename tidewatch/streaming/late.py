"""Enrichment that arrives after its flow, and rows that arrive too late."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.operators.enrich import ENRICHED

# Before all times.
EVER = -(2**62)
_STATE = "id string, ts_us long, flow string, fields string, version long"


class Enrichments(StatefulProcessor):
    """Flows that still wait for attributes, by id, in buckets.

    ``fields`` holds each attribute's time and value, ``ts_us`` the flow's time
    or, before it has come, that of its latest attribute. A flow goes on when it
    comes, and again when an attribute of it changes; attributes more than
    ``wait_us`` from it in event time are not its own, and so long it waits.
    """

    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        held = {r[0]: [*r] for r in self.waiting.get()}
        touched = {}
        new = pd.concat(list(rows)).sort_values("ts_us", kind="stable")
        for row_id, ts, flow, fields in new[["id", "ts_us", "flow", "fields"]].itertuples(index=False):
            own = held.setdefault(row_id, [row_id, ts, None, "{}", -1])
            known, told = json.loads(own[3]), json.loads(fields)
            before = {k: v for k, (_, v) in known.items()}
            if flow is not None:
                own[1], own[2] = ts, flow
                # What the flow brings along gives way to any attribute, of which only those near its time are its own.
                known = {k: [EVER, v] for k, v in told.items()} | {k: x for k, x in known.items() if x[0] == EVER or abs(x[0] - ts) <= self.wait_us}
            elif own[2] is None or abs(ts - own[1]) <= self.wait_us:
                known |= {k: [ts, v] for k, v in told.items() if known.get(k, [EVER])[0] <= ts}
                own[1] = own[1] if own[2] is not None else max(own[1], ts)
            own[3] = json.dumps(known)
            if own[2] is not None and (flow is not None or before != {k: v for k, (_, v) in known.items()}):
                touched[row_id] = True
        for row_id in touched:
            held[row_id][4] += 1
        self.waiting.put([tuple(r) for r in held.values()])
        if not list(self.handle.listTimers()):
            self._wake(held)
        made = [held[i] for i in touched]
        if not made:
            return
        yield pd.DataFrame({
            "id": [r[0] for r in made], "flow": [r[2] for r in made],
            "fields": [json.dumps({k: v[1] for k, v in json.loads(r[3]).items()}) for r in made], "version": [r[4] for r in made],
        })

    def _wake(self, held: dict) -> None:
        self.handle.registerTimer((min(r[1] for r in held.values()) + self.wait_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = {r[0]: [*r] for r in self.waiting.get() if r[1] + self.wait_us > now}
        if held:
            self.waiting.put([tuple(r) for r in held.values()])
            self._wake(held)
        else:
            self.waiting.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_enrich(
    flows: DataFrame, updates: DataFrame, on: str = "flow_id", wait_us: int = 30_000_000, delay: str = "10 seconds", buckets: int = 64
) -> DataFrame:
    """Flows as attributes arrive: a row with ``version`` 0 at once, and a new version for every change.

    ``updates`` (``on``, ``ts``, attributes of ``ENRICHED``) may come before or
    after their flow, by ``wait_us`` at most; a non-null attribute overwrites, the
    latest by time. The last version of a flow is what ``attach_enrichment``
    gives (readers take it as they take the latest verdict).
    """
    fields = [c for c in updates.columns if c in ENRICHED]
    own = [c for c in fields if c in flows.columns]
    rest = [c for c in flows.columns if c not in (*own, "ts")]
    nothing = F.lit(None).cast("string")

    def rows(df: DataFrame, flow, names: list[str]) -> DataFrame:
        told = F.to_json(F.struct(*names)) if names else F.lit("{}")
        return df.withWatermark("ts", delay).select(
            "ts", F.unix_micros("ts").alias("ts_us"), F.col(on).cast("string").alias("id"), flow.alias("flow"), told.alias("fields"))

    line = rows(flows, F.to_json(F.struct(*rest)), own).unionByName(rows(updates, nothing, fields))
    line = line.filter(F.col("id").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    found = line.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Enrichments(wait_us), outputStructType="id string, flow string, fields string, version long", outputMode="append", timeMode="eventTime")
    kinds = lambda df, names: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return found.select(
        F.from_json("flow", kinds(flows, rest)).alias("f"), F.from_json("fields", kinds(updates, fields)).alias("u"), "version"
    ).select("f.*", "u.*", "version")


def split_late(rows: DataFrame, path: str, checkpoint: str, delay_us: int = 10_000_000, every: str | None = None) -> StreamingQuery:
    """Write rows in time to ``path``/accepted and the others to ``path``/late, with the watermark they missed.

    The watermark of a micro-batch is the latest event time of the batches
    before it, less the delay, as Spark keeps it; a row at or before it would
    be dropped by a stateful operator. Put this in front of one: it then reads
    ``accepted`` as its stream, and nothing is lost unseen. Each batch's latest
    time is written beside its rows, so that a repeated batch decides alike.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reached = None
        if batch_id:
            seen = spark.read.schema("batch_id long, latest_us long").parquet(f"{path}/reached")
            reached = seen.filter(F.col("batch_id") < batch_id).agg(F.max("latest_us")).first()[0]
        mark = F.lit(None).cast("bigint") if reached is None else F.lit(reached - delay_us)
        judged = batch.withColumn("watermark_us", mark)
        is_late = F.coalesce(F.unix_micros("ts") <= F.col("watermark_us"), F.lit(False))
        judged.filter(~is_late).drop("watermark_us").write.mode("overwrite").parquet(f"{path}/accepted/batch_id={batch_id}")
        judged.filter(is_late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        batch.agg(F.max(F.unix_micros("ts")).alias("latest_us")).write.mode("overwrite").parquet(f"{path}/reached/batch_id={batch_id}")

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
