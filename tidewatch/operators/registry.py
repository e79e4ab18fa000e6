"""User detectors next to the built-in ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.decide import finding_rows
from tidewatch.schema import FINDING

RowDetector = Callable[[dict], dict]


class Detectors:
    """Registered detectors in summing order.

    A native detector maps flows to flows plus a ``finding`` struct and stays
    inside the JVM. A row detector is a Python function of one flow, run in
    Arrow batches.
    """

    def __init__(self) -> None:
        self._entries: list[tuple[str, str, Callable[[DataFrame], DataFrame]]] = []

    def register_detector(self, detector_id: str, fn: Callable[[DataFrame], DataFrame], version: str = "1.0.0") -> None:
        """``fn`` adds a ``finding`` column shaped like ``schema.FINDING``."""
        if any(entry[0] == detector_id for entry in self._entries):
            raise ValueError(f"detector {detector_id} is registered already")
        self._entries.append((detector_id, version, fn))

    def register_row_detector(self, detector_id: str, fn: RowDetector, columns: list[str], version: str = "1.0.0") -> None:
        finding = safe_finding(detector_id, fn, version)
        self.register_detector(
            detector_id, lambda df: df.withColumn("finding", finding(F.struct(*columns))), version
        )

    def findings(self, flows: DataFrame, id_column: str = "flow_id", first_ord: int = 0) -> DataFrame:
        """Long findings of all registered detectors, in one pass over flows."""
        scored, names = flows, []
        for i, (_, _, fn) in enumerate(self._entries):
            scored = fn(scored).withColumnRenamed("finding", f"_finding_{i}")
            names.append(f"_finding_{i}")
        return scored.select(id_column, F.posexplode(F.array(*names)).alias("ord", "f")).select(
            id_column, (F.col("ord") + first_ord).alias("ord"), "f.*"
        )

    def with_builtin(self, scored: DataFrame, id_column: str = "flow_id") -> DataFrame:
        """Built-in findings of scored flows followed by the registered ones."""
        builtin = finding_rows(scored, id_column)
        return builtin.unionByName(self.findings(scored, id_column, first_ord=6)) if self._entries else builtin


def safe_finding(detector_id: str, fn: RowDetector, version: str = "1.0.0") -> Callable[[Column], Column]:
    """A pandas UDF of ``fn``; a flow it fails on gets an Errored finding."""

    def run(flow: dict) -> dict:
        base = {
            "detector_id": detector_id, "detector_version": version, "score": 0.0, "confidence": 0.0,
            "severity": "Low", "evidence": [], "latency_us": 0, "status": "Completed",
        }
        try:
            return base | fn(flow)
        except Exception as error:
            return base | {"status": "Errored", "evidence": [{"description": str(error), "detail": None}]}

    @F.pandas_udf(FINDING)
    def finding(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [run(flow) for flow in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=FINDING.fieldNames())

    return finding
