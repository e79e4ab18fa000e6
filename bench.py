"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from harness.queries import ORACLES, QUERIES
from tidewatch.session import get_session

HEADLINE = [
    "verdicts_by_country", "packet_verdicts", "flow_sessions", "crossflow_lookup", "geo_lookup", "cooldown",
    "activity_feed", "active_blocks", "latest_verdicts", "block_intervals", "asof_ptr",
]


def duckdb_times(sf_dir: str, names: list[str], threads: int) -> dict[str, float]:
    """Seconds of each query's statement on the same tables; set BENCH_DUCKDB to have them."""
    import duckdb

    c = duckdb.connect(config={"threads": threads})
    for path in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path if path.is_file() else path / '*.parquet'}'")
    times = {}
    for name in (n for n in names if n in ORACLES):
        start = time.time()
        c.execute(f"CREATE OR REPLACE TEMP TABLE result AS {ORACLES[name]}")
        times[name] = round(time.time() - start, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(int(cpus) if cpus.isdigit() else 8), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # Classes are loaded and the first plans compiled before anything is timed.
    QUERIES["latest_verdicts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    told = {"duckdb": duckdb_times(sf_dir, list(times), int(cpus) if cpus.isdigit() else 8)} if os.environ.get("BENCH_DUCKDB") else {}
    print(json.dumps(told | {
        "metric": "headline queries, wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
