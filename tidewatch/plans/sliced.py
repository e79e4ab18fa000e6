"""Per-key running values that do not put a whole key into one task.

A window partitioned by a hot key sorts that key's rows in one task. The
helpers here cut every key's time line into slices, reduce each slice first
(with map-side combine), run the per-key window over slice totals only, and
finish inside (key, slice). Rows of one key then spread over as many tasks as
it has slices, and the per-key window sees at most one row per slice. Key
columns must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.times import SECOND_US, slot

_SLICE = "_slice"


def _before(partition: list[str], *order: str):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _through(partition: list[str], *order: str):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    slice_us: int = 10 * SECOND_US,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums and last non-null values in (``ts``, ``order``) order.

    ``inclusive=False`` leaves the row's own values out.
    """
    sums, lasts = sums or {}, lasts or {}
    rank = [ts, *order]
    rows = df.withColumns({f"_s_{n}": e for n, e in sums.items()} | {f"_l_{n}": e for n, e in lasts.items()})
    rows = rows.withColumn(_SLICE, slot(ts, slice_us)).repartition(*keys, _SLICE)

    totals = [F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums]
    for n in lasts:
        at = F.struct(*rank, F.col(f"_l_{n}").alias("_v"))
        totals.append(F.max(F.when(F.col(f"_l_{n}").isNotNull(), at)).alias(f"_t_{n}"))
    earlier = _before(keys, _SLICE)
    carried = [F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums]
    carried += [F.last(f"_t_{n}", ignorenulls=True).over(earlier)["_v"].alias(f"_b_{n}") for n in lasts]
    carry = rows.groupBy(*keys, _SLICE).agg(*totals).select(*keys, _SLICE, *carried)

    inside = (_through if inclusive else _before)([*keys, _SLICE], *rank)
    added = {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_s_{n}").over(inside), F.lit(0)) for n in sums}
    added |= {
        n: F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(inside), F.col(f"_b_{n}")) for n in lasts
    }
    return rows.join(carry, [*keys, _SLICE]).select(*df.columns, *[e.alias(n) for n, e in added.items()])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    slice_us: int = 60 * SECOND_US,
) -> DataFrame:
    """Left rows with ``values`` of the latest right row at or before them.

    Equal right times resolve to the largest ``values``. Rows with a null key
    or time match nothing.
    """
    known = F.lit(True)
    for key in [*keys, right_ts]:
        known = known & F.col(key).isNotNull()
    asked = F.lit(True)
    for key in [*keys, left_ts]:
        asked = asked & F.col(key).isNotNull()
    value = right.select(F.struct(*values).alias("v")).schema["v"].dataType
    facts = right.filter(known).groupBy(*keys, F.col(right_ts).alias("_at")).agg(F.max(F.struct(*values)).alias("_value"))
    # Only distinct keys and times are swept; what they find is joined to the rows.
    probes = left.filter(asked).select(*keys, F.col(left_ts).alias("_at")).distinct().withColumn("_value", F.lit(None).cast(value))
    timeline = facts.withColumn("_kind", F.lit(0)).unionByName(probes.withColumn("_kind", F.lit(1)))
    swept = running(timeline, keys, "_at", ["_kind"], lasts={"_found": F.col("_value")}, slice_us=slice_us).filter("_kind = 1")
    found = swept.select(*keys, F.col("_at").alias(left_ts), *[F.col("_found")[v].alias(v) for v in values])
    return left.join(found, [*keys, left_ts], "left").select(*left.columns, *values)


def islands(
    df: DataFrame,
    keys: list[str],
    ts: str,
    gap_us: int,
    aggs: dict[str, tuple[str, Column]],
    split_at_gap: bool = False,
    firsts: tuple[str, ...] = (),
) -> DataFrame:
    """Runs of rows whose neighbours are close, with their first and last time.

    A run ends where the next row is more than ``gap_us`` later, or at least
    ``gap_us`` later with ``split_at_gap``. ``aggs`` maps a name to one of
    sum, min, max and its expression; ``firsts`` are few-valued columns whose
    value at the start of the run is kept.
    """
    numbered = slice_runs(df, keys, ts, gap_us, aggs, split_at_gap, firsts)
    return numbered.groupBy(*keys, "_run").agg(
        F.min("_first").alias("first_us"),
        F.max("_last").alias("last_us"),
        *[getattr(F, how)(name).alias(name) for name, (how, _) in aggs.items()],
        *[F.min_by(name, "_first").alias(name) for name in firsts],
    ).drop("_run")


def slice_runs(
    df: DataFrame, keys: list[str], ts: str, gap_us: int, aggs: dict[str, tuple[str, Column]], split_at_gap: bool,
    firsts: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (key, slice) with the start time of the run it belongs to.

    Slices are as wide as the gap, so two rows of one slice are always closer
    than the gap and a slice never spans two runs. ``firsts`` are extra
    grouping columns, so that all buffers are numbers and the aggregation
    before the shuffle stays a hash aggregation.
    """
    slices = df.groupBy(*keys, *firsts, slot(ts, gap_us).alias(_SLICE)).agg(
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        *[getattr(F, how)(expr).alias(name) for name, (how, expr) in aggs.items()],
    )
    timeline = Window.partitionBy(*keys).orderBy(_SLICE, "_first")
    gap = F.col("_first") - F.max("_last").over(timeline.rowsBetween(Window.unboundedPreceding, -1))
    broken = (gap >= gap_us) if split_at_gap else (gap > gap_us)
    return slices.withColumn("_start", F.when(gap.isNull() | broken, F.col("_first"))).withColumn(
        "_run", F.last("_start", ignorenulls=True).over(timeline.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_start")


def session_running(
    df: DataFrame,
    keys: list[str],
    ts: str,
    is_event: str,
    gap_us: int,
    sums: dict[str, Column],
    slice_us: int = 10 * SECOND_US,
) -> DataFrame:
    """Counts that grow while events keep coming and restart after a silence.

    Every row (event or probe) gets the sums over the events of the current
    session up to its time: 0 once more than ``gap_us`` passed since the last
    event. An event counts itself, and events precede probes of equal time.
    """
    width = min(slice_us, gap_us)
    kind = F.when(F.col(is_event), 0).otherwise(1)
    event_ts = F.when(F.col(is_event), F.col(ts))
    rows = df.withColumns(
        {f"_s_{n}": F.when(F.col(is_event), e).otherwise(0) for n, e in sums.items()}
        | {"_kind": kind, "_event_ts": event_ts, _SLICE: slot(ts, width)}
    ).repartition(*keys, _SLICE)

    earlier, upto = _before(keys, _SLICE), _through(keys, _SLICE)
    slices = rows.groupBy(*keys, _SLICE).agg(
        F.min("_event_ts").alias("_first"),
        F.max("_event_ts").alias("_last"),
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
    )
    slices = slices.withColumns(
        {"_prev": F.last("_last", ignorenulls=True).over(earlier)}
        | {f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)) for n in sums}
    )
    fresh = F.col("_first").isNotNull() & (
        F.col("_prev").isNull() | (F.col("_first") - F.col("_prev") > gap_us)
    )
    # Total before the session started, for the slice's own session and for
    # the one before the slice.
    carry = slices.select(
        *keys, _SLICE, "_prev", *[f"_c_{n}" for n in sums],
        *[F.last(F.when(fresh, F.col(f"_c_{n}")), ignorenulls=True).over(upto).alias(f"_own_{n}") for n in sums],
        *[F.last(F.when(fresh, F.col(f"_c_{n}")), ignorenulls=True).over(earlier).alias(f"_old_{n}") for n in sums],
    )
    inside = _through([*keys, _SLICE], ts, "_kind")
    seen = F.max("_event_ts").over(inside)
    result = {}
    for n in sums:
        here = F.col(f"_c_{n}") - F.col(f"_own_{n}") + F.sum(f"_s_{n}").over(inside)
        carried = F.col(f"_c_{n}") - F.col(f"_old_{n}")
        result[n] = F.when(seen.isNotNull(), here).when(F.col(ts) - F.col("_prev") <= gap_us, carried).otherwise(0)
    return rows.join(carry, [*keys, _SLICE]).select(*df.columns, *[e.alias(n) for n, e in result.items()])
