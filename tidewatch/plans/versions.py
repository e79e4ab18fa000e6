"""Sets that change in time.

A table of snapshots says what a set held at certain times, and a snapshot
replaces the one before it. ``intervals`` turns snapshots into the times
during which each member was in the set, by comparing neighbouring snapshots:
a row says that its member is there at its own snapshot, and was there before
the next one; where only one of the two is found, the member came or went. One
aggregation on (owner, member, time) does this, so that no key's history is
in one task, and only the changes of a member are put in order.

``in_force`` and ``not_in_force`` join rows with the members at their time.
Intervals are cut into time slots, so that the join is an equality on the key
and the slot, and a member that every row refers to is spread over the slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.times import SECOND_US, slot
from tidewatch.plans.sliced import running

SLOT_US = 3600 * SECOND_US
_DAY_US = 24 * SLOT_US
BOUNDS = ["valid_from", "valid_to"]


def shared_owner(*tables: DataFrame) -> list[str]:
    """The host column, if all tables have one: then keys are per host."""
    return ["host"] if all("host" in t.columns for t in tables) else []


def intervals(
    snapshots: DataFrame, owner: list[str], member: list[str], ts: str = "ts_us", times: DataFrame | None = None
) -> DataFrame:
    """(owner, member, valid_from, valid_to): when each member was in the set.

    ``valid_to`` is the first snapshot without the member, null while there is
    none. ``times`` has further snapshots (owner, ts), as one that holds nothing
    has no row in ``snapshots``. Rows with a null in owner, member or time are
    ignored, repeated rows count once.
    """
    rows = snapshots.select(*owner, *member, F.col(ts).alias("_ts")).dropna()
    taken = rows.select(*owner, "_ts")
    if times is not None:
        taken = taken.unionByName(times.select(*owner, F.col(ts).alias("_ts")).dropna())
    marks = F.array_compact(F.array(
        F.struct(F.col("_ts").alias("at"), F.lit(1).alias("here"), F.lit(0).alias("before")),
        F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("at"), F.lit(0).alias("here"), F.lit(1).alias("before"))),
    ))
    seen = rows.join(_with_next(taken.distinct(), owner), [*owner, "_ts"]).select(*owner, *member, F.explode(marks).alias("m")).groupBy(
        *owner, *member, F.col("m.at").alias("_at")).agg(F.max("m.here").alias("_here"), F.max("m.before").alias("_before"))
    # Comings and goings of a member alternate.
    following = F.lead("_at").over(Window.partitionBy(*owner, *member).orderBy("_at"))
    ended = seen.filter("_here <> _before").withColumn("valid_to", following).filter("_here = 1")
    return ended.select(*owner, *member, F.col("_at").alias("valid_from"), "valid_to")


def _with_next(times: DataFrame, owner: list[str]) -> DataFrame:
    """Distinct times with the owner's next one, null after the last.

    An owner has a time each few seconds at most, whatever its data. Without
    owner, the times of a day are reduced before days are put in order.
    """
    if owner:
        return times.withColumn("_next", F.lead("_ts").over(Window.partitionBy(*owner).orderBy("_ts")))
    # On the reversed clock the next time is the last one before.
    back = times.select("_ts", F.lit(0).alias("_all"), (-F.col("_ts")).alias("_back"))
    found = running(back, ["_all"], "_back", [], lasts={"_next": F.col("_ts")}, slice_us=_DAY_US, inclusive=False)
    return found.select("_ts", "_next")


def _slotted(rows: DataFrame, sets: DataFrame, ts: str, width: int, span: tuple[int, int] | None) -> DataFrame:
    """The intervals, once for each slot between the first and the last row."""
    low, high = (F.lit(x) for x in span) if span else (rows.select(f(ts)).scalar() for f in (F.min, F.max))
    ends = sets.withColumns({
        "_low": F.greatest(F.col("valid_from"), low),
        "_high": F.least(F.coalesce(F.col("valid_to") - 1, high), high),
    }).filter("_low <= _high")
    return ends.withColumn("_slot", F.explode(F.sequence(slot("_low", width), slot("_high", width)))).drop("_low", "_high")


def _covers(ts: str) -> Column:
    at = F.col(f"l.{ts}")
    return (at >= F.col("s.valid_from")) & (F.col("s.valid_to").isNull() | (at < F.col("s.valid_to")))


def _matched(
    rows: DataFrame, sets: DataFrame, on: dict[str, str], ts: str, how: str, width: int, span: tuple[int, int] | None
) -> DataFrame:
    left = rows.withColumn("_slot", slot(ts, width)).alias("l")
    right = _slotted(rows, sets, ts, width, span).alias("s")
    condition = (F.col("l._slot") == F.col("s._slot")) & _covers(ts)
    for mine, theirs in on.items():
        condition = condition & (F.col(f"l.{mine}") == F.col(f"s.{theirs}"))
    return left.join(right, condition, how)


def in_force(
    rows: DataFrame, sets: DataFrame, on: dict[str, str], ts: str, values: dict[str, str],
    width: int = SLOT_US, span: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows with values of the interval that holds their time, else nulls.

    ``on`` maps columns of the rows to those of ``sets``, and ``values`` new
    columns to those of ``sets``. Intervals of one key don't overlap. ``span``
    is the first and last time of the rows, if it is known; else the rows are
    read for it. Rows with a null key or time match nothing.
    """
    picked = [F.col(f"s.{theirs}").alias(mine) for mine, theirs in values.items()]
    return _matched(rows, sets, on, ts, "left", width, span).select(*[F.col(f"l.{c}") for c in rows.columns], *picked)


def not_in_force(
    rows: DataFrame, sets: DataFrame, on: dict[str, str], ts: str,
    width: int = SLOT_US, span: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows that no interval of their key holds at their time; intervals may overlap."""
    return _matched(rows, sets, on, ts, "left_anti", width, span).select(*rows.columns)
