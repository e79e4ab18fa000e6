"""Cooldown chains: accept a row, then ignore the key until it expires.

Which rows are accepted depends on the row accepted before, so a key's rows
can't simply be shared out. But all that a stretch of time needs to know of the
past is when the key is free again, and all that it tells the next one is the
same: a function from entry to exit. So each key's time line is cut into
slices. In parallel, every slice works out its exit for every possible entry:
an entry only says which row is accepted first, and rows whose chains run into
each other share their exit. The functions, packed into a few bytes a row, are
then applied one after the other, and with its true entry every slice marks its
accepted rows, again in parallel. A key with most of all rows is spread over as
many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import HOUR_MS, slot

#: Free at any time.
NEVER = np.iinfo("int64").min
#: Rows of a result handed on at once.
ROWS = 10_000


def accepted_rows(df: DataFrame, keys: list[str], ts: str, ttl: str, row_id: str, width: int = HOUR_MS) -> DataFrame:
    """Rows of ``df`` that start a new cooldown, with ``until = ts + ttl``.

    A key is free again at ``until`` itself. Rows with equal time count in
    ``row_id`` order; ``ttl`` is positive, so at most one of them is accepted.
    Rows without key or time are never accepted. ``width`` is that of a slice in
    the unit of ``ts``; the distinct times of a key in one must fit a task.
    """
    first = df.groupBy(*keys, ts).agg(F.min(F.struct(row_id, ttl)).alias("_r"))
    nodes = first.select(
        *keys, slot(ts, width).alias("_slice"), ts, F.col(f"_r.{row_id}").alias(row_id), (F.col(ts) + F.col(f"_r.{ttl}")).alias("until")
    ).dropna(subset=[*keys, ts])
    entered = entries(exits(nodes, keys, ts), keys).select(*keys, "_slice", F.col("entry").alias("until"))
    # A slice's entry comes before its rows.
    line = nodes.unionByName(entered, allowMissingColumns=True).repartition(*keys, "_slice")
    rows = line.sortWithinPartitions(*keys, "_slice", F.col(ts).asc_nulls_first())

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, [*keys, "_slice"]):
            at, until = column(held, ts), column(held, "until")
            taken, row = [], 1 + int(np.searchsorted(at[1:], until[0]))
            while row < len(at):
                taken.append(row)
                row = max(row + 1, 1 + int(np.searchsorted(at[1:], until[row])))
            if taken:
                yield pa.Table.from_batches(held).take(pa.array(taken)).combine_chunks().to_batches()[0]

    walked = rows.mapInArrow(lambda batches: gathered(mark(batches)), line.schema).drop("_slice")
    return df.join(walked, [*keys, ts, row_id])


def sliced(nodes: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The rows of each key and slice side by side, in the order of time."""
    return nodes.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", ts)


def exits(nodes: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """(keys, _slice, n, lasts, places, exits): each slice's exit for every entry.

    An entry up to the first of the n ``lasts``, or between two of them, has the
    exit whose number stands there; a later one finds no row and is the exit
    itself.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, [*keys, "_slice"]):
            at, until = column(held, ts), column(held, "until")
            after = np.maximum(np.searchsorted(at, until), np.arange(1, len(at) + 1))
            # Follow all chains at once, twice as far each time, to their last row in the slice.
            end = np.where(after < len(at), after, np.arange(len(at)))
            while not np.array_equal(further := end[end], end):
                end = further
            exit_ = until[end]
            last = np.append(exit_[1:] != exit_[:-1], True)
            distinct, place = np.unique(exit_[last], return_inverse=True)
            head = held[0].slice(0, 1).select([*keys, "_slice"])
            told = [int(last.sum()), *map(packed, (np.diff(at[last], prepend=0), place.astype(np.uint32))), distinct.tobytes()]
            yield pa.RecordBatch.from_arrays([*head.columns, *(pa.array([x]) for x in told)], [*keys, "_slice", "n", "lasts", "places", "exits"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*keys, "_slice").schema)
    return sliced(nodes.select(*keys, "_slice", ts, "until"), keys, ts).mapInArrow(
        lambda batches: gathered(run(batches)), f"{own}, n long, lasts binary, places binary, exits binary")


def entries(functions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _slice, entry): when the key is free again as each slice begins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, free = None, NEVER
        for batch in batches:
            found, starts = [], changes(batch, keys)
            if before is not None and batch.num_rows:
                starts[0] = not same(before, batch, keys)
            for row, start in enumerate(starts.tolist()):
                free = NEVER if start else free
                found.append(free)
                n, lasts, places, ends = (batch.column(c)[row].as_py() for c in ("n", "lasts", "places", "exits"))
                place = int(np.searchsorted(np.cumsum(unpacked(lasts, n, "int64")), free))
                if place < n:
                    free = int(np.frombuffer(ends, "int64")[unpacked(places, n, "uint32")[place]])
            before = batch.slice(batch.num_rows - 1) if batch.num_rows else before
            yield batch.select([*keys, "_slice"]).append_column("entry", pa.array(found, pa.int64()))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in functions.select(*keys, "_slice").schema)
    return functions.repartition(*keys).sortWithinPartitions(*keys, "_slice").mapInArrow(run, f"{own}, entry long")


def packed(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes, most of which are alike in small numbers."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def changes(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """True for each row that differs from the one before; the first one does."""
    changed = np.zeros(batch.num_rows, bool)
    changed[:1] = True
    for name in by:
        own = batch.column(name)
        changed[1:] |= pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
    return changed


def same(a: pa.RecordBatch, b: pa.RecordBatch, by: list[str]) -> bool:
    return all(a.column(n)[0].as_py() == b.column(n)[0].as_py() for n in by)


def groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The pieces of each group of sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(changes(batch, by)).tolist()
        for k, (low, high) in enumerate(zip(starts, [*starts[1:], batch.num_rows])):
            part = batch.slice(low, high - low)
            if held and (k or not same(held[0], part, by)):
                yield held
                held = []
            held.append(part)
    if held:
        yield held


def column(held: list[pa.RecordBatch], name: str) -> np.ndarray:
    """A column of whole numbers; null is the least."""
    parts = [pc.fill_null(b.column(name).cast(pa.int64()), NEVER).to_numpy(zero_copy_only=False) for b in held]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
