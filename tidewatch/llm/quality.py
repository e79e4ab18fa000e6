"""Quality rules: fixed base rules and a logistic regression over hashed word and character n-grams.

The regression is fitted on at most ``sample`` labelled documents of each class (chosen by hash, none longer than
``LONGEST`` characters unless the class has only such; a bound on the sample only), in one task; its probabilities are calibrated on a held-out third, and every
document is scored in Arrow batches against a fixed threshold.

A null or empty text has no words and so fails the base rules; a document without label is scored like any other; without
labelled documents of both classes only the base rules decide. Repeated rows are judged each for itself, further
columns are ignored by ``judge`` and passed through by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import kernels as K
from tidewatch.plans.lineage import stage

BITS = 18
LONGEST = 20_000
#: A document is kept if it is of good quality with at least this probability (classes weighing the same).
THRESHOLD = 0.3
#: Largest size of a feature's weight sum: a document's features are averages times this.
SCALE = 64.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, p_quality double"
)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each family (words, word pairs, four characters): feature numbers, and the bounds of the rows in them."""
    starts, ends, first = K.words(data, offsets)
    own = K.span_hashes(data, starts, ends)
    shift = np.uint64(64 - BITS)
    found = [(own >> shift, first)]
    for values, bounds, width, salt in ((own, first, 2, 1), (data, offsets, 4, 2)):
        row = K.rows_of(bounds)
        inside = K.whole(row, width)
        hashes = K.windows(values, width)[inside] * np.uint64(2 * salt + 1)
        counts = np.bincount(row[: len(inside)][inside], minlength=len(bounds) - 1)
        found.append((hashes >> shift, np.concatenate([[0], np.cumsum(counts)])))
    return found


class Model:
    """Weights of the regression and its calibration."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(offsets) - 1)
        for ids, bounds in features(data, offsets):
            total += SCALE * K.totals(self.weights[ids], bounds) / np.maximum(np.diff(bounds), 1)
        return total

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.offset, -50, 50)))


def _batches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of the texts, a piece at a time."""
    for piece in K.pieces([pa.record_batch([pa.array(texts, pa.string())], ["text"])]):
        yield K.flat(piece.column("text"))


def train(texts: list[str], labels: np.ndarray, rounds: int = 60) -> Model | None:
    """Fit on two thirds of the texts, calibrate on the rest; None without both classes in both parts."""
    part = np.arange(len(texts)) % 3 == 2
    if any(len(np.unique(labels[x])) < 2 for x in (part, ~part)):
        return None
    at, row, value = ([[] for _ in range(3)] for _ in range(3))  # of each family
    done = 0
    for data, offsets in _batches([x for x, held in zip(texts, part) if not held]):
        for k, (ids, bounds) in enumerate(features(data, offsets)):
            pairs, counts = np.unique(K.rows_of(bounds).astype(np.int64) << BITS | ids.astype(np.int64), return_counts=True)
            r = (pairs >> BITS).astype(np.int32)
            at[k].append((pairs & ((1 << BITS) - 1)).astype(np.int32))
            row[k].append(r + np.int32(done))
            value[k].append((SCALE * counts / np.maximum(np.diff(bounds), 1)[r]).astype(np.float32))
        done += len(offsets) - 1
    at, row, value = (np.concatenate([x for family in column for x in family]) for column in (at, row, value))
    goal = labels[~part].astype(float)
    share = np.where(goal == 1, 0.5 / goal.sum(), 0.5 / (len(goal) - goal.sum()))
    weights, first, second = (np.zeros(1 << BITS) for _ in range(3))
    for step in range(1, rounds + 1):
        seen = np.bincount(row, weights[at] * value, len(goal))
        off = (1 / (1 + np.exp(-np.clip(seen, -50, 50))) - goal) * share
        slope = np.bincount(at, off[row] * value, 1 << BITS) + 1e-5 * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        weights -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    model = Model(weights.astype(np.float32), 1.0, 0.0)
    margins = [model.margins(data, offsets) for data, offsets in _batches([x for x, held in zip(texts, part) if held])]
    return _calibrated(model, np.concatenate(margins), labels[part].astype(float))


def _calibrated(model: Model, margins: np.ndarray, goal: np.ndarray) -> Model:
    """Logistic curve from margins to frequencies, by Newton's method with smoothed goals."""
    good, bad = goal.sum(), len(goal) - goal.sum()
    aim = np.where(goal == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.where(goal == 1, 0.5 / good, 0.5 / bad)
    x, b = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        bend = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        b = b - np.clip(np.linalg.solve(bend, x @ (weight * (p - aim)) + 1e-6 * (b - [1.0, 0.0])), -1, 1)
    return Model(model.weights, float(max(b[0], 1e-3)), float(b[1]))


def _trained(table: pa.Table) -> pa.Table:
    """A row of the model that the sample gives, or none."""
    quality, doc_id = (table.column(c).to_numpy() for c in ("quality", "doc_id"))
    order = np.lexsort((doc_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), quality))
    model = train(table.column("text").take(pa.array(order)).to_pylist(), quality[order])
    rows = [(model.weights.tobytes(), model.slope, model.offset)] if model else []
    kinds = (pa.binary(), pa.float64(), pa.float64())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["weights", "slope", "offset"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 800) -> Model | None:
    """Model from at most ``sample`` labelled documents a class; a document labelled both ways counts as bad.

    A task trains it; the driver gets its weights only.
    """
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(F.min(F.col("quality").cast("int")).alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    picked = stage(_picked(texts.where(F.length("text") <= LONGEST), one, sample))
    have = [r["quality"] for r in picked.select("quality").distinct().collect()]
    if len(have) < 2:
        # A class has longer texts only (or none): any length will do for it.
        missing = one.where(~F.col("quality").isin(have)) if have else one
        picked = picked.unionByName(_picked(texts, missing, sample))
    found = picked.groupBy().applyInArrow(_trained, "weights binary, slope double, offset double").first()
    return found and Model(np.frombuffer(found["weights"], np.float32), found["slope"], found["offset"])


def _picked(texts: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """quality, doc_id, text: at most ``sample`` labelled texts of each class."""
    # Twice the sample, as some may have no document or too long a one; at most 4 x sample ids are broadcast.
    picked = [labels.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample) for k in (0, 1)]
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    ranked = found.groupBy("quality", "doc_id").agg(F.min("text").alias("text"))
    each = [ranked.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return each[0].unionByName(each[1])


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each row."""
    starts, ends, first = K.words(data, offsets)
    row = K.rows_of(first)
    black = ~K.WHITE[data]
    begin, stop, owner = K.lines(data, offsets)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(black, out=filled[1:])
    filled = filled[stop] > filled[begin]
    begin, stop, owner = begin[filled], stop[filled], owner[filled]
    salt = K.mix(np.arange(1, len(offsets), dtype=np.uint64))
    twice = K.later(K.mix(K.span_hashes(data, begin, stop) ^ salt[owner]))
    inside = K.whole(row, 3)
    own = K.windows(K.span_hashes(data, starts, ends), 3)
    marked = np.zeros(len(inside), bool)
    marked[inside] = K.repeated(K.mix(own[inside] ^ salt[row[: len(inside)][inside]]))
    return {
        "n_words": np.diff(first),
        "word_chars": K.totals(black & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": K.totals(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(owner[twice], minlength=len(offsets) - 1),
        "n_repeat_words": K.totals(K.covered(marked, 3, len(row)), first),
    }




def verdicts(data: np.ndarray, offsets: np.ndarray, model: Model | None) -> dict[str, np.ndarray]:
    """Measures, base rules and the model's verdict of each row."""
    found = measure(data, offsets)
    failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
    p = model.probability(data, offsets) if model else np.ones(len(failed))
    return found | {"base_failed": failed, "kept": ~failed & (p >= THRESHOLD), "p_quality": p}


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: base measures, base_failed, kept, p_quality."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches):
            found = verdicts(*K.flat(piece.column("text")), model)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches):
            found = verdicts(*K.flat(pc.cast(piece.column("text"), pa.string())), model)
            yield piece.filter(pa.array(found["kept"]))

    return docs.mapInArrow(run, docs.schema)
