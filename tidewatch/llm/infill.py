"""Fill-in-the-middle transformation by secondary sort.

A text is cut into lines; two draws from its id choose where prefix and middle end. Its pieces, chunks of whole lines, are
keyed by document and position in the output. One exchange and Spark's sort bring each document's pieces into order, and a
task streams them, holding one piece at a time, so that a text of any length is assembled in bounded memory. For
restoration the output is read as a stream, its markers tell where each stretch belongs, and the same partitions are
sorted again, without a second exchange, into the order of the text.

A null or empty text is plain, and so is one that holds a marker. A null doc_id draws as an empty one. Equal rows of a
batch are moved once and counted; each gives a row. Rows that share a doc_id but not the text are told apart by a hash of
the text. Further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import kernels as K

#: Bytes of a piece, and rows and bytes of a batch that a task hands on, at most.
PIECE, ROWS, HELD = 1 << 15, 2000, 1 << 22

#: The markers, and the order of the stretches (prefix, suffix, middle) in each form.
MARKERS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
FORMS = {"psm": "PSM", "spm": "SPM"}
#: Order of the stretches in the text.
SOURCE = "PMS"

KEY = "doc_id long, _row long, "
PARTS = KEY + "place long, form string, n long, copies long, output binary"
STRETCHES = KEY + "place long, form string, n long, copies long, output_sha256 string, part binary"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Draws:
    """How often a text is transformed, and how often suffix first, in percent."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50

    def of(self, doc_id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def cut(doc_id: int | None, text: bytes, draws: Draws) -> tuple[str, np.ndarray, list[tuple[str, int, int]]]:
    """Form, ends of the lines, and the stretches (name, start, end) in the order of the output."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if text and text[-1] != 10:
        ends = np.append(ends, len(text))
    h = draws.of(doc_id)
    if not text or any(m in text for m in MARKERS.values()) or h[2] % 100 >= draws.rate:
        return "plain", ends, [("", 0, len(text))]
    low, high = sorted(x % (len(ends) + 1) for x in h[:2])
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    spans = {"P": (0, a), "M": (a, b), "S": (b, len(text))}
    form = "spm" if h[3] % 100 < draws.suffix_first else "psm"
    return form, ends, [(s, *spans[s]) for s in FORMS[form]]


def chunks(text: bytes, ends: np.ndarray, low: int, high: int) -> Iterator[bytes]:
    """The stretch in pieces of whole lines; a line that is longer than a piece is cut between code points."""
    while high - low > PIECE:
        k = int(np.searchsorted(ends, low + PIECE, "right")) - 1
        stop = int(ends[k]) if k >= 0 and ends[k] > low else low + PIECE
        while text[stop] & 0xC0 == 0x80:
            stop -= 1
        yield text[low:stop]
        low = stop
    yield text[low:high]


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, whose last column may be long, as batches of bounded size."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[-1] or "")
        if held > HELD or len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(low, 256).columns))


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def pieces(docs: DataFrame, draws: Draws = Draws()) -> DataFrame:
    """The output's pieces, in no order: place counts a document's pieces from 0; form, n (lines) and copies stand on the first."""
    schema = arrow(PARTS)

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for part in K.pieces(batches):
            data, offsets = K.flat(part.column("text"))
            data, offsets, copies = data.tobytes(), offsets.tolist(), {}
            for doc_id, row, a, b in zip(part.column("doc_id").to_pylist(), part.column("_row").to_pylist(), offsets, offsets[1:]):
                key = doc_id, row, data[a:b]
                copies[key] = copies.get(key, 0) + 1
            for (doc_id, row, text), n in copies.items():
                form, ends, stretches = cut(doc_id, text, draws)
                place = 0
                for name, low, high in stretches:
                    mark = MARKERS.get(name, b"")
                    for chunk in chunks(text, ends, low, high):
                        yield doc_id, row, place, form if not place else None, len(ends), n, mark + chunk
                        place, mark = place + 1, b""

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row"), text.alias("text"))
    return narrow.mapInArrow(lambda batches: batches_of(made(batches), schema), PARTS)


def ordered(docs: DataFrame, draws: Draws = Draws()) -> DataFrame:
    return pieces(docs, draws).repartition("doc_id", "_row").sortWithinPartitions("doc_id", "_row", "place")


def once(rows: Iterable[tuple]) -> Iterator[tuple[tuple, list[int], Iterator[tuple]]]:
    """Key, a counter of copies and the pieces of each document; pieces of equal rows lie side by side and are taken once."""
    for key, own in groupby(rows, key=lambda r: r[:2]):
        copies = [0]

        def distinct(own=own, copies=copies):
            for place, same in groupby(own, key=lambda r: r[2]):
                first = next(same)
                if not place:
                    copies[0] = first[5] + sum(r[5] for r in same)
                yield first

        yield key, copies, distinct()


def transformed(docs: DataFrame, draws: Draws = Draws()) -> DataFrame:
    """The transformed texts: doc_id, copies (equal rows), part (from 0), form, and output, the part's text (bytes in UTF-8)."""
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (doc_id, _), copies, own in once(rows):
            form = None
            for r in own:
                form = r[3] or form
                yield doc_id, copies[0], r[2], form, r[6]

    kinds = "doc_id long, copies long, part long, form string, output binary"
    schema = arrow(kinds)
    return ordered(docs, draws).mapInArrow(lambda batches: batches_of(run(rows_of(batches)), schema), kinds)


def dissect(form: str, parts: Iterable[bytes]) -> Iterator[tuple[str, bytes]]:
    """Stretch and bytes, read from a stream of the output's parts, however it is cut."""
    if form == "plain":
        yield from (("P", p) for p in parts)
        return
    held, name, ahead = b"", "", list(FORMS[form])
    for part in parts:
        held += part
        while ahead and (at := held.find(MARKERS[ahead[0]])) >= 0:
            if at:
                yield name, held[:at]
            name, held = ahead[0], held[at + len(MARKERS[ahead.pop(0)]) :]
        sure = len(held) - 2 * bool(ahead)  # a marker may have begun in the last two bytes
        if sure > 0:
            yield name, held[:sure]
            held = held[sure:]
    if held:
        yield name, held


def stretches(rows: Iterable[tuple]) -> Iterator[tuple]:
    """From the ordered pieces: the output's digest at place -1, and its stretches by their place in the text."""
    for (doc_id, row), copies, own in once(rows):
        first = next(own)
        form, n, digest = first[3], first[4], hashlib.sha256()

        def output(first=first, own=own, digest=digest):
            digest.update(first[6])
            yield first[6]
            for r in own:
                digest.update(r[6])
                yield r[6]

        for k, (name, part) in enumerate(dissect(form, output())):
            yield doc_id, row, SOURCE.index(name) << 40 | k, None, None, None, None, part
        yield doc_id, row, -1, form, n, copies[0], digest.hexdigest(), None


def restored(rows: Iterable[tuple]) -> Iterator[tuple]:
    for (doc_id, _), own in groupby(rows, key=lambda r: r[:2]):
        _, _, _, form, n, copies, output, _ = next(own)
        digest, chars = hashlib.sha256(), [0, 0, 0]
        for r in own:
            digest.update(r[7])
            chars[r[2] >> 40] += int(np.count_nonzero(np.frombuffer(r[7], np.uint8) & 0xC0 != 0x80))
        plain = form == "plain"
        found = doc_id, n, form, None if plain else chars[0], None if plain else chars[1], output, digest.hexdigest()
        yield from (found for _ in range(copies))


def digest(docs: DataFrame, draws: Draws = Draws()) -> DataFrame:
    """Per document: n (lines), form, code points of prefix and middle, digests of the output and of the text restored from it."""
    parts, result = arrow(STRETCHES), arrow(RESULT)
    told = ordered(docs, draws).mapInArrow(lambda batches: batches_of(stretches(rows_of(batches)), parts), STRETCHES)
    # The partitions stay as they are, so that a sort within them is enough.
    back = told.sortWithinPartitions("doc_id", "_row", "place")
    return back.mapInArrow(lambda batches: batches_of(restored(rows_of(batches)), result), RESULT)
