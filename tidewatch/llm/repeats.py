"""Finding which windows of a corpus can repeat, without moving the windows.

Documents are dealt into chunks of a few megabytes by a hash of their id and text (many may have one id, or none). Every window (of bytes or words) has an anchor: its
leftmost least short gram. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so that a run of windows
with one anchor is one fragment. Chunks ask about sorted keys; a shard, which holds a range of keys of all chunks, answers
each asker in the order of its keys. A chunk asks once about each key, however often it has it, so that the most
frequent key costs one entry a chunk and no task holds all its places. All passes read the same exchange of the
documents by chunk.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm import kernels as K

#: Bytes of text in a chunk, and of text whose questions go to one shard, on average.
CHUNK, SHARE = 6 << 20, 24 << 20
REPLY = "chunk long, kind int, shard long, blob binary"
NOBODY = np.iinfo(np.int64).min


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each compressed by byte planes."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()
        small = pa.compress(raw, "zstd", asbytes=True)
        out.append(struct.pack("<3sQQ", a.dtype.str[1:].encode().ljust(3), len(a), len(small)) + small)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n, size = struct.unpack_from("<3sQQ", blob, at)
        at += struct.calcsize("<3sQQ")
        kind = np.dtype("<" + kind.decode().strip())
        raw = pa.decompress(blob[at : at + size], n * kind.itemsize, "zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    return out


def chunked(docs: DataFrame, carry: tuple[str, ...] = (), share: int = SHARE) -> tuple[DataFrame, int]:
    """chunk, doc_id (null: the least), text as UTF-8 bytes (null: none), columns to carry as c0, c1, ...; and the number of shards."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY))
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    return docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(chunks)).alias("chunk"), doc_id.alias("doc_id"), text.alias("text"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry))), max(1, -(-size // share))


def slide(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Part:
    """Some rows of a chunk: their elements, windows, and fragments (runs of windows with one anchor)."""

    def __init__(self, batch: pa.RecordBatch, width: int, gram: int, elements: Callable):
        self.batch = batch
        self.ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        self.data, self.offsets = K.flat(batch.column("text"))
        self.values, self.bounds = elements(self, self.data, self.offsets)
        self.width = width
        n = len(self.values)
        row = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))
        at = np.flatnonzero(K.whole(row, width))
        del row
        self.start = self.count = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        if not len(at):
            return
        grams = K.windows(self.values, gram)
        low = np.uint64(0xFFFFFFFF)
        best = slide((grams & ~low) | np.arange(n - gram + 1, dtype=np.uint64), width - gram + 1)[at] & low
        head = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.start = at[head]
        self.count = np.diff(np.concatenate([head, [len(at)]]))
        # Anchors are least grams; mixed anew, their keys are even.
        self.key = K.mix(grams[best[head].astype(np.int64)]) >> np.uint64(16)

    def row(self, at: np.ndarray) -> np.ndarray:
        """Row of each element."""
        return np.searchsorted(self.bounds, at, "right") - 1


def parts(batches: Iterable[pa.RecordBatch], width: int, gram: int, elements: Callable) -> Iterator[Part]:
    for piece in K.pieces(batches):
        yield Part(piece, width, gram, elements)


class Shards:
    """The shards that sorted keys of so many bits (32 at least) belong to, and where each one's keys lie.

    Only the shards that are met are held, of which a chunk has no more than keys, however many there are.
    """

    def __init__(self, keys: np.ndarray, bits: int, shards: int):
        number = ((keys.astype(np.uint64) >> np.uint64(bits - 32)) * np.uint64(shards)) >> np.uint64(32)
        self.low = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.high = np.append(self.low[1:], len(keys))[: len(self.low)]
        self.ids = number[self.low].astype(np.int64)

    def __iter__(self) -> Iterator[tuple[int, slice]]:
        return zip(self.ids.tolist(), map(slice, self.low.tolist(), self.high.tolist()))

    def of(self, shard: int) -> slice:
        k = int(np.searchsorted(self.ids, shard))
        return slice(int(self.low[k]), int(self.high[k]))


def spread(shards: Shards, *arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """A row (shard, blob) for each shard that is asked something."""
    return [(s, pack(*(a[own] for a in arrays))) for s, own in shards]


def asked(keys_docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a chunk, and whether two documents have it."""
    key = np.concatenate([x for x, _ in keys_docs]) if keys_docs else np.zeros(0, np.uint64)
    doc = np.concatenate([x for _, x in keys_docs]) if keys_docs else np.zeros(0, np.int64)
    if not len(key):
        return key, np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)


def candidates(table: pa.Table, width: int, gram: int, elements: Callable) -> tuple[list[Part], np.ndarray, np.ndarray]:
    found = list(parts(table.to_batches(), width, gram, elements))
    return found, *asked([(p.key, p.ids[p.row(p.start)]) for p in found])


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


QUESTION = "shard long, chunk long, blob binary"


def questions(rows: list[tuple], chunk: int) -> pa.Table:
    return _table([(s, chunk, b) for s, b in rows], ["shard", "chunk", "blob"], [pa.int64(), pa.int64(), pa.binary()])


def replies(rows: list[tuple], kind: int, shard: int) -> pa.Table:
    return _table([(c, kind, shard, b) for c, b in rows], ["chunk", "kind", "shard", "blob"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])


def shared_anchors(docs: DataFrame, shards: int, width: int, gram: int, elements: Callable) -> DataFrame:
    """Replies of kind 0: for each chunk and shard, which of the chunk's anchors are found in two documents or more."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        keys, twice = _light(table, width, gram, elements)
        dealt = Shards(keys, 48, shards)
        first = np.diff(keys, prepend=np.uint64(0))
        first[dealt.low] = keys[dealt.low]
        return questions(spread(dealt, first, twice.view(np.uint8)), key[0].as_py())

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows = [(c, *unpack(b)) for c, b in zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist())]
        asks = [np.cumsum(x[1], dtype=np.uint64) for x in rows]
        every = np.concatenate(asks)
        order = np.argsort(every)
        every = every[order]
        same = every[1:] == every[:-1]
        shared = np.zeros(len(every), bool)
        shared[1:] |= same
        shared[:-1] |= same
        found = np.zeros(len(every), bool)
        found[order] = shared
        out, at = [], 0
        for (chunk, _, twice), own in zip(rows, asks):
            out.append((chunk, pack(np.packbits(found[at : at + len(own)] | (twice > 0)))))
            at += len(own)
        return replies(out, 0, key[0].as_py())

    return docs.groupBy("chunk").applyInArrow(ask, QUESTION).groupBy("shard").applyInArrow(answer, REPLY)


def _light(table: pa.Table, width: int, gram: int, elements: Callable) -> tuple[np.ndarray, np.ndarray]:
    return asked([(p.key, p.ids[p.row(p.start)]) for p in parts(table.to_batches(), width, gram, elements)])


def told(replied: pa.Table, kind: int) -> list[tuple[int, list[np.ndarray]]]:
    """The replies of a kind by shard, unpacked."""
    rows = zip(*(replied.column(c).to_pylist() for c in ("kind", "shard", "blob")))
    return sorted(((s, unpack(b)) for k, s, b in rows if k == kind), key=lambda x: x[0])


def shared_keys(keys: np.ndarray, shards: int, replied: pa.Table) -> np.ndarray:
    """Those of a chunk's keys that the shards found shared."""
    dealt = Shards(keys, 48, shards)
    marked = np.zeros(len(keys), bool)
    for shard, (bits,) in told(replied, 0):
        own = dealt.of(shard)
        marked[own] = np.unpackbits(bits, count=own.stop - own.start)
    return keys[marked]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """True for each value found in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def by_chunk(docs: DataFrame, replied: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f(chunk, documents of the chunk, replies to it) for every chunk."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return f(key[0].as_py(), left, right)

    return docs.groupBy("chunk").cogroup(replied.groupBy("chunk")).applyInArrow(run, schema)


def first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the first counts most), and the place in it where each group of equal first two keys begins."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(order) else np.zeros(0, np.int64)


def column(name: str) -> Column:
    """doc_id as it was."""
    return F.when(F.col(name) != NOBODY, F.col(name)).alias(name)
