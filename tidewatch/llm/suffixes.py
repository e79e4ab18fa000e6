"""Suffix-array dedup over UTF-8 bytes: external induced sorting of the text that may repeat.

Only fragments whose anchor two documents share are moved (see ``repeats``), each distinct one once a chunk. A shard sorts the
suffixes of its distinct fragments by induction: the leftmost S-suffixes are sorted first, recursively by the names of their
substrings; then the sorted order of all L-suffixes and then of all S-suffixes follows by taking suffixes from queues in order and
putting their predecessors into the queue of their own first byte. The queues together are a priority queue by first byte,
take whole runs of suffixes at once, and go to disk beyond ``SPILL`` entries. Neighbours in the order with a common
prefix of ``WIDTH`` bytes are one string; the least doc_id that has it decides. Fragments are shorter than 128 bytes, and only
prefixes of ``WIDTH`` bytes count: below the first level, where nearly every name has a queue of its own, names are sorted by
doubling until they cover that many bytes.

A null or empty text has no bytes. A null doc_id is smaller than all others. Rows with one doc_id are judged each, and never
against each other. Further columns are ignored by ``digest`` and carried by ``trim``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import kernels as K, repeats as R

WIDTH, GRAM = 50, 20
#: Bytes of text whose fragments go to one shard, on average: a shard sorts at most some four times as many.
SHARE = 2 << 20
#: Entries of a queue that are held in memory.
SPILL = 1 << 20
#: Largest number of symbols for which a level is sorted by induction.
SYMBOLS = 1 << 11
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Queue:
    """Suffixes in order of arrival; beyond ``SPILL`` they wait on disk, in a file that goes with the queue."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held, self.file = 0, None

    def put(self, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        self.parts.append(suffixes)
        self.held += len(suffixes)
        if self.held > SPILL:
            self.file = self.file or tempfile.TemporaryFile()
            for x in self.parts:
                self.file.write(np.ascontiguousarray(x, np.int32).tobytes())
            self.parts, self.held = [], 0

    def take(self) -> Iterator[np.ndarray]:
        if self.file:
            self.file.seek(0)
            while block := self.file.read(4 * SPILL):
                yield np.frombuffer(block, np.int32)
            self.file.close()
            self.file = None
        if self.parts:
            whole, self.parts, self.held = np.concatenate(self.parts), [], 0
            yield whole


def _deal(queues: list[Queue], symbols: np.ndarray, suffixes: np.ndarray) -> None:
    """Each suffix to the queue of its first symbol, in order."""
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbols)]):
        if high > low:
            queues[symbols[low]].put(suffixes[low:high])


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, n_symbols: int) -> np.ndarray:
    """Order of all suffixes from the order of the leftmost S-suffixes (or of those by their first symbol only)."""
    seed_of = text[seeds]
    by = np.argsort(seed_of, kind="stable")
    seeds, bounds = seeds[by], np.searchsorted(seed_of[by], np.arange(n_symbols + 1))
    queues = [Queue() for _ in range(n_symbols)]
    larger: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]

    def before(block: np.ndarray, want_small: bool) -> np.ndarray:
        block = block[block > 0] - 1
        return block[small[block] == want_small]

    for c in range(n_symbols):
        wave = list(queues[c].take())
        while wave:
            for block in wave:
                larger[c].append(block)
                found = before(block, False)
                _deal(queues, text[found], found)
            wave = list(queues[c].take())
        found = before(seeds[bounds[c] : bounds[c + 1]], False)
        _deal(queues, text[found], found)
    smaller: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    for c in reversed(range(n_symbols)):
        wave = list(queues[c].take())
        while wave:
            for block in wave:
                smaller[c].append(block)
                found = before(block, True)
                _deal(queues, text[found], found)
            wave = list(queues[c].take())
        for block in reversed(larger[c]):
            found = before(block[::-1], True)
            _deal(queues, text[found], found)
    end = np.array([len(text) - 1], np.int32)
    ordered = [x for c in range(n_symbols) for x in [*larger[c], *(b[::-1] for b in reversed(smaller[c]))]]
    return np.concatenate([end, *ordered]) if ordered else end


def doubled(names: np.ndarray, cover: int) -> np.ndarray:
    """Order of the suffixes of a string of names by their first ``cover`` names at least."""
    rank, span = names.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-span] = rank[span:] + 1
        key = rank << 32 | ahead
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = fresh
        span *= 2
        if span >= cover or span >= len(rank) or fresh[-1] == len(rank) - 1:
            return order


def suffix_order(text: np.ndarray, cover: int) -> np.ndarray:
    """Order of the suffixes of ``text`` (its last symbol 0, found only there) by their first ``cover`` symbols at least."""
    n = len(text)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1]
    n_symbols = int(text.max()) + 1
    up, moves = text[1:] > text[:-1], text[1:] != text[:-1]
    after = np.where(moves, np.arange(n - 1, dtype=np.int32), np.int32(n - 2))
    after = np.minimum.accumulate(after[::-1])[::-1]  # the next place where the symbol changes
    small = np.ones(n, bool)
    small[:-1] = up[after]
    del up, moves, after
    first = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)  # leftmost S-suffixes, the end among them
    rough = induce(text, small, first, n_symbols)
    is_first = np.zeros(n, bool)
    is_first[first] = True
    sorted_first = rough[is_first[rough]]
    stop = np.full(n, n, np.int32)
    stop[first[:-1]] = first[1:] + 1
    own = K._spans(K.mix(np.arange(1, n_symbols + 1, dtype=np.uint64))[text], sorted_first, np.minimum(stop[sorted_first], n))
    del rough, is_first, stop
    name = np.zeros(n, np.int32)
    name[sorted_first] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
    names = name[first]
    if names.max() + 1 < len(names):
        within = -(-cover // 2) + 1  # a name takes two symbols further at least
        order = suffix_order(names, within) if names.max() < SYMBOLS else doubled(names, within)
        sorted_first = first[order]
    return induce(text, small, sorted_first, n_symbols)


def strings(text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their suffixes, and where in it a string of ``width`` bytes begins that differs from the one before."""
    wanted = np.full(len(text), -1, np.int32)
    wanted[starts] = np.arange(len(starts))
    order = suffix_order(text, width)
    order = order[wanted[order] >= 0]
    view = np.lib.stride_tricks.sliding_window_view(text, width)
    new = np.ones(len(order), bool)
    for low in range(1, len(order), 1 << 18):
        high = min(low + (1 << 18), len(order))
        new[low:high] = (view[order[low:high]] != view[order[low - 1 : high - 1]]).any(axis=1)
    return wanted[order], np.flatnonzero(new)


def raw(part: R.Part, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def _spans_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each span, one after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class Fragments:
    """The fragments of a chunk that may repeat, and the distinct ones among them, by least doc_id."""

    def __init__(self, found: list[R.Part], shared: np.ndarray, width: int):
        self.found = found
        rows = []
        for k, part in enumerate(found):
            on = R.member(part.key, shared)
            start, count = part.start[on], part.count[on]
            content = K.span_hashes(part.data, start, start + count + width - 1)
            rows.append((part.key[on], content, part.ids[part.row(start)], np.full(len(start), k, np.int32), start, count))
        self.key, self.content, self.doc, self.part, self.start, self.count = (np.concatenate(x) for x in zip(*rows))
        order, head = R.first_of(self.key, self.content, self.doc)
        self.own = order[head]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(np.bincount(head, minlength=len(order))) - 1

    def ask(self, shards: int, width: int) -> list[tuple[int, bytes]]:
        own = self.own
        out = []
        for s, of in R.Shards(self.key[own], 48, shards):
            mine = own[of]
            size = self.count[mine] + width - 1
            place = np.concatenate([[0], np.cumsum(size)])
            content = np.empty(place[-1], np.uint8)
            for k in np.unique(self.part[mine]):
                at = np.flatnonzero(self.part[mine] == k)
                content[_spans_of(place[at], size[at])] = self.found[k].data[_spans_of(self.start[mine[at]], size[at])]
            key = self.key[mine]
            out.append((s, R.pack(np.diff(key, prepend=np.uint64(0)), self.doc[mine], self.count[mine].astype(np.uint8), content)))
        return out


def judged(rows: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """For each asker's fragments: a bit for each of its strings that a smaller doc_id than the fragment's has too."""
    key = np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in rows])
    doc, count, data = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
    count = count.astype(np.int64)
    size = count + width - 1
    place = np.concatenate([[0], np.cumsum(size)])[:-1]
    content = K.span_hashes(data, place, place + size)
    order, head = R.first_of(key, content, doc)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.bincount(head, minlength=len(order))) - 1
    lead = order[head]  # of each distinct fragment, one that has its least doc_id
    least = doc[lead]
    masks = np.where(least[group] < doc, np.uint32(0xFFFFFFFF), np.uint32(0))
    alike = np.bincount(np.unique(key[lead], return_inverse=True)[1])
    other = np.repeat(alike, alike) > 1  # distinct fragments are ordered by key
    if other.any():
        some = np.flatnonzero(other)
        pieces, windows = size[lead[some]], count[lead[some]]
        at = np.concatenate([[0], np.cumsum(pieces + 1)])
        text = np.ones(at[-1] + 1, np.uint16)  # 1 stands between fragments
        text[_spans_of(at[:-1], pieces)] = data[_spans_of(place[lead[some]], pieces)].astype(np.uint16) + 2
        text[-1] = 0
        owner = np.repeat(np.arange(len(some)), windows)
        ordered, new = strings(text, _spans_of(at[:-1], windows), width)
        first = np.empty(len(owner), np.int64)
        first[ordered] = np.repeat(np.minimum.reduceat(least[some][owner[ordered]], new), np.diff(np.concatenate([new, [len(ordered)]])))
        # An asker's fragment has its own least doc_id, so that the strings are compared with each asker's.
        slot = np.full(len(lead), -1)
        slot[some] = np.concatenate([[0], np.cumsum(windows)])[:-1]
        mine = np.flatnonzero(slot[group] >= 0)
        where = _spans_of(slot[group[mine]], count[mine])
        bit = np.arange(len(where)) - np.repeat(np.cumsum(count[mine]) - count[mine], count[mine])
        smaller = (first[where] < np.repeat(doc[mine], count[mine])).astype(np.uint32) << bit.astype(np.uint32)
        masks[mine] = np.add.reduceat(smaller, np.cumsum(count[mine]) - count[mine])
    ends = np.cumsum([len(r[1]) for r in rows])
    return np.split(masks, ends[:-1])


def _walk(docs: DataFrame, emit, schema: str, width: int, gram: int, carry: tuple[str, ...] = ()) -> DataFrame:
    assert width - gram + 1 <= 32, "the strings of a fragment are named by 32 bits"
    chunks, shards = R.chunked(docs, carry, SHARE)
    near = R.shared_anchors(chunks, shards, width, gram, raw)

    def known(table: pa.Table, replied: pa.Table) -> Fragments | None:
        found, keys, _ = R.candidates(table, width, gram, raw)
        return Fragments(found, R.shared_keys(keys, shards, replied), width) if found else None

    def ask(chunk: int, table: pa.Table, replied: pa.Table) -> pa.Table:
        own = known(table, replied)
        return R.questions(own.ask(shards, width) if own else [], chunk)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        masks = judged([R.unpack(b) for b in table.column("blob").to_pylist()], width)
        return R.replies([(c, R.pack(m)) for c, m in zip(table.column("chunk").to_pylist(), masks)], 1, key[0].as_py())

    def end(chunk: int, table: pa.Table, replied: pa.Table) -> pa.Table:
        own = known(table, replied)
        if not own:
            return emit([], [], [])
        dealt = R.Shards(own.key[own.own], 48, shards)
        masks = np.zeros(len(own.own), np.uint32)
        for shard, (m,) in R.told(replied, 1):
            masks[dealt.of(shard)] = m
        every = own.doc > own.doc[own.own][own.group]
        mask = np.where(every, np.uint32(0xFFFFFFFF), masks[own.group])
        hit = (np.repeat(mask, own.count) >> (np.arange(own.count.sum()) - np.repeat(np.cumsum(own.count) - own.count, own.count)).astype(np.uint32)) & 1
        at, number = _spans_of(own.start, own.count)[hit > 0], np.repeat(own.part, own.count)[hit > 0]
        gone = []
        for k, part in enumerate(own.found):
            marked = np.zeros(len(part.data), bool)
            marked[at[number == k]] = True
            gone.append(K.covered(marked, width, len(part.data)))
        return emit(own.found, gone, [part.data[~g] for part, g in zip(own.found, gone)])

    asked = R.by_chunk(chunks, near, ask, R.QUESTION).groupBy("shard").applyInArrow(answer, R.REPLY)
    return R.by_chunk(chunks, near.unionByName(asked), end, schema)


def _digest(found: list[R.Part], gone: list[np.ndarray], kept: list[np.ndarray]) -> pa.Table:
    columns: list[list] = [[], [], [], [], []]
    for part, g, left in zip(found, gone, kept):
        removed = K.totals(g, part.offsets)
        begins = g.copy()
        begins[1:] &= ~g[:-1]
        heads = part.offsets[:-1][np.diff(part.offsets) > 0]
        begins[heads] = g[heads]
        sizes = np.diff(part.offsets)
        at = np.concatenate([[0], np.cumsum(sizes - removed)]).tolist()
        hashes = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(at, at[1:])]
        for column, x in zip(columns, (part.ids, sizes, removed, K.totals(begins, part.offsets), hashes)):
            column.extend(x if isinstance(x, list) else x.tolist())
    ids = np.array(columns[0], np.int64)
    return pa.table([pa.array(ids, mask=ids == R.NOBODY), *(pa.array(x, pa.int64()) for x in columns[1:4]), pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: its bytes, the bytes removed, in how many runs, and the digest of the bytes kept."""
    return _walk(docs, _digest, DIGEST, width, gram)


def trim(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The documents without the repeated bytes (nor what is left of a code point cut in two), with their columns; n_chars follows."""
    carry = tuple(c for c in docs.columns if c != "text")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def emit(found: list[R.Part], gone: list[np.ndarray], kept: list[np.ndarray]) -> pa.Table:
        tables = []
        for part, g, left in zip(found, gone, kept):
            at = np.concatenate([[0], np.cumsum(np.diff(part.offsets) - K.totals(g, part.offsets))]).tolist()
            text = [left[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(at, at[1:])]
            columns = [*(part.batch.column(f"c{k}") for k in range(len(carry))), pa.array(text, pa.string())]
            tables.append(pa.table(columns, [*(f"c{k}" for k in range(len(carry))), "kept"]))
        if not tables:
            return None
        return pa.concat_tables(tables)

    schema = ", ".join([*(f"c{k} {kinds[c]}" for k, c in enumerate(carry)), "kept string"])
    found = _walk(docs, emit, schema, width, gram, carry)
    out = {c: F.col(f"c{k}").alias(c) for k, c in enumerate(carry)} | {"text": F.col("kept").alias("text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("kept").cast(kinds["n_chars"]).alias("n_chars")
    return found.select(*(out[c] for c in docs.columns))
