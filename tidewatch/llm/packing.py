"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so all that planning needs is how many pieces have each length: at most
``capacity`` counts, whatever the size of the corpus. Long lengths are put in groups of equal cardinality and rounded up
to the longest of their group; configurations of those few sizes are optimised; the actual pieces take the places,
longest first; short pieces then go where they fit best. The plan says of each (length, rank) its sequence and offset,
and every piece looks its own up, so that packing itself is a count and a ranked pass over narrow rows.

A null or empty text is one piece that holds only the end token. Repeated rows are packed as often as they occur, a null
doc_id is kept, further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm import kernels as K

CAPACITY = 4096
END = 1
#: Words whose ids a worker remembers at most, and their longest.
REMEMBERED, LONGEST = 500_000, 64
#: Words that are encoded in one call, and in one text; bytes of texts whose words are looked up together.
LEARNED, TOGETHER, PIECE = 20_000, 100, 1 << 22
#: Rows of one length that are ranked together at most, on average.
RANKED = 100_000

#: What special tokens begin with; and in UTF-8 what the marks begin with that form a character with h, j, t, w or y, but not with H, J, T, W or Y.
LEFT = (b"<|", b"\xcc", b"\xcd\x84")
#: Lower-case letters of ASCII and Latin-1, in UTF-8: a word of them is one unit of the vocabulary, whatever its normalisation.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: The same by bytes; and the signs of ASCII, without the apostrophe and those that special tokens have.
LETTER, SECOND, SIGN = np.zeros((3, 256), bool)
LETTER[97:123] = True
SECOND[0x9F:0xC0], SECOND[0xB7] = True, False
SIGN[np.frombuffer(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~', np.uint8)] = True

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids:
    """Ids of the words of texts, as little-endian bytes a text.

    The vocabulary drops white space and ignores case, so that a word (a run without ASCII white space, ASCII letters in lower
    case) has the same ids wherever it stands. So has what follows a letter from a sign on, as no token reaches from letters to
    signs. A text in which a special token or a mark that only small letters combine with may stand is left as it is. Each word of a batch is looked up once, and new words of
    letters only, which are one unit each, are encoded together: their ids end where a token ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: True for each id that ends a word.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Word k of ``known`` has the ids from ``bounds[k]`` to ``bounds[k + 1]``."""
        self.known: dict[bytes, int] = {}
        self.ids, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def of(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self._forget()
        words, first = split([x if any(a in x for a in LEFT) else x.lower() for x in texts])
        found = words.dictionary_encode()
        distinct = found.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        self._learn([w for w in new if len(w) <= LONGEST])
        kept = len(self.known)
        long = [w for w in new if len(w) > LONGEST]
        self._learn(long)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[found.indices.to_numpy()]
        low, sizes = self.bounds[at], np.diff(self.bounds)[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(low - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        rows = (4 * ends[first]).tolist()
        if long:  # not remembered
            for w in long:
                del self.known[w]
            self.bounds = self.bounds[: kept + 1]
            self.ids = self.ids[: self.bounds[-1]].copy()
        return [ids[a:b] for a, b in zip(rows, rows[1:])]

    def _learn(self, words: list[bytes]) -> None:
        plain, other = [], []
        for w in words:
            (plain if PLAIN(w) else other).append(w)
        for low in range(0, len(plain), LEARNED):
            part = plain[low : low + LEARNED]
            ids = np.concatenate(self._encode([b" ".join(part[k : k + TOGETHER]) for k in range(0, len(part), TOGETHER)]))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self._add(part, ids, ends)
            else:
                other += part
        for low in range(0, len(other), LEARNED):
            part = other[low : low + LEARNED]
            ids = self._encode(part)
            self._add(part, np.concatenate(ids), np.cumsum([len(x) for x in ids]))

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _add(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.bounds = np.concatenate([self.bounds, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts, cut where a sign follows a letter; ``first[r]`` to ``first[r + 1]`` are the words of text r."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    letter = LETTER[data]
    letter[1:] |= SECOND[data[1:]] & (data[:-1] == 0xC3)
    starts = np.zeros(len(data), bool)
    starts[1:] = SIGN[data[1:]] & letter[:-1]
    starts[K.words(data, offsets)[0]] = True
    black = ~K.WHITE[data]
    own, at = data[black], np.flatnonzero(starts[black])
    buffers = [None, pa.py_buffer(np.append(at, len(own))), pa.py_buffer(own)]
    return pa.Array.from_buffers(pa.large_binary(), len(at), buffers), np.searchsorted(np.flatnonzero(starts), offsets)


@lru_cache(1)
def ids_at(path: str) -> Ids:
    return Ids(path)


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and the end token: all but the last have ``capacity`` ids. With ``keep_ids`` also the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_at(path)
        for part in K.pieces(batches, limit=PIECE):
            rows: list[list] = [[] for _ in range(6)]
            data, offsets = K.flat(part.column("text"))
            data, offsets = data.tobytes(), offsets.tolist()
            found = ids.of([data[a:b] for a, b in zip(offsets, offsets[1:])])
            for doc_id, own_ids in zip(part.column("doc_id").to_pylist(), found):
                made = own_ids + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(made), 4 * capacity)):
                    own = made[at : at + 4 * capacity]
                    for column, x in zip(rows, (doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own)):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES + ", ids binary" * keep_ids)


class Bins:
    """Sequences in the making: runs of equally filled ones, by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.slots: list[tuple[int, int, int, int, int]] = []  # length, rank, how many, first sequence, offset
        self.left = np.zeros(capacity + 1, np.int64)

    def put(self, length: int, rank: int, n: int, base: int, room: int) -> None:
        self.slots.append((length, rank, n, base, self.capacity - room))

    def give(self, room: int, base: int, n: int) -> None:
        if n and room:
            self.room[room].append((base, n))
            self.left[room] += n

    def open(self, n: int) -> int:
        self.n += n
        return self.n - n


def configuration(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """The largest size left and those others that fill its sequence best: how often each size occurs."""
    lead = next(k for k, n in enumerate(counts) if n)
    rest = capacity - sizes[lead]
    reach, by, items = np.zeros(rest + 1, bool), np.full(rest + 1, -1), []
    reach[0] = True
    for k in range(lead, len(sizes)):
        for _ in range(min(counts[k] - (k == lead), rest // sizes[k])):
            fresh = np.zeros(rest + 1, bool)
            fresh[sizes[k] :] = reach[: rest + 1 - sizes[k]]
            fresh &= ~reach
            if not fresh.any():
                break
            by[fresh] = len(items)
            items.append(k)
            reach |= fresh
        if reach[rest]:
            break
    used, at = [0] * len(sizes), int(np.flatnonzero(reach)[-1])
    used[lead] = 1
    while at:
        used[items[by[at]]] += 1
        at -= sizes[items[by[at]]]
    return used


def plan_with(counts: dict[int, int], groups: int, capacity: int, small: int) -> Bins:
    bins = Bins(capacity)
    large = [(x, counts[x]) for x in sorted(counts, reverse=True) if x > small]
    cardinality = max(1, -(-sum(n for _, n in large) // groups))
    members: dict[int, list[list[int]]] = {}  # rounded size: lengths, first ranks, counts
    free, top = 0, 0
    for length, n in large:
        rank = 0
        while n:
            if not free:
                free, top = cardinality, length
            take = min(n, free)
            members.setdefault(top, []).append([length, rank, take])
            rank, n, free = rank + take, n - take, free - take
    sizes = sorted(members, reverse=True)
    left = [sum(x[2] for x in members[s]) for s in sizes]
    heads = [0] * len(sizes)
    while any(left):
        used = configuration(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, used) if u)
        base, runs = bins.open(times), []
        for k, u in enumerate(used):
            for _ in range(u):
                runs.append(_next(members[sizes[k]], heads, k, times))
            left[k] -= u * times
        _fill(bins, base, times, runs)
    for length in sorted((x for x in counts if x <= small), reverse=True):
        _best_fit(bins, length, counts[length])
    return bins


def _next(items: list[list[int]], heads: list[int], k: int, n: int) -> list[tuple[int, int, int]]:
    """The next n pieces of a group, longest first, as runs of equal length."""
    found = []
    while n:
        x = items[heads[k]]
        take = min(n, x[2])
        found.append((x[0], x[1], take))
        x[1], x[2], n = x[1] + take, x[2] - take, n - take
        heads[k] += not x[2]
    return found


def _fill(bins: Bins, base: int, times: int, runs: list[list[tuple[int, int, int]]]) -> None:
    """Put the actual pieces in the places of a configuration, cut where the length at any place changes."""
    cuts = sorted({0, times} | {int(c) for run in runs for c in np.cumsum([n for _, _, n in run])})
    at = [[0, 0] for _ in runs]
    for low, high in zip(cuts, cuts[1:]):
        room, n = bins.capacity, high - low
        for run, spot in zip(runs, at):
            length, rank, size = run[spot[0]]
            bins.put(length, rank + spot[1], n, base + low, room)
            room -= length
            spot[1] += n
            if spot[1] == size:
                spot[:] = spot[0] + 1, 0
        bins.give(room, base + low, n)


def _best_fit(bins: Bins, length: int, n: int) -> None:
    """Put n pieces of a length where the least room is left, else in new sequences."""
    rank = 0
    while n:
        fits = np.flatnonzero(bins.left[length:])
        room = int(fits[0]) + length if len(fits) else bins.capacity
        each = min(room // length, n)
        if len(fits):
            base, have = bins.room[room].pop()
            bins.left[room] -= have
            many = min(have, n // each)
            bins.give(room, base + many, have - many)
        else:
            many = n // each
            base = bins.open(many)
        for k in range(each):
            bins.put(length, rank, many, base, room - k * length)
            rank += many
        n -= each * many
        bins.give(room - each * length, base, many)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, how many, first sequence, offset) in order, and the number of sequences."""
    best = min((plan_with(dict(counts), k, capacity, capacity // 8) for k in (32, 128)), key=lambda b: b.n)
    return np.array(sorted(best.slots), np.int64).reshape(-1, 5), best.n


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """Each piece's rank among those of its length, from 0; no window holds more than a share of a length."""
    shares = max(1, -(-most // RANKED))
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    before = dealt.groupBy("length", "_share").count()
    before = before.select("length", "_share", (F.sum("count").over(Window.partitionBy("length").orderBy("_share")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("_rank", own).join(before, ["length", "_share"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_share")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which are read three times: hand in a stored table."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row a length
    slots, _ = plan(counts, capacity)
    keys = slots[:, 0] << 48 | slots[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            slot = slots[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            out = batch.drop_columns(["_rank"])
            yield out.append_column("sequence_id", pa.array(slot[:, 3] + rank - slot[:, 1])).append_column("offset", pa.array(slot[:, 4]))

    columns = pieces.columns
    placed = ranked(pieces, max(counts.values(), default=0)).select(*columns, F.col("_rank").cast("long").alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return placed.mapInArrow(run, schema)
