"""Byte-pair encoding that encodes chunks shared across documents once, and the way back.

A rolling hash cuts texts into chunks by their content, so that passages that documents share are cut alike. Chunks found twice
or more are gathered by their digest and encoded once; their ids go to every place they have. A document takes these
ids for its shared chunks. Where chunks join, pre-tokens may run across: the text around a join is encoded anew,
from the last boundary of the chunk before to the first of the chunk behind on which both encodings must agree whatever stands
around them, and the stretch grows until the chunk's own ids have a token's end there too (a chunk without such a place
is encoded anew as a whole). What was decoded from the ids is compared with the text; should they differ, as
two chunks of one digest would make them, the text is encoded without any shared chunk.

A boundary is certain between a visible ASCII character and a space or line feed, and between an ASCII letter and a full stop or comma: the
pre-tokenizer never takes both into one token, and no added token holds such a pair (checked when the file is read).

A null or empty text has no ids. Equal rows (doc_id and text) are encoded together and given as often as they occur, a null doc_id
is kept, further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import kernels as K
from tidewatch.plans.lineage import stage

#: Bytes the rolling hash sees, and its bits that are zero at a cut: chunks have 1 KB on average.
SEEN, BITS = 32, 10
#: Bytes of a chunk: at least (but at a text's end), at most.
LEAST, MOST = 128, 1 << 16
#: Runs of white space, and of anything else, that the quick encoder is not given.
WHITE_RUN, DARK_RUN = 200, 2000
#: Bytes of ASCII and of Latin letters, on whose classes all versions of Unicode agree.
LATIN = bytes(range(0xCA))

LONG_WHITE = re.compile(rb"\s{%d}" % WHITE_RUN)

VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
GAP, STOP = np.zeros(256, bool), np.zeros(256, bool)
GAP[[10, 32]] = True
STOP[[44, 46]] = True


def boundaries(data: np.ndarray) -> np.ndarray:
    """Certain boundaries inside a text, ascending."""
    a, b = data[:-1], data[1:]
    return np.flatnonzero((VISIBLE[a] & GAP[b]) | (LETTER[a] & STOP[b])) + 1


def cuts(data: np.ndarray) -> np.ndarray:
    """Bounds of a text's chunks, from 0 to its length; they follow from the text near them, and fall between code points."""
    n = len(data)
    if n <= SEEN:
        return np.array([0, n])
    hits = np.flatnonzero(K.windows(data, SEEN) & np.uint64((1 << BITS) - 1) == 0) + SEEN
    found = [0]
    for hit in [*hits[hits < n].tolist(), n]:
        while hit - found[-1] > MOST:
            found.append(_whole(data, found[-1] + MOST))
        hit = _whole(data, hit)
        if hit - found[-1] >= LEAST or hit == n:
            found.append(hit)
    return np.array(found)


def _whole(data: np.ndarray, at: int) -> int:
    """The start of the code point that a position falls into."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Vocabulary:
    """A byte-level tokenizer: ids of texts, and bytes of ids.

    The same vocabulary serves a quicker encoder of the same algorithm, if its merges are numbered in their order. It is given texts in
    Latin letters without added tokens; the library's own takes all others.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        splitter = told["pre_tokenizer"] or {}
        if told["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        across = (a["lstrip"] or a["rstrip"] or len(boundaries(np.frombuffer(a["content"].encode(), np.uint8))) for a in told["added_tokens"])
        if any(across):
            raise ValueError(f"{path} has an added token that reaches across a boundary")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = [b""] * size
        for token, k in told["model"]["vocab"].items():
            self.bytes_of[k] = bytes(shown[c] for c in token)
        for a in told["added_tokens"]:
            self.bytes_of[a["id"]] = a["content"].encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.written = [b"%d" % k for k in range(size)]
        #: Bytes of an id.
        self.kind = "H" if size <= 1 << 16 else "I"
        self.added = [a["content"].encode() for a in told["added_tokens"]]
        vocab, merges = told["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        numbers = [vocab[a + b] for a, b in merges]
        self.quick = None
        if numbers == sorted(set(numbers)) and not set(numbers) & {vocab[c] for c in shown if c in vocab}:
            ranks = {self.bytes_of[k]: k for k in vocab.values()}
            self.quick = tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: bytes) -> list[int]:
        """Ids of a text that is whole, or begins and ends at certain boundaries."""
        if self.quick and self.plain(text):
            return self.quick(text.decode())
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def plain(self, text: bytes) -> bool:
        if text.translate(None, LATIN) or any(a in text for a in self.added):
            return False
        return max(map(len, text.split()), default=0) < DARK_RUN and not LONG_WHITE.search(text)

    def text(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8; bytes that aren't UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").encode()


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def joined(text: bytes, bounds: np.ndarray, given: dict[int, bytes], words: Vocabulary) -> list[int]:
    """The ids of a whole text, from those of some of its chunks, with the joins repaired."""
    sure = boundaries(np.frombuffer(text, np.uint8))
    found: list[int] = []
    done = 0
    for k in sorted(given):
        low, high = int(bounds[k]), int(bounds[k + 1])
        ids = np.frombuffer(given[k], words.kind)
        ends = np.concatenate([[low], low + np.cumsum(words.lengths[ids])])
        # Boundaries of the text in the chunk, at which a token of the chunk's own encoding ends too.
        agreed = sure[np.searchsorted(sure, low) : np.searchsorted(sure, high, "right")]
        agreed = agreed[np.isin(agreed, ends)]
        if ends[-1] != high or len(agreed) < 2:
            continue
        first, last = int(agreed[0]), int(agreed[-1])
        found += words.ids(text[done:first])
        found += ids[np.searchsorted(ends, first) : np.searchsorted(ends, last)].tolist()
        done = last
    return found + words.ids(text[done:])


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, _row (a hash that tells texts of one doc_id apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_row"), text.alias("text"))


def chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bytes]]]]:
    """Row, number and bytes of each chunk of a batch's texts."""
    for part in K.pieces(batches):
        data, offsets = K.flat(part.column("text"))
        raw, found = data.tobytes(), []
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            bounds = (a + cuts(data[a:b])).tolist()
            found += [(row, k, raw[x:y]) for k, (x, y) in enumerate(zip(bounds, bounds[1:]))]
        yield part, found


def shared(texts: DataFrame, path: str) -> DataFrame:
    """chunk (its digest) and ids of each chunk found twice or more, encoded once."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in chunked(batches):
            # Equal chunks of a batch are moved once.
            own: dict[bytes, list] = {}
            for _, _, chunk in found:
                own.setdefault(hashlib.md5(chunk).digest(), [0, chunk])[0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()), pa.array([n for n, _ in own.values()], pa.int64()), pa.array([c for _, c in own.values()], pa.binary())], ["chunk", "n", "text"]
            )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            ids = [array(words.kind, words.ids(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(ids, pa.binary())], ["chunk", "ids"])

    found = texts.select("text").mapInArrow(cut, "chunk binary, n long, text binary")
    often = found.groupBy("chunk").agg(F.sum("n").alias("n"), F.first("text").alias("text")).filter("n > 1")
    return often.select("chunk", "text").mapInArrow(encode, "chunk binary, ids binary")


def places(texts: DataFrame) -> DataFrame:
    """doc_id, _row, place (number of the chunk) and chunk."""
    schema = "doc_id long, _row long, place int, chunk binary"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in chunked(batches):
            rows = pa.array([r for r, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(rows), part.column("_row").take(rows), pa.array([k for _, k, _ in found], pa.int32()),
                 pa.array([hashlib.md5(c).digest() for _, _, c in found], pa.binary())], ["doc_id", "_row", "place", "chunk"],
            )

    return texts.mapInArrow(cut, schema)


def encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, int, bytes, list[int], bytes]]:
    """doc_id, copies, text, ids and decoded text of each document, from its rows in order: copies of the text, then places with ids."""
    words, unpress = vocabulary(path), zstandard.ZstdDecompressor().decompress
    rows = (r for b in batches for low in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(low, 256).columns)))
    for (doc_id, _), own in groupby(rows, key=lambda r: r[:2]):
        copies, given, text = 0, {}, b""
        for _, _, place, found in own:
            if place < 0:
                copies, text = copies + 1, text if copies else unpress(found)
            else:
                given[place] = found
        ids = joined(text, cuts(np.frombuffer(text, np.uint8)), given, words) if given else words.ids(text)
        back = words.text(ids)
        if back != text and given:
            ids = words.ids(text)
            back = words.text(ids)
        yield doc_id, copies, text, ids, back


def pressed(texts: DataFrame) -> DataFrame:
    """The texts at place -1, compressed, as they are the larger part of what is moved."""
    names = ["doc_id", "_row", "place", "body"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for part in K.pieces(batches):
            data, offsets = K.flat(part.column("text"))
            data, offsets = data.tobytes(), offsets.tolist()
            bodies = pa.array([press(data[a:b]) for a, b in zip(offsets, offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_row"), pa.array([-1] * len(bodies), pa.int32()), bodies], names)

    return texts.mapInArrow(run, "doc_id long, _row long, place int, body binary")


def gathered(docs: DataFrame, path: str) -> DataFrame:
    """The texts, each followed by the ids of its shared chunks, in the partition of the document."""
    texts = texts_of(docs)
    given = places(texts).join(stage(shared(texts, path)), "chunk")
    rows = pressed(texts).unionByName(given.select("doc_id", "_row", "place", F.col("ids").alias("body")))
    return rows.repartition("doc_id", "_row").sortWithinPartitions("doc_id", "_row", "place")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, copies, _, ids, _ in encoded(batches, path):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * copies, pa.int64()), pa.array([ids] * copies, pa.list_(pa.int32()))], schema=schema)

    return gathered(docs, path).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of ids; null ids are none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = [words.text(x or []).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: how many ids, their digest as decimals joined by commas, and that of the text decoded from them."""
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, out = vocabulary(path).written, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))

        for doc_id, copies, _, ids, back in encoded(batches, path):
            row = doc_id, len(ids), hashlib.sha256(b",".join(map(written.__getitem__, ids))).hexdigest(), hashlib.sha256(back).hexdigest()
            out += [row] * copies
            if len(out) > 5000:
                yield batch()
                out = []
        yield batch()

    return gathered(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
