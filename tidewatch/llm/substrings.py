"""Substring dedup over words by compacting a De Bruijn graph.

Runs of ``WIDTH`` words are edges from one run of ``WIDTH - 1`` words to the next. Only edges whose anchor two documents share are
asked about. The shard that has a node sees all edges which leave it: it says where each edge is first found (least doc_id, then
least place) and whether the node branches. Back in the chunks, consecutive edges with consecutive first places and no branch between
them compact into one path, whose source coordinates say from where it is repeated; edges are equal if 96 bits of two independent
hashes are. A word is removed if it is on an edge first found in a document with a smaller doc_id.

A null or empty text has no words. A null doc_id is smaller than all others. Rows with one doc_id are judged
each, and never against each other. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm import kernels as K, repeats as R

WIDTH, GRAM = 13, 6
PATHS = "doc_id long, start long, n_edges long, source_doc long, source_start long, branching boolean"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def words(part: R.Part, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    part.begin, part.end, first = K.words(data, offsets)
    return K.span_hashes(data, part.begin, part.end), first


def edges(found: list[R.Part], shared: np.ndarray) -> list[np.ndarray]:
    """Of each edge that may repeat: node, edge, doc_id, place in its document, number of its part, place in the part."""
    out = []
    for k, part in enumerate(found):
        on = R.member(part.key, shared)
        size = part.count[on]
        at = np.repeat(part.start[on] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size, size) + np.arange(size.sum())
        row = part.row(at)
        node, edge = K.windows(part.values, part.width - 1)[at] >> np.uint64(32), K.windows(part.values, part.width)[at]
        out.append((node.astype(np.uint32), edge, part.ids[row], (at - part.bounds[row]).astype(np.int32), np.full(len(at), k, np.int32), at))
    return [np.concatenate(x) for x in zip(*out)]


def _graph(docs: DataFrame, shards: int, width: int, gram: int):
    near = R.shared_anchors(docs, shards, width, gram, words)

    def known(table: pa.Table, replied: pa.Table):
        found, keys, _ = R.candidates(table, width, gram, words)
        node, edge, doc, place, number, at = edges(found, R.shared_keys(keys, shards, replied)) if found else [np.zeros(0, t) for t in (np.uint32, np.uint64, np.int64, np.int32, np.int32, np.int64)]
        order, head = R.first_of(node, edge, doc, place)
        return found, node, edge, doc, place, number, at, order, head

    def ask(chunk: int, table: pa.Table, replied: pa.Table) -> pa.Table:
        _, node, edge, doc, place, _, _, order, head = known(table, replied)
        own = order[head]
        return R.questions(R.spread(R.Shards(node[own], 32, shards), node[own], edge[own], doc[own], place[own]), chunk)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        rows = [R.unpack(b) for b in table.column("blob").to_pylist()]
        node, edge, doc, place = (np.concatenate(x) for x in zip(*rows))
        order, head = R.first_of(node, edge, doc, place)
        group = np.cumsum(np.bincount(head, minlength=len(order))) - 1
        first = order[head]
        leaves = np.bincount(np.cumsum(np.concatenate([[0], node[first][1:] != node[first][:-1]])))
        branches = np.repeat(leaves, leaves) > 1
        back = np.empty(len(order), np.int64)
        back[order] = group
        out, at = [], 0
        for chunk, row in zip(chunks, rows):
            own = back[at : at + len(row[0])]
            out.append((chunk, R.pack(doc[first][own], place[first][own], branches[own].view(np.uint8))))
            at += len(own)
        return R.replies(out, 1, key[0].as_py())

    replied = near.unionByName(R.by_chunk(docs, near, ask, R.QUESTION).groupBy("shard").applyInArrow(answer, R.REPLY))
    return replied, known


def _resolved(replied: pa.Table, node: np.ndarray, doc: np.ndarray, order: np.ndarray, head: np.ndarray, shards: int):
    """First document, first place and branching of every edge of the chunk."""
    own = order[head]
    dealt = R.Shards(node[own], 32, shards)
    source, place, branch = np.zeros(len(own), np.int64), np.zeros(len(own), np.int32), np.zeros(len(own), bool)
    for shard, (d, p, b) in R.told(replied, 1):
        mine = dealt.of(shard)
        source[mine], place[mine], branch[mine] = d, p, b > 0
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.bincount(head, minlength=len(order))) - 1
    return source[group], place[group], branch[group]


def _walk(docs: DataFrame, emit, schema: str, width: int, gram: int) -> DataFrame:
    chunks, shards = R.chunked(docs)
    replied, known = _graph(chunks, shards, width, gram)

    def run(chunk: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        found, node, _, doc, place, number, at, order, head = known(table, answers)
        source, source_place, branch = _resolved(answers, node, doc, order, head, shards)
        return emit(found, number, at, doc, place, source, source_place, branch, width)

    return R.by_chunk(chunks, replied, run, schema)


def _paths(found, number, at, doc, place, source, source_place, branch, width) -> pa.Table:
    on = source < doc
    number, at, doc, place, source, source_place, branch = (x[on] for x in (number, at, doc, place, source, source_place, branch))
    goes_on = (number[1:] == number[:-1]) & (at[1:] == at[:-1] + 1) & (source[1:] == source[:-1]) & (source_place[1:] == source_place[:-1] + 1) & ~branch[1:]
    head = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(at) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([head, [len(at)]]))
    return pa.table(list(map(pa.array, (_null(doc[head]), place[head].astype(np.int64), n, _null(source[head]), source_place[head].astype(np.int64), branch[head]))), ["doc_id", "start", "n_edges", "source_doc", "source_start", "branching"])


def _null(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == R.NOBODY)


def paths(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Repeated paths: where each begins in its document, its edges (words less ``width - 1``), and its source coordinates."""
    return _walk(docs, _paths, PATHS, width, gram)


def _digest(found, number, at, doc, place, source, source_place, branch, width) -> pa.Table:
    rows = []
    bounds = np.searchsorted(number, np.arange(len(found) + 1))
    for k, part in enumerate(found):
        own = slice(*bounds[k : k + 2])
        marked = np.zeros(max(len(part.values), 1), bool)
        marked[at[own][source[own] < doc[own]]] = True
        gone = K.covered(marked[: len(part.values)], width, len(part.values))
        removed = K.totals(gone, part.bounds)
        text = part.data.tobytes()
        for r, doc_id in enumerate(part.ids.tolist()):
            low, high = part.bounds[r : r + 2]
            left = np.flatnonzero(~gone[low:high]) + low
            kept = b" ".join([text[a:b] for a, b in zip(part.begin[left].tolist(), part.end[left].tolist())])
            rows.append((doc_id, int(high - low), int(removed[r]), hashlib.sha256(kept).hexdigest()))
    ids = np.array([r[0] for r in rows], np.int64)
    return pa.table([_null(ids), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: its words, the words removed, and the digest of the words kept."""
    return _walk(docs, _digest, DIGEST, width, gram)
