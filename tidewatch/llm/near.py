"""Near-duplicate groups by a chosen-path similarity join over sets of word shingles.

Documents with equal sets are one class. Each class has ``COORDINATES`` minwise tokens. In each of ``TREES`` independent trees the
classes branch by one token after another: a node holds the classes that agree in all tokens of its path. A node of at most ``SMALL``
classes is compared exhaustively; a larger one branches on, and if its classes have ``ALIKE`` tokens in common, links all of them to
one pivot, so that a crowd of copies costs its size and not its square. Nodes that are still larger at depth ``DEPTH``, where the
tokens of all trees are used once, are compared exactly: their classes outside the node's largest group with all of the node, on the
full sets, in blocks. At likeness 0.8 a pair so meets in a node of depth d of some tree, and is compared there, with probability
1 - (1 - 0.8^d)^16: all but 7e-12 at depth 1, 1e-5 at depth 3, 2e-4 at depth 4 (7e-6 at likeness 0.85), however large a node is.
Candidates of small nodes and of pivots whose tokens agree far less than the likeness asked for go (five standard deviations below),
and the others are confirmed on their full sets: first each class's likeliest partner, then what still lies between two groups.

A null or empty text has an empty set and is linked with nothing. A null doc_id is smaller than all others. Rows with
one doc_id are documents each. Further columns are ignored by ``groups`` and carried by ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm import kernels as K, repeats as R
from tidewatch.plans.lineage import stage

WIDTH, PERCENT = 4, 80
TREES, COORDINATES, SMALL, DEPTH = 16, 64, 24, 4
#: Tokens that a crowd has in common, at least, when its classes are linked to a pivot.
ALIKE = 3
#: Classes, and shingles of them, in a block of a crowd that is compared exactly, on average.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Classes that have a shingle, at most, when its pairs are counted one by one.
RARE = 24
_RNG = np.random.default_rng(987654321)
_FACTORS = _RNG.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = [int(x) for x in _RNG.integers(-(2**62), 2**62, TREES)]


def sets(piece: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and the bounds of the rows."""
    data, offsets = K.flat(piece.column("text"))
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets)
    own = K.span_hashes(data, starts, ends)
    row = K.rows_of(first)
    inside = K.whole(row, width)
    hashes, rows = K.windows(own, width)[inside], row[: len(inside)][inside]
    few = np.diff(first)
    few = np.flatnonzero((few > 0) & (few < width))
    if len(few):
        short = np.array([int(K.windows(own[first[r] : first[r + 1]], int(first[r + 1] - first[r]))[0]) for r in few], np.uint64)
        hashes, rows = np.concatenate([hashes, K.mix(short + np.uint64(7))]), np.concatenate([rows, few])
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.uint16 if len(offsets) < 65_000 else np.int64), kind="stable")]
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def names(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits that name each row's set; 0 for an empty one."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(K.mix(hashes ^ np.uint64(0x1234567)), out=sums[1:])
    sizes = np.diff(bounds)
    return np.where(sizes > 0, K.mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64)), np.uint64(0)).view(np.int64)


def minwise(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minwise tokens of each row, 32 bits each; 0 for an empty set."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        for k, factor in enumerate(_FACTORS):
            mixed = hashes * factor
            mixed ^= mixed >> np.uint64(32)
            out[filled, k] = np.minimum.reduceat(((mixed * factor) >> np.uint64(32)).astype(np.uint32), bounds[filled])
    return out


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(R.NOBODY)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (the name of its set), tokens (array of int)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches):
            hashes, bounds = sets(piece, width)
            tokens = minwise(hashes, bounds).view(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, COORDINATES), pa.int32()), pa.array(tokens.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(bounds)), pa.array(names(hashes, bounds)), listed], ["doc_id", "n_shingles", "node", "tokens"])

    return narrow(docs).mapInArrow(run, "doc_id long, n_shingles long, node long, tokens array<int>")


def token(tree, level: int):
    """The token by which a tree branches at a level."""
    return F.get("tokens", ((tree + TREES * level + 7 * (TREES * level // COORDINATES)) % COORDINATES).cast("int"))


def candidates(classes: DataFrame, small: int = SMALL, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of classes that share a small node or a crowd's pivot; and the crowds that are left at the last depth (key, node)."""
    rows = classes.select("node", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "value")).select("node", "tree", F.xxhash64("tree", "value").alias("key"))
    salt = F.element_at(F.array(*map(F.lit, _SALTS)), F.col("tree") + 1)
    pairs = None
    for level in range(depth):
        crowds = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("node").bitwiseXOR(salt)).alias("pivot")).where("n > 1")
        held = stage(rows.join(crowds, "key").withColumn("pivot", F.col("pivot").bitwiseXOR(salt)))
        few, crowd = held.where(F.col("n") <= small).select("key", "node"), held.where(F.col("n") > small)
        both = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b")
        led = crowd.where("pivot != node").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
        found = both.unionByName(led) if level + 1 >= min(ALIKE, depth) else both
        pairs = found if pairs is None else pairs.unionByName(found)
        if level + 1 == depth or crowd.isEmpty():
            break
        rows = crowd.select("node", "tree", "key").join(classes.select("node", "tokens"), "node").select("node", "tree", F.xxhash64("key", token(F.col("tree"), level + 1)).alias("key"))
    return pairs.distinct(), crowd.select("key", "node")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that can reach the likeness by their sizes and by their tokens, with the share of equal tokens."""
    own = classes.select("node", "n_shingles", "tokens")
    left, right = (own.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b")
    same = F.aggregate(F.zip_with("t_a", "t_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / COORDINATES) ** 0.5
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return joined.where(sized).select("a", "b", same.alias("same")).where(F.col("same") >= int(least * COORDINATES))


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, members: the set of each wanted class (doc_id, node)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches):
            hashes, bounds = sets(piece, width)
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names(hashes, bounds)), listed], ["node", "members"])

    needed = narrow(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return needed.mapInArrow(run, "node long, members array<long>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets have the likeness."""

    left, right = (members.select(F.col("node").alias(x), F.col("members").alias(f"m_{x}")) for x in "ab")
    common = F.size(F.array_intersect("m_a", "m_b"))
    good = 100 * common >= percent * (F.size("m_a") + F.size("m_b") - common)
    return pairs.join(left, "a").join(right, "b").where(good).drop("m_a", "m_b")


def components(edges: DataFrame) -> DataFrame:
    """node, top (the least node it is connected with) of all nodes with an edge: least labels of neighbours, then labels of labels."""
    edges = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    tops = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("top")))
    while True:
        near = edges.join(tops.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("near"))
        lower = tops.join(near, "node").select("node", F.least("top", "near").alias("new"), "top")
        jumped = lower.join(lower.select(F.col("node").alias("new"), F.col("new").alias("far")), "new", "left")
        step = stage(jumped.select("node", F.least("new", "far").alias("new"), "top"))
        tops = step.select("node", F.col("new").alias("top"))
        if step.where("new != top").isEmpty():
            return tops


def joined(tops: DataFrame, edges: DataFrame) -> DataFrame:
    """``tops`` when the groups (or classes without a group) that the edges (a, b) connect become one."""
    edges = stage(edges)
    if edges.isEmpty():
        return tops
    above = components(edges)
    of_group = tops.join(above.select(F.col("node").alias("top"), F.col("top").alias("new")), "top", "left")
    fresh = above.join(tops.select("node"), "node", "left_anti")
    return stage(of_group.select("node", F.coalesce("new", "top").alias("top")).unionByName(fresh.select("node", "top")))


def overlaps(node: np.ndarray, asks: np.ndarray, sets_: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that ask, rows that are asked, and how many members each two have in common."""
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    every, one, own = np.unique(node, return_index=True, return_inverse=True)
    spots = [np.full(len(every), -1) for _ in "lr"]
    for spot, rows in zip(spots, (left, right)):
        spot[own[rows]] = np.arange(len(rows))
    bounds = sets_.offsets.to_numpy()
    sizes = np.diff(bounds)[one]
    start = np.repeat(bounds[one] - bounds[0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    members = sets_.flatten().to_numpy()[start + np.arange(sizes.sum())]
    row = np.repeat(np.arange(len(every)), sizes)
    order = np.argsort(members, kind="stable")
    members, row = members[order], row[order]
    many = np.diff(np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1], [True]]))) if len(members) else np.zeros(0, np.int64)
    name, many = np.repeat(np.arange(len(many)), many), np.repeat(many, many)
    common = np.zeros((len(left), len(right)), np.float32)

    def count(x: np.ndarray, y: np.ndarray) -> None:
        l, r = spots[0][x], spots[1][y]
        both = (l >= 0) & (r >= 0)
        np.add.at(common.reshape(-1), l[both] * len(right) + r[both], np.float32(1))

    few = many <= RARE
    n, x = name[few], row[few]
    for step in range(1, RARE):
        at = np.flatnonzero(n[step:] == n[:-step])
        count(x[at], x[at + step])
        count(x[at + step], x[at])
    _, n = np.unique(name[~few], return_inverse=True)
    x = row[~few]
    for low in range(0, int(n[-1]) + 1 if len(n) else 0, 1024):
        a, b = np.searchsorted(n, (low, low + 1024))
        held = np.zeros((len(every), 1024), np.float32)
        held[x[a:b], n[a:b] - low] = 1
        common += held[own[left]] @ held[own[right]].T
    return left, right, common


def bridges(table: pa.Table, percent: int) -> pa.Table:
    """Groups (a, b) that likenesses between classes that ask and classes that are asked connect; as few as do so."""
    node, top, asks = (table.column(c).to_numpy() for c in ("node", "top", "asks"))
    sets_ = table.column("members").combine_chunks()
    sizes = np.diff(sets_.offsets.to_numpy()).astype(np.int64)
    left, right, common = overlaps(node, asks.astype(bool), sets_)
    group, label = np.unique(top, return_inverse=True)
    edges = [np.zeros(0, np.int64)]
    for low in range(0, len(left), 256):
        mine, both = left[low : low + 256], common[low : low + 256].astype(np.int64)
        x, y = np.nonzero((100 * both >= percent * (sizes[mine][:, None] + sizes[right][None, :] - both)) & (label[mine][:, None] != label[right][None, :]))
        edges.append(np.unique(label[mine[x]] * len(group) + label[right[y]]))
    a, b = np.divmod(np.unique(np.concatenate(edges)), len(group))
    least = np.arange(len(group))
    while len(a):
        lower = least.copy()
        np.minimum.at(lower, a, least[b])
        np.minimum.at(lower, b, least[a])
        lower = lower[lower]
        if (lower == least).all():
            break
        least = lower
    moved = np.flatnonzero(least != np.arange(len(group)))
    return pa.table([pa.array(group[moved]), pa.array(group[least[moved]])], ["a", "b"])


def across(crowds: DataFrame, tops: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Groups (a, b) that the classes of a crowd connect: those outside its largest group are compared with all of it."""
    held = crowds.join(tops, "node", "left").join(classes.select("node", "n_shingles"), "node")
    held = stage(held.select("key", "node", F.coalesce("top", "node").alias("top"), "n_shingles"))
    parts = held.groupBy("key", "top").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    sums = parts.groupBy("key").agg(F.max(F.struct("n", "top", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("main.n < n")
    number = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    n, size = F.col("n"), F.col("size")
    sums = sums.select("key", F.col("main.top").alias("main"), number(n - F.col("main.n"), size - F.col("main.size")).alias("high"), number(n, size).alias("wide"))
    own = held.join(sums, "key")
    mine, each = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = own.where("top != main").select("key", "node", "top", F.lit(1).alias("asks"), mine("high").alias("i"), each("wide").alias("j"))
    right = own.select("key", "node", "top", F.lit(0).alias("asks"), each("high").alias("i"), mine("wide").alias("j"))
    dealt = left.unionByName(right).join(members, "node")
    return dealt.groupBy("key", "i", "j").applyInArrow(lambda table: bridges(table, percent), "a long, b long").distinct()


def between(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """Pairs of classes that aren't in one group yet, with their groups."""
    left, right = (tops.select(F.col("node").alias(x), F.col("top").alias(f"top_{x}")) for x in "ab")
    own = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left")
    return own.withColumns({f"top_{x}": F.coalesce(f"top_{x}", x) for x in "ab"}).where("top_a != top_b")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    seen = stage(sketches(docs, width))
    classes = stage(seen.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.min("tokens").alias("tokens")))
    found, crowds = candidates(classes, small, depth)
    pairs = stage(likely(found, classes, percent))
    crowds = stage(crowds)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowds.select("node"))
    members = stage(full_sets(docs, ends.distinct().join(classes.select("node", "doc_id"), "node"), width))
    sided = pairs.select(F.col("a").alias("node"), "a", "b", "same").unionByName(pairs.select(F.col("b").alias("node"), "a", "b", "same"))
    best = stage(sided.groupBy("node").agg(F.max(F.struct("same", "a", "b")).alias("x")).select("x.a", "x.b").distinct())
    tops = components(confirmed(best, members, percent))
    left = stage(between(pairs, tops).join(best, ["a", "b"], "left_anti"))
    tops = joined(tops, confirmed(left, members, percent).select(F.col("top_a").alias("a"), F.col("top_b").alias("b")))
    if not crowds.isEmpty():
        tops = joined(tops, across(crowds, tops, classes, members, percent))
    of_class = classes.select("node", "doc_id").join(tops, "node", "left").withColumn("top", F.coalesce("top", "node"))
    least = of_class.groupBy("top").agg(F.min("doc_id").alias("component"))
    of_class = stage(of_class.select("node", "top").join(least, "top").select("node", "component"))
    found = seen.select("doc_id", "n_shingles", "node").join(of_class, "node", "left")
    component = F.coalesce("component", "doc_id")
    return found.select(R.column("doc_id"), "n_shingles", F.when(component != R.NOBODY, component).alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def keep(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents of which one stays in each group, with all their columns; repeated rows stay once."""
    kept = groups(docs, width, percent).where("kept").select(F.coalesce("doc_id", F.lit(R.NOBODY)).alias("_kept")).distinct()
    names_ = docs.columns
    one = docs.withColumn("_kept", F.coalesce(F.col("doc_id").cast("long"), F.lit(R.NOBODY)))
    return one.join(kept, "_kept", "left_semi").select(*names_)
