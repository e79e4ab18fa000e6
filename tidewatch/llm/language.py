"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled text: at most ``SAMPLE`` documents (the first by hash,
of ``SHORTEST`` to ``LONGEST`` characters, or of any length where a language has none such; a bound on the learned sample only) and ``LEARNED`` symbols. A whole text is parsed against each automaton into
longest matches, and the language that needs the fewest phrases, as bits for each symbol, wins; the first by name on a tie. A long
text is parsed in blocks of ``BLOCK`` symbols, side by side, so that a block's end ends a phrase. Symbols are the letters, in lower
case, and one for whatever stands between them.

A null text, an empty one or one without a letter is ``und`` with score 0, as is every text if nothing can be learned. Rows
without label or doc_id are not learned from. Repeated rows are judged each; further columns are ignored. Memory grows with the number
of languages (about 4 MB each), not with the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm import kernels as K

SAMPLE, SHORTEST, LONGEST, LEARNED = 40, 100, 4000, 12_000
BLOCK = 1024
#: Bytes of text parsed side by side.
PIECE = 6 << 20
#: Symbols: 0 between words, 1 for rare letters, the others for the most frequent letters of the sample.
SYMBOLS = 64
UNKNOWN = "und"


def sample(docs: DataFrame, learn: Column) -> dict[str, list[str]]:
    """Texts to learn from, by language: at most ``SAMPLE`` each; of a language with none of the length asked for, those of any length."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    fits = F.length("text").between(SHORTEST, LONGEST).alias("fits")
    mixed = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"), fits)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("fits"), "h", "id"))  # Spark cuts such a window to its first rows in each task
    picked = mixed.withColumn("place", place).where(F.col("place") <= SAMPLE).groupBy("lang", "id").agg(F.max("fits").alias("fits"))
    text = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    cut = F.when(F.col("fits"), F.col("text")).otherwise(F.substring("text", 1, LEARNED)).alias("text")
    texts: dict[str, list[str]] = {}
    others: dict[str, list[str]] = {}
    # The bound on the broadcast ids, and on what comes back, is SAMPLE for each language.
    for r in sorted(text.join(F.broadcast(picked), ["id", "lang"]).select("id", "lang", cut, "fits").distinct().collect()):
        if r["text"] and (len(r["text"]) <= LONGEST or not r["fits"]):
            (texts if r["fits"] else others).setdefault(r["lang"], []).append(r["text"])
    return others | texts


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point: 0 if it is no letter, else its lower-case form."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            lower[c] = ord(x.lower()[0])
    return lower


def automaton(text: bytes) -> np.ndarray:
    """Transitions of the suffix automaton of ``text`` (by state and symbol; -1: none); state 0 is the start."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        fresh = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = fresh
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[fresh] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[fresh] = copy
        last = fresh
    table = np.full((len(moves), SYMBOLS), -1, np.int64)
    for state, own in enumerate(moves):
        for c, to in own.items():
            table[state, c] = to
    return table


class Model:
    """Parsing tables of the languages, one after the other.

    An entry holds the next state's row twice, plus 1 if the symbol begins a phrase: no match goes on, or the parse is at its beginning (the
    last row of each language) or behind a letter the language lacks.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        coded = [[letters()[np.array([ord(c) for c in t], np.int64)] for t in texts[x]] for x in self.languages]
        found, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *(t for x in coded for t in x)]), return_counts=True)
        found, counts = found[found > 0], counts[found > 0]
        common = found[np.argsort(-counts, kind="stable")][: SYMBOLS - 2]
        self.symbols = (letters() > 0).astype(np.uint8)
        order = np.argsort(common)
        at = np.searchsorted(common[order], letters())
        hit = common[order][np.minimum(at, max(len(common) - 1, 0))] == letters() if len(common) else np.zeros(0x110000, bool)
        self.symbols[hit] = (order[at[hit]] + 2).astype(np.uint8)
        tables, self.starts, self.bits, base = [], [], [], 0
        for lang in self.languages:
            learned = b"\0".join(self.squeezed(t).tobytes() for t in texts[lang])[:LEARNED]
            table = automaton(learned)
            root = np.where(table[0] >= 0, table[0], len(table))
            dead = table < 0
            full = np.vstack([np.where(dead, root, table), root])
            flag = np.vstack([dead, np.ones((1, SYMBOLS), bool)])
            tables.append(((full + base) * SYMBOLS * 2 + flag).astype(np.int32))
            self.starts.append((base + len(table)) * SYMBOLS)
            self.bits.append(np.log2(max(2, len(learned))))
            base += len(full)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def squeezed(self, text: str) -> np.ndarray:
        codes = self.symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return codes[(codes > 0) | np.concatenate([[False], codes[:-1] > 0])] if len(codes) else codes

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of phrases of each row (of ``symbols``, by bounds) in each language."""
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[row] + nth * BLOCK
        size = np.minimum(BLOCK, bounds[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        start, size, row = start[order], size[order], row[order]
        total = np.zeros((len(self.languages), len(row)), np.int32)
        if not len(row):
            return np.zeros((len(self.languages), len(sizes)))
        longest = int(size[0])
        padded = np.concatenate([symbols, np.zeros(BLOCK, np.uint8)])
        lanes = np.empty((longest, len(row)), np.uint8)
        for low in range(0, len(row), 512):
            high = min(low + 512, len(row))
            lanes[:, low:high] = padded[start[low:high][:, None] + np.arange(longest)].T
        active = np.searchsorted(-size, -np.arange(longest), "left")
        state = np.repeat(np.array(self.starts, np.int32)[:, None], len(row), 1)
        for t in range(longest):
            n = active[t]
            step = self.table.take(state[:, :n] + lanes[t, :n])
            total[:, :n] += step & 1
            state[:, :n] = step >> 1
        out = np.zeros((len(self.languages), len(sizes)))
        for k in range(len(self.languages)):
            out[k] = np.bincount(row, total[k], len(sizes))
        return out

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1: how far the second best is behind) of each row."""
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        symbols = self.symbols[points]
        begin = np.zeros(len(symbols) + 1, bool)
        begin[chars] = True
        keep = (symbols > 0) | (np.concatenate([[False], symbols[:-1] > 0]) & ~begin[:-1])
        bounds = np.concatenate([[0], np.cumsum(keep)])[chars]
        lettered = K.totals(symbols > 0, chars) > 0
        names, score = np.full(len(offsets) - 1, UNKNOWN, object), np.zeros(len(offsets) - 1)
        if self.languages:
            cost = self.phrases(symbols[keep], bounds) * np.array(self.bits)[:, None]
            best = cost.argmin(axis=0)
            names[lettered] = np.array(self.languages, object)[best[lettered]]
            if len(self.languages) > 1:
                two = np.partition(cost, 1, axis=0)
                score[lettered] = 1 - two[0][lettered] / np.maximum(two[1][lettered], 1e-9)
            else:
                score[lettered] = 1.0
        return names.tolist(), score


@lru_cache(1)
def _model(texts: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    return Model({k: list(v) for k, v in texts})


def predict(docs: DataFrame, texts: dict[str, list[str]]) -> DataFrame:
    """Per row: doc_id, lang_pred, score. Every worker builds the automata once, of the texts."""
    frozen = tuple((k, tuple(v)) for k, v in sorted(texts.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(frozen)
        for piece in K.pieces(batches, limit=PIECE):
            names, score = model.judge(*K.flat(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
