"""Held-out passages that occur, wholly or partly, in a corpus.

Passages and documents are cut into windows of an item's size, and each window gets a 64-bit SimHash of its words. A
multi-index of the items' fingerprints, in radius + 1 blocks of bits, finds every window within the Hamming radius: two
fingerprints that differ in at most radius bits agree in a whole block. Candidates are verified by the weighted similarity
of their word shingles, and by equality of words. The smallest leak is an item of ``window`` consecutive words of a
passage; near copies of a whole passage are found by windows as long as it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.words import WORD

SCHEMA = "doc_id bigint, item_id bigint, similarity double, same_words boolean"
SHINGLE = 5
#: Windows of whole passages grow by this factor, so that a passage is at most so much longer than its windows.
STEP = 1.15


class Hashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def running_bits(words: np.ndarray) -> np.ndarray:
    """How many of the words before each place have each of the 64 bits, modulo 65,536."""
    out = np.zeros((len(words) + 1, 64), np.uint16)
    np.cumsum(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint16, out=out[1:])
    return out


def fingerprints(running: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each window of ``window`` (at most 65,535) consecutive words: the majority of each of the 64 bits."""
    if len(running) <= window:
        return np.zeros(0, np.uint64)
    return np.packbits(running[window:] - running[:-window] > window // 2, axis=1).view(np.uint64).ravel()


def _shingles(words: np.ndarray) -> np.ndarray:
    """A hash for each SHINGLE consecutive words, in their order."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class WindowIndex:
    """Windows of one size of some passages, found by fingerprints within ``radius`` bits. All it holds are arrays."""

    def __init__(self, items: list[tuple[int, np.ndarray, list[int]]], window: int, radius: int):
        """``items`` are (item_id, words, places of its windows)."""
        self.window, self.radius = window, radius
        self.flat = np.concatenate([w for _, w, _ in items])
        base = np.cumsum([0, *[len(w) for _, w, _ in items]])
        self.at = np.concatenate([b + np.array(places, np.int64) for b, (_, _, places) in zip(base, items)])
        self.owner = np.repeat([i for i, _, _ in items], [len(p) for _, _, p in items]).astype(np.int64)
        self.prints = fingerprints(running_bits(self.flat), window)[self.at]
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            values = self._block(self.prints, a, b)
            order = np.argsort(values, kind="stable").astype(np.int32)
            self.blocks.append((a, b, order, values[order]))

    @staticmethod
    def _block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``prints``, row of the index) of fingerprints within the radius, each once."""
        found = []
        for a, b, order, values in self.blocks:
            wanted = self._block(prints, a, b)
            low, high = np.searchsorted(values, wanted), np.searchsorted(values, wanted, side="right")
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            place = np.repeat(hit, n)
            row = order[np.repeat(low[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(hit) else np.zeros(0, int)
            close = np.bitwise_count(prints[place] ^ self.prints[row]) <= self.radius
            found.append(place[close].astype(np.int64) * len(self.prints) + row[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def words(self, row: int) -> np.ndarray:
        return self.flat[self.at[row] : self.at[row] + self.window]


class Weights:
    """Weights of the items' shingles: those of many passages weigh less, those of none weigh 1."""

    def __init__(self, items: list[np.ndarray]):
        every = [np.unique(_shingles(w)) for w in items]
        self.keys, n = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
        self.values = 1.0 / (1.0 + np.log(n))

    def of(self, shingles: np.ndarray) -> float:
        if not len(self.keys):
            return float(len(shingles))
        at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        return float(np.where(self.keys[at] == shingles, self.values[at], 1.0).sum())

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingles of two windows."""
        x, y = np.unique(_shingles(a)), np.unique(_shingles(b))
        either = self.of(np.union1d(x, y))
        return self.of(np.intersect1d(x, y, assume_unique=True)) / either if either else 0.0


def every_window(words: list[np.ndarray], window: int) -> dict[int, list[tuple[int, list[int]]]]:
    """All windows of ``window`` words: {size: [(passage, places)]}."""
    return {window: [(i, list(range(len(w) - window + 1))) for i, w in enumerate(words) if len(w) >= window]}


def whole_windows(words: list[np.ndarray], window: int) -> dict[int, list[tuple[int, list[int]]]]:
    """Windows of the size of each passage, or up to STEP less, at its start and its end; passages under ``window`` words have none."""
    out: dict[int, list[tuple[int, list[int]]]] = {}
    for i, w in enumerate(words):
        if len(w) >= window:
            size = min(65_535, max(window, math.floor(STEP ** math.floor(math.log(len(w), STEP) + 1e-9))))
            out.setdefault(size, []).append((i, sorted({0, len(w) - size})))
    return out


def _index(items: list[tuple[int, str]], cut, window: int, radius: int) -> tuple[list[WindowIndex], Weights]:
    hashes = Hashes()
    words = [hashes.of(p) for _, p in items]
    indexes = [WindowIndex([(items[i][0], words[i], places) for i, places in rows], size, radius) for size, rows in cut(words, window).items() if rows]
    return indexes, Weights(words)


def _probe(broadcast, window: int, least: float, exact: bool, chunk: int = 60_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (indexes, weights), hashes = broadcast.value, Hashes()
        longest = max((x.window for x in indexes), default=window)

        def flush(words: list[np.ndarray], docs: list[int]) -> list[tuple]:
            flat = np.concatenate(words)
            doc = np.repeat(np.arange(len(docs)), [len(w) for w in words])
            running = running_bits(flat)
            best: dict[tuple[int, int], tuple[float, bool]] = {}
            for index in indexes:
                size = index.window
                if len(flat) < size:
                    continue
                inside = np.flatnonzero(doc[: len(flat) - size + 1] == doc[size - 1 :])
                place, row = index.near(fingerprints(running, size)[inside])
                at = inside[place]
                same = (flat[at[:, None] + np.arange(size)] == index.flat[index.at[row][:, None] + np.arange(size)]).all(1)
                for i, r, s in zip(at.tolist(), row.tolist(), same.tolist()):
                    key = (docs[doc[i]], int(index.owner[r]))
                    if key in best and (best[key][1] or exact and not s):
                        continue
                    sim = 1.0 if s else weights.similarity(flat[i : i + size], index.words(r))
                    if sim >= least:
                        best[key] = max(best.get(key, (0.0, False)), (sim, s))
            return [(d, item, sim, s) for (d, item), (sim, s) in best.items()]

        for batch in batches:
            out: list[tuple] = []
            words, docs, size = [], [], 0
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = hashes.of(text)
                if len(w) < window:
                    continue
                # A very long text is cut into stretches that overlap by the longest window less one word.
                for at in range(0, max(1, len(w) - longest + 1), chunk):
                    part = w[at : at + chunk + longest - 1]
                    words.append(part)
                    docs.append(d)
                    size += len(part)
                    if size >= chunk:
                        out += flush(words, docs)
                        words, docs, size = [], [], 0
            if words:
                out += flush(words, docs)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["doc_id", "item_id", "similarity", "same_words"])

    return run


def near_windows(documents: DataFrame, items: DataFrame, window: int = 15, radius: int = 3, least: float = 0.8, whole: bool = False, pass_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, similarity, same_words): documents with a window near one of an item's, the best of each.

    The windows are all those of ``window`` words, or with ``whole`` those of the size of each passage. The items are a
    stated query set: the index is built once, and up to ``pass_words`` words of them (some 50 bytes each) are held against
    the documents in one pass, larger sets in several, so what a task holds doesn't grow with them. Texts with fewer than
    ``window`` words, null or empty ones, reveal nothing.
    """
    spark = documents.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").where("item_id IS NOT NULL AND passage IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.size(F.split("passage", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    passes = max(1, -(-int(total) // pass_words))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = []
    for k in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        index = _index([(r.item_id, r.passage) for r in part.toLocalIterator()], whole_windows if whole else every_window, window, radius)
        found.append(docs.mapInArrow(_probe(spark.sparkContext.broadcast(index), window, least, not whole), SCHEMA))
    best = F.max(F.struct("similarity", "same_words")).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def leaked_items(documents: DataFrame, items: DataFrame, window: int = 15) -> DataFrame:
    """(doc_id, item_id, similarity), distinct: the text has ``window`` consecutive words of the item's passage."""
    return near_windows(documents, items, window).where("same_words").drop("same_words")


def near_items(documents: DataFrame, items: DataFrame, window: int = 15, radius: int = 7, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity), distinct: the text has a window of the passage's size with at least ``least`` of its weighted shingles.

    Every window within ``radius`` bits of one of the passage's is verified. One changed word in sixty flips about three bits.
    """
    return near_windows(documents, items, window, radius, least, whole=True).drop("same_words")
