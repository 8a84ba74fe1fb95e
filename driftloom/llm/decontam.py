"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Texts are lower-cased (A-Z), ASCII punctuation is removed and words are split at white space.
An item of n words is looked for in all windows of n words. A window of b shingles that has similarity
t with an item of a shingles shares at least t / (1 + t) * (a + b) of them, so windows are laid at
every start from which they hold that many of the item's shingles, in whatever order; any other window is
below the threshold. Each window's 64-bit SimHash (shingles weighted by how often they occur) is looked up in a multi-index: eight
blocks of eight bits, and by the pigeonhole principle an item within ``RADIUS`` = 23 bits differs in
at most two bits in some block, so probing every block with up to two bits changed finds all items
within the radius. Each candidate is verified by the exact weighted Jaccard similarity of the
shingle multisets: sum of minima over sum of maxima, at least ``THRESHOLD``.

At similarity 0.8 a SimHash differs in 9.7 bits with a deviation of 2.9, so the radius misses one in
about a million of the least similar pairs and fewer of the others.

The items are the stated query set: they are taken in blocks of bounded size, each a pass over all
documents.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import hash128, kept_in_worker, materialise

WORDS = 5
THRESHOLD = 0.8
RADIUS = 23
#: Bytes of item texts in a block.
BLOCK_BYTES = 16 << 20
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_FILTER_BITS = 22
#: Meetings of a text's shingles with items that are counted at once.
MEETINGS = 1 << 18
#: Window starts that are compared at once.
CHUNK = 1 << 12
#: Bytes to change in a block: up to two bits of eight.
_CHANGES = [0] + [1 << i for i in range(8)] + [1 << i | 1 << j for i, j in combinations(range(8), 2)]


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(None, _PUNCTUATION).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sequences(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words from the hashes of the words."""
    n = len(h) - size + 1
    out = h[:n] * _MULTIPLIERS[0]
    for k in range(1, size):
        out += h[k : k + n] * _MULTIPLIERS[k]
    return out


def _grams(h: np.ndarray) -> np.ndarray:
    """A hash of each shingle from the hashes of its words."""
    return _sequences(h, WORDS) if len(h) >= WORDS else np.zeros(0, np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the five-word shingles, repeats included, the same in every process."""
    if len(words) < WORDS:
        return np.zeros(0, np.uint64)
    return _mix(_grams(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))))


def simhash(h: np.ndarray) -> int:
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def simhashes(h: np.ndarray, n: int) -> list[int]:
    """The SimHash of each run of n shingles, from running counts of the bits."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(h) + 1, 64), np.int64)
    np.cumsum(bits, axis=0, out=total[1:])
    return np.packbits((total[n:] - total[:-n]) * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    shared = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 0.0


class ItemIndex:
    """Items of a block, by shingle and by SimHash block."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, radius: int = RADIUS):
        if not 0 <= radius <= 23:
            raise ValueError("eight blocks with two changes cover a radius from 0 to 23")
        self.threshold, self.radius = threshold, radius
        self.ids, self.sizes, self.shingles, prints, grams = [], [], [], [], []
        self.short: dict[int, dict[tuple, list[int]]] = {}
        for item_id, text in items:
            words = normalised(text)
            if len(words) < WORDS:  # its one shingle is the whole sequence
                if words:
                    self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(item_id)
                continue
            h = shingles(words)
            self.ids.append(item_id)
            self.sizes.append(len(words))
            self.shingles.append(h)
            prints.append(simhash(h))
            grams.append(_grams(self._local(words)))
        self.prints = np.array(prints, np.uint64)
        self.blocks: list[dict[int, np.ndarray]] = []
        for b in range(8):
            value = ((self.prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            self.blocks.append({int(v): np.flatnonzero(value == v) for v in np.unique(value)})
        all_grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(all_grams, kind="stable")
        self.gram = all_grams[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)[order]
        self.grams = [np.unique(g) for g in grams]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.short_hashes = {n: np.unique([_sequences(self._local(list(w)), n)[0] for w in found]) for n, found in self.short.items()}

    @staticmethod
    def _local(words: list[bytes]) -> np.ndarray:
        """Fast word hashes that hold within a process only; they serve equality alone."""
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    def within(self, fp: int) -> np.ndarray:
        """Items whose SimHash is within the radius."""
        found = [block[v] for b, block in enumerate(self.blocks) for c in _CHANGES if (v := (fp >> 8 * b & 255) ^ c) in block]
        if not found:
            return np.zeros(0, np.int64)
        near = np.unique(np.concatenate(found))
        return near[np.bitwise_count(self.prints[near] ^ np.uint64(fp)) <= self.radius]

    def windows(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """size -> ranges (first start, end) of the windows of that size that hold enough shingles of
        an item to reach the threshold, wherever in the item they stand."""
        g = _grams(self._local(words))
        at = np.flatnonzero(self.filter[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        # How often the text meets each item's shingles, in bounded steps, however many items share one.
        total, upto, start = np.zeros(len(self.sizes), np.int64), np.cumsum(n), 0
        while start < len(at):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + MEETINGS, "right")))
            m = n[start:end]
            entry = np.repeat(low[start:end] - np.cumsum(m) + m, m) + np.arange(m.sum())
            total += np.bincount(self.item[entry], minlength=len(total))
            start = end
        sizes = np.minimum(self.sizes, len(words)) if len(total) else total
        counts = np.array([len(h) for h in self.shingles], np.int64)
        least = np.maximum(1, np.ceil(self.threshold / (1 + self.threshold) * (counts + sizes - WORDS + 1) - 1e-9).astype(np.int64))
        found: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(total >= least).tolist():
            size, few, p = int(sizes[k]), int(least[k]), at[np.isin(g[at], self.grams[k])]
            b = size - WORDS + 1
            if few > len(p):
                continue
            first, last = p[few - 1 :], p[: len(p) - few + 1]
            held = first - last < b
            for s, e in zip(np.maximum(first[held] - b + 1, 0).tolist(), np.minimum(last[held], len(words) - size).tolist(), strict=True):
                found.setdefault(size, []).append((s, e + 1))
        out: dict[int, list[tuple[int, int]]] = {}
        for size, ranges in found.items():
            merged: list[tuple[int, int]] = []
            for s, e in sorted(ranges):
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            out[size] = merged
        return out

    def matches(self, text: str | None) -> dict[int, float]:
        """item_id -> best similarity, of the items found in a text."""
        words = normalised(text)
        out: dict[int, float] = {}
        for n, items in self.short.items():
            if n <= len(words):
                for i in np.flatnonzero(np.isin(_sequences(self._local(words), n), self.short_hashes[n])).tolist():
                    out |= dict.fromkeys(items.get(tuple(words[i : i + n]), ()), 1.0)
        if len(words) < WORDS or not len(self.gram):
            return out
        near: dict[int, np.ndarray] = {}
        for size, ranges in self.windows(words).items():
            n = size - WORDS + 1
            for first, end in ranges:
                for at in range(first, end, CHUNK):
                    h = shingles(words[at : min(at + CHUNK, end) + size - 1])
                    for i, fp in enumerate(simhashes(h, n)):
                        if fp not in near:
                            near[fp] = self.within(fp)
                        for k in near[fp]:
                            s = similarity(h[i : i + n], self.shingles[k])
                            if s >= self.threshold:
                                out[self.ids[k]] = max(s, out.get(self.ids[k], 0.0))
        return out


def index_for(tag: str, items: list[tuple[int, str]], threshold: float, radius: int) -> ItemIndex:
    """The index of a block; a process keeps one."""
    return kept_in_worker(("items", tag), lambda: ItemIndex(items, threshold, radius))


def _finder(tag: str, items: list[tuple[int, str]], threshold: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_for(tag, items, threshold, radius)
        for b in batches:
            rows = [(r, item, s) for r, t in enumerate(b.column(2)) for item, s in index.matches(t.as_py()).items()]
            at = pa.array([r for r, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([i for _, i, _ in rows], pa.int64()), pa.array([s for _, _, s in rows], pa.float64())], names=["rk1", "rk2", "item_id", "similarity"])

    return run


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rk1, rk2, item_ids, similarity) for the rows of ``docs`` (doc_id, text, ...) that hold an
    item of ``items`` (item_id, text, ...): the sorted item ids and the best similarity.

    Null and empty texts match nothing, and null and empty items are nowhere. Items without item_id
    count in the similarity but have no id to list. An item under five words is one shingle, its whole
    sequence, and found wherever these words stand in a row. Repeated items and rows are no matter,
    other columns are ignored. rk1 and rk2 identify rows by doc_id and text.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # A hash bucket may exceed the mean; half of the bound is left for that.
    blocks = blocks if blocks == 1 else 2 * blocks
    rows, found = docs.select(*hash128("doc_id", "text"), "text"), None
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        block = [(r.item_id, r.text) for r in held.collect()]
        part = rows.mapInArrow(_finder(uuid.uuid4().hex, block, threshold, radius), "rk1 long, rk2 long, item_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    out = found.groupBy("rk1", "rk2").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    return materialise(out, "contamination")


def report(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_items, item_ids, similarity, contaminated) for each row of ``docs``; rows that hold
    no item have an empty list and similarity 0. A row that holds only items without item_id is
    contaminated with an empty list. An empty table gives no rows."""
    found = contamination(docs, items, threshold, radius)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hash128("doc_id", "text"))
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return rows.join(found, ["rk1", "rk2"], "left").select(
        "doc_id", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("similarity").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    found = contamination(docs, items, threshold, radius).select("rk1", "rk2")
    packed = docs.select(F.struct(*docs.columns).alias("row"), *hash128("doc_id", "text"))
    return packed.join(found, ["rk1", "rk2"], "left_anti").select("row.*")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    rows = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.withColumn("item_ids", F.concat_ws(",", F.transform("item_ids", lambda x: x.cast("string"))))
