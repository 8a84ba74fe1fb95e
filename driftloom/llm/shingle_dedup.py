"""SimHash near-duplicates by five-word shingles: a Jaccard similarity of 0.8 or more of their sets.

The method is that of ``simhash`` with a longer fingerprint, as radius 4 of 64 bits misses most pairs of
0.8. Words are those of ``simhash`` (white space, A-Z lower-cased). Documents with the same set of
shingles are one vertex. A fingerprint has 448 bits, each the sign of a sum of random weights of the
shingles: at similarity 0.8 a pair differs in 68 bits with a deviation of 7.6, so ``RADIUS`` = 104 misses
about one pair in a million, above 0.8 fewer.

Fingerprints are cut into 32 segments of 14 bits. Two that differ in at most one bit of a segment share a
variant of it in which that one bit is a wildcard; at similarity 0.8 that holds for a segment with
probability 0.35, for none of the 32 about once in a million times (four for sets of four and five
shingles). The wildcard stands in one half of the segment, so vertices are shuffled by equality of the
other half, and a task indexes what meets under the variants. A pair equal in a whole segment is
taken up under its first variant only.

A variant gives a spanning forest of the pairs within the radius, nearest first; segments are taken in
rounds, and what is connected already is not compared again. So star contraction gives clusters that hold
all pairs that meet, and each pair of the forests is verified by the exact similarity of the two
sets. A cluster whose pairs all hold is done. In the others the texts come together, and every pair within the
radius that is still apart is verified in place and gives a row only if it connects. So no link is
lost, no pairs of a group are written out, and a large group of copies costs about one comparison a member; a
cluster of many documents that are alike just below the threshold is compared in full, in its tasks. A
large cluster is cut into tiles that meet in pairs, each pair a task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import connected_components, discard, hash128, materialise
from driftloom.llm.simhash import shingle_hashes, words_of

WORDS = 5
THRESHOLD = 0.8
RADIUS = 104
#: A fingerprint is a byte for each half of a segment, with bits in the lower seven.
SEGMENTS, HALF = 32, 7
HALVES = 2 * SEGMENTS
WORDS64 = HALVES // 8
#: Bits in which a word of a fingerprint (56 bits) differs at most, where the whole is within the radius: at
#: similarity 0.8 it differs in 8.5 with a deviation of 2.7, and about one pair in ten million in more.
FIRST = 24
#: Segments of each round; the first connects most of what is alike, so that later forests are small.
ROUNDS = ((0, 1), (1, 16), (16, 32))
#: Shingles whose weights are summed at once (the sums of 16 bits hold 257).
BLOCK = 256
#: Pairs that are compared at once; members of a variant from which on those connected are set aside first.
PAIRS, MANY = 1 << 18, 512
#: Members of a tile of those that share half a segment, and of a cluster whose texts come together;
#: tasks over which the pairs of one document are spread at most.
PART, TILE, SPREAD = 1 << 16, 512, 64
#: Rows to drop (17 bytes each) up to which they are sent to all tasks, instead of the documents being shuffled.
SENT = 500_000
_random = np.random.Generator(np.random.PCG64(0x5EED))
_XOR = _random.integers(0, 1 << 64, (HALF * WORDS64, 1), np.uint64)
_ODD = _random.integers(0, 1 << 64, (HALF * WORDS64, 1), np.uint64) | np.uint64(1)
_EVEN = np.uint64(0x00FF00FF00FF00FF)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the shingles; fewer than five words: of the whole sequence."""
    parts = list(shingle_hashes(words_of(text), WORDS))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The 64 halves (bytes) of the fingerprint of a set. A bit is 1 if the weights of the shingles, bytes of
    their mixed hashes, are above their mean in the sum."""
    low, high = np.zeros((len(_XOR), 4), np.int64), np.zeros((len(_XOR), 4), np.int64)
    for at in range(0, len(h), BLOCK):
        x = (h[at : at + BLOCK] ^ _XOR) * _ODD
        x ^= x >> np.uint64(32)
        low += (x & _EVEN).sum(axis=1, dtype=np.uint64).astype("<u8").view("<u2").reshape(-1, 4)
        high += ((x >> np.uint64(8)) & _EVEN).sum(axis=1, dtype=np.uint64).astype("<u8").view("<u2").reshape(-1, 4)
    bits = 2 * np.concatenate((low, high), axis=1) > 255 * len(h)
    return np.packbits(bits.reshape(HALVES, HALF), axis=1, bitorder="little").ravel()


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints (rows of 64-bit words) differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v, n, prints = [], [], []
        for t in b.column(3):
            h = shingle_set(t.as_py())
            v.append(xxhash.xxh64_intdigest(h.tobytes()))
            n.append(len(h))
            prints.append(fingerprint(h).tobytes())
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array(np.array(v, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(prints, pa.binary())],
            names=["doc_id", "rk1", "rk2", "v", "n", "fp"])


def _routes(first: int, end: int):
    """For each vertex (v, n, fp, root) a row (key, v, n, fp, root) for each half of the segments, its key the
    number and the bits of the half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = np.arange(2 * first, 2 * end)
        step = max(1, PAIRS // 8 // len(halves))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keys = halves << HALF | _words(part.column(2)).view(np.uint8)[:, halves]
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), len(halves))))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int32()), *rows.columns], names=["key", *rows.schema.names])

    return run


def _unequal(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Sets of so unequal sizes cannot reach the threshold."""
    return np.minimum(n, m) < np.maximum(n, m) * (threshold - 1e-9)


class Forest:
    """A spanning forest of pairs among members that have the given labels."""

    def __init__(self, label: np.ndarray):
        self.label, self.pairs = np.unique(label, return_inverse=True)[1], []
        self.parent = np.arange(len(label))

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x] = self.parent[self.parent[x]]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes the pairs that connect, in this order."""
        before = len(self.pairs)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = self._root(self.label[x]), self._root(self.label[y])
            if a != b:
                self.parent[b] = a
                self.pairs.append((x, y))
        if len(self.pairs) > before:
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]
            self.label = self.parent[self.label]


def _take(forest: Forest, i: np.ndarray, j: np.ndarray, n: np.ndarray, words: np.ndarray, tile: np.ndarray | None, threshold: float, radius: int) -> None:
    """Those of the pairs within the radius that connect, nearest first."""
    held = (forest.label[i] != forest.label[j]) & ~_unequal(n[i], n[j], threshold)
    if tile is not None:
        held &= tile[i] != tile[j]
    i, j = i[held], j[held]
    far = distance(words[i], words[j])
    near = np.flatnonzero(far <= radius)
    if len(near):
        near = near[np.lexsort((j[near], i[near], far[near]))]
        forest.add(i[near], j[near])


def _few(forest: Forest, order: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, word: np.ndarray, *rest) -> None:
    """The pairs of each member ``order[at]`` with those from ``low`` to ``high`` in the order."""
    count, start = high - low, 0
    upto = np.cumsum(count)
    while start < len(at):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        c = count[start:end]
        i = order[np.repeat(at[start:end], c)]
        j = order[np.repeat(low[start:end] - np.cumsum(c) + c, c) + np.arange(c.sum())]
        near = np.flatnonzero(np.bitwise_count(word[i] ^ word[j]) <= FIRST)
        _take(forest, i[near], j[near], *rest)
        start = end


def _many(forest: Forest, x: np.ndarray, y: np.ndarray, word: np.ndarray, *rest) -> None:
    """The pairs of a member in ``x`` and one in ``y``, where still apart."""
    x, at = x[np.argsort(forest.label[x], kind="stable")], 0
    while at < len(x):
        a = x[at : at + max(1, PAIRS // len(y))]
        at += len(a)
        b, labels = y, forest.label[a]
        if labels[0] == labels[-1]:
            b = y[forest.label[y] != labels[0]]
        i, j = np.nonzero(np.bitwise_count(word[a][:, None] ^ word[b]) <= FIRST)
        _take(forest, a[i], b[j], *rest)


def meetings(half: int, label: np.ndarray, n: np.ndarray, words: np.ndarray, tile: np.ndarray | None = None, threshold: float = THRESHOLD, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A forest of the pairs within the radius among members equal in this half of a segment that share a
    variant with the wildcard in the other half; with tiles, pairs of two tiles only."""
    forest = Forest(label)
    value = words.view(np.uint8)[:, half ^ 1]
    word = np.ascontiguousarray(words[:, (half // 8 + 1) % WORDS64])  # one that the segment is not in
    rest = (n, words, tile, threshold, radius)
    for p in range(HALF):
        equal = p == 0 and half % 2 == 0  # also the pairs that are equal in the whole segment
        wild, one = value & ~np.uint8(1 << p), value >> p & 1
        order = np.lexsort((one, wild))
        runs = np.array(_runs(wild[order]))
        sizes = runs[:, 1] - runs[:, 0]
        zeros = sizes - np.add.reduceat(one[order], runs[:, 0], dtype=np.int64)
        at, ends = np.arange(len(order)), np.repeat(runs[:, 1], sizes)
        low = at + 1 if equal else np.where(one[order] == 0, np.repeat(runs[:, 0] + zeros, sizes), ends)
        few = np.flatnonzero((np.repeat(sizes, sizes) <= MANY) & (low < ends))
        _few(forest, order, few, low[few], ends[few], word, *rest)
        for k in np.flatnonzero(sizes > MANY).tolist():
            run = order[runs[k, 0] : runs[k, 1]]
            x, y = run[: zeros[k]], run[zeros[k] :]
            for a, b in ((x, y), (x, x), (y, y)) if equal else ((x, y),):
                if len(a) and len(b):
                    _many(forest, a, b, word, *rest)
    return forest.pairs


def candidates(n: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, threshold: float, radius: int, holds: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs (i, j) within the radius of a member on the left and a later one on the right that hold, as many
    as connect all groups that can be connected; the nearest come first."""
    out, label = [], group.copy()
    for j in np.flatnonzero(right).tolist():
        near = np.flatnonzero(left[:j] & (label[:j] != label[j]))
        if not len(near):
            continue
        far = distance(words[near], words[j])
        held = (far <= radius) & ~_unequal(n[near], n[j], threshold)
        near, far = near[held], far[held]
        for i in near[np.lexsort((near, far))].tolist():
            if label[i] != label[j] and holds(i, j):
                out.append((i, j))
                label[label == label[i]] = label[j]
                if len(near) > 8 and (label[near] == label[j]).all():
                    break
    return out


def _words(prints: pa.Array) -> np.ndarray:
    fixed = prints.cast(pa.binary(8 * WORDS64))
    return np.frombuffer(fixed.buffers()[1], np.uint64)[WORDS64 * fixed.offset :][: WORDS64 * len(fixed)].reshape(-1, WORDS64)


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    return *(t[c].to_numpy() for c in ("i", "j", "tile", "v", "n", "root")), _words(t["fp"].combine_chunks())


def _sides(ti: int, tj: int, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The members of a pair of tiles in order, those of the left tile first, and which stand on each side."""
    order = np.argsort(tile == tj, kind="stable") if ti != tj else np.arange(len(tile))
    return order, tile[order] == ti, tile[order] == tj


def _by_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows (key, i, j, ...) cut where a run of equal (key, i, j) ends."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        joint = pa.Table.from_batches([*(r.slice(r.num_rows - 1) for r in rest[-1:]), batch])
        runs = _runs(*(joint[c].to_numpy() for c in ("key", "i", "j")))
        cut = runs[-1][0] - (joint.num_rows - batch.num_rows)  # the last run may go on in the next batch
        if cut >= 0 and (rest or cut):
            if whole := [*rest, batch.slice(0, cut)]:
                yield pa.Table.from_batches(whole).combine_chunks()
            rest = []
        rest.append(batch.slice(max(cut, 0)))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _pairs(threshold: float, radius: int):
    """A forest of the pairs that meet in each run of rows (key, v, n, fp, root, tile, i, j)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_run(batches):
            (ti, tj, tile, v, n, root, words), key, found = _columns(t), t["key"].to_numpy(), []
            for s, e in _runs(key, ti, tj):
                if e - s > 1:
                    found += [(s + i, s + j) for i, j in meetings(int(key[s]) >> HALF, root[s:e], n[s:e], words[s:e], tile[s:e] if ti[s] != tj[s] else None, threshold, radius)]
            at = np.array(found, np.int64).reshape(-1, 2)
            yield _edges(v[at[:, 0]], v[at[:, 1]])

    return run


def _links(threshold: float, radius: int):
    """Verified links that connect the roots in each run of rows (key, v, n, fp, root, text, tile, i, j)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_run(batches):
            (ti, tj, tile, v, n, root, words), found = _columns(t), []
            for s, e in _runs(t["key"].to_numpy(), ti, tj):
                order, left, right = _sides(ti[s], tj[s], tile[s:e])
                order, sets = s + order, {}

                def shingles(k: int) -> np.ndarray:
                    if k not in sets:
                        sets[k] = shingle_set(t["text"][int(order[k])].as_py())
                    return sets[k]

                def holds(i: int, j: int) -> bool:
                    return jaccard(shingles(i), shingles(j)) >= threshold

                group = np.unique(root[order], return_inverse=True)[1]
                found += [(order[i], order[j]) for i, j in candidates(n[order], words[order], left, right, group, threshold, radius, holds)]
            at = np.array(found, np.int64).reshape(-1, 2)
            yield _edges(v[at[:, 0]], v[at[:, 1]])

    return run


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    change = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys[0])]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, ok = [], [], []
            for x, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = shingle_set(t)
                if y is None:  # the first of a pair comes before those that are compared with it
                    own = h
                else:
                    a.append(x)
                    b.append(y)
                    ok.append(jaccard(own, h) >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ok): which of the pairs (a, b) reach the similarity, from texts (v, text). The pairs of
    one document with many are spread over several tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    firsts = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("v")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = firsts.unionByName(salted.join(texts, F.col("b") == F.col("v")).select("a", "salt", "b", "text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).select("a", "b", "text")
    return materialise(rows.mapInArrow(_verifier(threshold), "a long, b long, ok boolean"), "shingle-tested")


def _tiled(members: DataFrame, size: int) -> DataFrame:
    """The members (key, v, ...) of groups, those of the groups above ``size`` in pairs of tiles, dealt and
    sorted by key, i and j."""
    large = members.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles")).where("tiles > 1")
    large = materialise(large, "shingle-large")
    rows = members.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).drop("tiles", "other")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "v")


def _rooted(vertices: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``vertices`` (v, ...) with the root of their component; their own v where they have none."""
    if roots is None:
        return vertices.withColumn("root", F.col("v"))
    return vertices.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))


def _tree(roots: DataFrame) -> DataFrame:
    return roots.where("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))


def links(vertices: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b) of ``vertices`` (v, n, fp) within the radius, and (v, root) for the clusters that they
    make: all pairs within it that share a variant of a segment are in one cluster."""
    found, clusters = None, None
    for first, end in ROUNDS:
        members = _rooted(vertices, clusters).mapInArrow(_routes(first, end), "key int, v long, n long, fp binary, root long")
        part = materialise(_tiled(members, PART).mapInArrow(_pairs(threshold, radius), "a long, b long"), "shingle-pairs")
        found = part if found is None else found.unionByName(part)
        if not part.isEmpty():
            clusters = connected_components(part if clusters is None else part.unionByName(_tree(clusters)))
    return found.distinct(), clusters


def components(docs: DataFrame, rows: DataFrame, threshold: float, radius: int) -> DataFrame | None:
    """(v, root) for each vertex of ``rows`` that has a link; no rows without any."""
    vertices = rows.where("n > 0").groupBy("v").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min(F.struct("rk1", "rk2")).alias("rk"))
    vertices = materialise(vertices, "shingle-vertices")
    chosen, clusters = links(vertices.select("v", "n", "fp"), threshold, radius)
    if clusters is None:
        return None
    held = vertices.join(clusters, "v", "left_semi").select("v", "rk.rk1", "rk.rk2")
    texts = materialise(docs.select(*hash128("doc_id", "text"), "text").join(held, ["rk1", "rk2"]).select("v", "text").dropDuplicates(["v"]), "shingle-texts")
    tested = verified(chosen, texts, threshold)
    roots = connected_components(tested.where("ok").select("a", "b"))
    # Clusters in which a pair of the forest does not hold: whatever is still apart there.
    open_clusters = tested.where("not ok").join(clusters, F.col("a") == F.col("v")).select(F.col("root").alias("key")).distinct()
    sizes = clusters.withColumnRenamed("root", "key").join(open_clusters, "key", "left_semi").groupBy("key").agg(F.count("*").alias("size"))
    apart = clusters.withColumnRenamed("root", "key").join(sizes.where("size > 2").select("key"), "key", "left_semi")
    apart = _rooted(apart.join(vertices.select("v", "n", "fp"), "v"), roots)
    several = apart.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("key")
    apart = apart.join(several, "key", "left_semi").join(texts, "v")
    more = materialise(_tiled(apart, TILE).mapInArrow(_links(threshold, radius), "a long, b long"), "shingle-links")
    if not more.isEmpty():
        roots = connected_components(more.unionByName(_tree(roots)))
    for table in (texts, tested):
        discard(table)
    return roots


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each component of links: the one with the smallest
    doc_id (rows without doc_id come last; then the smallest row key). All columns are kept; null and
    empty texts are one group."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hash128("doc_id", "text"), "text")
    rows = materialise(rows.mapInArrow(_signed, "doc_id long, rk1 long, rk2 long, v long, n long, fp binary"), "shingle-rows")
    found = _rooted(rows.select("doc_id", "rk1", "rk2", "v"), components(docs, rows, threshold, radius))
    # Rows of a component may be many: the least one of each is found before they meet.
    best = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "rk1", "rk2")).alias("k"))
    best = materialise(best.select(F.col("k.rk1").alias("_rk1"), F.col("k.rk2").alias("_rk2")), "shingle-kept")
    counts = rows.groupBy(F.col("rk1").alias("_rk1"), F.col("rk2").alias("_rk2")).agg(F.count("*").alias("_n"))
    marked = counts.join(best.withColumn("_keep", F.lit(True)), ["_rk1", "_rk2"], "left")
    acts = materialise(marked.where("_keep is null or _n > 1").select("_rk1", "_rk2", F.col("_keep").isNotNull().alias("_again")), "shingle-acts")
    acts = F.broadcast(acts) if acts.count() <= SENT else acts
    packed = docs.select(F.struct(*docs.columns).alias("row"), *(h.alias(n) for h, n in zip(hash128("doc_id", "text"), ("_rk1", "_rk2"), strict=True)))
    met = packed.join(acts, ["_rk1", "_rk2"], "left")
    once = met.where("_again is null").select("row.*")
    return once.unionByName(met.where("_again").dropDuplicates(["_rk1", "_rk2"]).select("row.*"))
