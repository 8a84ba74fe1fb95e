"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. Two fingerprints
that differ in at most four bits differ in at most one bit in some segment, so they share a
segment variant in which that one bit is a wildcard. Each distinct fingerprint is indexed under
its 64 variants, an equality shuffle on the variant brings candidates together, and each
candidate pair is verified. A pair that meets under several variants is taken up under the first
of them only, and a bucket gives a spanning forest of its verified links, not all its pairs; no
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import connected_components, hash128, materialise

SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Buckets up to this size compare neighbours in the sorted run, larger ones row by row.
SMALL = 24


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z (only) lower-cased; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, repeats included, in blocks; fewer words: of the whole sequence."""
    if not words:
        return
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(words) < size:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    for at in range(0, len(words) - size + 1, BLOCK):
        part = words[at : at + BLOCK + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(part) - size + 1
        yield np.fromiter(
            (digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)),
            np.uint64, n)


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes; no words: 0."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(words_of(text)):
        total += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, rk1, rk2, fp): fp holds the 64 bits as a signed long; rk1 and rk2 identify the
    row by doc_id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hash128("doc_id", "text"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, rk1 long, rk2 long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): a row for each bit, that bit being the wildcard of its segment."""
    start = "case when p < 22 then 0 when p < 43 then 22 else 43 end"
    mask = "case when p < 22 then 4194303L else 2097151L end"
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(
        F.expr(f"cast(shiftleft(cast(p as bigint), 22) | (shiftrightunsigned(fp, {start}) & ({mask}) & ~shiftleft(1L, p - {start})) as int)").alias("key"), "fp")


def first_variant(diff: np.ndarray) -> np.ndarray:
    """The first wildcard position under which two fingerprints with these differing bits meet."""
    out = np.full(diff.shape, 64, np.int64)
    for start, width in reversed(SEGMENTS):
        d = (diff >> np.uint64(start)) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(d)
        at = start + np.bitwise_count((d - np.uint64(1)) & ~d & np.uint64((1 << width) - 1)).astype(np.int64)
        out = np.where(ones == 0, start, np.where(ones == 1, at, out))
    return out


def _forest(fps: np.ndarray, p: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between these fingerprints first met under p."""
    label, a, b = np.arange(len(fps)), [], []
    for i in range(len(fps) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])  # the connected ones are done
        diff = fps[rest] ^ fps[i]
        near = np.flatnonzero(np.bitwise_count(diff) <= radius)
        near = rest[near[first_variant(diff[near]) == p]]
        groups, at = np.unique(label[near], return_index=True)
        fresh = groups != label[i]
        if fresh.any():
            a += [fps[i]] * int(fresh.sum())
            b += fps[near[at[fresh]]].tolist()
            label[np.isin(label, groups[fresh])] = label[i]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _verify_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links in runs of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    big, a, b = sizes > SMALL, [], []
    size = np.repeat(np.where(big, 1, sizes), sizes)
    keep = size > 1
    k, f = keys[keep], fps[keep]
    for step in range(1, int(min(SMALL, sizes[~big].max(initial=1)))):
        same = np.flatnonzero(k[step:] == k[:-step])
        diff = f[same] ^ f[same + step]
        near = np.bitwise_count(diff) <= radius
        near[near] = first_variant(diff[near]) == (k[same[near]] >> 22)
        a.append(f[same[near]])
        b.append(f[same[near] + step])
    for s, n in zip(starts[big], sizes[big], strict=True):
        x, y = _forest(fps[s : s + n], int(keys[s]) >> 22, radius)
        a.append(x)
        b.append(y)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            a, b = _verify_runs(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy().astype(np.int64)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
                if cut:
                    yield out(keys[:cut], fps[:cut])
                    keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield out(keys, fps)

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that keep all connections at up to ``radius``
    differing bits. The three segments cover a radius of up to five."""
    if not 0 <= radius <= 5:
        raise ValueError("three segments cover a radius from 0 to 5")
    keyed = variants(fps.select("fp").distinct())
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, rk1, rk2, fp, root, component_id) for each row of ``docs`` (doc_id, text, ...).

    ``component_id`` is the smallest doc_id reachable over links, ``root`` names the component.
    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows give
    repeated rows; rows without doc_id get the smallest doc_id of their component, null if there
    is none. Other columns are ignored; an empty table gives no rows.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct, radius))
    by_fp = distinct.join(roots, distinct.fp == roots.v, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    by_root = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    comps = materialise(by_fp.join(by_root, "root").select("fp", "root", "component_id"), "simhash-components")
    return rows.join(comps, "fp").select("doc_id", "rk1", "rk2", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the smallest
    doc_id (rows without doc_id come last; then the smallest row key). All columns are kept."""
    found = near_duplicates(docs, radius)
    keep = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "rk1", "rk2")).alias("k"))
    keep = keep.select(F.col("k.rk1").alias("_rk1"), F.col("k.rk2").alias("_rk2"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), *(h.alias(n) for h, n in zip(hash128("doc_id", "text"), ("_rk1", "_rk2"), strict=True)))
    return packed.join(keep, ["_rk1", "_rk2"], "left_semi").dropDuplicates(["_rk1", "_rk2"]).select("row.*")


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
