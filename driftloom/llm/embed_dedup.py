"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of a label are one class with a count. Each class vector u, scaled to length one, is
stored as int8 numbers q and a scale s, with the exact length e of its rounding error u - s*q. For
two vectors |u.v - s_u s_v q_u.q_v| <= e_u (1 + e_v) + e_v, so a tile product of the int8 numbers
shows which pairs cannot reach the threshold; only the others are computed again in double
precision. Products of int8 numbers are summed in floating point without rounding (partial sums
stay below 2**24).

The classes of a label are dealt over tiles of bounded size. A tile is one row; tiles meet in an
equality join on label and stripe. A tile pair gives a row for each linked vector: how many vectors
it links to, and the smallest of its local component; links are not expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import connected_components, materialise

THRESHOLD = 0.98
#: Vectors of a tile; stripes over which the tiles of a label are spread.
TILE = 1024
STRIPES = 16
#: Numbers of a dot product that are summed in float32 at once, without rounding: 127 * 127 * 1040 < 2**24.
EXACT = 1024
#: Slack of the bounds for the rounding of the bounds themselves.
SLACK = 1e-6


def usable(label: Column, vector: Column) -> Column:
    """Labelled vectors of finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scales and error lengths of the rows of x, scaled to length one."""
    big = np.abs(x).max(axis=1, keepdims=True)
    u = x / big  # keeps squares in range
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    e = np.sqrt(((u - s[:, None] * q) ** 2).sum(axis=1)) + SLACK
    return q.astype(np.int8), s, e


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the paired rows in double precision."""
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def possible(q: np.ndarray, s: np.ndarray, e: np.ndarray, q2: np.ndarray, s2: np.ndarray, e2: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold."""
    dot = np.zeros((len(q), len(q2)))
    for at in range(0, q.shape[1], EXACT):
        dot += q[:, at : at + EXACT].astype(np.float32) @ q2[:, at : at + EXACT].astype(np.float32).T
    dot *= s[:, None]
    dot *= s2
    return dot + (e[:, None] * (1 + e2) + e2 + SLACK) >= threshold


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["x"], np.float64).reshape(len(ids), -1)
    return ids, np.frombuffer(row["n"], np.int64), x, np.frombuffer(row["q"], np.int8).reshape(x.shape), np.frombuffer(row["s"], np.float64), np.frombuffer(row["e"], np.float64)


def compare(left: tuple, right: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, parent) of the vectors of a tile pair that have links in it."""
    ids, n, x, q, s, e = left
    ids2, n2, x2, q2, s2, e2 = right
    may = possible(q, s, e, q2, s2, e2, threshold)
    if same:
        may = np.triu(may, 1)
    links, links2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
    if same:
        links2 = links
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    label = np.arange(len(ids2))  # of the right side, so that a row unites each group once
    for at in range(0, len(ids), 64):
        i, j = np.nonzero(may[at : at + 64])
        i += at
        real = cosines(x[i], x2[j]) >= threshold
        i, j = i[real], j[real]
        np.add.at(links, i, n2[j])
        np.add.at(links2, j, n[i])
        for row in np.unique(i):
            js = j[i == row]
            groups, first = np.unique(label[js], return_index=True)
            mine = find(int(ids[row]))
            for k in js[first]:
                other = find(int(ids2[k]))
                low, high = min(mine, other), max(mine, other)
                parent[high] = low
                mine = low
            label[np.isin(label, groups)] = label[js[0]]
    out = np.concatenate([ids[links > 0], ids2[links2 > 0]]) if not same else ids[links > 0]
    counts = np.concatenate([links[links > 0], links2[links2 > 0]]) if not same else links[links > 0]
    return out, counts, np.array([find(int(v)) for v in out], np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (label, dim, tile) of the sorted rows (label, dim, tile, tiles, id, n, vector)."""
    held: list = []

    def pack():
        head = held[0]
        x = np.array([r["vector"] for r in held], np.float64)
        q, s, e = quantise(x)
        ids, n = (np.array([r[k] for r in held], np.int64) for k in ("id", "n"))
        return pa.RecordBatch.from_pylist([{"label": head["label"], "dim": head["dim"], "tile": head["tile"], "tiles": head["tiles"], "ids": ids.tobytes(), "n": n.tobytes(), "x": x.tobytes(), "q": q.tobytes(), "s": s.tobytes(), "e": e.tobytes()}], schema=_TILE)

    for b in batches:
        for r in b.to_pylist():
            if held and (r["label"], r["dim"], r["tile"]) != (held[0]["label"], held[0]["dim"], held[0]["tile"]):
                yield pack()
                held = []
            held.append(r)
    if held:
        yield pack()


_TILE = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("tile", pa.int32()), ("tiles", pa.int32()), *((k, pa.binary()) for k in ("ids", "n", "x", "q", "s", "e"))])
_TILE_DDL = "label string, dim int, tile int, tiles int, ids binary, n binary, x binary, q binary, s binary, e binary"


def _comparer(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}
                left = _unpack(row)
                right = _unpack({n: row[f"{n}2"] for n in ("ids", "n", "x", "q", "s", "e")})
                out, counts, parents = compare(left, right, row["tile"] == row["tile2"], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(counts), pa.array(parents)], names=["id", "links", "parent"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Only vectors of the same label (and length) are compared. Vectors that are null, empty, zero or
    hold null or non-finite numbers, and those without label, link with nothing. Each repeated row
    is a vector of its own. Rows without vec_id take part; a component without any vec_id has a null
    component_id. ``kept`` is false where either id is null. Other columns are ignored; an empty
    table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("label"), F.col("vector")))
    args = [F.col("label"), F.size("vector"), F.col("vector")]
    keyed = rows.withColumns({"k1": F.when(F.col("ok"), F.xxhash64(*args)), "k2": F.when(F.col("ok"), F.xxhash64(F.lit(0x5851F42D4C957F2D), *args))})
    classes = keyed.where("ok").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialise(classes.withColumns({"id": F.monotonically_increasing_id(), "dim": F.size("vector")}), "embedding-classes")
    tiles = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.join(tiles, ["label", "dim"]).select(
        "label", "dim", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile"), "tiles", "id", "n", "vector")
    packed = dealt.repartition("label", "dim", "tile").sortWithinPartitions("label", "dim", "tile", "id")
    packed = materialise(packed.mapInArrow(_tiles, _TILE_DDL), "embedding-tiles")
    # Each left tile has one stripe, each right tile comes once for each stripe.
    stripes = F.least("tiles", F.lit(STRIPES))
    left = packed.withColumn("stripe", F.pmod("tile", stripes))
    right = packed.withColumn("stripe", F.explode(F.sequence(F.lit(0), stripes - 1)))
    right = right.select("label", "dim", "stripe", *[F.col(c).alias(f"{c}2") for c in ("tile", "ids", "n", "x", "q", "s", "e")])
    pairs = left.join(right, ["label", "dim", "stripe"]).where("tile <= tile2").drop("label", "dim", "stripe", "tiles")
    found = materialise(pairs.mapInArrow(_comparer(threshold), "id long, links long, parent long"), "embedding-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("id", "parent"), "id", "parent")
    known = classes.select("k1", "k2", "id", "least", "n").join(counts, "id", "left").join(roots, F.col("id") == F.col("v"), "left")
    known = known.select("k1", "k2", F.coalesce("root", "id").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    low = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialise(known.join(low, "root").select("k1", "k2", "n_links", "component_id"), "embedding-components")
    linked = keyed.where("ok").select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as x from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
    and len(list_filter(embedding, lambda e: e <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
      where list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98),
r as (select vec_id as v, vec_id as w from embeddings union select r.v, p.b from r join p on r.w = p.a),
c as (select v, min(w) as component_id from r group by v),
n as (select a, count(*) as n_links from p group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on e.vec_id = c.v left join n on n.a = e.vec_id
"""
