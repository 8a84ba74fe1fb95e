"""Shared plumbing: durable intermediate tables, row keys and connected components.

Intermediate results are written as Parquet below the folder that the session names in
``spark.checkpoint.dir``, so they outlive any executor and cut the lineage.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set here only where the session names none, and then
    only in local mode, where driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/") + "/driftloom"
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/") + "/driftloom"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="driftloom-"))
    return shared_dir(spark)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_worker: dict[tuple, object] = {}


def kept_in_worker(key: tuple, build: Callable[[], object]) -> object:
    """An object that later tasks in this process can use again. A process keeps one only, so the
    models and indexes of one stage do not weigh on the next."""
    if key not in _worker:
        if _worker:
            _worker.clear()
            give_back()
        _worker[key] = build()
    return _worker[key]


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: the written table takes their place."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, tag: str, partition_by: tuple[str, ...] = (), level: int = 3, page: int = 1 << 20) -> DataFrame:
    """Writes a table to the shared folder and reads it back: computed once, never again,
    whatever executors are lost. ``level`` is that of the compression, ``page`` the bytes it sees at
    once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    out = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page)
    with shuffles_removed(spark):
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._driftloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table made by materialise() that nothing will read again."""
    remove(df.sparkSession, df._driftloom_path)


def clear_shared(spark: SparkSession) -> None:
    """Deletes all intermediate tables; for when no result of this subpackage is read any more."""
    remove(spark, shared_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hash128(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes of the columns with independent seeds. A null leaves the running hash
    as it is, so each column is preceded by whether it is null."""
    args = [y for c in cols for y in (F.isnull(c), c)]
    return [F.xxhash64(*args).alias("rk1"), F.xxhash64(F.lit(0x5851F42D4C957F2D), *args).alias("rk2")]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for each vertex that has an edge; root is the smallest vertex of its component.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the
    edges form stars around the smallest vertices. Self-loops and repeated edges are allowed;
    vertices are longs without nulls.
    """
    def pack(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = materialise(df, "components")
        return out, tuple(out.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    cur, mark = pack(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    while mark[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        last, before = cur, mark
        cur, mark = pack(small)
        discard(last)
        if mark == before:
            break
    return cur.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
