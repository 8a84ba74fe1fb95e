"""Commit logs as stores: a folder with a manifest and the tables of commits, opcodes and blobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from driftloom.catalog.catalog import Catalog
from driftloom.migrate import VerificationError
from driftloom.operators import commitlog as L
from driftloom.plans.build import Migration, build
from driftloom.plans.directives import Directives
from driftloom.sources.store import BLOBS, CHUNKS, Files, Store, Writer


@dataclass(frozen=True)
class Progress:
    commits: int
    commit_count: int
    blobs: int = 0


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def create(spark: SparkSession, path: str, catalog: Catalog, commits: DataFrame, opcodes: DataFrame, blobs: DataFrame | None = None, chunks: DataFrame | None = None) -> Store:
    with Writer(spark, path, catalog, "commits") as w:
        w.write("commits", commits)
        w.write("opcodes", opcodes)
        w.write("blobs", blobs if blobs is not None else spark.createDataFrame([], BLOBS))
        w.write("blob_chunks", chunks if chunks is not None else spark.createDataFrame([], CHUNKS))
    return Store.open(spark, path)


def log_of(store: Store) -> L.Log:
    return L.Log(store.read("commits", _schema(L.COMMITS)), store.read("opcodes", _schema(L.OPCODES)), store.catalog, store.blobs)


def dry_run(store: Store, script: Directives) -> dict:
    return L.dry_run_log(log_of(store), build(store.catalog, script))


def verify(source: Store, m: Migration, target: Store) -> dict:
    return L.verify_log(log_of(source), m, log_of(target))


def run(spark: SparkSession, source_path: str, script: Callable[[], Directives] | Directives, target_path: str, *, check: bool = False, on_progress: Callable[[Progress], None] | None = None) -> dict:
    """Rewrites a log to a fresh target; nothing is published if an opcode is refused, and a target
    that fails verification is removed."""
    source = Store.open(spark, source_path)
    m = build(source.catalog, script() if callable(script) else script)
    out = L.migrate_log(log_of(source), m)
    target = create(spark, target_path, m.target, out.commits, out.opcodes, out.blobs, source.chunks.join(out.blobs.select("blob_id"), "blob_id", "left_semi"))
    commits, opcodes, blobs = log_of(target).commits.count(), log_of(target).opcodes.count(), target.blobs.count()
    if on_progress:
        on_progress(Progress(commits, commits, blobs))
    if check:
        try:
            verify(source, m, target)
        except VerificationError:
            Files(spark, target_path).delete()
            raise
    return {"commits": commits, "opcodes": opcodes, "blobs": blobs}
