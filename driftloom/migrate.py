"""Migrating document stores: dry run, migration, verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.catalog.catalog import Attachment, Catalog
from driftloom.catalog.types import Type
from driftloom.functions.nodes import Refused
from driftloom.operators.diagnostics import Finding, findings
from driftloom.operators.projection import Compiler, Projection
from driftloom.plans.build import Migration, build, gate_attachments, gate_documents
from driftloom.plans.directives import Directives
from driftloom.sources.store import Store, Writer


class VerificationError(AssertionError):
    """The target is not what the source and the script give; ``problems`` lists what differs."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("\n".join(problems))


@dataclass(frozen=True)
class Progress:
    attachment: str
    attachment_index: int
    attachment_count: int
    documents: int = 0
    blobs: int = 0
    bytes_copied: int = 0
    bytes_total: int = 0


@dataclass
class DryRun:
    documents: int
    dropped: int
    referenced_blobs: int
    orphans: int
    findings: list[Finding]


# --- Blobs ----------------------------------------------------------------------------------------

def blob_ids(t: Type, catalog: Catalog, c: Column, seen: tuple[str, ...] = (), kind: str = "blob_id") -> Column | None:
    """The blob ids (or ids of another ``kind``) in a value as an array; None for types that cannot hold any."""
    inner = lambda x, y: blob_ids(x, catalog, y, seen, kind)
    if t.kind == kind:
        return F.when(c.isNotNull(), F.array(c))
    if t.kind == "any":
        return F.when(c["type_id"] == kind, F.array(F.get_json_object(c["value"], "$")))
    if t.kind == "ref":
        s = catalog.struct(t.name)
        if s is None or t.name in seen:
            return None
        return _joined([blob_ids(f.type, catalog, c[f.name], (*seen, t.name), kind) for f in s.fields])
    if t.kind == "optional":
        return inner(t.args[0], c)
    if t.kind in ("vector", "set", "vec", "mat"):
        of = t.args[0] if t.kind != "mat" else Type("vector", t.args)
        return F.flatten(F.transform(c, lambda x: F.coalesce(inner(of, x), _none()))) if inner(of, F.lit(None)) is not None else None
    if t.kind == "xarray":
        of = t.args[0]
        return F.flatten(F.transform(c, lambda x: F.coalesce(inner(of, x["value"]), _none()))) if inner(of, F.lit(None)) is not None else None
    if t.kind == "map":
        return _joined([inner(Type("vector", (t.args[0],)), F.map_keys(c)), inner(Type("vector", (t.args[1],)), F.map_values(c))])
    if t.kind in ("tuple", "variant"):
        prefix = "_" if t.kind == "tuple" else "a"
        return _joined([inner(a, c[f"{prefix}{i}"]) for i, a in enumerate(t.args)])
    return None


def _none() -> Column:
    return F.array().cast("array<string>")


def _joined(parts: list[Column | None]) -> Column | None:
    held = [F.coalesce(p, _none()) for p in parts if p is not None]
    return F.concat(*held) if held else None


def referenced_blobs(catalog: Catalog, tables: list[tuple[Attachment, DataFrame]], spark: SparkSession) -> DataFrame:
    """The distinct blob ids in these tables."""
    out = spark.createDataFrame([], "blob_id string")
    for a, rows in tables:
        ids = _joined([blob_ids(f.type, catalog, F.col(f"`{f.name}`"), (a.document,)) for f in catalog.struct(a.document).fields])
        if ids is not None:
            out = out.unionByName(rows.select(F.explode(ids).alias("blob_id")))
    return out.where("blob_id is not null").distinct()


# --- The three passes -----------------------------------------------------------------------------

def compiled(m: Migration) -> list[Projection]:
    compiler = Compiler(m)
    return [compiler.projection(a) for a in m.source.attachments if a.id in m.attachments]


def projected(m: Migration, projection: Projection, source: Store) -> DataFrame:
    """The target rows of an attachment; a hook whose column is not exactly of the field's type is
    refused."""
    rows = projection.select(source.attachment(projection.source.id), source.attachment)
    expected = m.target.table_schema(projection.target)
    wrong = [f"[hook] {projection.source.id}.{w.name}: {g.dataType.simpleString()} is not {w.dataType.simpleString()}"
             for g, w in zip(rows.schema.fields, expected.fields, strict=True) if _bare(g.dataType) != _bare(w.dataType)]
    if wrong:
        raise Refused(wrong)
    return rows.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in expected.fields))


def _bare(t) -> str:
    return t.simpleString()


def dry_run(source: Store, m: Migration, max_samples: int = 5) -> DryRun:
    """Counts documents, drops, offenders and blobs without writing. Nothing is refused here."""
    found, documents, dropped, tables = [], 0, 0, []
    for p in compiled(m):
        rows = p.joined(source.attachment(p.source.id), source.attachment)
        own, n, gone = findings(p, rows, max_samples)
        found += own
        documents, dropped = documents + n - gone, dropped + gone
        columns = [F.col(p.source.key_column).alias(p.target.key_column), *(c.alias(k) for k, c in p.columns.items())]
        event = p.event()
        kept = rows if event is None else rows.where(event.isNull())
        tables.append((p.target, kept.select(*columns)))
    used = referenced_blobs(m.target, tables, source.spark)
    have = source.blobs.select("blob_id").distinct()
    return DryRun(documents, dropped, used.join(have, "blob_id", "left_semi").count(), have.join(used, "blob_id", "left_anti").count(), found)


def migrate(source: Store, m: Migration, target_path: str, on_progress: Callable[[Progress], None] | None = None) -> dict:
    """Writes the target store. A record that is refused ends the run, and nothing is published."""
    gate_documents(m)
    gate_attachments(m)
    spark, todo, total = source.spark, compiled(m), 0
    with Writer(spark, target_path, m.target, source.kind) as w:
        for i, p in enumerate(todo):
            w.write(p.target.id, projected(m, p, source))
            own = spark.read.parquet(*w.tables[p.target.id]).count() if w.tables[p.target.id] else 0
            total += own
            if on_progress:
                on_progress(Progress(p.source.id, i + 1, len(todo), total))
        written = Store(spark, target_path, m.target, source.kind, w.tables)
        used = referenced_blobs(m.target, [(p.target, written.attachment(p.target.id)) for p in todo], spark)
        # Blobs are copied on reference, each once; chunk bytes never pass through the driver.
        blobs = source.blobs.dropDuplicates(["blob_id"]).join(used, "blob_id", "left_semi")
        w.write("blobs", blobs)
        copied, size = 0, 0
        if w.tables["blobs"]:
            copied, size = spark.read.parquet(*w.tables["blobs"]).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        last = (todo[-1].source.id, len(todo), len(todo), total) if todo else None
        if on_progress and last:
            on_progress(Progress(*last, 0, 0, size))
        w.write("blob_chunks", _distinct_chunks(source.chunks).join(used, "blob_id", "left_semi"))
        if on_progress and last:
            on_progress(Progress(*last, copied, size, size))
    before = sum(source.attachment(p.source.id).count() for p in todo)
    return {"documents": total, "dropped": before - total, "blobs": copied, "bytes": size}


def _distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk once. Only chunk keys are shuffled to see whether any is there twice; the bytes are
    only if one is."""
    again = chunks.groupBy("blob_id", "chunk_no").count().where("count > 1")
    return chunks if again.isEmpty() else chunks.dropDuplicates(["blob_id", "chunk_no"])


def canonical(t: Type, catalog: Catalog, c: Column) -> Column:
    """A value in a form that compares: maps as sorted entries, sets sorted, NaN equal to itself."""
    sub = lambda x: lambda y: canonical(x, catalog, y)
    match t.kind:
        case "ref":
            s = catalog.struct(t.name)
            return c if s is None else F.when(c.isNotNull(), F.struct(*(canonical(f.type, catalog, c[f.name]).alias(f.name) for f in s.fields)))
        case "optional":
            return canonical(t.args[0], catalog, c)
        case "map":
            return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(sub(t.args[0])(e["key"]), sub(t.args[1])(e["value"]))))
        case "set":
            return F.array_sort(F.transform(c, sub(t.args[0])))
        case "vector" | "vec":
            return F.transform(c, sub(t.args[0]))
        case "mat":
            return F.transform(c, lambda col: F.transform(col, sub(t.args[0])))
        case "xarray":
            return F.transform(c, lambda x: F.struct(x["pos"], x["live"], sub(t.args[0])(x["value"])))
        case "tuple" | "variant":
            prefix, tag = ("_", []) if t.kind == "tuple" else ("a", [c["tag"]])
            return F.when(c.isNotNull(), F.struct(*tag, *(sub(a)(c[f"{prefix}{i}"]).alias(f"v{i}") for i, a in enumerate(t.args))))
    return c


def differences(expected: DataFrame, found: DataFrame, a: Attachment, catalog: Catalog) -> DataFrame:
    """(key, problem) for every key that is missing, spurious or holds another value. The values are
    compared by a hash of their canonical form, so only keys and hashes are shuffled."""
    def hashed(rows: DataFrame) -> DataFrame:
        values = [canonical(f.type, catalog, F.col(f"`{f.name}`")) for f in catalog.struct(a.document).fields]
        text = F.to_json(F.struct(*(v.alias(f"c{i}") for i, v in enumerate(values)))) if values else F.lit("")
        return rows.select(F.col(a.key_column).cast("string").alias("key"), F.sha2(text.cast("binary"), 256).alias("value"))

    x, y = hashed(expected).alias("x"), hashed(found).alias("y")
    both = x.join(y, F.col("x.key").eqNullSafe(F.col("y.key")), "full_outer")
    problem = F.when(F.col("y.value").isNull(), "missing").when(F.col("x.value").isNull(), "spurious").when(F.col("x.value") != F.col("y.value"), "differs")
    return both.select(F.coalesce("x.key", "y.key").alias("key"), problem.alias("problem")).where("problem is not null")


def verify(source: Store, m: Migration, target: Store, show: int = 5) -> dict:
    """Derives the target again from the source and compares; raises VerificationError. Dropped
    records must be absent, blobs must be exactly those that are referenced."""
    problems, documents = [], 0
    if target.catalog.digest() != m.target.digest():
        problems.append("the catalog differs")
    for p in compiled(m):
        diff = differences(projected(m, p, source), target.attachment(p.target.id), p.target, m.target)
        counts = {r.problem: r.n for r in diff.groupBy("problem").agg(F.count("*").alias("n")).collect()}
        for kind, n in sorted(counts.items()):
            keys = [r.key for r in diff.where(F.col("problem") == kind).orderBy("key").limit(show).collect()]
            problems.append(f"{p.target.id}: {n} {kind}, such as {', '.join(map(str, keys))}")
        documents += target.attachment(p.target.id).count()
    used = referenced_blobs(m.target, [(p.target, target.attachment(p.target.id)) for p in compiled(m)], source.spark)
    have, there = target.blobs.select("blob_id").distinct(), source.blobs.select("blob_id").distinct()
    dangling = used.join(there, "blob_id", "left_semi").join(have, "blob_id", "left_anti").count()
    orphans = have.join(used, "blob_id", "left_anti").count()
    if dangling:
        problems.append(f"{dangling} referenced blobs are missing")
    if orphans:
        problems.append(f"{orphans} blobs are not referenced")
    if problems:
        raise VerificationError(problems)
    return {"documents": documents, "blobs": have.count()}


def run(spark: SparkSession, source_path: str, script: Callable[[], Directives] | Directives, target_path: str, *, check: bool = False, on_progress=None) -> dict:
    """Opens, builds, migrates and, if asked, verifies; a target that fails verification is removed."""
    from driftloom.sources.store import Files

    source = Store.open(spark, source_path)
    m = build(source.catalog, script() if callable(script) else script)
    out = migrate(source, m, target_path, on_progress)
    if check:
        try:
            verify(source, m, Store.open(spark, target_path))
        except VerificationError:
            Files(spark, target_path).delete()
            raise
    return out
