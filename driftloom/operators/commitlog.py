"""Commit logs: an append-only DAG of commits, each with an ordered list of opcodes.

Two tables: commits (commit_id, commit_type, label, parent_id, target_id) and opcodes (commit_id,
op_index, verb, attachment, key, path, value, position, before_position). Commit types are Mutations,
Merge, Enable and Disable; ``target_id`` is the other commit of a merge, or the one that is enabled or
disabled. Values are JSON of the type that verb and path address, paths are arrays of components
(kind, name, idx, key).

The new id of a commit is a hash of its old id and the target catalog, so ids are mapped by a
projection, without walking the graph: topology is kept by construction, and commits can be rewritten
in any order, in parallel. Opcodes have a shape (verb, attachment, kinds and names on the path): there
are as many shapes as the schema allows, whatever the length of the log. One projection dispatches by
shape, so the log is read and sorted once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from driftloom.catalog.catalog import Catalog
from driftloom.catalog.types import XARRAY_LIVE, XARRAY_POSITION, XARRAY_VALUE, Type, optional
from driftloom.functions.nodes import IDENTITY, Node, Refused, one
from driftloom.migrate import VerificationError, blob_ids
from driftloom.operators.projection import Compiler, Context
from driftloom.plans.build import Migration, gate_attachments

COMMITS = "commit_id string, commit_type string, label string, parent_id string, target_id string"
PATH = "array<struct<kind:string, name:string, idx:int, key:string>>"
OPCODES = f"commit_id string, op_index int, verb string, attachment string, key string, path {PATH}, value string, position string, before_position string"
COMMIT_TYPES = ("Mutations", "Merge", "Enable", "Disable")
#: What the value of a verb is, given the type t that its path addresses.
VERBS = {
    "Document_Set": lambda t: t, "Document_Update": lambda t: t,
    "Set_Union": lambda t: t, "Set_Subtract": lambda t: t,
    "Map_Union": lambda t: t, "Map_Update": lambda t: t, "Map_Subtract": lambda t: Type("set", t.args[:1]),
    "XArray_Insert": lambda t: t.args[0], "XArray_Update": lambda t: t.args[0], "XArray_Remove": lambda t: None,
}
#: The verbs whose values stay in the documents.
ADDING = ("Document_Set", "Document_Update", "Set_Union", "Map_Union", "Map_Update", "XArray_Insert", "XArray_Update")


@dataclass
class Log:
    commits: DataFrame
    opcodes: DataFrame
    catalog: Catalog
    blobs: DataFrame | None = None


@dataclass(frozen=True)
class Shape:
    """A verb on a path of an attachment, with the names of the path's fields."""

    verb: str
    attachment: str
    steps: tuple[tuple[str, str], ...]


def new_id(old: Column, m: Migration) -> Column:
    return F.when(old.isNotNull(), F.sha1(F.concat(old, F.lit(m.target.digest())).cast("binary")))


def _remapped(commits: DataFrame, m: Migration, known: DataFrame) -> DataFrame:
    """Commits under their new ids; ids of commits outside the log stay as they are."""
    ids = known.select(F.col("commit_id").alias("_known")).distinct()
    out = commits
    for c in ("parent_id", "target_id"):
        out = out.join(ids, F.col(c) == F.col("_known"), "left").withColumn(c, F.when(F.col("_known").isNotNull(), new_id(F.col(c), m)).otherwise(F.col(c))).drop("_known")
    return out.withColumn("commit_id", new_id(F.col("commit_id"), m)).select("commit_id", "commit_type", "label", "parent_id", "target_id")


def arity(catalog: Catalog) -> int:
    """The length of the longest tuple in a catalog: indexes below it belong to a path's shape."""
    longest = lambda t: max([len(t.args) if t.kind == "tuple" else 0, *map(longest, t.args)])
    return max((longest(f.type) for s in catalog.structs for f in s.fields), default=0)


def steps_column(indexes: int = 0) -> Column:
    """A path's shape: component kinds, with the names of fields and the indexes that may be a tuple's."""
    name = lambda p: F.when(p["kind"] == "Field", p["name"]).when((p["kind"] == "Index") & (p["idx"] < indexes), p["idx"].cast("string")).otherwise(F.lit(""))
    return F.concat_ws("/", F.transform("path", lambda p: F.concat(p["kind"], F.lit("="), name(p))))


def shapes(opcodes: DataFrame, indexes: int = 0) -> list[tuple[Shape, str]]:
    """The distinct shapes in a log; bounded by the schema, not by the log."""
    rows = opcodes.select("verb", "attachment", steps_column(indexes).alias("steps")).distinct().collect()
    out = []
    for r in rows:
        steps = tuple(tuple(s.split("=", 1)) for s in r.steps.split("/")) if r.steps else ()
        out.append((Shape(r.verb, r.attachment, steps), r.steps))
    return sorted(out, key=lambda x: (x[0].attachment, x[0].verb, x[1]))


@dataclass
class Rewrite:
    """How opcodes of a shape are rewritten: None drops them."""

    source: Type | None
    target: Type | None
    node: Node
    steps: list[str]


def translate(shape: Shape, m: Migration, compiler: Compiler) -> Rewrite | None:
    """Walks the path through the source types. Fields are renamed; a path through a dropped field
    has no target, and its opcodes go; a path below a field that is converted has none either, and
    such an opcode is refused unless the conversion is at the path's end."""
    a = m.source.attachment(shape.attachment)
    if a is None:
        raise Refused(f"[opcode] unknown attachment {shape.attachment}")
    if shape.verb not in VERBS:
        raise Refused(f"[opcode] unknown verb {shape.verb}")
    t, names, where, d, context = Type("ref", name=a.document), [], None, m.directives, Context(compiler, None)
    path = a.id
    for i, (kind, name) in enumerate(shape.steps):
        path += f".{name}" if kind == "Field" else f"[{kind}]"
        if where is not None and (where in d.field_hooks or where in d.resizes or where in d.transposes or where in d.retypes):
            raise Refused(f"[opcode] {path} goes on below a converted field")
        new = name
        if kind == "Field":
            s = m.source.struct(t.name) if t.kind == "ref" else None
            f = s and s.field(name)
            if not f:
                raise Refused(f"[opcode] {path} is no field")
            where = (s.name, name)
            if where in d.dropped_fields:
                return None
            new, t = d.field_names.get(where, name), f.type
        elif kind == "Unwrap" and t.kind in ("optional", "any"):
            t, where = (t.args[0] if t.kind == "optional" else t), None
        elif kind == "Index" and t.kind in ("vector", "vec"):
            t, where = t.args[0], None
        elif kind == "Index" and t.kind == "tuple" and name.isdigit() and int(name) < len(t.args):
            t, where = t.args[int(name)], None
        elif kind == "Key" and t.kind == "map":
            t, where = t.args[1], None
        elif kind == "Position" and t.kind == "xarray":
            t, where = t.args[0], None
        else:
            raise Refused(f"[opcode] {path}: a {t} has no {kind}")
        names.append(new)
    return _at_end(shape, t, where, names, path, m, compiler, context)


def _at_end(shape: Shape, t: Type, where, names: list[str], path: str, m: Migration, compiler: Compiler, context: Context) -> Rewrite:
    d = m.directives
    value = VERBS[shape.verb](t)
    if where in d.field_hooks or where in d.resizes or where in d.transposes:
        raise Refused(f"[opcode] {path}: a hook or resize on this field needs the whole structure")
    if value is None:
        return Rewrite(None, None, IDENTITY, names)
    if where in d.retypes:
        r = d.retypes[where]
        goal = VERBS[shape.verb](r.type) if shape.verb.startswith("Document") or r.type.kind == t.kind else None
        if goal is None:
            raise Refused(f"[opcode] {path}: {shape.verb} on a {t} that becomes a {r.type}")
        return Rewrite(value, goal, compiler.retype(value, goal, r.policy, path, context), names)
    return Rewrite(value, m.retyped(value), compiler.walk(value, path, context), names)


def fused(opcodes: DataFrame) -> DataFrame:
    """An insert at a position and the update of it that follows at once are one insert with the
    value; the update goes."""
    w = Window.partitionBy("commit_id").orderBy("op_index")
    ahead = lambda c: F.lead(c).over(w)
    behind = lambda c: F.lag(c).over(w)
    pair = (F.col("verb") == "XArray_Insert") & (ahead("verb") == "XArray_Update") & ahead("position").eqNullSafe(F.col("position")) & ahead("key").eqNullSafe(F.col("key")) & (ahead("attachment") == F.col("attachment")) & ahead("path").eqNullSafe(F.col("path"))
    second = (F.col("verb") == "XArray_Update") & (behind("verb") == "XArray_Insert") & behind("position").eqNullSafe(F.col("position")) & behind("key").eqNullSafe(F.col("key")) & (behind("attachment") == F.col("attachment")) & behind("path").eqNullSafe(F.col("path"))
    marked = opcodes.withColumns({"_next": F.when(pair, ahead("value")), "_pair": pair, "_second": second})
    return marked.where(~F.coalesce("_second", F.lit(False))).withColumn(
        "value", F.when(F.coalesce("_pair", F.lit(False)), F.col("_next")).otherwise(F.col("value"))).drop("_next", "_pair", "_second")


class _Boxed:
    """Values travel as JSON; a box lets scalars through from_json and to_json."""

    @staticmethod
    def read(c: Column, t: S.DataType) -> Column:
        return F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), S.StructType([S.StructField("v", t)]))["v"]

    @staticmethod
    def write(c: Column) -> Column:
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return F.substring(text, F.lit(6), F.length(text) - 6)  # without {"v": and }


def _renamed(names: Column) -> Column:
    """The path with the names of its fields replaced."""
    return F.transform("path", lambda p, i: F.struct(
        p["kind"].alias("kind"), F.when(p["kind"] == "Field", F.get(names, i)).otherwise(p["name"]).alias("name"), p["idx"].alias("idx"), p["key"].alias("key")))


def _is(shape: Shape, steps: str) -> Column:
    return (F.col("verb") == shape.verb) & (F.col("attachment") == shape.attachment) & (F.col("_steps") == steps)


def _by_shape(cases: dict[int, Column], other: Column | None = None) -> Column:
    out = None
    for k, c in cases.items():
        out = F.when(F.col("_shape") == k, c) if out is None else out.when(F.col("_shape") == k, c)
    if out is None:
        return other if other is not None else F.lit(None)
    return out if other is None else out.otherwise(other)


def rewrite_opcodes(log: Log, m: Migration, remap: bool = True) -> tuple[DataFrame, list, DataFrame]:
    """(target opcodes, sites, frame): sites are (policy site, count over the frame) of policies that act.
    Opcodes of dropped attachments and of dropped fields are left out."""
    compiler, dropped, indexes = Compiler(m), [a.id for a in m.source.attachments if a.id not in m.attachments], arity(m.source)
    kept = log.opcodes.where(~F.col("attachment").isin(*dropped)) if dropped else log.opcodes
    found = [(shape, steps, r) for shape, steps in shapes(kept, indexes) if (r := translate(shape, m, compiler)) is not None]
    if not found:
        return fused(kept).limit(0), [], kept.limit(0)
    shape = None
    for k, (s, steps, _) in enumerate(found):
        shape = F.when(_is(s, steps), k) if shape is None else shape.when(_is(s, steps), k)
    frame = fused(kept).withColumn("_steps", steps_column(indexes)).withColumn("_shape", shape).where("_shape is not null")
    typed, values, sites, bad, goals = {}, {}, [], {}, {}
    for k, (_, _, r) in enumerate(found):
        if r.source is None:
            continue
        goals[k] = r.target
        if r.node.identity:
            continue
        v = F.col(f"_v{k}")
        typed[f"_v{k}"] = F.when(F.col("_shape") == k, _Boxed.read(F.col("value"), m.source.spark_type(r.source if r.source.kind == "optional" else optional(r.source))))
        values[k] = F.when(F.col("value").isNotNull(), _Boxed.write(r.node.value(v)))
        sites += [(s, s.count(v)) for s in r.node.sites]
        for s in r.node.sites:
            if s.drops or s.fails:
                text = F.lit(f"[{s.op}] {s.path}: a value has no target value")
                bad[k] = F.when(s.count(v) > 0, text) if k not in bad else bad[k].when(s.count(v) > 0, text)
    frame = frame.withColumns(typed) if typed else frame
    rows = frame
    if bad:
        rows = rows.withColumn("_bad", _by_shape(bad)).where(F.when(F.col("_bad").isNull(), True).otherwise(F.raise_error(F.col("_bad")).cast("boolean")))
    names = {k: (F.array(*map(F.lit, r.steps)) if r.steps else F.array()).cast("array<string>") for k, (_, _, r) in enumerate(found)}
    attachments = {k: F.lit(m.attachments[s.attachment]) for k, (s, _, _) in enumerate(found)}
    out = rows.withColumn("_names", _by_shape(names)).select(
        "commit_id", "op_index", "verb", _by_shape(attachments).alias("attachment"), "key", _renamed(F.col("_names")).alias("path"), _by_shape(values, F.col("value")).alias("value"), "position", "before_position", "_shape")
    if remap:
        out = _remap_values(out, log, m, goals).withColumn("commit_id", new_id(F.col("commit_id"), m))
    return out.drop("_shape"), sites, frame


def _remap_values(opcodes: DataFrame, log: Log, m: Migration, goals: dict[int, Type]) -> DataFrame:
    """Commit ids inside values, found by their type: ids of the log's own commits become the new ones,
    others stay. ``goals`` are the types of the values by shape."""
    held, read = {}, {}
    for k, t in goals.items():
        v = _Boxed.read(F.col("value"), m.target.spark_type(t if t.kind == "optional" else optional(t)))
        ids = blob_ids(t, m.target, v, kind="commit_id")
        if ids is not None:
            held[k], read[k] = ids, (t, v)
    if not held:
        return opcodes
    key = ["commit_id", "op_index"]
    found = opcodes.where(F.col("_shape").isin(*held)).select(*key, F.explode(F.array_distinct(_by_shape(held))).alias("old"))
    known = found.join(log.commits.select(F.col("commit_id").alias("old")).distinct(), "old", "left_semi").groupBy(*key).agg(F.collect_set("old").alias("_old"))
    new = lambda x: F.when(F.array_contains(F.col("_old"), x), new_id(x, m)).otherwise(x)
    values = {k: _Boxed.write(_mapped(t, m.target, v, "commit_id", new)) for k, (t, v) in read.items()}
    out = opcodes.join(known, key, "left")
    return out.withColumn("value", F.when(F.col("_old").isNotNull(), _by_shape(values)).otherwise(F.col("value"))).drop("_old")


def _mapped(t: Type, catalog: Catalog, c: Column, kind: str, change: Callable[[Column], Column]) -> Column:
    """A value with each id of this kind in it changed."""
    inner = lambda x, y: _mapped(x, catalog, y, kind, change)
    if t.kind == kind:
        return F.when(c.isNotNull(), change(c))
    if t.kind == "any":
        own = F.concat(F.lit('"'), change(F.get_json_object(c["value"], "$")), F.lit('"'))
        return F.when(c.isNotNull(), F.struct(c["type_id"].alias("type_id"), F.when(c["type_id"] == kind, own).otherwise(c["value"]).alias("value")))
    if t.kind == "ref" and (s := catalog.struct(t.name)):
        return F.when(c.isNotNull(), F.struct(*(inner(f.type, c[f.name]).alias(f.name) for f in s.fields)))
    if t.kind == "optional":
        if t.args[0].kind == "optional":
            return F.when(c.isNotNull(), F.struct(c["present"].alias("present"), inner(t.args[0], c["value"]).alias("value")))
        return inner(t.args[0], c)
    if t.kind in ("vector", "set", "vec"):
        return F.transform(c, lambda x: inner(t.args[0], x))
    if t.kind == "xarray":
        return F.transform(c, lambda x: F.struct(*(x[n].alias(n) for n in (XARRAY_POSITION, XARRAY_LIVE)), inner(t.args[0], x[XARRAY_VALUE]).alias(XARRAY_VALUE)))
    if t.kind == "map":
        keys = F.transform(F.map_keys(c), lambda x: inner(t.args[0], x))
        return F.when(c.isNotNull(), F.map_from_arrays(keys, F.transform(F.map_values(c), lambda x: inner(t.args[1], x))))
    if t.kind in ("tuple", "variant"):
        prefix = "_" if t.kind == "tuple" else "a"
        parts = [inner(a, c[f"{prefix}{i}"]).alias(f"{prefix}{i}") for i, a in enumerate(t.args)]
        return F.when(c.isNotNull(), F.struct(*([c["tag"].alias("tag")] if t.kind == "variant" else []), *parts))
    return c


def migrate_log(log: Log, m: Migration) -> Log:
    """The target log. Records cannot be dropped from a log: drop-record is refused beforehand, and an
    offender of a hook or policy raises when the opcodes are written."""
    if sites := m.directives.drop_record_sites():
        raise Refused(f"[drop-record] a commit log has no records to drop, at {', '.join(sites)}")
    gate_attachments(m)
    opcodes, _, _ = rewrite_opcodes(log, m)
    blobs = None
    if log.blobs is not None:
        blobs = log.blobs.join(log_blobs(opcodes, m.target, log.commits.sparkSession, _target_shapes(log, m), arity(m.source)), "blob_id", "left_semi")
    return Log(_remapped(log.commits, m, log.commits), opcodes, m.target, blobs)


def _target_shapes(log: Log, m: Migration) -> list[tuple[Shape, str]]:
    """The shapes of the target's opcodes, from those of the source: no opcode is rewritten for it."""
    compiler, out = Compiler(m), {}
    for shape, _ in shapes(log.opcodes.where(F.col("attachment").isin(*m.attachments)), arity(m.source)):
        if r := translate(shape, m, compiler):
            steps = tuple((kind, name) for (kind, _), name in zip(shape.steps, r.steps, strict=True))
            out[Shape(shape.verb, m.attachments[shape.attachment], steps)] = "/".join("=".join(s) for s in steps)
    return list(out.items())


def addressed(shape: Shape, catalog: Catalog) -> Type:
    """The type that the path of an opcode addresses."""
    t = Type("ref", name=catalog.attachment(shape.attachment).document)
    for kind, name in shape.steps:
        if kind == "Field":
            t = catalog.struct(t.name).field(name).type
        elif t.kind != "any":
            t = t.args[1] if kind == "Key" else t.args[int(name) if t.kind == "tuple" else 0]
    return t


def log_blobs(opcodes: DataFrame, catalog: Catalog, spark: SparkSession, found: list[tuple[Shape, str]] | None = None, indexes: int | None = None) -> DataFrame:
    """Distinct blob ids in the values that opcodes add; ``found`` are the shapes of the opcodes, with
    indexes below ``indexes``."""
    indexes = arity(catalog) if indexes is None else indexes
    live, held = opcodes.withColumn("_steps", steps_column(indexes)), None
    for shape, steps in shapes(opcodes, indexes) if found is None else found:
        if shape.verb not in ADDING:
            continue
        t = VERBS[shape.verb](addressed(shape, catalog))
        ids = blob_ids(t, catalog, _Boxed.read(F.col("value"), catalog.spark_type(t if t.kind == "optional" else optional(t))))
        if ids is not None:
            held = F.when(_is(shape, steps), ids) if held is None else held.when(_is(shape, steps), ids)
    if held is None:
        return spark.createDataFrame([], "blob_id string")
    return live.select(F.explode(held).alias("blob_id")).where("blob_id is not null").distinct()


def dry_run_log(log: Log, m: Migration) -> dict:
    """Counts without writing, in one pass: commits of mutations, opcodes, offenders by site; blobs that
    the target would hold, and those of the log that no opcode of it refers to."""
    opcodes, sites, frame = rewrite_opcodes(log, m, remap=False)
    counts: dict[tuple[str, str, str], int] = {}
    if sites:
        row = frame.agg(*(F.sum(n).alias(f"n{i}") for i, (_, n) in enumerate(sites))).first()
        for (s, _), n in zip(sites, row, strict=True):
            if n:
                counts[s.path, s.op, s.policy_name] = counts.get((s.path, s.op, s.policy_name), 0) + n
    refused = sum(n for (_, _, policy), n in counts.items() if policy in ("fail", "drop-record"))
    out = {"commits": log.commits.where("commit_type = 'Mutations'").count(), "opcodes": log.opcodes.count(), "unrepresentable": refused, "diagnostics": counts}
    if log.blobs is not None:
        held = log_blobs(log.opcodes.where(F.col("attachment").isin(*m.attachments)), m.source, log.commits.sparkSession)
        have = log.blobs.select("blob_id").distinct()
        out["referenced_blobs"] = have.join(held, "blob_id", "left_semi").count()
        out["stranded_blobs"] = have.count() - out["referenced_blobs"]
    return out


def verify_log(source: Log, m: Migration, target: Log) -> dict:
    """Every commit and opcode is what the source gives, and nothing else is there: topology is the
    commit table itself, compared with the ids mapped."""
    expected, problems = migrate_log(source, m), []
    for name in ("commits", "opcodes"):
        a, b = getattr(expected, name), getattr(target, name)
        text = F.to_json(F.struct(*a.columns), {"ignoreNullFields": "false"})
        key = ["commit_id"] if name == "commits" else ["commit_id", "op_index"]
        x, y = (df.select(*key, F.sha2(text.cast("binary"), 256).alias("h")) for df in (a, b.select(*a.columns)))
        both = x.alias("x").join(y.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key], "full_outer")
        row = both.agg(F.sum(one(F.col("y.h").isNull())).alias("missing"), F.sum(one(F.col("x.h").isNull())).alias("spurious"), F.sum(one(F.col("x.h") != F.col("y.h"))).alias("differing")).first()
        problems += [f"{n} {kind} {name}" for kind, n in row.asDict().items() if n]
    if expected.blobs is not None:
        have = target.blobs.select("blob_id").distinct() if target.blobs is not None else expected.blobs.select("blob_id").limit(0)
        want = expected.blobs.select("blob_id").distinct()
        missing, extra = want.join(have, "blob_id", "left_anti").count(), have.join(want, "blob_id", "left_anti").count()
        problems += [f"{n} {kind} blobs" for kind, n in (("missing", missing), ("unreferenced", extra)) if n]
        # What the target's own opcodes say, however it came about.
        source_has = source.blobs.select("blob_id").distinct()
        own = log_blobs(target.opcodes, m.target, target.commits.sparkSession).join(source_has, "blob_id", "left_semi")
        dangling = own.join(have, "blob_id", "left_anti").count()
        problems += [f"{dangling} dangling blobs"] if dangling else []
    if problems:
        raise VerificationError(problems)
    return {"commits": target.commits.count(), "opcodes": target.opcodes.count()}


def linear_order(commits: DataFrame) -> DataFrame:
    """(commit_id, depth): the length of the longest chain of parents and merged commits above a
    commit. Each round doubles the length of the paths that are known, so a history of n commits in a
    row takes about log2(n) rounds; a round is a join on paths, of which each commit and each of the
    commits some way above it has one, the longest."""
    edges = commits.select("commit_id", F.col("parent_id").alias("above")).unionByName(
        commits.where("commit_type = 'Merge'").select("commit_id", F.col("target_id").alias("above"))).where("above is not null")
    known = commits.select(F.col("commit_id").alias("above"))
    paths = edges.join(known, "above", "left_semi").distinct().select("commit_id", "above", F.lit(1).alias("length")).checkpoint()
    depth = commits.select("commit_id", F.lit(0).alias("depth"))
    # After a round: depths of all commits whose longest chain is shorter than the round's paths are final,
    # and ``paths`` leads from each commit to those exactly 2 ** round steps up.
    while not paths.isEmpty():
        longer = paths.join(depth.select(F.col("commit_id").alias("above"), "depth"), "above").groupBy("commit_id").agg(F.max(F.col("length") + F.col("depth")).alias("more"))
        depth = depth.join(longer, "commit_id", "left").select("commit_id", F.greatest("depth", F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
        up = paths.select(F.col("commit_id").alias("above"), F.col("above").alias("top"), F.col("length").alias("up"))
        paths = paths.join(up, "above").groupBy("commit_id", F.col("top").alias("above")).agg(F.max(F.col("length") + F.col("up")).alias("length")).checkpoint()
    return depth


def state_at(log: Log, order: DataFrame, attachment: str, upto: int | None = None) -> DataFrame:
    """(key, value): the documents of an attachment up to a depth. Each field holds what was written last
    (by depth, commit id, position) to it, or to the document or structure around it; a key that no
    Document_Set writes has no document. Commits that a later Disable switches off, and no later Enable on
    again, do not count; opcodes of the container verbs do not act here. Of writes at the same depth, which are
    concurrent, those of the greatest commit id count; ids change in a migration, so to compare states give
    an ``order`` that tells such commits apart."""
    switches = log.commits.where("commit_type in ('Enable', 'Disable')").join(order, "commit_id")
    if upto is not None:
        switches, order = switches.where(F.col("depth") <= upto), order.where(F.col("depth") <= upto)
    off = switches.groupBy("target_id").agg(F.max_by("commit_type", F.struct("depth", "commit_id")).alias("last")).where("last = 'Disable'").select(F.col("target_id").alias("commit_id"))
    writes = log.opcodes.where((F.col("attachment") == attachment) & F.col("verb").isin("Document_Set", "Document_Update")).join(off, "commit_id", "left_anti").join(order, "commit_id")
    values, root = _latest(log.catalog, Type("ref", name=log.catalog.attachment(attachment).document))
    writes = writes.select("key", F.col("verb") == "Document_Set", F.struct("depth", "commit_id", "op_index").alias("_order"), steps_column().alias("_steps"), "value").toDF("key", "_set", "_order", "_steps", "value")
    writes = writes.select("key", "_set", "_order", "_steps", *(c.alias(n) for n, c in values.items()))
    return writes.groupBy("key").agg(F.max("_set").alias("_set"), root.alias("_root")).where("_set").select("key", _Boxed.write(F.col("_root")).alias("value"))


def _latest(catalog: Catalog, document: Type) -> tuple[dict[str, Column], Column]:
    """Parsed values by column name, one for each place that opcodes can write, and the aggregate that
    builds the document from the last write to each field."""
    values: dict[str, Column] = {}

    def place(names: tuple[str, ...], t: Type) -> tuple[Column, Column]:
        here, column = F.col("_steps") == "/".join(f"Field={n}" for n in names), f"_v{len(values)}"
        values[column] = F.when(here, _Boxed.read(F.col("value"), catalog.spark_type(t)))
        return here, F.col(column)

    def built(names: tuple[str, ...], t: Type, around: list[tuple[Column, Column]]) -> Column:
        around = [*around, place(names, t)]
        if s := catalog.struct(t.name) if t.kind == "ref" else None:
            return F.struct(*(built((*names, f.name), f.type, [(here, v[f.name]) for here, v in around]).alias(f.name) for f in s.fields))
        written = value = None
        for here, v in around:
            written = here if written is None else written | here
            value = F.when(here, v) if value is None else value.when(here, v)
        return F.max_by(value, F.when(written, F.col("_order")))

    root = built((), document, [])
    return values, root
