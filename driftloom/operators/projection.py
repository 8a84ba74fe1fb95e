"""Compiles a migration to one projection for each attachment.

The compiler walks the target structure and asks for each target field where it comes from, so
source columns that no target field needs are never read. What it gives are Columns: Catalyst
prunes, pushes down and generates code for them.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.catalog.catalog import Attachment, Struct
from driftloom.catalog.types import Type
from driftloom.functions import convert as C
from driftloom.functions.nodes import IDENTITY, Node, Refused, Site, guarded, one
from driftloom.plans.build import Migration, field_type, walk_types
from driftloom.plans.directives import FAIL


@dataclass(frozen=True)
class Unless:
    """What a hook gives for records that have no target value: ``value`` unless ``drop`` holds."""

    value: Column
    drop: Column


class Source(Mapping):
    """The source structure's fields as Columns, by name or attribute."""

    def __init__(self, struct: Struct, at: Callable[[str], Column]):
        self._struct, self._at = struct, at

    def __getitem__(self, name: str) -> Column:
        if not self._struct.field(name):
            raise KeyError(f"{self._struct.name} has no field {name}")
        return self._at(name)

    def __getattr__(self, name: str) -> Column:
        return self[name]

    def __iter__(self):
        return (f.name for f in self._struct.fields)

    def __len__(self) -> int:
        return len(self._struct.fields)


class Context:
    """What hooks may read beside their own structure: other attachments, by key.

    Lookups and folds become joins of the attachment's table; equal ones share a join.
    """

    def __init__(self, compiler: Compiler, attachment: Attachment | None):
        self._compiler, self.attachment = compiler, attachment
        self.joins: dict[tuple, tuple] = {}

    @property
    def has_source_view(self) -> bool:
        return self.attachment is not None

    has_self_key = has_source_view

    @property
    def self_key(self) -> Column:
        if self.attachment is None:
            raise Refused("[hook] no attachment is being migrated here")
        return F.col(self.attachment.key_column)

    def _other(self, name: str) -> Attachment:
        other = self._compiler.migration.source.attachment(name)
        if other is None or self.attachment is None:
            raise Refused(f"[hook] no attachment {name} to read")
        return other

    def lookup(self, attachment: str, key: Column, column: str, *, rewritten: bool = False) -> Column:
        """The value of a column of another attachment at a key; null where there is no row.
        ``rewritten`` reads the other attachment's migrated rows (their own lookups are not followed)."""
        other = self._other(attachment)
        at = ("lookup", other.id, str(key), rewritten)
        if at not in self.joins:
            self.joins[at] = (f"_l{len(self.joins)}", other, key, rewritten, set())
        self.joins[at][4].add(column)
        return F.col(f"{self.joins[at][0]}.{column}")

    def fold(self, attachment: str, by: str, aggregate: Column, empty=None) -> Column:
        """An aggregate over the rows of another attachment whose column ``by`` holds the own key."""
        other = self._other(attachment)
        at = ("fold", other.id, by, str(aggregate))
        if at not in self.joins:
            self.joins[at] = (f"_f{len(self.joins)}", other, by, aggregate)
        out = F.col(f"{self.joins[at][0]}._fold")
        return out if empty is None else F.coalesce(out, F.lit(empty))


def _call(fn: Callable, *args, context: Context):
    """Hooks may take one argument more for the context."""
    count = sum(1 for p in inspect.signature(fn).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD))
    return fn(*args, context) if count > len(args) else fn(*args)


@dataclass
class Projection:
    """The compiled rewrite of one attachment."""

    source: Attachment
    target: Attachment
    columns: dict[str, Column]
    sites: list[Site]
    context: Context
    migration: Migration

    def joined(self, rows: DataFrame, read: Callable[[str], DataFrame] | None) -> DataFrame:
        """The source rows with what the hooks look up. Joins are left joins on keys that are unique
        on the other side, so no row is lost or doubled."""
        for at, join in self.context.joins.items():
            if read is None:
                raise Refused("[hook] lookups need the source tables")
            tag, other = join[0], join[1]
            table = read(other.id)
            if at[0] == "lookup":
                _, _, key, rewritten, wanted = join
                if rewritten:
                    inner = Compiler(self.migration).projection(other, plain=True)
                    table = inner.select(table)
                    key_name = inner.target.key_column
                else:
                    key_name = other.key_column
                table = table.select(F.col(key_name).alias("_key"), *sorted(wanted))
                rows = rows.join(table.alias(tag), key == F.col(f"{tag}._key"), "left")
            else:
                _, _, by, aggregate = join
                table = table.groupBy(F.col(by).alias("_key")).agg(aggregate.alias("_fold"))
                rows = rows.join(table.alias(tag), F.col(self.source.key_column) == F.col(f"{tag}._key"), "left")
        return rows

    def event(self) -> Column | None:
        """What happens to a record first, in the order of the walk: null, ``drop`` or a refusal."""
        acting = [s for s in self.sites if s.drops or s.fails]
        if not acting:
            return None
        out = None
        for s in acting:
            hit, what = s.count(F.lit(0)) > 0, F.lit("drop" if s.drops else f"[{s.op}] {s.path}: a value has no target value and the policy is fail")
            out = F.when(hit, what) if out is None else out.when(hit, what)
        return out

    def kept(self, rows: DataFrame) -> DataFrame:
        """Without dropped records; raises at a record that is refused. The check is a filter, which
        no pruning can remove."""
        event = self.event()
        if event is None:
            return rows
        return rows.withColumn("_event", event).where(
            F.when(F.col("_event").isNull(), True).when(F.col("_event") == "drop", False).otherwise(F.raise_error(F.col("_event")).cast("boolean")))

    def select(self, rows: DataFrame, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
        """The target rows. Works on batch and, without lookups, on streaming frames."""
        kept = self.kept(self.joined(rows, read))
        key = F.col(self.source.key_column).alias(self.target.key_column)
        return kept.select(key, *(c.alias(n) for n, c in self.columns.items()))


class Compiler:
    def __init__(self, migration: Migration):
        self.migration = migration

    def projection(self, attachment: Attachment, plain: bool = False) -> Projection:
        """``plain`` leaves hooks that look elsewhere null, which bounds nested rewriting."""
        m = self.migration
        context = Context(self, None if plain else attachment)
        source = m.source.struct(attachment.document)
        nodes = self.fields(source, lambda name: (lambda _: F.col(f"`{name}`")), context, plain)
        target = m.target.attachment(m.attachments[attachment.id])
        columns = {name: node.value(F.lit(0)) for name, node in nodes}
        return Projection(attachment, target, columns, [s for _, n in nodes for s in n.sites], context, m)

    def fields(self, source: Struct, at: Callable[[str], Callable], context: Context, plain: bool = False) -> list[tuple[str, Node]]:
        """(target name, node over the structure) for each target field, in the target's order."""
        m, d = self.migration, self.migration.directives
        target = m.target.struct(m.names[source.name])
        added = {a.name: a for a in d.added.get(source.name, ())}
        origin = {d.field_names.get((source.name, f.name), f.name): f for f in source.fields if (source.name, f.name) not in d.dropped_fields}
        out = []
        for t in target.fields:
            path = f"{source.name.rpartition('::')[2]}.{t.name}"
            spark = m.target.spark_type(t.type)
            if t.name in added and t.name not in origin:
                a = added[t.name]
                if a.derive is None:
                    node = Node((lambda v, dt: lambda c: F.lit(v).cast(dt))(a.default, spark))
                else:
                    node = self._hook(a.derive, source, at, t.name, t.type, path, context, plain)
                out.append((t.name, node))
                continue
            f = origin[t.name]
            where, own = (source.name, f.name), f"{source.name.rpartition('::')[2]}.{f.name}"
            if where in d.field_hooks:
                node = self._hook(d.field_hooks[where].fn, source, at, f.name, t.type, own, context, plain)
            elif where in d.resizes:
                r = d.resizes[where]
                node = C.resize(m.image(f.type), t.type, r.fill, r.on_shrink, own, m.target).at(at(f.name))
            elif where in d.transposes:
                node = C.transpose(m.image(f.type)).at(at(f.name))
            elif where in d.retypes:
                node = self.retype(f.type, d.retypes[where].type, d.retypes[where].policy, own, context).at(at(f.name))
            else:
                node = self.walk(f.type, path, context).at(at(f.name))
            out.append((t.name, node))
        return out

    def _hook(self, fn: Callable, source: Struct, at, name: str, target: Type, path: str, context: Context, plain: bool) -> Node:
        spark = self.migration.target.spark_type(target)

        def made(c: Column):
            if plain:
                try:
                    return _call(fn, Source(source, lambda n: at(n)(c)), name, target, context=context)
                except Refused:
                    return F.lit(None).cast(spark)
            return _call(fn, Source(source, lambda n: at(n)(c)), name, target, context=context)

        made(F.lit(0))  # registers its lookups
        value = lambda c: x.value if isinstance(x := made(c), Unless) else x
        sites = [Site(path, "transform", None, lambda c: F.lit(1).cast("long"), acts=False, after=value)]
        if isinstance(made(F.lit(0)), Unless):
            sites.append(Site(path, "transform", "drop-record", lambda c: one(F.coalesce(made(c).drop, F.lit(False)))))
        return Node(value, tuple(sites))

    def retype(self, a: Type, b: Type, policy, path: str, context: Context) -> Node:
        """Names are mapped first, then values are converted."""
        m = self.migration
        moved = self.walk(a, path, context)
        node = C.convert(m.image(a), b, policy, path, m.target, m.directives.winner)
        if moved.identity:
            return node
        after = node.at(moved.value)
        return Node(after.value, (*moved.sites, *after.sites))

    def walk(self, t: Type, path: str, context: Context) -> Node:
        """The node that carries a value of a source type to its image."""
        m, d = self.migration, self.migration.directives
        hook = d.type_hooks.get(t.name if t.kind == "ref" else str(t))
        if hook:
            value = lambda c: _call(hook.fn, c, hook.type, context=context)
            return Node(value, (Site(path, "transform", None, lambda c: F.lit(1).cast("long"), acts=False, after=value),))
        sub = lambda x, tail: self.walk(x, path + tail, context)
        match t.kind:
            case "ref":
                return self._named(t, path, context)
            case "key":
                return self._key(t)
            case "any":
                return self._any(path, context)
            case "optional":
                node = sub(t.args[0], "")
                return node if node.identity else guarded(node.value, node.sites)
            case "vec" | "vector":
                return C.over_array(sub(t.args[0], "[i]" if t.kind == "vec" else "[]"))
            case "mat":
                return C.over_array(C.over_array(sub(t.args[0], "[c,r]")))
            case "set":
                return C.over_set(m.image(t), m.image(t), sub(t.args[0], "{}"), path, d.winner)
            case "map":
                return C.over_map(sub(t.args[0], "<key>"), sub(t.args[1], "<val>"), path, d.winner)
            case "xarray":
                return C.over_xarray(sub(t.args[0], "[]"))
            case "tuple":
                return C.over_tuple([sub(a, f".{i}") for i, a in enumerate(t.args)])
            case "variant":
                return self._variant(t, path, context)
        return IDENTITY

    def _named(self, t: Type, path: str, context: Context) -> Node:
        m, d = self.migration, self.migration.directives
        if e := m.source.enum(t.name):
            renamed = [(c, d.case_names[e.name, c]) for c in e.names if (e.name, c) in d.case_names and d.case_names[e.name, c] != c]
            removed = [(c, d.removed_cases[e.name, c]) for c in e.names if (e.name, c) in d.removed_cases]
            if not renamed and not removed:
                return IDENTITY
            pairs = renamed + [(c, p[1]) for c, p in removed if isinstance(p, tuple)]
            lost = [c for c, p in removed if not isinstance(p, tuple)]

            def value(c: Column) -> Column:
                out = None
                for a, b in pairs:
                    out = F.when(c == a, F.lit(b)) if out is None else out.when(c == a, F.lit(b))
                if lost:
                    gone = F.lit(None).cast("string")
                    out = F.when(c.isin(*lost), gone) if out is None else out.when(c.isin(*lost), gone)
                return out.otherwise(c)

            return Node(value, tuple(Site(path, "remove-case", p, (lambda x: lambda c: one(F.coalesce(c == x, F.lit(False))))(n), after=value) for n, p in removed))
        s = m.source.struct(t.name)
        if s is None:
            raise Refused(f"[type] {path}: {t.name} is no value type")
        if not self.changes(s):
            return IDENTITY
        nodes = self.fields(s, lambda name: (lambda c: c[name]), context)
        return guarded(lambda c: F.struct(*(n.value(c).alias(name) for name, n in nodes)), tuple(x for _, n in nodes for x in n.sites))

    def changes(self, s: Struct, seen: tuple[str, ...] = ()) -> bool:
        """Whether values of a structure change in any way."""
        m, d = self.migration, self.migration.directives
        t = m.target.struct(m.names[s.name])
        if [f.name for f in t.fields] != [f.name for f in s.fields] or any(k[0] == s.name for k in [*d.retypes, *d.resizes, *d.transposes, *d.field_hooks]):
            return True
        return any(field_type(s, f, m) != f.type or not self._still(f.type, (*seen, s.name)) for f in s.fields)

    def _still(self, t: Type, seen: tuple[str, ...]) -> bool:
        m, d = self.migration, self.migration.directives
        if (t.name if t.kind == "ref" else str(t)) in d.type_hooks or t.kind == "any":
            return False
        if t.kind == "key":
            return m.names == {n: n for n in m.names}
        if t.kind == "ref":
            if m.source.enum(t.name):
                return not any(k[0] == t.name for k in [*d.case_names, *d.removed_cases])
            return t.name in seen or not self.changes(m.source.struct(t.name), seen)
        return all(self._still(a, seen) for a in t.args)

    def _key(self, t: Type) -> Node:
        """Concepts are renamed; the instance and the flavour stay."""
        moved = {a: b for a, b in self.migration.names.items() if a != b}
        if not moved:
            return IDENTITY

        def name(c: Column) -> Column:
            out = None
            for a, b in moved.items():
                out = F.when(c == a, F.lit(b)) if out is None else out.when(c == a, F.lit(b))
            return out.otherwise(c)

        return guarded(lambda c: F.struct(c["flavour"].alias("flavour"), name(c["type"]).alias("type"), name(c["concept"]).alias("concept"), c["instance_id"].alias("instance_id")), ())

    def _any(self, path: str, context: Context) -> Node:
        """Dynamic values follow the rewrite of their type; a type the catalog does not know is
        refused. Plain values stay."""
        m = self.migration
        # Structures that hold dynamic values themselves could nest without end; they are not followed.
        changed = [s for s in m.source.structs if not self._dynamic(s) and m.target.struct(m.names[s.name]) and (self.changes(s, (s.name,)) or m.names[s.name] != s.name)]
        known = [x.name for x in m.source.types() if x.name not in m.directives.dropped_types and not (isinstance(x, Struct) and self._dynamic(x))]

        def value(c: Column) -> Column:
            kind, body = c["type_id"], c["value"]
            new_kind, new_body = None, None
            for s in changed:
                node = self._named(Type("ref", name=s.name), path, context)
                read = F.from_json(body, m.source.spark_type(Type("ref", name=s.name)))
                made = F.to_json(node.value(read)) if not node.identity else body
                new_kind = F.when(kind == s.name, F.lit(m.names[s.name])) if new_kind is None else new_kind.when(kind == s.name, F.lit(m.names[s.name]))
                new_body = F.when(kind == s.name, made) if new_body is None else new_body.when(kind == s.name, made)
            if new_kind is None:
                return c
            return F.struct(new_kind.otherwise(kind).alias("type_id"), new_body.otherwise(body).alias("value"))

        unknown = lambda c: one(F.coalesce(c["type_id"].contains("::") & ~c["type_id"].isin(*known), F.lit(False)))
        return guarded(value, (Site(path, "any of unknown type", FAIL, unknown),))

    def _dynamic(self, s: Struct) -> bool:
        return any(t.kind == "any" for _, _, t, _ in walk_types(Type("ref", name=s.name), self.migration.source))

    def _variant(self, t: Type, path: str, context: Context) -> Node:
        m = self.migration
        arms = []
        for i, a in enumerate(t.args):
            node = self.walk(a, path, context)
            arms.append((a, m.image(a), Node(node.value, node.sites, node.identity, extra={"arm": i})))
        if all(n.identity and x == y for x, y, n in arms):
            return IDENTITY
        sites = tuple(s for i, (_, _, n) in enumerate(arms) for s in n.at((lambda k: lambda c: c[f"a{k}"])(i)).sites)
        return guarded(C.variant_value(arms, m.image(t), m.target), sites)
