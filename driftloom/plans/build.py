"""From a source catalog and an edit script to the target catalog.

Runs on the driver, without data. All problems are gathered before anything is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from driftloom.catalog.catalog import (
    NO_DEFAULT,
    Attachment,
    Case,
    Catalog,
    Club,
    Concept,
    Enum,
    Field,
    Namespace,
    Struct,
    local_name,
    namespace_of,
)
from driftloom.catalog.types import Type
from driftloom.functions.convert import lossy
from driftloom.functions.nodes import Refused
from driftloom.plans.directives import DROP_RECORD, Directives


@dataclass(frozen=True)
class Migration:
    """Source and target catalogs with the names in between."""

    source: Catalog
    target: Catalog
    directives: Directives
    names: dict[str, str]
    attachments: dict[str, str]

    def image(self, t: Type) -> Type:
        """The target type of a source type, renames and moves applied."""
        named = self.names.get(t.name, t.name)
        return Type(t.kind, tuple(map(self.image, t.args)), named, t.dims)

    def retyped(self, t: Type) -> Type:
        """As image(), with hooks on types applied."""
        hook = self.directives.type_hooks.get(t.name) if t.kind == "ref" else self.directives.type_hooks.get(str(t))
        if hook:
            return hook.type
        return Type(t.kind, tuple(map(self.retyped, t.args)), self.names.get(t.name, t.name), t.dims)


def attachments_named(catalog: Catalog, name: str) -> list[Attachment]:
    """One by its full identifier, or all that bear a local name."""
    return [a for a in catalog.attachments if a.id == name] or [a for a in catalog.attachments if a.name == name]


def build(source: Catalog, d: Directives) -> Migration:
    problems = [*_unknown(source, d), *_orders(source, d), *_dimensions(source, d), *_defaults(d), *_ambiguous(d)]
    if problems:
        raise Refused(problems)
    names, spaces = _new_names(source, d), _new_spaces(source, d)
    problems += _dangling(source, d) + _collisions(source, d, names)
    if problems:
        raise Refused(problems)
    dropped = set(d.dropped_types)
    partial = Migration(source, source, d, names, {})
    concepts = tuple(Concept(names[c.name], names.get(c.parent, ""), d.docs.get(("type", c.name), c.doc)) for c in source.concepts if c.name not in dropped)
    clubs = tuple(Club(names[c.name], tuple(names[m] for m in c.members), d.docs.get(("type", c.name), c.doc)) for c in source.clubs if c.name not in dropped)
    enums = tuple(_enum(e, d, names) for e in source.enums if e.name not in dropped)
    structs = tuple(_struct(s, d, partial) for s in source.structs if s.name not in dropped)
    attachments, mapped = [], {}
    gone = {a.id for n in d.dropped_attachments for a in attachments_named(source, n)}
    for a in source.attachments:
        if a.id in gone:
            continue
        new = replace(
            a, namespace=spaces[d.moved_attachments.get(a.id, d.moved_attachments.get(a.name, a.namespace))] if _moved(a, d) else spaces[a.namespace],
            name=d.attachment_names.get(a.id, d.attachment_names.get(a.name, a.name)), concept=names[a.concept], document=names[a.document],
            doc=next((d.docs[k] for k in (("attachment", a.id), ("attachment", a.name)) if k in d.docs), a.doc))
        attachments.append(new)
        mapped[a.id] = new.id
    namespaces = tuple(Namespace(spaces[n.name], d.namespace_uuids.get(n.name, n.uuid)) for n in source.namespaces)
    known = {n.name for n in namespaces}
    namespaces += tuple(Namespace(n, d.namespace_uuids[n]) for n in dict.fromkeys([*d.moved_types.values(), *d.moved_attachments.values()]) if spaces.get(n, n) not in known)
    try:
        target = Catalog(namespaces, concepts, clubs, enums, structs, tuple(attachments))
    except ValueError as e:
        raise Refused(str(e)) from e
    out = Migration(source, target, d, names, mapped)
    problems += _policies(out) + _drop_scopes(out)
    if problems:
        raise Refused(problems)
    return out


def build_for(source: Catalog, target: Catalog, d: Directives) -> Migration:
    """The migration to a catalog that was written elsewhere. Every definition that the script gives must
    stand in it under its name and with the same shape: fields by name, type and order, cases by name and
    order, the concept and document of attachments. It may hold more definitions, and its docs,
    defaults and namespace UUIDs are its own."""
    m = build(source, d)
    if problems := _shapes(m.target, target):
        raise Refused(problems)
    return replace(m, target=target)


def _shapes(expected: Catalog, given: Catalog) -> list[str]:
    """What the given catalog lacks or has in another shape."""
    out: list[str] = []

    def members(kind: str, owner: str, want: list[str], have: list[str]) -> None:
        if len(want) != len(have):
            out.append(f"[shape] {owner}: {len(want)} {kind}s expected, the target has {len(have)}")
        else:
            out.extend(f"[shape] {kind} #{i} of {owner}: {w} expected, the target has {h}" for i, (w, h) in enumerate(zip(want, have, strict=True)) if w != h)

    for x in expected.types():
        y = given.definition(x.name)
        if y is None or type(y) is not type(x):
            out.append(f"[no-target] {x.name}")
        elif isinstance(x, Struct):
            members("field", x.name, [f"{f.name}: {f.type}" for f in x.fields], [f"{f.name}: {f.type}" for f in y.fields])
        elif isinstance(x, Enum):
            members("case", x.name, x.names, y.names)
        elif isinstance(x, Concept) and x.parent != y.parent:
            out.append(f"[shape] parent of {x.name}: {x.parent or 'none'} expected, the target has {y.parent or 'none'}")
        elif isinstance(x, Club):
            members("member", x.name, sorted(x.members), sorted(y.members))
    for a in expected.attachments:
        b = next((b for b in given.attachments if b.id == a.id), None)
        if b is None:
            out.append(f"[no-target] {a.id}")
        elif (a.concept, a.document) != (b.concept, b.document):
            out.append(f"[shape] {a.id}: {a.concept} with {a.document} expected, the target has {b.concept} with {b.document}")
    return out


def _moved(a: Attachment, d: Directives) -> bool:
    return a.id in d.moved_attachments or a.name in d.moved_attachments


def _new_spaces(source: Catalog, d: Directives) -> dict[str, str]:
    out = {n.name: d.namespace_names.get(n.name, n.name) for n in source.namespaces}
    for n in [*d.moved_types.values(), *d.moved_attachments.values()]:
        out.setdefault(n, n)
    return out


def _new_names(source: Catalog, d: Directives) -> dict[str, str]:
    """Every type's target name; a new name may be given with or without a namespace."""
    spaces, out = _new_spaces(source, d), {}
    for x in source.types():
        new = d.type_names.get(x.name, x.name)
        space = d.moved_types.get(x.name) or (namespace_of(new) if "::" in new and x.name in d.type_names else namespace_of(x.name))
        out[x.name] = f"{spaces.get(space, space)}::{local_name(new)}"
    return out


def _enum(e: Enum, d: Directives, names: dict[str, str]) -> Enum:
    cases = [Case(d.case_names.get((e.name, c.name), c.name), d.docs.get(("case", e.name, c.name), c.doc)) for c in e.cases if (e.name, c.name) not in d.removed_cases]
    cases += [Case(n, d.docs.get(("case", e.name, n), "")) for n in d.added_cases.get(e.name, ())]
    if order := d.case_orders.get(e.name):
        cases.sort(key=lambda c: order.index(c.name))
    return Enum(names[e.name], tuple(cases), d.docs.get(("type", e.name), e.doc))


def field_type(s: Struct, f: Field, m: Migration) -> Type:
    """The target type of a source field."""
    at, d = (s.name, f.name), m.directives
    if at in d.field_hooks:
        return d.field_hooks[at].type
    if at in d.resizes:
        return replace(m.image(f.type), dims=d.resizes[at].dims)
    if at in d.transposes:
        return replace(m.image(f.type), dims=f.type.dims[::-1])
    if at in d.retypes:
        return d.retypes[at].type
    return m.retyped(f.type)


def _struct(s: Struct, d: Directives, m: Migration) -> Struct:
    fields = []
    for f in s.fields:
        if (s.name, f.name) in d.dropped_fields:
            continue
        t = field_type(s, f, m)
        kept = f.default if t == f.type else NO_DEFAULT  # a changed type loses the default
        fields.append(Field(d.field_names.get((s.name, f.name), f.name), t, d.docs.get(("field", s.name, f.name), f.doc), kept))
    for a in d.added.get(s.name, ()):
        doc = d.docs.get(("field", s.name, a.name), a.doc)
        fields.append(Field(a.name, a.type, doc, NO_DEFAULT if a.derive else a.default))
    if order := d.field_orders.get(s.name):
        fields.sort(key=lambda f: order.index(f.name))
    return Struct(m.names[s.name], tuple(fields), d.docs.get(("type", s.name), s.doc))


# --- Checks ---------------------------------------------------------------------------------------

def _unknown(source: Catalog, d: Directives) -> list[str]:
    out: list[str] = []
    types, spaces = {x.name for x in source.types()}, {n.name for n in source.namespaces}

    def need(ok: bool, what: str, name: str):
        if not ok:
            out.append(f"[unknown-target] {what} {name}")

    def field(s: str, f: str, extra: bool = False):
        x = source.struct(s)
        added = extra and any(a.name == f for a in d.added.get(s, ()))
        need(bool(x and x.field(f)) or added, "field", f"{s}.{f}")

    def case(e: str, c: str, extra: bool = False):
        x = source.enum(e)
        need(bool(x and c in x.names) or extra and c in d.added_cases.get(e, ()), "case", f"{e}.{c}")

    for n in [*d.type_names, *d.moved_types, *d.dropped_types]:
        need(n in types, "type", n)
    for n in d.type_hooks:
        need(n in types or "::" not in n, "type", n)
    for n in [*d.added, *d.field_orders]:
        need(source.struct(n) is not None, "structure", n)
    for n in [*d.added_cases, *d.case_orders]:
        need(source.enum(n) is not None, "enumeration", n)
    for s, f in [*d.field_names, *d.dropped_fields, *d.retypes, *d.resizes, *d.transposes, *d.field_hooks]:
        field(s, f)
    for e, c in [*d.case_names, *d.removed_cases]:
        case(e, c)
    for n in [*d.attachment_names, *d.moved_attachments, *d.dropped_attachments]:
        need(bool(attachments_named(source, n)), "attachment", n)
    for n in [*d.namespace_names, *(u for u in d.namespace_uuids if u not in [*d.moved_types.values(), *d.moved_attachments.values()])]:
        need(n in spaces, "namespace", n)
    for n in [*d.moved_types.values(), *d.moved_attachments.values()]:
        need(n in spaces or n in d.namespace_uuids, "namespace (a new one needs remap_namespace)", n)
    for what, *rest in d.docs:
        if what == "type":
            need(rest[0] in types, "type", rest[0])
        elif what == "field":
            field(*rest, extra=True)
        elif what == "case":
            case(*rest, extra=True)
        else:
            need(bool(attachments_named(source, rest[0])), "attachment", rest[0])
    return out


def _orders(source: Catalog, d: Directives) -> list[str]:
    out = []
    for s, order in d.field_orders.items():
        if x := source.struct(s):
            have = [d.field_names.get((s, f.name), f.name) for f in x.fields if (s, f.name) not in d.dropped_fields] + [a.name for a in d.added.get(s, ())]
            if sorted(order) != sorted(have):
                out.append(f"[order] {s}: {order} is no permutation of {have}")
    for e, order in d.case_orders.items():
        if x := source.enum(e):
            have = [d.case_names.get((e, c), c) for c in x.names if (e, c) not in d.removed_cases] + d.added_cases.get(e, [])
            if sorted(order) != sorted(have):
                out.append(f"[order] {e}: {order} is no permutation of {have}")
    for (e, c), policy in d.removed_cases.items():
        x = source.enum(e)
        if x and isinstance(policy, tuple) and policy[0] == "map-case":
            left = [d.case_names.get((e, n), n) for n in x.names if (e, n) not in d.removed_cases] + d.added_cases.get(e, [])
            if policy[1] not in left:
                out.append(f"[map-case] {e}.{c}: {policy[1]} is no case of the target")
    return out


def _dimensions(source: Catalog, d: Directives) -> list[str]:
    """Resizing and transposing apply to a field that is itself a vec or mat."""
    out = []
    for at, wanted in [*((k, len(r.dims)) for k, r in d.resizes.items()), *((k, 2) for k in d.transposes)]:
        s = source.struct(at[0])
        f = s and s.field(at[1])
        if f and (f.type.kind not in ("vec", "mat") or len(f.type.dims) != wanted):
            out.append(f"[dimension] {at[0]}.{at[1]} is a {f.type}")
    for at, r in d.resizes.items():
        if r.fill == "identity" and len(r.dims) != 2:
            out.append(f"[dimension] {at[0]}.{at[1]}: identity fills matrices only")
    return out


def domain_free(t: Type) -> bool:
    """Whether a constant of the type needs no catalog to be read."""
    return t.kind not in ("ref", "key", "any") and all(map(domain_free, t.args))


def _defaults(d: Directives) -> list[str]:
    return [f"[default] {s}.{a.name}: a constant of {a.type} is not domain-free" for s, added in d.added.items() for a in added if a.derive is None and a.default is not None and not domain_free(a.type)]


def _ambiguous(d: Directives) -> list[str]:
    """A field that is dropped and added again could keep or lose its values."""
    out = [f"[ambiguous] {s}.{a.name} is dropped and added" for s, added in d.added.items() for a in added if (s, a.name) in d.dropped_fields]
    for at in {*d.retypes} & {*d.field_hooks} | {*d.resizes} & {*d.transposes} | {*d.retypes} & ({*d.resizes} | {*d.transposes}):
        out.append(f"[ambiguous] {at[0]}.{at[1]} is converted in two ways")
    return out


def _dangling(source: Catalog, d: Directives) -> list[str]:
    """Every place that still refers to a dropped type. Dropped, retyped and transformed fields do
    not count, nor do dropped definitions and attachments."""
    dropped, out = set(d.dropped_types), []
    gone = {a.id for n in d.dropped_attachments for a in attachments_named(source, n)}
    say = lambda where, name: out.append(f"[dangling] {where} refers to dropped {name}")
    for s in source.structs:
        for f in s.fields:
            at = (s.name, f.name)
            if s.name in dropped or at in d.dropped_fields:
                continue
            t = d.field_hooks[at].type if at in d.field_hooks else d.retypes[at].type if at in d.retypes else f.type
            for n in sorted(t.names() & dropped):
                say(f"{s.name}.{f.name}", n)
        for a in d.added.get(s.name, ()):
            for n in sorted(a.type.names() & dropped):
                say(f"{s.name}.{a.name}", n)
    for c in source.concepts:
        if c.name not in dropped and c.parent in dropped:
            say(c.name, c.parent)
    for c in source.clubs:
        for n in sorted(set(c.members) & dropped if c.name not in dropped else ()):
            say(c.name, n)
    for a in source.attachments:
        for n in sorted({a.concept, a.document} & dropped if a.id not in gone else ()):
            say(a.id, n)
    return out


def _collisions(source: Catalog, d: Directives, names: dict[str, str]) -> list[str]:
    by: dict[str, list[str]] = {}
    for old, new in names.items():
        if old not in d.dropped_types:
            by.setdefault(new, []).append(old)
    return [f"[collision] {', '.join(sorted(olds))} all become {new}" for new, olds in sorted(by.items()) if len(olds) > 1]


def _policies(m: Migration) -> list[str]:
    """Lossy conversions without a policy, and conversions that do not exist."""
    out = []
    for (s, f), r in m.directives.retypes.items():
        try:
            loss = lossy(m.image(m.source.struct(s).field(f).type), r.type)
        except Refused as e:
            out += [f"{s}.{f}: {p}" for p in e.problems]
            continue
        if loss and r.policy is None:
            out.append(f"[policy] {s}.{f}: {loss}; name a policy")
    out += [f"[policy] {e}.{c} is removed; name a policy" for (e, c), p in m.directives.removed_cases.items() if p is None]
    return out


def walk_types(t: Type, catalog: Catalog, inside: str = "", seen: tuple[str, ...] = ()) -> Iterator[tuple[str, str, Type, str]]:
    """(struct, field, type, container) below a type; container is the first one that holds many."""
    if t.kind in ("vector", "set", "map", "xarray", "vec", "mat"):
        inside = inside or t.kind
    yield "", "", t, inside
    for a in t.args:
        yield from walk_types(a, catalog, inside, seen)
    s = catalog.struct(t.name) if t.kind == "ref" else None
    if s and s.name not in seen:
        for f in s.fields:
            yield s.name, f.name, f.type, inside
            yield from walk_types(f.type, catalog, inside, (*seen, s.name))


def _drop_scopes(m: Migration) -> list[str]:
    """drop-record drops the document, so its site must occur once in a document: not in a
    container that holds many."""
    d, out = m.directives, set()
    fields = {at for at, r in d.retypes.items() if r.policy == DROP_RECORD}
    enums = {e for (e, _), p in d.removed_cases.items() if p == DROP_RECORD}
    for a in m.source.attachments:
        for s, f, t, inside in walk_types(Type("ref", name=a.document), m.source):
            if inside and (s, f) in fields:
                out.add(f"[drop-record] {s}.{f} is in a {inside} in {a.id}")
            if inside and t.kind == "ref" and t.name in enums:
                out.add(f"[drop-record] {t.name} is in a {inside} in {a.id}")
    for at in fields:
        f = m.source.struct(at[0]).field(at[1])
        if f.type.kind in ("vector", "set", "map", "xarray") and not (f.type.kind == "vector" and d.retypes[at].type.kind == "vec"):
            out.add(f"[drop-record] {at[0]}.{at[1]} holds many values")
    return sorted(out)


def gate_documents(m: Migration) -> None:
    if (sites := m.directives.drop_record_sites()) and not m.directives.document_drops_accepted:
        raise Refused(f"[acknowledge] records can be dropped at {', '.join(sites)}; accept_document_drops() to go on")


def gate_attachments(m: Migration) -> None:
    if m.directives.dropped_attachments and not m.directives.attachment_drops_accepted:
        raise Refused(f"[acknowledge] attachments are dropped: {', '.join(m.directives.dropped_attachments)}; accept_attachment_drops() to go on")
