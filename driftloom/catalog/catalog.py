"""The catalog: namespaces, concepts, clubs, enumerations, structures and attachments.

A catalog is plain immutable data on the driver. Each definition has a fingerprint, the SHA-256 of
its canonical JSON: the namespace's UUID, not its name, names, field order, types, defaults and
cases are inside; docs and display names of namespaces are not.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as S

from driftloom.catalog.types import Type, from_spark, parse, spark_type

NO_DEFAULT = object()


@dataclass(frozen=True)
class Namespace:
    name: str
    uuid: str


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    doc: str = ""
    default: Any = field(default=NO_DEFAULT, compare=True)

    @property
    def has_default(self) -> bool:
        return self.default is not NO_DEFAULT


@dataclass(frozen=True)
class Struct:
    name: str
    fields: tuple[Field, ...]
    doc: str = ""

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True)
class Case:
    name: str
    doc: str = ""


@dataclass(frozen=True)
class Enum:
    name: str
    cases: tuple[Case, ...]
    doc: str = ""

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.cases]


@dataclass(frozen=True)
class Concept:
    name: str
    parent: str = ""
    doc: str = ""


@dataclass(frozen=True)
class Club:
    name: str
    members: tuple[str, ...]
    doc: str = ""


@dataclass(frozen=True)
class Attachment:
    """A table: rows keyed by instances of a concept. ``key_column`` holds the instance id, the
    other columns are the fields of the document structure."""

    namespace: str
    name: str
    concept: str
    document: str
    key_column: str = "key"
    doc: str = ""

    @property
    def id(self) -> str:
        return f"{self.namespace}::{self.concept.rpartition('::')[2]}.{self.name}"


Definition = Struct | Enum | Concept | Club | Attachment


def namespace_of(name: str) -> str:
    return name.rpartition("::")[0]


def local_name(name: str) -> str:
    return name.rpartition("::")[2]


@dataclass(frozen=True)
class Catalog:
    namespaces: tuple[Namespace, ...]
    concepts: tuple[Concept, ...] = ()
    clubs: tuple[Club, ...] = ()
    enums: tuple[Enum, ...] = ()
    structs: tuple[Struct, ...] = ()
    attachments: tuple[Attachment, ...] = ()

    def __post_init__(self):
        seen: set[str] = set()
        for name in [*(d.name for d in self.types()), *(a.id for a in self.attachments)]:
            if name in seen:
                raise ValueError(f"defined twice: {name}")
            seen.add(name)
            if "::" not in name or name.partition("::")[0] not in {n.name for n in self.namespaces}:
                raise ValueError(f"{name} is in no known namespace")
        for s in self.structs:
            for f in s.fields:
                if missing := f.type.names() - seen:
                    raise ValueError(f"{s.name}.{f.name} refers to undefined {', '.join(sorted(missing))}")
            if len({f.name for f in s.fields}) != len(s.fields):
                raise ValueError(f"{s.name} has a field twice")
        for a in self.attachments:
            if not self.struct(a.document):
                raise ValueError(f"{a.id} has no document structure {a.document}")
        self._topological({s.name: {n for f in s.fields for n in f.type.names() if self.struct(n) and not _through_key(f.type, n)} for s in self.structs}, "structure dependency cycle")
        self._topological({c.name: {c.parent} - {""} for c in self.concepts}, "concept parent cycle")

    @staticmethod
    def _topological(needs: dict[str, set[str]], what: str) -> list[str]:
        done: list[str] = []
        while len(done) < len(needs):
            ready = sorted(n for n in needs if n not in done and not (needs[n] & needs.keys()) - set(done))
            if not ready:
                raise ValueError(f"{what}: {', '.join(sorted(set(needs) - set(done)))}")
            done += ready
        return done

    def types(self) -> Iterator[Struct | Enum | Concept | Club]:
        yield from self.concepts
        yield from self.clubs
        yield from self.enums
        yield from self.structs

    def definition(self, name: str) -> Struct | Enum | Concept | Club | None:
        return next((d for d in self.types() if d.name == name), None)

    def struct(self, name: str) -> Struct | None:
        return next((s for s in self.structs if s.name == name), None)

    def enum(self, name: str) -> Enum | None:
        return next((e for e in self.enums if e.name == name), None)

    def attachment(self, name: str) -> Attachment | None:
        """By full identifier, or by a local name that only one attachment has."""
        found = [a for a in self.attachments if name in (a.id, a.name)]
        return next((a for a in found if a.id == name), found[0] if len(found) == 1 else None)

    def spark_type(self, t: Type) -> S.DataType:
        return spark_type(t, self._named)

    def _named(self, name: str) -> S.DataType:
        d = self.definition(name)
        if isinstance(d, Struct):
            return S.StructType([S.StructField(f.name, self.spark_type(f.type)) for f in d.fields])
        if isinstance(d, Enum):
            return S.StringType()  # the case's name, never its number
        raise ValueError(f"{name} is no value type")

    def table_schema(self, a: Attachment) -> S.StructType:
        """The schema of an attachment's table; docs are kept as column comments."""
        fields = [S.StructField(a.key_column, S.StringType())]
        for f in self.struct(a.document).fields:
            fields.append(S.StructField(f.name, self.spark_type(f.type), metadata={"comment": f.doc} if f.doc else {}))
        return S.StructType(fields)

    # --- Fingerprints ---

    def _uuid(self, name: str) -> str:
        space = name.partition("::")[0]
        return next(n.uuid for n in self.namespaces if n.name == space)

    def _identity(self, name: str) -> str:
        return f"{self._uuid(name)}::{name.partition('::')[2]}"

    def _type_identity(self, t: Type) -> str:
        named = Type(t.kind, t.args, self._identity(t.name) if t.name else "", t.dims)
        inner = [self._type_identity(a) for a in t.args]
        return f"{named.kind}({','.join([*([named.name] if named.name else []), *inner, *map(str, t.dims)])})"

    def fingerprint(self, d: Definition) -> str:
        match d:
            case Struct():
                body = [[f.name, self._type_identity(f.type), _json_default(f)] for f in d.fields]
            case Enum():
                body = d.names
            case Concept():
                body = [self._identity(d.parent)] if d.parent else []
            case Club():
                body = sorted(map(self._identity, d.members))
            case Attachment():
                body = [d.name, self._identity(d.concept), self._identity(d.document)]
        name = self._identity(d.id if isinstance(d, Attachment) else d.name)
        return hashlib.sha256(json.dumps([type(d).__name__, name, body], sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def digest(self) -> str:
        """Equal for catalogs with equal definitions, in whatever order."""
        prints = sorted(map(self.fingerprint, [*self.types(), *self.attachments]))
        return hashlib.sha256("".join(prints).encode()).hexdigest()

    # --- JSON ---

    def to_json(self) -> str:
        def struct_field(f: Field) -> dict:
            return {"name": f.name, "type": str(f.type), "doc": f.doc, **({"default": f.default} if f.has_default else {})}

        return json.dumps({
            "namespaces": [vars(n) for n in self.namespaces], "concepts": [vars(c) for c in self.concepts],
            "clubs": [{**vars(c), "members": list(c.members)} for c in self.clubs],
            "enums": [{"name": e.name, "doc": e.doc, "cases": [vars(c) for c in e.cases]} for e in self.enums],
            "structs": [{"name": s.name, "doc": s.doc, "fields": [struct_field(f) for f in s.fields]} for s in self.structs],
            "attachments": [vars(a) for a in self.attachments],
        }, indent=1)

    @staticmethod
    def from_json(text: str) -> Catalog:
        d = json.loads(text)
        return Catalog(
            tuple(Namespace(**n) for n in d["namespaces"]), tuple(Concept(**c) for c in d["concepts"]),
            tuple(Club(c["name"], tuple(c["members"]), c["doc"]) for c in d["clubs"]),
            tuple(Enum(e["name"], tuple(Case(**c) for c in e["cases"]), e["doc"]) for e in d["enums"]),
            tuple(Struct(s["name"], tuple(Field(f["name"], parse(f["type"]), f["doc"], f.get("default", NO_DEFAULT)) for f in s["fields"]), s["doc"]) for s in d["structs"]),
            tuple(Attachment(**a) for a in d["attachments"]))


def _through_key(t: Type, name: str) -> bool:
    """Whether a type names a definition through keys only."""
    if t.kind == "key":
        return True
    return t.kind != "ref" and all(_through_key(a, name) for a in t.args if name in a.names())


def _json_default(f: Field) -> Any:
    return ["default", f.default] if f.has_default else []


def catalog_of_tables(namespace: Namespace, tables: dict[str, tuple[S.StructType, str]], types: dict[str, Type] | None = None, enums: Iterable[Enum] = ()) -> Catalog:
    """A catalog of plain tables: name -> (schema, key column). Columns without a logical type are
    left out; ``types`` overrides columns as ``table.column``."""
    concepts, structs, attachments = [], [], []
    for name, (schema, key_column) in tables.items():
        title = "".join(p.capitalize() for p in name.split("_"))
        fields = []
        for f in schema.fields:
            t = (types or {}).get(f"{name}.{f.name}") or from_spark(f.dataType)
            if f.name != key_column and t is not None:
                fields.append(Field(f.name, t))
        concepts.append(Concept(f"{namespace.name}::{title}"))
        structs.append(Struct(f"{namespace.name}::{title}Doc", tuple(fields)))
        attachments.append(Attachment(namespace.name, name, f"{namespace.name}::{title}", f"{namespace.name}::{title}Doc", key_column))
    return Catalog((namespace,), tuple(concepts), (), tuple(enums), tuple(structs), tuple(attachments))


def with_struct(catalog: Catalog, s: Struct) -> Catalog:
    return replace(catalog, structs=tuple(s if x.name == s.name else x for x in catalog.structs))
