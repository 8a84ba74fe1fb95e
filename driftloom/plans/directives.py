"""The edit script: what changes between the source catalog and the target.

Targets are named by their source names; orders list target names. A script is plain data; nothing
is checked against a catalog before ``driftloom.plans.build``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from driftloom.catalog.types import Type

FAIL = "fail"
SATURATE = "saturate"
DROP_RECORD = "drop-record"
WINNERS = ("fail", "first", "last")


def default(value: Any) -> tuple[str, Any]:
    """Offending values become this one."""
    return ("default", value)


def map_case(name: str) -> tuple[str, str]:
    """A removed case becomes this target case."""
    return ("map-case", name)


def fit(pad: Any) -> tuple[str, Any]:
    """A vector is cut, or padded with this value, to the fixed length."""
    return ("fit", pad)


def checked_policy(policy: Any) -> Any:
    if policy in (None, FAIL, SATURATE, DROP_RECORD):
        return policy
    if isinstance(policy, tuple) and len(policy) == 2 and policy[0] in ("default", "map-case", "fit"):
        return policy
    raise ValueError(f"unknown policy: {policy!r}")


def policy_name(policy: Any) -> str:
    return policy[0] if isinstance(policy, tuple) else policy or FAIL


@dataclass(frozen=True)
class Added:
    name: str
    type: Type
    default: Any = None
    derive: Callable | None = None
    doc: str = ""


@dataclass(frozen=True)
class Retype:
    type: Type
    policy: Any = None


@dataclass(frozen=True)
class Resize:
    dims: tuple[int, ...]
    fill: Any
    on_shrink: str


@dataclass(frozen=True)
class Hook:
    """``fn(values, name, target[, context])`` builds a Column from the source structure's columns."""

    type: Type
    fn: Callable


@dataclass
class Directives:
    """Collects edits; every method gives the script back, so edits can be chained."""

    type_names: dict[str, str] = field(default_factory=dict)
    field_names: dict[tuple[str, str], str] = field(default_factory=dict)
    case_names: dict[tuple[str, str], str] = field(default_factory=dict)
    attachment_names: dict[str, str] = field(default_factory=dict)
    namespace_names: dict[str, str] = field(default_factory=dict)
    namespace_uuids: dict[str, str] = field(default_factory=dict)
    moved_types: dict[str, str] = field(default_factory=dict)
    moved_attachments: dict[str, str] = field(default_factory=dict)
    added: dict[str, list[Added]] = field(default_factory=dict)
    dropped_fields: list[tuple[str, str]] = field(default_factory=list)
    dropped_types: list[str] = field(default_factory=list)
    dropped_attachments: list[str] = field(default_factory=list)
    field_orders: dict[str, list[str]] = field(default_factory=dict)
    case_orders: dict[str, list[str]] = field(default_factory=dict)
    retypes: dict[tuple[str, str], Retype] = field(default_factory=dict)
    resizes: dict[tuple[str, str], Resize] = field(default_factory=dict)
    transposes: list[tuple[str, str]] = field(default_factory=list)
    field_hooks: dict[tuple[str, str], Hook] = field(default_factory=dict)
    type_hooks: dict[str, Hook] = field(default_factory=dict)
    added_cases: dict[str, list[str]] = field(default_factory=dict)
    removed_cases: dict[tuple[str, str], Any] = field(default_factory=dict)
    docs: dict[tuple[str, ...], str] = field(default_factory=dict)
    winner: str = "fail"
    document_drops_accepted: bool = False
    attachment_drops_accepted: bool = False

    # Names
    def rename_type(self, old: str, new: str) -> Directives:
        self.type_names[old] = new
        return self

    def rename_field(self, struct: str, old: str, new: str) -> Directives:
        self.field_names[struct, old] = new
        return self

    def rename_case(self, enum: str, old: str, new: str) -> Directives:
        self.case_names[enum, old] = new
        return self

    def rename_attachment(self, old: str, new: str) -> Directives:
        """A full identifier names one attachment, a local name all that bear it."""
        self.attachment_names[old] = new
        return self

    def rename_namespace(self, namespace: str, name: str) -> Directives:
        """The display name only: fingerprints stay."""
        self.namespace_names[namespace] = name
        return self

    def remap_namespace(self, namespace: str, uuid: str) -> Directives:
        """The identity: fingerprints change, names stay."""
        self.namespace_uuids[namespace] = uuid
        return self

    def move_type(self, name: str, namespace: str) -> Directives:
        self.moved_types[name] = namespace
        return self

    def move_attachment(self, name: str, namespace: str) -> Directives:
        self.moved_attachments[name] = namespace
        return self

    # Fields
    def add_field(self, struct: str, name: str, type: Type, default: Any = None, *, derive: Callable | None = None, doc: str = "") -> Directives:
        """Seeded with a constant, or computed from the source structure's columns."""
        if derive is not None and default is not None:
            raise ValueError("a field has a default or is derived, not both")
        self.added.setdefault(struct, []).append(Added(name, type, default, derive, doc))
        return self

    def drop_field(self, struct: str, name: str) -> Directives:
        self.dropped_fields.append((struct, name))
        return self

    def reorder_fields(self, struct: str, order: list[str]) -> Directives:
        self.field_orders[struct] = list(order)
        return self

    def retype_field(self, struct: str, name: str, type: Type, policy: Any = None) -> Directives:
        self.retypes[struct, name] = Retype(type, checked_policy(policy))
        return self

    def resize_vec_field(self, struct: str, name: str, size: int, *, fill: Any = "zero", on_shrink: str = FAIL) -> Directives:
        self.resizes[struct, name] = Resize((size,), fill, self._shrink(on_shrink))
        return self

    def resize_mat_field(self, struct: str, name: str, columns: int, rows: int, *, fill: Any = "identity", on_shrink: str = FAIL) -> Directives:
        self.resizes[struct, name] = Resize((columns, rows), fill, self._shrink(on_shrink))
        return self

    def transpose_mat_field(self, struct: str, name: str) -> Directives:
        self.transposes.append((struct, name))
        return self

    def transform_field(self, struct: str, name: str, type: Type, fn: Callable) -> Directives:
        """A hook computes the field, with its siblings in sight."""
        self.field_hooks[struct, name] = Hook(type, fn)
        return self

    def transform_type(self, source: str, target: Type, fn: Callable) -> Directives:
        """A hook replaces every value of a type, nested ones too; a hook on the field goes first."""
        self.type_hooks[source] = Hook(target, fn)
        return self

    # Cases
    def add_case(self, enum: str, name: str) -> Directives:
        self.added_cases.setdefault(enum, []).append(name)
        return self

    def reorder_cases(self, enum: str, order: list[str]) -> Directives:
        self.case_orders[enum] = list(order)
        return self

    def remove_case(self, enum: str, case: str, policy: Any = None) -> Directives:
        self.removed_cases[enum, case] = checked_policy(policy)
        return self

    # Whole definitions
    def drop_type(self, name: str) -> Directives:
        self.dropped_types.append(name)
        return self

    def drop_attachment(self, name: str) -> Directives:
        self.dropped_attachments.append(name)
        return self

    # Docs; an empty text clears
    def document_type(self, name: str, doc: str) -> Directives:
        self.docs["type", name] = doc
        return self

    def document_field(self, struct: str, name: str, doc: str) -> Directives:
        self.docs["field", struct, name] = doc
        return self

    def document_case(self, enum: str, name: str, doc: str) -> Directives:
        self.docs["case", enum, name] = doc
        return self

    def document_attachment(self, name: str, doc: str) -> Directives:
        self.docs["attachment", name] = doc
        return self

    # Decisions
    def resolve_collisions(self, winner: str) -> Directives:
        if winner not in WINNERS:
            raise ValueError(f"collisions are resolved by one of {', '.join(WINNERS)}")
        self.winner = winner
        return self

    def accept_document_drops(self) -> Directives:
        self.document_drops_accepted = True
        return self

    def accept_attachment_drops(self) -> Directives:
        self.attachment_drops_accepted = True
        return self

    def drop_record_sites(self) -> list[str]:
        """Where this script can drop a whole record."""
        fields = [f"{s}.{f}" for (s, f), r in self.retypes.items() if r.policy == DROP_RECORD]
        return fields + [f"{e}.{c}" for (e, c), p in self.removed_cases.items() if p == DROP_RECORD]

    @staticmethod
    def _shrink(how: str) -> str:
        if how not in (FAIL, "accept"):
            raise ValueError("on_shrink is fail or accept")
        return how
