"""The static plan: what a script would do, from catalogs alone.

Classes: A is lossless, B loses something unless its policy says how, C is a hook of the user's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from driftloom.catalog.catalog import Catalog
from driftloom.catalog.types import Type
from driftloom.functions.convert import lossy
from driftloom.functions.nodes import Refused
from driftloom.plans.build import attachments_named
from driftloom.plans.directives import FAIL, Directives, policy_name


@dataclass(frozen=True)
class Change:
    kind: str
    target: str
    detail: str
    loss_class: str
    loss: str = ""
    policy: str = ""


@dataclass
class Plan:
    changes: list[Change] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def classify(a: Type, b: Type) -> tuple[str, str]:
    """(class, loss) of a conversion; the class is ``refused`` where there is none."""
    try:
        loss = lossy(a, b)
    except Refused as e:
        return "refused", str(e)
    return ("B", loss) if loss else ("A", "")


def plan(source: Catalog, d: Directives) -> Plan:
    out = Plan()

    def add(kind: str, target: str, detail: str = "", loss_class: str = "A", loss: str = "", policy: str = ""):
        out.changes.append(Change(kind, target, detail, loss_class, loss, policy))

    for kind, names in (("rename-type", d.type_names), ("rename-attachment", d.attachment_names), ("rename-namespace", d.namespace_names), ("remap-namespace", d.namespace_uuids),
                        ("move-type", d.moved_types), ("move-attachment", d.moved_attachments)):
        for old, new in names.items():
            add(kind, old, new)
    for kind, pairs in (("rename-field", d.field_names), ("rename-case", d.case_names)):
        for (owner, old), new in pairs.items():
            add(kind, f"{owner}.{old}", new)
    for s, added in d.added.items():
        for a in added:
            add("add-field", f"{s}.{a.name}", str(a.type), "C" if a.derive else "A")
    for s, f in d.dropped_fields:
        add("drop-field", f"{s}.{f}", loss_class="A", loss="the field's values go")
    for s, order in d.field_orders.items():
        add("reorder-fields", s, ", ".join(order))
    for (s, f), r in d.retypes.items():
        have = source.struct(s) and source.struct(s).field(f)
        if not have:
            out.warnings.append(f"{s}.{f} is no field of the source")
            continue
        loss_class, loss = classify(have.type, r.type)
        add("retype-field", f"{s}.{f}", f"{have.type} to {r.type}", loss_class, loss, policy_name(r.policy) if r.policy else "")
        if loss_class == "refused":
            out.warnings.append(f"{s}.{f}: {loss}")
        elif loss_class == "B" and r.policy in (None, FAIL):
            out.warnings.append(f"{s}.{f}: {loss}, and no policy is named" if r.policy is None else f"{s}.{f}: the run ends at the first offender")
    for (s, f), r in d.resizes.items():
        have = source.struct(s) and source.struct(s).field(f)
        shrinks = bool(have) and any(x < y for x, y in zip(r.dims, have.type.dims, strict=False))
        add("resize-field", f"{s}.{f}", "x".join(map(str, r.dims)), "B" if shrinks else "A", "positions are cut" if shrinks else "", r.on_shrink if shrinks else "")
        if shrinks and r.on_shrink == FAIL:
            out.warnings.append(f"{s}.{f} shrinks; on_shrink='accept' to go on")
    for s, f in d.transposes:
        add("transpose-field", f"{s}.{f}")
    for (s, f), h in d.field_hooks.items():
        add("transform-field", f"{s}.{f}", str(h.type), "C")
    for t, h in d.type_hooks.items():
        add("transform-type", t, str(h.type), "C")
    if d.field_hooks or d.type_hooks or any(a.derive for added in d.added.values() for a in added):
        out.warnings.append("hooks are the user's own; their results are checked for type only")
    for e, names in d.added_cases.items():
        for n in names:
            add("add-case", f"{e}.{n}")
    for e, order in d.case_orders.items():
        add("reorder-cases", e, ", ".join(order))
    for (e, c), policy in d.removed_cases.items():
        add("remove-case", f"{e}.{c}", policy[1] if isinstance(policy, tuple) else "", "B", "values of the case", policy_name(policy) if policy else "")
        if policy is None:
            out.warnings.append(f"{e}.{c} is removed, and no policy is named")
    for t in d.dropped_types:
        add("drop-type", t)
    for n in d.dropped_attachments:
        for a in attachments_named(source, n):
            add("drop-attachment", a.id, loss_class="B", loss="all documents of the attachment", policy="accepted" if d.attachment_drops_accepted else "")
    for what, *rest in d.docs:
        add(f"document-{what}", ".".join(rest))
    _hints(source, d, out)
    return out


def _hints(source: Catalog, d: Directives, out: Plan) -> None:
    """A dropped field beside an added one of its type may be a rename that was forgotten; several
    cases that become one cannot be told apart again."""
    for s, f in d.dropped_fields:
        have = source.struct(s) and source.struct(s).field(f)
        for a in d.added.get(s, ()):
            if have and a.type == have.type and a.derive is None:
                out.warnings.append(f"{s}: {f} is dropped and {a.name} of the same type added; was a rename meant?")
    into: dict[tuple[str, str], list[str]] = {}
    for (e, c), p in d.removed_cases.items():
        if isinstance(p, tuple):
            into.setdefault((e, p[1]), []).append(c)
    for (e, c), old in into.items():
        out.warnings.append(f"{e}: {', '.join(old)} can no longer be told from {c}")


def format_plan(p: Plan) -> str:
    lines = [f"[{c.loss_class}] {c.kind} {c.target}" + (f" ({c.detail})" if c.detail else "") + (f": {c.loss}" if c.loss else "") + (f" [{c.policy}]" if c.policy else "") for c in p.changes]
    return "\n".join([*(lines or ["nothing changes"]), *(f"warning: {w}" for w in p.warnings)])
