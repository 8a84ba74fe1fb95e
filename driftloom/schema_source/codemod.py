"""Applies an edit script to schema source text.

The text is parsed to a lossless tree and read as a catalog; the script builds the target catalog;
the tree is edited in place, so blanks and comments stay; and before anything is written, the new
text is parsed again and its catalog's digest compared with the target's.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

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
from driftloom.catalog.types import CONTAINERS, PRIMITIVES, Type, parse as parse_type
from driftloom.functions.nodes import Refused
from driftloom.plans.build import Migration, build
from driftloom.plans.directives import Directives
from driftloom.schema_source.syntax import Block, Declaration, Member, Source, TypeText, Word, parse

_BUILT_IN = {*PRIMITIVES, *CONTAINERS, "key", "any", "mutable"}
_QUOTES = '"""'


class Tree:
    """The parsed files of a schema, by name."""

    def __init__(self, files: dict[str, str]):
        self.files = {name: parse(text) for name, text in sorted(files.items())}
        self.known = {f"{b.name.text}::{d.name.text}" for b in self.blocks("namespace") for d in b.items if d.kind != "attachment"}

    def blocks(self, kind: str | None = None) -> list[Block]:
        return [b for s in self.files.values() for b in s.blocks if kind in (None, b.kind) or kind == "pool" and b.kind != "namespace"]

    def resolve(self, name: str, space: str) -> str:
        """The full name of a reference in a namespace; a bare name elsewhere must be unambiguous."""
        if name in _BUILT_IN or name in self.known:
            return name
        own = f"{space}::{name}"
        if own in self.known:
            return own
        found = [n for n in self.known if local_name(n) == name]
        if len(found) != 1:
            raise Refused(f"[reference] {name} in {space or 'a pool'}: " + (f"could be {', '.join(sorted(found))}" if found else "unknown"))
        return found[0]

    def type(self, t: TypeText, space: str) -> Type:
        return _keyed(parse_type(t.renamed(lambda n: self.resolve(n, space)).bare()))

    def catalog(self) -> Catalog:
        spaces, concepts, clubs, enums, structs, attachments = {}, [], [], [], [], []
        for b in self.blocks("namespace"):
            space = b.name.text
            spaces.setdefault(space, Namespace(space, b.uuid[1].text))
            for d in b.items:
                name, doc = f"{space}::{d.name.text}", _doc_text(d.doc)
                match d.kind:
                    case "concept":
                        concepts.append(Concept(name, self.resolve(d.after[2].bare(), space) if d.after else "", doc))
                    case "club":
                        clubs.append(Club(name, tuple(self.resolve(m.type.bare(), space) for m in d.members), doc))
                    case "enum":
                        enums.append(Enum(name, tuple(Case(m.name.text, _doc_text(m.doc)) for m in d.members), doc))
                    case "struct":
                        structs.append(Struct(name, tuple(Field(m.name.text, self.type(m.type, space), _doc_text(m.doc), _default(m)) for m in d.members), doc))
                    case "attachment":
                        document = self.type(d.head[4], space)
                        if document.kind != "ref":  # a document that is no structure stands in one of its own
                            held = f"{space}::_{''.join(c if c.isalnum() else '_' for c in str(document))}"
                            if all(s.name != held for s in structs):
                                structs.append(Struct(held, (Field("value", document),)))
                            document = Type("ref", name=held)
                        attachments.append(Attachment(space, d.name.text, self.resolve(d.head[2].bare(), space), document.name, doc=doc))
        return Catalog(tuple(spaces.values()), tuple(concepts), tuple(clubs), tuple(enums), tuple(structs), tuple(attachments))


def _keyed(t: Type) -> Type:
    """key<any> is a key to any concept."""
    return Type(t.kind, tuple(map(_keyed, t.args)), "" if t.kind == "key" and t.name in ("any", "any_concept") else t.name, t.dims)


def _doc_text(w: Word | None) -> str:
    return w.text[3:-3].strip() if w else ""


def _default(m: Member):
    """The literal after =, as a value; text that is no JSON stays text."""
    if not m.tail or m.tail[0].text != "=":
        return NO_DEFAULT
    text = "".join(w.text for w in m.tail[1:-1])
    try:
        return json.loads(text)
    except ValueError:
        return text


def render_literal(v) -> str:
    return json.dumps(v, ensure_ascii=False)


class Codemod:
    def __init__(self, tree: Tree, m: Migration):
        self.tree, self.m, self.d = tree, m, m.directives
        self.notes: list[str] = []

    def check_pools(self) -> None:
        """Pool signatures that name a dropped type, all of them."""
        out = []
        for b in self.tree.blocks("pool"):
            for f in b.items:
                for t in (f.type, *f.params):
                    out += [f"[pool] {b.name.text}.{f.name.text} names dropped {n}" for _, _, x in t.names() if (n := self.tree.resolve(x, "")) in self.d.dropped_types]
        if out:
            raise Refused(out)

    def reference(self, name: str, space: str, new_space: str) -> str:
        """A reference as it must read in the target: qualified where it was, or where it or its
        place has moved to another namespace."""
        if name in _BUILT_IN:
            return name
        full = self.tree.resolve(name, space)
        new = self.m.names.get(full, full)
        if new == full and ("::" in name or space == new_space):
            return name
        if "::" in name or namespace_of(new) != new_space:
            return new
        return local_name(new)

    def type_text(self, t: TypeText, space: str, new_space: str) -> TypeText:
        return t.renamed(lambda n: self.reference(n, space, new_space))

    def written(self, t: Type, space: str) -> str:
        """A target type as source text."""
        def name(n: str) -> str:
            return local_name(n) if namespace_of(n) == space else n

        if t.kind == "ref":
            return name(t.name)
        if t.kind == "key":
            return f"key<{name(t.name) if t.name else 'any'}>"
        inner = [*(self.written(a, space) for a in t.args), *map(str, t.dims)]
        return f"{t.kind}<{','.join(inner)}>" if inner else t.kind

    def run(self) -> None:
        moved: list[tuple[str, Declaration, Source]] = []
        spaces = {n.name: self.d.namespace_names.get(n.name, n.name) for n in self.m.source.namespaces}
        for source in self.tree.files.values():
            for b in source.blocks:
                if b.kind == "namespace":
                    self._namespace(b, spaces[b.name.text], moved, source)
                else:
                    self._pool(b)
        for space, d, source in moved:
            self._place(space, d, source)

    def _namespace(self, b: Block, new_space: str, moved: list, source: Source) -> None:
        space, kept = b.name.text, []
        for d in b.items:
            full = f"{space}::{d.name.text}"
            if d.kind == "attachment":
                home = self._attachment(d, space)
            elif full in self.d.dropped_types:
                home = None
            else:
                home = namespace_of(self.m.names[full])
                self._type(d, full, space, home)
            if home is None:
                continue
            if home == new_space:
                kept.append(d)
            else:
                moved.append((home, d, source))
        b.items = kept
        b.name = Word(b.name.blank, new_space)
        if space in self.d.namespace_uuids:
            b.uuid[1] = Word(b.uuid[1].blank, self.d.namespace_uuids[space])

    def _attachment(self, d: Declaration, space: str) -> str | None:
        concept = self.tree.resolve(d.head[2].bare(), space)
        found = next(a for a in self.m.source.attachments if a.namespace == space and a.name == d.name.text and a.concept == concept)
        if found.id not in self.m.attachments:
            return None
        target = next(a for a in self.m.target.attachments if a.id == self.m.attachments[found.id])
        for k in (2, 4):
            d.head[k] = self.type_text(d.head[k], space, target.namespace)
        d.name = Word(d.name.blank, target.name)
        self._doc(d, d.head[0], target.doc, found.doc)
        return target.namespace

    def _type(self, d: Declaration, full: str, space: str, home: str) -> None:
        m, new = self.m, self.m.names[full]
        source, target = m.source.definition(full), m.target.definition(new)
        if d.kind == "concept" and d.after:
            d.after[2] = self.type_text(d.after[2], space, home)
        elif d.kind == "club":
            for x in d.members:
                x.type = self.type_text(x.type, space, home)
        elif d.kind == "enum":
            self._enum(d, full, target)
        elif d.kind == "struct":
            self._struct(d, source, target, space, home)
        d.name = Word(d.name.blank, local_name(new))
        self._doc(d, d.head[0], target.doc, source.doc)

    def _enum(self, d: Declaration, full: str, target: Enum) -> None:
        old = {self.d.case_names.get((full, x.name.text), x.name.text): x for x in d.members if (full, x.name.text) not in self.d.removed_cases}
        out = []
        for c in target.cases:
            x = old.get(c.name)
            if x is None:
                x = Member(None, None, Word(self._indent(d), c.name))
                before = ""
            else:
                before = _doc_text(x.doc)
                x.name = Word(x.name.blank, c.name)
            self._member_doc(x, c.doc, before)
            out.append(x)
        d.members = out

    def _struct(self, d: Declaration, source: Struct, target: Struct, space: str, home: str) -> None:
        old = {self.d.field_names.get((source.name, x.name.text), x.name.text): x for x in d.members if (source.name, x.name.text) not in self.d.dropped_fields}
        out = []
        for f in target.fields:
            x = old.get(f.name)
            if x is None:
                words = [Word(self._indent(d), self.written(f.type, home))]
                value = [Word(" ", "="), Word(" ", render_literal(f.default))] if f.has_default and f.default is not None else []
                x, before = Member(None, TypeText(words), Word(" ", f.name), [*value, Word("", ";")]), ""
            else:
                s, before = source.field(x.name.text), _doc_text(x.doc)
                if self.m.image(s.type) != f.type:
                    x.type = TypeText([Word(x.type.words[0].blank, self.written(f.type, home))])
                else:
                    x.type = self.type_text(x.type, space, home)
                if s.has_default and not f.has_default:
                    x.tail = [x.tail[-1]]  # a default was written for the old type
                x.name = Word(x.name.blank, f.name)
            self._member_doc(x, f.doc, before)
            out.append(x)
        d.members = out

    @staticmethod
    def _indent(d: Declaration) -> str:
        """The blanks before an existing member; four spaces where there is none."""
        for x in d.members or ():
            first = x.doc or (x.type.words[0] if x.type else x.name)
            return "\n" + first.blank.rpartition("\n")[2] if "\n" in first.blank else first.blank or " "
        return "\n    "

    @staticmethod
    def _doc_word(text: str, blank: str) -> Word:
        indent = blank.rpartition("\n")[2] if "\n" in blank else ""
        return Word(blank, _QUOTES + text.replace("\n", "\n" + indent) + _QUOTES)

    def _doc(self, d: Declaration, head: Word, new: str, old: str) -> None:
        if new == old:
            return
        if d.doc and new:
            d.doc = self._doc_word(new, d.doc.blank)
        elif d.doc:
            d.head[0], d.doc = Word(d.doc.blank, head.text), None
        else:
            d.doc = self._doc_word(new, head.blank)
            d.head[0] = Word("\n" + head.blank.rpartition("\n")[2], head.text)

    def _member_doc(self, x: Member, new: str, old: str) -> None:
        if new == old:
            return
        first = x.type.words[0] if x.type else x.name
        if x.doc and new:
            x.doc = self._doc_word(new, x.doc.blank)
            return
        if x.doc:
            blank, x.doc = x.doc.blank, None
        else:
            x.doc, blank = self._doc_word(new, first.blank), "\n" + first.blank.rpartition("\n")[2]
        if x.type:
            x.type.words[0] = Word(blank, first.text)
        else:
            x.name = Word(blank, first.text)

    def _place(self, space: str, d: Declaration, source: Source) -> None:
        """Into a block of the namespace, of the same file if there is one; or into a new block."""
        blocks = [b for b in source.blocks if b.kind == "namespace" and b.name.text == space] or [b for b in self.tree.blocks("namespace") if b.name.text == space]
        if not blocks:
            uuid = next(n.uuid for n in self.m.target.namespaces if n.name == space)
            block = Block("namespace", None, Word("\n\n" if source.blocks else "", "namespace"), Word(" ", space), [Word(" ", "{"), Word("", uuid), Word("", "}"), Word(" ", "{")], [], [Word("\n\n", "}"), Word("", ";")])
            source.blocks.append(block)
            blocks = [block]
        first = d.doc or d.head[0]
        first.blank = "\n\n" + first.blank.rpartition("\n")[2]
        blocks[0].items.append(d)

    def _pool(self, b: Block) -> None:
        for f in b.items:
            before = str(f)
            f.type = self.type_text(f.type, "", "")
            f.body = [self.type_text(x, "", "") if isinstance(x, TypeText) else x for x in f.body]
            if str(f) != before:
                self.notes.append(f"{b.name.text}.{f.name.text}: the signature changes to {' '.join(str(f).split())}")


def rewrite(files: dict[str, str], script: Directives, *, check: bool = True, on_note: Callable[[str], None] | None = None) -> dict[str, str]:
    """The files with the script applied. Refuses if the new text does not read as the target."""
    tree = Tree(files)
    if any(str(s) != files[n] for n, s in tree.files.items()):
        raise Refused("[syntax] the text does not print back as it was read")
    m = build(tree.catalog(), script)
    mod = Codemod(tree, m)
    mod.check_pools()
    mod.run()
    out = {name: str(s) for name, s in tree.files.items()}
    if check:
        found = Tree(out)
        found.catalog()
        if found.catalog().digest() != _without_held(m.target).digest():
            raise Refused("[digest] the new text does not read as the target catalog")
        for b in found.blocks("pool"):
            for f in b.items:
                for t in (f.type, *f.params):
                    t.renamed(lambda n: found.resolve(n, ""))
    for note in mod.notes:
        if on_note:
            on_note(note)
    return out


def _without_held(c: Catalog) -> Catalog:
    """Structures that stand for plain documents go with their last attachment."""
    used = {a.document for a in c.attachments}
    return Catalog(c.namespaces, c.concepts, c.clubs, c.enums, tuple(s for s in c.structs if not local_name(s.name).startswith("_") or s.name in used), c.attachments)


def rewrite_folder(source: str, script: Directives, target: str, *, check: bool = True, force: bool = False, on_note: Callable[[str], None] | None = None) -> list[str]:
    """All .dsm files of a folder to another folder; nothing is written unless everything is right."""
    root, out = Path(source), Path(target)
    if out.exists() and any(out.iterdir()) and not force:
        raise FileExistsError(f"{target} is not empty")
    new = rewrite({str(p.relative_to(root)): p.read_text(encoding="utf-8") for p in root.rglob("*.dsm")}, script, check=check, on_note=on_note)
    for name, text in new.items():
        (out / name).parent.mkdir(parents=True, exist_ok=True)
        (out / name).write_text(text, encoding="utf-8")
    return sorted(new)
