"""A lossless syntax tree of schema source text.

Every node keeps the blanks and comments that stand before its parts, so printing an unchanged tree
gives the text back, character by character. Edits replace parts of the tree.

    namespace Shop {uuid} {
    \"\"\"doc\"\"\" concept Customer;            concept Vip is a Customer;      club Any { Customer, Vip };
    enum Status { pending, shipped };
    struct Order { key<Customer> buyer; uint32 quantity = 1; };
    attachment<Customer, Order> orders;
    };
    function_pool Tools {uuid} { Shop::Order summarise(Shop::Order o); };
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(r'''(?P<blank>(?:\s|//[^\n]*|/\*.*?\*/)*)(?P<text>"""(?:.*?)"""|"(?:\\.|[^"\\])*"|::|[A-Za-z_][A-Za-z0-9_]*|-?[0-9][0-9A-Za-z_.+-]*|[{}<>(),;=.\[\]]|$)''', re.S)
_UUID = re.compile(r"(\s*)([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})")


class SyntaxFault(ValueError):
    pass


@dataclass
class Word:
    blank: str
    text: str

    def __str__(self) -> str:
        return self.blank + self.text


@dataclass
class TypeText:
    """Words of a type; a qualified name is several words."""

    words: list[Word]

    def __str__(self) -> str:
        return "".join(map(str, self.words))

    def bare(self) -> str:
        return "".join(w.text for w in self.words)

    def names(self) -> Iterator[tuple[int, int, str]]:
        """(first word, end, name) of the names in the type, containers included."""
        i = 0
        while i < len(self.words):
            if re.match(r"[A-Za-z_]", self.words[i].text):
                j = i + 1
                while j + 1 < len(self.words) and self.words[j].text == "::":
                    j += 2
                yield i, j, "".join(w.text for w in self.words[i:j])
                i = j
            else:
                i += 1

    def renamed(self, f: Callable[[str], str]) -> TypeText:
        out, last = [], 0
        for i, j, name in self.names():
            out += self.words[last:i]
            new = f(name)
            out += self.words[i:j] if new == name else [Word(self.words[i].blank, new)]
            last = j
        return TypeText(out + self.words[last:])


@dataclass
class Member:
    """A field, case or pool function: doc, type, name and what follows the name."""

    doc: Word | None
    type: TypeText | None
    name: Word
    tail: list[Word] = field(default_factory=list)
    params: list[TypeText] = field(default_factory=list)  # types inside the tail of a function
    body: list = field(default_factory=list)  # the tail of a function, words and types

    def __str__(self) -> str:
        return "".join(map(str, [*([self.doc] if self.doc else []), *([self.type] if self.type else []), self.name, *(self.body or self.tail)]))


@dataclass
class Declaration:
    """``head`` is what stands before the name: the keyword, for attachments the types as well."""

    kind: str
    doc: Word | None
    head: list
    name: Word
    after: list = field(default_factory=list)  # words and type texts between the name and the members
    members: list[Member] | None = None
    close: list[Word] = field(default_factory=list)

    def __str__(self) -> str:
        sep = "," if self.kind in ("enum", "club") else ""
        body = sep.join(map(str, self.members)) if self.members is not None else ""
        return "".join(map(str, [*([self.doc] if self.doc else []), *self.head, self.name, *self.after])) + body + "".join(map(str, self.close))


@dataclass
class Block:
    """A namespace, or a pool (whose declarations are its functions)."""

    kind: str
    doc: Word | None
    keyword: Word
    name: Word
    uuid: list[Word]
    items: list
    close: list[Word]

    def __str__(self) -> str:
        return "".join(map(str, [*([self.doc] if self.doc else []), self.keyword, self.name, *self.uuid, *self.items, *self.close]))


@dataclass
class Source:
    blocks: list[Block]
    end: str

    def __str__(self) -> str:
        return "".join(map(str, self.blocks)) + self.end


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> Word:
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise SyntaxFault(f"cannot read {self.text[self.at:self.at + 30]!r}")
        return Word(m["blank"], m["text"])

    def next(self, *want: str) -> Word:
        w = self.peek()
        if want and w.text not in want:
            line = self.text.count("\n", 0, self.at) + 1
            raise SyntaxFault(f"line {line}: {w.text!r} where {' or '.join(want)} should be")
        self.at += len(w.blank) + len(w.text)
        return w

    def name(self) -> Word:
        w = self.next()
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", w.text):
            raise SyntaxFault(f"{w.text!r} is no name")
        return w

    def doc(self) -> Word | None:
        return self.next() if self.peek().text.startswith('"""') else None

    def uuid(self) -> list[Word]:
        out = [self.next("{")]
        m = _UUID.match(self.text, self.at)
        if not m:
            raise SyntaxFault("a UUID is missing")
        self.at = m.end()
        return [*out, Word(m[1], m[2]), self.next("}"), self.next("{")]

    def type(self) -> TypeText:
        words, depth = [self.name()], 0
        while True:
            t = self.peek().text
            if t == "::":
                words += [self.next(), self.name()]
            elif t == "<":
                depth += 1
                words.append(self.next())
            elif depth and t in (",", ">"):
                depth -= t == ">"
                words.append(self.next())
            elif depth and re.match(r"[A-Za-z_0-9]", t):
                words.append(self.next())
            else:
                return TypeText(words)


def parse(text: str) -> Source:
    r, blocks = _Reader(text), []
    while r.peek().text or r.peek().blank != text[r.at:]:
        if not r.peek().text:
            break
        blocks.append(_block(r))
    return Source(blocks, text[r.at:])


def _block(r: _Reader) -> Block:
    doc = r.doc()
    keyword = r.next("namespace", "function_pool", "attachment_function_pool")
    name, uuid, items = r.name(), r.uuid(), []
    while r.peek().text != "}":
        items.append(_declaration(r) if keyword.text == "namespace" else _function(r))
    return Block(keyword.text, doc, keyword, name, uuid, items, [r.next("}"), r.next(";")])


def _function(r: _Reader) -> Member:
    doc = r.doc()
    mutable = [r.next()] if r.peek().text == "mutable" else []
    kind, name = r.type(), r.name()
    kind.words[:0] = mutable
    body: list = [r.next("(")]
    while r.peek().text != ")":
        body += [r.type(), r.name()]
        if r.peek().text == ",":
            body.append(r.next())
    body += [r.next(")"), r.next(";")]
    return Member(doc, kind, name, params=[x for x in body if isinstance(x, TypeText)], body=body)


def _declaration(r: _Reader) -> Declaration:
    doc, keyword = r.doc(), r.next("concept", "club", "enum", "struct", "attachment")
    kind = keyword.text
    if kind == "attachment":
        head = [keyword, r.next("<"), r.type(), r.next(","), r.type(), r.next(">")]
        return Declaration(kind, doc, head, r.name(), close=[r.next(";")])
    name, after = r.name(), []
    if kind == "concept":
        if r.peek().text == "is":
            after = [r.next(), r.next("a"), r.type()]
        return Declaration(kind, doc, [keyword], name, after, close=[r.next(";")])
    after, members = [r.next("{")], []
    while r.peek().text != "}":
        members.append(_member(r, kind))
        if kind != "struct" and r.peek().text != "}":
            r.next(",")
    return Declaration(kind, doc, [keyword], name, after, members, [r.next("}"), r.next(";")])


def _member(r: _Reader, kind: str) -> Member:
    doc = r.doc()
    if kind == "club":
        t = r.type()
        return Member(doc, t, Word("", ""))
    if kind == "enum":
        return Member(doc, None, r.name())
    t, name, tail = r.type(), r.name(), []
    while r.peek().text not in (";", ""):
        tail.append(r.next())
    return Member(doc, t, name, [*tail, r.next(";")])
