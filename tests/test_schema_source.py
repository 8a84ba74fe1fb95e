"""The schema source codemod: text in, text out, everything else untouched."""

import pytest

from driftloom.catalog import types as T
from driftloom.functions.nodes import Refused
from driftloom.plans.directives import Directives, map_case
from driftloom.schema_source.codemod import Tree, rewrite, rewrite_folder
from driftloom.schema_source.syntax import SyntaxFault, parse

STORE = '''// the stock of a small museum
namespace Museum {aaaaaaaa-1111-2222-3333-444444444444} {

"""Somebody who lends."""
concept Lender;
concept Gallery is a Lender;
club Party { Lender, Gallery };

/* how a piece is kept */
enum Care {
    """Untouched."""
    raw,
    framed,   // behind glass
    lost
};

struct Piece {
    key<Lender> owner;
    uint32 height = 10;
    uint16 code;
    vec<float,3> place;
    string tag = "a } brace { here";
    Care care;
};

attachment<Lender, Piece> pieces;
attachment<Lender, uint32> visits;
};
'''
TOOLS = '''function_pool Desk {bbbbbbbb-1111-2222-3333-444444444444} {
  """say what it is"""
  string label(Museum::Piece p, Museum::Care c);
  mutable float weigh(Piece p);
};
'''
FILES = {"store.dsm": STORE, "tools.dsm": TOOLS}
P = "Museum::Piece"


def test_text_round_trips():
    assert str(parse(STORE)) == STORE and str(parse(TOOLS)) == TOOLS and rewrite(FILES, Directives()) == FILES
    c = Tree(FILES).catalog()
    assert c.struct(P).field("height").default == 10 and c.concepts[1].parent == "Museum::Lender" and [a.name for a in c.attachments] == ["pieces", "visits"]
    with pytest.raises(SyntaxFault):
        parse("namespace X { }")


def changed(script, **kw):
    return rewrite(FILES, script, **kw)


def test_renames():
    out = changed(Directives().rename_type(P, "Work").rename_field(P, "height", "tall").rename_case("Museum::Care", "raw", "bare").rename_type("Museum::Care", "State"))
    s = out["store.dsm"]
    assert "struct Work {" in s and "uint32 tall = 10;" in s and "attachment<Lender, Work> pieces;" in s and "State care;" in s and '"""Untouched."""\n    bare,' in s
    assert "Museum::Work p, Museum::State c" in out["tools.dsm"] and "weigh(Museum::Work p)" in out["tools.dsm"] or "weigh(Work p)" in out["tools.dsm"]
    assert "// the stock" in s and "// behind glass" in s


def test_fields():
    d = Directives().retype_field(P, "height", T.prim("uint64")).drop_field(P, "code").add_field(P, "year", T.INT32, 1900).resize_vec_field(P, "place", 4)
    s = changed(d)["store.dsm"]
    assert "uint64 height;" in s and "code" not in s and "    int32 year = 1900;\n};" in s and "vec<float,4> place;" in s
    d.reorder_fields(P, ["year", "care", "tag", "place", "height", "owner"])
    s = changed(d)["store.dsm"]
    assert s.index("year") < s.index("Care care") < s.index("string tag") < s.index("vec<float,4>") < s.index("uint64 height") < s.index("key<Lender> owner")


def test_cases():
    s = changed(Directives().add_case("Museum::Care", "sold").remove_case("Museum::Care", "framed", map_case("raw")))["store.dsm"]
    assert "raw,\n    lost,\n    sold" in s or "lost,\n    sold" in s and "framed" not in s
    s = changed(Directives().reorder_cases("Museum::Care", ["lost", "raw", "framed"]))["store.dsm"]
    assert s.index("lost") < s.index('"""Untouched."""') < s.index("framed")


def test_docs():
    d = Directives().document_type("Museum::Lender", "").document_type(P, "One piece.").document_field(P, "code", "Old number.").document_case("Museum::Care", "lost", "Gone.").document_attachment("pieces", "All of them.")
    s = changed(d)["store.dsm"]
    assert "Somebody" not in s and '"""One piece."""\nstruct Piece' in s and '    """Old number."""\n    uint16 code;' in s and '"""Gone."""\n    lost' in s and '"""All of them."""\nattachment' in s
    c = Tree({"s": s}).catalog()
    assert c.struct(P).doc == "One piece." and c.concepts[0].doc == ""


def test_namespaces_and_moves():
    out = changed(Directives().rename_namespace("Museum", "House").remap_namespace("Museum", "cccccccc-1111-2222-3333-444444444444"))
    assert "namespace House {cccccccc" in out["store.dsm"] and "House::Piece p" in out["tools.dsm"]
    d = Directives().move_type("Museum::Care", "Care").remap_namespace("Care", "dddddddd-1111-2222-3333-444444444444")
    s = changed(d)
    assert "namespace Care {dddddddd" in s["store.dsm"] and "Care::Care care;" in s["store.dsm"] and "Care::Care c" in s["tools.dsm"]
    d = Directives().move_attachment("pieces", "Other").remap_namespace("Other", "eeeeeeee-1111-2222-3333-444444444444")
    assert "attachment<Museum::Lender, Museum::Piece> pieces;" in changed(d)["store.dsm"]


def test_attachments():
    s = changed(Directives().rename_attachment("pieces", "works").drop_attachment("visits"))["store.dsm"]
    assert "works;" in s and "visits" not in s


def test_pools():
    with pytest.raises(Refused) as e:
        changed(Directives().drop_type(P).drop_attachment("pieces"))
    assert len(e.value.problems) == 2 and all("[pool]" in p for p in e.value.problems)
    notes = []
    changed(Directives().rename_type(P, "Work"), on_note=notes.append)
    assert len(notes) == 2 and "label" in notes[0]


def test_folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    d = Directives().rename_type(P, "Work")
    assert rewrite_folder(str(tmp_path / "in"), d, str(tmp_path / "out")) == ["store.dsm", "tools.dsm"]
    assert "Work" in (tmp_path / "out/store.dsm").read_text()
    with pytest.raises(FileExistsError):
        rewrite_folder(str(tmp_path / "in"), d, str(tmp_path / "out"))
