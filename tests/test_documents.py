"""Edit scripts, checks, hooks, stores, dry runs and verification."""

from dataclasses import replace

import pytest
from helpers import DEMO, DOC, catalog, frame, rewritten
from pyspark.sql import functions as F

from driftloom.catalog import types as T
from driftloom.catalog.catalog import Attachment, Case, Catalog, Club, Concept, Enum, Field, Namespace, Struct, catalog_of_tables
from driftloom.functions.nodes import Refused
from driftloom.migrate import VerificationError, dry_run, migrate, run, verify
from driftloom.operators.diagnostics import format_report
from driftloom.operators.projection import Compiler, Unless
from driftloom.plans.build import build, build_for
from driftloom.plans.directives import Directives, default, map_case
from driftloom.plans.report import format_plan, plan
from driftloom.sources.store import Store, create

MODE = Enum("Demo::Mode", (Case("Old"), Case("New"), Case("Off")))
INNER = Struct("Demo::Inner", (Field("x", T.optional(T.INT32)), Field("mode", T.ref("Demo::Mode"))))


# --- Types and catalogs ---

@pytest.mark.parametrize("t", [
    T.INT32, T.vec(T.FLOAT, 3), T.mat(T.DOUBLE, 2, 3), T.optional(T.optional(T.STRING)), T.map_of(T.STRING, T.vector(T.ref("Demo::Mode"))), T.xarray(T.key("Demo::C")),
    T.tuple_of(T.INT32, T.STRING), T.variant(T.INT32, T.set_of(T.STRING)), T.ANY, T.key()])
def test_types_round_trip(t):
    assert T.parse(str(t)) == t


def test_catalog_round_trips_and_fingerprints():
    c = catalog({"a": T.INT32, "m": T.ref("Demo::Mode")}, [MODE])
    again = Catalog.from_json(c.to_json())
    assert again == c and again.digest() == c.digest()
    d = lambda s: build(c, s).target.digest()
    assert d(Directives().document_field(DOC, "a", "text")) == c.digest()
    assert d(Directives().rename_namespace("Demo", "Other")) == c.digest()
    assert d(Directives().remap_namespace("Demo", "22222222-2222-2222-2222-222222222222")) != c.digest()
    assert d(Directives().rename_field(DOC, "a", "b")) != c.digest() != d(Directives().reorder_fields(DOC, ["m", "a"]))


def test_catalogs_are_checked():
    with pytest.raises(ValueError, match="cycle"):
        Catalog((DEMO,), structs=(Struct("Demo::A", (Field("b", T.ref("Demo::B")),)), Struct("Demo::B", (Field("a", T.vector(T.ref("Demo::A"))),))))
    with pytest.raises(ValueError, match="parent cycle"):
        Catalog((DEMO,), (Concept("Demo::A", "Demo::B"), Concept("Demo::B", "Demo::A")))
    with pytest.raises(ValueError, match="undefined"):
        catalog({"a": T.ref("Demo::Nothing")})


def test_catalog_of_tables(spark):
    df = spark.createDataFrame([(1, "a", 2.0, [1])], "k long, s string, d double, v array<int>")
    c = catalog_of_tables(DEMO, {"my_table": (df.schema, "k")})
    assert [(f.name, str(f.type)) for f in c.struct("Demo::MyTableDoc").fields] == [("s", "string"), ("d", "double"), ("v", "vector<int32>")]


# --- Scripts ---

def test_fields(spark):
    c = catalog({"a": T.INT32, "b": T.STRING, "gone": T.INT32})
    d = Directives().rename_field(DOC, "a", "z").drop_field(DOC, "gone").add_field(DOC, "n", T.INT64, 7).add_field(DOC, "nil", T.optional(T.STRING))
    d.add_field(DOC, "sum", T.INT32, derive=lambda s, name, t: s.a + s.gone).reorder_fields(DOC, ["sum", "z", "b", "n", "nil"])
    assert [f.name for f in build(c, d).target.struct(DOC).fields] == ["sum", "z", "b", "n", "nil"]
    assert rewritten(spark, c, d, [("k", 1, "x", 5)]) == {"k": {"sum": 6, "z": 1, "b": "x", "n": 7, "nil": None}}


def test_defaults_are_carried():
    c = Catalog((DEMO,), structs=(Struct(DOC, (Field("a", T.INT32, default=4), Field("b", T.INT32, default=5))),))
    t = build(c, Directives().rename_field(DOC, "a", "z").retype_field(DOC, "b", T.INT64)).target.struct(DOC)
    assert t.field("z").default == 4 and not t.field("b").has_default


def test_cases_and_nesting(spark):
    c = catalog({"mode": T.ref("Demo::Mode"), "inner": T.ref("Demo::Inner"), "many": T.vector(T.ref("Demo::Inner")), "by": T.map_of(T.STRING, T.ref("Demo::Mode"))}, [MODE], [INNER])
    d = Directives().rename_case("Demo::Mode", "Old", "Older").remove_case("Demo::Mode", "Off", map_case("New")).add_case("Demo::Mode", "Next").reorder_cases("Demo::Mode", ["Next", "New", "Older"])
    d.rename_type("Demo::Inner", "Part").rename_field("Demo::Inner", "x", "y")
    row = ("k", "Off", (1, "Old"), [(None, "New"), (2, "Off")], {"a": "Old", "b": "Off"})
    assert rewritten(spark, c, d, [row])["k"] == {
        "mode": "New", "inner": {"y": 1, "mode": "Older"}, "many": [{"y": None, "mode": "New"}, {"y": 2, "mode": "New"}], "by": {"a": "Older", "b": "New"}}
    assert build(c, d).target.enum("Demo::Mode").names == ["Next", "New", "Older"]


def test_enum_map_keys_collide(spark):
    c = catalog({"m": T.map_of(T.ref("Demo::Mode"), T.INT32)}, [MODE])
    d = Directives().remove_case("Demo::Mode", "Old", map_case("New"))
    row = [("k", {"Old": 1, "New": 2})]
    with pytest.raises(Exception, match="map-collision"):
        rewritten(spark, c, d, row)
    assert rewritten(spark, c, d.resolve_collisions("first"), row)["k"]["m"] in ({"New": 1}, {"New": 2})


def test_removed_case_policies(spark):
    c = catalog({"mode": T.ref("Demo::Mode")}, [MODE])
    rows = [("a", "Off"), ("b", "New")]
    assert set(rewritten(spark, c, Directives().remove_case("Demo::Mode", "Off", "drop-record"), rows)) == {"b"}
    with pytest.raises(Exception, match="remove-case"):
        rewritten(spark, c, Directives().remove_case("Demo::Mode", "Off", "fail"), rows)
    with pytest.raises(Refused, match="policy"):
        build(c, Directives().remove_case("Demo::Mode", "Off"))


def test_first_event_decides(spark):
    """A record that is dropped by an earlier field is not refused by a later one, and the reverse."""
    c = catalog({"a": T.optional(T.INT32), "b": T.INT64})
    rows = [("x", None, 2**40), ("y", 1, 5)]
    d = Directives().retype_field(DOC, "a", T.INT32, "drop-record").retype_field(DOC, "b", T.INT32, "fail")
    assert set(rewritten(spark, c, d, rows)) == {"y"}
    with pytest.raises(Exception, match="narrow"):
        rewritten(spark, c, d.reorder_fields(DOC, ["b", "a"]), rows)


def test_names_and_namespaces():
    c = catalog({"m": T.ref("Demo::Mode"), "k": T.key("Demo::C")}, [MODE], attachments=[Attachment("Demo", "Notes", "Demo::C", DOC)], clubs=[Club("Demo::All", ("Demo::C",))])
    t = build(c, Directives().rename_type("Demo::Mode", "Kind").rename_type("Demo::C", "Thing").rename_namespace("Demo", "Shop").rename_attachment("Docs", "Papers")).target
    assert t.enum("Shop::Kind") and t.struct("Shop::Doc").field("k").type == T.key("Shop::Thing") and {a.id for a in t.attachments} == {"Shop::Thing.Papers", "Shop::Thing.Notes"}
    assert t.clubs[0].members == ("Shop::Thing",)
    t = build(c, Directives().move_type("Demo::Mode", "New").move_attachment("Notes", "New").remap_namespace("New", "33333333-3333-3333-3333-333333333333")).target
    assert t.enum("New::Mode") and t.struct(DOC).field("m").type == T.ref("New::Mode") and "New::C.Notes" in {a.id for a in t.attachments}


def test_keys_and_dynamic_values(spark):
    c = catalog({"k": T.key("Demo::C"), "any": T.ANY}, structs=[Struct("Demo::Money", (Field("amount", T.INT64),))])
    d = Directives().rename_type("Demo::C", "Thing").rename_field("Demo::Money", "amount", "value").retype_field("Demo::Money", "amount", T.prim("int8"), "saturate")
    key = ("concept", "Demo::C", "Demo::C", "7")
    got = rewritten(spark, c, d, [("a", key, ("Demo::Money", '{"amount":900}')), ("b", key, ("int32", "5"))])
    assert got["a"] == {"k": {"flavour": "concept", "type": "Demo::Thing", "concept": "Demo::Thing", "instance_id": "7"}, "any": {"type_id": "Demo::Money", "value": '{"value":127}'}}
    assert got["b"]["any"] == {"type_id": "int32", "value": "5"}
    with pytest.raises(Exception, match="unknown type"):
        rewritten(spark, c, d, [("a", key, ("Demo::Lost", "{}"))])


# --- Refusals ---

def test_all_unknown_targets_are_reported():
    d = Directives().rename_type("Demo::No", "X").rename_field(DOC, "no", "x").rename_case("Demo::Mode", "No", "x").drop_attachment("No").rename_namespace("No", "X").document_field(DOC, "nope", "d").move_type("Demo::Mode", "Nowhere")
    with pytest.raises(Refused) as e:
        build(catalog({"a": T.INT32}, [MODE]), d)
    assert len(e.value.problems) == 7 and all("[unknown-target]" in p for p in e.value.problems)


@pytest.mark.parametrize(("script", "message"), [
    (Directives().reorder_fields(DOC, ["a"]), "order"), (Directives().reorder_cases("Demo::Mode", ["Old", "New", "New"]), "order"),
    (Directives().remove_case("Demo::Mode", "Old", map_case("Nothing")), "map-case"), (Directives().resize_vec_field(DOC, "a", 3), "dimension"), (Directives().transpose_mat_field(DOC, "a"), "dimension"),
    (Directives().add_field(DOC, "m", T.ref("Demo::Mode"), "Old"), "default"), (Directives().drop_field(DOC, "a").add_field(DOC, "a", T.INT32, 1), "ambiguous"),
    (Directives().drop_type("Demo::Mode"), "dangling"), (Directives().rename_type("Demo::Mode", "Doc"), "collision"), (Directives().retype_field(DOC, "a", T.prim("int8")), "policy"),
    (Directives().retype_field("Demo::Inner", "x", T.INT32, "drop-record"), "drop-record")])
def test_refused(script, message):
    c = catalog({"a": T.INT32, "m": T.ref("Demo::Mode"), "many": T.vector(T.ref("Demo::Inner"))}, [MODE], [INNER])
    with pytest.raises(Refused, match=message):
        build(c, script)


def test_dropped_type_without_references():
    c = catalog({"a": T.INT32, "m": T.ref("Demo::Mode")}, [MODE])
    t = build(c, Directives().drop_field(DOC, "m").drop_type("Demo::Mode")).target
    assert not t.enums and [f.name for f in t.struct(DOC).fields] == ["a"]


def test_arguments_are_checked():
    for wrong in (lambda d: d.resolve_collisions("maybe"), lambda d: d.retype_field(DOC, "a", T.INT32, "perhaps"), lambda d: d.resize_vec_field(DOC, "a", 3, on_shrink="x"), lambda d: d.add_field(DOC, "a", T.INT32, 1, derive=len)):
        with pytest.raises(ValueError):
            wrong(Directives())


# --- Hooks ---

def test_hooks(spark):
    c = catalog({"a": T.INT32, "b": T.INT32, "s": T.vector(T.STRING)})
    d = Directives().transform_field(DOC, "a", T.INT32, lambda s, name, t: Unless(s.a * s.b, s.b < 0)).transform_type("string", T.STRING, lambda v, t: F.upper(v))
    assert rewritten(spark, c, d, [("x", 3, 100, ["q"]), ("y", 1, -1, [])]) == {"x": {"a": 300, "b": 100, "s": ["Q"]}}


def test_python_hook(spark):
    import pandas as pd

    @F.pandas_udf("int")
    def square(x: pd.Series) -> pd.Series:
        return x * x

    d = Directives().transform_field(DOC, "a", T.INT32, lambda s, name, t: square(s.a))
    assert rewritten(spark, catalog({"a": T.INT32}), d, [("x", 9)])["x"] == {"a": 81}


def linked():
    return Catalog(
        (DEMO,), (Concept("Demo::Customer"), Concept("Demo::Order")), (), (), (Struct("Demo::CustomerDoc", (Field("name", T.STRING),)), Struct("Demo::OrderDoc", (Field("customer", T.STRING), Field("amount", T.INT32)))),
        (Attachment("Demo", "Customers", "Demo::Customer", "Demo::CustomerDoc"), Attachment("Demo", "Orders", "Demo::Order", "Demo::OrderDoc")))


def linked_store(spark, path):
    c = linked()
    return create(spark, path, c, {
        "Demo::Customer.Customers": spark.createDataFrame([("1", "Ada"), ("2", "Bob"), ("3", "Cid")], "key string, name string"),
        "Demo::Order.Orders": spark.createDataFrame([("a", "1", 10), ("b", "1", 20), ("c", "1", 30), ("d", "2", 99), ("e", "9", 1)], "key string, customer string, amount int")})


def test_lookup_and_fold(spark, tmp_path):
    store = linked_store(spark, f"file://{tmp_path}/s")
    d = Directives().add_field("Demo::OrderDoc", "name", T.optional(T.STRING), derive=lambda s, n, t, ctx: ctx.lookup("Customers", s.customer, "name"))
    d.add_field("Demo::CustomerDoc", "total", T.INT64, derive=lambda s, n, t, ctx: ctx.fold("Orders", "customer", F.sum("amount"), 0))
    m = build(store.catalog, d)
    migrate(store, m, f"file://{tmp_path}/t")
    t = Store.open(spark, f"file://{tmp_path}/t")
    assert {r.key: r.name for r in t.attachment("Demo::Order.Orders").collect()} == {"a": "Ada", "b": "Ada", "c": "Ada", "d": "Bob", "e": None}
    assert {r.name: r.total for r in t.attachment("Demo::Customer.Customers").collect()} == {"Ada": 60, "Bob": 99, "Cid": 0}
    assert verify(store, m, t) == {"documents": 8, "blobs": 0}


def test_hook_of_another_type_is_refused(spark, tmp_path):
    store = linked_store(spark, f"file://{tmp_path}/s")
    m = build(store.catalog, Directives().transform_field("Demo::OrderDoc", "amount", T.INT64, lambda s, n, t: s.amount))
    with pytest.raises(Refused, match="hook"):
        migrate(store, m, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        Store.open(spark, f"file://{tmp_path}/t")


# --- Stores ---

BLOB_CATALOG = catalog({"thumb": T.prim("blob_id"), "old": T.prim("blob_id"), "n": T.optional(T.INT32), "more": T.vector(T.tuple_of(T.prim("blob_id"), T.INT32))})


def blob_store(spark, path):
    rows = [("1", "b1", "b2", 5, [("b4", 1)]), ("2", "b1", "b3", None, []), ("3", "b3", "b2", 2**20, [])]
    blobs = spark.createDataFrame([(f"b{i}", "raw", 2) for i in range(1, 7)], "blob_id string, layout string, size long")
    chunks = spark.createDataFrame([(f"b{i}", k, bytearray([i])) for i in range(1, 7) for k in range(2)], "blob_id string, chunk_no int, bytes binary")
    return create(spark, path, BLOB_CATALOG, {"Demo::C.Docs": frame(spark, BLOB_CATALOG, rows)}, blobs, chunks)


def test_blobs_are_copied_on_reference(spark, tmp_path):
    store = blob_store(spark, f"file://{tmp_path}/s")
    seen = []
    m = build(store.catalog, Directives().drop_field(DOC, "old").retype_field(DOC, "n", T.INT32, "drop-record").accept_document_drops())
    assert migrate(store, m, f"file://{tmp_path}/t", seen.append) == {"documents": 2, "dropped": 1, "blobs": 3, "bytes": 6}
    assert [(x.blobs, x.bytes_copied, x.bytes_total) for x in seen[-2:]] == [(0, 0, 6), (3, 6, 6)]
    t = Store.open(spark, f"file://{tmp_path}/t")
    assert {r.blob_id for r in t.blobs.collect()} == {"b1", "b3", "b4"} and t.chunks.count() == 6 and seen[-1].documents == 2
    assert verify(store, m, t) == {"documents": 2, "blobs": 3}
    report = dry_run(store, m)
    assert (report.documents, report.dropped, report.referenced_blobs, report.orphans) == (2, 1, 3, 3)


def test_gates_and_failures(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = blob_store(spark, path)
    with pytest.raises(Refused, match="accept_document_drops"):
        migrate(store, build(store.catalog, Directives().retype_field(DOC, "n", T.INT32, "drop-record")), f"file://{tmp_path}/t")
    with pytest.raises(Refused, match="accept_attachment_drops"):
        migrate(store, build(store.catalog, Directives().drop_attachment("Docs")), f"file://{tmp_path}/t")
    with pytest.raises(Exception, match="nil-unwrap"):
        run(spark, path, Directives().retype_field(DOC, "n", T.INT32, "fail"), f"file://{tmp_path}/t")
    assert not (tmp_path / "t").exists()
    with pytest.raises(FileExistsError):
        run(spark, path, Directives(), path)
    assert run(spark, path, lambda: Directives().rename_field(DOC, "n", "m"), f"file://{tmp_path}/t", check=True)["documents"] == 3


def test_verification_finds_drift(spark, tmp_path):
    store = blob_store(spark, f"file://{tmp_path}/s")
    m = build(store.catalog, Directives().retype_field(DOC, "n", T.INT32, default(0)))
    good = m.target
    rows = [("1", "b1", "b2", 5, [("b4", 1)]), ("2", "b1", "b3", 1, []), ("9", "b3", "b2", 1, [])]
    chunks = store.chunks
    bad = create(spark, f"file://{tmp_path}/t", good, {"Demo::C.Docs": spark.createDataFrame(rows, good.table_schema(good.attachment("Docs")))}, store.blobs.where("blob_id <> 'b4'"), chunks)
    with pytest.raises(VerificationError) as e:
        verify(store, m, bad)
    text = str(e.value)
    assert "1 differs, such as 2" in text and "1 missing, such as 3" in text and "1 spurious, such as 9" in text and "1 referenced blobs are missing" in text and "2 blobs are not referenced" in text


def test_dry_run_reports(spark, tmp_path):
    c = catalog({"n": T.INT64, "x": T.DOUBLE})
    store = create(spark, f"file://{tmp_path}/s", c, {"Demo::C.Docs": frame(spark, c, [(str(i), 2**40 if i < 7 else i, i + 0.5) for i in range(10)])})
    m = build(c, Directives().retype_field(DOC, "n", T.INT32, "saturate").retype_field(DOC, "x", T.INT32, default(0)))
    report = dry_run(store, m, max_samples=3)
    found = {(f.path, f.op): f for f in report.findings}
    narrow = found["Doc.n", "narrow int64→int32"]
    assert (narrow.count, narrow.policy, narrow.samples) == (7, "saturate", [(str(i), "2147483647") for i in range(3)])
    assert found["Doc.x", "double→int32 truncate"].count == 10 and "saturate" in format_report(report.findings)
    assert format_report([]).startswith("no value")


# --- Plans ---

def test_plan():
    c = catalog({"a": T.INT64, "b": T.vector(T.INT32), "v": T.vec(T.INT32, 4), "old": T.STRING}, [MODE])
    d = Directives().retype_field(DOC, "a", T.INT32).retype_field(DOC, "b", T.STRING, "fail").resize_vec_field(DOC, "v", 2).drop_field(DOC, "old").add_field(DOC, "new", T.STRING, "")
    d.remove_case("Demo::Mode", "Old", map_case("New")).remove_case("Demo::Mode", "Off", map_case("New")).transform_type("Demo::Mode", T.STRING, lambda v, t: v).drop_attachment("Docs").move_type("Demo::Mode", "Other")
    p = plan(c, d)
    classes = {(x.kind, x.target): x.loss_class for x in p.changes}
    assert classes["retype-field", f"{DOC}.a"] == "B" and classes["retype-field", f"{DOC}.b"] == "refused" and classes["resize-field", f"{DOC}.v"] == "B"
    assert classes["transform-type", "Demo::Mode"] == "C" and classes["drop-attachment", "Demo::C.Docs"] == "B" and ("move-type", "Demo::Mode") in classes
    text = format_plan(p)
    for words in ("no policy is named", "was a rename meant", "can no longer be told", "shrinks", "hooks are the user's own"):
        assert words in text
    assert format_plan(plan(c, Directives())) == "nothing changes"


def test_target_written_elsewhere(spark):
    c = catalog({"a": T.INT32, "m": T.ref("Demo::Mode")}, [MODE], attachments=[Attachment("Demo", "More", "Demo::C", "Demo::Inner")], structs=[INNER])
    d = Directives().rename_field(DOC, "a", "b").rename_type("Demo::Mode", "State").rename_case("Demo::Mode", "Old", "Past")
    good = build(c, d).target
    extra = replace(good, structs=(*good.structs, Struct("Demo::Extra", (Field("x", T.INT32),))))
    p = Compiler(build_for(c, extra, d)).projection(c.attachment("Docs"))
    assert p.select(frame(spark, c, [("k", 1, "Old")])).collect()[0].asDict() == {"key": "k", "b": 1, "m": "Past"}

    def refused(target: Catalog, message: str, script: Directives = d):
        with pytest.raises(Refused) as e:
            build_for(c, target, script)
        assert any(message in x for x in e.value.problems), e.value.problems

    change = lambda **kw: replace(good, structs=tuple(replace(s, fields=kw["fields"](s.fields)) if s.name == DOC else s for s in good.structs))
    refused(change(fields=lambda f: f[:1]), f"{DOC}: 2 fields expected, the target has 1")
    refused(change(fields=lambda f: f[::-1]), f"field #0 of {DOC}: b: int32 expected")
    refused(change(fields=lambda f: (replace(f[0], type=T.INT64), f[1])), "the target has b: int64")
    refused(replace(good, enums=(replace(good.enums[0], cases=good.enums[0].cases[::-1]),)), "case #0 of Demo::State: Past expected")
    refused(replace(good, enums=(replace(good.enums[0], cases=good.enums[0].cases[:2]),)), "3 cases expected")
    refused(replace(good, attachments=good.attachments[1:]), f"[no-target] {good.attachments[0].id}")
    refused(good, "[no-target] Demo::Mode", Directives())


def test_new_namespace_uuid():
    n = Namespace("X", "u")
    assert Catalog((n,)).digest() == Catalog((Namespace("Y", "u"),)).digest()
