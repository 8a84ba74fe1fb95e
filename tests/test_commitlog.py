"""Commit logs: ids, topology, opcodes of every verb, states, verification."""

import hashlib
import json

import pytest
from helpers import DEMO

from driftloom.catalog import types as T
from driftloom.catalog.catalog import Attachment, Catalog, Concept, Field, Struct
from driftloom.functions.nodes import Refused
from driftloom.migrate import VerificationError
from driftloom.operators import commitlog as L
from driftloom.plans.build import build
from driftloom.plans.directives import Directives, default

ORDER = "Demo::OrderDoc"
CATALOG = Catalog(
    (DEMO,), (Concept("Demo::Order"), Concept("Demo::Note")), (), (), (
        Struct(ORDER, (Field("qty", T.INT64), Field("label", T.STRING), Field("tags", T.set_of(T.STRING)), Field("attrs", T.map_of(T.STRING, T.INT64)), Field("lines", T.xarray(T.INT64)),
                       Field("prev", T.optional(T.prim("commit_id"))), Field("blob", T.optional(T.prim("blob_id"))))),
        Struct("Demo::NoteDoc", (Field("text", T.STRING),))),
    (Attachment("Demo", "Orders", "Demo::Order", ORDER), Attachment("Demo", "Notes", "Demo::Note", "Demo::NoteDoc")))
ORDERS = "Demo::Order.Orders"
ID = {n: hashlib.sha1(n.encode()).hexdigest() for n in "abcdefg"}
FAR = hashlib.sha1(b"elsewhere").hexdigest()


def field(name):
    return [("Field", name, None, None)]


def log(spark, extra=()):
    commits = [(ID["a"], "Mutations", "base", None, None), (ID["b"], "Mutations", "left", ID["a"], None), (ID["c"], "Mutations", "right", ID["a"], None), (ID["d"], "Merge", "join", ID["b"], ID["c"]),
               (ID["e"], "Disable", "off", ID["d"], ID["c"]), (ID["f"], "Mutations", "more", FAR, None)]
    whole = {"qty": 2**40, "label": "x", "tags": ["p"], "attrs": {"k": 1}, "lines": [], "prev": ID["a"], "blob": "b1"}
    ops = [
        (ID["a"], 0, "Document_Set", ORDERS, "1", [], json.dumps(whole), None, None), (ID["a"], 1, "Document_Set", "Demo::Note.Notes", "n", [], '{"text":"hello"}', None, None),
        (ID["b"], 0, "Document_Update", ORDERS, "1", field("qty"), "7", None, None), (ID["b"], 1, "Set_Union", ORDERS, "1", field("tags"), '["q","r"]', None, None),
        (ID["b"], 2, "Set_Subtract", ORDERS, "1", field("tags"), '["p"]', None, None), (ID["b"], 3, "Map_Update", ORDERS, "1", field("attrs"), '{"k":5}', None, None),
        (ID["b"], 4, "Map_Subtract", ORDERS, "1", field("attrs"), '["k"]', None, None), (ID["b"], 5, "Document_Update", ORDERS, "1", field("prev"), json.dumps(FAR), None, None),
        (ID["c"], 0, "Document_Set", ORDERS, "1", [], json.dumps(whole | {"qty": 3, "blob": "b2"}), None, None),
        (ID["f"], 0, "XArray_Insert", ORDERS, "1", field("lines"), None, "p1", None), (ID["f"], 1, "XArray_Update", ORDERS, "1", field("lines"), "41", "p1", None),
        (ID["f"], 2, "XArray_Remove", ORDERS, "1", field("lines"), None, "p0", None), *extra]
    blobs = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "blob_id string")
    return L.Log(spark.createDataFrame(commits, L.COMMITS), spark.createDataFrame(ops, L.OPCODES), CATALOG, blobs)


def script():
    d = Directives().rename_field(ORDER, "label", "name").retype_field(ORDER, "qty", T.INT32, "saturate").drop_attachment("Notes").accept_attachment_drops()
    return d.retype_field(ORDER, "attrs", T.map_of(T.STRING, T.prim("int8")), "saturate")


def test_log_is_rewritten(spark):
    m = build(CATALOG, script())
    out = L.migrate_log(log(spark), m)
    new = {n: hashlib.sha1((i + m.target.digest()).encode()).hexdigest() for n, i in ID.items()}
    commits = {r.commit_id: r for r in out.commits.collect()}
    assert set(commits) == {new[n] for n in "abcdef"}
    assert (commits[new["d"]].parent_id, commits[new["d"]].target_id) == (new["b"], new["c"]) and commits[new["f"]].parent_id == FAR and commits[new["a"]].parent_id is None
    ops = {(r.commit_id, r.op_index): r for r in out.opcodes.collect()}
    assert len(ops) == 10 and not any(r.attachment.endswith("Notes") for r in ops.values())
    first = json.loads(ops[new["a"], 0].value)
    assert first["qty"] == 2**31 - 1 and first["name"] == "x" and first["prev"] == new["a"] and "label" not in first
    value = lambda n, i: json.loads(ops[new[n], i].value)
    assert value("b", 0) == 7 and value("b", 1) == ["q", "r"] and value("b", 3) == {"k": 5} and value("b", 4) == ["k"] and value("b", 5) == FAR
    assert ops[new["f"], 0].verb == "XArray_Insert" and value("f", 0) == 41 and (new["f"], 1) not in ops and ops[new["f"], 2].value is None
    assert {r.blob_id for r in out.blobs.collect()} == {"b1", "b2"}
    assert L.verify_log(log(spark), m, out) == {"commits": 6, "opcodes": 10}


def test_commit_ids_in_values(spark):
    """Ids are found by type, whatever verb adds them and however the rows are dealt; a string is never
    an id, and ids need no certain form."""
    i = T.prim("commit_id")
    fields = (Field("prev", T.optional(i)), Field("all", T.set_of(i)), Field("by", T.map_of(T.STRING, i)), Field("list", T.xarray(i)), Field("pair", T.tuple_of(T.STRING, i)), Field("note", T.STRING))
    c = Catalog((DEMO,), (Concept("Demo::Order"),), (), (), (Struct(ORDER, fields),), (Attachment("Demo", "Orders", "Demo::Order", ORDER),))
    whole = {"prev": "a", "all": ["a", "far"], "by": {"a": "b"}, "list": [], "pair": {"_0": "a", "_1": "b"}, "note": "a"}
    ops = [("b", 0, "Document_Set", ORDERS, "1", [], json.dumps(whole), None, None), ("b", 1, "Document_Update", ORDERS, "1", field("prev"), '"a"', None, None), ("b", 2, "Document_Update", ORDERS, "1", field("note"), '"a"', None, None),
           ("b", 3, "Set_Union", ORDERS, "1", field("all"), '["b","far"]', None, None), ("b", 4, "Map_Update", ORDERS, "1", field("by"), '{"k":"a"}', None, None), ("b", 5, "XArray_Insert", ORDERS, "1", field("list"), '"a"', "p", None),
           ("b", 6, "Document_Update", ORDERS, "1", [*field("pair"), ("Index", None, 1, None)], '"a"', None, None), ("b", 7, "Document_Update", ORDERS, "1", [*field("pair"), ("Index", None, 0, None)], '"a"', None, None),
           ("b", 8, "Document_Update", ORDERS, "1", field("prev"), "null", None, None)]
    commits = spark.createDataFrame([("a", "Mutations", "base", None, None), ("b", "Mutations", "more", "a", None)], L.COMMITS)
    m = build(c, Directives().rename_field(ORDER, "note", "text"))
    new = lambda x: hashlib.sha1((x + m.target.digest()).encode()).hexdigest()
    for n in (1, 5):
        out = L.migrate_log(L.Log(commits, spark.createDataFrame(ops, L.OPCODES).repartition(n), c), m).opcodes
        got = {r.op_index: json.loads(r.value) for r in out.collect()}
        assert got[0] == {"prev": new("a"), "all": [new("a"), "far"], "by": {"a": new("b")}, "list": [], "pair": {"_0": "a", "_1": new("b")}, "text": "a"}
        assert [got[k] for k in range(1, 9)] == [new("a"), "a", [new("b"), "far"], {"k": new("a")}, new("a"), new("a"), "a", None]


def test_depths_of_a_long_history(spark):
    """Chains of any length and merges of branches of unequal length."""
    ids = [f"c{i}" for i in range(40)]
    rows = [(ids[i], "Mutations", "x", ids[i - 1] if i else None, None) for i in range(40)]
    rows += [("s", "Mutations", "x", "c3", None), ("m", "Merge", "x", "s", "c39"), ("n", "Merge", "x", "c2", "s"), ("t", "Mutations", "x", "n", None), ("w", "Mutations", "x", "gone", None)]
    got = {r.commit_id: r.depth for r in L.linear_order(spark.createDataFrame(rows, L.COMMITS)).collect()}
    assert got == {**{c: i for i, c in enumerate(ids)}, "s": 4, "m": 40, "n": 5, "t": 6, "w": 0}


def test_verification_finds_drift(spark):
    from pyspark.sql import functions as F

    m = build(CATALOG, script())
    good = L.migrate_log(log(spark), m)
    for bad in (
        L.Log(good.commits.where("label <> 'left'"), good.opcodes, m.target, good.blobs),
        L.Log(good.commits.withColumn("parent_id", F.when(F.col("label") == "right", F.lit(None)).otherwise(F.col("parent_id"))), good.opcodes, m.target, good.blobs),
        L.Log(good.commits, good.opcodes.withColumn("value", F.when(F.col("verb") == "Map_Update", F.lit('{"k":6}')).otherwise(F.col("value"))), m.target, good.blobs),
        L.Log(good.commits, good.opcodes.where("verb <> 'Set_Union'"), m.target, good.blobs),
        L.Log(good.commits, good.opcodes, m.target, good.blobs.limit(1)),
    ):
        with pytest.raises(VerificationError):
            L.verify_log(log(spark), m, bad)


def test_paths_are_translated(spark):
    d = Directives().rename_field(ORDER, "qty", "count").drop_field(ORDER, "tags")
    m = build(CATALOG, d)
    ops = L.migrate_log(log(spark), m).opcodes.collect()
    assert {r.path[0].name for r in ops if r.verb == "Document_Update"} == {"count", "prev"} and not [r for r in ops if r.verb.startswith("Set_")]


def test_losses(spark):
    with pytest.raises(Refused, match="no records to drop"):
        L.migrate_log(log(spark), build(CATALOG, Directives().retype_field(ORDER, "qty", T.INT32, "drop-record")))
    m = build(CATALOG, Directives().retype_field(ORDER, "qty", T.INT32, "fail"))
    with pytest.raises(Exception, match="narrow"):
        L.migrate_log(log(spark), m).opcodes.count()
    report = L.dry_run_log(log(spark), m)
    assert report["commits"] == 4 and report["unrepresentable"] == 1 and (report["referenced_blobs"], report["stranded_blobs"]) == (2, 1)
    report = L.dry_run_log(log(spark), build(CATALOG, Directives().retype_field(ORDER, "qty", T.INT32, default(0))))
    assert report["unrepresentable"] == 0 and sum(report["diagnostics"].values()) == 1


@pytest.mark.parametrize("op", [
    (ID["f"], 9, "Document_Update", ORDERS, "1", field("nope"), "1", None, None), (ID["f"], 9, "Document_Explode", ORDERS, "1", [], "1", None, None), (ID["f"], 9, "Document_Set", "Demo::X.Y", "1", [], "{}", None, None),
    (ID["f"], 9, "Document_Update", ORDERS, "1", [("Index", None, 0, None)], "1", None, None)])
def test_unknown_opcodes_are_refused(spark, op):
    with pytest.raises(Refused, match="opcode"):
        L.migrate_log(log(spark, [op]), build(CATALOG, script()))


def test_states_commute(spark):
    """The state of the target at a commit is the rewritten state of the source there."""
    m, source = build(CATALOG, script()), log(spark)
    target = L.migrate_log(source, m)
    order = L.linear_order(source.commits)
    assert {r.commit_id: r.depth for r in order.collect()} == {ID["a"]: 0, ID["b"]: 1, ID["c"]: 1, ID["d"]: 2, ID["e"]: 3, ID["f"]: 0}
    order2 = L.linear_order(target.commits)
    # The left branch updates what the base sets; the right one sets the whole, at the same depth and under a
    # smaller id, until it is switched off.
    for upto, qty, blob in ((0, 2**31 - 1, "b1"), (2, 7, "b2"), (3, 7, "b1")):
        rows = {r.key: json.loads(r.value) for r in L.state_at(target, order2, ORDERS, upto).collect()}
        assert rows["1"]["qty"] == qty and rows["1"]["blob"] == blob
        assert {r.key for r in L.state_at(source, order, ORDERS, upto).collect()} == set(rows)


def test_state_takes_the_last_write_of_each_field(spark):
    inner = Struct("Demo::Inner", (Field("x", T.INT32), Field("y", T.optional(T.STRING))))
    s = Struct(ORDER, (Field("a", T.optional(T.INT32)), Field("in", T.ref("Demo::Inner")), Field("m", T.map_of(T.STRING, T.INT32))))
    c = Catalog((DEMO,), (Concept("Demo::Order"),), (), (), (inner, s), (Attachment("Demo", "Orders", "Demo::Order", ORDER),))
    whole = lambda a, x: json.dumps({"a": a, "in": {"x": x, "y": "w"}, "m": {"k": x}})
    deep = [*field("in"), *field("x")]
    ops = [("1", "Document_Update", field("a"), "7"), ("1", "Document_Set", [], whole(1, 1)), ("1", "Document_Update", field("a"), "null"), ("1", "Document_Update", deep, "5"),
           ("1", "Document_Update", field("m"), '{"z":9}'), ("2", "Document_Set", [], whole(1, 1)), ("2", "Document_Update", deep, "5"), ("2", "Document_Update", field("in"), '{"x":6,"y":null}'),
           ("3", "Document_Update", field("a"), "3"), ("4", "Document_Update", deep, "8"), ("4", "Document_Set", [], whole(2, 2))]
    rows = [(ID["a"], i, verb, ORDERS, key, path, value, None, None) for i, (key, verb, path, value) in enumerate(ops)]
    commits = spark.createDataFrame([(ID["a"], "Mutations", "base", None, None)], L.COMMITS)
    source = L.Log(commits, spark.createDataFrame(rows, L.OPCODES), c)
    got = {r.key: json.loads(r.value) for r in L.state_at(source, L.linear_order(commits), ORDERS).collect()}
    assert got == {"1": {"a": None, "in": {"x": 5, "y": "w"}, "m": {"z": 9}}, "2": {"a": 1, "in": {"x": 6, "y": None}, "m": {"k": 1}}, "4": {"a": 2, "in": {"x": 2, "y": "w"}, "m": {"k": 2}}}


def test_blobs_of_every_adding_verb_are_kept(spark):
    b = T.prim("blob_id")
    fields = (Field("one", T.optional(b)), Field("all", T.set_of(b)), Field("by", T.map_of(T.STRING, b)), Field("list", T.xarray(b)))
    c = Catalog((DEMO,), (Concept("Demo::Order"),), (), (), (Struct(ORDER, fields),), (Attachment("Demo", "Orders", "Demo::Order", ORDER),))
    op = lambda i, verb, name, value, position=None: (ID["a"], i, verb, ORDERS, "1", field(name), value, position, None)
    ops = [op(0, "Document_Update", "one", '"b0"'), op(1, "Set_Union", "all", '["b1","b2"]'), op(2, "Map_Union", "by", '{"x":"b3"}'), op(3, "Map_Update", "by", '{"x":"b4"}'),
           op(4, "XArray_Insert", "list", '"b5"', "p"), op(5, "XArray_Insert", "list", None, "q"), op(6, "XArray_Update", "list", '"b6"', "q"), op(7, "XArray_Update", "list", '"b7"', "p"),
           op(8, "Set_Subtract", "all", '["gone"]'), op(9, "Document_Update", "one", "null"),
           (ID["a"], 10, "Document_Set", ORDERS, "2", [], json.dumps({"one": "b8", "all": ["b9"], "by": {}, "list": []}), None, None)]
    commits = spark.createDataFrame([(ID["a"], "Mutations", "base", None, None)], L.COMMITS)
    blobs = spark.createDataFrame([(f"b{i}",) for i in range(11)] + [("gone",)], "blob_id string")
    source = L.Log(commits, spark.createDataFrame(ops, L.OPCODES), c, blobs)
    m = build(c, Directives().rename_field(ORDER, "one", "first").rename_field(ORDER, "by", "named"))
    out = L.migrate_log(source, m)
    assert {r.blob_id for r in out.blobs.collect()} == {f"b{i}" for i in range(10)}
    assert {r.blob_id for r in L.log_blobs(out.opcodes, m.target, spark).collect()} == {f"b{i}" for i in range(10)}
    L.verify_log(source, m, out)
    with pytest.raises(VerificationError):
        L.verify_log(source, m, L.Log(out.commits, out.opcodes, m.target, out.blobs.where("blob_id <> 'b1'")))
