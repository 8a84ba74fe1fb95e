"""Command lines and streams."""

import pytest
from helpers import DOC, catalog, frame
from pyspark.sql import functions as F
from test_commitlog import CATALOG, log

from driftloom import cli, commitstore
from driftloom.catalog import types as T
from driftloom.functions.nodes import Refused
from driftloom.plans.build import build
from driftloom.plans.directives import Directives
from driftloom.sources.store import Store, create
from driftloom.streaming.rewrite import follow, rewritten_stream

SCRIPT = """
from driftloom.catalog import types as T
from driftloom.plans.directives import Directives

def directives(catalog):
    return Directives().retype_field("Demo::Doc", "n", T.INT32, "saturate")
"""


def test_documents(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    c = catalog({"n": T.INT64})
    create(spark, f"{tmp_path}/s", c, {"Demo::C.Docs": frame(spark, c, [("a", 2**40), ("b", 1)])})
    script = tmp_path / "script.py"
    script.write_text(SCRIPT)
    call = lambda *a: cli.main(["migrate", str(script), f"{tmp_path}/s", *a])
    assert call("--plan") == 0 and "retype-field" in capsys.readouterr().out
    assert call("--dry-run") == 0 and "2 documents" in capsys.readouterr().out
    assert call() == 2
    assert call(f"{tmp_path}/t", "--verify", "-v") == 0 and "'documents': 2" in capsys.readouterr().out
    assert call(f"{tmp_path}/t") == 2 and call(f"{tmp_path}/t", "--force") == 0
    assert {r.n for r in Store.open(spark, f"{tmp_path}/t").attachment("Demo::C.Docs").collect()} == {2**31 - 1, 1}
    assert cli.main(["soak", f"{tmp_path}/s", f"{tmp_path}/u"]) == 0 and "verify_s" in capsys.readouterr().out


def test_logs(spark, tmp_path):
    held = log(spark)
    blobs = held.blobs.select("blob_id", F.lit("raw").alias("layout"), F.lit(1).cast("long").alias("size"))
    store = commitstore.create(spark, f"{tmp_path}/s", CATALOG, held.commits, held.opcodes, blobs)
    d = Directives().rename_field("Demo::OrderDoc", "label", "name")
    assert commitstore.dry_run(store, d)["commits"] == 4
    assert commitstore.run(spark, f"{tmp_path}/s", d, f"{tmp_path}/t", check=True) == {"commits": 6, "opcodes": 11, "blobs": 2}


def test_source(tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.dsm").write_text("namespace Demo {6ba7b810-9dad-11d1-80b4-00c04fd430c8} {\nstruct Doc { int64 n; };\n};\n")
    script = tmp_path / "script.py"
    script.write_text(SCRIPT)
    assert cli.main(["source", str(script), f"{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert (tmp_path / "out/a.dsm").read_text().count("int32 n;") == 1 and "a.dsm" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    c = catalog({"n": T.INT64})
    m = build(c, Directives().retype_field(DOC, "n", T.INT32, "drop-record").rename_field(DOC, "n", "m"))
    for k in range(2):
        frame(spark, c, [(f"{k}a", 2**40), (f"{k}b", k)]).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, f"{tmp_path}/in", m, "Docs", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert {(r.key, r.m) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("0b", 0), ("1b", 1)}
    with pytest.raises(Refused, match="stream"):
        looked = build(c, Directives().add_field(DOC, "x", T.INT64, derive=lambda s, n, t, ctx: ctx.lookup("Docs", ctx.self_key, "n")))
        rewritten_stream(frame(spark, c, []), looked, "Docs")
