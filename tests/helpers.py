"""Small catalogs: one attachment ``Docs`` of ``Demo::Doc``, keyed by concept ``Demo::C``."""

from driftloom.catalog.catalog import Attachment, Catalog, Concept, Field, Namespace, Struct
from driftloom.operators.projection import Compiler
from driftloom.plans.build import build

DEMO = Namespace("Demo", "6ba7b810-9dad-11d1-80b4-00c04fd430c8")
DOC = "Demo::Doc"


def catalog(fields, enums=(), structs=(), attachments=(), concepts=(), clubs=()):
    return Catalog(
        (DEMO,), (Concept("Demo::C"), *concepts), tuple(clubs), tuple(enums), (*structs, Struct(DOC, tuple(Field(n, t) for n, t in fields.items()))),
        (Attachment("Demo", "Docs", "Demo::C", DOC), *attachments))


def frame(spark, c, rows, attachment="Docs"):
    return spark.createDataFrame(rows, c.table_schema(c.attachment(attachment)))


def rewritten(spark, c, directives, rows, read=None):
    """The target rows by key, as dicts."""
    p = Compiler(build(c, directives)).projection(c.attachment("Docs"))
    out = p.select(frame(spark, c, rows), read)
    return {r["key"]: {k: v for k, v in r.asDict(recursive=True).items() if k != "key"} for r in out.collect()}


def one_field(spark, source, target, policy, values, winner=None):
    """A single field ``x`` retyped; gives the values by key (their position)."""
    from driftloom.plans.directives import Directives

    d = Directives().retype_field(DOC, "x", target, policy).accept_document_drops()
    if winner:
        d.resolve_collisions(winner)
    rows = rewritten(spark, catalog({"x": source}), d, [(str(i), v) for i, v in enumerate(values)])
    return {int(k): v["x"] for k, v in rows.items()}
