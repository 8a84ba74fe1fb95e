"""The engine's operators as queries over the benchmark tables, with DuckDB SQL for each.

Each query builds a catalog of the tables it needs, an edit script, and reads the compiled projection
over the whole tables. Results are flat: arrays and maps are exploded.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.catalog import types as T
from driftloom.catalog.catalog import Attachment, Case, Catalog, Concept, Enum, Field, Namespace, Struct
from driftloom.functions.nodes import Refused
from driftloom.migrate import compiled, differences, dry_run, migrate, referenced_blobs, verify
from driftloom.operators import commitlog as L
from driftloom.operators.diagnostics import counts
from driftloom.operators.projection import Compiler, Unless
from driftloom.plans.build import Migration, build, build_for, gate_attachments, gate_documents
from driftloom.plans.directives import Directives, default, fit, map_case
from driftloom.plans.report import plan
from driftloom.sources.store import Store, create

SHOP = Namespace("Shop", "11111111-1111-1111-1111-111111111111")
I16, I32, I64, DBL, STR, FLT = T.prim("int16"), T.INT32, T.INT64, T.DOUBLE, T.STRING, T.FLOAT

#: The tables as attachments: fields that a logical type can hold, and the key column.
TABLES: dict[str, tuple[str, dict[str, T.Type]]] = {
    "nation": ("n_nationkey", {"n_name": STR, "n_regionkey": I32}),
    "customer": ("c_custkey", {"c_name": STR, "c_nationkey": I32, "c_acctbal": DBL, "c_mktsegment": STR}),
    "part": ("p_partkey", {"p_name": STR, "p_brand": STR, "p_type": STR, "p_size": I32, "p_retailprice": DBL}),
    "orders": ("o_orderkey", {"o_custkey": I64, "o_orderstatus": T.ref("Shop::Status"), "o_totalprice": DBL, "o_orderpriority": STR}),
    "lineitem": ("l_id", {"l_orderkey": I64, "l_partkey": I64, "l_linenumber": I32, "l_quantity": DBL, "l_extendedprice": DBL, "l_discount": DBL, "l_tax": DBL, "l_returnflag": STR}),
    "documents": ("doc_id", {"text": STR, "lang": STR, "source": STR, "n_chars": I64}),
    "labels": ("doc_id", {"quality": T.optional(I32), "toxic": T.optional(I32)}),
}
STATUS = Enum("Shop::Status", (Case("F"), Case("O"), Case("P")))


def title(table: str) -> str:
    return table.capitalize()


def shop(tables: dict[str, tuple[str, dict[str, T.Type]]], structs: tuple[Struct, ...] = ()) -> Catalog:
    return Catalog(
        (SHOP,), tuple(Concept(f"Shop::{title(t)}") for t in tables), (), (STATUS,),
        structs + tuple(Struct(f"Shop::{title(t)}Doc", tuple(Field(n, k) for n, k in fields.items())) for t, (_, fields) in tables.items()),
        tuple(Attachment("Shop", t, f"Shop::{title(t)}", f"Shop::{title(t)}Doc", key) for t, (key, _) in tables.items()))


def of(*names: str) -> Catalog:
    return shop({n: TABLES[n] for n in names})


def doc(table: str) -> str:
    return f"Shop::{title(table)}Doc"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "lineitem":
        rows = rows.withColumn("l_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return rows


def migration(catalog: Catalog, d: Directives) -> Migration:
    return build(catalog, d.accept_document_drops().accept_attachment_drops())


def project(spark: SparkSession, sf_dir: str, table: str, d: Directives, catalog: Catalog | None = None, rows: DataFrame | None = None) -> DataFrame:
    """The target rows of a table; hooks may look up the other tables of the catalog."""
    m = migration(catalog or of(table), d)
    p = Compiler(m).projection(m.source.attachment(table))
    read = lambda a: load(spark, sf_dir, m.source.attachment(a).name)
    return p.select(load(spark, sf_dir, table) if rows is None else rows, read)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- Fields ---------------------------------------------------------------------------------------

@query("""select c_custkey, c_mktsegment as segment, 'EUR' as currency, c_name as name, c_acctbal from customer""")
def rename_add_drop_reorder(spark, sf_dir):
    d = Directives().rename_field(doc("customer"), "c_name", "name").rename_field(doc("customer"), "c_mktsegment", "segment").drop_field(doc("customer"), "c_nationkey")
    d.add_field(doc("customer"), "currency", STR, "EUR").reorder_fields(doc("customer"), ["segment", "currency", "name", "c_acctbal"])
    return project(spark, sf_dir, "customer", d)


@query("""select o_orderkey, o_custkey, o_orderstatus, cast(greatest(-32768, least(32767, trunc(o_totalprice))) as smallint) as o_totalprice, o_orderpriority from orders""")
def narrow_saturate(spark, sf_dir):
    return project(spark, sf_dir, "orders", Directives().retype_field(doc("orders"), "o_totalprice", I16, "saturate"))


@query("""select l_orderkey, l_linenumber, l_partkey, cast(case when trunc(l_extendedprice) between -32768 and 32767 then trunc(l_extendedprice) else -1 end as smallint) as price from lineitem""")
def narrow_default(spark, sf_dir):
    d = Directives().retype_field(doc("lineitem"), "l_extendedprice", I16, default(-1)).rename_field(doc("lineitem"), "l_extendedprice", "price")
    return project(spark, sf_dir, "lineitem", d).select("l_orderkey", "l_linenumber", "l_partkey", "price")


@query("""select o_orderkey, cast(trunc(o_totalprice) as smallint) as o_totalprice from orders where trunc(o_totalprice) between -32768 and 32767""")
def narrow_drop_record(spark, sf_dir):
    return project(spark, sf_dir, "orders", Directives().retype_field(doc("orders"), "o_totalprice", I16, "drop-record")).select("o_orderkey", "o_totalprice")


@query("""select o_orderkey, cast(least(127, o_custkey) as tinyint) as o_custkey from orders""")
def narrow_int_saturate(spark, sf_dir):
    return project(spark, sf_dir, "orders", Directives().retype_field(doc("orders"), "o_custkey", T.prim("int8"), "saturate")).select("o_orderkey", "o_custkey")


@query("""select n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey from nation""")
def widen(spark, sf_dir):
    return project(spark, sf_dir, "nation", Directives().retype_field(doc("nation"), "n_regionkey", I64))


@query("""select c_custkey, cast(c_acctbal as varchar) as c_acctbal, cast(c_nationkey as varchar) as c_nationkey from customer""")
def format_string(spark, sf_dir):
    d = Directives().retype_field(doc("customer"), "c_acctbal", STR).retype_field(doc("customer"), "c_nationkey", STR)
    return project(spark, sf_dir, "customer", d).select("c_custkey", "c_acctbal", "c_nationkey")


_PART_TEXT = {"part": ("p_partkey", {"code": STR})}


def _part_text(spark, sf_dir):
    """Brand numbers, and for every third size the type, which is no number."""
    code = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.substring("p_brand", 7, 9)))
    return load(spark, sf_dir, "part").select("p_partkey", code.alias("code"))


_CODE = "case when p_size % 3 = 0 then p_type else ' ' || substr(p_brand, 7) end"


@query(f"""select p_partkey, case when regexp_full_match({_CODE}, '\\s*[+-]?[0-9](_?[0-9])*\\s*') then cast(trim({_CODE}) as integer) else -1 end as code from part""")
def parse_string_default(spark, sf_dir):
    return project(spark, sf_dir, "part", Directives().retype_field(doc("part"), "code", I32, default(-1)), shop(_PART_TEXT), _part_text(spark, sf_dir))


@query(f"""select p_partkey, cast(trim({_CODE}) as double) as code from part where regexp_full_match({_CODE}, '\\s*[+-]?[0-9]+\\s*')""")
def parse_string_drop_record(spark, sf_dir):
    return project(spark, sf_dir, "part", Directives().retype_field(doc("part"), "code", DBL, "drop-record"), shop(_PART_TEXT), _part_text(spark, sf_dir))


@query("""select d.doc_id, coalesce(l.quality, -1) as quality from documents d left join labels l using (doc_id)""")
def optional_unwrap_default(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return project(spark, sf_dir, "labels", Directives().retype_field(doc("labels"), "quality", I32, default(-1)).drop_field(doc("labels"), "toxic"), rows=rows)


@query("""select d.doc_id, l.quality, l.toxic from documents d join labels l using (doc_id) where l.quality is not null""")
def optional_unwrap_drop_record(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return project(spark, sf_dir, "labels", Directives().retype_field(doc("labels"), "quality", I32, "drop-record"), rows=rows)


# --- Enumerations ---------------------------------------------------------------------------------

@query("""select o_orderkey, case o_orderstatus when 'F' then 'FILLED' when 'O' then 'OPEN' else o_orderstatus end as o_orderstatus from orders""")
def rename_case(spark, sf_dir):
    return project(spark, sf_dir, "orders", Directives().rename_case("Shop::Status", "F", "FILLED").rename_case("Shop::Status", "O", "OPEN").add_case("Shop::Status", "X")).select("o_orderkey", "o_orderstatus")


@query("""select o_orderkey, case o_orderstatus when 'P' then 'O' else o_orderstatus end as o_orderstatus from orders""")
def remove_case_map_case(spark, sf_dir):
    return project(spark, sf_dir, "orders", Directives().remove_case("Shop::Status", "P", map_case("O"))).select("o_orderkey", "o_orderstatus")


@query("""select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P'""")
def remove_case_drop_record(spark, sf_dir):
    return project(spark, sf_dir, "orders", Directives().remove_case("Shop::Status", "P", "drop-record")).select("o_orderkey", "o_orderstatus")


# --- Containers -----------------------------------------------------------------------------------

def _per_order(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda x: x["l_quantity"]).alias("q"))


def _quantities(spark, sf_dir, source: T.Type, target: T.Type | None, policy=None, rows=None, winner: str = "fail"):
    d = Directives().resolve_collisions(winner)
    if target is not None:
        d.retype_field(doc("bag"), "q", target, policy)
    return project(spark, sf_dir, "bag", d, shop({"bag": ("l_orderkey", {"q": source})}), _per_order(spark, sf_dir) if rows is None else rows)


_Q = "select l_orderkey, list(l_quantity order by l_linenumber, l_partkey, l_suppkey, l_quantity) as q from lineitem group by l_orderkey"
_JOINED = "array_to_string(list_transform({}, lambda x: cast(cast(x as integer) as varchar)), ',')"


def _text(rows: DataFrame) -> DataFrame:
    return rows.select("l_orderkey", F.array_join(F.transform("q", lambda x: x.cast("int").cast("string")), ",").alias("q"))


@query(f"with b as ({_Q}) select l_orderkey, {_JOINED.format('list_sort(list_distinct(q))')} as q from b")
def vector_to_set(spark, sf_dir):
    return _text(_quantities(spark, sf_dir, T.vector(DBL), T.set_of(DBL), "fail"))


@query(f"with b as ({_Q}) select l_orderkey, {_JOINED.format('list_sort(list_distinct(q))')} as q from b")
def set_to_vector(spark, sf_dir):
    rows = _per_order(spark, sf_dir).select("l_orderkey", F.array_distinct("q").alias("q"))
    return _text(_quantities(spark, sf_dir, T.set_of(DBL), T.vector(DBL), rows=rows))


@query(f"""with b as ({_Q}), e as (select l_orderkey, unnest(q) as value, generate_subscripts(q, 1) - 1 as i from b)
select l_orderkey, printf('00000001-0000-0000-0000-%012x', i) as pos, value from e""")
def vector_to_xarray(spark, sf_dir):
    rows = _quantities(spark, sf_dir, T.vector(DBL), T.xarray(DBL))
    return rows.select("l_orderkey", F.explode("q").alias("e")).select("l_orderkey", "e.pos", "e.value")


@query(f"""with b as ({_Q}), e as (select l_orderkey, unnest(q) as value, generate_subscripts(q, 1) - 1 as i from b)
select l_orderkey, string_agg(cast(cast(value as integer) as varchar), ',' order by i) as q from e where i % 2 = 0 group by l_orderkey""")
def xarray_to_vector(spark, sf_dir):
    """Every second element is a tombstone."""
    entry = lambda x, i: F.struct(i.cast("string").alias("pos"), (i % 2 == 0).alias("live"), x.alias("value"))
    rows = _per_order(spark, sf_dir).select("l_orderkey", F.transform("q", entry).alias("q"))
    return _text(_quantities(spark, sf_dir, T.xarray(DBL), T.vector(DBL), rows=rows))


@query(f"with b as ({_Q}) select l_orderkey, {_JOINED.format('list_transform(q, lambda x: least(x, 20))')} as q from b")
def elements_saturate(spark, sf_dir):
    """Quantities times a thousand, so that the int16 edge is met."""
    rows = _per_order(spark, sf_dir).select("l_orderkey", F.transform("q", lambda x: F.when(x > 20, x * 10000).otherwise(x)).alias("q"))
    out = _quantities(spark, sf_dir, T.vector(DBL), T.vector(I16), "saturate", rows=rows)
    return _text(out.select("l_orderkey", F.transform("q", lambda x: F.when(x == 32767, 20).otherwise(x)).alias("q")))


@query(f"""with b as ({_Q}) select l_orderkey, {_JOINED.format('list_slice(list_concat(q, [0, 0, 0, 0, 0]), 1, 5)')} as q from b""")
def vector_to_vec_fit(spark, sf_dir):
    return _text(_quantities(spark, sf_dir, T.vector(DBL), T.vec(DBL, 5), fit(0.0)))


@query(f"with b as ({_Q}) select l_orderkey, {_JOINED.format('q')} as q from b where len(q) = 4")
def vector_to_vec_drop_record(spark, sf_dir):
    return _text(_quantities(spark, sf_dir, T.vector(DBL), T.vec(DBL, 4), "drop-record"))


def _part_map(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("l_quantity"))
    return rows.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_partkey", "l_quantity"))).alias("q"))


def _part_map_sql(winner: str) -> str:
    return f"""with g as (select l_orderkey, l_partkey, max(l_quantity) as q from lineitem group by all)
select l_orderkey, cast(least(255, l_partkey) as smallint) as k, arg_{winner}(q, l_partkey) as v from g group by all"""


def _part_map_query(spark, sf_dir, winner: str):
    rows = _quantities(spark, sf_dir, T.map_of(I64, DBL), T.map_of(T.prim("uint8"), DBL), "saturate", _part_map(spark, sf_dir), winner)
    return rows.select("l_orderkey", F.explode("q").alias("k", "v"))


@query(_part_map_sql("min"))
def map_collision_first(spark, sf_dir):
    return _part_map_query(spark, sf_dir, "first")


@query(_part_map_sql("max"))
def map_collision_last(spark, sf_dir):
    return _part_map_query(spark, sf_dir, "last")


@query("""with g as (select distinct l_orderkey, cast(least(255, l_partkey) as smallint) as p from lineitem)
select l_orderkey, p from g""")
def set_collapse_winner(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("q"))
    return _quantities(spark, sf_dir, T.set_of(I64), T.set_of(T.prim("uint8")), "saturate", rows, "first").select("l_orderkey", F.explode("q").alias("p"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(least(32767, trunc(l_extendedprice)) as smallint) as price, l_returnflag as flag from lineitem""")
def tuple_elements(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumn("t", F.struct(F.col("l_extendedprice").alias("_0"), F.col("l_returnflag").alias("_1")))
    c = shop({"pair": ("l_orderkey", {"l_linenumber": I32, "l_partkey": I64, "l_suppkey": I64, "t": T.tuple_of(DBL, STR)})})
    out = project(spark, sf_dir, "pair", Directives().retype_field(doc("pair"), "t", T.tuple_of(I16, STR), "saturate"), c, rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("t._0").alias("price"), F.col("t._1").alias("flag"))


@query("""select event_id, case when event_type in ('click', 'view') then 'double' else 'string' end as tag,
       case when event_type in ('click', 'view') then value end as num, case when event_type = 'error' then props when event_type not in ('click', 'view') then 'none' end as txt from events""")
def variant_arms(spark, sf_dir):
    """Three arms; the int64 arm is removed and its values become a text."""
    kind = F.when(F.col("event_type").isin("click", "view"), "double").when(F.col("event_type") == "error", "string").otherwise("int64")
    v = F.struct(kind.alias("tag"), F.when(kind == "double", F.col("value")).alias("a0"), F.when(kind == "int64", F.col("user_id")).alias("a1"), F.when(kind == "string", F.col("props")).alias("a2"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", v.alias("v"))
    c = shop({"event": ("event_id", {"v": T.variant(DBL, I64, STR)})})
    out = project(spark, sf_dir, "event", Directives().retype_field(doc("event"), "v", T.variant(STR, DBL), default("none")), c, rows)
    return out.select("event_id", "v.tag", F.col("v.a1").alias("num"), F.col("v.a0").alias("txt"))


# --- Vectors and matrices -------------------------------------------------------------------------

def _vectors(spark, sf_dir, t: T.Type, d: Directives) -> DataFrame:
    x = F.col("embedding")
    if t.kind == "mat":
        x = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("embedding", c * 8 + 1, 8))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", x.alias("e"))
    return project(spark, sf_dir, "point", d, shop({"point": ("vec_id", {"e": t})}), rows)


def _elements(rows: DataFrame, x) -> DataFrame:
    return rows.select("vec_id", F.posexplode(x).alias("i", "v")).select("vec_id", "i", F.col("v").cast("double").alias("v"))


_CELLS = "select vec_id, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings"


@query(f"""with e as ({_CELLS}) select vec_id, cast(i as integer) as i, v from e union all
select vec_id, cast(64 + k.k as integer) as i, 9.0::double as v from embeddings, range(6) k(k)""")
def vec_resize_grow(spark, sf_dir):
    return _elements(_vectors(spark, sf_dir, T.vec(FLT, 64), Directives().resize_vec_field(doc("point"), "e", 70, fill=9)), "e")


@query(f"with e as ({_CELLS}) select vec_id, cast(i as integer) as i, v from e where i < 10")
def vec_resize_shrink(spark, sf_dir):
    return _elements(_vectors(spark, sf_dir, T.vec(FLT, 64), Directives().resize_vec_field(doc("point"), "e", 10, on_shrink="accept")), "e")


@query(f"""with e as ({_CELLS}), g as (select vec_id, c.c as c, r.r as r from embeddings, range(9) c(c), range(9) r(r))
select g.vec_id, cast(g.c * 9 + g.r as integer) as i, coalesce(e.v, case when g.c = g.r then 1.0 else 0.0 end)::double as v
from g left join e on g.vec_id = e.vec_id and g.c < 8 and g.r < 8 and e.i = g.c * 8 + g.r""")
def mat_resize_identity(spark, sf_dir):
    return _elements(_vectors(spark, sf_dir, T.mat(FLT, 8, 8), Directives().resize_mat_field(doc("point"), "e", 9, 9)), F.flatten("e"))


@query(f"with e as ({_CELLS}) select vec_id, cast((i % 8) * 8 + i // 8 as integer) as i, v from e")
def mat_transpose(spark, sf_dir):
    return _elements(_vectors(spark, sf_dir, T.mat(FLT, 8, 8), Directives().transpose_mat_field(doc("point"), "e")), F.flatten("e"))


@query(f"with e as ({_CELLS}) select vec_id, cast(i as integer) as i, v from e")
def mat_flatten(spark, sf_dir):
    return _elements(_vectors(spark, sf_dir, T.mat(FLT, 8, 8), Directives().retype_field(doc("point"), "e", T.vector(FLT))), "e")


@query(f"with e as ({_CELLS}) select vec_id, cast(i as integer) as i, cast(trunc(v) as double) as v from e")
def vec_elements(spark, sf_dir):
    return _elements(_vectors(spark, sf_dir, T.vec(FLT, 64), Directives().retype_field(doc("point"), "e", T.vec(T.prim("int8"), 64), "saturate")), "e")


# --- Hooks ----------------------------------------------------------------------------------------

@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) as net from lineitem""")
def derive_field(spark, sf_dir):
    d = Directives().add_field(doc("lineitem"), "net", DBL, derive=lambda s, name, t: s.l_extendedprice * (1 - s.l_discount))
    rows = load(spark, sf_dir, "lineitem")
    c = shop({"lineitem": ("l_id", TABLES["lineitem"][1] | {"l_suppkey": I64})})
    return project(spark, sf_dir, "lineitem", d, c, rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net")


@query("""select p_partkey, p_brand || '/' || p_type as p_brand from part""")
def transform_field(spark, sf_dir):
    d = Directives().transform_field(doc("part"), "p_brand", STR, lambda s, name, t: F.concat(s[name], F.lit("/"), s.p_type))
    return project(spark, sf_dir, "part", d).select("p_partkey", "p_brand")


@query("""select p_partkey, upper(p_name) as p_name, upper(p_brand) as p_brand, upper(p_type) as p_type from part""")
def transform_type(spark, sf_dir):
    d = Directives().transform_type("string", STR, lambda v, t: F.upper(v))
    return project(spark, sf_dir, "part", d).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""select o_orderkey, o_totalprice from orders where o_orderpriority <> '5-LOW'""")
def hook_drops_record(spark, sf_dir):
    d = Directives().transform_field(doc("orders"), "o_totalprice", DBL, lambda s, name, t: Unless(s[name], s.o_orderpriority == "5-LOW"))
    return project(spark, sf_dir, "orders", d).select("o_orderkey", "o_totalprice")


@query("""select o_orderkey, c_name as customer from orders left join customer on o_custkey = c_custkey""")
def lookup_hook(spark, sf_dir):
    d = Directives().add_field(doc("orders"), "customer", STR, derive=lambda s, name, t, ctx: ctx.lookup("customer", s.o_custkey, "c_name"))
    return project(spark, sf_dir, "orders", d, of("orders", "customer")).select("o_orderkey", "customer")


@query("""select o_orderkey, cast(case when trunc(c_acctbal) between -128 and 127 then trunc(c_acctbal) when c_acctbal > 0 then 127 else -128 end as tinyint) as balance from orders left join customer on o_custkey = c_custkey""")
def lookup_rewritten(spark, sf_dir):
    d = Directives().retype_field(doc("customer"), "c_acctbal", T.prim("int8"), "saturate")
    d.add_field(doc("orders"), "balance", T.optional(T.prim("int8")), derive=lambda s, name, t, ctx: ctx.lookup("customer", s.o_custkey, "c_acctbal", rewritten=True))
    return project(spark, sf_dir, "orders", d, of("orders", "customer")).select("o_orderkey", "balance")


@query("""select c_custkey, coalesce(n, 0)::bigint as n_orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey""")
def aggregate_hook(spark, sf_dir):
    d = Directives().add_field(doc("customer"), "n_orders", I64, derive=lambda s, name, t, ctx: ctx.fold("orders", "o_custkey", F.count("*"), 0))
    return project(spark, sf_dir, "customer", d, of("customer", "orders")).select("c_custkey", "n_orders")


# --- Names, cases and whole definitions ----------------------------------------------------------

CRM = "22222222-2222-2222-2222-222222222222"


def _buyers(spark, sf_dir, d: Directives) -> DataFrame:
    """Orders with a key of a customer, whose type is what the script makes of it."""
    c = shop({"orders": ("o_orderkey", {"buyer": T.key("Shop::Customer")}), "customer": TABLES["customer"]})
    name = F.lit("Shop::Customer")
    key = F.struct(F.lit("concept").alias("flavour"), name.alias("type"), name.alias("concept"), F.col("o_custkey").cast("string").alias("instance_id"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", key.alias("buyer"))
    return project(spark, sf_dir, "orders", d, c, rows).select("o_orderkey", "buyer.type", "buyer.concept", "buyer.instance_id")


@query("""select o_orderkey, 'Crm::Client' as type, 'Crm::Client' as concept, cast(o_custkey as varchar) as instance_id from orders""")
def move_and_rename_type(spark, sf_dir):
    return _buyers(spark, sf_dir, Directives().rename_type("Shop::Customer", "Client").move_type("Shop::Customer", "Crm").remap_namespace("Crm", CRM))


@query("""select o_orderkey, 'Store::Customer' as type, 'Store::Customer' as concept, cast(o_custkey as varchar) as instance_id from orders""")
def rename_namespace(spark, sf_dir):
    return _buyers(spark, sf_dir, Directives().rename_namespace("Shop", "Store"))


@query("""select a as attachment, cast(k as varchar) as key, n as name from (
 select 'Crm::Customer.clients' as a, c_custkey as k, c_name as n from customer union all select 'Shop::Nation.countries', n_nationkey, n_name from nation)""")
def move_and_rename_attachment(spark, sf_dir):
    """Tables under the identifiers of the target."""
    d = Directives().rename_attachment("customer", "clients").move_attachment("customer", "Crm").remap_namespace("Crm", CRM)
    d.rename_attachment("Shop::Nation.nation", "countries")
    m = migration(of("customer", "nation"), d)
    parts = []
    for table, key, name in (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name")):
        p = Compiler(m).projection(m.source.attachment(table))
        parts.append(p.select(load(spark, sf_dir, table)).select(F.lit(p.target.id).alias("attachment"), F.col(key).cast("string").alias("key"), F.col(name).alias("name")))
    return parts[0].unionByName(parts[1])


@query("""select 'same' as name, true as value union all select 'renamed namespace', true union all select 'remapped namespace', false union all select 'docs', true
union all select 'renamed field', false union all select 'reordered cases', false""")
def fingerprints_kept(spark, sf_dir):
    """Which edits leave the fingerprints of a catalog as they are."""
    c = of("orders")
    edits = {"same": Directives(), "renamed namespace": Directives().rename_namespace("Shop", "Store"), "remapped namespace": Directives().remap_namespace("Shop", CRM),
             "docs": Directives().document_type(doc("orders"), "An order.").document_field(doc("orders"), "o_custkey", "Who buys.").document_case("Shop::Status", "F", "Done.").document_attachment("orders", "All."),
             "renamed field": Directives().rename_field(doc("orders"), "o_custkey", "buyer"), "reordered cases": Directives().reorder_cases("Shop::Status", ["P", "O", "F"])}
    return spark.createDataFrame([(k, migration(c, d).target.digest() == c.digest()) for k, d in edits.items()], "name string, value boolean")


@query("""select o_orderkey, o_orderstatus, cast(case o_orderstatus when 'P' then 1 when 'O' then 2 else 3 end as integer) as place from orders""")
def add_and_reorder_cases(spark, sf_dir):
    """Values keep their case by name wherever it stands in the target."""
    d = Directives().add_case("Shop::Status", "X").reorder_cases("Shop::Status", ["X", "P", "O", "F"])
    names = migration(of("orders"), d).target.enum("Shop::Status").names
    places = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    return project(spark, sf_dir, "orders", d).select("o_orderkey", "o_orderstatus", places[F.col("o_orderstatus")].alias("place"))


@query("""select 'Shop::Nation.nation' as attachment, cast(n_nationkey as varchar) as key from nation""")
def drop_type_and_attachment(spark, sf_dir):
    """A dropped attachment's rows go with the types that only it used."""
    d = Directives().drop_attachment("customer").drop_type(doc("customer")).drop_type("Shop::Customer")
    m, out = migration(of("customer", "nation"), d), None
    for p in compiled(m):
        rows = p.select(load(spark, sf_dir, p.source.name)).select(F.lit(p.target.id).alias("attachment"), F.col(p.target.key_column).cast("string").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""select c_custkey, column_name as field, comment from customer, (values ('c_name', 'Full name.'), ('c_nationkey', ''), ('c_acctbal', 'In euros.'), ('c_mktsegment', '')) t(column_name, comment)""")
def documented(spark, sf_dir):
    """Docs of fields are comments of columns."""
    d = Directives().document_field(doc("customer"), "c_name", "Full name.").document_field(doc("customer"), "c_acctbal", "In euros.")
    m = migration(of("customer"), d)
    comments = [(f.name, f.metadata.get("comment", "")) for f in m.target.table_schema(m.target.attachment("customer")).fields[1:]]
    return project(spark, sf_dir, "customer", d).select("c_custkey", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.lit(c).alias("comment")) for n, c in comments))).alias("x")).select("c_custkey", "x.*")


_REFUSALS: dict[str, tuple[str, Callable[[], object]]] = {
    "unknown field": ("unknown-target", lambda: build(of("orders"), Directives().rename_field(doc("orders"), "nothing", "x"))),
    "unknown case": ("unknown-target", lambda: build(of("orders"), Directives().rename_case("Shop::Status", "X", "Y"))),
    "unknown namespace": ("unknown-target", lambda: build(of("orders"), Directives().rename_namespace("Other", "X"))),
    "order is no permutation": ("order", lambda: build(of("orders"), Directives().reorder_fields(doc("orders"), ["o_custkey"]))),
    "dropped type in use": ("dangling", lambda: build(of("orders"), Directives().drop_type("Shop::Status"))),
    "names collide": ("collision", lambda: build(of("orders", "customer"), Directives().rename_type(doc("orders"), "CustomerDoc"))),
    "loss without policy": ("policy", lambda: build(of("orders"), Directives().retype_field(doc("orders"), "o_totalprice", I16))),
    "case without policy": ("policy", lambda: build(of("orders"), Directives().remove_case("Shop::Status", "P"))),
    "case to an unknown case": ("map-case", lambda: build(of("orders"), Directives().remove_case("Shop::Status", "P", map_case("X")))),
    "no such conversion": ("composite-retype", lambda: build(of("orders"), Directives().retype_field(doc("orders"), "o_custkey", T.vector(I64)))),
    "resize of a scalar": ("dimension", lambda: build(of("orders"), Directives().resize_vec_field(doc("orders"), "o_custkey", 3))),
    "default of a named type": ("default", lambda: build(of("orders"), Directives().add_field(doc("orders"), "x", T.ref("Shop::Status"), "F"))),
    "dropped and added": ("ambiguous", lambda: build(of("orders"), Directives().drop_field(doc("orders"), "o_custkey").add_field(doc("orders"), "o_custkey", I64, 0))),
    "drop-record in a container": ("drop-record", lambda: build(shop({"orders": ("o_orderkey", {"all": T.vector(T.ref("Shop::Status"))})}), Directives().remove_case("Shop::Status", "P", "drop-record"))),
    "record drops not accepted": ("acknowledge", lambda: gate_documents(build(of("orders"), Directives().remove_case("Shop::Status", "P", "drop-record")))),
    "attachment drops not accepted": ("acknowledge", lambda: gate_attachments(build(of("orders", "customer"), Directives().drop_attachment("customer")))),
    "target lacks a type": ("no-target", lambda: build_for(of("orders"), of("customer"), Directives())),
    "target of another shape": ("shape", lambda: build_for(of("orders"), build(of("orders"), Directives().drop_field(doc("orders"), "o_custkey")).target, Directives())),
    "record drops in a log": ("drop-record", lambda: L.migrate_log(L.Log(None, None, of("orders")), build(of("orders"), Directives().remove_case("Shop::Status", "P", "drop-record")))),
}


@query(" union all ".join(f"select '{name}' as script, '{code}' as code" for name, (code, _) in _REFUSALS.items()))
def refusals(spark, sf_dir):
    """What each faulty script is refused for."""
    out = []
    for name, (_, attempt) in _REFUSALS.items():
        try:
            attempt()
            out.append((name, "accepted"))
        except Refused as e:
            text = e.problems[0]
            out.append((name, text[text.index("[") + 1 : text.index("]")]))
    return spark.createDataFrame(out, "script string, code string")


@query("""select o_orderkey, cast(o_totalprice as float) as o_totalprice from orders""")
def narrow_to_float(spark, sf_dir):
    d = Directives().retype_field(doc("orders"), "o_totalprice", FLT, "saturate")
    return project(spark, sf_dir, "orders", d).select("o_orderkey", "o_totalprice")


# --- Stores ---------------------------------------------------------------------------------------

def _scratch(spark: SparkSession) -> str:
    """A new folder for stores, which the cluster shares; local sessions without one use their own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='driftloom-')).rstrip('/')}/stores-{uuid.uuid4().hex}"


def _store(spark, sf_dir) -> tuple[Store, Migration, str]:
    """Orders, and documents that hold the English texts as blobs of one chunk."""
    root, c = _scratch(spark), shop({"orders": TABLES["orders"], "documents": ("doc_id", {"blobs": T.vector(T.prim("blob_id"))})})
    blob = load(spark, sf_dir, "documents").where("text is not null").select(F.sha1(F.col("text").cast("binary")).alias("blob_id"), F.col("text").cast("binary").alias("bytes")).dropDuplicates(["blob_id"])
    tables = {"Shop::Orders.orders": load(spark, sf_dir, "orders"), "Shop::Documents.documents": _blob_rows(spark, sf_dir)}
    store = create(spark, f"{root}/source", c, tables, blob.select("blob_id", F.lit("raw").alias("layout"), F.octet_length("bytes").cast("long").alias("size")),
                   blob.select("blob_id", F.lit(0).alias("chunk_no"), "bytes"))
    d = Directives().remove_case("Shop::Status", "P", "drop-record").retype_field(doc("orders"), "o_totalprice", I16, "saturate").rename_field(doc("orders"), "o_custkey", "buyer")
    return store, migration(c, d), f"{root}/target"


_TEXTS = "with b as (select text, bool_or(lang = 'en') as used from documents where text is not null group by text)"


@query(f"""{_TEXTS} select 'documents' as name, ((select count(*) from orders where o_orderstatus <> 'P') + (select count(*) from documents))::bigint as n
union all select 'dropped', count(*)::bigint from orders where o_orderstatus = 'P' union all select 'blobs', count(*) filter (used)::bigint from b
union all select 'bytes', (sum(strlen(text)) filter (used))::bigint from b
union all select 'verified documents', ((select count(*) from orders where o_orderstatus <> 'P') + (select count(*) from documents))::bigint
union all select 'verified blobs', count(*) filter (used)::bigint from b""")
def store_migrate_verify(spark, sf_dir):
    """A store is migrated, opened again and verified."""
    store, m, path = _store(spark, sf_dir)
    done = migrate(store, m, path)
    checked = verify(store, m, Store.open(spark, path))
    return spark.createDataFrame([*done.items(), *((f"verified {k}", n) for k, n in checked.items())], "name string, n long")


@query("""select o_orderkey, o_custkey as buyer, o_orderstatus, cast(greatest(-32768, least(32767, trunc(o_totalprice))) as smallint) as o_totalprice from orders where o_orderstatus <> 'P'""")
def store_scan(spark, sf_dir):
    """The migrated table as the target store gives it."""
    store, m, path = _store(spark, sf_dir)
    migrate(store, m, path)
    rows = Store.open(spark, path).attachment("Shop::Orders.orders")
    return rows.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "buyer", "o_orderstatus", "o_totalprice")


@query(f"""{_TEXTS} select 'documents' as name, ((select count(*) from orders where o_orderstatus <> 'P') + (select count(*) from documents))::bigint as n
union all select 'dropped', count(*)::bigint from orders where o_orderstatus = 'P' union all select 'referenced_blobs', count(*) filter (used)::bigint from b
union all select 'orphans', count(*) filter (not used)::bigint from b
union all select 'saturate', (select count(*) from orders where o_orderstatus <> 'P' and trunc(o_totalprice) not between -32768 and 32767)::bigint
union all select 'drop-record', (select count(*) from orders where o_orderstatus = 'P')::bigint""")
def store_dry_run(spark, sf_dir):
    """What a migration would do, without writing."""
    store, m, _ = _store(spark, sf_dir)
    r = dry_run(store, m, 0)
    rows = [(k, getattr(r, k)) for k in ("documents", "dropped", "referenced_blobs", "orphans")]
    return spark.createDataFrame(rows + [(f.policy, f.count) for f in r.findings if f.policy != "report"], "name string, n long")


# --- Keys and dynamic values ----------------------------------------------------------------------

@query("""select o_orderkey, 'concept' as flavour, 'Shop::Client' as type, 'Shop::Client' as concept, cast(o_custkey as varchar) as instance_id from orders""")
def key_rewrite(spark, sf_dir):
    c = shop({"orders": ("o_orderkey", {"buyer": T.key("Shop::Customer")}), "customer": TABLES["customer"]})
    name = F.lit("Shop::Customer")
    key = F.struct(F.lit("concept").alias("flavour"), name.alias("type"), name.alias("concept"), F.col("o_custkey").cast("string").alias("instance_id"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", key.alias("buyer"))
    return project(spark, sf_dir, "orders", Directives().rename_type("Shop::Customer", "Client"), c, rows).select("o_orderkey", "buyer.*")


@query("""select c_custkey, 'Shop::Money' as type_id, cast(least(32767, greatest(-32768, trunc(c_acctbal))) as integer) as amount from customer""")
def any_rewrite(spark, sf_dir):
    money = Struct("Shop::Balance", (Field("balance", DBL),))
    c = shop({"customer": ("c_custkey", {"extra": T.ANY})}, (money,))
    extra = F.struct(F.lit("Shop::Balance").alias("type_id"), F.to_json(F.struct(F.col("c_acctbal").alias("balance"))).alias("value"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", extra.alias("extra"))
    d = Directives().rename_type("Shop::Balance", "Money").rename_field("Shop::Balance", "balance", "amount").retype_field("Shop::Balance", "balance", I16, "saturate")
    return project(spark, sf_dir, "customer", d, c, rows).select("c_custkey", "extra.type_id", F.get_json_object("extra.value", "$.amount").cast("int").alias("amount"))


@query("""select c_custkey, c_name as label, cast(least(32767, greatest(-32768, trunc(c_acctbal))) as integer) as amount from customer""")
def nested_struct(spark, sf_dir):
    inner = Struct("Shop::Account", (Field("name", STR), Field("balance", DBL)))
    c = shop({"customer": ("c_custkey", {"account": T.ref("Shop::Account")})}, (inner,))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("account"))
    d = Directives().rename_field("Shop::Account", "name", "label").retype_field("Shop::Account", "balance", I16, "saturate")
    return project(spark, sf_dir, "customer", d, c, rows).select("c_custkey", "account.label", F.col("account.balance").cast("int").alias("amount"))


# --- Diagnostics, verification, blobs -------------------------------------------------------------

@query("""select 'OrdersDoc.o_totalprice' as path, 'double→int16 truncate' as op, 'report' as policy,
  count(*) filter (trunc(o_totalprice) between -32768 and 32767 and o_totalprice <> round(o_totalprice)) as count from orders where o_orderstatus <> 'P'
union all select 'OrdersDoc.o_totalprice', 'double→int16 edge', 'saturate', count(*) filter (trunc(o_totalprice) not between -32768 and 32767) from orders where o_orderstatus <> 'P'
union all select 'OrdersDoc.o_orderstatus', 'remove-case', 'drop-record', count(*) filter (o_orderstatus = 'P') from orders""")
def diagnostics_counts(spark, sf_dir):
    """Offenders by site; records that an earlier site drops count at no later one."""
    d = Directives().remove_case("Shop::Status", "P", "drop-record").retype_field(doc("orders"), "o_totalprice", I16, "saturate")
    m = migration(of("orders"), d)
    return counts(Compiler(m).projection(m.source.attachment("orders")), load(spark, sf_dir, "orders"))


@query("""select cast(o_orderkey as varchar) as key, case when o_orderkey % 7 = 0 then 'missing' else 'differs' end as problem from orders
where o_orderkey % 7 = 0 or o_orderkey % 11 = 0 union all select cast(-1 - o_orderkey as varchar), 'spurious' from orders where o_orderkey % 13 = 0""")
def verify_diff(spark, sf_dir):
    """A target with missing, altered and spurious rows against what the source gives."""
    m = migration(of("orders"), Directives().retype_field(doc("orders"), "o_totalprice", I16, "saturate"))
    p = Compiler(m).projection(m.source.attachment("orders"))
    good = p.select(load(spark, sf_dir, "orders"))
    bad = good.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 == 0, F.lit(-2)).otherwise(F.col("o_totalprice")).cast("smallint"))
    bad = bad.unionByName(good.where("o_orderkey % 13 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    return differences(good, bad, p.target, m.target)


def _blob_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "documents")
    held = F.when(F.col("lang") == "en", F.array(F.sha1(F.col("text").cast("binary")))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", held.alias("blobs"))


@query("""select distinct sha1(text) as blob_id from documents where lang = 'en' and text is not null""")
def blobs_referenced(spark, sf_dir):
    c = shop({"documents": ("doc_id", {"blobs": T.vector(T.prim("blob_id"))})})
    return referenced_blobs(c, [(c.attachment("documents"), _blob_rows(spark, sf_dir))], spark)


@query("""select distinct sha1(text) as blob_id from documents where text is not null
except select sha1(text) from documents where lang = 'en' and text is not null""")
def blobs_orphaned(spark, sf_dir):
    have = load(spark, sf_dir, "documents").select(F.sha1(F.col("text").cast("binary")).alias("blob_id")).distinct()
    return have.join(blobs_referenced(spark, sf_dir), "blob_id", "left_anti")


@query("""select * from (values
 ('rename-field', 'Shop::OrdersDoc.o_custkey', 'buyer', 'A', '', ''), ('drop-field', 'Shop::OrdersDoc.o_orderpriority', '', 'A', 'the field''s values go', ''),
 ('retype-field', 'Shop::OrdersDoc.o_totalprice', 'double to int16', 'B', 'values out of range', 'saturate'),
 ('remove-case', 'Shop::Status.P', 'O', 'B', 'values of the case', 'map-case')) t(kind, target, detail, loss_class, loss, policy)""")
def plan_report(spark, sf_dir):
    d = Directives().rename_field(doc("orders"), "o_custkey", "buyer").drop_field(doc("orders"), "o_orderpriority").retype_field(doc("orders"), "o_totalprice", I16, "saturate")
    d.remove_case("Shop::Status", "P", map_case("O"))
    return spark.createDataFrame([tuple(vars(c).values()) for c in plan(of("orders"), d).changes], "kind string, target string, detail string, loss_class string, loss string, policy string")


@query("""select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders""")
def identity(spark, sf_dir):
    return project(spark, sf_dir, "orders", Directives())


# --- Commit logs ----------------------------------------------------------------------------------

_EVENT = shop({"event": ("event_id", {"amount": DBL, "kind": STR, "note": T.optional(STR)}), "audit": ("audit_id", {"kind": STR})})
EVENT = "Shop::Event.event"


def _log_migration() -> Migration:
    d = Directives().retype_field(doc("event"), "amount", T.prim("int8"), "saturate").rename_field(doc("event"), "kind", "label").drop_attachment("audit")
    return migration(_EVENT, d)


def _log(spark, sf_dir) -> L.Log:
    """An event is a commit on the one before it of its user. Views are audits, errors update the
    amount at its path, the others set the whole document."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    cid = lambda c: F.when(c.isNotNull(), F.sha1(c.cast("string").cast("binary")))
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    commits = rows.select(cid(F.col("event_id")).alias("commit_id"), F.lit("Mutations").alias("commit_type"), F.col("event_type").alias("label"), cid(before).alias("parent_id"), F.lit(None).cast("string").alias("target_id"))
    kind, whole = F.col("event_type"), F.to_json(F.struct(F.col("value").alias("amount"), F.col("event_type").alias("kind")))
    empty, at = F.expr(f"cast(array() as {L.PATH})"), F.expr(f"cast(array(named_struct('kind', 'Field', 'name', 'amount', 'idx', cast(null as int), 'key', cast(null as string))) as {L.PATH})")
    ops = rows.select(
        cid(F.col("event_id")).alias("commit_id"), F.lit(0).alias("op_index"), F.when(kind == "error", "Document_Update").otherwise("Document_Set").alias("verb"),
        F.when(kind == "view", "Shop::Audit.audit").otherwise(EVENT).alias("attachment"), F.col("user_id").cast("string").alias("key"),
        F.when(kind == "error", at).otherwise(empty).alias("path"), F.when(kind == "error", F.col("value").cast("string")).when(kind == "view", F.to_json(F.struct(kind.alias("kind")))).otherwise(whole).alias("value"),
        F.lit(None).cast("string").alias("position"), F.lit(None).cast("string").alias("before_position"))
    return L.Log(commits, ops, _EVENT)


def _remap_sql() -> str:
    digest = _log_migration().target.digest()
    new = lambda x: f"sha1(sha1(cast({x} as varchar)) || '{digest}')"
    return f"""with e as (select *, lag(event_id) over (partition by user_id order by event_id) as before from events)
select {new('event_id')} as commit_id, 'Mutations' as commit_type, event_type as label, case when before is not null then {new('before')} end as parent_id from e"""


@query(_remap_sql())
def commit_remap(spark, sf_dir):
    return L.migrate_log(_log(spark, sf_dir), _log_migration()).commits.drop("target_id")


@query(f"""select sha1(sha1(cast(event_id as varchar)) || '{_log_migration().target.digest()}') as commit_id, cast(user_id as varchar) as key,
  case when event_type = 'error' then 'Document_Update' else 'Document_Set' end as verb, case when event_type <> 'error' then event_type end as label,
  cast(least(127, greatest(-128, trunc(value))) as integer) as amount from events where event_type <> 'view'""")
def opcode_rewrite(spark, sf_dir):
    ops = L.migrate_log(_log(spark, sf_dir), _log_migration()).opcodes
    amount = F.when(F.col("verb") == "Document_Update", F.col("value")).otherwise(F.get_json_object("value", "$.amount"))
    return ops.select("commit_id", "key", "verb", F.when(F.col("verb") == "Document_Set", F.get_json_object("value", "$.label")).alias("label"), amount.cast("int").alias("amount"))


@query("""with e as (select *, row_number() over (partition by user_id order by event_id) as n from events where event_type <> 'view')
select cast(user_id as varchar) as key, arg_max(event_type, n) filter (event_type <> 'error') as kind, arg_max(value, n) as amount from e group by user_id having count(*) filter (event_type <> 'error') > 0""")
def opcode_fold(spark, sf_dir):
    """The document of each key: whole writes and updates of the amount, the last one of each field; a
    user's events form a chain, so depth is its rank."""
    log = _log(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    order = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.sha1(F.col("event_id").cast("string").cast("binary")).alias("commit_id"), rank.alias("depth"))
    return L.state_at(log, order, EVENT).select("key", F.get_json_object("value", "$.kind").alias("kind"), F.get_json_object("value", "$.amount").cast("double").alias("amount"))


_LINES = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"


@query(f"""select cast(l_orderkey as varchar) as key, cast({_LINES} as integer) as op_index, cast(cast(l_quantity as integer) as varchar) as value from lineitem""")
def opcode_fusion(spark, sf_dir):
    """Each line is inserted without value and then updated; the pair becomes one insert. Lines stand in
    their order by all columns."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.expr(_LINES).alias("n"), F.col("l_quantity").cast("int").cast("string").alias("q"))
    key = F.col("l_orderkey").cast("string")
    op = lambda verb, at, value: F.struct(at.alias("op_index"), F.lit(verb).alias("verb"), value.alias("value"))
    pairs = F.array(op("XArray_Insert", F.col("n") * 2, F.lit(None).cast("string")), op("XArray_Update", F.col("n") * 2 + 1, F.col("q")))
    ops = rows.select(key.alias("commit_id"), key.alias("key"), F.col("n").cast("string").alias("position"), F.explode(pairs).alias("o")).select(
        "commit_id", "key", "position", "o.*", F.lit(EVENT).alias("attachment"), F.expr(f"cast(array() as {L.PATH})").alias("path"))
    return L.fused(ops).select("key", (F.col("op_index") / 2).cast("int").alias("op_index"), "value")


def _hex(c):
    return F.when(c.isNotNull(), F.sha1(c.cast("string").cast("binary")))


def _log_of(rows: DataFrame, catalog: Catalog, id_column: str, attachment: str, verb, name, value, position=None) -> L.Log:
    """A log with a commit and an opcode for each row, at a field of the document or (null) the whole."""
    cid, text = _hex(F.col(id_column)), F.lit(None).cast("string")
    path = F.when(name.isNotNull(), F.array(F.struct(F.lit("Field").alias("kind"), name.alias("name"), F.lit(None).cast("int").alias("idx"), text.alias("key")))).otherwise(F.array()).cast(L.PATH)
    ops = rows.select(cid.alias("commit_id"), F.lit(0).alias("op_index"), verb.alias("verb"), F.lit(attachment).alias("attachment"), F.col(id_column).cast("string").alias("key"), path.alias("path"), value.alias("value"), (text if position is None else position).alias("position"), text.alias("before_position"))
    return L.Log(rows.select(cid.alias("commit_id"), F.lit("Mutations").alias("commit_type"), F.lit("x").alias("label"), text.alias("parent_id"), text.alias("target_id")), ops, catalog)


_LINK = shop({"link": ("link_id", {"prev": T.optional(T.prim("commit_id")), "note": STR})})
_LINK_MIGRATION = migration(_LINK, Directives().rename_field(doc("link"), "note", "text"))


@query(f"""with e as (select *, lag(event_id) over (partition by user_id order by event_id) as before from events),
o as (select event_id, event_type, case when event_type = 'click' then sha1('far' || event_id) else sha1(cast(before as varchar)) end as old, event_type <> 'click' and before is not null as own from e)
select cast(event_id as varchar) as key, case when own then sha1(old || '{_LINK_MIGRATION.target.digest()}') else old end as prev, case when event_type <> 'error' then old end as text from o""")
def log_value_remap(spark, sf_dir):
    """Commit ids inside values: those of the log change, those of elsewhere and strings stay."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("before", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    update = F.col("event_type") == "error"
    rows = rows.withColumn("old", F.when(F.col("event_type") == "click", _hex(F.concat(F.lit("far"), "event_id"))).otherwise(_hex(F.col("before"))))
    value = F.when(update, F.coalesce(F.concat(F.lit('"'), "old", F.lit('"')), F.lit("null"))).otherwise(F.to_json(F.struct(F.col("old").alias("prev"), F.col("old").alias("note")), {"ignoreNullFields": "false"}))
    log = _log_of(rows, _LINK, "event_id", "Shop::Link.link", F.when(update, "Document_Update").otherwise("Document_Set"), F.when(update, "prev"), value)
    ops = L.migrate_log(log, _LINK_MIGRATION).opcodes
    alone = F.col("verb") == "Document_Update"
    prev = F.when(alone, F.when(F.col("value") != "null", F.btrim("value", F.lit('"')))).otherwise(F.get_json_object("value", "$.prev"))
    return ops.select("key", prev.alias("prev"), F.get_json_object(F.when(~alone, F.col("value")), "$.text").alias("text"))


_VERB_CATALOG = shop({"log": ("log_id", {"total": I64, "tags": T.set_of(STR), "attrs": T.map_of(STR, I64), "lines": T.xarray(I64), "thumb": T.optional(T.prim("blob_id"))})})
_VERB_MIGRATION = migration(_VERB_CATALOG, Directives().rename_field(doc("log"), "tags", "labels").retype_field(doc("log"), "total", I32, "saturate").retype_field(
    doc("log"), "attrs", T.map_of(STR, I32), "saturate").retype_field(doc("log"), "lines", T.xarray(I32), "saturate"))
_VERB_FIELDS = (("Document_Set", None), ("Document_Update", "total"), ("Set_Union", "tags"), ("Set_Subtract", "tags"), ("Map_Union", "attrs"), ("Map_Update", "attrs"), ("Map_Subtract", "attrs"),
                ("XArray_Insert", "lines"), ("XArray_Update", "lines"), ("XArray_Remove", "lines"))


def _verb_log(spark, sf_dir) -> L.Log:
    """Every verb, by event_id mod 10."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"n": F.col("event_id") % 10, "v": (F.col("event_id") * 1000003).cast("string")})
    pick = lambda texts: F.element_at(F.array(*map(F.lit, texts)), F.col("n").cast("int") + 1)
    some = F.concat(F.lit('{"k":'), "v", F.lit("}"))
    whole = F.concat(F.lit('{"total":'), "v", F.lit(',"tags":["t"],"attrs":{"k":'), "v", F.lit('},"lines":[],"thumb":"'), _hex(F.col("event_id")), F.lit('"}'))
    value = F.when(F.col("n") == 0, whole).when(F.col("n").isin(1, 7, 8), F.col("v")).when(F.col("n").isin(2, 3), F.lit('["t"]')).when(F.col("n").isin(4, 5), some).when(F.col("n") == 6, F.lit('["k"]'))
    log = _log_of(rows, _VERB_CATALOG, "event_id", "Shop::Log.log", pick([v for v, _ in _VERB_FIELDS]), pick([f for _, f in _VERB_FIELDS]), value, F.when(F.col("n") >= 7, "p"))
    return L.Log(log.commits, log.opcodes, log.catalog, rows.select(_hex(F.col("event_id")).alias("blob_id")))


@query("""with e as (select event_id, event_id % 10 as n, cast(least(event_id * 1000003, 2147483647) as varchar) as v from events)
select cast(event_id as varchar) as key, ['Document_Set', 'Document_Update', 'Set_Union', 'Set_Subtract', 'Map_Union', 'Map_Update', 'Map_Subtract', 'XArray_Insert', 'XArray_Update', 'XArray_Remove'][n + 1] as verb,
  ['', 'total', 'labels', 'labels', 'attrs', 'attrs', 'attrs', 'lines', 'lines', 'lines'][n + 1] as field,
  case when n = 0 then '{"total":' || v || ',"labels":["t"],"attrs":{"k":' || v || '},"lines":[],"thumb":"' || sha1(cast(event_id as varchar)) || '"}'
       when n in (1, 7, 8) then v when n in (2, 3) then '["t"]' when n in (4, 5) then '{"k":' || v || '}' when n = 6 then '["k"]' end as value from e""")
def log_verbs(spark, sf_dir):
    """All ten verbs through renamed and narrowed fields."""
    ops = L.migrate_log(_verb_log(spark, sf_dir), _VERB_MIGRATION).opcodes
    return ops.select("key", "verb", F.coalesce(F.get("path", F.lit(0))["name"], F.lit("")).alias("field"), "value")


@query("""select sha1(cast(event_id as varchar)) as blob_id from events where event_id % 10 = 0""")
def log_blobs(spark, sf_dir):
    """Of a log's blobs those that its values refer to."""
    return L.migrate_log(_verb_log(spark, sf_dir), _VERB_MIGRATION).blobs


@query("""with e as (select event_id % 10 as n, event_id * 1000003 > 2147483647 as wide from events)
select 'opcodes' as name, count(*)::bigint as n from e union all select 'commits', count(*)::bigint from e
union all select 'referenced_blobs', count(*) filter (n = 0) from e union all select 'stranded_blobs', count(*) filter (n <> 0) from e
union all select 'narrowed', (count(*) filter (wide and n in (1, 4, 5, 7, 8)) + 2 * count(*) filter (wide and n = 0))::bigint from e""")
def log_dry_run(spark, sf_dir):
    """What a rewrite would meet, without writing."""
    r = L.dry_run_log(_verb_log(spark, sf_dir), _VERB_MIGRATION)
    rows = [(k, r[k]) for k in ("opcodes", "commits", "referenced_blobs", "stranded_blobs")] + [("narrowed", sum(r["diagnostics"].values()))]
    return spark.createDataFrame(rows, "name string, n long")


@query("""select 'commits' as name, count(*)::bigint as n from events union all select 'opcodes', count(*)::bigint from events""")
def log_verify(spark, sf_dir):
    """A target that is what its source gives."""
    log = _verb_log(spark, sf_dir)
    r = L.verify_log(log, _VERB_MIGRATION, L.migrate_log(log, _VERB_MIGRATION))
    return spark.createDataFrame(list(r.items()), "name string, n long")


@query("""select sha1(cast(event_id as varchar)) as commit_id, cast(row_number() over (partition by user_id order by event_id) - 1 as integer) as depth from events""")
def log_depth(spark, sf_dir):
    """The place of each commit in the history: a user's events are a chain."""
    return L.linear_order(_log(spark, sf_dir).commits)
