"""Conversions between logical types: retyping a field.

Lossless conversions need no policy. Lossy ones are refused until a policy is named, and the policy
decides on offending values only.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.catalog.catalog import Catalog
from driftloom.catalog.types import INT_RANGE, XARRAY_LIVE, XARRAY_POSITION, XARRAY_VALUE, Type
from driftloom.functions.nodes import (
    ARROW,
    IDENTITY,
    Fn,
    Node,
    Refused,
    Site,
    decided,
    guarded,
    lifted,
    one,
    over_array,
    python_node,
    summed,
)
from driftloom.plans.directives import FAIL

#: Integers that hold in another type whatever their value.
WIDENING = {(a, b) for a in INT_RANGE for b in INT_RANGE if a != b and a[0] == b[0] and INT_RANGE[b][0] <= INT_RANGE[a][0] and INT_RANGE[a][1] <= INT_RANGE[b][1]}
WIDENING |= {("int8", "double"), ("int16", "double"), ("int32", "double"), ("float", "double")}

_DIGITS = "[0-9](_?[0-9])*"
INT_FORM = rf"^\s*[+-]?{_DIGITS}\s*$"
FLOAT_FORM = rf"^\s*[+-]?(({_DIGITS}\.?({_DIGITS})?)|(\.{_DIGITS}))([eE][+-]?{_DIGITS})?\s*$"
FLOAT_NAME = r"^\s*[+-]?(inf|infinity|nan)\s*$"


def lossy(a: Type, b: Type) -> str:
    """Why converting a to b may lose something, "" where it cannot; raises Refused where there is
    no conversion. Named types count as equal to their images."""
    if a == b:
        return ""
    if a.kind == "optional" and b.kind != "optional":
        inner = "" if a.args[0] == b else lossy(a.args[0], b)
        return "nil has no value" + (f", {inner}" if inner else "")
    if b.kind == "optional" and a.kind != "optional":
        return lossy(a, b.args[0])
    if a.kind == "any" or b.kind == "any":
        raise Refused(f"[composite-retype] {a} to {b}")
    if a.is_scalar and b.is_scalar:
        return _lossy_scalar(a, b)
    pair = (a.kind, b.kind)
    if pair == ("vector", "set"):
        _same(a.args[0], b.args[0], a, b)
        return "equal elements collapse"
    if pair in (("set", "vector"), ("vector", "xarray"), ("xarray", "vector"), ("vec", "vector"), ("mat", "vector")):
        _same(a.args[0], b.args[0], a, b)
        return ""
    if pair == ("vector", "vec"):
        _same(a.args[0], b.args[0], a, b)
        return "lengths may differ"
    if a.kind != b.kind:
        raise Refused(f"[composite-retype] {a} to {b}")
    if a.kind in ("vec", "mat"):
        if a.dims != b.dims:
            raise Refused(f"[dimension-change] {a} to {b}: resize the field instead")
        return lossy(a.args[0], b.args[0])
    if a.kind == "tuple" and len(a.args) != len(b.args):
        raise Refused(f"[composite-retype] {a} to {b}: the arity differs")
    if a.kind == "variant":
        gone = [str(x) for x in a.args if x not in b.args]
        return f"removed arms: {', '.join(gone)}" if gone else ""
    if a.kind in ("vector", "set", "map", "xarray", "optional", "tuple"):
        parts = [x for x in map(lossy, a.args, b.args) if x]
        if a.kind == "set" or a.kind == "map" and a.args[0] != b.args[0]:
            parts += ["converted elements may collide"] if lossy(a.args[0], b.args[0]) else []
        return ", ".join(parts)
    raise Refused(f"[composite-retype] {a} to {b}")


def _same(x: Type, y: Type, a: Type, b: Type) -> None:
    if x != y:
        raise Refused(f"[composite-retype] {a} to {b}: the element type changes as well")


def _lossy_scalar(a: Type, b: Type) -> str:
    if (a.kind, b.kind) in WIDENING or b.kind == "string":
        return ""
    numeric = lambda t: t.is_int or t.is_float
    if a.kind == "string" and numeric(b):
        return "not every text is a number"
    if numeric(b) and (numeric(a) or a.kind == "bool" and b.is_int):
        return "" if a.kind == "bool" else "values out of range"
    raise Refused(f"[scalar-retype] {a} to {b}")


def scalar(a: Type, b: Type, policy: Any, path: str, catalog: Catalog) -> Node:
    target = catalog.spark_type(b)
    plain = lambda c: c.cast(target)
    if a == b:
        return IDENTITY
    if b.kind == "string":
        if a.kind == "bool":
            return guarded(lambda c: F.when(c, F.lit("True")).otherwise(F.lit("False")), ())
        return python_node(lambda v: repr(float(v)), target) if a.is_float else Node(plain)
    if (a.kind, b.kind) in WIDENING or a.kind == "bool":
        return Node(lambda c: c.cast("int").cast(target)) if a.kind == "bool" else Node(plain)
    if a.kind == "string":
        return decided(path, f"parse{ARROW}{b}", policy, lambda c: parsed(c, b, target).isNull(), lambda c: parsed(c, b, target), target)
    if a.is_int and b.is_int:
        low, high = _bounds(b)
        return decided(path, f"narrow {a}{ARROW}{b}", policy, lambda c: ~c.between(low, high), lambda c: c.try_cast(target), target,
                       lambda c: F.when(c < low, low.cast(target)).otherwise(high.cast(target)))
    if a.is_float and b.is_int:
        return _float_to_int(a, b, policy, path, target)
    # Other numbers: exact if they come back unchanged; the nearest finite number otherwise.
    back = catalog.spark_type(a)
    wrong = lambda c: ~F.coalesce((c.cast(target).try_cast(back) == c) | F.isnan(c.cast("double")), F.lit(False))
    limit = 3.4028234663852886e38
    near = lambda c: F.greatest(F.least(c.cast("double"), F.lit(limit)), F.lit(-limit)).cast(target) if b.kind == "float" else c.cast(target)
    return decided(path, f"narrow {a}{ARROW}{b}", policy, wrong, plain, target, near)


def _bounds(t: Type) -> tuple[Column, Column]:
    low, high = INT_RANGE[t.kind]
    return F.lit(low).cast("decimal(20,0)"), F.expr(f"cast('{high}' as decimal(20,0))")


def parsed(c: Column, b: Type, target) -> Column:
    """A number as Python's int() and float() read ASCII texts; null where they would not, or where
    the number is out of range."""
    bare = F.regexp_replace(c, r"[_\s]", "")
    if b.is_int:
        low, high = _bounds(b)
        wide = bare.try_cast("decimal(38,0)")
        return F.when(c.rlike(INT_FORM) & wide.between(low, high), wide.try_cast(target))
    name = F.lower(F.trim(bare))
    special = F.when(name.endswith("nan"), F.lit(float("nan"))).when(name.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(F.lower(c).rlike(FLOAT_NAME), special.cast(target)).when(c.rlike(FLOAT_FORM), bare.try_cast(target))


def _float_to_int(a: Type, b: Type, policy: Any, path: str, target) -> Node:
    low, high = INT_RANGE[b.kind]
    wild = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    # Truncation brings (low-1, high+1) into range; both ends are exact as doubles up to 53 bits, and
    # low - 1 is low itself beyond that, so low is then compared with "<".
    below = lambda c: c.cast("double") < float(low) if abs(low) >= 2**53 else c.cast("double") <= float(low - 1)
    above = lambda c: c.cast("double") >= float(high + 1)
    offends = lambda c: wild(c) | below(c) | above(c)
    cut = lambda c: _truncated(c, b, target)
    limit = lambda x: F.expr(f"cast('{x}' as decimal(20,0))").cast(target)
    saturated = lambda c: F.when(F.isnan(c) | below(c), limit(low)).otherwise(limit(high))
    inexact = lambda c: one(~offends(c) & (c.cast("double") != F.rint(c.cast("double"))))
    report = Site(path, f"{a}{ARROW}{b} truncate", None, inexact, acts=False, after=cut)
    return decided(path, f"{a}{ARROW}{b} edge", policy, offends, cut, target, saturated, (report,))


def _truncated(c: Column, b: Type, target) -> Column:
    if b.kind != "uint64":
        return c.try_cast("bigint").try_cast(target)
    high = F.floor(c.cast("double") / 2.0**32)  # both halves are exact
    low = F.floor(c.cast("double") - high.cast("double") * 2.0**32)
    return (high.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + low.cast("decimal(11,0)")).cast(target)


# --- Containers -----------------------------------------------------------------------------------

def sorted_set(c: Column, of: Type) -> Column:
    """Distinct elements in the total order of sets; NaN sorts before all other numbers."""
    distinct = F.array_distinct(c)
    if not of.is_float:
        return F.array_sort(distinct)
    return F.concat(F.filter(distinct, lambda x: F.isnan(x)), F.array_sort(F.filter(distinct, lambda x: ~F.isnan(x))))


def position(i: Column) -> Column:
    """The position given to the i-th element of a vector that becomes an xarray."""
    return F.format_string("00000001-0000-0000-0000-%012x", i)


def convert(a: Type, b: Type, policy: Any, path: str, catalog: Catalog, winner: str = FAIL) -> Node:
    """The node that converts values of a to b; both are types of the target catalog."""
    if a == b:
        return IDENTITY
    target = catalog.spark_type(b)
    sub = lambda x, y, tail: convert(x, y, policy, path + tail, catalog, winner)
    if a.kind == "optional" and b.kind != "optional":
        inner = sub(a.args[0], b, "")
        if isinstance(policy, tuple) and policy[0] == "default":
            value = lambda c: F.when(c.isNull(), F.lit(policy[1]).cast(target)).otherwise(inner.value(c))
        elif policy == "saturate":
            raise Refused(f"[policy] {path}: saturate does not apply to nil-unwrap")
        else:
            value = inner.value
        nil = Site(path, "nil-unwrap", policy, lambda c: one(c.isNull()), after=value)
        return Node(value, (nil, *inner.sites))
    if b.kind == "optional" and a.kind != "optional":
        return sub(a, b.args[0], "")
    if a.is_scalar and b.is_scalar:
        return scalar(a, b, policy, path, catalog)
    match a.kind, b.kind:
        case "vector", "set":
            value = lambda c: sorted_set(c, a.args[0])
            return Node(value, (Site(path, "set-collapse", policy, lambda c: one(F.size(c) != F.size(F.array_distinct(c))), acts=False, after=value),))
        case "set", "vector":
            return Node(lambda c: sorted_set(c, a.args[0]))
        case "vector", "xarray":
            return Node(lambda c: F.transform(c, lambda x, i: F.struct(position(i).alias(XARRAY_POSITION), F.lit(True).alias(XARRAY_LIVE), x.alias(XARRAY_VALUE))))
        case "xarray", "vector":
            return Node(lambda c: F.transform(F.filter(c, lambda x: x[XARRAY_LIVE]), lambda x: x[XARRAY_VALUE]))
        case "vec", "vector":
            return IDENTITY
        case "mat", "vector":
            return Node(F.flatten)  # columns one after the other
        case "vector", "vec":
            return _fit(b, policy, path, catalog)
        case ("vec", "vec") | ("vector", "vector"):
            return over_array(sub(a.args[0], b.args[0], "[i]" if a.kind == "vec" else "[]"))
        case "mat", "mat":
            return over_array(over_array(sub(a.args[0], b.args[0], "[c,r]")))
        case "set", "set":
            return _set(a, b, sub(a.args[0], b.args[0], "{}"), path, winner)
        case "map", "map":
            return _map(sub(a.args[0], b.args[0], "<key>"), sub(a.args[1], b.args[1], "<val>"), path, winner)
        case "xarray", "xarray":
            return over_xarray(sub(a.args[0], b.args[0], "[]"))
        case "optional", "optional":
            node = sub(a.args[0], b.args[0], "")
            return node if node.identity or node.python else guarded(node.value, node.sites)
        case "tuple", "tuple":
            return over_tuple([sub(x, y, f".{i}") for i, (x, y) in enumerate(zip(a.args, b.args, strict=True))])
        case "variant", "variant":
            return _variant(a, b, policy, path, catalog)
    raise Refused(f"[composite-retype] {path}: {a} to {b}")


def over_xarray(node: Node) -> Node:
    return lifted(node, lambda c, f: F.transform(c, lambda x: F.struct(x[XARRAY_POSITION].alias(XARRAY_POSITION), x[XARRAY_LIVE].alias(XARRAY_LIVE), f(x[XARRAY_VALUE]).alias(XARRAY_VALUE))),
                  lambda c: F.transform(c, lambda x: x[XARRAY_VALUE]))


def over_tuple(nodes: list[Node]) -> Node:
    if all(n.identity for n in nodes):
        return IDENTITY
    parts = [n.at((lambda i: lambda c: c[f"_{i}"])(i)) for i, n in enumerate(nodes)]
    return guarded(lambda c: F.struct(*(p.value(c).alias(f"_{i}") for i, p in enumerate(parts))), tuple(s for p in parts for s in p.sites))


def _fit(b: Type, policy: Any, path: str, catalog: Catalog) -> Node:
    n = b.dims[0]
    wrong = lambda c: F.size(c) != n
    op = f"Vector{ARROW}Vec length {n}"
    if isinstance(policy, tuple) and policy[0] == "fit":
        pad = F.lit(policy[1]).cast(catalog.spark_type(b.args[0]))
        value = lambda c: F.slice(F.concat(c, F.array_repeat(pad, n)), 1, n)
        return guarded(value, (Site(path, op, policy, lambda c: one(wrong(c)), after=value),))
    return decided(path, op, policy, wrong, lambda c: c, catalog.spark_type(b))


def _set(a: Type, b: Type, node: Node, path: str, winner: str) -> Node:
    inner = over_array(node)
    value = lambda c: sorted_set(inner.value(c), b.args[0])
    guard = Site(path, "set-collapse", None if winner == FAIL else winner, lambda c: one(F.size(c) != F.size(F.array_distinct(inner.value(c)))), after=value)
    return guarded(value, (*inner.sites, guard))


def _map(k: Node, v: Node, path: str, winner: str) -> Node:
    """Entries in the order of their source keys, so that first and last are well defined."""
    if k.identity and v.identity:
        return IDENTITY
    def value(c: Column) -> Column:
        rows = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
            e["key"].alias("was"), k.value(e["key"]).alias("key"), v.value(e["value"]).alias("value"))))
        if not k.identity:
            # The winner of a key is its first or last entry; the sorted rows and their keys are
            # bound once, as the one element of an array.
            last = winner == "last"
            bound = F.array(F.struct(rows.alias("rows"), F.transform(rows, lambda x: x["key"]).alias("keys")))
            won = lambda x, e: F.size(x["keys"]) + 1 - F.array_position(F.reverse(x["keys"]), e["key"]) if last else F.array_position(x["keys"], e["key"])
            rows = F.get(F.transform(bound, lambda x: F.filter(x["rows"], lambda e, i: won(x, e) == i + 1)), F.lit(0))
        return F.map_from_entries(F.transform(rows, lambda e: F.struct(e["key"], e["value"])))

    keys = lambda c: F.map_keys(c)
    sites = [*lifted(k, lambda c, f: c, keys).sites, *lifted(v, lambda c, f: c, lambda c: F.map_values(c)).sites]
    if not k.identity:
        hit = lambda c: one(F.size(c) != F.size(F.array_distinct(F.transform(keys(c), k.value))))
        sites.append(Site(path, "map-collision", None if winner == FAIL else winner, hit, after=value))
    return guarded(value, tuple(sites))


def over_map(k: Node, v: Node, path: str, winner: str) -> Node:
    return _map(k, v, path, winner)


def over_set(a: Type, b: Type, node: Node, path: str, winner: str) -> Node:
    return IDENTITY if node.identity else _set(a, b, node, path, winner)


def variant_value(arms: list[tuple[Type, Type, Node]], b: Type, catalog: Catalog) -> Fn:
    """Rebuilds a tagged union: (source arm, target arm, node) for the arms that stay."""
    def value(c: Column) -> Column:
        tag = F.coalesce(*(F.when(c["tag"] == str(x), F.lit(str(y))) for x, y, _ in arms))
        fields = []
        for i, y in enumerate(b.args):
            own = [(k, n) for k, (_, z, n) in enumerate(arms) if z == y]
            at = own[0][1].value(c[f"a{own[0][1].extra['arm']}"]) if own else F.lit(None).cast(catalog.spark_type(y))
            fields.append(at.alias(f"a{i}"))
        return F.struct(tag.alias("tag"), *fields)

    return value


def _variant(a: Type, b: Type, policy: Any, path: str, catalog: Catalog) -> Node:
    arms = [(x, x, Node(lambda c: c, identity=True, extra={"arm": i})) for i, x in enumerate(a.args) if x in b.args]
    gone = [x for x in a.args if x not in b.args]
    value, sites = variant_value(arms, b, catalog), []
    for x in gone:
        sites.append(Site(path, f"variant arm removed: {x}", policy, (lambda t: lambda c: one(c["tag"] == t))(str(x))))
    if not gone or policy in (None, FAIL, "drop-record"):
        return guarded(value, tuple(sites))
    if not (isinstance(policy, tuple) and policy[0] == "default"):
        raise Refused(f"[policy] {path}: {policy!r} does not apply to removed arms")
    # The default is a value of the first arm that takes it.
    wanted = policy[1]
    for i, y in enumerate(b.args):
        if isinstance(wanted, bool) == (y.kind == "bool") and (isinstance(wanted, str) == (y.kind == "string")):
            filler = F.struct(F.lit(str(y)).alias("tag"), *((F.lit(wanted) if j == i else F.lit(None)).cast(catalog.spark_type(z)).alias(f"a{j}") for j, z in enumerate(b.args)))
            return guarded(lambda c: F.when(c["tag"].isin(*map(str, gone)), filler).otherwise(value(c)), tuple(sites))
    raise Refused(f"[policy] {path}: no arm of {b} takes the default {wanted!r}")


# --- Vectors and matrices -------------------------------------------------------------------------

def resize(a: Type, b: Type, fill: Any, on_shrink: str, path: str, catalog: Catalog) -> Node:
    """Positions are kept; new ones take the fill, or the identity matrix's number."""
    element = catalog.spark_type(a.args[0])
    shrinks = any(x < y for x, y in zip(b.dims, a.dims, strict=True))
    constant = F.lit(0 if fill in ("zero", "identity") else fill).cast(element)
    if a.kind == "vec":
        (n,) = b.dims
        value = lambda c: F.slice(F.concat(c, F.array_repeat(constant, n)), 1, n)
    else:
        columns, rows = a.dims
        new_columns, new_rows = b.dims
        filler = (lambda ci, ri: F.when(ci == ri, F.lit(1).cast(element)).otherwise(F.lit(0).cast(element))) if fill == "identity" else lambda ci, ri: constant

        def value(c: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(new_columns - 1)), lambda ci: F.transform(F.sequence(F.lit(0), F.lit(new_rows - 1)), lambda ri: F.when(
                (ci < columns) & (ri < rows), F.get(F.get(c, ci), ri)).otherwise(filler(ci, ri))))

    if not shrinks:
        return guarded(value, ())
    # Every value is cut; that is known without looking at it.
    return guarded(value, (Site(path, "resize-shrink", None if on_shrink == FAIL else on_shrink, lambda c: one(c.isNotNull()), acts=on_shrink == FAIL, after=value),))


def transpose(a: Type) -> Node:
    columns, rows = a.dims
    return guarded(lambda c: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(
        F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: F.get(F.get(c, k), r))), ())


__all__ = ["convert", "lossy", "over_array", "over_map", "over_set", "over_tuple", "over_xarray", "resize", "summed", "transpose", "variant_value"]
