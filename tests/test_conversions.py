"""Conversions against the rules restated in plain Python."""

import math
import random
from decimal import Decimal

import pytest
from helpers import DOC, catalog, one_field, rewritten

from driftloom.catalog import types as T
from driftloom.functions.convert import WIDENING, lossy
from driftloom.functions.nodes import Refused
from driftloom.plans.build import build
from driftloom.plans.directives import Directives, default, fit

FLOATS = [0.0, 1.9, -1.9, 127.0, 127.5, 128.0, -128.9, -129.0, 1e10, 2.0**31, -(2.0**31) - 0.5, 2.0**63, -(2.0**63), 1e300, math.nan, math.inf, -math.inf]
TEXTS = ["7", " 8 ", "+9", "-10", "1_000", "abc", "", "1.5", "1__0", "99999999999999999999", "0x1", "1e3", "127", "128"]


def py_int(text, low, high):
    try:
        v = int(text)
    except ValueError:
        return None
    return v if low <= v <= high else None


def saturate(x, low, high):
    if math.isnan(x) or x == -math.inf:
        return low
    if x == math.inf:
        return high
    return min(max(math.trunc(x), low), high)


def test_sixteen_widenings():
    assert len(WIDENING) == 16 and all(lossy(T.prim(a), T.prim(b)) == "" for a, b in WIDENING)


@pytest.mark.parametrize("kind", ["int8", "int32", "int64", "uint8", "uint64"])
def test_float_to_int_saturates(spark, kind):
    low, high = T.INT_RANGE[kind]
    got = one_field(spark, T.DOUBLE, T.prim(kind), "saturate", FLOATS)
    assert {k: int(v) for k, v in got.items()} == {i: saturate(x, low, high) for i, x in enumerate(FLOATS)}


def test_float_to_int_policies(spark):
    inside = {i: math.trunc(x) for i, x in enumerate(FLOATS) if math.isfinite(x) and -129 < x < 128}
    assert one_field(spark, T.DOUBLE, T.prim("int8"), "drop-record", FLOATS) == inside
    got = one_field(spark, T.DOUBLE, T.prim("int8"), default(-7), FLOATS)
    assert got == {i: inside.get(i, -7) for i in range(len(FLOATS))}


@pytest.mark.parametrize(("kind", "low", "high"), [("int8", -128, 127), ("int32", -(2**31), 2**31 - 1)])
def test_texts_to_int(spark, kind, low, high):
    want = {i: py_int(x, low, high) for i, x in enumerate(TEXTS)}
    assert one_field(spark, T.STRING, T.prim(kind), default(-1), TEXTS) == {i: -1 if v is None else v for i, v in want.items()}
    assert one_field(spark, T.STRING, T.prim(kind), "drop-record", TEXTS) == {i: v for i, v in want.items() if v is not None}


def test_texts_to_double(spark):
    texts = ["1.5", "1e3", "-2.", ".5", "1_0.5", "nan", "-inf", "Infinity", "1d", "1.5f", "", "x", "1e", "0x10"]
    got = one_field(spark, T.STRING, T.DOUBLE, default(-9.0), texts)
    for i, t in enumerate(texts):
        try:
            want = float(t)
        except ValueError:
            want = -9.0
        assert got[i] == want or math.isnan(want) and math.isnan(got[i]), t


def test_narrowing(spark):
    values = [0, 127, 128, -128, -129, 2**40, -(2**62)]
    assert one_field(spark, T.INT64, T.prim("int8"), "saturate", values) == {i: min(max(v, -128), 127) for i, v in enumerate(values)}
    assert one_field(spark, T.INT64, T.prim("uint8"), default(1), values) == {i: v if 0 <= v <= 255 else 1 for i, v in enumerate(values)}
    assert one_field(spark, T.INT64, T.INT32, "drop-record", values) == {i: v for i, v in enumerate(values) if -(2**31) <= v < 2**31}
    assert one_field(spark, T.prim("uint64"), T.INT64, "saturate", [Decimal(2**64 - 1), Decimal(5)]) == {0: 2**63 - 1, 1: 5}


def test_narrowing_refused_at_an_offender(spark):
    assert one_field(spark, T.INT64, T.INT32, "fail", [1, 2]) == {0: 1, 1: 2}
    with pytest.raises(Exception, match="narrow int64→int32"):
        one_field(spark, T.INT64, T.INT32, "fail", [1, 2**40])


def test_refusal_survives_count(spark):
    from driftloom.operators.projection import Compiler

    c = catalog({"x": T.INT64, "y": T.INT64})
    p = Compiler(build(c, Directives().retype_field(DOC, "x", T.INT32, "fail"))).projection(c.attachment("Docs"))
    from helpers import frame

    with pytest.raises(Exception, match="no target value"):
        p.select(frame(spark, c, [("a", 2**40, 1)])).select("y").count()


def test_to_string(spark):
    assert one_field(spark, T.BOOL, T.STRING, None, [True, False]) == {0: "True", 1: "False"}
    assert one_field(spark, T.INT64, T.STRING, None, [5, -6]) == {0: "5", 1: "-6"}
    values = [1e16, 1e-5, 0.1, 1.0, 123456789.123, math.nan, math.inf, -0.0, 1e15]
    assert one_field(spark, T.DOUBLE, T.STRING, None, values) == {i: repr(v) for i, v in enumerate(values)}
    assert one_field(spark, T.vector(T.DOUBLE), T.vector(T.STRING), None, [[1e16, 0.5], []]) == {0: ["1e+16", "0.5"], 1: []}


def test_other_numbers(spark):
    assert one_field(spark, T.DOUBLE, T.FLOAT, default(0.0), [0.5, 0.1, 1e300]) == {0: 0.5, 1: 0.0, 2: 0.0}
    assert one_field(spark, T.INT64, T.DOUBLE, default(-1.0), [5, 2**53 + 1]) == {0: 5.0, 1: -1.0}


def test_optional(spark):
    nil = T.optional(T.INT32)
    assert one_field(spark, nil, T.INT32, default(0), [9, None]) == {0: 9, 1: 0}
    assert one_field(spark, nil, T.INT32, "drop-record", [9, None]) == {0: 9}
    assert one_field(spark, T.INT32, nil, None, [9]) == {0: 9}
    assert one_field(spark, T.optional(T.INT64), T.optional(T.prim("int8")), "saturate", [900, None]) == {0: 127, 1: None}
    with pytest.raises(Exception, match="nil-unwrap"):
        one_field(spark, nil, T.INT32, "fail", [None])


def test_sets_vectors_xarrays(spark):
    v, s, x = T.vector(T.INT32), T.set_of(T.INT32), T.xarray(T.INT32)
    assert one_field(spark, v, s, "fail", [[3, 1, 2, 3, 2, 3]]) == {0: [1, 2, 3]}
    assert one_field(spark, s, v, None, [[2, 1]]) == {0: [1, 2]}
    made = one_field(spark, v, x, None, [[10, 20]])[0]
    assert [(e["pos"], e["live"], e["value"]) for e in made] == [("00000001-0000-0000-0000-000000000000", True, 10), ("00000001-0000-0000-0000-000000000001", True, 20)]
    assert one_field(spark, x, v, None, [[("p", True, 10), ("q", False, 20), ("r", True, 30)]]) == {0: [10, 30]}


def test_fixed_sizes(spark):
    assert one_field(spark, T.vec(T.INT32, 2), T.vector(T.INT32), None, [[1, 2]]) == {0: [1, 2]}
    assert one_field(spark, T.mat(T.INT32, 2, 2), T.vector(T.INT32), None, [[[1, 2], [3, 4]]]) == {0: [1, 2, 3, 4]}
    rows = [[1, 2, 3], [1], [1, 2, 3, 4]]
    assert one_field(spark, T.vector(T.INT32), T.vec(T.INT32, 3), fit(0), rows) == {0: [1, 2, 3], 1: [1, 0, 0], 2: [1, 2, 3]}
    assert one_field(spark, T.vector(T.INT32), T.vec(T.INT32, 3), "drop-record", rows) == {0: [1, 2, 3]}


@pytest.mark.parametrize("wrap", [T.vector, T.set_of, T.xarray, lambda t: T.vec(t, 2)])
def test_elements_saturate(spark, wrap):
    x = wrap(T.INT64).kind == "xarray"
    values = [("p", True, 5), ("q", True, 900)] if x else [5, 900]
    got = one_field(spark, wrap(T.INT64), wrap(T.prim("int8")), "saturate", [values])[0]
    assert [e["value"] if x else e for e in got] == [5, 127]


def test_set_collapse_guard(spark):
    a, b = T.set_of(T.INT64), T.set_of(T.prim("int8"))
    with pytest.raises(Exception, match="set-collapse"):
        one_field(spark, a, b, "saturate", [[500, 600]])
    assert one_field(spark, a, b, "saturate", [[500, 600, 1]], winner="first") == {0: [1, 127]}


def test_map_keys_collide(spark):
    a, b = T.map_of(T.INT64, T.STRING), T.map_of(T.prim("int8"), T.STRING)
    values = [{500: "x", 600: "y", 1: "z"}]
    with pytest.raises(Exception, match="map-collision"):
        one_field(spark, a, b, "saturate", values)
    assert one_field(spark, a, b, "saturate", values, winner="first") == {0: {1: "z", 127: "x"}}
    assert one_field(spark, a, b, "saturate", values, winner="last") == {0: {1: "z", 127: "y"}}


def test_tuples_and_variants(spark):
    assert one_field(spark, T.tuple_of(T.INT64, T.STRING), T.tuple_of(T.prim("int8"), T.STRING), "saturate", [(900, "a")]) == {0: {"_0": 127, "_1": "a"}}
    a, b = T.variant(T.INT32, T.STRING, T.DOUBLE), T.variant(T.STRING, T.INT32)
    values = [("int32", 5, None, None), ("string", None, "s", None), ("double", None, None, 2.5)]
    want = {0: {"tag": "int32", "a0": None, "a1": 5}, 1: {"tag": "string", "a0": "s", "a1": None}}
    assert one_field(spark, a, b, "drop-record", values) == want
    assert one_field(spark, a, b, default(-1), values) == want | {2: {"tag": "int32", "a0": None, "a1": -1}}
    with pytest.raises(Exception, match="variant arm removed"):
        one_field(spark, a, b, "fail", values)


def test_resizing(spark):
    c = catalog({"v": T.vec(T.INT32, 3), "m": T.mat(T.INT32, 2, 2)})
    rows = [("a", [1, 2, 3], [[1, 2], [3, 4]])]
    d = Directives().resize_vec_field(DOC, "v", 5, fill=9).resize_mat_field(DOC, "m", 3, 3)
    assert rewritten(spark, c, d, rows)["a"] == {"v": [1, 2, 3, 9, 9], "m": [[1, 2, 0], [3, 4, 0], [0, 0, 1]]}
    d = Directives().resize_vec_field(DOC, "v", 2, on_shrink="accept").resize_mat_field(DOC, "m", 2, 1, on_shrink="accept")
    assert rewritten(spark, c, d, rows)["a"] == {"v": [1, 2], "m": [[1], [3]]}
    with pytest.raises(Exception, match="resize-shrink"):
        rewritten(spark, c, Directives().resize_vec_field(DOC, "v", 2), rows)
    c = catalog({"m": T.mat(T.INT32, 2, 3)})
    assert rewritten(spark, c, Directives().transpose_mat_field(DOC, "m"), [("a", [[0, 1, 2], [3, 4, 5]])])["a"]["m"] == [[0, 3], [1, 4], [2, 5]]


@pytest.mark.parametrize(("a", "b"), [
    (T.vec(T.INT32, 4), T.mat(T.INT32, 2, 2)), (T.vec(T.INT32, 3), T.vec(T.INT32, 4)), (T.vector(T.INT32), T.mat(T.INT32, 2, 2)),
    (T.vector(T.INT32), T.set_of(T.INT64)), (T.tuple_of(T.INT32), T.tuple_of(T.INT32, T.INT32)), (T.variant(T.INT32), T.INT32), (T.vector(T.INT32), T.STRING), (T.key("Demo::C"), T.key())])
def test_refused_when_built(a, b):
    with pytest.raises(Refused):
        build(catalog({"x": a}), Directives().retype_field(DOC, "x", b, "fail"))


def test_seeded_records(spark):
    """Every record is rewritten as the plain rules say, or dropped where they say so."""
    r = random.Random(7)
    rows = [(str(i), r.choice([r.uniform(-300, 300), math.nan, 1e30]), r.choice([None, r.randrange(300)]), [r.randrange(-300, 300) for _ in range(r.randrange(4))]) for i in range(200)]
    c = catalog({"amt": T.DOUBLE, "opt": T.optional(T.INT32), "vec": T.vector(T.INT32)})
    d = Directives().retype_field(DOC, "amt", T.prim("int8"), "drop-record").retype_field(DOC, "opt", T.INT32, "drop-record").retype_field(DOC, "vec", T.vector(T.prim("int8")), "saturate").accept_document_drops()
    want = {k: {"amt": math.trunc(a), "opt": o, "vec": [min(max(v, -128), 127) for v in vs]} for k, a, o, vs in rows if math.isfinite(a) and -129 < a < 128 and o is not None}
    assert rewritten(spark, c, d, rows) == want and 0 < len(want) < 200
