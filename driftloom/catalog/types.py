"""Logical types and their Spark representation.

A logical type is an immutable tree. Spark has no unsigned integers, fixed-size vectors, sets,
tagged unions or typed keys, so these are carried by the nearest Spark type and the logical type
tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as S

#: Inclusive ranges of the integer types.
INT_RANGE = {
    "int8": (-(2**7), 2**7 - 1), "int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1),
    "uint8": (0, 2**8 - 1), "uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1),
}
FLOATS = ("float", "double")
PRIMITIVES: dict[str, S.DataType] = {
    "void": S.StringType(), "bool": S.BooleanType(),
    "int8": S.ByteType(), "int16": S.ShortType(), "int32": S.IntegerType(), "int64": S.LongType(),
    "uint8": S.ShortType(), "uint16": S.IntegerType(), "uint32": S.LongType(), "uint64": S.DecimalType(20, 0),
    "float": S.FloatType(), "double": S.DoubleType(), "string": S.StringType(), "blob": S.BinaryType(),
    "blob_id": S.StringType(), "commit_id": S.StringType(), "uuid": S.StringType(),
}
CONTAINERS = ("vec", "mat", "optional", "vector", "set", "map", "xarray", "tuple", "variant")
KEY_FLAVOURS = ("concept", "club", "any")

XARRAY_POSITION, XARRAY_LIVE, XARRAY_VALUE = "pos", "live", "value"


@dataclass(frozen=True)
class Type:
    """``kind`` is a primitive, a container, ``key``, ``any`` or ``ref`` (a named definition)."""

    kind: str
    args: tuple[Type, ...] = ()
    name: str = ""
    dims: tuple[int, ...] = ()

    def __str__(self) -> str:
        if self.kind == "ref":
            return self.name
        inner = [*map(str, self.args), *map(str, self.dims)]
        if self.kind == "key":
            inner = [self.name]
        return f"{self.kind}<{','.join(inner)}>" if inner else self.kind

    def mapped(self, f: Callable[[Type], Type]) -> Type:
        """The type with its direct parts replaced."""
        return Type(self.kind, tuple(map(f, self.args)), self.name, self.dims)

    def names(self) -> set[str]:
        """Definitions that the type refers to."""
        own = {self.name} if self.kind in ("ref", "key") and self.name else set()
        return own.union(*(a.names() for a in self.args)) if self.args else own

    @property
    def is_int(self) -> bool:
        return self.kind in INT_RANGE

    @property
    def is_float(self) -> bool:
        return self.kind in FLOATS

    @property
    def is_scalar(self) -> bool:
        return self.kind in PRIMITIVES and self.kind not in ("void", "blob")


def prim(kind: str) -> Type:
    if kind not in PRIMITIVES:
        raise ValueError(f"unknown primitive type: {kind}")
    return Type(kind)


def ref(name: str) -> Type:
    return Type("ref", name=name)


def vec(of: Type, n: int) -> Type:
    return Type("vec", (of,), dims=(_size(n),))


def mat(of: Type, columns: int, rows: int) -> Type:
    return Type("mat", (of,), dims=(_size(columns), _size(rows)))


def optional(of: Type) -> Type:
    return Type("optional", (of,))


def vector(of: Type) -> Type:
    return Type("vector", (of,))


def set_of(of: Type) -> Type:
    return Type("set", (of,))


def map_of(key: Type, value: Type) -> Type:
    return Type("map", (key, value))


def xarray(of: Type) -> Type:
    return Type("xarray", (of,))


def tuple_of(*of: Type) -> Type:
    return Type("tuple", of)


def variant(*arms: Type) -> Type:
    if len(set(arms)) != len(arms) or not arms:
        raise ValueError("a variant needs distinct arms")
    return Type("variant", arms)


def key(name: str = "") -> Type:
    """A key to a concept or club, or to any concept where no name is given. Not a foreign key."""
    return Type("key", name=name)


ANY = Type("any")
BOOL, STRING, DOUBLE, FLOAT, INT32, INT64 = map(prim, ("bool", "string", "double", "float", "int32", "int64"))


def _size(n: int) -> int:
    if n < 1:
        raise ValueError("dimensions are at least 1")
    return n


def parse(text: str) -> Type:
    """The type that str() of a type gives."""
    out, rest = _parse(text.replace(" ", ""))
    if rest:
        raise ValueError(f"cannot read type: {text}")
    return out


def _parse(text: str) -> tuple[Type, str]:
    end = min((i for i in (text.find(c) for c in "<,>") if i >= 0), default=len(text))
    head, rest = text[:end], text[end:]
    if not head:
        raise ValueError(f"cannot read type: {text}")
    if head == "key":
        if not rest.startswith("<"):
            return key(), rest
        name, _, rest = rest[1:].partition(">")
        return key(name), rest
    if head == "any" or head in PRIMITIVES:
        return (ANY if head == "any" else prim(head)), rest
    if head not in CONTAINERS:
        return ref(head), rest
    args, dims, rest = [], [], rest[1:]
    while True:
        if rest[:1].isdigit():
            digits = len(rest) - len(rest.lstrip("0123456789"))
            dims.append(int(rest[:digits]))
            rest = rest[digits:]
        else:
            part, rest = _parse(rest)
            args.append(part)
        more, rest = rest[:1], rest[1:]
        if more == ">":
            return Type(head, tuple(args), dims=tuple(dims)), rest
        if more != ",":
            raise ValueError(f"cannot read type: {text}")


KEY_SPARK = S.StructType([S.StructField(n, S.StringType()) for n in ("flavour", "type", "concept", "instance_id")])
ANY_SPARK = S.StructType([S.StructField("type_id", S.StringType()), S.StructField("value", S.StringType())])


def spark_type(t: Type, struct_of: Callable[[str], S.DataType]) -> S.DataType:
    """The Spark type of a logical type; ``struct_of`` gives that of a named definition.

    Optionals are nulls; an optional directly inside another needs a struct to tell the levels
    apart. A variant is its tag and a nullable field for each arm. An ``any`` is a type id and the
    value as JSON.
    """
    of = lambda x: spark_type(x, struct_of)
    match t.kind:
        case "ref":
            return struct_of(t.name)
        case "key":
            return KEY_SPARK
        case "any":
            return ANY_SPARK
        case "optional":
            inner = of(t.args[0])
            if t.args[0].kind == "optional":
                return S.StructType([S.StructField("present", S.BooleanType()), S.StructField("value", inner)])
            return inner
        case "vec" | "vector" | "set":
            return S.ArrayType(of(t.args[0]))
        case "mat":
            return S.ArrayType(S.ArrayType(of(t.args[0])))
        case "map":
            return S.MapType(of(t.args[0]), of(t.args[1]))
        case "xarray":
            return S.ArrayType(S.StructType([
                S.StructField(XARRAY_POSITION, S.StringType()), S.StructField(XARRAY_LIVE, S.BooleanType()), S.StructField(XARRAY_VALUE, of(t.args[0]))]))
        case "tuple":
            return S.StructType([S.StructField(f"_{i}", of(a)) for i, a in enumerate(t.args)])
        case "variant":
            return S.StructType([S.StructField("tag", S.StringType()), *(S.StructField(f"a{i}", of(a)) for i, a in enumerate(t.args))])
    if t.kind in PRIMITIVES:
        return PRIMITIVES[t.kind]
    raise ValueError(f"no Spark type for {t}")


#: Logical types read off Spark columns that carry no catalog of their own.
_FROM_SPARK = {
    "boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
    "float": "float", "double": "double", "string": "string", "binary": "blob",
}


def from_spark(dt: S.DataType) -> Type | None:
    """The logical type of a plain Spark type; None where there is none (timestamps, decimals)."""
    if isinstance(dt, S.ArrayType):
        inner = from_spark(dt.elementType)
        return vector(inner) if inner else None
    if isinstance(dt, S.MapType):
        k, v = from_spark(dt.keyType), from_spark(dt.valueType)
        return map_of(k, v) if k and v else None
    name = _FROM_SPARK.get(dt.simpleString())
    return prim(name) if name else None
