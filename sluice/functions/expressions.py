"""Descriptor expressions to native Columns, with static types.

Integers and doubles never mix; logic wants booleans; only numbers have an order.  ``extended`` also
lets strings, dates and wide decimals be compared.  Nulls follow SQL, or with ``strict`` raise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import CompileError
from sluice.plans.registry import Registry

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Typed:
    column: Column
    type: T.DataType

    @property
    def family(self) -> str:
        for name, kinds in (("int", _INTS), ("float", _FLOATS), ("bool", T.BooleanType), ("string", T.StringType), ("null", T.NullType)):
            if isinstance(self.type, kinds):
                return name
        return "other"


@dataclass(frozen=True)
class Rules:
    strict: bool = False
    extended: bool = True


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, _FLOATS):
        return T.DoubleType()
    return T.LongType() if isinstance(a, T.LongType) or isinstance(b, T.LongType) else T.IntegerType()


def float_divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero it gives an infinity or NaN instead of raising.  -0.0 counts as 0.0."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    by_zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def float_remainder(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((b == 0) | (F.abs(a) == float("inf")), F.lit(float("nan"))).otherwise(a % F.when(b != 0, b))


def _literal(d: dict) -> Typed:
    kinds = {"int": T.IntegerType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "null": T.NullType()}
    kind = d.get("type")
    if kind not in kinds:
        raise CompileError(f"unknown literal type {kind!r}")
    if kind == "null":
        return Typed(F.lit(None), T.NullType())
    value = d.get("value")
    if kind == "int" and (isinstance(value, bool) or not isinstance(value, int) or not -(1 << 31) <= value < 1 << 31):
        raise CompileError(f"{value!r} is no 32-bit integer")
    return Typed(F.lit(float(value) if kind == "float" else value).cast(kinds[kind]), kinds[kind])


def _binary(op: str, a: Typed, b: Typed, rules: Rules) -> Typed:
    x, y, kind = a.column, b.column, a.family
    if a.family != b.family:
        raise CompileError(f"{op!r} between {a.family} and {b.family}")
    number = kind in ("int", "float")
    if op in ("+", "-", "*", "/", "%"):
        if not number:
            raise CompileError(f"{op!r} is not for {kind}")
        to = _wider(a.type, b.type)
        x, y = x.cast(to), y.cast(to)
        if op == "/":
            return Typed(float_divide(x, y) if kind == "float" else F.call_function("div", x, y).cast(to), to)
        if op == "%":
            return Typed(float_remainder(x, y) if kind == "float" else x % y, to)
        return Typed({"+": x + y, "-": x - y, "*": x * y}[op], to)
    if op in ("=", "==", "!="):
        if not (number or kind == "bool" or rules.extended and kind in ("string", "other")):
            raise CompileError(f"{op!r} is not for {kind}")
        return Typed(x != y if op == "!=" else x == y, T.BooleanType())
    if op in (">", ">=", "<", "<="):
        if not (number or rules.extended and kind in ("string", "other")):
            raise CompileError(f"{op!r} is not for {kind}")
        return Typed({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op], T.BooleanType())
    if op in ("&", "&&", "|", "||", "^"):
        if kind != "bool":
            raise CompileError(f"{op!r} is not for {kind}")
        return Typed(x & y if op[0] == "&" else x | y if op[0] == "|" else x != y, T.BooleanType())
    raise CompileError(f"unknown operation {op!r}")


def compile_expression(d: dict, schema: T.StructType, registry: Registry | None = None, rules: Rules = Rules(), columns: dict[str, Column] | None = None) -> Typed:
    """The Column of a descriptor over rows of ``schema``, with its type.

    ``columns`` says which Column a field stands for, where its name alone does not.
    """
    again = lambda e: compile_expression(e, schema, registry, rules, columns)

    def known(t: Typed) -> Typed:
        if not rules.strict:
            return t
        return Typed(F.when(F.assert_true(t.column.isNotNull(), "null in an expression").isNull(), t.column), t.type)

    kind = d.get("kind")
    if kind == "field":
        name = d["name"]
        if name not in schema.names:
            raise CompileError(f"no field {name!r}; there are {schema.names}")
        return Typed((columns or {}).get(name, F.col(f"`{name}`")), schema[name].dataType)
    if kind == "literal":
        return _literal(d)
    if kind == "unary":
        a = known(again(d["expr"]))
        if d["op"] == "-" and a.family in ("int", "float"):
            return Typed(-a.column, a.type)
        if d["op"] == "!" and a.family == "bool":
            return Typed(~a.column, a.type)
        raise CompileError(f"{d['op']!r} is not for {a.family}")
    if kind == "binary":
        return _binary(d["op"], known(again(d["left"])), known(again(d["right"])), rules)
    if kind == "ternary":
        cond, a, b = known(again(d["cond"])), again(d["left"]), again(d["right"])
        if cond.family != "bool":
            raise CompileError(f"a condition must be boolean, not {cond.family}")
        if a.family != b.family and "null" not in (a.family, b.family):
            raise CompileError(f"branches are {a.family} and {b.family}")
        to = b.type if a.family == "null" else a.type if b.family == "null" or a.type == b.type else _wider(a.type, b.type) if a.family in ("int", "float") else a.type
        return Typed(F.when(cond.column, a.column).when(~cond.column, b.column), to)
    if kind == "udf":
        if registry is None:
            raise CompileError("no functions are registered")
        function = registry.find("expression", d["name"])
        args = [again(a) for a in d.get("args", [])]
        kind_of = getattr(function, "returns", None) or getattr(function, "returnType", None)
        column = function(*[a.column for a in args])
        return Typed(column, T._parse_datatype_string(kind_of) if isinstance(kind_of, str) else kind_of or T.BinaryType())
    raise CompileError(f"unknown expression kind {kind!r}")


def returning(kind: str):
    """Mark a native builder with the type of its result, which expressions around it need."""

    def mark(function):
        function.returns = kind
        return function

    return mark


def rounded(c: Column, places: int) -> Column:
    """``c`` to so many places as databases round doubles: scaled, halves away from zero; zeros keep their sign.

    Spark's own ``round`` goes by the shortest decimal form of the number, and so takes other halves for halves.
    """
    by = float(10**places)
    scaled = c * by
    near = F.rint(scaled)
    made = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / by
    return F.when(F.abs(made) < float("inf"), made).otherwise(c)
