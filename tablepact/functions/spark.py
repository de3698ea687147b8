"""Expression trees as Spark columns of the contracts' semantics.

Spark raises where the contracts are lenient (overflow, division by zero, casts), so every
operator that could raise has a form that can't, and types are checked here, when a plan is built. The
result is plain Catalyst expressions, without Python functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from . import nodes as N
from .regex import checked, replacement

NUMBERS = ("int", "float")
WIDE = float(2**53)


class CompileError(TypeError):
    """An expression that has no meaning for the types it is applied to."""


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str  # int, float, str, bool, datetime, date, duration, null, or any where a type isn't known


def literal(value: Any) -> Typed:
    if isinstance(value, Column):
        return Typed(value, "any")
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint") if -(2**63) <= value < 2**63 else F.lit(float(value)), "int" if -(2**63) <= value < 2**63 else "float")
    if isinstance(value, (float, Decimal)):
        return Typed(F.lit(float(value)), "float")
    if isinstance(value, str):
        return Typed(F.lit(value), "str")
    if isinstance(value, datetime):
        return Typed(F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"), "datetime")
    if isinstance(value, date):
        return Typed(F.lit(value), "date")
    raise CompileError(f"no literal of type {type(value).__name__}")


#: Beyond it only -1, 0 and 1 have a power in a long, which a double gives as well.
MOST_POWER = 64


def _whole_power(x: Column, power: int) -> Column:
    """An exact integer power by repeated squaring; null where a long can't hold it."""
    out, square = F.when(x.isNotNull(), F.lit(1).cast("bigint")), x
    while power:
        if power & 1:
            out = F.try_multiply(out, square)
        power >>= 1
        if power:
            square = F.try_multiply(square, square)
    return out


class Compiler:
    """Compiles nodes over columns of known kinds; ``frame`` is where InColumn finds its values."""

    def __init__(self, kinds: dict[str, str], frame: DataFrame | None = None):
        self.kinds, self.frame = kinds, frame

    def condition(self, node: N.Node) -> Column:
        out = self(node)
        if out.kind not in ("bool", "null", "any"):
            raise CompileError(f"a rule has to be boolean, not {out.kind}")
        return out.column.cast("boolean") if out.kind == "null" else out.column

    def __call__(self, node: Any) -> Typed:
        if not isinstance(node, N.Node):
            return literal(node)
        return getattr(self, "_" + type(node).__name__)(node)

    def _FieldRef(self, node: N.FieldRef) -> Typed:
        if self.kinds and node.name not in self.kinds:
            raise CompileError(f"no column {node.name!r}")
        return Typed(F.col("`" + node.name.replace("`", "``") + "`"), self.kinds.get(node.name, "any"))

    def _Literal(self, node: N.Literal) -> Typed:
        return literal(node.value)

    # -- pairs --------------------------------------------------------------------------------

    @staticmethod
    def _comparable(a: Typed, b: Typed) -> tuple[Column, Column]:
        x, y = a.kind, b.kind
        if x == y or "null" in (x, y) or "any" in (x, y) or x in NUMBERS and y in NUMBERS:
            return a.column, b.column
        if {x, y} == {"date", "datetime"}:
            return a.column.cast("timestamp_ntz"), b.column.cast("timestamp_ntz")
        raise CompileError(f"{x} can't be compared with {y}")

    def _Binary(self, node: N.Binary) -> Typed:
        a, b, op = self(node.left), self(node.right), node.op
        kinds = {a.kind, b.kind}
        if op in (">", ">=", "<", "<=", "==", "!="):
            x, y = self._comparable(a, b)
            return Typed({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y, "==": x == y, "!=": x != y}[op], "bool")
        if op in "&|":
            if not kinds <= {"bool", "null", "any"}:
                raise CompileError(f"{op} needs boolean operands")
            x, y = a.column.cast("boolean"), b.column.cast("boolean")
            return Typed(x & y if op == "&" else x | y, "bool")
        if kinds <= {"null"}:
            return Typed(F.lit(None).cast("double"), "float")
        if op == "+" and "str" in kinds and kinds <= {"str", "null", "any"}:
            return Typed(F.concat(a.column, b.column), "str")
        if op == "-" and kinds <= {"date", "datetime"}:
            return Typed(a.column.cast("timestamp_ntz") - b.column.cast("timestamp_ntz"), "duration")
        if op in "+-" and a.kind in ("date", "datetime") and b.kind == "duration":
            return Typed(a.column + b.column if op == "+" else a.column - b.column, "datetime")
        if not kinds <= {"int", "float", "null", "any"}:
            raise CompileError(f"{a.kind} {op} {b.kind}")
        if op == "/":
            x, y = a.column.cast("double"), b.column.cast("double")
            by_zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).when(x.isNotNull(), float("nan"))
            return Typed(F.when(y == 0, F.when(F.isnan(x), float("nan")).otherwise(by_zero)).otherwise(F.try_divide(x, y)), "float")
        kind = "float" if "float" in kinds else "any" if "any" in kinds else "int"
        cast = {"float": "double", "int": "bigint"}.get(kind)
        x, y = (a.column.cast(cast), b.column.cast(cast)) if cast else (a.column, b.column)
        return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](x, y), kind)

    # -- one operand --------------------------------------------------------------------------

    def _Unary(self, node: N.Unary) -> Typed:
        a, op = self(node.operand), node.op
        c = a.column
        if op == "is_null":
            return Typed(c.isNull(), "bool")
        if op == "is_not_null":
            return Typed(c.isNotNull(), "bool")
        if op == "~":
            if a.kind not in ("bool", "null", "any"):
                raise CompileError(f"~ needs a boolean operand, not {a.kind}")
            return Typed(~c.cast("boolean"), "bool")
        if a.kind == "duration" and op == "abs":
            return Typed(F.when(c < F.expr("INTERVAL '0' DAY"), -c).otherwise(c), "duration")
        if a.kind not in ("int", "float", "null", "any"):
            raise CompileError(f"{op} of {a.kind}")
        if op == "abs":
            return Typed(F.when(c == -(2**63), c).otherwise(F.abs(c)) if a.kind == "int" else F.abs(c), a.kind)
        if op == "round":
            return Typed(F.bround(c, node.arg or 0), a.kind)
        if op in ("floor", "ceil"):
            if a.kind == "int":
                return a
            x = c.cast("double")
            f = F.floor if op == "floor" else F.ceil
            return Typed(F.when(F.isnan(x) | (F.abs(x) >= WIDE), x).otherwise(f(x).cast("double")), "float")
        if op == "sqrt":
            return Typed(F.sqrt(c.cast("double")), "float")
        if op == "pow":
            power = node.arg
            e = self(power)
            if e.kind not in ("int", "float", "null", "any"):
                raise CompileError(f"pow with an exponent of {e.kind}")
            if a.kind == "int" and isinstance(power, int) and 0 <= power <= MOST_POWER:
                return Typed(_whole_power(c.cast("bigint"), power), "int")
            out = F.pow(c.cast("double"), e.column.cast("double"))
            if a.kind == "int" and isinstance(power, int) and power >= 0:
                return Typed(out.try_cast("bigint"), "int")
            return Typed(out, "float")
        raise CompileError(f"unknown operator {op}")

    def _IsIn(self, node: N.IsIn) -> Typed:
        a = self(node.operand)
        values = []
        for v in node.values:
            if v is not None:
                x = literal(v)
                self._comparable(a, x)
                values.append(x.column)
        found = a.column.isin(*values) if values else F.when(a.column.isNotNull(), False)
        if node.nulls_equal:
            has_null = any(v is None for v in node.values)
            return Typed(F.coalesce(found, F.lit(False)) | (a.column.isNull() & F.lit(has_null)), "bool")
        return Typed(found, "bool")

    def _InColumn(self, node: N.InColumn) -> Typed:
        """Membership in the distinct values of a column of the frame, as an uncorrelated subquery."""
        if self.frame is None:
            raise CompileError("is_in over a column needs the table it is in")
        a, b = self(node.operand), self(node.other)
        self._comparable(a, b)
        values = self.frame.select(b.column.alias("v"))
        found = a.column.isin(values.filter("v IS NOT NULL").distinct())
        if node.nulls_equal:
            nulls = values.filter("v IS NULL").limit(1).exists()
            return Typed(F.coalesce(found, F.lit(False)) | (a.column.isNull() & nulls), "bool")
        return Typed(F.when(a.column.isNotNull(), found), "bool")

    def _Between(self, node: N.Between) -> Typed:
        v, lo, hi = self(node.operand), self(node.lower), self(node.upper)
        a, b = self._comparable(v, lo)
        c, d = self._comparable(v, hi)
        low = a >= b if node.closed in ("both", "left") else a > b
        high = c <= d if node.closed in ("both", "right") else c < d
        return Typed(low & high, "bool")

    # -- strings ------------------------------------------------------------------------------

    def _StringOp(self, node: N.StringOp) -> Typed:
        a, op, args = self(node.operand), node.op, node.args
        if a.kind not in ("str", "null", "any"):
            raise CompileError(f".str.{op} of {a.kind}")
        c = a.column.cast("string") if a.kind == "null" else a.column
        if op == "contains":
            return Typed(c.rlike(checked(args[0])), "bool")
        if op in ("starts_with", "ends_with"):
            other = self(args[0]).column
            return Typed(c.startswith(other) if op == "starts_with" else c.endswith(other), "bool")
        if op == "len_chars":
            return Typed(F.char_length(c).cast("bigint"), "int")
        if op == "strip_chars":
            return Typed(F.regexp_replace(c, r"(?U)^\s+|\s+\z", ""), "str")
        if op == "to_lowercase":
            return Typed(F.lower(c), "str")
        if op == "to_uppercase":
            return Typed(F.upper(c), "str")
        if op == "replace":
            return Typed(F.regexp_replace(c, checked(args[0]), replacement(args[1])), "str")
        if op == "extract":
            pattern, group = checked(args[0]), args[1]
            if group == 0:
                return Typed(F.regexp_substr(c, F.lit(pattern)), "str")
            return Typed(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)), "str")
        if op == "slice":
            offset, length = args
            length = 2**31 - 1 if length is None else length
            return Typed(F.substring(c, offset + 1 if offset >= 0 else offset, length), "str")
        if op == "count_matches":
            return Typed(F.regexp_count(c, F.lit(checked(args[0]))).cast("bigint"), "int")
        raise CompileError(f"unknown string operator {op}")

    # -- dates --------------------------------------------------------------------------------

    def _DateOp(self, node: N.DateOp) -> Typed:
        a, op = self(node.operand), node.op
        if a.kind not in ("date", "datetime", "null", "any"):
            raise CompileError(f".dt.{op} of {a.kind}")
        if op == "total_days":
            b = self(node.other)
            if b.kind not in ("date", "datetime", "null", "any"):
                raise CompileError(f"total_days from {b.kind}")
            return Typed(F.timestamp_diff("DAY", b.column.cast("timestamp_ntz"), a.column.cast("timestamp_ntz")), "int")
        if op in ("hour", "minute", "second") and a.kind == "date":
            raise CompileError(f".dt.{op} needs a datetime, not a date")
        part = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[op]
        return Typed(part(a.column.cast("timestamp_ntz") if a.kind == "null" else a.column).cast("bigint"), "int")


def to_column(node: Any, kinds: dict[str, str] | None = None, frame: DataFrame | None = None) -> Column:
    """A node as a Spark column; ``kinds`` are the logical types of the columns by name."""
    return Compiler(kinds or {}, frame)(node).column
