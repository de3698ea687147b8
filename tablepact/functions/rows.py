"""Expression trees over a single row.

Here a null isn't unknown, as it is over tables: comparing it is an error, arithmetic with it is too, and
string tests of it are false. ``&`` and ``|`` stop at the first operand that decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from datetime import date, datetime
from typing import Any

from . import nodes as N
from .regex import to_python


def value_of(values: Any, name: str) -> Any:
    """A field of an object or of a mapping."""
    if isinstance(values, Mapping):
        if name in values:
            return values[name]
    elif hasattr(values, name):
        return getattr(values, name)
    raise AttributeError(f"no field {name!r}")


def evaluate(node: Any, values: Any) -> Any:
    if not isinstance(node, N.Node):
        return node
    return _RULES[type(node)](node, values)


def _binary(node: N.Binary, values: Any) -> Any:
    a = evaluate(node.left, values)
    if node.op == "&":
        return a and evaluate(node.right, values)
    if node.op == "|":
        return a or evaluate(node.right, values)
    return _PAIRS[node.op](a, evaluate(node.right, values))


_PAIRS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b,
}


def _unary(node: N.Unary, values: Any) -> Any:
    v, op = evaluate(node.operand, values), node.op
    if op == "is_null":
        return v is None
    if op == "is_not_null":
        return v is not None
    if op == "~":
        return not v
    if op == "abs":
        return abs(v)
    if v is None:
        return None
    if op == "round":
        rounded = round(v, node.arg)
        return int(rounded) if isinstance(v, int) else rounded
    if op == "floor":
        return math.floor(v)
    if op == "ceil":
        return math.ceil(v)
    if op == "sqrt":
        return math.sqrt(v) if v >= 0 else math.nan
    return pow(v, evaluate(node.arg, values))


def _is_in(node: N.IsIn, values: Any) -> Any:
    v = evaluate(node.operand, values)
    if v is None and not node.nulls_equal:
        return None
    return v in node.values


def _in_column(node: N.InColumn, values: Any) -> Any:
    v, other = evaluate(node.operand, values), evaluate(node.other, values)
    if v is None and not node.nulls_equal:
        return None
    try:
        return other is not None and v in other
    except TypeError:
        return False


def _between(node: N.Between, values: Any) -> Any:
    v, lo, hi = (evaluate(x, values) for x in (node.operand, node.lower, node.upper))
    if v is None or lo is None or hi is None:
        return None
    return (lo <= v if node.closed in ("both", "left") else lo < v) and (v <= hi if node.closed in ("both", "right") else v < hi)


def _string(node: N.StringOp, values: Any) -> Any:
    v, op, args = evaluate(node.operand, values), node.op, node.args
    if v is None:
        return {"contains": False, "starts_with": False, "ends_with": False, "len_chars": 0, "count_matches": 0}.get(op)
    if op == "contains":
        return re.search(to_python(args[0]), v) is not None
    if op == "starts_with":
        return v.startswith(evaluate(args[0], values))
    if op == "ends_with":
        return v.endswith(evaluate(args[0], values))
    if op == "len_chars":
        return len(v)
    if op == "strip_chars":
        return v.strip()
    if op == "to_lowercase":
        return v.lower()
    if op == "to_uppercase":
        return v.upper()
    if op == "replace":
        return re.sub(to_python(args[0]), args[1], v)
    if op == "extract":
        m = re.search(to_python(args[0]), v)
        return m.group(args[1]) if m else None
    if op == "slice":
        offset, length = args
        start = offset if offset >= 0 else max(0, len(v) + offset)
        return v[start:] if length is None else v[start : start + length]
    return len(re.findall(to_python(args[0]), v))


def _date(node: N.DateOp, values: Any) -> Any:
    v, op = evaluate(node.operand, values), node.op
    if op == "total_days":
        other = evaluate(node.other, values)
        return None if v is None or other is None else (v - other).total_seconds() / 86_400
    if v is None:
        return None
    if not isinstance(v, date):
        raise ValueError(f".dt.{op} needs a date or datetime, not {type(v).__name__}")
    if op in ("hour", "minute", "second") and not isinstance(v, datetime):
        raise ValueError(f".dt.{op} needs a datetime, not a date")
    return getattr(v, op)


_RULES = {
    N.FieldRef: lambda node, values: value_of(values, node.name), N.Literal: lambda node, values: node.value, N.Binary: _binary, N.Unary: _unary,
    N.IsIn: _is_in, N.InColumn: _in_column, N.Between: _between, N.StringOp: _string, N.DateOp: _date,
}
