"""Expression trees. A node only describes; ``spark`` and ``rows`` evaluate it.

Every node has every method, so results can be combined freely. A node has no
truth value: ``18 <= col("a") <= 65`` is an error and not one half of what it says.
"""

from __future__ import annotations

import builtins
import logging
from collections.abc import Iterable
from typing import Any

log = logging.getLogger(__name__)

CLOSED = ("both", "left", "right", "none")


class Node:
    """Base of all expressions."""

    __slots__ = ()
    __hash__ = object.__hash__

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; combine expressions with & | ~ and compare one pair at a time")

    # comparison
    def __gt__(self, other: Any) -> Node:
        return Binary(">", self, lift(other))

    def __ge__(self, other: Any) -> Node:
        return Binary(">=", self, lift(other))

    def __lt__(self, other: Any) -> Node:
        return Binary("<", self, lift(other))

    def __le__(self, other: Any) -> Node:
        return Binary("<=", self, lift(other))

    def __eq__(self, other: Any) -> Node:  # type: ignore[override]
        return Binary("==", self, lift(other))

    def __ne__(self, other: Any) -> Node:  # type: ignore[override]
        return Binary("!=", self, lift(other))

    # arithmetic
    def __add__(self, other: Any) -> Node:
        return Binary("+", self, lift(other))

    def __radd__(self, other: Any) -> Node:
        return Binary("+", lift(other), self)

    def __sub__(self, other: Any) -> Node:
        return Binary("-", self, lift(other))

    def __rsub__(self, other: Any) -> Node:
        return Binary("-", lift(other), self)

    def __mul__(self, other: Any) -> Node:
        return Binary("*", self, lift(other))

    def __rmul__(self, other: Any) -> Node:
        return Binary("*", lift(other), self)

    def __truediv__(self, other: Any) -> Node:
        return Binary("/", self, lift(other))

    def __rtruediv__(self, other: Any) -> Node:
        return Binary("/", lift(other), self)

    def __mod__(self, other: Any) -> Node:
        return Binary("%", self, lift(other))

    # logic
    def __and__(self, other: Any) -> Node:
        return Binary("&", self, lift(other))

    def __rand__(self, other: Any) -> Node:
        return Binary("&", lift(other), self)

    def __or__(self, other: Any) -> Node:
        return Binary("|", self, lift(other))

    def __ror__(self, other: Any) -> Node:
        return Binary("|", lift(other), self)

    def __invert__(self) -> Node:
        return Unary("~", self)

    # nulls and numbers
    def is_null(self) -> Node:
        return Unary("is_null", self)

    def is_not_null(self) -> Node:
        return Unary("is_not_null", self)

    def abs(self) -> Node:
        return Unary("abs", self)

    def round(self, decimals: int = 0) -> Node:
        if not isinstance(decimals, int):
            raise TypeError("round() decimals must be an integer")
        return Unary("round", self, decimals)

    def floor(self) -> Node:
        return Unary("floor", self)

    def ceil(self) -> Node:
        return Unary("ceil", self)

    def sqrt(self) -> Node:
        return Unary("sqrt", self)

    def pow(self, exponent: Any = None) -> Node:
        if exponent is None:
            raise ValueError("pow() requires an exponent")
        if not isinstance(exponent, (int, float, Node)):
            raise TypeError("pow() exponent must be a number")
        return Unary("pow", self, exponent)

    # membership
    def is_in(self, other: Any, *, nulls_equal: bool = False) -> Node:
        if isinstance(other, Node):
            return InColumn(self, other, nulls_equal)
        if isinstance(other, (builtins.str, bytes)) or not isinstance(other, Iterable):
            raise TypeError("is_in() takes a list, tuple, set or other collection, or an expression")
        return IsIn(self, tuple(other), nulls_equal)

    def is_between(self, lower: Any, upper: Any, closed: builtins.str = "both") -> Node:
        if closed not in CLOSED:
            raise ValueError(f"closed must be one of {', '.join(CLOSED)}; got {closed!r}")
        if not any(isinstance(b, (Node, builtins.str)) or b is None for b in (lower, upper)):
            try:
                if lower > upper:
                    log.warning("is_between: the lower bound %r is above the upper bound %r", lower, upper)
            except TypeError:
                pass
        # A string bound names a column.
        bounds = [FieldRef(b) if isinstance(b, builtins.str) else lift(b) for b in (lower, upper)]
        return Between(self, bounds[0], bounds[1], closed)

    @property
    def str(self) -> StringFunctions:
        return StringFunctions(self)

    @property
    def dt(self) -> DateFunctions:
        return DateFunctions(self)


class _Tuple(Node):
    """A node that holds its parts as attributes named in __slots__."""

    __slots__ = ()

    def __init__(self, *parts: Any):
        for name, part in zip(self.__slots__, parts, strict=True):
            object.__setattr__(self, name, part)

    def __repr__(self) -> builtins.str:
        return f"{type(self).__name__}({', '.join(repr(getattr(self, n)) for n in self.__slots__)})"


class FieldRef(_Tuple):
    """A column by name."""

    __slots__ = ("name",)


class Literal(_Tuple):
    __slots__ = ("value",)


class Binary(_Tuple):
    __slots__ = ("op", "left", "right")


class Unary(_Tuple):
    __slots__ = ("op", "operand", "arg")

    def __init__(self, op: builtins.str, operand: Node, arg: Any = None):
        super().__init__(op, operand, arg)


class IsIn(_Tuple):
    __slots__ = ("operand", "values", "nulls_equal")


class InColumn(_Tuple):
    """Membership in all values of a column."""

    __slots__ = ("operand", "other", "nulls_equal")


class Between(_Tuple):
    __slots__ = ("operand", "lower", "upper", "closed")


class StringOp(_Tuple):
    __slots__ = ("op", "operand", "args")


class DateOp(_Tuple):
    __slots__ = ("op", "operand", "other")


class StringFunctions:
    """What ``.str`` offers."""

    def __init__(self, operand: Node):
        self._of = lambda op, *args: StringOp(op, operand, args)

    def contains(self, pattern: builtins.str) -> Node:
        """Whether a regular expression is found anywhere."""
        return self._of("contains", pattern)

    def starts_with(self, prefix: builtins.str) -> Node:
        return self._of("starts_with", prefix)

    def ends_with(self, suffix: builtins.str) -> Node:
        return self._of("ends_with", suffix)

    def len_chars(self) -> Node:
        return self._of("len_chars")

    def strip_chars(self) -> Node:
        return self._of("strip_chars")

    def to_lowercase(self) -> Node:
        return self._of("to_lowercase")

    def to_uppercase(self) -> Node:
        return self._of("to_uppercase")

    def replace(self, pattern: builtins.str, value: builtins.str) -> Node:
        """Replaces every match of a regular expression."""
        return self._of("replace", pattern, value)

    def extract(self, pattern: builtins.str, group_index: int = 0) -> Node:
        """A group of the first match; 0 is the whole match; null without one."""
        return self._of("extract", pattern, group_index)

    def slice(self, offset: int, length: int | None = None) -> Node:
        """A negative offset counts from the end."""
        return self._of("slice", offset, length)

    def count_matches(self, pattern: builtins.str) -> Node:
        return self._of("count_matches", pattern)


class DateFunctions:
    """What ``.dt`` offers."""

    def __init__(self, operand: Node):
        self._operand = operand

    def year(self) -> Node:
        return DateOp("year", self._operand, None)

    def month(self) -> Node:
        return DateOp("month", self._operand, None)

    def day(self) -> Node:
        return DateOp("day", self._operand, None)

    def hour(self) -> Node:
        return DateOp("hour", self._operand, None)

    def minute(self) -> Node:
        return DateOp("minute", self._operand, None)

    def second(self) -> Node:
        return DateOp("second", self._operand, None)

    def total_days(self, other: Any) -> Node:
        """Days from ``other`` to this: whole days over tables, a float over a single row."""
        return DateOp("total_days", self._operand, lift(other))


def lift(value: Any) -> Node:
    return value if isinstance(value, Node) else Literal(value)


def col(name: str) -> FieldRef:
    return FieldRef(name)
