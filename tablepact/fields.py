"""Columns of a contract: type, nullability, default, constraints and table metadata."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

from .functions.nodes import Node, col
from .types import BOOL, DATE, DATETIME, FLOAT, INT, STR, LogicalType


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False


MISSING = _Missing()

BOUNDS = {"gt": (">", lambda c, v: c > v), "ge": (">=", lambda c, v: c >= v), "lt": ("<", lambda c, v: c < v), "le": ("<=", lambda c, v: c <= v)}


class FieldInfo:
    """What ``Field()`` was told; a column once the class gives it a name and a type."""

    def __init__(self, **said: Any):
        self.said = said


def Field(
    *, default: Any = MISSING, nullable: bool = False, primary_key: bool = False, unique: bool = False, index: bool = False, autoincrement: bool | None = None,
    description: str | None = None, gt: Any = None, ge: Any = None, lt: Any = None, le: Any = None, multiple_of: int | None = None,
    min_length: int | None = None, max_length: int | None = None, pattern: str | None = None,
) -> Any:
    """Constraints and metadata of a column."""
    given = {k: v for k, v in (("gt", gt), ("ge", ge), ("lt", lt), ("le", le), ("multiple_of", multiple_of), ("min_length", min_length), ("max_length", max_length), ("pattern", pattern)) if v is not None}
    return FieldInfo(default=default, nullable=nullable, primary_key=primary_key, unique=unique, index=index, autoincrement=autoincrement, description=description, **given)


class FieldBase:
    """A column; subclasses name the type and the constraints it takes."""

    type: LogicalType
    takes: tuple[str, ...] = ()

    def __init__(
        self, *, default: Any = MISSING, nullable: bool = False, primary_key: bool = False, unique: bool = False, index: bool = False, autoincrement: bool | None = None,
        description: str | None = None, **constraints: Any,
    ):
        foreign = sorted(k for k, v in constraints.items() if v is not None and k not in self.takes)
        if foreign:
            raise TypeError(f"{type(self).__name__} columns take no constraint {', '.join(foreign)}")
        self.name: str | None = None
        self.default, self.nullable, self.primary_key, self.unique, self.index = default, nullable, primary_key, unique, index
        self.autoincrement, self.description = autoincrement, description
        self.constraints = {k: constraints.get(k) for k in self.takes}
        self.validators: list[tuple[Callable[[Node], Node], str]] = []
        self._warned = False

    def __getattr__(self, name: str) -> Any:
        # Constraints read as attributes; an unset one is None.
        constraints = self.__dict__.get("constraints", {})
        if name in constraints:
            return constraints[name]
        raise AttributeError(name)

    @property
    def has_default(self) -> bool:
        return self.default is not MISSING

    @property
    def required(self) -> bool:
        """Whether a table has to have the column: nullable or not, it has unless there is a default."""
        return not self.has_default

    def add_validator(self, rule: Callable[[Node], Node], message: str | None = None) -> None:
        """A rule of one's own over the column: gets its expression, returns a boolean one."""
        self.validators.append((rule, message or f"{self.name} failed {getattr(rule, '__name__', 'a rule')}"))

    def get_constraints(self) -> list[tuple[Node, str]]:
        """Boolean expressions and messages, in the order in which they are applied."""
        if self.name is None:
            raise RuntimeError("constraints require field name: the column isn't part of a schema yet")
        if self.nullable and self.has_default and not self._warned:
            self._warned = True
            warnings.warn(f"column {self.name!r} is nullable and has a default: nulls stay null unless they are filled", UserWarning, stacklevel=3)
        c, out = col(self.name), []
        for kind, value in self.constraints.items():
            if value is None:
                continue
            if kind in BOUNDS:
                sign, make = BOUNDS[kind]
                said = value.isoformat() if hasattr(value, "isoformat") else value
                out.append((make(c, value), f"{self.name} must be {sign} {said}"))
            elif kind == "multiple_of":
                out.append((c % value == 0, f"{self.name} must be multiple of {value}"))
            elif kind == "min_length":
                out.append((c.str.len_chars() >= value, f"{self.name} must have at least {value} characters"))
            elif kind == "max_length":
                out.append((c.str.len_chars() <= value, f"{self.name} must have at most {value} characters"))
            elif kind == "pattern":
                out.append((c.str.contains(value), f"{self.name} must match pattern: {value}"))
        return out + [(rule(c), message) for rule, message in self.validators]

    def get_python_type(self) -> type:
        return self.type.python

    def get_spark_type(self):
        return self.type.spark

    def get_sql_type(self) -> str:
        return self.type.ddl

    def get_model_kwargs(self) -> dict[str, Any]:
        """Keyword arguments of the row model's field."""
        return {k: v for k, v in self.constraints.items() if v is not None and k != "pattern"}


class Integer(FieldBase):
    type, takes = INT, ("gt", "ge", "lt", "le", "multiple_of")


class Float(FieldBase):
    type, takes = FLOAT, ("gt", "ge", "lt", "le")


class String(FieldBase):
    type, takes = STR, ("min_length", "max_length", "pattern")

    def get_sql_type(self) -> str:
        return f"VARCHAR({self.max_length})" if self.max_length else "STRING"


class Boolean(FieldBase):
    type = BOOL


class Datetime(FieldBase):
    type, takes = DATETIME, ("gt", "ge", "lt", "le")


class Date(FieldBase):
    """Bounds on dates are applied, as on datetimes."""

    type, takes = DATE, ("gt", "ge", "lt", "le")


FIELDS: dict[type, type[FieldBase]] = {f.type.python: f for f in (Integer, Float, String, Boolean, Datetime, Date)}
