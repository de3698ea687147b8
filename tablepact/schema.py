"""Contracts: a class whose annotations are the columns of a table."""

from __future__ import annotations

import sys
import types
import typing
from collections.abc import Callable
from typing import Any, ClassVar

from pyspark.sql import types as T

from .fields import FIELDS, MISSING, FieldBase, FieldInfo
from .types import SUPPORTED


def model_validator(func: Callable) -> Callable:
    """Marks a method that returns a rule over several columns (see ``rules``)."""
    target = func.__func__ if isinstance(func, (classmethod, staticmethod)) else func
    target._is_model_validator = True
    return func


def _annotations(cls: type) -> dict[str, Any]:
    """The class's own annotations, with strings resolved."""
    if sys.version_info >= (3, 14):
        import annotationlib

        own = annotationlib.get_annotations(cls, format=annotationlib.Format.FORWARDREF)
    else:
        own = cls.__dict__.get("__annotations__", {})
    if not any(isinstance(a, str) for a in own.values()):
        return dict(own)
    names = vars(sys.modules.get(cls.__module__, types.ModuleType("none"))) | dict(vars(typing))
    out = {}
    for name, a in own.items():
        try:
            out[name] = eval(a, dict(names), {}) if isinstance(a, str) else a
        except NameError as e:
            raise TypeError(f"{cls.__name__}.{name}: annotation {a!r} can't be resolved") from e
    return out


def _plain(cls: str, name: str, annotation: Any) -> tuple[type, bool]:
    """The column's Python type and whether it may be null."""
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        kinds = [a for a in typing.get_args(annotation) if a is not type(None)]
        if len(kinds) != 1 or len(kinds) == len(typing.get_args(annotation)):
            raise TypeError(f"{cls}.{name}: a union has to be of one type and None, not {annotation}")
        return kinds[0], True
    return annotation, False


class SchemaMeta(type):
    """Turns annotations into columns, in order; columns and rules of base classes come first."""

    def __new__(mcs, name: str, bases: tuple[type, ...], namespace: dict[str, Any]):
        cls = super().__new__(mcs, name, bases, namespace)
        fields: dict[str, FieldBase] = {}
        rules: dict[str, Callable] = {}
        for base in reversed(cls.__mro__[1:]):
            fields |= getattr(base, "__dict__", {}).get("_own_fields", {})
            rules |= getattr(base, "__dict__", {}).get("_own_rules", {})
        own: dict[str, FieldBase] = {}
        for key, annotation in _annotations(cls).items():
            if key.startswith("_") or typing.get_origin(annotation) is ClassVar or annotation is ClassVar:
                continue
            kind, nullable = _plain(name, key, annotation)
            value = namespace.get(key, MISSING)
            if isinstance(value, FieldBase):
                raise TypeError(f"{name}.{key}: give a type annotation and Field(...), not {type(value).__name__}(...)")
            maker = FIELDS.get(kind) if isinstance(kind, type) else None
            if maker is None:
                raise TypeError(f"{name}.{key}: unsupported type {kind}. Supported types: {SUPPORTED}")
            said = dict(value.said) if isinstance(value, FieldInfo) else {"default": value}
            said["nullable"] = nullable or said.get("nullable", False)
            field = maker(**said)
            field.name = key
            own[key] = field
        cls._own_fields = own
        cls._own_rules = {k: v for k, v in namespace.items() if getattr(v.__func__ if isinstance(v, (classmethod, staticmethod)) else v, "_is_model_validator", False)}
        cls._fields = fields | own
        cls._rules = list((rules | cls._own_rules).values())
        return cls


class Schema(metaclass=SchemaMeta):
    """Base of contracts. Never instantiated; everything is asked of the class."""

    _fields: ClassVar[dict[str, FieldBase]]
    _rules: ClassVar[list[Callable]]

    @classmethod
    def fields(cls) -> dict[str, FieldBase]:
        return dict(cls._fields)

    @classmethod
    def model_validators(cls) -> list[Callable]:
        return list(cls._rules)

    @classmethod
    def kinds(cls) -> dict[str, str]:
        """Logical types by column."""
        return {n: f.type.name for n, f in cls._fields.items()}

    @classmethod
    def to_struct(cls) -> T.StructType:
        """The Spark schema; descriptions are column comments."""
        return T.StructType([T.StructField(n, f.type.spark, f.nullable, {"comment": f.description} if f.description else None) for n, f in cls._fields.items()])

    @classmethod
    def to_spark_validator(cls):
        """A validator of whole tables."""
        from .operators.validator import SparkValidator

        return SparkValidator(cls)

    @classmethod
    def to_pydantic(cls):
        """A model of single rows."""
        from .rowmodel import create_row_model

        return create_row_model(cls)

    @classmethod
    def to_table(cls, table_name: str | None = None, database: str | None = None):
        """The definition of a SQL table."""
        from .sources.ddl import create_table

        return create_table(cls, table_name, database)
