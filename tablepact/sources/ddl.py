"""SQL table definitions of contracts."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from ..fields import MISSING, FieldBase


def table_name_of(schema: type) -> str:
    """``PersonSchema`` gives ``persons``."""
    return schema.__name__.replace("Schema", "").lower() + "s"


def sql_literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value.replace(tzinfo=None).isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


@dataclass
class ColumnDefinition:
    name: str
    type: str
    nullable: bool
    primary_key: bool = False
    unique: bool = False
    index: bool = False
    autoincrement: bool | None = None
    default: Any = MISSING
    comment: str | None = None

    @classmethod
    def of(cls, f: FieldBase) -> ColumnDefinition:
        return cls(f.name, f.get_sql_type(), f.nullable and not f.primary_key, f.primary_key, f.unique, f.index, f.autoincrement, f.default, f.description)

    def sql(self, defaults: bool) -> str:
        parts = [f"`{self.name}` {self.type}"]
        if not self.nullable:
            parts.append("NOT NULL")
        if defaults and self.default is not MISSING and self.default is not None:
            parts.append(f"DEFAULT {sql_literal(self.default)}")
        if self.comment:
            parts.append(f"COMMENT {sql_literal(self.comment)}")
        return " ".join(parts)


@dataclass
class TableDefinition:
    """A table's name and columns. Keys, uniqueness and indexes are metadata: Spark keeps them as table properties."""

    name: str
    columns: dict[str, ColumnDefinition] = field(default_factory=dict)
    database: str | None = None

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns.values() if c.primary_key]

    @property
    def full_name(self) -> str:
        return f"`{self.database}`.`{self.name}`" if self.database else f"`{self.name}`"

    def properties(self) -> dict[str, str]:
        named = {"primary_key": self.primary_key, "unique": [c.name for c in self.columns.values() if c.unique], "index": [c.name for c in self.columns.values() if c.index], "autoincrement": [c.name for c in self.columns.values() if c.autoincrement]}
        return {f"contract.{k}": ",".join(v) for k, v in named.items() if v}

    def to_ddl(self, using: str = "parquet", defaults: bool = True, if_not_exists: bool = True) -> str:
        columns = ",\n  ".join(c.sql(defaults) for c in self.columns.values())
        props = ", ".join(f"{sql_literal(k)} = {sql_literal(v)}" for k, v in self.properties().items())
        return f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{self.full_name} (\n  {columns}\n) USING {using}" + (f"\nTBLPROPERTIES ({props})" if props else "")

    def create(self, spark, using: str = "parquet", defaults: bool = True) -> None:
        spark.sql(self.to_ddl(using, defaults))


def create_table(schema: type, table_name: str | None = None, database: str | None = None) -> TableDefinition:
    return TableDefinition(table_name or table_name_of(schema), {n: ColumnDefinition.of(f) for n, f in schema.fields().items()}, database)
