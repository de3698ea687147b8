"""A table in the shape of a contract: defaults added, columns cast leniently, selected and ordered."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..fields import FieldBase
from ..functions.spark import literal

log = logging.getLogger(__name__)


def default_column(field: FieldBase) -> Column:
    return literal(field.default).column.cast(field.type.spark)


def lenient(c: Column, have: T.DataType, field: FieldBase) -> Column:
    """The column as the field's type; a value that can't be is null, and never an error."""
    want = field.type
    if have == want.spark:
        return c
    text, number = isinstance(have, (T.StringType, T.VarcharType, T.CharType)), isinstance(have, T.NumericType)
    if want.name == "int" and text:
        return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("bigint"))
    if want.name == "bool" and text:
        return F.when(c == "true", True).when(c == "false", False)
    if want.name == "datetime" and isinstance(have, T.IntegralType):
        return F.timestamp_micros(c.cast("bigint")).try_cast("timestamp_ntz")
    if want.name == "date" and isinstance(have, T.IntegralType):
        return F.date_from_unix_date(c.try_cast("int"))
    if want.name in ("datetime", "date") and (number or isinstance(have, T.BooleanType)) or want.name in ("int", "float") and isinstance(have, (T.DateType,)):
        if want.name == "int":
            return F.unix_date(c).cast("bigint")
        return F.lit(None).cast(want.spark)
    if want.name == "int" and isinstance(have, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(have, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast(want.spark)
    return c.try_cast(want.spark)


def missing_columns(df: DataFrame, fields: dict[str, FieldBase]) -> list[str]:
    return [n for n, f in fields.items() if f.required and n not in df.columns]


def normalise(df: DataFrame, fields: dict[str, FieldBase]) -> DataFrame:
    """Columns in the contract's order and types, absent ones from their defaults, others dropped."""
    missing = missing_columns(df, fields)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name, field in fields.items():
        if name in kinds:
            c = F.col("`" + name.replace("`", "``") + "`")
            out.append(lenient(c, kinds[name], field).alias(name))
        else:
            log.info("added column %r with its default %r", name, field.default)
            out.append(default_column(field).alias(name))
    return df.select(*out)
