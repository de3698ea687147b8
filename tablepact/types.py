"""The six logical column types, in Python, Spark and DDL."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import types as T


@dataclass(frozen=True)
class LogicalType:
    name: str
    python: type
    spark: T.DataType
    ddl: str


INT = LogicalType("int", int, T.LongType(), "BIGINT")
FLOAT = LogicalType("float", float, T.DoubleType(), "DOUBLE")
STR = LogicalType("str", str, T.StringType(), "STRING")
BOOL = LogicalType("bool", bool, T.BooleanType(), "BOOLEAN")
DATETIME = LogicalType("datetime", datetime, T.TimestampNTZType(), "TIMESTAMP_NTZ")
DATE = LogicalType("date", date, T.DateType(), "DATE")

BY_PYTHON = {t.python: t for t in (INT, FLOAT, STR, BOOL, DATETIME, DATE)}
SUPPORTED = "int, str, float, bool, datetime, date"
