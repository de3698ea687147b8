"""Contracts over the test tables."""

from __future__ import annotations

from datetime import datetime

from .. import Field, Schema, col, model_validator


class LineitemSchema(Schema):
    l_orderkey: int
    l_linenumber: int = Field(ge=1, le=7)
    l_quantity: float = Field(ge=10, le=50)
    l_extendedprice: float = Field(gt=0)
    l_discount: float = Field(ge=0, le=0.05)
    l_returnflag: str = Field(pattern="^[AN]$")
    l_shipdate: datetime


class OrdersSchema(Schema):
    o_orderkey: int = Field(primary_key=True)
    o_totalprice: float = Field(gt=1000, lt=400000)
    o_orderdate: datetime = Field(ge=datetime(1996, 1, 1), lt=datetime(2000, 1, 1))
    o_orderpriority: str = Field(pattern="^[1-3]-")


class OrdersOpenSchema(Schema):
    o_orderkey: int
    o_orderdate: datetime = Field(gt=datetime(1996, 1, 1), le=datetime(1999, 12, 31))


class PartSchema(Schema):
    p_partkey: int
    p_size: int = Field(gt=3, lt=49, multiple_of=5)
    p_brand: str


class DocumentLengthSchema(Schema):
    doc_id: int
    text: str = Field(min_length=50, max_length=2000)


class NationSchema(Schema):
    n_nationkey: int = Field(primary_key=True)
    n_name: str = Field(max_length=25, unique=True, description="name of the nation")
    population: int = 0
    note: str | None = None


class FilledSchema(Schema):
    l_orderkey: int
    l_linenumber: int
    discount: float = Field(default=0.01)


class NotNullSchema(Schema):
    l_orderkey: int
    l_linenumber: int
    tax: float


class NullKeptSchema(Schema):
    l_orderkey: int
    l_linenumber: int
    discount: float | None = Field(le=1.0)


class NullDroppedSchema(Schema):
    l_orderkey: int
    l_linenumber: int
    discount: float | None = Field(le=0.05)


class CastSchema(Schema):
    o_orderkey: int
    level: int | None
    broken: int | None
    price: int
    day: str


class ChainSchema(Schema):
    l_orderkey: int
    l_linenumber: int
    l_quantity: float = Field(le=40)
    l_discount: float = Field(le=0.07)
    l_tax: float = Field(gt=0.01)


class CrossFieldSchema(Schema):
    l_orderkey: int
    l_linenumber: int
    l_quantity: float
    l_extendedprice: float
    discount: float | None
    l_tax: float

    @model_validator
    def reduced():
        return (col("l_extendedprice") * (1 - col("l_tax")) <= col("l_extendedprice"), "a reduced price is no higher")

    @model_validator
    def small_or_none():
        return col("discount").is_null() | (col("discount") < 0.1)

    @model_validator
    def raw(cls):
        from pyspark.sql import functions as F

        return (F.col("l_quantity") % 2 == 0, "even quantities")

    @model_validator
    def both(cls):
        return {"spark": (col("l_tax") < 0.08, "taxed below 8 %"), "python": lambda row: (row.l_tax < 0.08, "taxed below 8 %")}


class DocumentSchema(Schema):
    doc_id: int = Field(primary_key=True)
    text: str = Field(min_length=20)
    lang: str = Field(max_length=2)
    source: str
    n_chars: int = Field(ge=0)

    @model_validator
    def counted():
        return (col("n_chars") == col("text").str.len_chars(), "n_chars is the text's length")

    @model_validator
    def language():
        return (col("lang").is_in(["en", "de", "fr"]), "a known language")


class AccountSchema(Schema):
    c_custkey: int
    c_nationkey: int = Field(le=20)
    c_acctbal: float = Field(ge=0)
    c_mktsegment: str = "NONE"

    @model_validator
    def builders():
        return {"spark": (col("c_acctbal") >= 100, "too little to build"), "python": lambda row: (row.c_mktsegment != "BUILDING" or row.c_acctbal >= 100, "too little to build")}


class OddSchema(Schema):
    o_orderkey: int
    o_totalprice: float = Field(gt=50000)
    o_orderpriority: str = Field(pattern="(?=1)")

    @model_validator
    def mixed():
        return (col("o_orderkey") > "x", "a number above a text")

    @model_validator
    def absent():
        return (col("nowhere") > 1, "a column that isn't there")


class NationKeySchema(Schema):
    n_nationkey: int = Field(primary_key=True, autoincrement=True)
    n_name: str = Field(max_length=25, index=True)
    population: int = 0
    note: str | None
