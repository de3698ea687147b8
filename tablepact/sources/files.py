"""Readers and writers that know a contract.

Readers ask for the contract's columns only, so that others aren't read. Text formats are read as strings and
cast by validation, which is lenient, and not by the reader, whose errors differ by format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _wanted(df: DataFrame, schema: type | None) -> DataFrame:
    return df if schema is None else df.select(*[F.col(f"`{n}`") for n in schema.fields() if n in df.columns])


def read_csv(spark: SparkSession, path: str, schema: type | None = None, header: bool = True, **options) -> DataFrame:
    return _wanted(spark.read.options(header=header, inferSchema=False, **options).csv(path), schema)


def read_json(spark: SparkSession, path: str, schema: type | None = None, **options) -> DataFrame:
    """With a contract, the columns that it names, as strings; the files aren't read to infer a schema."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in schema.fields()]))
    return reader.json(path)


def read_parquet(spark: SparkSession, *paths: str, schema: type | None = None, **options) -> DataFrame:
    return _wanted(spark.read.options(**options).parquet(*paths), schema)


def read_jdbc(spark: SparkSession, url: str, table: str, schema: type | None = None, **options) -> DataFrame:
    """Filters on the result are pushed to the database; ``partitionColumn`` and its bounds make the read parallel."""
    return _wanted(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), schema)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_table(df: DataFrame, name: str, mode: str = "append", **options) -> None:
    df.write.mode(mode).options(**options).saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 10_000, **options) -> None:
    """Each task inserts its rows in batches; none pass through the driver."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=batch_size, **options).save()
