"""Contracts on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.validator import SparkValidator, ValidationReport


def filter_stream(stream: DataFrame, schema: type, fill_nulls: bool = False) -> DataFrame:
    """A stream's valid rows, each judged by itself, without state or micro-batch boundaries."""
    return SparkValidator(schema).row_filter(stream, fill_nulls)


def validate_batches(stream: DataFrame, schema: type, sink: Callable[[DataFrame, int], None], on_report: Callable[[ValidationReport, int], None] | None = None, strict: bool = False, fill_nulls: bool = False) -> DataStreamWriter:
    """A writer that validates each micro-batch as a table of its own and hands its valid rows to ``sink``.

    A batch is read twice (to decide and to write), so it is persisted meanwhile. ``sink`` gets the batch id, with
    which it can make its writes idempotent.
    """
    validator = SparkValidator(schema)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sink(validator.validate(batch, strict=strict, fill_nulls=fill_nulls), batch_id)
            if on_report:
                on_report(validator.report, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)


__all__ = ["filter_stream", "validate_batches"]
