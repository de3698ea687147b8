"""The row model over a table: each row is built as a record, in batches on the executors.

For rules that only have a row form (Python functions), and for checking that a table passes what its single records would have to.
Rules with a table form belong to the validator, which needs no Python on executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pydantic import ValidationError
from pyspark.sql import DataFrame, types as T

from ..rowmodel import create_row_model


def check_rows(df: DataFrame, schema: type, column: str = "errors") -> DataFrame:
    """``df`` with what is wrong with each row by the schema's row model ("field: message"); empty for a valid row. Columns that the schema doesn't name are kept."""
    if column in df.columns:
        raise ValueError(f"the table has a column {column!r} already")
    wanted = [n for n in df.columns if n in schema.fields()]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = create_row_model(schema)
        for batch in batches:
            said = []
            for row in batch.select(wanted).to_pylist():
                try:
                    model(**row)
                    said.append([])
                except ValidationError as e:
                    said.append([f"{'.'.join(map(str, x['loc'])) or 'row'}: {x['msg']}" for x in e.errors()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.list_(pa.string()))], [*batch.schema.names, column])

    return df.mapInArrow(checked, T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.StringType()))]))
