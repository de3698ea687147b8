"""Where tables come from and go to: files, databases, table definitions."""

from .ddl import TableDefinition, create_table
from .files import read_csv, read_jdbc, read_json, read_parquet, write_jdbc, write_parquet, write_table

__all__ = ["TableDefinition", "create_table", "read_csv", "read_jdbc", "read_json", "read_parquet", "write_jdbc", "write_parquet", "write_table"]
