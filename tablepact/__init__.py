"""tablepact: declarative table contracts on Spark.

A class describes a table once: types, nullability, defaults, constraints and rules across columns. From it come a
validator of DataFrames, a model of single rows, and table definitions.
"""

from .fields import Date, Field, FieldBase, FieldInfo
from .functions.nodes import FieldRef, col
from .schema import Schema, model_validator

__version__ = "0.1.0"
__all__ = ["Date", "Field", "FieldBase", "FieldInfo", "FieldRef", "Schema", "col", "model_validator"]
