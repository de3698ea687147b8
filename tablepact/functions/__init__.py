"""The column-expression language and its two evaluators: Spark columns and single rows."""

from .nodes import FieldRef, Node, col

__all__ = ["FieldRef", "Node", "col"]
