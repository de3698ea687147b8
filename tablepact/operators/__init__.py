"""Validation of tables."""

from .rowcheck import check_rows
from .validator import SparkValidator, ValidationReport

__all__ = ["SparkValidator", "ValidationReport", "check_rows"]
