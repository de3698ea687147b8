"""What a ``model_validator`` may return, and how it is read.

* an expression, or (expression, message)
* (Spark column, message), for tables only
* {"spark": expression, column, or either with a message; "python": function of a row}, each read by its own evaluator
"""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column

from .functions.nodes import Node
from .functions.rows import evaluate

log = logging.getLogger(__name__)

FAILED = "Validation failed"


def call(rule: Callable, schema: type) -> Any:
    """The rule's result; it gets the schema if it takes a parameter."""
    func = rule.__func__ if isinstance(rule, (classmethod, staticmethod)) else rule
    return func(schema) if inspect.signature(func).parameters else func()


def for_tables(result: Any) -> tuple[Node | Column, str]:
    """The rule over tables, and its message."""
    if isinstance(result, dict):
        if "spark" not in result:
            raise ValueError(f"a dict rule must have the key 'spark'; it has {sorted(result)}")
        return for_tables(result["spark"])
    expr, message = result if isinstance(result, tuple) and len(result) == 2 else (result, FAILED)
    if isinstance(expr, Column) and not isinstance(result, tuple):
        return expr, message
    if not isinstance(expr, (Node, Column)):
        raise ValueError(f"invalid validator result type: {type(expr).__name__}; expected an expression, (expression, message) or a dict")
    return expr, message


def for_rows(result: Any) -> Callable[[Any], None] | None:
    """A function that raises ValueError for a row that breaks the rule; None if the rule has no form for rows."""
    if isinstance(result, dict):
        check = result.get("python")
        if check is None:
            log.warning("the rule has no 'python' form and is applied to tables only")
            return None

        def apply(row: Any) -> None:
            said = check(row)
            if isinstance(said, tuple) and said and said[0] is False:
                raise ValueError(said[1] if len(said) > 1 else FAILED)

        return apply
    expr, message = result if isinstance(result, tuple) and len(result) == 2 else (result, FAILED)
    if not isinstance(expr, Node):
        return None

    def test(row: Any) -> None:
        try:
            ok = evaluate(expr, row)
        except ValueError:
            raise
        except Exception as e:
            raise ValueError(f"{message}: {e}") from e
        if not ok:
            raise ValueError(message)

    return test
