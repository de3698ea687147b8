"""Models of single rows, for checking records where there is no table."""

from __future__ import annotations

import logging
import re
from typing import Annotated, Any, Optional

from pydantic import AfterValidator, BaseModel, Field, create_model, model_validator

from .fields import MISSING
from .functions.regex import to_python
from .rules import call, for_rows

log = logging.getLogger(__name__)


def _matching(pattern: str) -> AfterValidator:
    found = re.compile(to_python(pattern)).search

    def check(value: str | None) -> str | None:
        if value is not None and not found(value):
            raise ValueError(f"must match pattern: {pattern}")
        return value

    return AfterValidator(check)


def create_row_model(schema: type) -> type[BaseModel]:
    """A Pydantic model named after the schema (``PersonSchema`` gives ``PersonModel``)."""
    fields: dict[str, Any] = {}
    for name, f in schema.fields().items():
        kind: Any = Optional[f.type.python] if f.nullable else f.type.python
        if f.constraints.get("pattern"):
            kind = Annotated[kind, _matching(f.pattern)]
        said = f.get_model_kwargs()
        if f.description:
            said["description"] = f.description
        fields[name] = (kind, Field(**said) if f.default is MISSING else Field(default=f.default, **said))
    checks = [c for c in (for_rows(call(r, schema)) for r in schema.model_validators()) if c is not None]
    name = schema.__name__.replace("Schema", "") + "Model"
    model = create_model(name, **fields)
    if not checks:
        return model

    class Checked(model):  # type: ignore[misc, valid-type]
        @model_validator(mode="after")
        def _rules(self):
            for check in checks:
                try:
                    check(self)
                except Exception as e:
                    log.warning("a rule failed: %s", e)
                    raise
            return self

    Checked.__name__ = Checked.__qualname__ = name
    return Checked
